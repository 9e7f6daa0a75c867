"""Raw lines are written once."""

from datetime import datetime

from sessionloom.views import raw_logs


def test_lines_are_stored_once(spark, tmp_path, monkeypatch):
    rows = [(i, datetime(2024, 1, 2), i % 4, t, 1.5, f'{{"k": {i}}}') for i in range(80) for t in ["purchase"]]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    plain, stored = raw_logs.materialize, []

    def counted(df):
        stored.append(df.columns)
        return plain(df)

    monkeypatch.setattr(raw_logs, "materialize", counted)
    lines = raw_logs.counter_lines(spark, str(tmp_path)).collect()
    assert stored == [["source_id", "source_kind", "ordinal", "line"]] and len(lines) == 40
    for r in lines:
        n = r.ordinal
        broken = n % 37 == 5 or n % 41 == 3
        assert (r.line == "[1, 2]" if n % 41 == 3 and n % 37 != 5 else len(r.line) == 10 if broken else r.line.startswith("{") and r.line.endswith("}")), n
