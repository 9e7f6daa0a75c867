"""No row is moved to meet a table known to be small, and no carried value with it."""

from pyspark.sql import functions as F

from sessionloom.operators import pricing, scan, scope
from sessionloom.session import prepare


def counting(monkeypatch, module):
    plain, stored = module.materialize, []

    def counted(df):
        stored.append(df)
        return plain(df)

    monkeypatch.setattr(module, "materialize", counted)
    return stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_carried_values_are_spelled_out_after_the_rows_are_moved(spark, monkeypatch):
    stored = counting(monkeypatch, scan)
    rows = spark.createDataFrame([("a", i, i if i % 5 == 0 else None) for i in range(40)], "k string, o bigint, v bigint")
    done = scan.carry_last(rows, ["k"], "o", {"x": scan.Carry(F.col("v") * 2)}, scan.chunk_of(F.col("o"), 7))
    assert {(r.o, r.x) for r in done.collect()} == {(i, i // 5 * 10) for i in range(40)}
    assert len(stored) == 2  # the pass and what crosses chunks
    passed = stored[0]._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in passed and "_v_x" not in passed.split("RepartitionByExpression")[1]


def test_small_tables_are_stored_before_rows_meet_them(spark, monkeypatch):
    prices, directories = counting(monkeypatch, pricing), counting(monkeypatch, scope)
    rows = spark.createDataFrame([(i, "gpt-5-mini" if i % 2 else "no-such-model", "/repo/1/x") for i in range(20)], "i int, model string, cwd string")
    assert {(r.i, r.price is not None) for r in pricing.with_price(rows, "model", pricing.price_epoch(pricing.default_price_time())).collect()} == {(i, i % 2 == 1) for i in range(20)}
    repos = spark.createDataFrame([(1, "/repo/1", "f")], "repo_id bigint, root string, fingerprint string")
    assert [tuple(r) for r in scope.scope_directories(rows, repos, "cwd").collect()] == [("/repo/1/x", 1, "f", "subdirectory")]
    assert len(prices) == 1 and len(directories) == 1


def test_generated_methods_can_be_compiled(spark):
    prepare(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
