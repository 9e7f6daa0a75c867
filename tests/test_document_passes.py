"""Documents that are checked are neither stored level by level nor moved."""

import json

from sessionloom.operators import documents
from sessionloom.plans import publish


def counting(monkeypatch, module):
    plain, stored = module.materialize, []

    def counted(df):
        stored.append(df)
        return plain(df)

    monkeypatch.setattr(module, "materialize", counted)
    return stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_levels_of_documents_are_not_stored(spark, monkeypatch):
    stored = counting(monkeypatch, documents)
    deep = "end"
    for i in range(2 * documents.LEVELS + 1):
        deep = [deep] if i % 2 else {"a": deep, "b": i}
    rows = spark.createDataFrame([(1, json.dumps({"a": {"b": ["x"]}}))], "id int, doc string")
    nodes = documents.document_nodes(rows, ["id"], "doc")
    assert {(r.path, r.kind, r.text) for r in nodes.collect()} == {("$.a", "nested", None), ("$.a.b", "nested", None), ("$.a.b[0]", "string", "x")}
    assert not stored and "Exchange" not in plan(nodes)
    assert documents.document_nodes(spark.createDataFrame([(1, json.dumps(deep))], "id int, doc string"), ["id"], "doc").count() == 3 * documents.LEVELS + 2
    assert len(stored) == 2


def test_findings_are_counted_without_the_documents(spark, tmp_path):
    rows = [(1, "fine"), (1, "mail a@b.co or c@d.co"), (1, "mail a@b.co or c@d.co"), (2, "fine"), (None, "mail a@b.co")]
    staged = publish.stage({"s": publish.Section(spark.createDataFrame(rows, "repo_id bigint, t string"))})
    staged.write.parquet(f"{tmp_path}/staged")
    staged = spark.read.parquet(f"{tmp_path}/staged")
    found = publish.findings(staged).localCheckpoint()
    verdict = publish.verdicts(staged, found)
    assert {tuple(r) for r in verdict.collect()} == {(1, 3, 2, False), (2, 1, 0, True), (None, 1, 0, True)}
    read = [line for line in plan(verdict).splitlines() if "FileScan" in line]
    assert read and all("ReadSchema: struct<repo_id:bigint>" in line for line in read)
