"""Publishing in two phases: sections are staged, checked as a whole, and committed for the repositories that pass."""

from __future__ import annotations

import uuid
from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionloom.functions.canonical import canonical
from sessionloom.operators.documents import document_leaks, document_nodes
from sessionloom.operators.quality import FORBIDDEN_KEYS
from sessionloom.session import materialize

_ROW = ["repo_id", "section", "row"]


@dataclass(frozen=True)
class Section:
    """Rows with a ``repo_id``; every other column is part of the row's document. ``nulls`` as in ``canonical``."""

    rows: DataFrame
    nulls: Collection[str] = ()

    @property
    def schema(self) -> StructType:
        return StructType([f for f in self.rows.schema.fields if f.name != "repo_id"])


def section_documents(name: str, section: Section) -> DataFrame:
    """(repo_id, section, row, document): one canonical document a row; ``row`` is the digest that names it."""
    kind = section.schema
    text = canonical(F.struct(*[F.col(f"`{f.name}`") for f in kind.fields]), kind, section.nulls)
    rows = section.rows.select("repo_id", F.lit(name).alias("section"), text.alias("document"))
    return rows.select("repo_id", "section", F.sha2("document", 256).alias("row"), "document")


def stage(sections: dict[str, Section]) -> DataFrame:
    """Documents of all sections, stored before anything is checked: what is checked is what is committed later.

    The digest of a row follows from its document and is not stored.
    """
    rows = reduce(DataFrame.unionByName, [section_documents(n, s) for n, s in sorted(sections.items())])
    return materialize(rows.drop("row")).select("repo_id", "section", F.sha2("document", 256).alias("row"), "document")


def findings(staged: DataFrame) -> DataFrame:
    """(repo_id, section, row, path, kind, category) of everything that must not be published, at any depth of a document."""
    return document_leaks(document_nodes(staged, _ROW, "document"), _ROW, FORBIDDEN_KEYS)


def verdicts(staged: DataFrame, found: DataFrame) -> DataFrame:
    """Per repository: documents, documents with findings, and whether it may be published; one finding stops all of it.

    A document that is staged n times has each of its findings n times, so only findings are moved, never documents.
    """
    every = staged.groupBy("repo_id").agg(F.count(F.lit(1)).alias("documents"))
    copies = found.groupBy(*_ROW, "path", "kind", "category").agg(F.count(F.lit(1)).alias("n")).groupBy(*_ROW).agg(F.max("n").alias("n"))
    leaking = copies.groupBy("repo_id").agg(F.sum("n").alias("n"))
    bad = F.coalesce("n", F.lit(0))
    return every.join(leaking, "repo_id", "left").select("repo_id", "documents", bad.alias("leaking_documents"), (bad == 0).alias("passed"))


def commit(staged: DataFrame, verdict: DataFrame, path: str) -> DataFrame:
    """Write what passed below ``path`` and a manifest last; gives the manifest (repo_id, section, documents, digest).

    A section is ``<path>/section=<name>/repo_id=<id>/*.json`` with one document a record. A reader goes by the manifest, so a
    run that ends before it has published nothing. The digest is the sum of the row digests' leading 56 bits: it does
    not depend on the order of rows or files, and repeated rows count.
    """
    passed = staged.join(verdict.filter("passed"), "repo_id", "left_semi")
    records = passed.select("section", "repo_id", F.regexp_replace("document", "\n *", " ").alias("value"))
    records.write.mode("overwrite").partitionBy("section", "repo_id").text(f"{path}/documents")
    part = F.conv(F.left("row", F.lit(14)), 16, 10).cast("decimal(38,0)")
    total = passed.groupBy("repo_id", "section").agg(F.count(F.lit(1)).alias("documents"), F.sum(part).cast("string").alias("digest"))
    total.write.mode("overwrite").parquet(f"{path}/manifest")
    return total.sparkSession.read.parquet(f"{path}/manifest")


def read_published(spark: SparkSession, path: str, name: str, kind: StructType) -> DataFrame:
    """A published section as a typed table: its documents, of the repositories the manifest lists."""
    listed = spark.read.parquet(f"{path}/manifest").filter(F.col("section") == name).select("repo_id")
    raw = spark.read.schema("value string, section string, repo_id bigint").text(f"{path}/documents").filter(F.col("section") == name)
    return raw.join(listed, "repo_id", "left_semi").select("repo_id", F.from_json("value", kind).alias("r")).select("repo_id", "r.*")


def publish(sections: dict[str, Section], path: str) -> tuple[DataFrame, DataFrame]:
    """Stage, check and commit; gives the verdicts and the manifest."""
    staged = stage(sections)
    verdict = materialize(verdicts(staged, findings(staged)))
    return verdict, commit(staged, verdict, path)


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("publishing needs a folder that all executors share: set spark.checkpoint.dir or pass a path")
    return f"{folder.rstrip('/')}/sessionloom/{spark.sparkContext.applicationId}/published-{uuid.uuid4().hex}"
