"""Shared helpers: intermediate tables in the cluster's shared folder, id folds, Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a temporary one of the driver, in local mode only (tests)."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not folder:
            folder = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="sessionloom-")
    return folder.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Cuts the lineage, survives lost executors, and later reads prune columns.
    """
    path = f"{shared_folder(df.sparkSession)}/llm/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop_stash(*tables: DataFrame) -> None:
    """Remove stashed tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def drawn(column: str, share: float) -> Column:
    """Whether a row belongs to a sample of this share, by a hash of one column; any positive share draws rows."""
    parts = max(1, int(share * 1_000_000))
    rest = min(1.0, share * 1_000_000 / parts)
    first = F.pmod(F.xxhash64(column), F.lit(1_000_000)) < parts
    return first & (F.lit(True) if rest == 1.0 else F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(column)), 1) < F.lit(int(rest * (1 << 63))))


def id_fold(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], slice_bytes: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a factory: ``make`` runs once per task, its result once per batch.

    With ``slice_bytes`` a larger batch is handed over in slices of about so many bytes, so that what
    is made of its rows is never held for the whole batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            parts = -(-batch.nbytes // slice_bytes) if slice_bytes else 1
            rows = max(1, batch.num_rows // max(1, parts))
            for at in range(0, batch.num_rows, rows):
                out = step(batch.slice(at, rows))
                if out is not None:
                    yield out
        pa.default_memory_pool().release_unused()  # workers are used again and would keep what the largest batch took

    return run


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    Contraction: every node joins the neighbour (or itself) with the smallest salted
    hash, edges are renamed to those leaders, loops and repeats go. The salt changes
    each round, so a chain shrinks by a constant factor too and the number of rounds
    is logarithmic. Each round is written to the shared folder; nothing is collected.
    Nulls and loops in the edges are ignored; an empty edge table gives an empty result.
    """
    kind = dict(edges.dtypes)[left]
    a, b = F.col(left).cast(kind), F.col(right).cast(kind)
    live = stash(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    nodes, turn = None, 0
    while not live.isEmpty():
        both = live.union(live.select("v", "u"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("n"))
        lead = stash(
            both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m"))
            .select("u", F.least(F.col("m"), rank(F.col("u"))).getField("n").alias("lead"))
        )
        if nodes is None:
            moved = stash(lead.select(F.col("u").alias("node"), F.col("lead").alias("cur")))
        else:
            moved = stash(nodes.join(lead, nodes["cur"] == lead["u"], "left").select("node", F.coalesce("lead", "cur").alias("cur")))
        l1, l2 = lead.select(F.col("u"), F.col("lead").alias("a")), lead.select(F.col("u").alias("v"), F.col("lead").alias("b"))
        renamed = live.join(l1, "u").join(l2, "v").where("a <> b")
        after = stash(renamed.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        drop_stash(*(t for t in (nodes, live, lead) if t is not None))
        nodes, live, turn = moved, after, turn + 1
    if nodes is None:
        return live.select(F.col("u").alias("node"), F.col("u").alias("component"))
    least = nodes.groupBy("cur").agg(F.min("node").alias("component"))
    return nodes.join(least, "cur").select("node", "component")
