"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.base import stash, table

WORD = r"[^\x20\x09-\x0D]+"
_GRID = 4096  # virtual time is cut into this many slices per unit when the budget's end is located


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], ratio: float, repeats: int) -> DataFrame:
    """Target words per source (rows: source, source_size): shares by weight, at most ``repeats`` times a source.

    Water filling in closed form: with sources in order of cap / weight, a source is
    capped if its cap does not reach the level that the sources before it leave.
    One row per source, so the global windows stay small.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn("weight", F.element_at(w, ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    everything = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(ratio)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(onward))
        .withColumn("capped", F.col("cap") * F.col("rest") <= F.col("left") * F.col("weight"))
    )
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    level = (F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))) / free
    return ranked.select("source", "source_size", "budget", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def _place() -> Column:
    """Place of a document in its source's shuffled order."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, repeats: int = 2) -> DataFrame:
    """How many words the mix takes of every document: doc_id, source, size, source_size, target, passes, taken, h, version.

    Every source's documents stand in one shuffled order (md5 of the id), ``repeats`` times
    over. A document finishes at virtual time (words of its source so far) / (target of its
    source); all are sorted by finish time over all sources and taken until the budget,
    ``ratio`` times all words, is spent; the last one may be taken in part. ``passes`` has
    the words taken in each pass, ``h`` is the place in the shuffled order and ``version`` a hash of the text.

    Running sums never need a whole source in one task: sums of 256 hash ranges, then of 256
    ranges in each, then the rows of one. The end of the budget is found over slices of
    virtual time; only the slice it falls in is ordered.

    Null or empty text has size 0 and takes nothing; a row with a null id is shuffled by its text instead, so
    that many of them spread over the ranges like other documents;
    repeated rows count separately; a null source is a source, last in order; an empty table
    gives an empty result. Other columns are ignored.
    """
    rows = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _place().alias("h"), F.xxhash64("text").alias("version")))
    key = rows.withColumn("b1", F.shiftright("h", 52)).withColumn("b2", F.shiftright("h", 44))
    sums = stash(key.groupBy("source", "b1", "b2").agg(F.sum("size").alias("s2")))
    s1 = sums.groupBy("source", "b1").agg(F.sum("s2").alias("s1"))
    prior = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    s1 = s1.select("source", "b1", F.coalesce(F.sum("s1").over(prior(Window.partitionBy("source").orderBy("b1"))), F.lit(0)).alias("o1"))
    s2 = sums.select("source", "b1", "b2", F.coalesce(F.sum("s2").over(prior(Window.partitionBy("source", "b1").orderBy("b2"))), F.lit(0)).alias("o2"))
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    offsets = s2.join(s1, same(s2, s1, ["source", "b1"]), "left").select(s2["source"], s2["b2"], (F.col("o1") + F.col("o2")).alias("offset"))
    targets = stash(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ratio, repeats))

    fine = Window.partitionBy("source", "b2").orderBy("h", "doc_id", "size", "version")
    within = key.withColumn("cum", F.sum("size").over(fine.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(fine))
    placed = within.join(offsets, same(within, offsets, ["source", "b2"]), "left").select(within["*"], offsets["offset"])
    placed = placed.join(targets, same(placed, targets, ["source"]), "left").select(placed["*"], targets["source_size"], targets["target"], targets["budget"])
    turns = placed.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    turns = turns.withColumn("finish", F.when(F.col("target") > 0, (F.col("offset") + F.col("cum") + F.col("pass") * F.col("source_size")).cast("double") / F.col("target")))
    slice_no = F.least(F.floor(F.col("finish") * _GRID), F.lit(2 * _GRID)).cast("long")
    turns = stash(turns.select("doc_id", "source", "size", "h", "version", "nth", "source_size", "target", "budget", "pass", "finish", slice_no.alias("slice")))

    spent = turns.where("slice is not null").groupBy("slice").agg(F.sum("size").alias("in_slice"))
    spent = spent.select("slice", F.coalesce(F.sum("in_slice").over(prior(Window.orderBy("slice"))), F.lit(0)).alias("spent"), "in_slice")
    turns = turns.join(F.broadcast(spent), "slice", "left")  # at most 2 * _GRID + 1 rows
    cut = (F.col("spent") < F.col("budget")) & (F.col("spent") + F.col("in_slice") > F.col("budget"))
    turns = turns.withColumn("cut", F.coalesce(cut, F.lit(False))).withColumn("part", F.when(F.col("cut"), F.lit(-1)).otherwise(F.col("h")))
    order = Window.partitionBy("part").orderBy("finish", F.col("source").asc_nulls_last(), "h", "doc_id", "size", "nth", "pass")
    upto = F.col("spent") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("budget")).cast("long") - (upto - F.col("size"))))
    whole = F.when(F.col("spent") < F.col("budget"), F.col("size")).otherwise(F.lit(0))
    took = turns.withColumn("took", F.when(F.col("slice").isNull(), F.lit(0)).when(F.col("cut"), part).otherwise(whole).cast("long"))
    each = [F.sum(F.when(F.col("pass") == i, F.col("took"))).alias(f"p{i}") for i in range(repeats)]
    out = took.groupBy("source", "h", "doc_id", "nth").agg(F.first("size").alias("size"), F.first("version").alias("version"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), *each)
    passes = F.array(*[F.col(f"p{i}") for i in range(repeats)])
    return out.select("doc_id", "source", "size", "source_size", "target", passes.alias("passes"), F.aggregate(passes, F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"), "h", "version")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of the mix: one row for each pass that takes words of a document.

    A document taken in part keeps its first words, joined by spaces; ``n_chars`` follows.
    Documents without words take nothing and do not appear. Rows that agree in id, source and text (nulls are
    equal) all follow the one that takes most.
    """
    mixed = fair_mix(docs, **options).groupBy("doc_id", "source", "h", "version").agg(F.max("passes").alias("__passes"))
    mixed = mixed.select(*[F.col(c).alias(f"__of_{c}") for c in ("doc_id", "source", "h", "version")], "__passes")
    rows = docs.withColumn("__size", word_count(F.col("text"))).withColumn("__h", _place()).withColumn("__version", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(mixed["__of_doc_id"]) & rows["source"].eqNullSafe(mixed["__of_source"])
    same &= (rows["__h"] == mixed["__of_h"]) & (rows["__version"] == mixed["__of_version"])
    rows = rows.join(mixed, same).select(*docs.columns, "__size", F.explode("__passes").alias("__took")).where("__took > 0")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), F.col("__took").cast("int")), " ")
    text = F.when(F.col("__took") >= F.col("__size"), F.col("text")).otherwise(first)
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             (source_size * 2)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM src),
fill AS (SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS capped FROM w),
tgt AS (SELECT source, source_size, budget, CASE WHEN capped THEN cap ELSE
    (budget - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN weight END) OVER () * weight END AS target FROM fill),
cum AS (SELECT docs.*, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum,
    row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size) AS nth FROM docs),
turns AS (SELECT cum.*, t.source_size, t.target, t.budget, p.pass, CASE WHEN t.target > 0 THEN (cum.cum + p.pass * t.source_size)::DOUBLE / t.target END AS finish
    FROM cum JOIN tgt t ON cum.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) p(pass)),
spent AS (SELECT *, sum(CASE WHEN finish IS NULL THEN 0 ELSE size END)
    OVER (ORDER BY finish NULLS LAST, source NULLS LAST, h, doc_id, size, nth, pass ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM turns),
took AS (SELECT *, CASE WHEN finish IS NULL THEN 0 ELSE greatest(0, least(size, floor(budget)::BIGINT - (upto - size))) END::BIGINT AS took FROM spent)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, sum(took)::BIGINT AS taken
FROM took GROUP BY source, h, doc_id, nth
"""
