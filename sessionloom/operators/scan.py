"""Ordered-log primitives that split a hot key.

A window over a whole session, source or repository puts that group into one
task, however large it is. Both primitives below bound the group by a *chunk*
of the order instead: the heavy pass works per ``(key, chunk)``, a summary of
one row per chunk carries what crosses chunk borders, and the two are joined.
Carrying reads its input once, however many values are carried.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.session import materialize

# Rows of one log that share a task. A 100 TB log of 1 KB records has under a
# million chunks, so the summary pass stays small as well.
CHUNK_ROWS = 1 << 17


_BASE = Decimal(10) ** 15


def _any_present(prefix: str, names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"{prefix}{n}").isNotNull() for n in names])


def pack(major: Column, minor: Column) -> Column:
    """Two longs as one ordered number, so that min/max over pairs stay hash aggregates.

    Aggregation buffers of structs or strings would make Spark sort the input.
    """
    return (major.cast("decimal(20,0)") * F.lit(_BASE) + minor.cast("decimal(20,0)")).cast("decimal(38,0)")


def pack_reversed(major: Column, minor: Column) -> Column:
    """As ``pack``, the smaller ``minor`` counting as larger."""
    return pack(major, F.lit(int(_BASE) - 1) - minor)


def major_of(packed: Column) -> Column:
    return F.call_function("div", packed, F.lit(_BASE)).cast("long")


def minor_of(packed: Column) -> Column:
    return (packed % F.lit(_BASE)).cast("long")


def minor_of_reversed(packed: Column) -> Column:
    return F.lit(int(_BASE) - 1) - minor_of(packed)


@dataclass(frozen=True)
class Carry:
    """Last non-null ``value`` up to a row, with or without the row itself.

    ``backward`` looks from the end instead: the next non-null value.
    """

    value: Column
    inclusive: bool = True
    backward: bool = False


def chunk_of(order: Column, rows: int = CHUNK_ROWS) -> Column:
    return F.floor(order / F.lit(rows)).cast("long")


def carry_last(
    df: DataFrame,
    keys: list[str],
    order: str,
    carries: dict[str, Carry],
    chunk: Column | None = None,
) -> DataFrame:
    """Add one column per carry: the running last non-null value within ``keys``.

    A segmented prefix scan that reads ``df`` once. One pass, partitioned by (keys, chunk) and sorted by ``order``, gives
    every row the values carried inside its chunk, and leaves on the chunk's border rows what the chunk hands on. It is
    stored; the border rows, one or two a chunk, are summed up along the chunks and joined back to the rows. What crosses is
    stored as well, only keys that span chunks have any: the join knows its size and leaves the rows where they are.
    """
    chunk = chunk_of(F.col(order)) if chunk is None else chunk
    parts = [*keys, "_chunk"]
    moved = df.withColumn("_chunk", chunk).repartition(*parts)  # before the carried values are spelled out beside the columns they come from
    base = moved.withColumns({f"_v_{n}": c.value for n, c in carries.items()})
    along = {side: Window.partitionBy(*parts).orderBy(F.desc(order) if side else F.asc(order)) for side in {c.backward for c in carries.values()}}

    def inside(n: str, c: Carry) -> Column:
        return F.last(f"_v_{n}", ignorenulls=True).over(along[c.backward].rowsBetween(Window.unboundedPreceding, 0 if c.inclusive else -1))

    def handed_on(n: str, c: Carry) -> Column:
        return F.when(F.col(f"_end_{c.backward}"), F.coalesce(f"_v_{n}", f"_l_{n}"))

    scanned = (
        base.withColumns({
            **{f"_l_{n}": inside(n, c) for n, c in carries.items()},
            **{f"_end_{side}": F.lead(F.lit(True)).over(window).isNull() for side, window in along.items()},
        })
        .withColumns({f"_s_{n}": handed_on(n, c) for n, c in carries.items()})
        .drop(*[f"_v_{n}" for n in carries])
    )
    scanned = materialize(scanned.withColumn("_border", reduce(lambda a, b: a | b, [F.col(f"_end_{side}") for side in along])).drop(*[f"_end_{side}" for side in along]))

    def from_other_chunks(c: Carry):
        to = F.desc("_chunk") if c.backward else F.asc("_chunk")
        return Window.partitionBy(*keys).orderBy(to).rowsBetween(Window.unboundedPreceding, -1)

    borders = scanned.filter("_border").select(*parts, *[f"_s_{n}" for n in carries])
    if len(along) > 1:  # the first and the last row of a chunk
        borders = borders.groupBy(*parts).agg(*[F.max(f"_s_{n}").alias(f"_s_{n}") for n in carries])
    crossing = borders.select(
        *parts, *[F.last(f"_s_{n}", ignorenulls=True).over(from_other_chunks(c)).alias(f"_c_{n}") for n, c in carries.items()]
    )
    crossing = materialize(crossing.filter(_any_present("_c_", list(carries))))
    return scanned.join(crossing, parts, "left").select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in carries],
    )


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Dense position 1, 2, ... of each row within ``keys``.

    ``bucket`` is a value that never decreases along ``order``; a task sorts one
    bucket of one key, and the counts of earlier buckets are added afterwards.
    """
    base = df.withColumn("_bucket", bucket)
    parts = [*keys, "_bucket"]
    counts = base.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*parts, F.sum("_n").over(earlier).alias("_offset")).filter(F.col("_offset").isNotNull())
    local = base.withColumn("_local", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    return local.join(offsets, parts, "left").select(
        *[F.col(c) for c in df.columns],
        (F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))).cast("long").alias(out),
    )


def _log_bucket(value: Column) -> Column:
    """Monotone bucket of a non-negative long: 11 leading bits plus magnitude."""
    shift = F.greatest(F.length(F.bin(value)) - 11, F.lit(0)).cast("int")
    return (shift.cast("long") * 4096 + F.call_function("shiftright", value, shift)).cast("long")


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics of a non-negative long per key, without sorting a whole key.

    ``ranks`` maps an output column to a 1-based rank, a Column over ``_n`` (the
    group size). A histogram of at most a few ten thousand buckets per key finds
    the bucket that holds the rank; only that bucket is then resolved by value.
    """
    valued = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("long").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_bucket", _log_bucket(F.col("_value")))
    )
    hist = valued.groupBy(*keys, "_bucket").agg(F.sum("_count").alias("_count"))
    by_key = Window.partitionBy(*keys)
    hist = hist.withColumns(
        {
            "_cum": F.sum("_count").over(by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)),
            "_n": F.sum("_count").over(by_key),
        }
    )
    wanted = hist.select(
        *keys, "_bucket", "_cum", "_count",
        F.explode(F.array(*[F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank")) for n, r in ranks.items()])).alias("_w"),
    ).filter((F.col("_w.rank") <= F.col("_cum")) & (F.col("_w.rank") > F.col("_cum") - F.col("_count")))
    wanted = wanted.select(
        *keys, "_bucket", F.col("_w.name").alias("_name"),
        (F.col("_w.rank") - (F.col("_cum") - F.col("_count"))).alias("_rank"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    resolved = valued.join(wanted.select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi").withColumn(
        "_upto", F.sum("_count").over(inside)
    )
    hits = resolved.join(wanted, [*keys, "_bucket"]).filter(
        (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_count"))
    )
    return hits.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in ranks]
    )
