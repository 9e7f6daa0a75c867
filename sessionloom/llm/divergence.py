"""How sources of one language differ: exact divergences ranked over cells of equal counts."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.base import drop_stash, stash, table

_SCALE = 1_000_000_000
_LETTER = lambda c: c > 0x7F or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A
#: A byte of a term as it is, but A-Z in lower case; any other byte becomes a space. Bytes above 0x7F belong to letters beyond ASCII.
_FOLD = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if _LETTER(c) else 0x20 for c in range(256))


def terms(text: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded size; a list ends between two terms."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + step)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def term_counts(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, added up over a task's rows up to ``flush`` different ones."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = defaultdict(Counter)
        among: dict = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in found.items():
                inside = among[lang, source]
                words = pa.array(list(counts), pa.binary()).cast(pa.string())
                same = lambda value, n=len(words): pa.repeat(pa.scalar(value, pa.string()), n)
                numbers = pa.array(list(counts.values()), pa.int64()), pa.array([inside[w] for w in counts], pa.int64())
                for at in range(0, len(words), 20_000):
                    yield pa.RecordBatch.from_arrays([x.slice(at, 20_000) for x in (same(lang), same(source), words, *numbers)], schema=schema)
            found.clear()
            among.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                counts, own = found[lang, source], set()
                for part in terms(text.as_py()):
                    counts.update(part)
                    own.update(part)
                among[lang, source].update(own)
                if sum(map(len, found.values())) > flush:
                    yield from rows()
        yield from rows()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _wide(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def _p(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / (total + kept)); null where nothing is kept."""
    return (F.lit(1) + F.call_function("div", F.lit(_SCALE).cast("decimal(10,0)") * _wide(count + 1), F.when(kept > 0, _wide(total + kept)))).cast("long")


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, salts: int = 16) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) group of ``docs``; null texts, languages and sources read as ''.

    The value of a term depends only on how often it stands in the group and in the language, so terms are grouped into cells
    by these two counts and the value is computed once a cell, in exact integers. Cells of a group are merged by value and ranked
    by the number of terms in them; only cells that begin within the first ``top`` ranks are expanded into terms, in UTF-8 order.
    For pairs of sources the cells are pairs of counts. Terms whose counts agree in every source are merged before pairs are
    formed; terms that one or both of a pair lack enter through each source's own cells.

    Terms are added up per task before one shuffle by (lang, term). Hot cells are salted when they are expanded; windows see at most
    ``top`` rows of a group from each task. An empty table gives an empty result; other columns are ignored; repeated rows count
    as documents of their own.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per_term = counted.groupBy("lang", "term").agg(
        F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"), F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")
    )
    kept = stash(per_term.where(F.col("docs") >= least_docs).drop("docs"))
    alike = stash(kept.groupBy("lang", "counts", "in_lang").agg(F.count("*").alias("terms")))
    cells = stash(
        alike.select("lang", "in_lang", "terms", F.explode("counts").alias("c"))
        .groupBy("lang", F.col("c.source").alias("source"), F.col("c.n").alias("in_group"), "in_lang").agg(F.sum("terms").alias("terms"))
    )
    totals = cells.groupBy("lang", "source").agg(F.sum(F.col("in_group") * F.col("terms")).alias("words"))
    langs = alike.groupBy("lang").agg(F.sum("terms").alias("kept"), F.sum(F.col("in_lang") * F.col("terms")).alias("lang_words"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stash(groups.na.fill(0, ["words", "kept", "lang_words"]))

    # terms
    p, q = _p(F.col("in_group"), F.col("words"), F.col("kept")), _p(F.col("in_lang"), F.col("lang_words"), F.col("kept"))
    valued = cells.join(groups, ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("p > q").withColumn("value", _f(F.col("p"), F.col("q")))
    valued = stash(valued.select("lang", "source", "in_group", "in_lang", "terms", "value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    levels = valued.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms")).withColumn("level", F.row_number().over(by_value)).where(F.col("level") <= top)
    before = F.coalesce(F.sum("terms").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value", "before")
    open_cells = valued.drop("terms").join(levels, ["lang", "source", "value"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = kept.select("lang", "term", "in_lang", F.explode("counts").alias("c"))
    spread = spread.select("lang", "term", "in_lang", F.col("c.source").alias("source"), F.col("c.n").alias("in_group"), F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt"))
    in_order = F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("term"))
    named = spread.join(open_cells, ["lang", "source", "in_group", "in_lang", "salt"]).withColumn("place", in_order).where(F.col("place") <= top)
    named = named.withColumn("rank", (F.col("before") + F.col("place")).cast("int")).where(F.col("rank") <= top)
    by_term = named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # pairs of sources; a and b are a term's counts in the two
    others = groups.select("lang", F.col("source").alias("item"), F.col("words").alias("item_words"))
    pairs = groups.select("lang", "source", "words", "kept").join(others, "lang").where("source <> item")
    f = lambda a, b: _wide(_f(_p(a, F.col("words"), F.col("kept")), _p(b, F.col("item_words"), F.col("kept"))))
    zero, a, b, terms_ = F.lit(0).cast("long"), F.col("a"), F.col("b"), F.col("terms").cast("decimal(18,0)")
    later = alike.select("lang", "counts", "terms", F.posexplode("counts").alias("at", "one"))
    later = later.select("lang", "terms", "one", F.explode(F.slice("counts", F.col("at") + 2, F.size("counts"))).alias("two"))
    joint = later.groupBy("lang", F.col("one.source").alias("source"), F.col("two.source").alias("item"), F.col("one.n").alias("a"), F.col("two.n").alias("b")).agg(F.sum("terms").alias("terms"))
    joint = stash(joint)
    joint = joint.unionByName(joint.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("b").alias("a"), F.col("a").alias("b"), "terms"))
    single = cells.groupBy("lang", "source", "in_group").agg(F.sum("terms").alias("terms"))
    both = joint.join(pairs, ["lang", "source", "item"]).select("lang", "source", "item", (terms_ * (f(a, b) - f(a, zero) - f(zero, b) + f(zero, zero))).alias("part_value"))
    left = single.withColumnRenamed("in_group", "a").join(pairs, ["lang", "source"]).select("lang", "source", "item", (terms_ * (f(a, zero) - f(zero, zero))).alias("part_value"))
    right = single.withColumnsRenamed({"in_group": "b", "source": "item"}).join(pairs, ["lang", "item"]).select("lang", "source", "item", (terms_ * (f(zero, b) - f(zero, zero))).alias("part_value"))
    none = pairs.select("lang", "source", "item", F.coalesce(F.col("kept").cast("decimal(18,0)") * f(zero, zero), F.lit(0)).alias("part_value"))
    parts = [x.withColumn("part_value", F.col("part_value").cast("decimal(38,0)")) for x in (both, left, right, none)]
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "source", "item").agg(F.sum("part_value").cast("long").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    by_pair = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.cast("int").alias("rank"))
    out = stash(by_pair.unionByName(by_term))
    drop_stash(kept, alike, cells, groups, valued, joint)
    return out


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
g AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN l USING (lang, term) GROUP BY ALL),
grp AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
lt AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n) AS n FROM l GROUP BY lang),
gt AS MATERIALIZED (SELECT grp.lang, grp.source, coalesce(sum(g.n), 0)::HUGEINT AS n FROM grp LEFT JOIN g ON g.lang = grp.lang AND g.source = grp.source GROUP BY ALL),
full_ AS MATERIALIZED (SELECT gt.lang, gt.source, l.term, coalesce(g.n, 0) AS n, l.n AS ln, lt.n AS lnn,
          1 + (1000000000::HUGEINT * (coalesce(g.n, 0) + 1)) // (gt.n + lt.v) AS p,
          1 + (1000000000::HUGEINT * (l.n + 1)) // (lt.n + lt.v) AS q
   FROM gt JOIN lt ON lt.lang = gt.lang JOIN l ON l.lang = gt.lang LEFT JOIN g ON g.lang = gt.lang AND g.source = gt.source AND g.term = l.term),
t AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM full_ WHERE n > 0 AND p > q),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
      FROM full_ x JOIN full_ y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
       FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM pr))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
