"""Nested JSON documents as rows: one for every key and every value, at any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.redaction import known_secrets, private_locations
from sessionloom.session import materialize

_NESTED = "^(OBJECT|ARRAY)"

# Levels that are split in one pass; what is still open after them is stored, so that plans stay short at any depth.
LEVELS = 6


def _step(parent: Column, key: Column, at: Column) -> Column:
    """``$.a[0].b``; keys other than plain names are quoted."""
    plain = key.rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    name = F.when(plain, F.concat(F.lit("."), key)).otherwise(F.concat(F.lit("['"), F.replace(key, F.lit("'"), F.lit("\\'")), F.lit("']")))
    return F.concat(parent, F.when(key.isNotNull(), name).otherwise(F.concat(F.lit("["), at.cast("string"), F.lit("]"))))


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return F.when(shape.rlike(_NESTED), F.lit("nested")).when(shape == "STRING", F.lit("string")).otherwise(F.lit("other"))


def _split(level: DataFrame, keys: list[str]) -> DataFrame:
    """One level further down: an open object or array gives itself, now closed, and its parts; every other node stays."""
    c, none = F.col, F.lit(None).cast("string")

    def node(path: Column, key: Column, value: Column, kind: Column) -> Column:
        return F.struct(path.alias("path"), key.alias("key"), value.alias("value"), kind.alias("kind"))

    pairs = F.map_entries(F.try_variant_get("value", F.lit("$"), "map<string,variant>"))
    members = F.transform(pairs, lambda e: node(_step(c("path"), e["key"], F.lit(0)), e["key"], e["value"], none))
    values = F.try_variant_get("value", F.lit("$"), "array<variant>")
    elements = F.transform(values, lambda v, i: node(_step(c("path"), none, i), none, v, none))
    itself = F.array(node(c("path"), c("key"), F.when(c("kind") != "nested", c("value")), c("kind")))
    parts = F.when(F.schema_of_variant("value").startswith("OBJECT"), members).otherwise(elements)
    nodes = F.when(~c("_open"), itself).when(c("path") == "$", parts).otherwise(F.concat(itself, parts))
    kind = F.coalesce("e.kind", _kind(c("e.value")))
    split = level.select(*keys, F.explode(nodes).alias("e")).select(*keys, "e.path", "e.key", "e.value", kind.alias("kind"), c("e.kind").isNull().alias("_open"))
    return split.withColumn("_open", c("_open") & (c("kind") == "nested"))


def document_nodes(rows: DataFrame, keys: list[str], document: str) -> DataFrame:
    """(keys, path, key, kind, text): every member and element of every document, and a document that is a single value.

    ``kind`` is nested, string or other; ``text`` is the value of a string. One pass over ``rows`` splits objects and
    arrays ``LEVELS`` levels deep, all documents together, and neither stores nor moves a node; what is open below them is
    stored for the next pass. There are as many as the deepest document needs, and nothing is cut off; ``rows`` are also
    read to see whether a level is open. Text that is no JSON gives one node of kind invalid.
    """
    parsed = rows.filter(F.col(document).isNotNull()).select(*keys, F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(document).alias("value"))
    kind = F.when(F.col("value").isNull(), F.lit("invalid")).otherwise(_kind(F.col("value")))
    level = parsed.withColumn("kind", kind).withColumn("_open", F.col("kind") == "nested")
    found, depth = [], 0
    while not level.filter("_open").isEmpty():
        if depth == LEVELS:
            found.append(level.filter("NOT _open"))
            level, depth = materialize(level.filter("_open")), 0
        level, depth = _split(level, keys), depth + 1
    every = reduce(DataFrame.unionByName, [*found, level])
    return every.select(*keys, "path", "key", "kind", F.when(F.col("kind") == "string", F.try_variant_get("value", F.lit("$"), "string")).alias("text"))


def document_leaks(nodes: DataFrame, keys: list[str], forbidden: list[str]) -> DataFrame:
    """(keys, path, kind, category): forbidden keys, secrets and private locations in strings, and texts that are no JSON.

    One pass over the nodes, which are read once.
    """
    none, c = F.array().cast("array<string>"), F.col
    banned = F.when(c("key").isin(forbidden), F.array(c("key")))
    broken = F.when(c("kind") == "invalid", F.array(F.lit("json")))
    read = nodes.select(*keys, "path", banned.alias("k"), broken.alias("b"), known_secrets(c("text")).alias("s"), private_locations(c("text")).alias("l"))

    def tagged(found: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(found), none), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("category")))

    inside = F.concat(tagged("k", "key"), tagged("b", "invalid"), tagged("s", "secret"), tagged("l", "location"))
    return read.select(*keys, "path", F.explode(inside).alias("f")).select(*keys, "path", "f.*")
