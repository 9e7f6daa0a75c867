"""Logs with one usage value per response, and their child logs, as typed response records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import blank_to_null
from sessionloom.schema import COUNTERS, USAGE
from sessionloom.sources.jsonl import count_at, flag_at, has_at, kind_of, object_at, text_at, time_at

_CHILD = r"^(.*)/subagents/[^/]+\.jsonl$"


def usage_at(rec: Column, path: str) -> Column:
    n = lambda field: count_at(rec, f"{path}.{field}")
    values = {
        "input": n("input_tokens"), "cached": F.lit(0), "output": n("output_tokens"), "reasoning": F.lit(0),
        "cache_write": n("cache_creation_input_tokens"), "cache_read": n("cache_read_input_tokens"),
        "cache_write_1h": n("cache_creation.ephemeral_1h_input_tokens"), "cache_write_5m": n("cache_creation.ephemeral_5m_input_tokens"),
    }
    values["total"] = values["input"] + values["output"] + values["cache_write"] + values["cache_read"]
    return F.when(object_at(rec, path), F.struct(*[values[c].cast("long").alias(c) for c in COUNTERS])).cast(USAGE)


def response_records(raw: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """``raw``: source_id, source_kind, ordinal, rec. A log under ``<session>/subagents`` belongs
    to the session's log; ``sidecars`` (path, json) give the child's agent type."""
    r = F.col("rec")
    blocks = F.coalesce(F.try_variant_get(r, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    has = lambda kind: F.exists(blocks, lambda b: F.coalesce(text_at(b, "$.type") == kind, F.lit(False)))
    calls = F.filter(blocks, lambda b: F.coalesce(text_at(b, "$.type") == "tool_use", F.lit(False)))
    texts = F.filter(blocks, lambda b: F.coalesce(text_at(b, "$.type") == "text", F.lit(False)))
    iterations = F.coalesce(F.try_variant_get(r, "$.message.usage.iterations", "array<variant>"), F.array().cast("array<variant>"))
    advisors = F.filter(
        F.transform(
            iterations,
            lambda it, i: F.when(
                text_at(it, "$.type") == "advisor_message", F.struct(i.alias("idx"), text_at(it, "$.model").alias("model"), usage_at(it, "$").alias("usage"))
            ),
        ),
        lambda a: a.isNotNull(),
    )
    kind = text_at(r, "$.type")
    child = F.regexp_extract("source_id", _CHILD, 1)
    is_child = F.length(child) > 0
    rows = raw.select(
        F.when(is_child, F.concat(child, F.lit(".jsonl"))).otherwise(F.col("source_id")).alias("source_id"), "source_kind",
        F.when(is_child, F.col("source_id")).alias("child_id"), "ordinal", time_at(r, "$.timestamp").alias("ts"),
        (has_at(r, "$.timestamp") & time_at(r, "$.timestamp").isNull()).alias("ts_invalid"), kind.alias("rec_type"),
        text_at(r, "$.cwd").alias("cwd"), text_at(r, "$.sessionId").alias("raw_session_id"), text_at(r, "$.permissionMode").alias("permission_mode"),
        flag_at(r, "$.isSidechain").alias("is_sidechain"), has("tool_result").alias("is_tool_result"), object_at(r, "$.message").alias("has_message"),
        F.coalesce(text_at(r, "$.message.id"), text_at(r, "$.uuid")).alias("response_id"), text_at(r, "$.message.model").alias("model"),
        text_at(r, "$.message.stop_reason").alias("stop_reason"), has("text").alias("has_text"),
        F.when(kind == "user", F.when(kind_of(r, "$.message.content") == "STRING", text_at(r, "$.message.content")))
        .otherwise(F.get(F.transform(texts, lambda b: text_at(b, "$.text")), F.lit(0))).alias("text"),
        F.when(kind == "custom-title", text_at(r, "$.customTitle")).when(kind == "ai-title", text_at(r, "$.aiTitle")).alias("title"),
        F.transform(calls, lambda b: F.coalesce(text_at(b, "$.name"), F.lit("unknown-tool"))).alias("tools"),
        usage_at(r, "$.message.usage").alias("usage"), advisors.alias("advisors"),
    )
    if sidecars is None:
        return rows.withColumn("agent_type", F.lit(None).cast("string"))
    types = sidecars.select(
        F.regexp_replace("path", r"\.meta\.json$", ".jsonl").alias("child_id"), blank_to_null(F.get_json_object("json", "$.agentType")).alias("agent_type")
    )
    return rows.join(types, "child_id", "left")
