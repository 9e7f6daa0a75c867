"""Logs with cumulative token counters as typed counter records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.schema import COUNTERS, USAGE
from sessionloom.sources.jsonl import count_at, first_text, has_at, object_at, text_at, time_at


def usage_at(rec: Column, path: str) -> Column:
    """A usage object; input excludes cached and written tokens, a missing total is rebuilt."""
    n = lambda field: count_at(rec, f"{path}.{field}")
    reported, cached, write, output = n("input_tokens"), n("cached_input_tokens"), n("cache_write_input_tokens"), n("output_tokens")
    total = n("total_tokens")
    values = {
        "input": F.greatest(F.lit(0), reported - cached - write),
        "cached": cached,
        "output": output,
        "reasoning": n("reasoning_output_tokens"),
        "total": F.when(total > 0, total).otherwise(reported + output),
        "cache_write": F.when(has_at(rec, f"{path}.cache_write_input_tokens"), write),
    }
    fields = [values.get(c, F.lit(None)).cast("long").alias(c) for c in COUNTERS]
    return F.when(object_at(rec, path), F.struct(*fields)).cast(USAGE)


def counter_records(raw: DataFrame) -> DataFrame:
    """``raw``: source_id, source_kind, ordinal, rec (VARIANT)."""
    r = F.col("rec")
    kind, payload = text_at(r, "$.type"), text_at(r, "$.payload.type")
    meta, context = kind == "session_meta", kind == "turn_context"
    info = object_at(r, "$.payload.info")
    tokens = (kind == "event_msg") & (payload == "token_count")
    loose = F.coalesce(usage_at(r, "$.payload.last_token_usage"), usage_at(r, "$.payload.total_token_usage"))
    return raw.select(
        "source_id", "source_kind", "ordinal", time_at(r, "$.timestamp").alias("ts"), time_at(r, "$.payload.timestamp").alias("meta_ts"),
        (has_at(r, "$.timestamp") & time_at(r, "$.timestamp").isNull()).alias("ts_invalid"),
        kind.alias("rec_type"), payload.alias("payload_type"), text_at(r, "$.payload.cwd").alias("cwd"),
        F.lit(None).cast("string").alias("default_cwd"),
        F.when(meta, F.coalesce(text_at(r, "$.payload.id"), text_at(r, "$.payload.session_id"))).alias("raw_session_id"),
        F.when(meta, text_at(r, "$.payload.model_provider")).alias("model_provider"),
        F.when(meta, text_at(r, "$.payload.model")).alias("meta_model"),
        F.when(context, text_at(r, "$.payload.model")).alias("ctx_model"),
        text_at(r, "$.payload.role").alias("role"), text_at(r, "$.payload.name").alias("tool_raw"),
        F.coalesce(F.when(kind == "event_msg", text_at(r, "$.payload.message")), first_text(r, "$.payload.content")).alias("text"),
        F.when(tokens, F.when(info, usage_at(r, "$.payload.info.total_token_usage")).otherwise(loose)).alias("cum"),
        F.when(tokens & info, usage_at(r, "$.payload.info.last_token_usage")).alias("direct"),
    )
