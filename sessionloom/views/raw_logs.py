"""The driver's events rendered as raw log lines of both dialects, some of them broken, for the parsers to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.text import iso
from sessionloom.session import materialize
from sessionloom.views.driver import events, shaped
from sessionloom.views.shapes import COUNTER, RESPONSE

# Lines longer than this count as oversized in these views.
LINE_BYTES = 4096


def _stored(rows: DataFrame) -> DataFrame:
    """The lines as a table of text, as a log collector would leave them; parsers start from stored text.

    Some lines are cut off, some hold an array, some are padded beyond the limit, some have a number written as text.
    """
    return materialize(rows.select("source_id", "source_kind", "ordinal", _rendered(F.col("line")).alias("line")))


def _rendered(line: Column) -> Column:
    n = F.col("event_id")
    quoted = F.regexp_replace(line, '"(reasoning_output_tokens|cache_read_input_tokens)":([0-9]+)', '"$1":"$2"')
    padded = F.concat(F.lit('{"pad":"'), F.repeat(F.lit("x"), F.lit(LINE_BYTES)), F.lit('",'), F.substr(line, F.lit(2)))
    return (
        F.when(n % 37 == 5, F.left(line, F.lit(10))).when(n % 41 == 3, F.lit("[1, 2]")).when(n % 61 == 2, padded)
        .when(n % 53 == 7, quoted).otherwise(line)
    )


def _time() -> Column:
    return F.when(F.col("event_id") % 43 == 1, F.lit("not a time")).otherwise(iso(F.col("ts")))


def counter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, source_kind, ordinal, line) of logs with cumulative counters."""
    c = F.col
    rows = shaped(events(spark, sf_dir).filter(c("user_id") % 2 == 0), COUNTER)
    said = F.concat(F.lit("said "), c("event_id").cast("string"))
    tokens, message = c("payload_type") == "token_count", c("payload_type").isin("user_message", "agent_message", "message")
    usage = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    total = usage(
        input_tokens=c("cum_reported"), cached_input_tokens=c("cum_cached"), cache_write_input_tokens=c("cum_write"),
        output_tokens=c("cum_output"), reasoning_output_tokens=c("cum_reasoning"),
    )
    last = usage(
        input_tokens=c("dir_input") + c("dir_cached"), cached_input_tokens=c("dir_cached"), output_tokens=c("dir_output"),
        reasoning_output_tokens=c("dir_reasoning"), total_tokens=c("dir_total"),
    )
    meta = c("rec_type") == "session_meta"
    payload = F.struct(
        c("payload_type").alias("type"), F.when(meta, c("raw_session_id")).alias("id"),
        F.when(meta & (c("k") % 3 == 0), iso(c("ts") - F.expr("INTERVAL 2 MINUTES"))).alias("timestamp"), "cwd", "model_provider",
        F.coalesce("meta_model", "ctx_model").alias("model"), "role", c("tool_raw").alias("name"),
        F.when(message & (c("rec_type") == "event_msg"), said).alias("message"),
        F.when(message & (c("rec_type") == "response_item"), F.array(F.struct(F.lit("").alias("text")), F.struct(said.alias("text")))).alias("content"),
        F.when(tokens, F.struct(
            F.when(c("cum_reported").isNotNull(), total).alias("total_token_usage"), F.when(c("dir_input").isNotNull(), last).alias("last_token_usage")
        )).alias("info"),
    )
    line = F.to_json(F.struct(_time().alias("timestamp"), c("rec_type").alias("type"), payload.alias("payload")))
    return _stored(rows.select("source_id", "source_kind", "ordinal", "event_id", line.alias("line")))


def _with_path(rows: DataFrame) -> DataFrame:
    """Child logs lie below the folder of their session's log."""
    child = F.concat(F.regexp_replace("source_id", "\\.jsonl$", ""), F.lit("/subagents/agent-"), (F.col("k") % 3).cast("string"), F.lit(".jsonl"))
    return rows.withColumn("path", F.when(F.col("child_id").isNotNull(), child).otherwise(F.col("source_id")))


def response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, source_kind, ordinal, line) of logs with one usage value per response, and of their child logs."""
    c = F.col
    rows = _with_path(shaped(events(spark, sf_dir).filter(c("user_id") % 2 == 1), RESPONSE))
    said = lambda word: F.concat(F.lit(f"{word} "), c("event_id").cast("string"))
    text_block = F.when(c("has_text"), F.struct(F.lit("text").alias("type"), said("replied").alias("text"), F.lit(None).cast("string").alias("name")))
    call = lambda tool: F.when(c(tool).isNotNull(), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), c(tool).alias("name")))
    advisor = F.when(c("adv_input").isNotNull(), F.array(F.struct(
        F.lit("advisor_message").alias("type"), c("adv_model").alias("model"), c("adv_input").alias("input_tokens"), c("adv_output").alias("output_tokens")
    )))
    usage = F.when(c("use_input").isNotNull() | c("adv_input").isNotNull(), F.struct(
        c("use_input").alias("input_tokens"), c("use_output").alias("output_tokens"), c("use_write").alias("cache_creation_input_tokens"),
        c("use_read").alias("cache_read_input_tokens"), advisor.alias("iterations"),
        F.when(c("use_write").isNotNull(), F.struct(c("use_write_1h").alias("ephemeral_1h_input_tokens"), c("use_write_5m").alias("ephemeral_5m_input_tokens"))).alias("cache_creation"),
    ))
    replies = F.struct(c("response_id").alias("id"), "model", "stop_reason", F.array_compact(F.array(text_block, call("tool_1"), call("tool_2"))).alias("content"), usage.alias("usage"))
    results = F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), said("result").alias("content"))).alias("content"))
    asks = F.struct(said("asked").alias("content"))

    def record(message: Column) -> Column:
        return F.to_json(F.struct(
            c("rec_type").alias("type"), _time().alias("timestamp"), "cwd", c("raw_session_id").alias("sessionId"), c("permission_mode").alias("permissionMode"),
            c("is_sidechain").alias("isSidechain"), F.when(c("rec_type") == "ai-title", said("title")).alias("aiTitle"), F.when(c("has_message"), message).alias("message"),
        ))

    line = F.when(c("rec_type") == "assistant", record(replies)).when(c("is_tool_result"), record(results)).otherwise(record(asks))
    return _stored(rows.select(c("path").alias("source_id"), "source_kind", "ordinal", "event_id", line.alias("line")))


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, json) beside every child log: which kind of agent wrote it."""
    rows = _with_path(shaped(events(spark, sf_dir).filter(F.col("user_id") % 2 == 1), RESPONSE)).filter("child_id IS NOT NULL")
    return rows.select(F.regexp_replace("path", "\\.jsonl$", ".meta.json").alias("path"), F.to_json(F.struct(F.col("agent_type").alias("agentType"))).alias("json")).distinct()
