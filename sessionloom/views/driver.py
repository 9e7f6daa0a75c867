"""The driver's tables seen as logs, commits, conversations, texts and remotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.text import digest
from sessionloom.schema import USAGE
from sessionloom.session import prepare
from sessionloom.views.shapes import CHANGES, COMMITS, COMMON, COUNTER, RESPONSE, SHIFT_DAYS, STATUS_CODES, pick, spell


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """With columns spelled as in ``views.shapes``."""
    return df.selectExpr("*", *[f"{spell(sql, 'spark')} AS {name}" for name, sql in columns.items()])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    prepared = raw.select(
        "event_id", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.floor(F.col("value") * 100).cast("long").alias("tok"),
        F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd").alias("week"),
        F.timestamp_millis(F.unix_millis(ts) + SHIFT_DAYS * 86_400_000).alias("ts"),
    )
    return shaped(prepared, COMMON)


def _usage(present: Column, **fields: Column) -> Column:
    from sessionloom.schema import COUNTERS

    parts = [fields.get(c, F.lit(None)).cast("long").alias(c) for c in COUNTERS]
    return F.when(present, F.struct(*parts)).cast(USAGE)


def counter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even users: logs with cumulative counters."""
    zero, c = F.lit(0), F.col
    rows = shaped(events(spark, sf_dir).filter(c("user_id") % 2 == 0), COUNTER)
    write = F.coalesce(c("cum_write"), zero)
    return rows.select(
        "source_id", "source_kind", "ordinal", "ts",
        F.when((c("rec_type") == "session_meta") & (c("k") % 3 == 0), c("ts") - F.expr("INTERVAL 2 MINUTES")).alias("meta_ts"),
        F.lit(False).alias("ts_invalid"),
        "rec_type", "payload_type", "cwd", "default_cwd", "raw_session_id", "model_provider", "meta_model", "ctx_model",
        "role", "tool_raw",
        _usage(
            c("cum_reported").isNotNull(),
            input=F.greatest(zero, c("cum_reported") - c("cum_cached") - write), cached=c("cum_cached"),
            output=c("cum_output"), reasoning=c("cum_reasoning"), total=c("cum_reported") + c("cum_output"), cache_write=c("cum_write"),
        ).alias("cum"),
        _usage(
            c("dir_input").isNotNull(), input=c("dir_input"), cached=c("dir_cached"), output=c("dir_output"),
            reasoning=c("dir_reasoning"), total=c("dir_total"),
        ).alias("direct"),
    )


def response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd users: logs with one usage value per response, and child logs."""
    zero, c = F.lit(0), F.col
    rows = shaped(events(spark, sf_dir).filter(c("user_id") % 2 == 1), RESPONSE)
    advisor = F.when(
        c("adv_input").isNotNull(),
        F.array(
            F.struct(
                zero.cast("int").alias("idx"), c("adv_model").alias("model"),
                _usage(
                    c("adv_input").isNotNull(), input=c("adv_input"), cached=zero, output=c("adv_output"), reasoning=zero,
                    total=c("adv_input") + c("adv_output"), cache_write=zero, cache_write_1h=zero, cache_write_5m=zero, cache_read=zero,
                ).alias("usage"),
            )
        ),
    )
    return rows.select(
        "source_id", "source_kind", "child_id", "agent_type", "ordinal", "ts", F.lit(False).alias("ts_invalid"),
        "rec_type", "cwd", "raw_session_id", "permission_mode", "is_sidechain", "is_tool_result", "has_message",
        "response_id", "model", "stop_reason", "has_text", F.array_compact(F.array("tool_1", "tool_2")).alias("tools"),
        _usage(
            c("use_input").isNotNull(), input=c("use_input"), cached=zero, output=c("use_output"), reasoning=zero,
            total=c("use_input") + c("use_output") + c("use_write") + c("use_read"), cache_write=c("use_write"),
            cache_write_1h=c("use_write_1h"), cache_write_5m=c("use_write_5m"), cache_read=c("use_read"),
        ).alias("usage"),
        advisor.alias("advisors"),
    )


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repository id the logs mention, with its root and identity."""
    ids = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("repo_id")).distinct()
    root = F.concat(F.lit("/repo/"), F.col("repo_id").cast("string"))
    return ids.select("repo_id", root.alias("root"), digest(root).alias("fingerprint"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(table(spark, sf_dir, "orders"), COMMITS)
    day = (F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")) % 45).cast("long")
    start = F.unix_millis(F.lit("2026-08-20T00:00:00Z").cast("timestamp"))
    return rows.select(
        "repo_id", "commit_id", "author", "is_merge",
        F.timestamp_millis(start + day * 86_400_000 + (F.col("o_orderkey") % 86_400) * 1000).alias("ts"),
    )


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*[F.expr(spell(s, "spark")).alias(n) for n, s in CHANGES.items()])


def status_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        (F.col("o_custkey") % 7).alias("repo_id"),
        F.expr(pick(STATUS_CODES, "o_orderkey % 10")).alias("code"),
        F.concat(F.lit("file-"), F.col("o_orderkey").cast("string")).alias("path"),
    )


def offsets(repos: DataFrame) -> DataFrame:
    """A local-time offset per repository, for the work-pattern queries."""
    return repos.select("repo_id", ((F.col("repo_id") - 3) * 120).cast("int").alias("utc_offset"))


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as normalised events, with a tool call after some replies."""
    c = F.col
    none = F.lit(None).cast("string")
    provider = F.expr(pick(["claude-code", "codex", "cursor"], "conv_id % 3"))
    base = table(spark, sf_dir, "conversations").select(
        (c("conv_id") % 7).alias("repo_id"), provider.alias("provider"), c("conv_id").cast("string").alias("session_ref"), "conv_id", "turn", "role", "text",
        F.timestamp_millis(F.lit(1_704_067_200_000) + c("conv_id") * 3_600_000 + c("turn") * 60_000).alias("occurred_at"),
    )
    message = F.struct(
        (c("turn") * 2).alias("ordinal"), c("text").alias("text"),
        F.when(c("role") == "system", F.lit("title")).otherwise(F.lit("message")).alias("event_kind"),
        F.when(c("role") == "user", F.when(c("turn") % 4 < 2, F.lit("plan")).otherwise(F.lit("default"))).alias("permission_mode"),
        none.alias("tool_name"),
    )
    call = F.struct(
        (c("turn") * 2 + 1).alias("ordinal"), none.alias("text"), F.lit("tool-call").alias("event_kind"), none.alias("permission_mode"),
        F.when(c("conv_id") % 5 == 0, F.lit("Read")).otherwise(F.lit("Edit")).alias("tool_name"),
    )
    calls = (c("role") == "assistant") & ((c("conv_id") + c("turn")) % 3 == 0)
    return base.select(
        "repo_id", "provider", "session_ref", "occurred_at", "role", F.explode(F.when(calls, F.array(message, call)).otherwise(F.array(message))).alias("e")
    ).select("repo_id", "provider", "session_ref", "e.ordinal", "occurred_at", "role", "e.text", "e.event_kind", "e.permission_mode", "e.tool_name")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).alias("repo_id"), "text")


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as nested JSON documents: lines in an array, the source under a key that may or may not be published, some cut off."""
    c = F.col
    key = F.when(c("doc_id") % 3 == 0, F.lit("title")).when(c("doc_id") % 3 == 1, F.lit("prompt")).otherwise(F.lit("note"))
    body = F.struct(F.split("text", "\n").alias("lines"), F.array(F.create_map(key, c("source"))).alias("extra"))
    text = F.to_json(F.struct(c("lang").alias("lang"), body.alias("body")))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(c("doc_id") % 11 == 0, F.left(text, F.lit(20))).otherwise(text).alias("document"))


def remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


def chat_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON documents of a few turns, under keys that are read or not."""
    c = F.col
    bubbles = table(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(c("turn") / 4).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    tabs = F.array(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("bubbles")))
    key = F.when(c("conv_id") % 4 == 3, F.lit("unrelated.key")).otherwise(
        F.concat(F.lit("composerData:"), F.lpad(c("part").cast("string"), 9, "0"))
    )
    return bubbles.select(
        c("conv_id").cast("string").alias("workspace"), F.lit("cursorDiskKV").alias("tbl"), key.alias("key"),
        F.to_json(F.struct(tabs.alias("tabs"))).alias("value"),
    )


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workspace, json, modified_at): a description beside every chat store, with folders written in many ways."""
    c, r = F.col, (F.col("conv_id") % 7).cast("string")
    uris = ["file:///repo/", "file://localhost/repo/", "file://C:/repo/", "file:///repo/", "vscode-remote://ssh/repo/", "file:///repo/", "file:///repo/", "file://server/repo/"]
    ends = ["", "/sub%20dir+x", "", "/only", "", "/./x/../y?q=1#f", "/a%2Fb", ""]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (c("conv_id") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return rows.select(
        c("conv_id").cast("string").alias("workspace"), F.to_json(F.struct(F.concat(of(uris), r, of(ends)).alias("folder"))).alias("json"),
        F.timestamp_millis(F.lit(1_767_225_600_000) + c("conv_id") * 60_000).alias("modified_at"),
    )
