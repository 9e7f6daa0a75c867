"""Sessions, their model and tool rows, evidence and warnings, per repository."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.numbers import clamp_safe
from sessionloom.functions.redaction import with_clean_metadata
from sessionloom.functions.text import digest, iso, plural, seed, stable_id, trim_all
from sessionloom.operators.ledger import UNKNOWN_MODEL
from sessionloom.operators.pricing import PRICE_TABLE, cost_nano, with_price
from sessionloom.operators.scan import major_of, minor_of, minor_of_reversed
from sessionloom.operators.scope import scope_directories
from sessionloom.schema import (
    BLOB_PROVIDER, CORE, COUNTER_PROVIDER, COUNTERS, DETECT_ONLY_PROVIDER, OPTIONAL, RESPONSE_PROVIDER, USAGE,
)

# Display names of the providers.
PROVIDER_LABELS = {
    COUNTER_PROVIDER: "Codex",
    RESPONSE_PROVIDER: "Claude Code",
    BLOB_PROVIDER: "Cursor",
    DETECT_ONLY_PROVIDER: "Gemini Antigravity",
}

SESSION_COLUMNS = [
    "repo_id", "session_ref", "provider", "source_kind", "source_id", "started_at", "ended_at", "start_ordinal",
    "end_ordinal", "status", "relation", "turns", "assistant_messages", "tool_calls", "plan_turns", "subagents",
    "usage", "tool_ordinal", "tool_at", "bodies", "payloads", "ts_invalid", "unknown_model",
]

MODEL_COLUMNS = [
    "repo_id", "source_id", "provider", "model_provider", "model", "calls", "usage", "priced", "unpriced", "cost_nano",
]


def provider_label(provider: Column) -> Column:
    label = F.lit(PROVIDER_LABELS[COUNTER_PROVIDER])
    for name, text in PROVIDER_LABELS.items():
        label = F.when(provider == name, F.lit(text)).otherwise(label)
    return label


def session_ref(provider: str, fingerprint: Column, identity: Column) -> Column:
    if provider == COUNTER_PROVIDER:
        return stable_id("ses_", 20, fingerprint, identity)
    return stable_id("ses_", 20, F.lit(provider), fingerprint, identity)


def file_identity(source_kind: Column, source_id: Column) -> Column:
    """Identity of a log that names no session: kind and file name."""
    return F.concat(source_kind, F.lit(":"), F.element_at(F.split(source_id, "/"), -1))


def usage_sum(present: Column, column: Column | None = None, zero_write: Column | None = None) -> Column:
    """Null-preserving sum of usage values: null when nothing is present.

    ``zero_write`` tells when an absent cache-write counter reads as 0 instead.
    """
    value = (lambda c: F.col(c)) if column is None else (lambda c: column[c])
    fields = []
    for c in COUNTERS:
        total = clamp_safe(F.sum(F.when(present, value(c))))
        if c == "cache_write" and zero_write is not None:
            total = F.coalesce(total, F.when(zero_write, F.lit(0)))
        fields.append(total.cast("long").alias(c))
    return F.when(F.bool_or(present), F.struct(*fields).cast(USAGE))


def with_cost(cells: DataFrame, table: list[tuple] = PRICE_TABLE) -> DataFrame:
    """``_cost`` of cells: one row per key, model (redacted name), price epoch and context class."""
    priced = with_price(cells, "model", F.coalesce("epoch", F.lit(-1)), table)
    cost = cost_nano({c: F.col(c) for c in COUNTERS}, F.col("price"), F.col("long_context"))
    return priced.withColumn("_cost", F.when(F.col("responses") > 0, cost)).drop("price", "_epoch")


def priced_models(costed: DataFrame, keys: list[str], provider: Column) -> DataFrame:
    """Model rows per session: totals, their priced and unpriced parts, exact cost, from cells ``with_cost``."""
    used, some_price = F.col("responses") > 0, F.col("_cost").isNotNull()
    return costed.groupBy(*keys, "model").agg(
        F.max(provider).alias("_provider"),
        F.sum("calls").alias("calls"),
        usage_sum(used, zero_write=F.sum("responses") > 1).alias("usage"),
        usage_sum(used & some_price, zero_write=F.sum(F.when(some_price, F.col("responses"))) > 1).alias("priced"),
        usage_sum(used & ~some_price, zero_write=F.sum(F.when(~some_price, F.col("responses"))) > 1).alias("unpriced"),
        F.sum("_cost").cast("decimal(38,0)").alias("cost_nano"),
    )


@dataclass(frozen=True)
class SessionTables:
    """Everything one dialect contributes before de-duplication across files."""

    sessions: DataFrame
    models: DataFrame
    tools: DataFrame
    unmatched: DataFrame


def _no_usage() -> Column:
    return F.lit(None).cast(USAGE)


def clean_names(*names: DataFrame) -> DataFrame:
    """``(name, clean)`` for every distinct raw model, tool, agent or provider name.

    Redaction runs on the distinct names of the cells, not on records.
    """
    distinct = reduce(lambda a, b: a.unionByName(b), names).filter(F.col("name").isNotNull()).distinct()
    return with_clean_metadata(distinct, F.col("name"), "clean", 160)


def _short(clean: Column, limit: int = 80) -> Column:
    return F.when(F.length(clean) > limit, F.concat(F.left(clean, F.lit(limit - 1)), F.lit("…"))).otherwise(clean)


# Counter dialect ---------------------------------------------------------------


def counter_names(cells: DataFrame) -> DataFrame:
    return cells.select(F.explode(F.array("name", "provider_now")).alias("name"))


def counter_sessions(cells: DataFrame, names: DataFrame, repositories: DataFrame, table: list[tuple] = PRICE_TABLE) -> SessionTables:
    """Only segments whose working directory lies inside a repository count for it."""
    scope = scope_directories(cells, repositories)
    logs = cells.groupBy("source_id", "source_kind").agg(
        F.min_by("raw_session_id", "id_ordinal").alias("raw_id"), F.bool_or("saw_meta").alias("saw_meta")
    )
    scoped = cells.join(scope, "cwd_now")
    used = F.col("cell") == "usage"
    facts = scoped.groupBy("repo_id", "fingerprint", "source_id").agg(
        F.bool_or(F.col("relation") == "repository-root").alias("at_root"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("first_tool").alias("first_tool"),
        *[F.sum(c).alias(c) for c in ("event_user", "event_assistant", "response_user", "response_assistant", "bodies", "payloads")],
        F.sum(F.when(F.col("cell") == "tool", F.col("records")).otherwise(F.lit(0))).alias("tool_calls"),
        F.bool_or("completed").alias("completed"),
        F.bool_or("aborted").alias("aborted"),
        F.bool_or("ts_invalid").alias("ts_invalid"),
        F.bool_or(used & (F.col("name") == UNKNOWN_MODEL)).alias("unknown_model"),
        usage_sum(used, zero_write=F.sum("responses") > 1).alias("usage"),
    )
    first_of = lambda a, b: F.when(F.col(a) > 0, F.col(a)).otherwise(F.col(b))
    sessions = (
        facts.join(logs, "source_id")
        .withColumns(
            {
                "provider": F.lit(COUNTER_PROVIDER),
                "session_ref": session_ref(
                    COUNTER_PROVIDER, F.col("fingerprint"),
                    F.coalesce("raw_id", file_identity(F.col("source_kind"), F.col("source_id"))),
                ),
                **_bounds(),
                "status": F.when(F.col("aborted"), F.lit("aborted")).when(F.col("completed"), F.lit("completed")).otherwise(F.lit("incomplete")),
                "relation": F.when(F.col("at_root"), F.lit("repository-root")).otherwise(F.lit("subdirectory")),
                "turns": first_of("event_user", "response_user"),
                "assistant_messages": first_of("event_assistant", "response_assistant"),
                "plan_turns": F.lit(None).cast("long"),
                "subagents": F.lit(None).cast("long"),
                "tool_ordinal": major_of(F.col("first_tool")),
                "tool_at": F.timestamp_millis(minor_of(F.col("first_tool"))),
            }
        )
        .select(*SESSION_COLUMNS)
    )
    named = scoped.filter(F.col("name").isNotNull()).join(names, "name")
    models = (
        priced_models(
            with_cost(named.filter(F.col("cell") != "tool").withColumns({"model": F.col("clean"), "calls": F.col("responses")}), table),
            ["repo_id", "source_id"], F.struct("last_ordinal", "provider_now"),
        )
        .withColumn("name", F.col("_provider.provider_now"))
        .join(names, "name")
        .select("repo_id", "source_id", F.lit(COUNTER_PROVIDER).alias("provider"), _short(F.col("clean")).alias("model_provider"), *MODEL_COLUMNS[4:])
    )
    tools = (
        named.filter(F.col("cell") == "tool")
        .groupBy("repo_id", "source_id", F.col("clean").alias("tool"))
        .agg(F.sum("records").alias("calls"))
        .withColumn("provider", F.lit(COUNTER_PROVIDER))
    )
    unmatched = logs.filter(~F.col("saw_meta")).join(facts, "source_id", "left_anti").select(
        "source_id", F.lit(COUNTER_PROVIDER).alias("provider")
    )
    return SessionTables(sessions, models, tools, unmatched)


def _bounds() -> dict[str, Column]:
    """Start and end with the first record that reaches each, from the packed pairs."""
    return {
        "started_at": F.timestamp_millis(major_of(F.col("first_seen"))),
        "ended_at": F.timestamp_millis(major_of(F.col("last_seen"))),
        "start_ordinal": minor_of(F.col("first_seen")),
        "end_ordinal": minor_of_reversed(F.col("last_seen")),
    }


# Response dialect --------------------------------------------------------------


def response_sessions(
    cells: DataFrame, logs: DataFrame, turns: DataFrame, names: DataFrame, repositories: DataFrame, table: list[tuple] = PRICE_TABLE
) -> SessionTables:
    """A log belongs to the repositories around its first working directory."""
    placed = logs.join(scope_directories(logs, repositories, "cwd"), "cwd")
    kind = F.col("cell")
    tool = trim_all(F.col("name"))
    block = (kind == "tool") & ~tool.startswith("Agent:") & ~tool.endswith(" (subagent)")
    facts = cells.groupBy("source_id").agg(
        F.sum(F.when(kind == "usage", F.col("assistant_messages"))).alias("assistant_messages"),
        F.max_by("stop_reason", "stopped_at").alias("stop"),
        F.sum(F.when(block, F.col("calls"))).alias("tool_calls"),
        F.sum(F.when(kind == "agent", F.col("calls"))).alias("subagents"),
        F.min(F.when(kind == "tool", F.col("first_tool"))).alias("first_tool"),
        usage_sum((kind == "usage") & (F.col("responses") > 0), zero_write=F.lit(True)).alias("usage"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sessions = (
        placed.join(facts, "source_id", "left")
        .join(turns, "source_id", "left")
        .withColumns(
            {
                "provider": F.lit(RESPONSE_PROVIDER),
                "session_ref": session_ref(
                    RESPONSE_PROVIDER, F.col("fingerprint"),
                    F.coalesce("raw_id", file_identity(F.col("source_kind"), F.col("source_id"))),
                ),
                **_bounds(),
                "status": F.when(F.col("stop").isNull(), F.lit("unknown")).when(F.col("stop") == "tool_use", F.lit("incomplete")).otherwise(F.lit("completed")),
                "turns": zero("turns"),
                "assistant_messages": zero("assistant_messages"),
                "tool_calls": zero("tool_calls"),
                "plan_turns": F.when(zero("turns") > 0, zero("plan_turns")),
                "subagents": F.when(zero("subagents") > 0, F.col("subagents")),
                "tool_ordinal": minor_of(F.col("first_tool")),
                "tool_at": F.timestamp_millis(major_of(F.col("first_tool"))),
                "bodies": F.lit(None).cast("long"),
                "payloads": F.lit(None).cast("long"),
                "unknown_model": F.lit(False),
            }
        )
        .select(*SESSION_COLUMNS)
    )
    repos = placed.select("repo_id", "source_id")
    called = cells.join(names, "name")
    # priced before they are placed: rows that meet on their log are then summed where they are
    costed = with_cost(called.filter(kind == "usage").withColumn("model", F.col("clean")), table).join(repos, "source_id")
    models = priced_models(costed, ["repo_id", "source_id"], F.lit("anthropic")).select(
        "repo_id", "source_id", F.lit(RESPONSE_PROVIDER).alias("provider"), F.col("_provider").alias("model_provider"), *MODEL_COLUMNS[4:]
    )
    label = (
        F.when(kind == "agent", F.concat(F.lit("Agent:"), _short(F.col("clean"))))
        .when(kind == "child_tool", F.concat(F.col("name"), F.lit(" (subagent)")))
        .otherwise(F.col("clean"))
    )
    tools = (
        called.filter(kind != "usage")
        .join(repos, "source_id")
        .groupBy("repo_id", "source_id", label.alias("tool"))
        .agg(F.sum("calls").alias("calls"))
        .withColumn("provider", F.lit(RESPONSE_PROVIDER))
    )
    unmatched = logs.join(placed.select("source_id"), "source_id", "left_anti").filter(
        F.col("raw_id").isNull() & F.col("first_seen").isNull()
    ).select("source_id", F.lit(RESPONSE_PROVIDER).alias("provider"))
    return SessionTables(sessions, models, tools, unmatched)


# Blob dialect --------------------------------------------------------------------


def blob_sessions(messages: DataFrame, workspaces: DataFrame, repositories: DataFrame) -> SessionTables:
    """One session per workspace that holds a message of any role; its only time is when the store was last written.

    ``workspaces``: workspace, folder, modified_at.
    """
    where = scope_directories(workspaces.select(F.col("folder").alias("cwd")), repositories, "cwd")
    counts = messages.groupBy("workspace").agg(
        F.count(F.when(F.col("role") == "user", F.lit(1))).alias("turns"),
        F.count(F.when(F.col("role") == "assistant", F.lit(1))).alias("assistant_messages"),
    )
    placed = workspaces.withColumn("cwd", F.col("folder")).join(where, "cwd").join(counts, "workspace")
    none = lambda t: F.lit(None).cast(t)
    sessions = placed.select(
        "repo_id",
        session_ref(BLOB_PROVIDER, F.col("fingerprint"), F.col("workspace")).alias("session_ref"),
        F.lit(BLOB_PROVIDER).alias("provider"), F.lit("active").alias("source_kind"), F.col("workspace").alias("source_id"),
        F.col("modified_at").alias("started_at"), F.col("modified_at").alias("ended_at"),
        F.lit(0).cast("long").alias("start_ordinal"), F.lit(0).cast("long").alias("end_ordinal"),
        F.lit("unknown").alias("status"), "relation", "turns", "assistant_messages", F.lit(0).cast("long").alias("tool_calls"),
        none("long").alias("plan_turns"), none("long").alias("subagents"), _no_usage().alias("usage"),
        none("long").alias("tool_ordinal"), none("timestamp").alias("tool_at"), none("long").alias("bodies"),
        none("long").alias("payloads"), F.lit(False).alias("ts_invalid"), F.lit(False).alias("unknown_model"),
    )
    spark = messages.sparkSession
    models = spark.createDataFrame([], f"repo_id bigint, source_id string, provider string, model_provider string, model string, calls bigint, usage {USAGE}, priced {USAGE}, unpriced {USAGE}, cost_nano decimal(38,0)")
    tools = spark.createDataFrame([], "repo_id bigint, source_id string, tool string, calls bigint, provider string")
    unmatched = spark.createDataFrame([], "source_id string, provider string")
    return SessionTables(sessions, models, tools, unmatched)


# Across dialects -------------------------------------------------------------------


def latest_copies(sessions: DataFrame) -> DataFrame:
    """One file per session: the one that ends last.

    At equal ends an active file of a counter log wins (the last one by name),
    otherwise the first file by name. Aggregations only, no per-session sort.
    """
    preferred = (F.col("provider") == COUNTER_PROVIDER) & (F.col("source_kind") == "active")
    end = F.unix_micros("ended_at")
    best = sessions.groupBy("repo_id", "session_ref").agg(
        F.max(F.struct(end.alias("e"), preferred.alias("p"), F.col("source_id"))).alias("last_active"),
        F.min(F.struct((-end).alias("e"), F.col("source_id"))).alias("first_latest"),
    )
    winner = best.select(
        "repo_id", "session_ref",
        F.when(F.col("last_active.p"), F.col("last_active.source_id")).otherwise(F.col("first_latest.source_id")).alias("source_id"),
    )
    return sessions.join(winner, ["repo_id", "session_ref", "source_id"], "left_semi")


def session_sentence() -> Column:
    label = provider_label(F.col("provider"))
    users = plural(F.col("turns"), "user turn")
    replies = plural(F.col("assistant_messages"), "assistant message")
    log = F.concat(
        label, F.lit(" session with "), users, F.lit(", "), replies, F.lit(", and "),
        plural(F.col("tool_calls"), "tool call"), F.lit("."),
    )
    blob = F.concat(label, F.lit(" session with "), users, F.lit(" and "), replies, F.lit(" (unverified local format)."))
    return F.when(F.col("provider") == BLOB_PROVIDER, blob).otherwise(log)


def union_parts(parts: list[SessionTables]) -> SessionTables:
    """The dialects' tables one under the other."""
    union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
    return SessionTables(
        union([p.sessions for p in parts]),
        union([p.models.select(*MODEL_COLUMNS) for p in parts]),
        union([p.tools.select(*FILE_KEY, "tool", "calls") for p in parts]),
        union([p.unmatched for p in parts]),
    )


FILE_KEY = ["repo_id", "source_id", "provider"]


def with_names(sessions: DataFrame, models: DataFrame, tools: DataFrame) -> DataFrame:
    """Sorted model and tool names and the sentence of every session."""
    model_refs = models.groupBy(*FILE_KEY).agg(F.array_sort(F.collect_set("model")).alias("model_refs"))
    tool_refs = tools.groupBy(*FILE_KEY).agg(F.array_sort(F.collect_set("tool")).alias("tool_refs"))
    none = F.array().cast("array<string>")
    return (
        sessions.join(model_refs, FILE_KEY, "left")
        .join(tool_refs, FILE_KEY, "left")
        .withColumns(
            {"model_refs": F.coalesce("model_refs", none), "tool_refs": F.coalesce("tool_refs", none), "summary": session_sentence()}
        )
    )


def of_files(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Model or tool rows of the files the sessions were taken from, with the session."""
    return rows.join(sessions.select(*FILE_KEY, "session_ref"), FILE_KEY)


def evidence(sessions: DataFrame, tool_evidence_all: bool = False) -> DataFrame:
    """Boundary and first-tool markers of each session, with content-free digests.

    Only counter logs report the first tool call, unless ``tool_evidence_all``.
    """
    tool_known = F.col("tool_ordinal").isNotNull() & (
        F.lit(tool_evidence_all) | (F.col("provider") == COUNTER_PROVIDER)
    )
    mark = lambda kind, ordinal, at: F.struct(
        F.lit(kind).alias("kind"), F.col(ordinal).alias("event_ordinal"), F.col(at).alias("at")
    )
    marks = F.array_compact(
        F.array(
            mark("session-boundary", "start_ordinal", "started_at"),
            F.when(F.col("end_ordinal") != F.col("start_ordinal"), mark("session-boundary", "end_ordinal", "ended_at")),
            F.when(tool_known, mark("tool-activity", "tool_ordinal", "tool_at")),
        )
    )
    rows = sessions.select("repo_id", "session_ref", F.col("provider").alias("source"), F.explode(marks).alias("m")).select(
        "repo_id", "session_ref", "source", "m.kind", "m.event_ordinal", iso(F.col("m.at")).alias("observed_at")
    )
    parts = [F.col("session_ref"), F.col("kind"), F.col("event_ordinal"), F.col("observed_at")]
    return rows.withColumns({"evidence_id": stable_id("ev_", 20, *parts), "digest": digest(seed(*parts))})
