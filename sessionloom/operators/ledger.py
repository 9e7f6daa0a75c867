"""Token ledgers of both log dialects, reduced to *cells*.

A cell is one pre-aggregated row per log, working directory, name and price
epoch. Scoping to repositories, pricing and session building all read cells, so
the raw records are shuffled once and nothing is joined onto them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import blank_to_null, trim_all
from sessionloom.operators.pricing import PRICE_TABLE, default_price_time, is_long_context, price_epoch
from sessionloom.operators.scan import CHUNK_ROWS, Carry, carry_last, chunk_of, pack, pack_reversed
from sessionloom.schema import CORE, COUNTERS, OPTIONAL, USAGE

UNKNOWN_MODEL = "unknown-model"
UNKNOWN_TOOL = "unknown-tool"


_TRACKED = [*CORE, "cache_write"]


def _tracked(usage: Column) -> dict[str, Column]:
    """The compared counters of a usage value; an absent cache-write counts as 0."""
    return {c: F.when(usage.isNotNull(), F.coalesce(usage[c], F.lit(0))) for c in _TRACKED}


def counter_delta(current: Column, previous: dict[str, Column]) -> Column:
    """Difference of cumulative counters; each field resets on its own."""
    def step(name: str) -> Column:
        now = F.coalesce(current[name], F.lit(0))
        then = F.coalesce(previous[name], F.lit(0))
        return F.when(now < then, now).otherwise(now - then)

    fields = [step(c).alias(c) for c in CORE]
    fields.append(F.when(current["cache_write"].isNotNull(), step("cache_write")).alias("cache_write"))
    fields += [F.lit(None).cast("long").alias(c) for c in OPTIONAL[1:]]
    return F.when(current.isNotNull(), F.struct(*fields).cast(USAGE))


def with_carried_state(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Scope, model, provider, previous counters of every record of a counter log."""
    is_meta = F.col("rec_type") == "session_meta"
    is_context = F.col("rec_type") == "turn_context"
    usage = {"shown": F.coalesce(F.col("cum"), F.col("direct")), "cum": F.col("cum")}
    tracked = {f"_{n}": F.when(u.isNotNull(), F.struct(*[v.alias(c) for c, v in _tracked(u).items()])) for n, u in usage.items()}
    carried = carry_last(
        records,
        ["source_id"],
        "ordinal",
        {
            "cwd_now": Carry(F.when(is_meta | is_context, blank_to_null(F.col("cwd")))),
            "active_model": Carry(F.when(is_context, blank_to_null(F.col("ctx_model")))),
            "session_model": Carry(F.when(is_meta, F.col("meta_model"))),
            "provider_now": Carry(F.when(is_meta, F.col("model_provider"))),
            **{n: Carry(v, inclusive=False) for n, v in tracked.items()},
        },
        chunk_of(F.col("ordinal"), chunk_rows),
    )
    return carried.withColumns(
        {
            "cwd_now": F.coalesce("cwd_now", "default_cwd"),
            "provider_now": F.coalesce("provider_now", F.lit("unknown")),
            **{f"{n}_{c}": F.col(f"_{n}.{c}") for n in usage for c in _TRACKED},
        }
    ).drop(*tracked)


def with_accepted_usage(carried: DataFrame) -> DataFrame:
    """``accepted``: usage a token record adds, after duplicate and reset handling."""
    is_tokens = (F.col("rec_type") == "event_msg") & (F.col("payload_type") == "token_count")
    shown = F.coalesce(F.col("cum"), F.col("direct"))
    repeated = reduce(lambda a, b: a & b, [v.eqNullSafe(F.col(f"shown_{c}")) for c, v in _tracked(shown).items()])
    usage = F.coalesce(F.col("direct"), counter_delta(F.col("cum"), {c: F.col(f"cum_{c}") for c in _TRACKED}))
    return (
        carried.withColumn("accepted", F.when(is_tokens & shown.isNotNull() & ~repeated, usage))
        .withColumn("accepted", F.when(F.col("accepted.total") > 0, F.col("accepted")))
        .withColumn(
            "model",
            F.when(
                F.col("accepted").isNotNull(),
                F.coalesce("active_model", "session_model", F.lit(UNKNOWN_MODEL)),
            ),
        )
        .drop(*[f"{p}_{c}" for p in ("shown", "cum") for c in _TRACKED])
    )


def counter_usage(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return with_accepted_usage(with_carried_state(records, chunk_rows))


def counter_tool(payload_type: Column, name: Column) -> Column:
    """Tool a response item calls, if it calls one."""
    return (
        F.when(payload_type.isin("function_call", "custom_tool_call"), F.coalesce(name, F.lit(UNKNOWN_TOOL)))
        .when(payload_type == "web_search_call", F.lit("web_search"))
        .when(payload_type == "local_shell_call", F.lit("local_shell"))
    )


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _sums(usage: Column) -> list[Column]:
    return [F.sum(usage[c]).alias(c) for c in COUNTERS]


# Strings are grouping keys and pairs are packed numbers: every aggregate below has
# fixed-width buffers, so cells come out of hash aggregation without a sort.
CELL_KEYS = [
    "source_id", "source_kind", "raw_session_id", "cwd_now", "provider_now", "cell", "name", "epoch", "long_context",
]


def counter_cells(rows: DataFrame, table: list[tuple] = PRICE_TABLE) -> DataFrame:
    """Every record of a counter log (``counter_usage``) falls into exactly one cell."""
    item = F.col("rec_type") == "response_item"
    event = F.col("rec_type") == "event_msg"
    kind = F.col("payload_type")
    tool = F.when(item, counter_tool(kind, F.col("tool_raw")))
    context_model = F.when(F.col("rec_type") == "turn_context", blank_to_null(F.col("ctx_model")))
    used = F.col("accepted").isNotNull()
    rows = rows.withColumns(
        {
            "tool": tool,
            "cell": F.when(used, F.lit("usage")).when(tool.isNotNull(), F.lit("tool"))
            .when(context_model.isNotNull(), F.lit("model")).otherwise(F.lit("other")),
            "name": F.coalesce("model", tool, context_model),
            "epoch": F.when(used, price_epoch(F.coalesce("ts", default_price_time()), table)),
            "long_context": F.when(used, is_long_context(F.col("accepted"))),
            "seen_ms": F.unix_millis(F.coalesce(F.when(F.col("rec_type") == "session_meta", F.col("meta_ts")), F.col("ts"))),
        }
    )
    body = (event & kind.isin("user_message", "agent_message", "agent_reasoning")) | (
        item & kind.isin("message", "reasoning")
    )
    payload = item & (F.col("tool").isNotNull() | kind.isin("function_call_output", "custom_tool_call_output"))
    return rows.groupBy(*CELL_KEYS).agg(
        F.count(F.lit(1)).alias("records"),
        F.min(F.when(F.col("raw_session_id").isNotNull(), F.col("ordinal"))).alias("id_ordinal"),
        F.max("ordinal").alias("last_ordinal"),
        F.min(pack(F.col("seen_ms"), F.col("ordinal"))).alias("first_seen"),
        F.max(pack_reversed(F.col("seen_ms"), F.col("ordinal"))).alias("last_seen"),
        F.min(F.when(F.col("tool").isNotNull(), pack(F.col("ordinal"), F.unix_millis("ts")))).alias("first_tool"),
        _count(event & (kind == "user_message")).alias("event_user"),
        _count(event & (kind == "agent_message")).alias("event_assistant"),
        _count(item & (kind == "message") & (F.col("role") == "user")).alias("response_user"),
        _count(item & (kind == "message") & (F.col("role") == "assistant")).alias("response_assistant"),
        F.bool_or(event & kind.isin("task_complete", "task_completed")).alias("completed"),
        F.bool_or(event & kind.isin("turn_aborted", "task_aborted")).alias("aborted"),
        F.bool_or(F.coalesce("ts_invalid", F.lit(False))).alias("ts_invalid"),
        F.bool_or(F.col("rec_type") == "session_meta").alias("saw_meta"),
        _count(body).alias("bodies"),
        _count(payload).alias("payloads"),
        _count(used).alias("responses"),
        *_sums(F.col("accepted")),
    )


# Response dialect -------------------------------------------------------------


def response_scope(records: DataFrame) -> DataFrame:
    """Per log: first working directory and where it appears, session id, time bounds.

    First per distinct directory and id with fixed-width buffers, then over those few.
    """
    main = records.filter(F.col("child_id").isNull()).withColumn("cwd", blank_to_null(F.col("cwd")))
    seen = F.unix_millis("ts")
    found = main.groupBy("source_id", "source_kind", "cwd", "raw_session_id").agg(
        F.min("ordinal").alias("ordinal"),
        F.min(pack(seen, F.col("ordinal"))).alias("first_seen"),
        F.max(pack_reversed(seen, F.col("ordinal"))).alias("last_seen"),
        F.bool_or(F.coalesce("ts_invalid", F.lit(False))).alias("ts_invalid"),
    )
    return found.groupBy("source_id", "source_kind").agg(
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("ordinal"))).alias("cwd"),
        F.min(F.when(F.col("cwd").isNotNull(), F.col("ordinal"))).alias("scope_ordinal"),
        F.min_by("raw_session_id", F.when(F.col("raw_session_id").isNotNull(), F.col("ordinal"))).alias("raw_id"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.bool_or("ts_invalid").alias("ts_invalid"),
    )


def response_rows(records: DataFrame) -> DataFrame:
    """Assistant records and their advisor iterations as ledger rows with a key."""
    own = F.coalesce(
        F.concat(F.lit("id:"), F.col("response_id")),
        F.concat(F.lit("record:"), F.coalesce("child_id", "source_id"), F.lit(":"), F.col("ordinal").cast("string")),
    )
    assistant = records.filter((F.col("rec_type") == "assistant") & F.col("has_message")).withColumn("own_key", own)
    main = F.struct(
        F.col("own_key").alias("key"), "ordinal", "model", "usage", "stop_reason",
        (F.coalesce("is_sidechain", F.lit(False)) | F.col("child_id").isNotNull()).alias("is_sidechain"),
        F.coalesce("has_text", F.lit(False)).alias("has_text"), "tools", F.lit(False).alias("is_advisor"),
    )
    advisors = F.transform(
        F.coalesce("advisors", F.array().cast("array<struct<idx:int,model:string,usage:" + USAGE + ">>")),
        lambda a: F.struct(
            F.concat(F.col("own_key"), F.lit(":advisor:"), a["idx"].cast("string")).alias("key"),
            (F.col("ordinal") + a["idx"] + 1).alias("ordinal"),
            F.coalesce(a["model"], F.col("model")).alias("model"),
            a["usage"].alias("usage"),
            F.lit(None).cast("string").alias("stop_reason"),
            F.lit(True).alias("is_sidechain"),
            F.lit(False).alias("has_text"),
            F.array().cast("array<string>").alias("tools"),
            F.lit(True).alias("is_advisor"),
        ),
    )
    return assistant.select(
        "source_id", "child_id", "ordinal", F.coalesce("ts", default_price_time()).alias("ts"),
        F.explode(F.concat(F.array(main), advisors)).alias("row"), F.col("ordinal").alias("copy_ordinal"),
    ).select("source_id", "child_id", "copy_ordinal", "ts", "row.*")


def response_ledger(records: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """One row per response and session: the last copy wins, child logs after the parent.

    A plain aggregation, so copies are combined before the shuffle and no session
    is sorted. Main-log copies before the log's scope is known do not count.
    """
    rows = response_rows(records)
    scope = response_scope(records) if scope is None else scope
    last = F.max_by(
        F.struct("child_id", "copy_ordinal", "ordinal", "ts", "model", "usage", "stop_reason", "is_sidechain", "has_text", "tools", "is_advisor"),
        F.struct(F.col("child_id").isNotNull().alias("c"), F.coalesce("child_id", F.lit("")).alias("f"), F.col("copy_ordinal")),
    )
    winners = rows.groupBy("source_id", "key").agg(last.alias("row")).select("source_id", "key", "row.*")
    started = scope.select("source_id", "scope_ordinal")
    return (
        winners.join(started, "source_id")
        .filter(F.col("child_id").isNotNull() | (F.col("copy_ordinal") >= F.col("scope_ordinal")))
        .drop("scope_ordinal")
        .filter(~F.coalesce(F.lower(trim_all(F.col("model"))) == "<synthetic>", F.lit(False)))
        .withColumn("model", F.coalesce(blank_to_null(F.col("model")), F.lit(UNKNOWN_MODEL)))
    )


def child_tools(records: DataFrame) -> DataFrame:
    """Tool and invocation counts of child logs, named for the parent's list."""
    children = records.filter(F.col("child_id").isNotNull())
    calls = (
        response_rows(children.filter(F.size(F.coalesce("tools", F.array().cast("array<string>"))) > 0))
        .filter(~F.col("is_advisor"))
        .groupBy("source_id", "child_id", "key")
        .agg(F.max_by("tools", "copy_ordinal").alias("tools"))
        .select("source_id", F.explode("tools").alias("tool"))
        .groupBy("source_id", "tool")
        .agg(F.count(F.lit(1)).alias("calls"))
        .select("source_id", F.lit("child_tool").alias("cell"), F.col("tool").alias("name"), "calls")
    )
    runs = (
        children.groupBy("source_id", "child_id")
        .agg(F.max("agent_type").alias("agent_type"))
        .groupBy("source_id", F.coalesce("agent_type", F.lit("unknown")).alias("name"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .select("source_id", F.lit("agent").alias("cell"), "name", "calls")
    )
    return calls.unionByName(runs)


def user_turns(records: DataFrame, scope: DataFrame) -> DataFrame:
    """Authored user records per log, in total and in plan mode."""
    authored = records.filter(
        F.col("child_id").isNull() & (F.col("rec_type") == "user") & ~F.coalesce("is_sidechain", F.lit(False))
    ).select("source_id", "ordinal", "permission_mode", F.coalesce("is_tool_result", F.lit(False)).alias("continued"))
    started = scope.select("source_id", "scope_ordinal")
    return (
        authored.join(started, "source_id")
        .filter(F.col("ordinal") >= F.col("scope_ordinal"))
        .groupBy("source_id")
        .agg(
            _count(~F.col("continued")).alias("turns"),
            _count(~F.col("continued") & (F.col("permission_mode") == "plan")).alias("plan_turns"),
        )
    )


def without_model(records: DataFrame, scope: DataFrame) -> DataFrame:
    """Logs with an assistant message of the main chain that names no model."""
    kind, side = F.col("rec_type"), F.coalesce("is_sidechain", F.lit(False))
    silent = records.filter(
        F.col("child_id").isNull() & (kind == "assistant") & ~side & F.col("has_message") & blank_to_null(F.col("model")).isNull()
    ).select("source_id", "ordinal")
    started = scope.select("source_id", "scope_ordinal")
    return silent.join(started, "source_id").filter(F.col("ordinal") >= F.col("scope_ordinal")).select("source_id").distinct()


def response_cells(records: DataFrame, rows: DataFrame, table: list[tuple] = PRICE_TABLE) -> DataFrame:
    """Ledger rows (``response_ledger``) per log, model, price epoch; tool calls per log and tool."""
    ledger = rows.withColumns(
        {"epoch": price_epoch(F.col("ts"), table), "long_context": is_long_context(F.col("usage"))}
    )
    main_chain = ~F.col("is_sidechain")
    stop = F.when(main_chain, F.col("stop_reason"))
    when = pack(F.unix_millis("ts"), F.col("ordinal"))
    usage = ledger.groupBy(
        "source_id", F.lit("usage").alias("cell"), F.col("model").alias("name"), "epoch", "long_context", stop.alias("stop_reason")
    ).agg(
        F.count(F.lit(1)).alias("calls"),
        _count(F.col("usage").isNotNull()).alias("responses"),
        _count(main_chain & F.col("has_text")).alias("assistant_messages"),
        F.max(F.when(main_chain & F.col("stop_reason").isNotNull(), when)).alias("stopped_at"),
        *_sums(F.col("usage")),
    )
    tools = (
        ledger.filter(main_chain)
        .select("source_id", F.explode("tools").alias("name"), "ordinal", "ts")
        .groupBy("source_id", F.lit("tool").alias("cell"), "name")
        .agg(F.count(F.lit(1)).alias("calls"), F.min(when).alias("first_tool"))
    )
    return usage.unionByName(tools, allowMissingColumns=True).unionByName(child_tools(records), allowMissingColumns=True)
