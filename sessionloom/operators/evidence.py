"""Conversation excerpts: candidates, fair budgeted selection, and their audit."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions.redaction import with_clean_excerpt
from sessionloom.functions.tables import constant_table
from sessionloom.functions.text import iso, stable_id
from sessionloom.operators.scan import CHUNK_ROWS, Carry, carry_last, chunk_of, ranked
from sessionloom.session import materialize
from sessionloom.schema import BLOB_PROVIDER, COUNTER_PROVIDER, RESPONSE_PROVIDER

# Fixed value: longest assistant text that counts as a decision.
DECISION_CHARS = 600


@dataclass(frozen=True)
class Budget:
    max_excerpts: int = 40
    max_chars: int = 600
    max_total_chars: int = 20_000
    max_total_bytes: int | None = None
    per_session: int = 6
    decisions_per_session: int = 3
    policy: str = "deterministic-heuristic-v1"


# The evidence budgets by name.
BUDGETS = {
    "default": Budget(),
    "cloud": Budget(80, 800, 60_000, None, 8, 4),
    "deep": Budget(400, 1_500, 700 * 1024, 700 * 1024, 12, 6, "deep-evidence-v2"),
    "local-safe": Budget(40, 600, 20_000, None, 6, 3),
    "local-balanced": Budget(64, 800, 48_000, None, 8, 4),
    "local-enhanced": Budget(80, 900, 60_000, None, 10, 5),
}


def budget_table(spark: SparkSession) -> DataFrame:
    rows = [(n, b.max_excerpts, b.max_chars, b.max_total_chars, b.max_total_bytes, b.per_session, b.decisions_per_session, b.policy) for n, b in BUDGETS.items()]
    return constant_table(spark, rows, "name string, max_excerpts int, max_chars int, max_total_chars int, max_total_bytes int, per_session int, decisions_per_session int, policy string")


def local_budget(memory_gib: float, cpus: int) -> Budget:
    """The budget of a machine's capability tier."""
    if memory_gib >= 24 and cpus >= 8:
        return BUDGETS["local-enhanced"]
    return BUDGETS["local-balanced"] if memory_gib >= 16 and cpus >= 4 else BUDGETS["local-safe"]


# Common conversation events -----------------------------------------------------------

EVENT_COLUMNS = ["repo_id", "provider", "session_ref", "ordinal", "occurred_at", "role", "text", "event_kind", "permission_mode", "tool_name"]
_SLOTS = 1 << 31  # places for the events of one record: no array is longer


def _owned(records: DataFrame, sessions: DataFrame, provider: str) -> DataFrame:
    """Records of the files the sessions were taken from."""
    owner = sessions.filter(F.col("provider") == provider).select("repo_id", "session_ref", "source_id", "provider")
    return records.join(owner, "source_id")


def response_events(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Titles, authored user text, first assistant text and tool calls of the main chain."""
    main = records.filter(F.col("child_id").isNull() & ~F.coalesce("is_sidechain", F.lit(False)))
    kind = F.col("rec_type")
    none = F.lit(None).cast("string")
    event = lambda slot, role, text, what, mode, tool: F.struct(
        (F.col("ordinal") * _SLOTS + slot.cast("long")).alias("ordinal"), F.lit(role).alias("role"), text.alias("text"),
        F.lit(what).alias("event_kind"), mode.alias("permission_mode"), tool.alias("tool_name"),
    )
    text = F.when(F.length("text") > 0, F.col("text"))
    user = (kind == "user") & ~F.coalesce("is_tool_result", F.lit(False)) & text.isNotNull()
    assistant = (kind == "assistant") & F.col("has_message")
    events = F.concat(
        F.array_compact(
            F.array(
                F.when(kind.isin("custom-title", "ai-title") & (F.length("title") > 0), event(F.lit(0), "system", F.col("title"), "title", none, none)),
                F.when(user, event(F.lit(0), "user", text, "message", F.when(F.length("permission_mode") > 0, F.col("permission_mode")), none)),
                F.when(assistant & text.isNotNull(), event(F.lit(0), "assistant", text, "message", none, none)),
            )
        ),
        F.when(assistant & F.col("tools").isNotNull(), F.transform("tools", lambda t, i: event(i + 1, "assistant", none, "tool-call", none, t))).otherwise(
            F.array().cast("array<struct<ordinal:bigint,role:string,text:string,event_kind:string,permission_mode:string,tool_name:string>>")
        ),
    )
    return _owned(main, sessions, RESPONSE_PROVIDER).select(
        "repo_id", "provider", "session_ref", F.coalesce("ts", F.timestamp_millis(F.lit(0))).alias("occurred_at"), F.explode(events).alias("e")
    ).select("repo_id", "provider", "session_ref", "occurred_at", "e.*").select(*EVENT_COLUMNS)


def counter_events(carried: DataFrame, sessions: DataFrame, scope: DataFrame) -> DataFrame:
    """Messages and tool calls inside the repository, messages of both kinds of record; ``number_events`` chooses between them.

    ``carried``: counter records with their working directory (``cwd_now``) and text.
    """
    from sessionloom.operators.ledger import counter_tool

    kind, item = F.col("payload_type"), F.col("rec_type") == "response_item"
    event = F.col("rec_type") == "event_msg"
    says = F.when(event & (kind == "user_message"), F.lit("user")).when(event & (kind == "agent_message"), F.lit("assistant"))
    reply = F.when(item & (kind == "message") & F.col("role").isin("user", "assistant"), F.col("role"))
    tool = F.when(item, counter_tool(kind, F.col("tool_raw")))
    owned = _owned(carried, sessions, COUNTER_PROVIDER).join(scope.select("cwd_now", "repo_id"), ["cwd_now", "repo_id"], "left_semi")
    return owned.select(
        "repo_id", "provider", "session_ref", "ordinal", F.coalesce("ts", F.timestamp_millis(F.lit(0))).alias("occurred_at"),
        F.coalesce(says, reply, F.when(tool.isNotNull(), F.lit("assistant"))).alias("role"),
        F.when(tool.isNull() & (F.length("text") > 0), F.col("text")).alias("text"),
        F.when(tool.isNotNull(), F.lit("tool-call")).otherwise(F.lit("message")).alias("event_kind"),
        F.lit(None).cast("string").alias("permission_mode"), tool.alias("tool_name"),
        F.when(says.isNotNull(), F.lit("event")).when(reply.isNotNull(), F.lit("response")).alias("copy"),
    ).filter(F.col("role").isNotNull() & (F.col("text").isNotNull() | F.col("tool_name").isNotNull()))


def number_events(*parts: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The common events of all dialects, each with its ``number`` in its session, from 1 without gaps in what was read.

    Only a session's first title counts. A log that holds every message twice, as an event and as a response (``copy``), keeps
    the events, or the responses where it has no event; dropped copies keep their numbers. The table is stored, it is what everything about
    conversations reads. Numbers are counted per chunk of records and offset, so one session may be of any length.
    """
    key = ["repo_id", "provider", "session_ref"]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if "copy" not in every.columns:
        every = every.withColumn("copy", F.lit(None).cast("string"))
    every = materialize(every)
    titles = every.filter("event_kind = 'title'").select(*key, "ordinal")
    later = titles.join(titles.groupBy(*key).agg(F.min("ordinal").alias("_first")), key).filter("ordinal > _first").select(*key, "ordinal")
    numbered = ranked(every.join(later, [*key, "ordinal"], "left_anti"), key, record_chunk(chunk_rows), [F.col("ordinal")], "number")
    with_events = every.filter("copy = 'event'").select(*key).distinct().withColumn("_events", F.lit(True))
    kept = numbered.join(with_events, key, "left").filter("copy IS NULL OR copy = 'event' OR _events IS NULL")
    return kept.select(*EVENT_COLUMNS, "number")


def blob_events(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return _owned(messages.withColumnRenamed("workspace", "source_id"), sessions.select("*"), BLOB_PROVIDER).join(
        sessions.select("repo_id", "session_ref", F.col("started_at").alias("occurred_at")), ["repo_id", "session_ref"]
    ).select(
        "repo_id", "provider", "session_ref", F.col("pos").alias("ordinal"), "occurred_at",
        F.when(F.col("role") == "user", F.lit("user")).otherwise(F.lit("assistant")).alias("role"), "text",
        F.lit("message").alias("event_kind"), none.alias("permission_mode"), none.alias("tool_name"),
    )


# Candidates ------------------------------------------------------------------------------

# Significant events: a short assistant text waits for what follows it.
_USER, _TEXT, _TOOL = 1, 2, 3


def record_chunk(chunk_rows: int = CHUNK_ROWS) -> Column:
    """Chunk of events made by the functions above: by the record they come from."""
    record = F.when(F.col("provider") == RESPONSE_PROVIDER, F.call_function("div", F.col("ordinal"), F.lit(_SLOTS))).otherwise(F.col("ordinal"))
    return chunk_of(record, chunk_rows)


def candidates(events: DataFrame, chunk: Column | None = None, max_decisions: int | None = None) -> DataFrame:
    """Ranked excerpt candidates of every session.

    ``pos`` counts them within a session: title, first user text, turning points in
    order of events, last user text unless the same text is listed already. Turning
    points are changes of the permission mode and short assistant texts directly
    followed by a changing tool call; the providers differ in which tools count. Every
    such text is a candidate unless the caller limits them per session. ``chunk`` must
    not fall as ``ordinal`` rises. Events are read twice: once without texts for the state before and
    after every event, once for the texts of the few that are picked.
    """
    chunk = chunk_of(F.col("ordinal"), CHUNK_ROWS) if chunk is None else chunk
    key = ["repo_id", "provider", "session_ref"]
    provider, kind = F.col("provider"), F.col("event_kind")
    is_user = (F.col("role") == "user") & (kind == "message") & F.col("text").isNotNull()
    is_short = (F.col("role") == "assistant") & (kind == "message") & (F.length("text") <= DECISION_CHARS)
    is_tool = (kind == "tool-call") & ((provider != RESPONSE_PROVIDER) | F.col("tool_name").isin("Edit", "Write"))
    is_title = (kind == "title") & F.col("text").isNotNull() & (provider == RESPONSE_PROVIDER)
    slim = events.select(
        *key, "ordinal", "occurred_at", "permission_mode", is_title.alias("_title"), F.xxhash64("text").alias("_text"),
        F.when(is_user, F.lit(_USER)).when(is_short, F.lit(_TEXT)).when(is_tool, F.lit(_TOOL)).alias("_code"),
    )
    code, title = F.col("_code"), F.coalesce("_title", F.lit(False))
    user, short = code.eqNullSafe(F.lit(_USER)), code.eqNullSafe(F.lit(_TEXT))
    seen = carry_last(
        slim,
        key,
        "ordinal",
        {
            "_next": Carry(code, inclusive=False, backward=True),
            "_user_before": Carry(F.when(user, F.lit(True)), inclusive=False),
            "_user_after": Carry(F.when(user, F.lit(True)), inclusive=False, backward=True),
            "_title_before": Carry(F.when(title, F.lit(True)), inclusive=False),
            "_mode_before": Carry(F.when(user, F.col("permission_mode")), inclusive=False),
        },
        chunk,
    )
    decided = F.when(provider == BLOB_PROVIDER, short).otherwise(short & (F.col("_next") == _TOOL))
    changed = user & (provider == RESPONSE_PROVIDER) & (F.col("permission_mode") != F.col("_mode_before"))
    role = lambda condition, stage, name: F.when(condition, F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("role")))
    roles = F.array_compact(
        F.array(
            role(title & F.col("_title_before").isNull(), 0, "session-title"),
            role(user & F.col("_user_before").isNull(), 1, "user-intent"),
            role(changed, 2, "plan-transition"),
            role(decided, 2, "assistant-decision"),
            role(user & F.col("_user_after").isNull(), 3, "outcome"),
        )
    )
    picked = seen.select(*key, "ordinal", "_text", "occurred_at", F.explode(roles).alias("r")).select(*key, "ordinal", "_text", "occurred_at", "r.*")
    texts = events.select(*key, "ordinal", F.xxhash64("text").alias("_text"), "text")
    found = materialize(picked.join(texts, [*key, "ordinal", "_text"]).drop("_text"))
    decisions = found.filter(F.col("role") == "assistant-decision")
    if max_decisions is not None:
        decisions = ranked(decisions, key, chunk, [F.col("ordinal")], "_n").filter(F.col("_n") <= max_decisions).drop("_n")
    listed = found.filter(~F.col("role").isin("assistant-decision", "outcome")).unionByName(decisions)
    closing = found.filter(F.col("role") == "outcome").join(listed.select(*key, "text").distinct(), [*key, "text"], "left_anti")
    numbered = ranked(listed.unionByName(closing), key, F.struct("stage", chunk.alias("chunk")), [F.col("stage"), F.col("ordinal")], "pos")
    return numbered.select("repo_id", "provider", "session_ref", (F.col("pos") - 1).alias("pos"), "role", "occurred_at", "ordinal", "text")


# Selection ---------------------------------------------------------------------------------


def _fold(budget: Budget):
    """Greedy pass over the few candidates of one repository that can still be chosen."""
    limit, chars_left, bytes_left = budget.max_excerpts, budget.max_total_chars, budget.max_total_bytes
    per_session, per_decisions = budget.per_session, budget.decisions_per_session

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pos", "provider", "session_ref"], kind="stable")
        chars = size = 0
        taken: dict[str, int] = {}
        decided: dict[str, int] = {}
        kept = []
        for row in rows.itertuples(index=False):
            if len(kept) >= limit:
                break
            if taken.get(row.session_ref, 0) >= per_session:
                continue
            if row.is_decision and decided.get(row.session_ref, 0) >= per_decisions:
                continue
            if chars + row.chars > chars_left or (bytes_left is not None and size + row.bytes > bytes_left):
                continue
            chars += row.chars
            size += row.bytes
            taken[row.session_ref] = taken.get(row.session_ref, 0) + 1
            if row.is_decision:
                decided[row.session_ref] = decided.get(row.session_ref, 0) + 1
            kept.append((row.repo_id, row.provider, row.session_ref, row.pos, len(kept), taken[row.session_ref], decided.get(row.session_ref, 0)))
        return pd.DataFrame(kept, columns=["repo_id", "provider", "session_ref", "pos", "index", "of_session", "of_decisions"])

    return choose


cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CHOSEN = "repo_id bigint, provider string, session_ref string, pos bigint, index bigint, of_session bigint, of_decisions bigint"


def _sized(cleaned: DataFrame, budget: Budget) -> DataFrame:
    """Candidates without a secret: where they stand and what they take, without text."""
    return cleaned.filter(F.col("clean").isNotNull()).select(
        "repo_id", "provider", "session_ref", "pos", (F.col("role") == "assistant-decision").alias("is_decision"),
        F.length("clean").alias("chars"),
        (F.octet_length("clean") if budget.max_total_bytes is not None else F.lit(0)).alias("bytes"),
    )


def greedy_rounds(cleaned: DataFrame, budget: Budget) -> DataFrame:
    """The greedy pass in rounds over all repositories at once, for budgets with many candidates of many sizes.

    A round keeps what still fits what is left of the budgets; nothing else can be accepted any more. Supposing that no size is
    refused, the limits of sessions alone say which of these come next, and of them the longest head whose running sums
    fit is accepted: so far nothing was refused, so the pass decides alike. The candidate behind the head is the one the
    pass refuses, and everything up to it is settled. What is left is then smaller than that candidate, so a round
    ends one size at least, and a repository has as many rounds as refusals that end a head. Windows keep at most
    ``per_session`` rows of a session and ``max_excerpts`` + 1 of a repository from each task; only these are summed up.
    """
    key = ["repo_id", "provider", "session_ref"]
    place = F.struct("pos", "provider", "session_ref")
    most, total_bytes = budget.max_excerpts, budget.max_total_bytes
    of_kind = F.row_number().over(Window.partitionBy(*key, "is_decision").orderBy("pos"))
    of_session = F.row_number().over(Window.partitionBy(*key).orderBy("pos"))
    in_order = Window.partitionBy("repo_id").orderBy("pos", "provider", "session_ref")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    columns = [*key, "pos", "is_decision", "chars", "bytes"]
    live = materialize(_sized(cleaned, budget))
    start = {"_at": F.lit(None).cast("struct<pos:bigint,provider:string,session_ref:string>"), **{c: F.lit(0).cast("long") for c in ("_kept", "_chars", "_bytes", "_taken", "_decided")}}
    rows, accepted = live.withColumns(start), None
    while True:
        fits = (
            (F.col("_at").isNull() | (place > F.col("_at")))
            & (F.col("chars") + F.col("_chars") <= budget.max_total_chars)
            & (F.lit(True) if total_bytes is None else F.col("bytes") + F.col("_bytes") <= total_bytes)
            & (F.col("_taken") < budget.per_session)
            & ~(F.col("is_decision") & (F.col("_decided") >= budget.decisions_per_session))
        )
        rows = materialize(rows.filter(fits))
        able = rows.withColumn("_n", of_kind).filter(F.col("_n") <= budget.per_session).filter(~F.col("is_decision") | (F.col("_n") <= budget.decisions_per_session - F.col("_decided")))
        able = able.withColumn("_n", of_session).filter(F.col("_n") <= budget.per_session).filter(F.col("_n") <= budget.per_session - F.col("_taken"))
        heads = able.withColumn("_n", F.row_number().over(in_order)).filter(F.col("_n") <= most + 1)
        fine = (F.col("_n") + F.col("_kept") <= most) & (F.sum("chars").over(so_far) + F.col("_chars") <= budget.max_total_chars)
        if total_bytes is not None:
            fine = fine & (F.sum("bytes").over(so_far) + F.col("_bytes") <= total_bytes)
        heads = materialize(heads.withColumn("_fine", fine).select(*columns, "_fine"))
        taken = heads.filter("_fine").select(*columns)
        accepted = taken if accepted is None else materialize(accepted.unionByName(taken))
        used = accepted.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_kept"), F.sum("chars").alias("_chars"), F.sum("bytes").alias("_bytes"))
        stops = heads.filter("NOT _fine").groupBy("repo_id").agg(F.min(place).alias("_at"))
        state = stops.join(used, "repo_id", "left").na.fill(0, ["_kept", "_chars", "_bytes"]).filter(F.col("_kept") < most)
        if state.isEmpty():
            break
        sessions = accepted.groupBy(*key).agg(F.count(F.lit(1)).alias("_taken"), F.count_if("is_decision").alias("_decided"))
        rows = rows.select(*columns).join(state, "repo_id").join(sessions, key, "left").na.fill(0, ["_taken", "_decided"])
    in_session = Window.partitionBy(*key).orderBy("pos")
    return accepted.select(
        *key, "pos", (F.row_number().over(in_order) - 1).cast("long").alias("index"), F.row_number().over(in_session).cast("long").alias("of_session"),
        F.sum(F.col("is_decision").cast("long")).over(in_session.rowsBetween(Window.unboundedPreceding, 0)).alias("of_decisions"),
    )


def contenders(cleaned: DataFrame, budget: Budget) -> DataFrame:
    """Every candidate that any greedy pass could accept, a bounded number per repository.

    Take candidates of equal size (and equal decision flag) in pass order. Whatever
    the budget rejected once for its size it rejects for every later one of that size.
    So within one session only the first ``per_session`` can be accepted: before a
    further one, either one was rejected for size or the session is full. And within a
    repository an accepted one has at most M accepted predecessors, plus those of full
    sessions (at most M / per_session sessions with per_session each) and of sessions
    full of decisions (M / decisions_per_session with per_session each).
    """
    sized = _sized(cleaned, budget)
    size = ["repo_id", "is_decision", "chars", "bytes"]
    in_session = Window.partitionBy(*size, "provider", "session_ref").orderBy("pos")
    in_repository = Window.partitionBy(*size).orderBy("pos", "provider", "session_ref")
    bound = math.ceil(budget.max_excerpts * (2 + budget.per_session / budget.decisions_per_session))
    return (
        sized.withColumn("_n", F.row_number().over(in_session)).filter(F.col("_n") <= budget.per_session)
        .withColumn("_n", F.row_number().over(in_repository)).filter(F.col("_n") <= bound)
        .drop("_n")
    )


@dataclass(frozen=True)
class Selection:
    excerpts: DataFrame
    audit: DataFrame
    per_provider: DataFrame


def select_evidence(found: DataFrame, budget: Budget = BUDGETS["default"], rounds: bool | None = None) -> Selection:
    """Fair round-robin selection per repository under a global budget.

    One candidate per session and pass, sessions by (provider, reference). A candidate
    is refused, in this order, when the repository has enough, its session has enough,
    its session has enough decisions, it holds a secret, or it does not fit any more;
    a later, smaller one may still fit. Only sizes and positions of the contenders reach
    the pass; the counters of everything else follow from the accepted rows by joins. Budgets in bytes have too many
    sizes to bound the contenders of a repository by much; their pass runs in ``rounds`` over all candidates.
    """
    rounds = budget.max_total_bytes is not None if rounds is None else rounds
    cleaned = materialize(with_clean_excerpt(found, "text", "clean", budget.max_chars).drop("text"))
    if rounds:
        chosen = greedy_rounds(cleaned, budget)
    else:
        chosen = contenders(cleaned, budget).groupBy("repo_id").applyInPandas(_fold(budget), _CHOSEN)
    key = ["repo_id", "provider", "session_ref", "pos"]
    excerpts = cleaned.join(chosen, key).select(
        "repo_id", stable_id("exc_", 20, F.col("session_ref"), F.col("role"), iso(F.col("occurred_at")), F.col("index")).alias("excerpt_id"),
        "provider", "session_ref", "occurred_at", "role", F.col("clean").alias("text"), "index",
    )
    place = F.struct("pos", "provider", "session_ref")
    full = chosen.groupBy("repo_id").agg(F.max(F.when(F.col("index") == budget.max_excerpts - 1, place)).alias("full_at"))
    session_full = chosen.groupBy("repo_id", "provider", "session_ref").agg(
        F.max(F.when(F.col("of_session") == budget.per_session, F.col("pos"))).alias("session_full_at"),
        F.min(F.when(F.col("of_decisions") == budget.decisions_per_session, F.col("pos"))).alias("decisions_full_at"),
    )
    late = lambda at, here: F.coalesce(here > at, F.lit(False))
    secret = (
        cleaned.filter(F.col("clean").isNull()).select("repo_id", "provider", "session_ref", "pos", "role")
        .join(full, "repo_id", "left").join(session_full, ["repo_id", "provider", "session_ref"], "left")
        .filter(
            ~late(F.col("full_at"), place) & ~late(F.col("session_full_at"), F.col("pos"))
            & ~((F.col("role") == "assistant-decision") & late(F.col("decisions_full_at"), F.col("pos")))
        )
        .groupBy("repo_id", "provider").agg(F.count(F.lit(1)).alias("by_redaction"))
    )
    per_provider = (
        cleaned.groupBy("repo_id", "provider").agg(F.count(F.lit(1)).alias("candidates"))
        .join(chosen.groupBy("repo_id", "provider").agg(F.count(F.lit(1)).alias("kept")), ["repo_id", "provider"], "left")
        .join(secret, ["repo_id", "provider"], "left")
        .na.fill(0)
        .withColumn("by_budget", F.col("candidates") - F.col("kept") - F.col("by_redaction"))
    )
    audit = per_provider.groupBy("repo_id").agg(*[F.sum(c).alias(c) for c in ("candidates", "kept", "by_redaction", "by_budget")])
    return Selection(excerpts, audit, per_provider)


def empty_reason(repositories: DataFrame, audit: DataFrame, supported: Column | None = None) -> DataFrame:
    """Why a repository has no excerpt; null where it has one."""
    supported = F.lit(True) if supported is None else supported
    rows = repositories.select("repo_id").join(audit, "repo_id", "left").na.fill(0)
    return rows.select(
        "repo_id",
        F.when(F.col("kept") > 0, F.lit(None)).when(~supported, F.lit("no-supported-provider-evidence"))
        .when(F.col("candidates") == 0, F.lit("no-candidates-in-window")).otherwise(F.lit("all-candidates-rejected")).alias("empty_reason"),
    )


def labelled_excerpts(excerpts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Excerpts with their catalogue reference; those of unknown sessions drop out."""
    refs = catalog.filter(F.col("session_ref").isNotNull()).select("repo_id", "session_ref", "ref")
    return excerpts.join(refs, ["repo_id", "session_ref"]).select(
        "repo_id", "excerpt_id", "ref", "role", F.concat(F.lit("["), "ref", F.lit(" | "), "role", F.lit("] "), "text").alias("line")
    )


def excerpt_coverage(sessions: DataFrame, excerpts: DataFrame, windows: DataFrame) -> DataFrame:
    """Sessions seen, excerpts used, their bytes, and the window."""
    seen = sessions.groupBy("repo_id").agg(F.count(F.lit(1)).alias("sessions_seen"))
    used = excerpts.groupBy("repo_id").agg(F.count(F.lit(1)).alias("excerpts_used"), F.sum(F.octet_length("text")).alias("evidence_bytes"))
    return windows.select("repo_id", iso(F.col("window_start")).alias("window_start"), iso(F.col("window_end")).alias("window_end")).join(
        seen, "repo_id", "left"
    ).join(used, "repo_id", "left").na.fill(0)
