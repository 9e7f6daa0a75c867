"""Named queries over the driver tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import redaction
from sessionloom.functions.tables import constant_table
from sessionloom.functions.text import iso
from sessionloom.operators import claims as claims_ops
from sessionloom.operators import git as git_ops
from sessionloom.operators import evidence, ledger, receipt, usage
from sessionloom.operators import profile as profile_ops
from sessionloom.operators import quality as quality_ops
from sessionloom.operators import sessions as session_ops
from sessionloom.operators import timeline as timeline_ops
from sessionloom.operators.pricing import price_epoch, price_lookup, price_responses
from sessionloom.operators.scope import remote_identity as remote_identity_of
from sessionloom.operators.scope import scope_directories
from sessionloom.functions.canonical import document
from sessionloom.operators import documents as document_ops
from sessionloom.plans import publish, report
from sessionloom.plans.driver_layers import layers
from sessionloom.schema import COUNTERS
from sessionloom.sources import chat_blobs, jsonl
from sessionloom.sources import counter_logs, response_logs
from sessionloom.views import driver, raw_logs
from sessionloom.views.shapes import STORY_PLACES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def tokens(usage_column: str = "usage", *names: str) -> list[Column]:
    return [F.col(f"{usage_column}.{n}").alias(f"{n}_tokens") for n in names or COUNTERS]


# Ledgers ---------------------------------------------------------------------------


@query
def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).model_usage.select(
        "repo_id", "model_provider", "model", "calls", "sessions", *tokens(), "cost_micro", "repriced"
    )


@query
def token_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layers(spark, sf_dir).counter_rows.filter(F.col("accepted").isNotNull())
    return rows.select("source_id", "ordinal", "cwd_now", "model", "provider_now", *tokens("accepted", "input", "cached", "output", "reasoning", "total", "cache_write"))


@query
def segment_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = layers(spark, sf_dir).counter_cells
    scope = scope_directories(cells, driver.repositories(spark, sf_dir))
    return cells.join(scope, "cwd_now").groupBy("repo_id", "source_id", "relation").agg(
        F.sum("records").alias("records"), F.sum("responses").alias("responses"), F.sum("total").alias("total_tokens")
    )


@query
def response_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layers(spark, sf_dir).response_ledger
    return rows.select("source_id", "key", "copy_ordinal", "model", "is_sidechain", "is_advisor", "stop_reason", F.size("tools").alias("tool_blocks"), *tokens())


@query
def child_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.child_tools(driver.response_records(spark, sf_dir))
    return rows.select("source_id", "cell", "name", "calls")


@query
def price_lookup_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = driver.counter_records(spark, sf_dir).filter("ctx_model IS NOT NULL").select(
        F.col("ctx_model").alias("model"), price_epoch(F.col("ts")).alias("epoch")
    ).distinct()
    return used.join(price_lookup(used), ["model", "epoch"], "left").select(
        "model", "epoch", F.col("price.prefix").alias("prefix"), F.col("price.n_input").alias("nano_input"),
        F.col("price.n_output").alias("nano_output"), F.col("price").isNotNull().alias("is_priced"),
    )


@query
def response_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of every single response of the response ledger."""
    rows = layers(spark, sf_dir).response_ledger.filter(F.col("usage").isNotNull())
    return price_responses(rows, "model", "usage", F.col("ts")).select(
        "source_id", "key", "model", F.col("cost_nano").cast("bigint").alias("cost_nano"), "cost_micro", "is_priced"
    )


@query
def priced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).all_models.select(
        "repo_id", "session_ref", "provider", "model_provider", "model", "calls",
        F.col("usage.total").alias("total_tokens"), F.col("priced.total").alias("priced_tokens"),
        F.col("unpriced.total").alias("unpriced_tokens"), F.col("cost_nano").cast("bigint").alias("cost_nano"),
    )


@query
def fallback_reprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models per provider, and whether their price came from the second look-up."""
    return layers(spark, sf_dir).model_usage.select(
        "repo_id", "model_provider", "model", F.col("priced.total").alias("priced_tokens"),
        F.col("unpriced.total").alias("unpriced_tokens"), "cost_micro", "repriced",
    )


# Raw logs ----------------------------------------------------------------------------


def _parsed_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter_logs.counter_records(jsonl.raw_records(raw_logs.counter_lines(spark, sf_dir), raw_logs.LINE_BYTES))


def _parsed_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = jsonl.raw_records(raw_logs.response_lines(spark, sf_dir), raw_logs.LINE_BYTES)
    return response_logs.response_records(raw, raw_logs.sidecars(spark, sf_dir))


@query
def parsed_counter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of counter logs as typed records; lines that are no object or too long give none."""
    fields = [F.col(f"{u}.{c}").alias(f"{u}_{c}") for u in ("cum", "direct") for c in ("input", "cached", "output", "reasoning", "total", "cache_write")]
    return _parsed_counter(spark, sf_dir).select(
        "source_id", "source_kind", "ordinal", iso(F.col("ts")).alias("ts"), iso(F.col("meta_ts")).alias("meta_ts"), "ts_invalid", "rec_type", "payload_type",
        "cwd", "raw_session_id", "model_provider", "meta_model", "ctx_model", "role", "tool_raw", "text", *fields,
    )


@query
def parsed_response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of response logs and of their child logs as typed records."""
    fields = [F.col(f"usage.{c}").alias(f"usage_{c}") for c in COUNTERS]
    return _parsed_response(spark, sf_dir).select(
        "source_id", "source_kind", "child_id", "agent_type", "ordinal", iso(F.col("ts")).alias("ts"), "ts_invalid", "rec_type", "cwd", "raw_session_id",
        "permission_mode", "is_sidechain", "is_tool_result", "has_message", "response_id", "model", "stop_reason", "has_text", "text", "title",
        F.array_join("tools", "|").alias("tools"), *fields, F.size("advisors").alias("advisors"),
        F.get("advisors", F.lit(0))["model"].alias("advisor_model"), F.get("advisors", F.lit(0))["usage"]["total"].alias("advisor_total"),
    )


@query
def scan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per log that are too long or no JSON object."""
    return _audited(spark, sf_dir)


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_logs.counter_lines(spark, sf_dir).unionByName(raw_logs.response_lines(spark, sf_dir))
    return jsonl.scan_audit(lines, raw_logs.LINE_BYTES)


@query
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation events of both dialects from their raw lines, numbered per session."""
    built = layers(spark, sf_dir)
    carried = ledger.with_carried_state(_parsed_counter(spark, sf_dir))
    scope = scope_directories(carried.select("cwd_now").distinct(), built.inputs.repositories)
    parts = evidence.response_events(_parsed_response(spark, sf_dir), built.all_sessions), evidence.counter_events(carried, built.all_sessions, scope)
    rows = evidence.number_events(*parts)
    return rows.select("repo_id", "provider", "session_ref", "number", iso(F.col("occurred_at")).alias("occurred_at"), "role", "text", "event_kind", "permission_mode", "tool_name")


# Sessions ----------------------------------------------------------------------------


@query
def sessions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).all_sessions.select(
        "repo_id", "session_ref", "provider", "source_kind", iso(F.col("started_at")).alias("started_at"),
        iso(F.col("ended_at")).alias("ended_at"), "start_ordinal", "end_ordinal", "relation", "turns", "assistant_messages",
        "tool_calls", "plan_turns", "subagents", F.array_join("model_refs", "|").alias("model_refs"),
        F.array_join("tool_refs", "|").alias("tool_refs"), "summary", *tokens(),
    )


@query
def workspace_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_blobs.workspace_folders(driver.workspaces(spark, sf_dir))
    return rows.select("workspace", "folder", iso(F.col("modified_at")).alias("modified_at"))


@query
def every_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all three dialects; chat stores are placed by their workspace's folder."""
    built = layers(spark, sf_dir)
    folders = chat_blobs.workspace_folders(driver.workspaces(spark, sf_dir))
    stores = session_ops.blob_sessions(chat_blobs.blob_messages(driver.chat_blobs(spark, sf_dir)), folders, built.inputs.repositories).sessions
    columns = ["repo_id", "session_ref", "provider", "source_kind", "started_at", "ended_at", "relation", "turns", "assistant_messages", "status"]
    rows = built.all_sessions.select(*columns).unionByName(session_ops.latest_copies(stores).select(*columns))
    return rows.withColumns({x: iso(F.col(x)) for x in ("started_at", "ended_at")})


@query
def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).all_sessions.groupBy("repo_id", "provider", "status").agg(F.count(F.lit(1)).alias("sessions"))


@query
def session_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).all_tools.select("repo_id", "session_ref", "provider", "tool", "calls")


@query
def session_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which file each session was taken from."""
    return layers(spark, sf_dir).all_sessions.select("repo_id", "session_ref", "source_id", "source_kind")


@query
def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).evidence.select("repo_id", "session_ref", "source", "kind", "event_ordinal", "observed_at", "evidence_id", "digest")


# Usage, windows, history ----------------------------------------------------------------


@query
def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).tool_usage


@query
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).totals.select(
        "repo_id", "sessions", "turns", "tool_calls", "assistant_messages", "plan_turns", "subagents", "completed", "active_days", *tokens()
    )


@query
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).costs


@query
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions kept when every window starts a week after the first session."""
    built = layers(spark, sf_dir)
    later = built.windows.withColumn("window_start", F.col("window_start") + F.expr("INTERVAL 7 DAYS"))
    return usage.coverage(built.all_sessions, usage.in_window(built.all_sessions, later))


@query
def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).windows.select(
        "repo_id", iso(F.col("window_start")).alias("window_start"), iso(F.col("window_end")).alias("window_end"), "start_basis", "end_basis"
    )


@query
def window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that touch the second week of their repository's history."""
    built = layers(spark, sf_dir)
    week = built.windows.withColumns(
        {"window_start": F.col("window_start") + F.expr("INTERVAL 7 DAYS"), "window_end": F.col("window_start") + F.expr("INTERVAL 14 DAYS")}
    )
    return usage.in_window(built.all_sessions, week).select("repo_id", "session_ref")


@query
def git_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).git


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return git_ops.status_counts(driver.status_entries(spark, sf_dir))


@query
def reconcile_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.reconcile_sessions(layers(spark, sf_dir).sessions)


@query
def reconcile_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.reconcile_models(layers(spark, sf_dir).model_usage)


# Timeline, signals, profile, receipt -------------------------------------------------------


def _joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


@query
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).milestones.select("repo_id", "milestone_id", "kind", "title", "occurred_at", _joined("evidence_refs"))


@query
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).timeline.select(
        "repo_id", "session_ref", "provider", "kind", "occurred_at", "magnitude", "measurement", "temporal_precision", _joined("source_refs"),
        "event_id", "label", "phase",
    )


@query
def timeline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = layers(spark, sf_dir)
    return timeline_ops.timeline_coverage(built.sessions, built.milestones, built.timeline)


@query
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).signals.select(
        "repo_id", "id", "family", "headline", "detail", "value", "unit", "notability", _joined("source_refs"), "rank"
    )


@query
def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).catalog.select(
        "repo_id", "ref", "provider", "session_ref", iso(F.col("at")).alias("occurred_at"), _joined("evidence_refs"), "turns", "assistant_messages", "tool_calls"
    )


@query
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = layers(spark, sf_dir)
    rows = profile_ops.scores(built.sessions, built.tool_usage, built.totals, built.git, built.windows)
    return rows.select("repo_id", *profile_ops.DIMENSIONS)


@query
def work_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = layers(spark, sf_dir)
    rows = profile_ops.work_patterns(built.sessions, built.tool_usage, built.model_usage, built.windows)
    return rows.withColumns({"peak_hours": F.array_join(F.col("peak_hours").cast("array<string>"), ","), "preferred_days": F.array_join("preferred_days", ",")})


@query
def archetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).profiles.select("repo_id", "archetype", "rationale")


@query
def receipt_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = layers(spark, sf_dir)
    return receipt.tiles(built.totals, built.costs, built.model_usage)


@query
def spend_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipt.spend_share(layers(spark, sf_dir).model_usage)


@query
def unpriced_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = layers(spark, sf_dir)
    return receipt.unpriced_share(built.totals, built.costs)


@query
def daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = layers(spark, sf_dir)
    return receipt.daily_spend(built.sessions, built.model_usage).withColumn("spend_micro", F.round("spend_micro").cast("long"))


@query
def daily_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten columns, so that a month of days is really thinned out."""
    built = layers(spark, sf_dir)
    return receipt.downsample(receipt.daily_spend(built.sessions, built.model_usage), 10).select("repo_id", "day", "sessions")


@query
def hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipt.hour_profile(layers(spark, sf_dir).sessions)


@query
def top_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen latest sessions of each repository."""
    rows = receipt.top_rows(layers(spark, sf_dir).sessions, receipt.MAX_SESSIONS, F.desc("started_at"), F.col("session_ref"))
    return rows.select("repo_id", "position", "session_ref")


@query
def usage_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = layers(spark, sf_dir)
    return receipt.usage_suffix(built.totals, built.costs)


@query
def reasoned_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metric-derived sections."""
    return profile_ops.default_narrative(layers(spark, sf_dir).profiles)


# Quality ---------------------------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files per dialect; the blob store is not installed in this view."""
    logs = lambda df, p: df.select("source_id").distinct().agg(F.lit(p).alias("provider"), F.lit(True).alias("available"), F.count(F.lit(1)).alias("files"))
    return logs(driver.counter_records(spark, sf_dir), "codex").unionByName(logs(driver.response_records(spark, sf_dir), "claude-code"))


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = layers(spark, sf_dir)
    selection = quality_ops.provider_selection(built.inputs.repositories, built.all_sessions, built.sessions, _found(spark, sf_dir))
    every = quality_ops.session_warnings(built.all_sessions, built.undated, _audited(spark, sf_dir)).unionByName(quality_ops.provider_warnings(selection))
    every = every.unionByName(quality_ops.model_warnings(built.without_model))
    every = every.unionByName(quality_ops.repository_warnings(built.inputs.repositories, built.all_sessions, built.files.unmatched))
    return quality_ops.distinct_warnings(every, built.sessions)


@query
def provider_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = layers(spark, sf_dir)
    wanted = [p[0] for p in quality_ops.PROVIDERS]
    return quality_ops.provider_selection(built.inputs.repositories, built.all_sessions, built.sessions, _found(spark, sf_dir), wanted)


@query
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warnings(spark, sf_dir)


@query
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ops.quality(layers(spark, sf_dir).inputs.repositories, _warnings(spark, sf_dir))


@query
def assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that apply to the providers with sessions in the window."""
    return quality_ops.assumptions(layers(spark, sf_dir).sessions.select("repo_id", "provider"))


# Redaction and publishing -------------------------------------------------------------------


@query
def redact_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = redaction.with_redaction_counts(driver.texts(spark, sf_dir), "text", 1000)
    return rows.select("doc_id", "clean", "truncated")


@query
def redaction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    audited = redaction.with_redaction_counts(driver.texts(spark, sf_dir), "text", 5000)
    return redaction.redaction_summary(audited, ["repo_id"])


@query
def redact_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.with_clean_excerpt(driver.texts(spark, sf_dir), "text", "clean", 2000).select("doc_id", "clean")


@query
def known_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = driver.texts(spark, sf_dir)
    return rows.select("doc_id", F.array_join(redaction.known_secrets(F.col("text")), ",").alias("categories"))


@query
def private_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = driver.texts(spark, sf_dir)
    return rows.select("doc_id", F.array_join(redaction.private_locations(F.col("text")), ",").alias("categories"))


@query
def leak_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ops.publish_gate(driver.texts(spark, sf_dir), "text")


@query
def nested_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in nested documents a forbidden key, a secret or a private location stands."""
    nodes = document_ops.document_nodes(driver.nested_documents(spark, sf_dir), ["doc_id"], "document")
    return document_ops.document_leaks(nodes, ["doc_id"], quality_ops.FORBIDDEN_KEYS)


@query
def snapshot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested canonical document per repository, over its totals, window and models."""
    built, c = layers(spark, sf_dir), F.col
    model = F.struct("model_provider", "model", "calls", F.struct("priced.total", c("repriced").alias("second_lookup")).alias("priced"), "cost_micro")
    models = built.model_usage.groupBy("repo_id").agg(F.array_sort(F.collect_list(model)).alias("models"))
    window = F.struct(iso(c("window_start")).alias("start"), iso(c("window_end")).alias("end"), F.lit(None).cast("string").alias("since"), F.lit(None).cast("string").alias("until"))
    totals = built.totals.select("repo_id", F.struct("sessions", "turns", "tool_calls", F.struct("usage.input", "usage.output", "usage.cache_read").alias("tokens")).alias("totals"))
    rows = built.windows.select("repo_id", window.alias("window")).join(totals, "repo_id", "left").join(models, "repo_id", "left")
    rows = rows.select("repo_id", F.struct("window", "totals", "models", F.array().cast("array<string>").alias("notes")).alias("snapshot"))
    return rows.select("repo_id", document(c("snapshot"), rows.schema["snapshot"].dataType, {"window.since", "models.cost_micro"}).alias("document"))


def _published(spark: SparkSession, sf_dir: str) -> tuple[dict[str, publish.Section], DataFrame, str]:
    c, path = F.col, publish.scratch(spark)
    sessions = layers(spark, sf_dir).all_sessions.select(
        "repo_id", "session_ref", "provider", F.struct(iso(c("started_at")).alias("start"), iso(c("ended_at")).alias("end")).alias("span"),
        F.struct("turns", "assistant_messages", "tool_calls").alias("counts"), c("model_refs").alias("models"),
    )
    pages = driver.remotes(spark, sf_dir).select((c("page_id") % 4).alias("repo_id"), "page_id", F.struct(c("url").alias("origin")).alias("found"))
    sections = {"sessions": publish.Section(sessions), "remotes": publish.Section(pages)}
    verdict, _ = publish.publish(sections, path)
    return sections, verdict, path


@query
def publish_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every repository and addresses of pages in some: what the check says about each."""
    return _published(spark, sf_dir)[1]


@query
def published_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions read back from what was published: those of the repositories without addresses."""
    sections, _, path = _published(spark, sf_dir)
    rows = publish.read_published(spark, path, "sessions", sections["sessions"].schema)
    return rows.select(
        "repo_id", "session_ref", "provider", F.col("span.start").alias("started_at"), F.col("span.end").alias("ended_at"),
        "counts.turns", "counts.assistant_messages", "counts.tool_calls", F.array_join("models", "|").alias("models"),
    )


@query
def remote_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.concat(F.lit("/repo/"), F.col("page_id").cast("string"))
    rows = remote_identity_of(driver.remotes(spark, sf_dir), "url", local)
    return rows.select("page_id", "fingerprint", "fingerprint_basis", "path_hash")


@query
def blob_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_blobs.blob_messages(driver.chat_blobs(spark, sf_dir))


# Evidence --------------------------------------------------------------------------------------


@query
def excerpt_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.candidates(driver.conversation_events(spark, sf_dir))
    return rows.select("repo_id", "provider", "session_ref", "pos", "role", iso(F.col("occurred_at")).alias("occurred_at"), "text")


@query
def evidence_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = evidence.select_evidence(evidence.candidates(driver.conversation_events(spark, sf_dir)))
    return chosen.excerpts.select("repo_id", "excerpt_id", "provider", "session_ref", iso(F.col("occurred_at")).alias("occurred_at"), "role", "text", "index")


@query
def evidence_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deep budget, chosen in distributed rounds."""
    chosen = evidence.select_evidence(evidence.candidates(driver.conversation_events(spark, sf_dir)), evidence.BUDGETS["deep"])
    return chosen.excerpts.select("repo_id", "excerpt_id", "provider", "session_ref", iso(F.col("occurred_at")).alias("occurred_at"), "role", "text", "index")


@query
def evidence_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters under a budget so small that sizes are refused again and again, in rounds."""
    tight = evidence.Budget(30, 300, 3_000, 3_100, 2, 1)
    return evidence.select_evidence(evidence.candidates(driver.conversation_events(spark, sf_dir)), tight).per_provider


@query
def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.select_evidence(evidence.candidates(driver.conversation_events(spark, sf_dir)), evidence.BUDGETS["cloud"]).per_provider


# Claims and report -----------------------------------------------------------------------------


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per catalogued session: its own reference, and some unknown or repeated ones."""
    p = F.substr("ref", F.lit(2)).try_cast("int")
    second = F.when(p % 5 == 0, F.lit("S999")).when(p % 7 == 0, F.col("ref")).otherwise(F.lit("S01"))
    rows = layers(spark, sf_dir).catalog.filter(F.col("ref") != "GIT")
    return rows.select(
        "repo_id", p.alias("position"), F.concat(F.lit("moments."), p.cast("string"), F.lit(".title")).alias("path"),
        F.when(p % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("Session with "), F.col("turns").cast("string"), F.lit(" turns"))).alias("text"),
        F.when(p % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("ref"), second)).alias("refs"),
    )


@query
def claim_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims_ops.claim_errors(_claims(spark, sf_dir), layers(spark, sf_dir).catalog)
    return rows.withColumn("number", F.col("number").cast("int"))


@query
def claim_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    defaults = claims.select("repo_id", "path", F.lit("Observed session").alias("text"), F.array(F.lit("S01")).alias("refs"))
    rows = claims_ops.repair_claims(claims, defaults, layers(spark, sf_dir).catalog)
    return rows.select("repo_id", "path", "text", _joined("refs"), _joined("fallbacks"))


def _story(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Claimed reports of every kind, repaired from the defaults of their repository."""
    built, c = layers(spark, sf_dir), F.col
    places = constant_table(spark, STORY_PLACES, "mode int, path string, i int, field string")
    kind = (c("repo_id") + c("i")) % 5
    refs = F.when(c("i") % 3 == 2, F.array(F.lit("S01"), F.lit("GIT"), F.lit("S01"))).when(c("i") % 2 == 0, F.array(F.lit("S01"))).otherwise(F.array(F.lit("S999")))
    text = F.when((kind == 2) & (c("field") != "title"), F.lit(" ")).otherwise(F.concat_ws(" ", F.lit("Claim"), "field", "i", F.lit("of"), c("repo_id").cast("string")))
    rows = built.inputs.repositories.withColumn("mode", (c("repo_id") % 4).cast("int")).join(places, "mode").select("repo_id", "path", text.alias("text"), refs.alias("refs"))
    return claims_ops.repair_story(rows, claims_ops.default_claims(built.profiles, built.totals, built.git, built.catalog), built.catalog)


@query
def story_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _story(spark, sf_dir)[0].select("repo_id", "path", "text", _joined("refs"))


@query
def story_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _story(spark, sf_dir)[1]


@query
def default_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = layers(spark, sf_dir)
    return claims_ops.default_claims(built.profiles, built.totals, built.git, built.catalog).select("repo_id", "path", "text", _joined("refs"))


@query
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = layers(spark, sf_dir)
    names = built.inputs.repositories.select("repo_id", F.concat(F.lit("repo-"), F.col("repo_id").cast("string")).alias("display_name"))
    return report.report_lines(built.totals, built.costs, built.git, built.windows, built.profiles, built.signals, names)
