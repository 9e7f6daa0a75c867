"""Warnings, provider outcomes, quality level, assumptions and the publish gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.redaction import known_secrets, private_locations
from sessionloom.functions.tables import constant_table
from sessionloom.operators.sessions import PROVIDER_LABELS
from sessionloom.schema import BLOB_PROVIDER, COUNTER_PROVIDER, DETECT_ONLY_PROVIDER, RESPONSE_PROVIDER

# Every registered provider with its format and capabilities.
PROVIDERS = [
    (RESPONSE_PROVIDER, "Claude Code", "claude-code-jsonl", True, True),
    (COUNTER_PROVIDER, "Codex", "codex-jsonl", True, True),
    (BLOB_PROVIDER, "Cursor", "cursor-sqlite", True, True),
    (DETECT_ONLY_PROVIDER, "Gemini Antigravity", "gemini-antigravity-jsonl", False, False),
]

# Warning code and message when a provider's root is missing.
ROOT_UNAVAILABLE = {
    COUNTER_PROVIDER: ("CODEX_ROOT_UNAVAILABLE", "A configured Codex session root was unavailable and was skipped."),
    RESPONSE_PROVIDER: ("CLAUDE_CODE_ROOT_UNAVAILABLE", "The configured Claude Code session root was unavailable and was skipped."),
    BLOB_PROVIDER: ("CURSOR_ROOT_UNAVAILABLE", "Cursor's local workspace storage directory was not found; treated as not installed."),
    DETECT_ONLY_PROVIDER: ("GEMINI_ANTIGRAVITY_ROOT_UNAVAILABLE", "Google Antigravity's local data directory was not found; treated as not installed."),
}

# Messages about stores and logs that cannot be placed or read.
UNVERIFIED_FORMAT = "Cursor's local conversation format is not yet verified against a real installation; session metrics are best-effort."
UNREAD_BLOBS = "A Cursor workspace database had no recognizable user or assistant messages in its unverified local format."
UNPLACED_LOG = {
    COUNTER_PROVIDER: "A Codex JSONL file had no repository-scoping metadata in its discovery prefix.",
    RESPONSE_PROVIDER: "A Claude Code transcript had no repository-scoping metadata in its discovery prefix.",
}

# What every report assumes, and what it assumes per provider.
ASSUMPTIONS = [
    (None, "When no explicit start is supplied, the scanner defaults to full observed history, starting at the earliest session."),
    (None, "Git fileTouches is the sum of per-commit changed-file counts and is not a unique-file count."),
    (None, "Estimated cost is priced from a static, versioned table of known model families; a model not in that table shows tokens only, never a guessed price."),
    (COUNTER_PROVIDER, "Codex sessions are repository-scoped from session or turn-context working-directory metadata."),
    (COUNTER_PROVIDER, "User-turn and assistant-message counts prefer event records and fall back to response records to avoid double counting."),
    (COUNTER_PROVIDER, "Codex token usage is attributed per accepted token-count response to the active turn-context model; repeated cumulative snapshots are ignored and counter resets start a new ledger segment."),
    (BLOB_PROVIDER, "Cursor sessions are repository-scoped from each workspace's workspace.json folder path."),
    (BLOB_PROVIDER, "Cursor's local conversation format is unverified; session content metrics are best-effort and may undercount or miss activity."),
    (RESPONSE_PROVIDER, "Claude Code sessions are repository-scoped from the working directory recorded on transcript lines."),
    (RESPONSE_PROVIDER, "Claude Code turn counts exclude tool-result continuation lines; only author-authored messages are counted as turns."),
    (RESPONSE_PROVIDER, "Claude Code token usage is summed per globally deduplicated assistant response, including advisor iterations and folded subagent transcripts."),
    (RESPONSE_PROVIDER, "Claude Code subagent invocations and their token usage are folded into the parent session while the invocation count remains separately visible."),
]

# Key names no published document may contain.
FORBIDDEN_KEYS = [
    "host", "cwd", "filePath", "absolutePath", "sourceText", "fileBody", "diff", "patch", "prompt", "transcript",
    "toolArguments", "toolResults", "remoteUrl",
]
MAX_PUBLISH_BYTES = 8 * 1024 * 1024


def provider_table(spark: SparkSession) -> DataFrame:
    return constant_table(spark, PROVIDERS, "provider string, display_name string, session_format string, metadata boolean, narrative boolean")


def default_providers(spark: SparkSession) -> DataFrame:
    """Providers selected when none are named: those whose sessions can be read."""
    return provider_table(spark).filter("metadata")


def selected_providers(spark: SparkSession, wanted: list[str] | None = None) -> DataFrame:
    if wanted is None:
        return default_providers(spark)
    return provider_table(spark).join(constant_table(spark, [(w,) for w in wanted], "provider string"), "provider", "left_semi")


def provider_selection(
    repositories: DataFrame, all_sessions: DataFrame, sessions: DataFrame, found: DataFrame, wanted: list[str] | None = None
) -> DataFrame:
    """Outcome per repository and provider; ``found``: provider, available, files."""
    chosen = [p for p in PROVIDERS if (p[3] if wanted is None else p[0] in wanted)]
    listed = F.array(*[F.struct(F.lit(p[0]).alias("provider"), F.lit(p[3]).alias("metadata")) for p in chosen])
    key = ["repo_id", "provider"]
    n = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    rows = (
        repositories.select("repo_id", F.explode(listed).alias("p")).select("repo_id", "p.*")
        .join(found, "provider", "left")
        .join(n(all_sessions, "matched"), key, "left")
        .join(n(sessions, "included"), key, "left")
        .na.fill(0, ["files", "matched", "included"])
    )
    diagnostic = (
        F.when(~F.col("metadata"), F.lit("format-unsupported"))
        .when(~F.coalesce("available", F.lit(False)), F.lit("not-installed"))
        .when(F.col("files") == 0, F.lit("no-project-directory"))
        .when(F.col("matched") == 0, F.lit("no-matching-sessions"))
        .otherwise(F.lit("scanned"))
    )
    return rows.select(*key, "files", "matched", "included", diagnostic.alias("diagnostic"))


def _warning(condition: Column, code: str, severity: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), text.alias("message")))


# The messages below are fixed values as well.


def session_warnings(sessions: DataFrame, undated: DataFrame, scan_audit: DataFrame | None = None) -> DataFrame:
    """Warnings about single sessions; ``scan_audit``: source_id, oversized, invalid_json."""
    c = F.col
    rows = sessions
    if scan_audit is not None:
        rows = rows.join(scan_audit.select("source_id", "oversized", "invalid_json"), "source_id", "left")
    else:
        rows = rows.withColumns({"oversized": F.lit(0), "invalid_json": F.lit(0)})
    label = F.when(c("provider") == RESPONSE_PROVIDER, F.lit(PROVIDER_LABELS[RESPONSE_PROVIDER])).otherwise(F.lit(PROVIDER_LABELS[COUNTER_PROVIDER]))
    logs = c("provider") != BLOB_PROVIDER
    found = F.array_compact(
        F.array(
            _warning(F.coalesce(c("invalid_json"), F.lit(0)) > 0, "SESSION_LINE_INVALID_JSON", "warning", "At least one JSONL record was invalid and ignored."),
            _warning(F.coalesce(c("oversized"), F.lit(0)) > 0, "SESSION_LINE_TOO_LARGE", "warning", "At least one JSONL record exceeded the 4 MiB safety limit and was ignored."),
            _warning(c("ts_invalid"), "SESSION_TIMESTAMP_INVALID", "warning", "At least one session timestamp was invalid and ignored."),
            _warning(logs & (F.size("model_refs") == 0), "SESSION_MODEL_UNKNOWN", "info", "No model identifier was present in the session metadata."),
            _warning(c("unknown_model"), "SESSION_MODEL_UNKNOWN", "info", "At least one token count was recorded before any model identifier was established and was billed under a placeholder model name."),
            _warning(logs & (c("status") == "incomplete") & (c("source_kind") == "active"), "SESSION_ACTIVE_AT_SCAN_END", "info",
                     F.concat(F.lit("An active "), label, F.lit(" session had no completion marker at the observed boundary."))),
            _warning(~logs & (F.coalesce(c("turns"), F.lit(0)) + F.coalesce(c("assistant_messages"), F.lit(0)) == 0), "SESSION_MISSING_METADATA", "info", UNREAD_BLOBS),
        )
    )
    about = rows.select("repo_id", "session_ref", F.explode(found).alias("w")).select("repo_id", "session_ref", "w.*")
    excluded = undated.select(
        "repo_id", "session_ref", F.lit("SESSION_TIMESTAMP_INVALID").alias("code"), F.lit("warning").alias("severity"),
        F.lit("A matched session had no usable timestamp and was excluded.").alias("message"),
    )
    return about.unionByName(excluded)


def repository_warnings(repositories: DataFrame, sessions: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Warnings without a session, once per repository: a store whose format is not verified, and logs that name no directory.

    ``unmatched``: provider of every log that could be placed nowhere. Every repository looks at every log, so one such
    log warns all of them; only the providers are multiplied, at most one row each.
    """
    none = F.lit(None).cast("string")
    row = lambda df, code, message: df.select("repo_id", none.alias("session_ref"), F.lit(code).alias("code"), F.lit("info").alias("severity"), message.alias("message"))
    stores = sessions.filter(F.col("provider") == BLOB_PROVIDER)
    unverified = row(stores.select("repo_id").distinct(), "PROVIDER_FORMAT_UNVERIFIED", F.lit(UNVERIFIED_FORMAT))
    found = unmatched.groupBy().agg(F.collect_set("provider").alias("providers"))  # at most as many as there are dialects
    texts = F.create_map(*[F.lit(x) for pair in UNPLACED_LOG.items() for x in pair])
    unplaced = repositories.select("repo_id").join(F.broadcast(found)).select("repo_id", F.explode("providers").alias("provider"))
    return unverified.unionByName(row(unplaced, "SESSION_MISSING_METADATA", F.try_element_at(texts, F.col("provider"))).filter("message IS NOT NULL"))


def model_warnings(repositories: DataFrame) -> DataFrame:
    """One warning for each repository with a log that holds an assistant message without a model."""
    return repositories.select(
        "repo_id", F.lit(None).cast("string").alias("session_ref"), F.lit("SESSION_MODEL_UNKNOWN").alias("code"), F.lit("info").alias("severity"),
        F.lit("No model identifier was present in an assistant message.").alias("message"),
    )


def provider_warnings(selection: DataFrame) -> DataFrame:
    """Warnings about a provider as a whole."""
    c, none = F.col, F.lit(None).cast("string")
    code, message = none, none
    for provider, (root_code, text) in ROOT_UNAVAILABLE.items():
        code = F.when(c("provider") == provider, F.lit(root_code)).otherwise(code)
        message = F.when(c("provider") == provider, F.lit(text)).otherwise(message)
    label = none
    for provider, text in PROVIDER_LABELS.items():
        label = F.when(c("provider") == provider, F.lit(text)).otherwise(label)
    missing = selection.filter(c("diagnostic") == "not-installed").select("repo_id", code.alias("code"), message.alias("message"))
    unmatched = selection.filter(c("diagnostic").isin("no-project-directory", "no-matching-sessions")).select(
        "repo_id", F.lit("NO_MATCHING_SESSIONS").alias("code"), F.concat(F.lit("No "), label, F.lit(" sessions were scoped to the selected repository.")).alias("message")
    )
    return missing.unionByName(unmatched).select("repo_id", none.alias("session_ref"), "code", F.lit("info").alias("severity"), "message")


def distinct_warnings(warnings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each warning once; those of sessions outside the window are dropped."""
    about = warnings.filter(F.col("session_ref").isNotNull()).join(sessions.select("repo_id", "session_ref"), ["repo_id", "session_ref"], "left_semi")
    general = warnings.filter(F.col("session_ref").isNull())
    return about.unionByName(general.select(*about.columns)).dropDuplicates(["repo_id", "code", "severity", "message", "session_ref"])


def quality(repositories: DataFrame, warnings: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """high / medium / low from the number of warnings and of skipped files."""
    counted = warnings.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("warning_count"), F.count(F.when(F.col("severity") == "warning", F.lit(1))).alias("serious")
    )
    rows = repositories.select("repo_id").join(counted, "repo_id", "left")
    rows = rows.withColumn("skipped_files", F.lit(0)) if skipped is None else rows.join(skipped.select("repo_id", "skipped_files"), "repo_id", "left")
    rows = rows.na.fill(0)
    level = (
        F.when((F.col("serious") == 0) & (F.col("skipped_files") == 0), F.lit("high"))
        .when((F.col("serious") <= 5) & (F.col("skipped_files") <= 5), F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    return rows.select("repo_id", level.alias("level"), "warning_count", "skipped_files")


def assumptions(selection: DataFrame) -> DataFrame:
    """``(repo_id, position, text)``: general ones, then those of the selected providers."""
    texts = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(p).cast("string").alias("needs"), F.lit(t).alias("text")) for i, (p, t) in enumerate(ASSUMPTIONS)
    ])
    chosen = selection.groupBy("repo_id").agg(F.collect_set("provider").alias("providers"))
    applying = F.filter(texts, lambda t: t["needs"].isNull() | F.array_contains("providers", t["needs"]))
    return chosen.select("repo_id", F.explode(applying).alias("t")).select("repo_id", "t.position", "t.text")


# Publish gate ----------------------------------------------------------------------------


def publish_gate(rows: DataFrame, text: str) -> DataFrame:
    """Per repository: fails if any of its texts leaks; nothing of it may be published then. Nested documents: ``plans.publish``."""
    checked = rows.withColumns({"secrets": known_secrets(F.col(text)), "locations": private_locations(F.col(text))})
    bad = (F.size("secrets") > 0) | (F.size("locations") > 0)
    return checked.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(bad, F.lit(1))).alias("leaking_rows"),
        F.count(F.when(F.size("secrets") > 0, F.lit(1))).alias("secret_rows"),
        (~F.bool_or(bad)).alias("passed"),
    )
