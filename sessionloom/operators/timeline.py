"""Milestones and the metadata-only timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import digest, iso, plural, seed, stable_id
from sessionloom.operators.sessions import provider_label

# Labels and phases by kind of event.
LABELS = {
    "session-start": "Session opened",
    "planning": "Plan-first work",
    "model-shift": "Model context changed",
    "exploration": "Exploration tools observed",
    "mutation": "Build tools observed",
    "verification": "Verification tools observed",
    "delegation": "Subagent work delegated",
    "session-outcome": "Session closed",
    "repository-milestone": "Repository milestone",
}
PHASES = {
    "session-start": "discover",
    "exploration": "discover",
    "planning": "decide",
    "model-shift": "decide",
    "mutation": "decide",
    "verification": "deliver",
    "delegation": "deliver",
    "session-outcome": "deliver",
    "repository-milestone": "deliver",
}

# Words in a tool name that make it a verifying or a changing tool.
VERIFY_TOOL = "(?i)(?:test|lint|typecheck|check|verify|build|pytest|vitest|jest|playwright|cypress)"
MUTATE_TOOL = "(?i)(?:edit|write|patch|apply|replace|create|delete|move|rename|format)"

GIT_COLUMNS = ["commits", "merge_commits", "contributors", "file_touches", "insertions", "deletions"]


def evidence_by_session(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("repo_id", "session_ref").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_refs"))


def git_evidence(git: DataFrame, windows: DataFrame, repositories: DataFrame) -> DataFrame:
    """One digest per repository with commits in its window."""
    rows = (
        git.filter(F.col("commits") > 0)
        .join(windows.select("repo_id", "window_start", "window_end"), "repo_id")
        .join(repositories.select("repo_id", "fingerprint"), "repo_id")
    )
    content = seed(F.col("fingerprint"), iso(F.col("window_start")), iso(F.col("window_end")), *[F.col(c) for c in GIT_COLUMNS])
    return rows.select(
        "repo_id", stable_id("ev_", 20, F.lit("git-aggregate"), content).alias("evidence_id"), digest(content).alias("digest"),
        iso(F.col("window_end")).alias("observed_at"), "commits",
    )


def milestones(sessions: DataFrame, evidence: DataFrame, git_rows: DataFrame) -> DataFrame:
    """One per session at its end, one per repository with commits."""
    refs = evidence_by_session(evidence)
    none = F.array().cast("array<string>")
    of_sessions = sessions.join(refs, ["repo_id", "session_ref"], "left").select(
        "repo_id", stable_id("mil_", 20, F.lit("session-activity"), F.col("session_ref")).alias("milestone_id"),
        F.lit("session-activity").alias("kind"),
        F.concat(provider_label(F.col("provider")), F.lit(" session activity")).alias("title"),
        "summary", iso(F.col("ended_at")).alias("occurred_at"), F.coalesce("evidence_refs", none).alias("evidence_refs"),
    )
    of_repositories = git_rows.select(
        "repo_id", stable_id("mil_", 20, F.lit("repository-activity"), F.col("evidence_id")).alias("milestone_id"),
        F.lit("repository-activity").alias("kind"), F.lit("Repository activity").alias("title"),
        F.concat(plural(F.col("commits"), "commit"), F.lit(" observed in the selected time window.")).alias("summary"),
        F.col("observed_at").alias("occurred_at"), F.array("evidence_id").alias("evidence_refs"),
    )
    return of_sessions.unionByName(of_repositories)


def _between(position: Column) -> Column:
    """A point between start and end of the session, to the millisecond."""
    start, end = F.unix_millis("started_at"), F.unix_millis("ended_at")
    inside = start + F.floor((end - start) * position + F.lit(0.5))
    return F.timestamp_millis(F.when(end <= start, start).otherwise(inside).cast("long"))


def _event(kind: Column, at: Column, magnitude: Column, measurement: str, precision: str) -> Column:
    return F.struct(
        kind.alias("kind"), at.alias("at"), magnitude.cast("long").alias("magnitude"),
        F.lit(measurement).alias("measurement"), F.lit(precision).alias("temporal_precision"),
    )


def _lookup(table: dict[str, str], kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[kind]


def timeline(sessions: DataFrame, evidence: DataFrame, git_rows: DataFrame) -> DataFrame:
    """Up to eight events per session and one per repository; order by (occurred_at, event_id)."""
    tools = F.col("tool_refs")
    verifying = F.size(F.filter(tools, lambda t: t.rlike(VERIFY_TOOL)))
    changing = F.size(F.filter(tools, lambda t: t.rlike(MUTATE_TOOL) & ~t.rlike(VERIFY_TOOL)))
    counted = sessions.withColumns({"_verify": verifying, "_mutate": changing}).withColumn(
        "_explore", F.greatest(F.lit(0), F.size(tools) - F.col("_verify") - F.col("_mutate"))
    )
    families = F.filter(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("count")) for k, c in (("exploration", "_explore"), ("mutation", "_mutate"), ("verification", "_verify"))]),
        lambda f: f["count"] > 0,
    )
    fallback = F.array(F.struct(F.lit("exploration").alias("kind"), F.size(tools).alias("count")))
    counted = counted.withColumn(
        "_families",
        F.when(F.col("tool_calls") == 0, F.filter(fallback, lambda f: F.lit(False))).when(F.size(families) == 0, fallback).otherwise(families),
    )
    spread = F.greatest(F.lit(1), F.size("_families") - 1)
    used = F.transform(
        "_families",
        lambda f, i: _event(f["kind"], _between(F.lit(0.45) + (i / spread) * F.lit(0.3)), f["count"], "distinct-tools", "estimated"),
    )
    one = lambda kind, at, magnitude, measurement, precision: _event(F.lit(kind), at, magnitude, measurement, precision)
    plan, agents = F.coalesce("plan_turns", F.lit(0)), F.coalesce("subagents", F.lit(0))
    models = F.size("model_refs")
    closing = F.when(F.col("status") == "completed", F.lit(1)).otherwise(F.lit(0))
    events = F.concat(
        F.array_compact(
            F.array(
                one("session-start", F.col("started_at"), F.col("turns"), "turns", "exact"),
                F.when(plan > 0, one("planning", _between(F.lit(0.2)), plan, "turns", "estimated")),
                F.when(models > 1, one("model-shift", _between(F.lit(0.35)), models, "models", "estimated")),
            )
        ),
        used,
        F.array_compact(
            F.array(
                F.when(agents > 0, one("delegation", _between(F.lit(0.8)), agents, "invocations", "estimated")),
                one("session-outcome", F.col("ended_at"), closing, "status", "exact"),
            )
        ),
    )
    none = F.array().cast("array<string>")
    of_sessions = (
        counted.join(evidence_by_session(evidence), ["repo_id", "session_ref"], "left")
        .select("repo_id", "session_ref", "provider", F.coalesce("evidence_refs", none).alias("source_refs"), F.explode(events).alias("e"))
        .select("repo_id", "session_ref", "provider", "source_refs", "e.kind", iso(F.col("e.at")).alias("occurred_at"), "e.magnitude", "e.measurement", "e.temporal_precision")
    )
    of_repositories = git_rows.select(
        "repo_id", F.lit(None).cast("string").alias("session_ref"), F.lit("git").alias("provider"), F.array("evidence_id").alias("source_refs"),
        F.lit("repository-milestone").alias("kind"), F.col("observed_at").alias("occurred_at"), F.lit(1).cast("long").alias("magnitude"),
        F.lit("milestone").alias("measurement"), F.lit("exact").alias("temporal_precision"),
    )
    rows = of_sessions.unionByName(of_repositories)
    identity = [F.coalesce("session_ref", F.lit("")), F.col("provider"), F.col("kind"), F.col("occurred_at"), F.col("magnitude"),
                F.col("measurement"), F.col("temporal_precision"), F.array_join("source_refs", ",")]
    return rows.withColumns(
        {
            "event_id": stable_id("evt_", 20, *identity),
            "label": _lookup(LABELS, F.col("kind")),
            "phase": _lookup(PHASES, F.col("kind")),
        }
    )


def timeline_coverage(sessions: DataFrame, milestone_rows: DataFrame, events: DataFrame) -> DataFrame:
    """How many sessions, milestones and events each repository's timeline covers."""
    count = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    return count(events, "events").join(count(milestone_rows, "milestones"), "repo_id", "left").join(
        count(sessions, "sessions"), "repo_id", "left"
    ).na.fill(0)
