"""Usage, cost, coverage and time-window aggregates per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import EPOCH_ISO, iso
from sessionloom.operators.pricing import PRICE_TABLE, PRICING_TABLE_VERSION, cost_nano, is_long_context, micro_usd, price_epoch, with_price
from sessionloom.operators.sessions import usage_sum
from sessionloom.schema import COUNTERS


# Time window --------------------------------------------------------------------


def time_windows(sessions: DataFrame, repositories: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Observation window per repository, with the basis of each end.

    ``repositories`` may carry ``head_at``; ``params``: repo_id, since, until,
    utc_offset. ``valid`` is false where a window starts after it ends or the
    offset is out of range; such repositories must be reported, not computed.
    """
    repos = repositories if "head_at" in repositories.columns else repositories.withColumn("head_at", F.lit(None).cast("timestamp"))
    bounds = sessions.groupBy("repo_id").agg(F.min("started_at").alias("first_start"), F.max("ended_at").alias("last_end"))
    base = repos.select("repo_id", "head_at").join(bounds, "repo_id", "left")
    if params is None:
        base = base.withColumns(
            {"since": F.lit(None).cast("timestamp"), "until": F.lit(None).cast("timestamp"), "utc_offset": F.lit(None).cast("int")}
        )
    else:
        base = base.join(params.select("repo_id", "since", "until", "utc_offset"), "repo_id", "left")
    epoch = F.to_timestamp(F.lit(EPOCH_ISO))
    inferred = F.greatest("last_end", "head_at")
    out = base.withColumns(
        {
            "window_start": F.coalesce("since", "first_start", epoch),
            "window_end": F.coalesce("until", inferred, epoch),
            "start_basis": F.when(F.col("since").isNotNull(), F.lit("explicit")).otherwise(F.lit("full-history")),
            "end_basis": F.when(F.col("until").isNotNull(), F.lit("explicit"))
            .when(F.col("last_end").isNotNull() & (F.col("last_end") == inferred), F.lit("latest-session"))
            .when(F.col("head_at").isNotNull(), F.lit("head-commit"))
            .otherwise(F.lit("unix-epoch")),
        }
    )
    in_range = F.col("utc_offset").isNull() | F.col("utc_offset").between(-840, 840)
    return out.withColumn("valid", (F.col("window_start") <= F.col("window_end")) & in_range).select(
        "repo_id", "window_start", "window_end", "start_basis", "end_basis", "utc_offset", "valid"
    )


def in_window(sessions: DataFrame, windows: DataFrame) -> DataFrame:
    """Sessions that overlap their repository's window, both ends inclusive."""
    bounds = windows.filter("valid").select("repo_id", "window_start", "window_end")
    return (
        sessions.join(bounds, "repo_id")
        .filter((F.col("ended_at") >= F.col("window_start")) & (F.col("started_at") <= F.col("window_end")))
        .drop("window_start", "window_end")
    )


# Usage ---------------------------------------------------------------------------


def tool_usage(tools: DataFrame) -> DataFrame:
    """Calls and sessions per tool; a session has one row per tool."""
    return tools.groupBy("repo_id", "tool").agg(
        F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("sessions")
    )


def model_usage(models: DataFrame, sessions: DataFrame, table: list[tuple] = PRICE_TABLE) -> DataFrame:
    """Calls, sessions, tokens and cost per model and repository.

    A model none of whose responses had a price is priced once more on its total,
    at the end of its latest session; then all its tokens count as priced.
    """
    ends = sessions.select("repo_id", "session_ref", "ended_at")
    has = lambda c: F.col(c).isNotNull()
    rolled = (
        models.join(ends, ["repo_id", "session_ref"])
        .groupBy("repo_id", "model_provider", "model")
        .agg(
            F.sum("calls").alias("calls"),
            F.countDistinct("session_ref").alias("sessions"),
            usage_sum(has("usage"), F.col("usage")).alias("usage"),
            usage_sum(has("priced"), F.col("priced")).alias("priced"),
            usage_sum(has("unpriced"), F.col("unpriced")).alias("unpriced"),
            F.sum("cost_nano").cast("decimal(38,0)").alias("cost_nano"),
            F.max("ended_at").alias("latest_end"),
        )
    )
    u = F.col("usage")
    again = with_price(rolled, "model", price_epoch(F.col("latest_end"), table), table)
    retry = F.when(
        F.col("cost_nano").isNull() & u.isNotNull(),
        micro_usd(cost_nano({c: u[c] for c in COUNTERS}, F.col("price"), is_long_context(u))),
    )
    return again.withColumn("retry", retry).select(
        "repo_id", "model_provider", "model", "calls", "sessions", "usage",
        F.when(F.col("retry").isNotNull(), u).otherwise(F.col("priced")).alias("priced"),
        F.when(F.col("retry").isNull(), F.col("unpriced")).alias("unpriced"),
        F.coalesce(micro_usd(F.col("cost_nano")), F.col("retry")).alias("cost_micro"),
        F.col("retry").isNotNull().alias("repriced"),
    )


def usage_totals(sessions: DataFrame) -> DataFrame:
    """Session count, turns, messages, tool calls, tokens and active days per repository."""
    has = F.col("usage").isNotNull()
    return sessions.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("turns").alias("turns"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("assistant_messages").alias("assistant_messages"),
        F.sum(F.coalesce("plan_turns", F.lit(0))).alias("plan_turns"),
        F.sum(F.coalesce("subagents", F.lit(0))).alias("subagents"),
        F.count(F.when(F.col("status") == "completed", F.lit(1))).alias("completed"),
        F.countDistinct(F.to_date("started_at")).alias("active_days"),
        F.max("ended_at").alias("last_end"),
        usage_sum(has, F.col("usage")).alias("usage"),
    )


def cost_rollup(model_rows: DataFrame) -> DataFrame:
    """Total cost (null if nothing is priced), priced and unpriced tokens, partial models."""
    return model_rows.groupBy("repo_id").agg(
        F.sum("cost_micro").alias("total_micro"),
        F.coalesce(F.sum("priced.total"), F.lit(0)).alias("priced_tokens"),
        F.coalesce(F.sum("unpriced.total"), F.lit(0)).alias("unpriced_tokens"),
        F.count(F.when(F.col("priced").isNotNull() & F.col("unpriced").isNotNull(), F.lit(1))).alias("partially_priced_models"),
        F.lit(PRICING_TABLE_VERSION).alias("pricing_table_version"),
    )


def coverage(all_sessions: DataFrame, included: DataFrame) -> DataFrame:
    """Discovered, included and skipped sessions per repository."""
    found = all_sessions.groupBy("repo_id").agg(F.count(F.lit(1)).alias("discovered"))
    kept = included.groupBy("repo_id").agg(F.count(F.lit(1)).alias("included"))
    return found.join(kept, "repo_id", "left").select(
        "repo_id", "discovered", F.coalesce("included", F.lit(0)).alias("included"),
        (F.col("discovered") - F.coalesce("included", F.lit(0))).alias("skipped"),
        F.when(F.col("discovered") > F.coalesce("included", F.lit(0)), F.lit("outside-window")).alias("reason"),
    )


def reconcile_sessions(sessions: DataFrame) -> DataFrame:
    """Per session: tokens and models, no cost (a session sum must not be priced)."""
    return sessions.select(
        "repo_id", iso(F.col("started_at")).alias("started_at"), "session_ref", "provider", "turns",
        F.coalesce("usage.total", F.lit(0)).alias("tokens"),
        F.when(F.size("model_refs") > 0, F.array_join("model_refs", ",")).otherwise(F.lit("(none)")).alias("models"),
    )


def reconcile_models(model_rows: DataFrame, table: list[tuple] = PRICE_TABLE) -> DataFrame:
    """Per model: the authoritative cost, and whether the price list knows the model."""
    from sessionloom.operators.pricing import default_price_time

    priced = with_price(model_rows, "model", price_epoch(default_price_time(), table), table)
    return priced.select(
        "repo_id", "model_provider", "model", "calls", F.coalesce("usage.total", F.lit(0)).alias("tokens"),
        "cost_micro", F.col("price").isNotNull().alias("is_priced"),
    )

