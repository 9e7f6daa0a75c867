"""Receipt queries: tiles, spend shares, daily spend, hour profile, one-line summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.numbers import ratio
from sessionloom.functions.text import compact_tokens, usd

MAX_COLUMNS = 40
MAX_SHARE_MODELS = 8
MAX_SESSIONS = 16
MAX_SIGNALS = 10
MAX_RECEIPT_SIGNALS = 3


def top_rows(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows of every repository; the limit is applied before the shuffle too."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))).filter(F.col("position") <= limit)


def tiles(totals: DataFrame, costs: DataFrame, model_rows: DataFrame) -> DataFrame:
    """Spend, tokens, sessions and the model with the largest spend (ties by provider, name)."""
    top = model_rows.filter(F.col("cost_micro").isNotNull()).groupBy("repo_id").agg(
        F.min(F.struct((-F.col("cost_micro")).alias("neg"), "model_provider", "model"))["model"].alias("top_spend_model")
    )
    return totals.join(costs, "repo_id", "left").join(top, "repo_id", "left").select(
        "repo_id", F.col("total_micro").alias("spend_micro"), F.coalesce("usage.total", F.lit(0)).alias("tokens"), "sessions", "top_spend_model"
    )


def _tenth_percent(part: Column, whole: Column) -> Column:
    return F.floor(ratio(part, whole) * 1000 + F.lit(0.5)) / 10


def spend_share(model_rows: DataFrame) -> DataFrame:
    """The eight largest models with their share of the priced total."""
    priced = model_rows.filter(F.col("cost_micro") > 0).select("repo_id", "model_provider", "model", "cost_micro")
    total = priced.groupBy("repo_id").agg(F.sum("cost_micro").alias("all_micro"))
    top = top_rows(priced, MAX_SHARE_MODELS, F.desc("cost_micro"), F.col("model_provider"), F.col("model"))
    return top.join(total, "repo_id").select(
        "repo_id", "position", "model", "cost_micro", _tenth_percent(F.col("cost_micro"), F.col("all_micro")).alias("percent")
    )


def unpriced_share(totals: DataFrame, costs: DataFrame) -> DataFrame:
    tokens = F.coalesce("usage.total", F.lit(0))
    some = (tokens > 0) & (F.col("unpriced_tokens") > 0)
    return totals.join(costs, "repo_id").select("repo_id", F.when(some, _tenth_percent(F.col("unpriced_tokens"), tokens)).alias("unpriced_percent"))


def session_rates(names: DataFrame, model_rows: DataFrame) -> DataFrame:
    """Cost and tokens that give each first-model name its rate per token.

    By exact name; for a name that is not listed, by the first listed model that is a
    prefix of it or has it as a prefix. The names are the few distinct first models of
    a repository, matched through their prefixes by equi-joins.
    """
    order = F.struct("model_provider", "model")
    listed = model_rows.groupBy("repo_id", "model").agg(
        F.min_by(F.struct(F.col("cost_micro").alias("cost"), F.col("usage.total").alias("tokens"), "model_provider"), order).alias("m")
    )
    exact = names.join(listed.withColumnRenamed("model", "name"), ["repo_id", "name"], "left")
    found = exact.filter(F.col("m").isNotNull()).select("repo_id", "name", "m")
    missing = exact.filter(F.col("m").isNull()).select("repo_id", "name")
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.left(c, i))
    shorter = missing.select("repo_id", "name", F.explode(prefixes(F.col("name"))).alias("model")).join(listed, ["repo_id", "model"])
    longer = (
        listed.select("repo_id", "model", "m", F.explode(prefixes(F.col("model"))).alias("name")).join(missing, ["repo_id", "name"], "left_semi")
    )
    columns = ["repo_id", "name", "model", "m"]
    guessed = shorter.select(*columns).unionByName(longer.select(*columns)).groupBy("repo_id", "name").agg(
        F.min_by("m", F.struct("m.model_provider", "model")).alias("m")
    )
    usable = F.col("m.cost").isNotNull() & (F.col("m.tokens") > 0)
    return found.unionByName(guessed).filter(usable).select(
        "repo_id", "name", F.col("m.cost").alias("rate_cost"), F.col("m.tokens").alias("rate_tokens")
    )


def daily_spend(sessions: DataFrame, model_rows: DataFrame) -> DataFrame:
    """Estimated spend per UTC day: session tokens at the rate of the session's first model.

    Token sums stay whole numbers per day and model; the rate is applied once to each.
    """
    first = F.coalesce(F.try_element_at("model_refs", F.lit(1)), F.lit("unknown"))
    per_model = (
        sessions.select("repo_id", F.date_format("started_at", "yyyy-MM-dd").alias("day"), first.alias("name"), F.coalesce("usage.total", F.lit(0)).alias("tokens"))
        .groupBy("repo_id", "day", "name")
        .agg(F.count(F.lit(1)).alias("sessions"), F.sum("tokens").alias("tokens"))
    )
    rates = session_rates(per_model.select("repo_id", "name").distinct(), model_rows)
    spend = F.when(F.col("tokens") > 0, F.col("tokens").cast("double") * F.col("rate_cost").cast("double") / F.col("rate_tokens").cast("double"))
    valued = per_model.join(rates, ["repo_id", "name"], "left").withColumn("spend", spend)
    days = valued.groupBy("repo_id", "day").agg(
        F.sum("sessions").alias("sessions"),
        F.array_sort(F.collect_list(F.when(F.col("spend").isNotNull(), F.struct("name", "spend")))).alias("parts"),
        F.min(F.when(F.col("spend") > 0, F.struct((-F.col("spend")).alias("neg"), "name"))).alias("top"),
    )
    # The few models of a day are added in name order: the sum of doubles is reproducible.
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["spend"])
    return days.select("repo_id", "day", "sessions", total.alias("spend_micro"), F.col("top.name").alias("top_model"), (total <= 0).alias("unpriced"))


def downsample(days: DataFrame, columns: int = MAX_COLUMNS) -> DataFrame:
    """At most ``columns`` days per repository, evenly picked; dates bound a repository's rows."""
    w = Window.partitionBy("repo_id")
    numbered = days.withColumns({"_i": F.row_number().over(w.orderBy("day")) - 1, "_n": F.count(F.lit(1)).over(w)})
    step = F.col("_n").cast("double") / columns
    wanted = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.floor(i * step).cast("int"))
    return numbered.filter((F.col("_n") <= columns) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def hour_profile(sessions: DataFrame) -> DataFrame:
    """24 characters per repository: no session, under half of the peak, at least half."""
    counts = sessions.groupBy("repo_id").agg(
        F.array(*[F.count(F.when(F.hour("started_at") == h, F.lit(1))) for h in range(24)]).alias("hours")
    )
    peak = F.greatest(F.lit(1), F.array_max("hours"))
    mark = lambda n: F.when(n <= 0, F.lit("·")).when(n / peak >= 0.5, F.lit("#")).otherwise(F.lit("+"))
    return counts.select("repo_id", F.array_join(F.transform("hours", mark), "").alias("profile"))


def usage_suffix(totals: DataFrame, costs: DataFrame) -> DataFrame:
    """', 12.3K tokens, est. $4.82', empty without tokens."""
    tokens = F.coalesce("usage.total", F.lit(0))
    cost = F.when(F.col("total_micro").isNull(), F.lit("")).otherwise(F.concat(F.lit(", est. "), usd(F.col("total_micro"))))
    return totals.join(costs, "repo_id", "left").select(
        "repo_id", F.when(tokens == 0, F.lit("")).otherwise(F.concat(F.lit(", "), compact_tokens(tokens), F.lit(" tokens"), cost)).alias("suffix")
    )


def compact_receipt(totals: DataFrame, git: DataFrame, profile_rows: DataFrame, signal_rows: DataFrame, names: DataFrame, mode: str = "off") -> DataFrame:
    """A receipt as ``(repo_id, line_no, line)``; ``names``: repo_id, display_name."""
    tokens = F.coalesce("usage.total", F.lit(0))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    shown = F.when(tokens > 0, compact_tokens(tokens)).otherwise(F.lit("—"))
    head = F.array(
        F.col("display_name"),
        say(F.col("sessions"), " sessions · ", F.col("commits"), " commits · ", F.col("archetype")),
        say(F.col("sessions"), " sessions   ", F.col("commits"), " commits   ", shown, f" tokens   {mode}"),
    )
    facts = names.join(totals, "repo_id").join(git, "repo_id").join(profile_rows.select("repo_id", "archetype"), "repo_id")
    top = facts.select("repo_id", F.posexplode(head).alias("line_no", "line"))
    facts_lines = signal_rows.filter(F.col("rank") <= MAX_RECEIPT_SIGNALS).select(
        "repo_id", (F.col("rank") + 2).alias("line_no"), F.concat(F.lit("  "), "headline").alias("line")
    )
    return top.unionByName(facts_lines)
