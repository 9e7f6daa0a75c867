"""Aggregates over commit history, working-tree status and attribution tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.numbers import MAX_SAFE_INTEGER, clamp_safe
from sessionloom.functions.redaction import compose
from sessionloom.functions.text import blank_to_null, clean_identifier, trim_all

# Two-letter status codes of unmerged paths.
CONFLICTS = ["DD", "AU", "UD", "UA", "DU", "AA", "UU"]


def git_metrics(commits: DataFrame, changes: DataFrame, windows: DataFrame) -> DataFrame:
    """Commits, merges, contributors, file touches and lines inside each window.

    Changes are summed per commit before they meet the commits, so the join moves
    one row per commit.
    """
    bounds = windows.filter("valid").select("repo_id", "window_start", "window_end")
    inside = commits.join(bounds, "repo_id").filter(F.col("ts").between(F.col("window_start"), F.col("window_end")))
    per_commit = changes.groupBy("commit_id").agg(
        F.count(F.lit(1)).alias("touches"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions")
    )
    author = blank_to_null(F.lower(trim_all(F.col("author"))))
    measured = (
        inside.join(per_commit, "commit_id", "left")
        .groupBy("repo_id")
        .agg(
            F.count(F.lit(1)).alias("commits"),
            F.count(F.when(F.col("is_merge"), F.lit(1))).alias("merge_commits"),
            F.countDistinct(F.sha2(author, 256)).alias("contributors"),
            *[clamp_safe(F.coalesce(F.sum(c), F.lit(0))).alias(n) for c, n in (("touches", "file_touches"), ("insertions", "insertions"), ("deletions", "deletions"))],
        )
    )
    zeros = {c: 0 for c in ("commits", "merge_commits", "contributors", "file_touches", "insertions", "deletions")}
    return bounds.select("repo_id").join(measured, "repo_id", "left").na.fill(zeros)


def status_counts(entries: DataFrame) -> DataFrame:
    """Working-tree counts per repository; a conflict also counts as staged and modified."""
    code = F.col("code")
    plain = ~code.isin("??", "!!")
    n = lambda condition: F.count(F.when(condition, F.lit(1)))
    counted = entries.groupBy("repo_id").agg(
        n(plain & (F.left(code, F.lit(1)) != " ")).alias("staged"),
        n(plain & (F.substring(code, 2, 1) != " ")).alias("modified"),
        n(code == "??").alias("untracked"),
        n(code.isin(*CONFLICTS)).alias("conflicted"),
    )
    return counted.withColumn(
        "is_dirty", (F.col("staged") + F.col("modified") + F.col("untracked") + F.col("conflicted")) > 0
    )


_ATTRIBUTION = (
    "struct<human_additions:string,ai_additions:string,ai_accepted:string,"
    "tool_model_breakdown:map<string,struct<ai_additions:string,ai_accepted:string>>>"
)


def _whole(value):
    number = F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*\+?(\d{1,16})", 1)
    parsed = number.try_cast("long")
    return F.when(parsed <= MAX_SAFE_INTEGER, parsed).otherwise(F.lit(0)).cast("long")


def attribution(stats: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Totals per repository, and rows per tool and model (key split at the first slash)."""
    parsed = stats.select("repo_id", F.from_json(column, _ATTRIBUTION).alias("j")).filter(F.col("j").isNotNull())
    totals = parsed.select(
        "repo_id", _whole(F.col("j.human_additions")).alias("human_additions"),
        _whole(F.col("j.ai_additions")).alias("ai_additions"), _whole(F.col("j.ai_accepted")).alias("ai_accepted"),
    )
    rows = parsed.select("repo_id", F.explode("j.tool_model_breakdown").alias("key", "v"))
    cut = F.locate("/", F.col("key"))
    tool = F.when(cut > 0, F.left("key", cut - 1)).otherwise(F.col("key"))
    model = F.when(cut > 0, F.substr("key", cut + 1)).otherwise(F.lit("unknown"))
    return totals, rows.select(
        "repo_id", clean_identifier(compose(tool), 80).alias("tool"), clean_identifier(compose(model), 120).alias("model"),
        _whole(F.col("v.ai_additions")).alias("ai_additions"), _whole(F.col("v.ai_accepted")).alias("ai_accepted"),
    )


def head_times(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo_id").agg(F.max("ts").alias("head_at"))
