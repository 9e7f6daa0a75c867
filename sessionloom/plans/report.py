"""Report lines and text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import compact_tokens, iso, usd
from sessionloom.operators.profile import DIMENSIONS


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def report_lines(totals: DataFrame, costs: DataFrame, git: DataFrame, windows: DataFrame, profile_rows: DataFrame, signal_rows: DataFrame, names: DataFrame) -> DataFrame:
    """A Markdown report as ``(repo_id, line_no, line)``; ``names``: repo_id, display_name."""
    tokens = F.coalesce("usage.total", F.lit(0))
    facts = (
        names.join(totals, "repo_id").join(costs, "repo_id", "left").join(git, "repo_id")
        .join(windows.select("repo_id", "window_start", "window_end"), "repo_id").join(profile_rows.select("repo_id", "archetype"), "repo_id")
    )
    head = F.array(
        _say("# ", F.col("display_name")), F.lit(""), F.lit("## Receipt"), F.lit(""), _say("- Repository: ", F.col("display_name")),
        _say("- Window: ", iso(F.col("window_start")), " → ", iso(F.col("window_end"))), _say("- Sessions: ", F.col("sessions")),
        _say("- Active days: ", F.col("active_days")), _say("- Commits: ", F.col("commits")),
        _say("- Tokens: ", F.when(tokens > 0, compact_tokens(tokens)).otherwise(F.lit("not collected"))),
        _say("- Estimated cost: ", usd(F.col("total_micro"))), _say("- Archetype: ", F.col("archetype")), F.lit("- Narrative: off — metrics only"), F.lit(""),
    )
    top = facts.select("repo_id", F.posexplode(head).alias("line_no", "line"))
    title = signal_rows.filter(F.col("rank") == 1).select("repo_id", F.lit(100).alias("line_no"), F.lit("## By the numbers").alias("line"))
    numbers = signal_rows.select("repo_id", (F.col("rank") + 100).alias("line_no"), _say("- **", F.col("headline"), "** — ", F.col("detail")).alias("line"))
    return top.unionByName(title).unionByName(numbers)


def signals_block(signal_rows: DataFrame) -> DataFrame:
    """At most eighteen signals per repository as one text block."""
    line = F.struct("rank", _say("- ", F.col("id"), ": ", F.col("headline"), " (", F.col("detail"), ")").alias("line"))
    return signal_rows.groupBy("repo_id").agg(
        F.concat(F.lit("COMPUTED SIGNALS:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")).alias("block")
    )


def catalog_lines(catalog: DataFrame, git: DataFrame) -> DataFrame:
    """One line per catalogue entry; kept as rows, a repository may have any number."""
    of_git = _say(F.col("ref"), ": ", F.col("commits"), " commits, ", F.col("file_touches"), " file touches")
    of_session = _say(F.col("ref"), ": ", F.col("provider"), ", ended ", iso(F.col("at")), ", ", F.col("turns"), " turns, ", F.col("tool_calls"), " tool calls")
    rows = catalog.join(git.select("repo_id", "commits", "file_touches"), "repo_id")
    return rows.select("repo_id", "ref", F.when(F.col("ref") == "GIT", of_git).otherwise(of_session).alias("line"))


def facts_lines(totals: DataFrame, git: DataFrame, profile_rows: DataFrame) -> DataFrame:
    scores = F.concat_ws(", ", *[_say(f"{d}: ", F.col(d), "/100") for d in DIMENSIONS])
    rows = profile_rows.select("repo_id", "archetype", "rationale", *DIMENSIONS).join(totals.select("repo_id", F.col("sessions").alias("n")), "repo_id").join(git, "repo_id")
    lines = F.array(
        _say("Sessions: ", F.col("n")), _say("Commits: ", F.col("commits"), " (", F.col("insertions"), " insertions, ", F.col("deletions"), " deletions)"),
        _say("Archetype: ", F.col("archetype"), " (", F.col("rationale"), ")"), _say("Profile scores: ", scores),
    )
    return rows.select("repo_id", F.posexplode(lines).alias("line_no", "line"))
