"""Which repositories a working directory belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import digest, trim_all
from sessionloom.session import materialize


def path_parts(path: Column) -> Column:
    """Segments of an absolute path after resolving ``.`` and ``..``; null if relative."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.concat(done, F.array(s))
        ),
    )
    return F.when(path.startswith("/"), resolved)


def normal_path(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(path_parts(path), "/"))


def scope_directories(directories: DataFrame, repositories: DataFrame, column: str = "cwd_now") -> DataFrame:
    """``(column, repo_id, fingerprint, relation)`` for every enclosing repository.

    Each distinct directory is exploded into itself and its ancestors and matched
    by an equi-join; nested repositories legitimately match more than once. The
    result is stored: several joins read it, and its size is known to them, so that
    many records are not moved to meet a few directories.
    """
    parts = path_parts(F.col(column))
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size("_parts")),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice("_parts", F.lit(1), n), "/")),
    )
    exploded = (
        directories.select(column)
        .filter(F.col(column).isNotNull())
        .distinct()
        .withColumn("_parts", parts)
        .filter(F.col("_parts").isNotNull())
        .select(column, normal_path(F.col(column)).alias("_self"), F.explode(ancestors).alias("_root"))
    )
    roots = repositories.select("repo_id", "fingerprint", normal_path(F.col("root")).alias("_root"))
    scope = exploded.join(roots, "_root").select(
        column, "repo_id", "fingerprint",
        F.when(F.col("_self") == F.col("_root"), F.lit("repository-root")).otherwise(F.lit("subdirectory")).alias("relation"),
    )
    return materialize(scope)


# Fixed values: ``[user@]host:path``, and a drive path, which is local. A URL fits
# the first form too, its scheme standing where the host would be.
_REMOTE = r"^(?:[^@/\s]+@)?([^:/\s]+):(.+)$"
_DRIVE = r"^[A-Za-z]:[\\/]"


def remote_identity(df: DataFrame, remote: str, local_path: Column) -> DataFrame:
    """Canonical host/path of a remote, the fingerprint it gives and on what basis."""
    url = trim_all(F.col(remote))
    known_form = url.rlike(_REMOTE) & ~url.rlike(_DRIVE)
    path = F.regexp_extract(url, _REMOTE, 2)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^/+", ""), "/+$", ""), r"(?i)\.git$", "")
    known = df.withColumns(
        {"host": F.when(known_form, F.lower(F.regexp_extract(url, _REMOTE, 1))), "path": F.when(known_form, bare)}
    )
    has_remote = F.col("host").isNotNull()
    return known.withColumns(
        {
            "fingerprint": digest(F.when(has_remote, F.concat_ws("/", "host", "path")).otherwise(local_path)),
            "fingerprint_basis": F.when(has_remote, F.lit("canonical-remote")).otherwise(F.lit("local-path")),
            "path_hash": F.when(has_remote, digest(F.col("path"))),
        }
    )
