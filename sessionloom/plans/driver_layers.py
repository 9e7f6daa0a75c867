"""The middle layer over the driver tables, built once per session and folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sessionloom.session import materialize
from sessionloom.plans.layers import Inputs, Layers
from sessionloom.views import driver

_BUILT: dict[tuple[str, str], Layers] = {}


def layers(spark: SparkSession, sf_dir: str) -> Layers:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        repos = materialize(driver.repositories(spark, sf_dir))
        params = driver.offsets(repos).selectExpr(
            "repo_id", "CAST(NULL AS TIMESTAMP) AS since", "CAST(NULL AS TIMESTAMP) AS until", "utc_offset"
        )
        _BUILT[key] = Layers(
            Inputs(
                repositories=repos,
                counter_records=driver.counter_records(spark, sf_dir),
                response_records=driver.response_records(spark, sf_dir),
                commits=driver.commits(spark, sf_dir),
                file_changes=driver.file_changes(spark, sf_dir),
                params=params,
            )
        )
    return _BUILT[key]


def forget() -> None:
    """Drop every built layer, so that the next query starts from the tables again."""
    while _BUILT:
        _BUILT.popitem()[1].release()
