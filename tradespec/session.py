"""Session settings the package is designed for.

They are plain Spark settings; a cluster normally sets them in its own
defaults and no operator depends on them being set here.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE picks broadcast joins from measured sizes, merges small shuffle
# partitions and splits skewed ones. With merging on, the initial partition
# count can be generous.
SCALE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    # The reports have many small stages; by default only 100 compiled ones are
    # kept and a session that alternates between reports compiles them anew.
    "spark.sql.codegen.cache.maxEntries": "2000",
}


def build_session(
    app_name: str,
    master: str | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """Session with :data:`SCALE_SETTINGS`; ``settings`` win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SCALE_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
