"""Session settings the jobs rely on. Every one is a public Spark SQL option."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime options: safe to set on a session somebody else has built.
RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot partition of a shuffled join, also where the split costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Lets rebalance() cut a hot output partition (pattern_x may hold a third of all memberships).
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}
# What one task of a catalogue query is handed. A listing's task sorts and aggregates some ten tables side by side, so it
# needs many times the bytes it reads; these sizes, not the input's, set its memory.
TASK_OPTIONS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
}
# So many shuffle partitions to begin with, which adaptive execution joins up to the size above: with Spark's 200 a task's
# share would grow with the input from 1.6 GB of shuffle on.
INITIAL_PARTITIONS = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1000")


def tune(spark: SparkSession, catalogue: bool = True) -> SparkSession:
    """Apply the runtime options to a running session; those of catalogue tasks only for the catalogue."""
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    for key, value in TASK_OPTIONS.items():
        if catalogue:
            spark.conf.set(key, value)
        elif spark.conf.get(key) == value:  # left by a catalogue query of the same session
            spark.conf.unset(key)
    key, value = INITIAL_PARTITIONS
    if catalogue:
        spark.conf.set(key, value)
    elif spark.conf.get(key, "1") == value:
        spark.conf.unset(key)
    return spark


def build_session(master: str | None = None, app: str = "numberboard", **options: str) -> SparkSession:
    """Session for tests and the bench; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_OPTIONS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
