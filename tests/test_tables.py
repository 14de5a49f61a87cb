"""Stored tables: appending, publishing, pruning by pattern, and where files may go."""

import pytest
from pyspark.sql import functions as F

from numberboard.plans import changes as W
from numberboard.plans.changes import rebuild_patterns
from numberboard.sources import tables as TB
from numberboard.sources.fixtures import derive
from numberboard.sources.workspace import workspace

SF_DIR = "/root/testdata/sf0.001"


def fronts(spark, n):
    return spark.range(n).selectExpr("CAST(id AS INT) AS special_front_id", "'x' AS front")


def test_publish_reads_its_own_table(spark, tmp_path):
    root, table = str(tmp_path / "t"), "special_front"
    with pytest.raises(FileNotFoundError):
        TB.current(spark, root, table)
    assert TB.publish(fronts(spark, 10), root) == 1
    assert TB.publish(TB.current(spark, root, table).where("special_front_id >= 4"), root) == 2
    assert TB.current(spark, root, table).count() == 6
    # A version without its log entry is not visible and is replaced by the next attempt.
    fronts(spark, 99).write.parquet(f"{root}/data/v=3")
    assert TB.current(spark, root, table).count() == 6
    assert TB.publish(fronts(spark, 2), root) == 3
    assert TB.current(spark, root, table).count() == 2


def test_admitted_rows_fit_their_tables(spark, tmp_path):
    """Each kind of new row is appended to its declared table and read back."""
    now = F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'")
    views = derive(spark, SF_DIR)
    plates = W.admitted_plates(W.admit_new_plates(views["new_plates_batch"], views["plates"]), now)
    users = W.admitted_users(W.admit_signups(views["signup_batch"], views["users"]), now)
    pairs = W.admitted_plate_hashtags(views["new_plates_hashtag"], views["plates_hashtag"])
    for name, rows in (("plates", plates), ("users", users), ("plates_hashtag", pairs)):
        path = str(tmp_path / name)
        TB.append(views[name], path)
        TB.append(rows, path)
        assert rows.columns == TB.SCHEMAS[name].names
        stored = spark.read.schema(TB.SCHEMAS[name]).parquet(path)
        assert stored.count() == views[name].count() + rows.count() > views[name].count()
        assert stored.select(f"{name}_id").distinct().count() == stored.count()


def test_append_adds_rows(spark, tmp_path):
    path = str(tmp_path / "likes")
    for _ in range(2):
        TB.append(spark.range(3), path)
    assert spark.read.schema("id bigint").parquet(path).count() == 6


def test_only_the_pattern_is_read(spark, tmp_path):
    path = str(tmp_path / "patterns")
    rebuild_patterns(derive(spark, SF_DIR, "plates")["plates"], path)
    members = TB.pattern_members(spark, path, "pattern_xyx")
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pattern" in plan
    assert members.select("pattern").distinct().collect()[0].pattern == "pattern_xyx"
    with pytest.raises(ValueError):
        TB.pattern_members(spark, path, "pattern_nothing")
    # Rebuilding publishes the next version; a reader of the one before keeps it.
    before = TB.current(spark, path, "plate_patterns")
    n = before.count()
    assert rebuild_patterns(derive(spark, SF_DIR, "plates")["plates"], path, F.expr("TIMESTAMP_NTZ '2024-06-01'")) == 2
    after = TB.current(spark, path, "plate_patterns")
    assert before.count() == after.count() == n
    assert [str(r.add_date) for r in after.select("add_date").distinct().collect()] == ["2024-06-01 00:00:00"]


def test_workspace_is_below_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = workspace(spark, "x"), workspace(spark, "x")
    assert first.startswith(f"{shared}/x-") and first != second
