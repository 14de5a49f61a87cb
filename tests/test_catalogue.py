"""Commits over several tables: all or nothing, conflicts, folding, and a batch that is found afterwards."""

import pytest
from pyspark.sql import functions as F

from numberboard.operators.classify import classify
from numberboard.plans.changes import admit_new_plates
from numberboard.plans.publishing import admit_and_publish
from numberboard.sources.catalogue import Catalogue, Conflict
from numberboard.sources.fixtures import derive

SF_DIR = "/root/testdata/sf0.001"


def fronts(spark, *ids):
    return spark.createDataFrame([(i, "x") for i in ids], "special_front_id int, front string")


def held(catalogue, snapshot=None):
    return sorted(r.special_front_id for r in catalogue.table("special_front", snapshot).collect())


def now():
    return F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'")


def test_versions_and_conflicts(spark, tmp_path):
    catalogue = Catalogue(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        catalogue.table("special_front")
    first = catalogue.commit(catalogue.snapshot(), replaced={"special_front": fronts(spark, 1, 2)})
    second = catalogue.commit(first, added={"special_front": fronts(spark, 3)})
    with pytest.raises(Conflict):  # began from the first version too
        catalogue.commit(first, added={"special_front": fronts(spark, 99)})
    assert catalogue.snapshot().version == 2 and held(catalogue) == [1, 2, 3] and held(catalogue, first) == [1, 2]
    catalogue.commit(second, replaced={"special_front": catalogue.table("special_front").where("special_front_id > 1")})
    assert held(catalogue) == [2, 3] and held(catalogue, catalogue.snapshot(2)) == [1, 2, 3]


def test_added_rows_fold(spark, tmp_path):
    catalogue = Catalogue(spark, str(tmp_path), fan=2)
    at = catalogue.commit(catalogue.snapshot(), replaced={"special_front": fronts(spark, 0)})
    for k in range(1, 8):
        at = catalogue.commit(at, added={"special_front": fronts(spark, k)})
        assert held(catalogue) == list(range(k + 1))
        assert len(at.folders["special_front"]) <= 4
    assert held(catalogue, catalogue.snapshot(3)) == [0, 1, 2]


def test_admitted_plates_are_found_in_all_tables(spark, tmp_path):
    views = derive(spark, SF_DIR, "plates", "price_history", "new_plates_batch")
    batch = views["new_plates_batch"]
    catalogue = Catalogue(spark, str(tmp_path))
    tables = {"plates": views["plates"], "price_history": views["price_history"], "plate_patterns": classify(views["plates"])}
    first = catalogue.commit(catalogue.snapshot(), replaced=tables)
    latest, decisions = admit_and_publish(catalogue, batch, now())
    twin = admit_new_plates(batch, views["plates"])
    assert sorted(map(repr, decisions.collect())) == sorted(map(repr, twin.collect()))
    new = {r.plates_id for r in decisions.where("status = 'admitted'").collect()}
    known = {r.plates_id for r in catalogue.table("plates", first).collect()}
    assert {r.plates_id for r in catalogue.table("plates").collect()} == known | new and not known & new
    priced = {r.plates_id for r in catalogue.table("price_history").select("plates_id").collect()}
    assert priced & new == {r.plates_id for r in decisions.where("status = 'admitted' AND NOT is_temporary").collect()}
    members = {(r.plates_id, r.pattern) for r in catalogue.table("plate_patterns").collect()}
    assert members == {(r.plates_id, r.pattern) for r in classify(catalogue.table("plates")).collect()}
    # The same batch again: everything is listed by now. From the old version it conflicts and changes nothing.
    again, refused = admit_and_publish(catalogue, batch, now())
    assert refused.where("status = 'admitted'").isEmpty() and again.version == latest.version + 1
    with pytest.raises(Conflict):
        admit_and_publish(catalogue, batch, now(), first)
    assert catalogue.table("plates").count() == len(known) + len(new)
