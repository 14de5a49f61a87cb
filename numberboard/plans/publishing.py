"""Batches whose effects on several tables become visible together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..sources.catalogue import Catalogue, Snapshot
from ..sources.workspace import workspace
from .changes import admit_new_plates, admitted_plates, new_plate_patterns, new_plate_prices

MARKET = ("plates", "price_history", "plate_patterns")


def admit_and_publish(catalogue: Catalogue, batch: DataFrame, now: Column, since: Snapshot | None = None) -> tuple[Snapshot, DataFrame]:
    """Admit new plates and commit them with their first prices and their pattern memberships.

    Returns the new version and the decision on every request. Decisions are written once, so the three
    tables get the same ids. Only the new rows are classified and written. If another commit came in between, ``Conflict`` is raised and
    nothing has changed: ids and identities may be taken now, so the batch has to be decided again.
    """
    since = since or catalogue.snapshot()
    spark = catalogue.spark
    decisions = admit_new_plates(batch, catalogue.table("plates", since))
    path = workspace(spark, "decisions")
    decisions.write.parquet(path)
    decisions = spark.read.schema(decisions.schema).parquet(path)
    added = {
        "plates": admitted_plates(decisions, now),
        "price_history": new_plate_prices(decisions, catalogue.table("price_history", since), now),
        "plate_patterns": new_plate_patterns(decisions, now),
    }
    return catalogue.commit(since, added=added), decisions
