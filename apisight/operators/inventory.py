"""Observed and declared inventories of endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisight.functions.paths import canonical_segments, endpoint_id, join_segments
from apisight.operators.normalize import collapse_ids
from apisight.session import cut_lineage


def observations() -> list[Column]:
    """Aggregates of requests (method, auth, ts) that merge_observations() adds up."""
    state = F.col("auth.state")
    return [
        F.collect_set("method").alias("methods"),
        F.count(F.lit(1)).alias("observations"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count_if(state != "NotObservable").alias("auth_observable"),
        F.count_if(state == "Present").alias("auth_present"),
    ]


def path_observations(requests: DataFrame) -> DataFrame:
    """One mergeable row per raw path: methods, observations, first_seen, last_seen, auth_observable, auth_present.

    requests: method, raw_path, auth, ts. Partial sums per raw path come before the shuffle; canonical forms are made from distinct raw paths.
    """
    return requests.groupBy("raw_path").agg(*observations())


def merge_observations(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("methods")))).alias("methods"),
        F.sum("observations").alias("observations"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("auth_observable").alias("auth_observable"),
        F.sum("auth_present").alias("auth_present"),
    )


def auth_verdict(observable: Column, present: Column) -> Column:
    return F.when(observable == 0, "NotObservable").when(present == observable, "Yes").when(present == 0, "No").otherwise("Mixed")


def inventory_from(observations: DataFrame) -> DataFrame:
    """Endpoints from path_observations() rows, of one log or of several together."""
    segs = observations.withColumn("segs", canonical_segments(F.col("raw_path"))).drop("raw_path")
    # equal canonical paths meet before the levels are walked; the log is read once, for this table
    paths = cut_lineage(merge_observations(segs, "segs"))
    return endpoints_of(collapse_ids(paths))


def endpoints_of(found: DataFrame) -> DataFrame:
    """Endpoints from rows with collapsed segs."""
    merged = merge_observations(found.withColumn("path_pattern", join_segments(F.col("segs"))), "path_pattern")
    return merged.select(
        endpoint_id(F.col("path_pattern")).alias("id"),
        "path_pattern",
        "methods",
        "first_seen",
        "last_seen",
        F.col("observations").alias("observation_count"),
        auth_verdict(F.col("auth_observable"), F.col("auth_present")).alias("auth_observed"),
        F.col("auth_observable").alias("auth_observable_count"),
    )


def observed_inventory(requests: DataFrame) -> DataFrame:
    return inventory_from(path_observations(requests))


def merge_declared(declared: DataFrame) -> DataFrame:
    """Rows of one path pattern with the union of their methods and schemes."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return declared.groupBy("path_pattern").agg(union("methods"), union("declared_auth_schemes"))
