"""Variability collapse: identifier-like segments with several values under one prefix become {id}."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apisight.functions.paths import is_id_like
from apisight.ruleset import ID_PLACEHOLDER, MIN_DISTINCT_VALUES_FOR_VARIABLE
from apisight.session import cut_lineage

#: Levels that are joined on before the paths themselves are written again.
LEVELS = 4


def _with_placeholder(depth: int) -> Column:
    return F.transform("segs", lambda s, i: F.when(i == depth, F.lit(ID_PLACEHOLDER)).otherwise(s))


def collapse_ids(paths: DataFrame) -> DataFrame:
    """paths with segs rewritten: the identifier-like segment at a depth is {id} where its already rewritten prefix has three such values or more.

    paths should be a table (a checkpoint, say), for every level reads it. Depths are walked from the root, for a depth's prefix depends on
    those before. Only depths at which three distinct identifier-like values occur at all are walked, and a path is exploded into such values
    alone, so one of thousands of segments costs no more than its length. Each level is a distinct count per prefix (combined before the
    shuffle), whose few varying prefixes are checkpointed and joined back.
    """
    values = paths.select(F.posexplode(F.transform("segs", lambda s: F.when(is_id_like(s), s))).alias("depth", "value")).where("value is not null")
    depths = [r.depth for r in values.groupBy("depth").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= MIN_DISTINCT_VALUES_FOR_VARIABLE).orderBy("depth").collect()]
    for i, d in enumerate(depths):
        if i and i % LEVELS == 0:
            paths = cut_lineage(paths)
        here = F.col("segs")[d]
        fits = (F.size("segs") > d) & F.coalesce(is_id_like(F.get("segs", F.lit(d))), F.lit(False))
        prefix = F.when(fits, F.array_join(F.slice("segs", 1, d), "/"))
        varying = paths.where(fits).groupBy(prefix.alias("_varies")).agg(F.count_distinct(here).alias("n")).where(F.col("n") >= MIN_DISTINCT_VALUES_FOR_VARIABLE)
        varying = cut_lineage(varying.select("_varies"))
        paths = paths.join(varying, prefix == F.col("_varies"), "left")
        paths = paths.withColumn("segs", F.when(F.col("_varies").isNotNull(), _with_placeholder(d)).otherwise(F.col("segs"))).drop("_varies")
    return paths


@dataclass
class Collapse:
    """A collapse that goes on as paths come: known (segs and now, which is segs collapsed), varying (depth, prefix: its identifier-like values
    are {id}) and values (depth, prefix, value: of the other prefixes, two values at most)."""

    known: DataFrame
    values: DataFrame
    varying: DataFrame

    SCHEMAS = {"known": "segs array<string>, now array<string>", "values": "depth int, prefix string, value string", "varying": "depth int, prefix string"}

    @classmethod
    def empty(cls, spark: SparkSession) -> Collapse:
        return cls(*[spark.createDataFrame([], s) for s in cls.SCHEMAS.values()])

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Collapse:
        return cls(*[spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in cls.SCHEMAS.items()])

    def write(self, folder: str) -> None:
        for name in self.SCHEMAS:
            getattr(self, name).write.parquet(f"{folder}/{name}")


def _prefix(depth: int) -> Column:
    return F.array_join(F.slice("now", 1, depth), "/")


def _fits(depth: int) -> Column:
    return (F.size("segs") > depth) & F.coalesce(is_id_like(F.get("segs", F.lit(depth))), F.lit(False))


def _depths(rows: DataFrame) -> set[int]:
    found = rows.select(F.posexplode(F.transform("segs", is_id_like)).alias("depth", "like")).where("like").select("depth").distinct()
    return {r.depth for r in found.collect()}


def collapse_more(state: Collapse, paths: DataFrame) -> tuple[Collapse, bool]:
    """The collapse with the paths (column segs) as well, which is what collapse_ids() makes of all paths so far; and whether any was new.

    New paths walk down from the root. At a depth their values are added to the few that the prefix has; at three the prefix varies from then
    on, and its values are forgotten. The known paths below such a prefix, and no others, are walked again from there: their prefix has
    changed. What was known of prefixes below the old ones goes.
    """
    fresh = paths.select("segs").distinct().join(state.known.select("segs"), "segs", "left_anti")
    work = cut_lineage(fresh.withColumn("now", F.col("segs")))
    if not work.limit(1).count():
        return state, False
    known, values, varying = state.known, state.values, state.varying
    todo, walked = _depths(work), 0
    while todo:
        d = min(todo)
        todo.discard(d)
        at = F.col("depth") == d
        mine = work.where(_fits(d)).select(F.lit(d).alias("depth"), _prefix(d).alias("prefix"), F.col("segs")[d].alias("value")).distinct()
        mine = cut_lineage(mine.join(varying.where(at), ["depth", "prefix"], "left_anti"))
        both = values.where(at).join(mine.select("depth", "prefix").distinct(), ["depth", "prefix"], "left_semi").union(mine).distinct()
        cross = cut_lineage(both.groupBy("depth", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DISTINCT_VALUES_FOR_VARIABLE).drop("n"))
        if cross.limit(1).count():
            old = values.join(cross, ["depth", "prefix"], "left_semi")
            # the beginnings that no path has any more, by the segments that a deeper prefix starts with
            dead = cut_lineage(old.select(F.when(F.lit(d) == 0, F.col("value")).otherwise(F.concat("prefix", F.lit("/"), "value")).alias("dead")))
            alive = lambda rows: rows.withColumn("dead", F.when(F.col("depth") > d, F.substring_index("prefix", "/", d + 1))).join(dead, "dead", "left_anti").drop("dead")  # noqa: B023, E731
            below = known.where(_fits(d)).withColumn("prefix", _prefix(d)).join(cross.select("prefix"), "prefix", "left_semi")
            again = cut_lineage(below.select("segs", F.concat(F.slice("now", F.lit(1), F.lit(d)), F.slice("segs", F.lit(d + 1), F.size("segs") - d)).alias("now")))
            known = known.join(again.select("segs"), "segs", "left_anti")
            values, varying = alive(values.join(cross, ["depth", "prefix"], "left_anti")), alive(varying).union(cross)
            todo |= {x for x in _depths(again) if x > d}
            work = work.union(again)
        values = cut_lineage(values.union(mine.join(cross, ["depth", "prefix"], "left_anti")).distinct())
        varying = cut_lineage(varying)
        here = varying.where(at).select(F.col("prefix").alias("_varies"))
        work = work.join(here, F.when(_fits(d), _prefix(d)) == F.col("_varies"), "left")
        work = cut_lineage(work.select("segs", F.when(F.col("_varies").isNotNull(), F.transform("now", lambda s, i: F.when(i == d, F.lit(ID_PLACEHOLDER)).otherwise(s))).otherwise(F.col("now")).alias("now")))  # noqa: B023
        walked += 1
    return Collapse(known.union(work), values, varying), True
