"""Matching observed endpoints with declared ones, segment by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisight.functions.paths import declared_segments, observed_segments, shape_key
from apisight.session import cut_lineage

#: Keys of a trie's edges besides those of literals: a declared variable, and any edge.
WILD, ANY = "*", "?"
#: Edges of a trie that are broadcast (some 50 bytes each); levels that are walked before the rows are checkpointed.
BROADCAST_EDGES, LEVELS = 500_000, 8


def _typed(observed: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    o = observed.select("id", "path_pattern", "methods", observed_segments(F.col("path_pattern")).alias("o"))
    d = declared.select(F.col("path_pattern").alias("declared_path"), F.col("methods").alias("declared_methods"), declared_segments(F.col("path_pattern")).alias("d"))
    return o, d


def _conflict(o: Column, d: Column) -> Column:
    return F.exists(F.zip_with(o, d, lambda x, y: F.coalesce(x != y, F.lit(False))), lambda x: x)


def distance(o: Column, d: Column) -> Column:
    """(mismatches, how far from the end the first one is): smaller is nearer."""
    n, m = F.size(o), F.size(d)
    both = F.least(n, m)
    # zip_with pads the shorter with null; only positions of both count here
    differs = F.transform(F.zip_with(F.slice(o, 1, both), F.slice(d, 1, both), lambda x, y: ~x.eqNullSafe(y)), lambda x: x.cast("int"))
    first = F.array_position(differs, 1)
    longer = F.greatest(n - m, F.lit(0))
    return F.struct((F.aggregate(differs, F.lit(0), lambda a, x: a + x) + longer).alias("mismatches"), F.when(first > 0, n - first.cast("int") + 1).otherwise(F.lit(0)).alias("tail"))


def divergence(o: Column, d: Column) -> Column:
    both = F.least(F.size(o), F.size(d))
    pairs = lambda f: F.exists(F.zip_with(F.slice(o, 1, both), F.slice(d, 1, both), f), lambda x: x)
    fixed = pairs(lambda x, y: x.isNotNull() & y.isNull())
    variable = pairs(lambda x, y: x.isNull() & y.isNotNull())
    return F.when(fixed & variable, "both").when(fixed, "observed_fixed").when(variable, "observed_variable").otherwise("no_line_up")


def exact_matches(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Pairs that agree in every segment: an equi-join on the shape."""
    o, d = _typed(observed, declared)
    return o.withColumn("k", shape_key(F.col("o"))).join(d.withColumn("kd", shape_key(F.col("d"))), F.col("k") == F.col("kd")).drop("k", "kd")


def _edge_keys(segments: Column) -> Column:
    return F.transform(segments, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit(WILD)))


def declared_trie(declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The declared paths as a trie of segments, in two tables.

    Edges: node, key, child, ends (a path ends at the child), goes_on (a path goes on there). A literal's key is `=` and the literal, a
    variable's WILD; every edge has a second row under ANY, for observed variables. Ends: node and the declared columns of the path that ends
    there. A node is a hash of the keys from the root: two that fall together would let more pairs through to the exact conditions.
    """
    rows = declared.withColumn("k", _edge_keys(F.col("d")))
    ends = rows.select(F.xxhash64("k").alias("end_node"), "declared_path", "declared_methods", "d")
    steps = rows.where(F.size("k") > 0).select("k", F.explode(F.sequence(F.lit(1), F.size("k"))).alias("i"))
    steps = steps.select(F.xxhash64(F.slice("k", F.lit(1), F.col("i") - 1)).alias("node"), F.expr("k[i - 1]").alias("key"), F.xxhash64(F.slice("k", F.lit(1), F.col("i"))).alias("child"), (F.col("i") == F.size("k")).alias("last"))
    edges = steps.groupBy("node", "key", "child").agg(F.max("last").alias("ends"), F.max(~F.col("last")).alias("goes_on"))
    edges = edges.withColumn("open", F.col("key") == WILD)
    return cut_lineage(edges.union(edges.withColumn("key", F.lit(ANY)))), ends


def _walk(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Pairs whose shapes may agree as far as the declared path goes: id, path_pattern, methods, o and the declared columns.

    Each observed path walks down the trie one level at a time, by an equi-join on (node, key): a literal takes its own edge and the variable
    one, a variable takes all. What has reached the end of a declared path (of the same length, or one whose last segment is variable) stays as
    it is, under a key of its own that no edge has. The trie is broadcast where it is small, and joined by a shuffle where not.
    """
    o, d = _typed(observed, declared)
    edges, ends = declared_trie(d)
    # two rows for each segment at most
    depth, segments = ends.agg(F.coalesce(F.max(F.size("d")), F.lit(0)), F.coalesce(F.sum(F.size("d")), F.lit(0))).first()
    small = 2 * segments <= BROADCAST_EDGES
    sized = lambda table: F.broadcast(table) if small else table
    walk = o.withColumns({"node": F.xxhash64(F.array().cast("array<string>")), "done": F.lit(False)})
    columns = o.columns
    for level in range(depth):
        if level and level % LEVELS == 0:
            walk = cut_lineage(walk)
        segment = F.get("o", F.lit(level))
        taken = F.when(F.col("done"), F.array(F.concat(F.lit("!"), "id"))).when(F.size("o") <= level, F.array().cast("array<string>"))
        taken = taken.when(segment.isNull(), F.array(F.lit(ANY))).otherwise(F.array(F.concat(F.lit("="), segment), F.lit(WILD)))
        steps = walk.withColumn("step", F.explode(taken))
        met = steps.join(sized(edges.withColumnsRenamed({"node": "from_node", "key": "from_key"})), (F.col("node") == F.col("from_node")) & (F.col("step") == F.col("from_key")), "left")
        exact, longer = F.size("o") == level + 1, F.size("o") > level + 1
        state = lambda node, done: F.struct(F.col(node).alias("node"), F.lit(done).alias("done"))
        states = F.array(
            F.when(F.col("done"), state("node", True)),
            F.when(F.col("ends") & (exact | (longer & F.col("open"))), state("child", True)),
            F.when(F.col("goes_on") & longer, state("child", False)),
        )
        walk = met.select(*columns, F.explode(F.array_compact(states)).alias("s")).select(*columns, "s.node", "s.done")
    return walk.where("done").join(sized(ends), F.col("node") == F.col("end_node")).drop("node", "done", "end_node")


def _agree_partly() -> Column:
    """Of one length, no two different literals at a place, and not the same shape."""
    return (F.size("o") == F.size("d")) & ~_conflict(F.col("o"), F.col("d")) & (shape_key(F.col("o")) != shape_key(F.col("d")))


def _spans() -> Column:
    """The observed path is longer, the declared one ends with a variable, and nothing before that contradicts."""
    m = F.size("d")
    open_ = (m > 0) & F.element_at("d", F.when(m > 0, m).otherwise(F.lit(1))).isNull()
    head = lambda c: F.slice(c, F.lit(1), F.greatest(m - 1, F.lit(0)))
    return open_ & (F.size("o") > m) & ~_conflict(head("o"), head("d"))


def partial_matches(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Pairs of one length without two different literals that diverge somewhere."""
    return _walk(observed, declared).where(_agree_partly()).withColumn("spans", F.lit(None).cast("int"))


def spanning_matches(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Pairs where the declared path would fit if its last segment, a variable one, spanned several."""
    return _walk(observed, declared).where(_spans()).withColumn("spans", F.size("o") - F.size("d") + 1)


def candidates(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Partial and spanning pairs with their distance, from one walk."""
    pairs = _walk(observed, declared).where(_agree_partly() | _spans())
    pairs = pairs.withColumn("spans", F.when(F.size("o") > F.size("d"), F.size("o") - F.size("d") + 1))
    return pairs.withColumn("distance", distance(F.col("o"), F.col("d"))).withColumn("divergence", divergence(F.col("o"), F.col("d")))


def nearest(pairs: DataFrame) -> DataFrame:
    """For each observed id its nearest candidate (ties: the lesser declared path), how many are as near, and all candidates' methods.

    Candidates meet by id and distance first, with a count and a least one; a row holds no more than the sets of methods that occur.
    """
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    near = pairs.groupBy("id", "distance").agg(F.min(F.struct("declared_path", "spans", "divergence")).alias("least"), F.count(F.lit(1)).alias("n"), every("declared_methods").alias("m"))
    best = near.groupBy("id").agg(F.min(F.struct("distance", "least", "n")).alias("b"), every("m").alias("candidate_methods"))
    return best.select("id", F.col("b.least.declared_path").alias("declared_path"), F.col("b.distance").alias("distance"), F.col("b.least.spans").alias("spans"), F.col("b.least.divergence").alias("divergence"), (F.col("b.n") - 1).cast("int").alias("ties"), "candidate_methods")


def declared_unseen(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared rows that no observed endpoint matches exactly."""
    seen = exact_matches(observed, declared).select(F.col("declared_path").alias("seen")).distinct()
    return declared.join(seen, F.col("path_pattern") == F.col("seen"), "left_anti")
