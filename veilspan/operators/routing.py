"""Routing: from query codes to candidate ids with a score, over the index tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.vectors import hamming

_TD = ["table", "division"]


#: Children of a node in the search for a block; a query meets so many rows of one order at once.
FAN = 1024


def _first_reaching(asked: DataFrame, nodes: DataFrame, n_blocks: int, fan: int) -> DataFrame:
    """q_id, table, division, x, at: the first block whose largest key is x or more.

    A tree over the blocks, which are sorted by key: each level holds the largest key of ``fan`` nodes below, and a
    query goes down one level a step, so it meets ``fan`` rows a level however many blocks there are.
    """
    height = 1
    while fan**height < n_blocks:
        height += 1
    found = asked.withColumn("at", F.lit(0).cast("bigint"))
    for level in range(height - 1, -1, -1):
        step = fan**level
        own = nodes.groupBy(*_TD, F.floor(F.col("part_idx") / step).alias("node")).agg(F.max("max_key").alias("reach"))
        own = own.withColumn("at", F.floor(F.col("node") / fan))
        down = found.join(own, [*_TD, "at"]).where("reach >= x")
        found = down.groupBy("q_id", *_TD, "x").agg(F.min("node").alias("at"))
    return found


def nearest_blocks(tokens: DataFrame, partitions: DataFrame, fan: int = FAN) -> DataFrame:
    """q_id, table, division, center: the block whose key range holds or is nearest to the query's key.

    Of equally near ranges the one with the lower index wins. The blocks of an order are sorted by key, so the
    first that reaches the key and the one before it are all that can win. No more than ``fan`` blocks for a query are
    compared at once: with more blocks in an order they are searched as a tree.
    """
    asked = tokens.select("q_id", *_TD, F.col("key").alias("x"))
    slim = partitions.select(*_TD, "part_idx", "min_key", "max_key")
    ends = slim.groupBy(*_TD).agg(F.max("part_idx").alias("last"))
    n_blocks = (ends.agg(F.max("last")).first()[0] or 0) + 1
    if n_blocks <= fan:
        both = slim.join(asked, _TD)
        far = F.greatest(F.col("min_key") - F.col("x"), F.col("x") - F.col("max_key"), F.lit(0).cast("bigint"))
        best = both.groupBy("q_id", *_TD).agg(F.min(F.struct(far.alias("range_dist"), "part_idx")).alias("b"))
        return best.select("q_id", *_TD, F.col("b.part_idx").alias("center"), F.col("b.range_dist").alias("range_dist"))
    top = F.lit(2**63 - 1)
    wall = ends.select(*_TD, (F.col("last") + 1).alias("part_idx"), F.lit(None).cast("bigint").alias("min_key"), top.alias("max_key"))
    nodes = slim.unionByName(wall)  # one block beyond the last, which reaches every key
    first = slim.groupBy(*_TD, "max_key").agg(F.min("part_idx").alias("before"))
    before = slim.select(*_TD, (F.col("part_idx") + 1).alias("part_idx"), "max_key").join(first, [*_TD, "max_key"])
    sides = nodes.select(*_TD, F.col("part_idx").alias("at"), "min_key").join(before.select(*_TD, F.col("part_idx").alias("at"), F.col("max_key").alias("low_key"), "before"), [*_TD, "at"], "left")
    found = _first_reaching(asked, nodes, n_blocks + 1, fan).join(sides, [*_TD, "at"])
    up = F.when(F.col("min_key").isNotNull(), F.greatest(F.col("min_key") - F.col("x"), F.lit(0).cast("bigint")))
    down = F.col("x") - F.col("low_key")
    found = found.withColumn("up", up).withColumn("down", down)
    lower = F.col("up").isNull() | (F.col("down") <= F.col("up")) & (F.col("up") > 0)
    lower = F.coalesce(lower, F.lit(False))
    return found.select("q_id", *_TD, F.when(lower, F.col("before")).otherwise(F.col("at")).alias("center"), F.when(lower, F.col("down")).otherwise(F.col("up")).alias("range_dist"))


def probe_order(tokens: DataFrame, partitions: DataFrame, probes: int | str) -> DataFrame:
    """q_id, table, division, part_idx, hamming, probe_rank: the probed run of blocks in order.

    Growing from the centre to the neighbour of lower Hamming distance visits blocks by the largest distance
    on the way to them, left side first among equals: a running maximum, no loop. probes may be a column
    of tokens. Blocks are found by equality on their index, not by a range condition.
    """
    probes_col = F.col(probes) if isinstance(probes, str) else F.lit(probes)
    center = nearest_blocks(tokens, partitions)
    asked = tokens.select("q_id", *_TD, F.col("code").alias("q_code"), probes_col.cast("bigint").alias("probes"))
    spread = center.join(asked, ["q_id", *_TD])
    spread = spread.withColumn("part_idx", F.explode(F.sequence(F.greatest(F.col("center") - F.col("probes") + 1, F.lit(0).cast("bigint")), F.col("center") + F.col("probes") - 1)))
    near = spread.join(partitions.select(*_TD, "part_idx", "rep_code"), [*_TD, "part_idx"])
    near = near.withColumn("hamming", hamming(F.col("q_code"), F.col("rep_code"))).withColumn("side", F.signum(F.col("part_idx") - F.col("center")).cast("int"))
    dist = F.abs(F.col("part_idx") - F.col("center"))
    key = ["q_id", *_TD]
    on_way = F.max("hamming").over(Window.partitionBy(*key, "side").orderBy(dist).rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_way", F.when(F.col("side") == 0, F.lit(-1).cast("bigint")).otherwise(on_way)).withColumn("_dist", dist)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_way", "side", "_dist"))
    return near.withColumn("probe_rank", rank).where(F.col("probe_rank") <= F.col("probes")).select(*key, "part_idx", "hamming", "probe_rank")


def sightings(probed: DataFrame, membership: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """One row for each probed block and id in it: q_id, vec_id, hamming, and the probe's place."""
    seen = probed.join(membership, [*_TD, "part_idx"]).select("q_id", "vec_id", "hamming", *_TD, "probe_rank")
    return seen if deleted is None else seen.join(deleted.select("vec_id"), "vec_id", "left_anti").select("q_id", "vec_id", "hamming", *_TD, "probe_rank")


def candidates(seen: DataFrame) -> DataFrame:
    """q_id, vec_id, hamming: the least distance over all probed blocks."""
    return seen.groupBy("q_id", "vec_id").agg(F.min("hamming").alias("hamming"))


def capped(seen: DataFrame, cap: int) -> DataFrame:
    """Sightings of the probes before which fewer than cap distinct ids were seen, in probe order."""
    place = [*_TD, "probe_rank"]
    first = seen.withColumn("_first", F.row_number().over(Window.partitionBy("q_id", "vec_id").orderBy(*place)) == 1)
    new = first.groupBy("q_id", *place).agg(F.count_if("_first").alias("_new"))
    before = F.coalesce(F.sum("_new").over(Window.partitionBy("q_id").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keep = new.withColumn("_before", before).where(F.col("_before") < cap).select("q_id", *place)
    return seen.join(keep, ["q_id", *place], "left_semi")


def raw_seen(seen: DataFrame) -> DataFrame:
    """q_id, raw_seen: sightings that were new or better than all before."""
    order = Window.partitionBy("q_id", "vec_id").orderBy(*_TD, "probe_rank").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("hamming").over(order)
    marked = seen.withColumn("_new", best.isNull() | (F.col("hamming") < best))
    return marked.groupBy("q_id").agg(F.count_if("_new").alias("raw_seen"))


def prefiltered(found: DataFrame, limit: int, threshold: int = 0) -> DataFrame:
    """The first ``limit`` candidates by (hamming, id), with their rank and whether they are under the threshold."""
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("hamming", "vec_id"))
    out = found.withColumn("cand_rank", rank).where(F.col("cand_rank") <= limit)
    return out.withColumn("under", (F.lit(threshold) <= 0) | (F.col("hamming") <= threshold))
