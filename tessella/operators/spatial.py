"""Adjacency from shared vertices and spatial autocorrelation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessella.functions.lineage import Tables
from tessella.functions.stats import ratio


def _incidences(starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the members of the vertices ``at`` lie, one vertex after the other, and for each of them its place in ``at``."""
    size = sizes[at]
    ends = np.cumsum(size)
    return np.repeat(starts[at] - (ends - size), size) + np.arange(size.sum()), np.repeat(np.arange(len(at)), size)


def _tops(vertex: np.ndarray, entity: np.ndarray, n: int, width: int) -> np.ndarray:
    """Each of ``n`` entities' vertices, at most ``width``; -1 where it has fewer."""
    order = np.argsort(entity, kind="stable")
    out, entity = np.full((n, width), -1), entity[order]
    out[entity, np.arange(len(entity)) - np.searchsorted(entity, entity)] = vertex[order]
    return out


def _met(least: int, cells: int = 1 << 20) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that gives the adjacent entities of two blocks (or of one with itself) from their lists of members.

    Vertices that are among the ``least - 1`` most common ones of neither entity are counted, for as many sources at a
    time as make about ``cells`` pairs or twice as many incidences; the others are looked up for the pairs so found.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        same = key[0].as_py() == key[1].as_py()

        def side(first: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
            own = rows.filter(pc.equal(rows["first"], first))
            lists = own.filter(pc.is_valid(own["id"])).sort_by("id").combine_chunks()
            code = pc.list_flatten(lists["m"]).to_numpy().astype(np.int64)
            return pc.list_flatten(own.filter(pc.is_null(own["id"]))["names"]).combine_chunks(), lists["id"].to_numpy(), pc.list_value_length(lists["m"]).to_numpy(), code

        (a_names, a_ids, a_sizes, a_code), (b_names, b_ids, b_sizes, b_code) = x = (side(True), side(True) if same else side(False))
        n = len(b_names)
        shared, *at = np.intersect1d(a_ids, b_ids, assume_unique=True, return_indices=True)
        members = []
        for (_, ids, sizes, code), places in zip(x, at, strict=True):
            number = np.full(len(ids), -1)
            number[places] = np.arange(len(shared))
            vertex = np.repeat(number, sizes)
            members.append((vertex[vertex >= 0], code[vertex >= 0] >> 1, code[vertex >= 0] & 1 == 1))
        (a_vertex, a_entity, a_top), (b_vertex, b_entity, b_top) = members
        all_sizes, rare_sizes = np.bincount(b_vertex, minlength=len(shared)), np.bincount(b_vertex[~b_top], minlength=len(shared))
        all_starts, rare_starts, b_rare = np.cumsum(all_sizes) - all_sizes, np.cumsum(rare_sizes) - rare_sizes, b_entity[~b_top]
        a_tops, b_tops = _tops(a_vertex[a_top], a_entity[a_top], len(a_names), least - 1), _tops(b_vertex[b_top], b_entity[b_top], n, least - 1)
        kinds, b_kind = np.unique(b_tops, return_inverse=True)
        b_kind = b_kind.reshape(b_tops.shape)
        kind = np.full(len(shared), -1)
        kind[kinds[kinds >= 0]] = np.nonzero(kinds >= 0)[0]
        order = np.argsort(a_entity[~a_top], kind="stable")
        a_entity, a_vertex = a_entity[~a_top][order], a_vertex[~a_top][order]
        sources, first = np.unique(a_entity, return_index=True)
        first = np.append(first, len(a_entity))
        work = np.append(0, np.cumsum(rare_sizes[a_vertex]))[first]
        begin = 0
        while begin < len(sources):
            end = max(begin + 1, min(begin + max(1, cells // max(n, 1)), int(np.searchsorted(work, work[begin] + 2 * cells, "right")) - 1))
            own, vertex = sources[begin:end], a_vertex[first[begin] : first[end]]
            source = np.repeat(np.arange(end - begin), np.diff(first[begin : end + 1]))
            begin = end
            places, of = _incidences(rare_starts, rare_sizes, vertex)
            pair = source[of] * n + b_rare[places]
            if 8 * len(pair) > len(own) * n:
                count = np.bincount(pair, minlength=len(own) * n)
                pair = np.flatnonzero(count)
                count = count[pair]
            else:
                pair, count = np.unique(pair, return_counts=True)
            if same:
                later = pair % n > own[pair // n]
                pair, count = pair[later], count[later]
            open_ = np.flatnonzero(count < least)
            if len(open_):
                s, d = np.divmod(pair[open_], n)
                tops, top = np.unique(a_tops[own], return_inverse=True)
                top = top.reshape(len(own), least - 1)
                held = np.zeros((len(tops), n), dtype=bool)  # which entities have each of the sources' most common vertices
                known = np.flatnonzero(tops >= 0)
                places, of = _incidences(all_starts, all_sizes, tops[known])
                held[known[of], b_entity[places]] = True
                has = np.zeros((len(own), len(kinds)), dtype=bool)  # which sources count each of the entities' most common vertices
                has[source[kind[vertex] >= 0], kind[vertex][kind[vertex] >= 0]] = True
                for k in range(least - 1):
                    count[open_] += held[top[s, k], d]
                    count[open_] += has[s, b_kind[d, k]]
            s, d = np.divmod(pair[count >= least], n)
            if len(s):
                src, dst = a_names.take(pa.array(own[s])), b_names.take(pa.array(d))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([src, dst]), pa.concat_arrays([dst, src])], ["src", "dst"])

    return run


def build_adjacency(vertices: DataFrame, least: int = 2, block: int = 4096) -> DataFrame:
    """(src, dst) in both directions of entities that share at least ``least`` of their distinct vertices (entity, vertex).

    Two entities that share so many also share one when each leaves out its ``least - 1`` most common ones, so those
    bring no pairs together: a vertex that all entities have is never paired. Entities are dealt into blocks of about
    ``block`` (8192 at most, fewer where they have many vertices), and a task gets two blocks' members of the vertices
    that both have, counts and hands on its pairs as it finds them. So pairs are never shuffled, only members, at most
    once for each block. Null entities and vertices are left out.
    """
    tables = Tables(vertices.sparkSession)
    rows = tables.put(vertices.where("entity is not null and vertex is not null").select("entity", "vertex").distinct())
    sizes = tables.put(rows.groupBy("vertex").agg(F.count("*").alias("k")).where("k > 1").withColumn("id", F.monotonically_increasing_id()))
    lists = tables.put(rows.join(sizes, "vertex").groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("k", "id")))["id"].alias("v")).where(F.size("v") >= least))
    tables.drop(rows, sizes)
    block = min(block, 8192)
    n, total = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-total // (256 * block)))
    number = F.row_number().over(Window.partitionBy("block").orderBy("entity")) - 1
    numbered = lists.withColumn("block", F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int")).withColumn("number", number)
    # a member is twice its number in the block, and one more if the vertex is among its most common ones
    member = (2 * F.col("number") + (F.col("at") >= F.size("v") - (least - 1)).cast("int")).cast("short")
    found = numbered.select("block", "number", "v", F.posexplode("v").alias("at", "id")).groupBy("block", "id").agg(F.sort_array(F.collect_list(member)).alias("m"))
    found = tables.put(found)
    names = tables.put(numbered.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("number", "entity")))["entity"].alias("names")))
    tables.drop(lists)
    of = found.groupBy("id").agg(F.collect_set("block").alias("others"))
    pairs = tables.put(of.select(F.explode("others").alias("i"), "others").select("i", F.explode("others").alias("j")).where("i <= j").distinct())
    dealt = found.join(of, "id").select("id", "m", "block", F.explode("others").alias("other")).where("block <> other or size(m) > 1")
    dealt = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("first"), "id", "m", F.lit(None).cast(names.schema["names"].dataType).alias("names"))
    for own in ("i", "j"):
        of_pair = pairs.where("i < j or " + str(own == "i")).withColumn("block", F.col(own)).join(names, "block")
        dealt = dealt.union(of_pair.select("i", "j", F.lit(own == "i").alias("first"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<short>").alias("m"), "names"))
    kind = lists.schema["entity"].dataType
    n = pairs.count()
    return dealt.repartition(max(1, min(n, max(256, n // 16))), "i", "j").groupBy("i", "j").applyInArrow(_met(least), StructType([StructField("src", kind), StructField("dst", kind)]))


def _lags(dev: DataFrame, edges: DataFrame) -> DataFrame:
    """Scores of connected entities as deviations ``d`` from their mean, with the mean deviation ``lag`` of neighbours."""
    key = ["scheme", "year"]
    rows = dev.where("total_score is not null").select("scheme", "year", "entity", F.col("total_score").alias("y"))
    near = rows.select(*key, F.col("entity").alias("dst"), F.col("y").alias("ny"))
    found = rows.join(edges, rows.entity == edges.src).join(near, [*key, "dst"]).groupBy(*key, "entity").agg(F.first("y").alias("y"), F.avg("ny").alias("ny"), F.count("*").alias("n_neighbors"))
    means = found.groupBy(*key).agg(F.avg("y").alias("m"), F.count("*").alias("n"))
    return found.join(means, key).select(*key, "entity", (F.col("y") - F.col("m")).alias("d"), (F.col("ny") - F.col("m")).alias("lag"), "n_neighbors", "n")


def moran_global(dev: DataFrame, edges: DataFrame) -> DataFrame:
    """Moran's I per (scheme, year) with row-standardised weights over entities that are present and connected."""
    out = _lags(dev, edges).groupBy("scheme", "year").agg(F.count("*").alias("n"), ratio(F.sum(F.col("d") * F.col("lag")), F.sum(F.col("d") * F.col("d"))).alias("moran_i")).where("n >= 3")
    return out.withColumn("expected", -1 / (F.col("n") - 1))


def moran_local_parts(dev: DataFrame, edges: DataFrame) -> DataFrame:
    """The deterministic part of local Moran: local_i, neighbours and the quadrant by the signs of deviation and lag."""
    rows = _lags(dev, edges)
    scale = rows.groupBy("scheme", "year").agg(F.avg(F.col("d") * F.col("d")).alias("m2"))
    up, lag_up = F.col("d") >= 0, F.col("lag") >= 0
    quadrant = F.when(up & lag_up, "HH").when(~up & lag_up, "LH").when(~up, "LL").otherwise("HL")
    local = rows.join(scale, ["scheme", "year"]).select("scheme", "year", "entity", ratio(F.col("d") * F.col("lag"), F.col("m2")).alias("local_i"), "n_neighbors", quadrant.alias("quadrant"))
    return dev.where("total_score is not null").select("scheme", "year", "entity").join(local, ["scheme", "year", "entity"], "left").na.fill({"n_neighbors": 0, "quadrant": "ns"})


def _shuffled(rows: DataFrame, permutations: int, seed: int) -> DataFrame:
    """``rows`` of connected entities once per permutation ``p``, with the entity's ``place`` (from 1) in it by a seeded
    hash. The permutation is part of the key, so a slice's permutations spread over all tasks."""
    dealt = rows.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    order = Window.partitionBy("scheme", "year", "p").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "p", "entity")), "entity")
    return dealt.withColumn("place", F.row_number().over(order))


def _extreme(larger: Column, permutations: int) -> Column:
    """One more than the simulations at the nearer end, over one more than all of them."""
    return (F.least(larger, permutations - larger) + 1) / F.lit(permutations + 1)


def moran_significance(dev: DataFrame, edges: DataFrame, permutations: int = 999, seed: int = 42) -> DataFrame:
    """Pseudo p-value and z-score of the global I per (scheme, year), by shuffles of the scores over the entities.

    A shuffle gives each entity the score of the one whose rank by name is its place; simulated and own values are
    compared at 9 decimals. Without any spread of scores, or of simulated values, I and z are 0.
    """
    key = ["scheme", "year"]
    rows = _lags(dev, edges).where("n >= 3").select(*key, "entity", "d")
    named = rows.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("entity")).alias("place"), F.col("d").alias("x"))
    moved = _shuffled(rows.select(*key, "entity"), permutations, seed).join(named, [*key, "place"]).select(*key, "p", "entity", "x")
    near = moved.select(*key, "p", F.col("entity").alias("dst"), F.col("x").alias("nx"))
    lagged = moved.join(edges, moved.entity == edges.src).join(near, [*key, "p", "dst"]).groupBy(*key, "p", "entity").agg(F.first("x").alias("x"), F.avg("nx").alias("nx"))
    stat = lambda x, nx: F.coalesce(F.round(ratio(F.sum(F.col(x) * F.col(nx)), F.sum(F.col(x) * F.col(x))), 9), F.lit(0.0))
    sims = lagged.groupBy(*key, "p").agg(stat("x", "nx").alias("sim"))
    own = _lags(dev, edges).where("n >= 3").groupBy(*key).agg(stat("d", "lag").alias("moran_i"))
    found = sims.join(own, key).groupBy(*key, "moran_i").agg(F.count_if(F.col("sim") >= F.col("moran_i")).alias("larger"), F.avg("sim").alias("m"), F.stddev_pop("sim").alias("s"))
    z = F.when(F.col("s") > 1e-12, (F.col("moran_i") - F.col("m")) / F.col("s")).otherwise(0.0)
    return found.select(*key, "moran_i", z.alias("z_score"), _extreme(F.col("larger"), permutations).alias("p_value"))


def moran_local(dev: DataFrame, edges: DataFrame, permutations: int = 999, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """``moran_local_parts`` with two-sided conditional-permutation p-values; a quadrant that isn't significant is ns.

    A permutation hands an entity with k neighbours the first k others in its order, so only the first entities of an
    order, one more than the largest number of neighbours, meet the slice. That number is known before the orders are
    made, so each task hands on its own first entities alone (``windowGroupLimitThreshold`` allows a number up to 1000).
    """
    key = ["scheme", "year"]
    rows = _lags(dev, edges)
    most = rows.groupBy(*key).agg(F.max("n_neighbors").alias("most"))
    ahead = (most.agg(F.max("most")).first()[0] or 0) + 1
    first = _shuffled(rows.select(*key, "entity", "d"), permutations, seed).where(F.col("place") <= ahead).join(most, key).where("place <= most + 1")
    first = first.groupBy(*key, "p").agg(F.array_sort(F.collect_list(F.struct("place", "entity", "d"))).alias("order"))
    drawn = F.slice(F.filter("order", lambda o: o["entity"] != F.col("entity")), 1, F.col("n_neighbors").cast("int"))
    mean = F.aggregate(drawn, F.lit(0.0), lambda t, o: t + o["d"]) / F.col("n_neighbors")
    sims = rows.where("n > n_neighbors").join(first, key).select(*key, "entity", F.round(mean * F.col("d"), 9).alias("sim"), F.round(F.col("d") * F.col("lag"), 9).alias("own"))
    larger = sims.groupBy(*key, "entity").agg(F.count_if(F.col("sim") >= F.col("own")).alias("larger"))
    p = larger.select(*key, "entity", F.least(F.lit(1.0), 2 * _extreme(F.col("larger"), permutations)).alias("p_value"))
    out = moran_local_parts(dev, edges).join(p, [*key, "entity"], "left")
    return out.withColumn("quadrant", F.when(F.col("p_value") < alpha, F.col("quadrant")).otherwise("ns"))
