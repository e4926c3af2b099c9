"""Graph analytics: blast radius, PageRank, degree, components, betweenness."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import DEPENDENCY_KINDS
from graphloom.operators.contract import smallest_reachable
from graphloom.operators.traverse import bfs
from graphloom.plans.storage import stored

MAX_LIMIT, MAX_DEPTH = 500, 10
BLOCK_SOURCES = 256
#: A graph that goes to the tasks as arrays: its nodes and edges (8 bytes each at most), and the cells of sources and nodes there.
SMALL_NODES, SMALL_EDGES, BLOCK_CELLS = 500_000, 8_000_000, 1 << 20


def projection(edges: DataFrame) -> DataFrame:
    """Dependency edges; parallel edges of different kinds stay parallel."""
    return edges.where(F.col("kind").isin(*DEPENDENCY_KINDS)).select("kind", "src", "dst")


def blast_radius(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """root, id, distance of everything that reaches a root through dependencies; the root itself is left out."""
    _, reached = bfs(edges, roots, min(depth, MAX_DEPTH), DEPENDENCY_KINDS, inbound=True, with_edges=False)
    return reached.where("depth > 0").select("root", "id", F.col("depth").alias("distance"))


def in_degree(nodes: DataFrame, edges: DataFrame, kind: str = "RESOURCE") -> DataFrame:
    """id, name, score: inbound dependency edges of every node of a kind, zero included."""
    n = projection(edges).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.where(F.col("kind") == kind).select("id", "name").join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("double").alias("score"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """id, score after a fixed number of iterations: 1 - damping + damping * sum of score / out-degree over inbound edges.

    The weighted links stay partitioned by source, as does the score of each round, so a round shuffles only its sums,
    combined before. Nodes without inbound links take part through a contribution of zero.
    """
    e = projection(edges)
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    links = stored(e.join(out, "src").select("src", "dst", (F.lit(damping) / F.col("deg")).alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w")), "pr-links")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = links.repartition(parts, "src").persist()
    ids = stored(nodes.select("id").distinct(), "pr-ids")
    rank = ids.withColumn("score", F.lit(1.0 - damping))
    none = ids.withColumn("v", F.lit(0.0))
    for i in range(iterations):
        got = links.join(rank, links["src"] == rank["id"]).select(F.col("dst").alias("id"), (F.col("score") * F.col("w")).alias("v"))
        # A link to an id that is no node counts for nothing: only ids that have a zero row stay.
        sums = got.withColumn("own", F.lit(False)).union(none.withColumn("own", F.lit(True))).groupBy("id").agg(F.sum("v").alias("s"), F.max("own").alias("own"))
        rank = sums.where("own").select("id", (F.lit(1.0 - damping) + F.col("s")).alias("score"))
        if i % 5 == 4:
            rank = stored(rank, f"pr-{i}")
    rank = stored(rank, "pr-rank")
    links.unpersist()
    return rank


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (smallest id), size; by contraction over numbers that stand for the ids, hot nodes pre-aggregated."""
    ids = stored(nodes.select("id").distinct().withColumn("n", F.monotonically_increasing_id()), "cc-ids")
    known = lambda c: ids.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    e = projection(edges).select("src", "dst").where("src <> dst").join(known("src"), "src").join(known("dst"), "dst").select(F.col("n_src").alias("a"), F.col("n_dst").alias("b"))
    both = stored(e.select("a", "b").union(e.select("b", "a")).distinct(), "cc-edges")
    linked = smallest_reachable(both, lambda df, step: stored(df, f"cc-{step}"))
    label = stored(ids.join(linked.withColumnRenamed("id", "n"), "n", "left").select("id", F.coalesce("comp", "n").alias("c")), "cc-labels")
    size = label.groupBy("c").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("size"))
    return label.join(size, "c").select("id", "component", "size")


def betweenness(edges: DataFrame, sources: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """id, score: Brandes' dependencies summed over the given sources, as joins on (source, node) level by level.

    No sources: all nodes with a dependency. No ``max_depth``: until nothing new is reached. ``BLOCK_SOURCES`` bounds the
    work at a time: one row of state for each source of a block and node that it reaches. A graph of at most SMALL_NODES
    and SMALL_EDGES, counted first, goes to the tasks as arrays, and each walks its sources there.
    """
    steps = stored(projection(edges).select("src", "dst").distinct(), "bc-edges")
    sources = stored((steps.select(F.col("src").alias("id")) if sources is None else sources.select("id")).distinct(), "bc-sources")
    if steps.count() <= SMALL_EDGES:
        ids = steps.select(F.col("src").alias("id")).union(steps.select("dst")).union(sources).distinct()
        ids = stored(numbered(ids, "id"), "bc-ids")
        if ids.count() <= SMALL_NODES:
            return _betweenness_in_arrays(steps, sources, ids, max_depth)
    blocks = max(1, -(-sources.count() // BLOCK_SOURCES))
    total = None
    for b in range(blocks):
        part = _dependencies(steps, sources.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), max_depth)
        part = part if blocks == 1 else stored(part, f"bc-part-{b}")
        total = part if total is None else total.union(part)
    return total if blocks == 1 else total.groupBy("id").agg(F.sum("score").alias("score"))


def _betweenness_in_arrays(steps: DataFrame, sources: DataFrame, ids: DataFrame, max_depth: int | None) -> DataFrame:
    at = lambda c: ids.select(F.col("id").alias(c), (F.col("number") - 1).cast("int").alias(f"n_{c}"))
    got = steps.join(at("src"), "src").join(at("dst"), "dst").select("n_src", "n_dst").toArrow()  # at most SMALL_EDGES
    n = ids.count()
    held = steps.sparkSession.sparkContext.broadcast(_graph_arrays(got.column("n_src").to_numpy(), got.column("n_dst").to_numpy(), n))
    del got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, met = np.zeros(n), np.zeros(n, dtype=bool)
        width = max(1, min(16, BLOCK_CELLS // n))
        depth, place = np.full(width * n, -1, dtype=np.int32), np.zeros(width * n, dtype=np.int32)
        for batch in batches:
            all_ = batch.column("n").to_numpy()
            for i in range(0, len(all_), width):
                _brandes(all_[i : i + width], n, held.value, max_depth, depth, place, score, met)
        some = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(score[some])], names=["n", "score"])

    starts = sources.join(at("id"), "id").select(F.col("n_id").alias("n")).repartition(max(1, -(-sources.count() // BLOCK_SOURCES)))
    sums = stored(starts.mapInArrow(run, "n long, score double").groupBy("n").agg(F.sum("score").alias("score")), "bc-sums")
    held.destroy()
    return ids.join(sums, ids["number"] - 1 == sums["n"]).select("id", "score")


def _graph_arrays(src: np.ndarray, dst: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Edges by their source, those into nodes without edges of their own (ends) apart; these by their end too, and the ends by weak component."""
    end = np.bincount(src, minlength=n) == 0
    out = {}
    for name, some, near, far in (("on", ~end[dst], src, dst), ("off", end[dst], src, dst), ("back", end[dst], dst, src)):
        near, far = near[some], far[some]
        out[name] = far[np.argsort(near, kind="stable")]
        out[f"{name}_at"] = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=n))]).astype(np.int32)
    label = np.arange(n, dtype=np.int32)
    while len(src):
        a, b = label[src], label[dst]
        apart = a != b
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up
    ends = np.flatnonzero(end).astype(np.int32)
    out["ends"] = ends[np.argsort(label[ends], kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(label[ends], minlength=n))]).astype(np.int32)
    return out | {"ends_from": first[label], "ends_to": first[label + 1]}


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each first to before its last, and the index of the range of each."""
    many = last - first
    of = np.repeat(np.arange(len(many), dtype=np.int32), many)
    return np.arange(len(of), dtype=np.int32) + (first - (np.cumsum(many, dtype=np.int32) - many))[of], of


def _brandes(sources: np.ndarray, n: int, graph: dict[str, np.ndarray], max_depth: int | None, depth: np.ndarray, place: np.ndarray, score: np.ndarray, met: np.ndarray) -> None:
    """Adds the dependencies of some sources to ``score``, and the nodes that they reach to ``met``.

    A cell is a node as one source sees it. Only edges of the cells reached last are walked, and those on shortest paths
    are kept for the way back. A source's ends that are not reached yet look for their nearer cells themselves where that is
    less work, and cost nothing once all are reached.
    ``depth`` is -1 in every cell before and after.
    """
    base = np.arange(len(sources), dtype=np.int32) * n
    k, of = _ranges(graph["ends_from"][sources], graph["ends_to"][sources])
    open_, open_base = graph["ends"][k], base[of]
    node, sigma, links, levels = sources.astype(np.int32), np.ones(len(sources)), [], []
    depth[node + base] = 0
    while True:
        levels.append((node, base, sigma))
        if len(levels) - 1 == max_depth:
            break
        k, parent = _ranges(graph["on_at"][node], graph["on_at"][node + 1])
        child, child_base = graph["on"][k], base[parent]
        new = depth[child + child_base] < 0
        parent, child, child_base = parent[new], child[new], child_base[new]
        still = depth[open_ + open_base] < 0
        open_, open_base = open_[still], open_base[still]
        if len(open_):
            down, up = graph["off_at"][node + 1] - graph["off_at"][node], graph["back_at"][open_ + 1] - graph["back_at"][open_]
            own, open_own = base // n, open_base // n
            down, up = np.bincount(own, weights=down, minlength=len(sources)), np.bincount(open_own, weights=up, minlength=len(sources))
            walks = (down <= up) & (up > 0)
            at = np.flatnonzero(walks[own]).astype(np.int32)
            k, of = _ranges(graph["off_at"][node[at]], graph["off_at"][node[at] + 1])
            near = at[of]
            far, far_base = graph["off"][k], base[near]
            new = depth[far + far_base] < 0
            found = [(parent, child, child_base), (near[new], far[new], far_base[new])]
            look = ~walks[open_own]
            k, of = _ranges(graph["back_at"][open_[look]], graph["back_at"][open_[look] + 1])
            far, far_base = open_[look][of], open_base[look][of]
            cell = graph["back"][k] + far_base
            new = depth[cell] == len(levels) - 1
            found.append((place[cell[new]], far[new], far_base[new]))
            parent, child, child_base = (np.concatenate(x) for x in zip(*found))
        if not len(child):
            break
        cell, order = child + child_base, np.arange(len(child), dtype=np.int32)
        place[cell] = order
        one = place[cell] == order  # of the edges into a cell, the one written last stands for it
        node, base, cells = child[one], child_base[one], cell[one]
        place[cells] = np.arange(len(cells), dtype=np.int32)
        depth[cells] = len(levels)
        at = place[cell]
        links.append((parent, at))
        sigma = np.bincount(at, weights=sigma[parent], minlength=len(cells))
    delta, sums = np.zeros(len(sigma)), []
    for level in range(len(levels) - 1, 0, -1):
        node, base, sigma = levels[level]
        sums.append((node, delta))
        depth[node + base] = -1
        parent, at = links[level - 1]
        over = levels[level - 1][2]
        delta = over * np.bincount(parent, weights=((1.0 + delta) / sigma)[at], minlength=len(over))
    depth[levels[0][0] + levels[0][1]] = -1
    if sums:
        node, delta = (np.concatenate(x) for x in zip(*sums))
        met[node] = True
        score += np.bincount(node, weights=delta, minlength=n)


def _dependencies(steps: DataFrame, sources: DataFrame, max_depth: int | None) -> DataFrame:
    seen = stored(sources.select(F.col("id").alias("s"), "id", F.lit(0).alias("d"), F.lit(1.0).alias("sigma")), "bc-0")
    levels = [seen]
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        hop = levels[-1].join(steps, levels[-1]["id"] == steps["src"]).groupBy("s", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        new = stored(hop.join(seen.select("s", "id"), ["s", "id"], "left_anti").select("s", "id", F.lit(d).alias("d"), "sigma"), f"bc-{d}")
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.union(new)
    below, total = None, None
    for level in reversed(levels[1:]):
        here = level.select("s", "id", "sigma", F.lit(0.0).alias("delta")) if below is None else level.join(below, ["s", "id"], "left").select("s", "id", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        here = stored(here, "bc-back")
        total = here.select("id", "delta") if total is None else total.union(here.select("id", "delta"))
        upper = levels[level.first()["d"] - 1].select("s", F.col("id").alias("v"), F.col("sigma").alias("sv"))
        flow = here.join(steps, here["id"] == steps["dst"]).select("s", F.col("src").alias("v"), "sigma", "delta").join(upper, ["s", "v"])
        below = flow.groupBy("s", F.col("v").alias("id")).agg(F.sum(F.col("sv") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
    if total is None:
        return seen.select("id", F.lit(0.0).alias("score")).limit(0)
    return total.groupBy("id").agg(F.sum("delta").alias("score"))


def report(rows: DataFrame, limit: int, degraded: bool = False, note: str | None = None) -> dict:
    """The analytics envelope: at most ``limit`` rows (1 to 500), with the flags callers expect."""
    limit = max(1, min(limit, MAX_LIMIT))
    cut = rows.limit(limit + 1)
    return {"engine": "spark", "rows": rows.limit(limit), "truncated": cut.count() > limit, "degraded": degraded, "note": note}


def numbered(values: DataFrame, column: str) -> DataFrame:
    """The distinct values with ``number``, their rank from 1: a ranged sort, then an offset for each partition."""
    parts = values.select(column).distinct().repartitionByRange(column).withColumn("__part", F.spark_partition_id())
    parts = stored(parts, "numbered")
    inside = parts.withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy(column)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__at", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return inside.join(offsets, "__part").select(column, (F.col("__at") + F.col("__i")).cast("long").alias("number"))


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component, size, score (the size) with components numbered by their smallest id; largest first."""
    c = components(nodes, edges)
    out = c.join(numbered(c, "component"), "component").select("id", F.col("number").alias("component"), "size", F.col("size").cast("double").alias("score"))
    return out.orderBy(F.desc("size"), "component", "id")


#: How each mode of the analytics runs here; every one is native, so none is degraded.
MODES = ("blast_radius", "critical_resources", "bridges", "clusters")


def run(mode: str, nodes: DataFrame, edges: DataFrame, node: str | None = None, depth: int | None = None) -> DataFrame:
    """The rows of a mode, best first."""
    if mode == "blast_radius":
        roots = nodes.sparkSession.createDataFrame([(node,)], "id string")
        return blast_radius(edges, roots, MAX_DEPTH if depth is None else depth).select("id", "distance").orderBy("distance", "id")
    if mode == "critical_resources":
        return pagerank(nodes, edges).join(nodes.where("kind = 'RESOURCE'").select("id", "name"), "id").orderBy(F.desc("score"), "id")
    if mode == "bridges":
        return betweenness(edges).orderBy(F.desc("score"), "id")
    if mode == "clusters":
        return clusters(nodes, edges)
    raise ValueError(f"unknown mode {mode}")
