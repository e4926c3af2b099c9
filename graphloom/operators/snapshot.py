"""Snapshots: merge of facts, diff, application of deltas, incremental plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from graphloom.model import check_relation
from graphloom.plans.storage import small, stored

EDGE_KEY = ["kind", "src", "dst"]
#: Priority of analyzers when facts disagree, and the tags of their messages.
PRIORITY = {"JOERN": 2, "SCIP": 1}
TAGS = {"GIT": "git", "TREE_SITTER": "tree-sitter", "SCIP": "scip", "JOERN": "joern", "CI_CD": "ci-cd", "DEPLOYMENT_SYSTEM": "deployment", "MANUAL": "manual"}


def sorted_map(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def priority(source: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.upper(source)), F.lit(0))


def merge_facts(facts: DataFrame, key: list[str], identity: list[str]) -> DataFrame:
    """One row a key from facts (key, seq, source, identity columns, content_hash, properties ..) of nodes or edges.

    ``identity`` comes from the first fact of highest priority. Language and location, where facts have them, are the
    first that are known. A hash or property is the first given, replaced by a later one whose priority exceeds that of
    everything before it. ``provenance`` holds each (source, analyzer_version, status, detail) once, in order of arrival.
    """
    p = facts.withColumn("p", priority(F.col("source")))
    before = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("above", F.col("p") > F.coalesce(F.max("p").over(before), F.lit(-1)))
    rank = F.struct(-F.col("p"), F.col("seq"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq")))
    last_above = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull() & F.col("above"), F.col("seq")))
    out = [F.min_by(c, rank).alias(c) for c in identity] + [first(c).alias(c) for c in ("language", "location") if c in facts.columns]
    if "content_hash" in facts.columns:
        out.append(F.coalesce(last_above("content_hash"), first("content_hash")).alias("content_hash"))
    merged = p.groupBy(*key).agg(*out, F.array_sort(F.collect_set("source")).alias("sources"))
    props = p.select(*key, "seq", "above", F.explode("properties").alias("k", "v"))
    # A key's first value stands until a fact of higher priority than all before brings another.
    pick = F.coalesce(F.max_by("v", F.when(F.col("above"), F.col("seq"))), F.min_by("v", "seq"))
    bag = props.groupBy(*key, "k").agg(pick.alias("v")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    given = lambda c: F.col(c) if c in facts.columns else F.lit(None).cast("string").alias(c)
    origin = p.select(*key, "seq", F.col("source"), *[given(c) for c in ("analyzer_version", "status", "detail", "recorded_at")])
    origin = origin.groupBy(*key, "source", "analyzer_version", "status", "detail").agg(F.min("seq").alias("seq"), F.min_by("recorded_at", "seq").alias("recorded_at"))
    origin = origin.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "source", "analyzer_version", "status", "detail", "recorded_at"))).alias("o"))
    origin = origin.select(*key, F.transform("o", lambda x: x.dropFields("seq")).alias("provenance"))
    return merged.join(bag, key, "left").join(origin, key)


def merge_edges(relations: DataFrame) -> DataFrame:
    """``merge_facts`` of relations (kind, src, dst, seq, source, properties ..)."""
    return merge_facts(relations, EDGE_KEY, [])


def normalize(symbols: DataFrame, relations: DataFrame, errors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(nodes, edges, messages) from the outputs of all analyzers: symbols (id, ..), relations (kind, src, dst, ..), errors (source, message, seq).

    A message carries its analyzer's tag in brackets; facts without a source are unknown.
    """
    nodes = merge_facts(symbols, ["id"], [c for c in ("kind", "name", "qualified_name") if c in symbols.columns])
    tag = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv]), F.upper("source")), F.col("source"), F.lit("unknown"))
    said = None if errors is None else errors.select("seq", F.concat(F.lit("["), tag, F.lit("] "), F.col("message")).alias("message"))
    return nodes, merge_edges(relations), said


def _comparable(df: DataFrame, column: str) -> Column:
    """The column itself; a map as its sorted entries, since maps can't be compared."""
    return sorted_map(F.col(column)).alias(column) if isinstance(df.schema[column].dataType, MapType) else F.col(column)


def diff(old: DataFrame, new: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """op (CREATE, UPDATE, DELETE) and key of every change in the columns compared, maps included; unchanged rows give nothing."""
    o = old.select(*key, F.struct(*[_comparable(old, c) for c in compare]).alias("o"), F.lit(True).alias("in_old"))
    n = new.select(*key, F.struct(*[_comparable(new, c) for c in compare]).alias("n"), F.lit(True).alias("in_new"))
    both = o.join(n, key, "full_outer")
    op = F.when(F.col("in_old").isNull(), "CREATE").when(F.col("in_new").isNull(), "DELETE").when(~F.col("o").eqNullSafe(F.col("n")), "UPDATE")
    return both.withColumn("op", op).where("op is not null").select("op", *key)


def graph_delta(old_nodes, old_edges, new_nodes, new_edges, node_cols=("content_hash",), edge_cols=("content_hash",)) -> DataFrame:
    """phase, op, entity, kind, a, b: node upserts, edge upserts, edge deletes, node deletes, in that order of phases."""
    nodes = diff(old_nodes, new_nodes, ["id"], list(node_cols)).select("op", F.lit("node").alias("entity"), F.lit(None).cast("string").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))
    edges = diff(old_edges, new_edges, EDGE_KEY, list(edge_cols)).select("op", F.lit("edge").alias("entity"), "kind", F.col("src").alias("a"), F.col("dst").alias("b"))
    phase = F.when((F.col("entity") == "node") & (F.col("op") != "DELETE"), 0).when(F.col("op") != "DELETE", 1).when(F.col("entity") == "edge", 2).otherwise(3)
    return nodes.union(edges).withColumn("phase", phase).select("phase", "op", "entity", "kind", "a", "b")


def upsert(old: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``changed`` in place of those of the same key."""
    return old.join(changed.select(*key), key, "left_anti").unionByName(changed)


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose two ends exist, the others)."""
    ids = nodes.select("id")
    ok = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
    return ok, edges.join(ok.select(*EDGE_KEY), EDGE_KEY, "left_anti")


def guarded_delete(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, retained ids): a doomed node goes unless a commit still contains it; its edges go with it."""
    held = edges.where("kind = 'CONTAINS_STATE_OF'").select(F.col("dst").alias("id")).distinct()
    doomed = doomed.select("id").join(nodes.select("id"), "id", "left_semi").distinct()
    kept, gone = doomed.join(held, "id", "left_semi"), stored(doomed.join(held, "id", "left_anti"), "guarded-gone")
    gone = small(gone, gone.count())
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)
    return nodes.join(gone, "id", "left_anti"), left, kept


def apply_delta(old_nodes, old_edges, new_nodes, new_edges, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counters: outcome, n) after the delta, its ops in the order of their phases.

    Counters tell what was done: an upsert of a node that exists updates it; an edge whose ends are not both there is an
    error and changes nothing; a node that a commit still contains is retained; what is missing can't be deleted. Edges
    that the delta does not name are not looked at.
    """
    pick = lambda e, *o: ops.where((F.col("entity") == e) & F.col("op").isin(*o))
    key_cols = lambda df: df.select("op", "kind", F.col("a").alias("src"), F.col("b").alias("dst"))
    some = lambda df, outcome: df.select(F.lit(outcome).alias("outcome"))
    put = pick("node", "CREATE", "UPDATE").select("op", F.col("a").alias("id")).join(old_nodes.select("id", F.lit(True).alias("known")), "id", "left")
    nodes = upsert(old_nodes, new_nodes.join(put.select("id"), "id", "left_semi"), ["id"])
    fresh = F.when((F.col("op") == "CREATE") & F.col("known").isNull(), "created_nodes").otherwise("updated_nodes")
    tied = key_cols(pick("edge", "CREATE", "UPDATE"))
    sound, missing = drop_dangling(nodes, tied)
    edges = upsert(old_edges, new_edges.join(sound.select(*EDGE_KEY), EDGE_KEY, "left_semi"), EDGE_KEY)
    born = sound.where("op = 'CREATE'").join(old_edges.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    cut = edges.join(key_cols(pick("edge", "DELETE")).select(*EDGE_KEY), EDGE_KEY, "left_semi")
    edges = edges.join(key_cols(pick("edge", "DELETE")).select(*EDGE_KEY), EDGE_KEY, "left_anti")
    doomed = pick("node", "DELETE").select(F.col("a").alias("id"))
    before = nodes
    nodes, edges, kept = guarded_delete(nodes, edges, doomed)
    gone = before.select("id").join(doomed, "id", "left_semi").join(kept, "id", "left_anti")
    done = put.select(fresh.alias("outcome")).union(some(born, "created_rels")).union(some(cut, "deleted_rels")).union(some(gone, "deleted_nodes"))
    done = done.union(some(kept, "nodes_retained")).union(some(missing, "errors"))
    return nodes, edges, done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def count_ops(ops: DataFrame) -> DataFrame:
    """created, changed: how many ops create something, and how many do anything else."""
    return ops.agg(F.count_if(F.col("op") == "CREATE").alias("created"), F.count_if(F.col("op") != "CREATE").alias("changed"))


def maps_delta(prev: tuple[DataFrame, DataFrame] | None, new: tuple[DataFrame, DataFrame], base: str | None, target: str, node_cols=("content_hash",), edge_cols=("content_hash",)) -> DataFrame:
    """The ops from a stored snapshot (none: an empty one) to a new one, with base_revision and target_revision."""
    old = prev or (new[0].limit(0), new[1].limit(0))
    ops = graph_delta(*old, *new, node_cols, edge_cols)
    return ops.withColumn("base_revision", F.lit(base).cast("string")).withColumn("target_revision", F.lit(target))


@dataclass
class DeltaBuilder:
    """A delta put together op by op; ``ops`` gives its table, in the order of phases that appliers keep."""

    rows: list[tuple[int, str, str, str | None, str, str | None]] = field(default_factory=list)

    def _node(self, phase: int, op: str, node: str) -> DeltaBuilder:
        self.rows.append((phase, op, "node", None, node, None))
        return self

    def _edge(self, phase: int, op: str, kind: str, src: str, dst: str) -> DeltaBuilder:
        self.rows.append((phase, op, "edge", check_relation(kind), src, dst))
        return self

    def create_node(self, node: str) -> DeltaBuilder:
        return self._node(0, "CREATE", node)

    def update_node(self, node: str) -> DeltaBuilder:
        return self._node(0, "UPDATE", node)

    def delete_node(self, node: str) -> DeltaBuilder:
        return self._node(3, "DELETE", node)

    def create_edge(self, kind: str, src: str, dst: str) -> DeltaBuilder:
        return self._edge(1, "CREATE", kind, src, dst)

    def update_edge(self, kind: str, src: str, dst: str) -> DeltaBuilder:
        return self._edge(1, "UPDATE", kind, src, dst)

    def delete_edge(self, kind: str, src: str, dst: str) -> DeltaBuilder:
        return self._edge(2, "DELETE", kind, src, dst)

    def ops(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "phase int, op string, entity string, kind string, a string, b string")


def apply_to_maps(old_nodes, old_edges, new_nodes, new_edges, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the ops as plain maps: no guard, no look at ends; applied to the old snapshot it gives the new one."""
    key = lambda e, *o: ops.where((F.col("entity") == e) & F.col("op").isin(*o))
    ids = lambda *o: key("node", *o).select(F.col("a").alias("id"))
    ties = lambda *o: key("edge", *o).select("kind", F.col("a").alias("src"), F.col("b").alias("dst"))
    nodes = upsert(old_nodes, new_nodes.join(ids("CREATE", "UPDATE"), "id", "left_semi"), ["id"]).join(ids("DELETE"), "id", "left_anti")
    edges = upsert(old_edges, new_edges.join(ties("CREATE", "UPDATE"), EDGE_KEY, "left_semi"), EDGE_KEY).join(ties("DELETE"), EDGE_KEY, "left_anti")
    return nodes, edges


def incremental_plan(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths to analyze, paths to remove) from changes (status A, M, D, R; old_path, new_path)."""
    analyze = changes.where("status <> 'D'").select(F.coalesce("new_path", "old_path").alias("path")).distinct()
    gone = changes.where("status in ('D', 'R')").select(F.col("old_path").alias("path"))
    return analyze, analyze.union(gone).distinct()


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """status, old_path, new_path from two listings (path, hash); a rename pairs a deletion and an addition of one hash."""
    both = old.select("path", F.col("hash").alias("h0")).join(new.select("path", F.col("hash").alias("h1")), "path", "full_outer")
    gone, came = both.where("h1 is null").select(F.col("path").alias("old_path"), F.col("h0").alias("h")), both.where("h0 is null").select(F.col("path").alias("new_path"), F.col("h1").alias("h"))
    w = lambda c: F.row_number().over(Window.partitionBy("h").orderBy(c))
    moved = gone.withColumn("i", w("old_path")).join(came.withColumn("i", w("new_path")), ["h", "i"]).select(F.lit("R").alias("status"), "old_path", "new_path")
    null = F.lit(None).cast("string")
    return (
        moved.union(gone.join(moved, "old_path", "left_anti").select(F.lit("D"), "old_path", null))
        .union(came.join(moved, "new_path", "left_anti").select(F.lit("A"), null, "new_path"))
        .union(both.where("h0 <> h1").select(F.lit("M"), "path", "path"))
    )
