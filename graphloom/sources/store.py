"""Where graphs, contracts, link sets and index state live: versioned Parquet tables behind one interface."""

from __future__ import annotations

import json
import time
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import analytics, snapshot
from graphloom.operators.indexing import COMPARED_EDGE, COMPARED_NODE, EDGE, NODE, Contracts, IndexRun
from graphloom.operators.links import LinkSet
from graphloom.operators.traverse import edges_at
from graphloom.plans.storage import stored
from graphloom.sources.config import to_index

STATE = "repo_id string, branch string, sha string, indexed_at string"


class GraphStore(Protocol):
    """What questions and runs need of a store."""

    def apply_delta(self, nodes: DataFrame, edges: DataFrame, ops: DataFrame) -> dict[str, int]: ...
    def get_node(self, node: str) -> DataFrame: ...
    def find_nodes(self, name: str, limit: int, mode: str = "contains") -> DataFrame: ...
    def get_edges_from(self, node: str, kind: str | None, limit: int) -> DataFrame: ...
    def get_edges_to(self, node: str, kind: str | None, limit: int) -> DataFrame: ...
    def run_analytics(self, mode: str, node: str | None = None, depth: int | None = None, limit: int | None = None) -> dict: ...
    def health(self) -> bool: ...
    def reset(self) -> None: ...


class Tables:
    """Named tables in a folder; a write goes to a new version, and a small pointer file tells which one counts."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, name: str) -> str | None:
        p, fs = self._fs(f"{self.home}/{name}/current.json")
        if not fs.exists(p):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(p.toString()).collect()))["version"]  # one line

    def read(self, name: str) -> DataFrame | None:
        """The table, or null where nothing was stored."""
        version = self._pointer(name)
        return None if version is None else self.spark.read.parquet(f"{self.home}/{name}/{version}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Store the next version whole, then point to it; readers of the former one are not disturbed, and it goes with the version after."""
        old, version = self._pointer(name), f"v-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.home}/{name}/{version}")
        p, fs = self._fs(f"{self.home}/{name}/current.json")
        out = fs.create(p, True)
        out.writeBytes(json.dumps({"version": version, "before": old}))
        out.close()
        parent, _ = self._fs(f"{self.home}/{name}")
        for status in fs.listStatus(parent):
            if status.isDirectory() and status.getPath().getName() not in (version, old):
                fs.delete(status.getPath(), True)
        return self.spark.read.parquet(f"{self.home}/{name}/{version}")

    def drop(self, name: str) -> None:
        p, fs = self._fs(f"{self.home}/{name}")
        fs.delete(p, True)


class SparkGraphStore:
    """The graph as two tables, ``nodes`` and ``edges``."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.tables = spark, Tables(spark, home)

    @property
    def nodes(self) -> DataFrame:
        got = self.tables.read("nodes")
        return self.spark.createDataFrame([], NODE) if got is None else got

    @property
    def edges(self) -> DataFrame:
        got = self.tables.read("edges")
        return self.spark.createDataFrame([], EDGE) if got is None else got

    def apply_delta(self, nodes: DataFrame, edges: DataFrame, ops: DataFrame) -> dict[str, int]:
        """Apply ops, whose payload is in ``nodes`` and ``edges``, and tell the counters; no ops change nothing."""
        ops = stored(ops.select("phase", "op", "entity", "kind", "a", "b"), "store-ops")
        if ops.isEmpty():
            return {}
        node_cols, edge_cols = self.nodes.columns, self.edges.columns
        left, tied, counters = snapshot.apply_delta(self.nodes, self.edges, nodes.select(*node_cols), edges.select(*edge_cols), ops)
        counters = {r.outcome: r.n for r in counters.collect()}  # six rows
        left, tied = stored(left, "store-nodes"), stored(tied, "store-edges")
        self.tables.write("nodes", left)
        self.tables.write("edges", tied)
        return counters

    def get_node(self, node: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node)

    def find_nodes(self, name: str, limit: int, mode: str = "contains") -> DataFrame:
        exact = (F.col("name") == name) | (F.col("qualified_name") == name)
        return self.nodes.where(exact if mode == "exact" else F.contains(F.lower("name"), F.lit(name.lower()))).orderBy("id").limit(limit)

    def get_edges_from(self, node: str, kind: str | None, limit: int) -> DataFrame:
        return edges_at(self.edges, node, False, kind).limit(limit)

    def get_edges_to(self, node: str, kind: str | None, limit: int) -> DataFrame:
        return edges_at(self.edges, node, True, kind).limit(limit)

    def run_analytics(self, mode: str, node: str | None = None, depth: int | None = None, limit: int | None = None) -> dict:
        return analytics.report(analytics.run(mode, self.nodes, self.edges, node, depth), limit or analytics.MAX_LIMIT) | {"mode": mode}

    def health(self) -> bool:
        """Whether the tables can be read."""
        return self.nodes.limit(1).count() >= 0 and self.edges.limit(1).count() >= 0

    def reset(self) -> None:
        for name in ("nodes", "edges"):
            self.tables.drop(name)


class RunState:
    """What runs keep between them: a snapshot and contracts of each repository and branch, the state, the link set."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.tables = spark, Tables(spark, home)

    @staticmethod
    def _place(repo: str, branch: str) -> str:
        safe = lambda s: "".join(c if c.isalnum() or c in "._-" else "_" for c in s)
        return f"{safe(repo)}/{safe(branch)}"

    def load_maps(self, repo: str, branch: str) -> tuple[DataFrame, DataFrame] | None:
        got = [self.tables.read(f"snapshots/{self._place(repo, branch)}/{t}") for t in ("nodes", "edges")]
        return None if got[0] is None or got[1] is None else (got[0], got[1])

    def save_maps(self, repo: str, branch: str, nodes: DataFrame, edges: DataFrame) -> None:
        for t, df in (("nodes", nodes), ("edges", edges)):
            self.tables.write(f"snapshots/{self._place(repo, branch)}/{t}", df)

    def load_contracts(self, repo: str, branch: str) -> Contracts | None:
        got = {t: self.tables.read(f"contracts/{self._place(repo, branch)}/{t}") for t in ("provides", "consumes", "channels", "resources", "evidence")}
        return None if any(t is None for t in got.values()) else Contracts(got)

    def save_contracts(self, repo: str, branch: str, contracts: Contracts) -> None:
        for t, df in contracts.tables.items():
            self.tables.write(f"contracts/{self._place(repo, branch)}/{t}", df)

    def persist_contracts(self, repo: str, branch: str, fresh: Contracts, removed: DataFrame | None = None) -> None:
        """Whole: the fresh ones replace all. After changes: rows of removed files go, rows of fresh files are replaced; nothing stored and nothing fresh stores nothing."""
        held = self.load_contracts(repo, branch)
        if removed is None or held is None:
            if removed is None or not fresh.files().isEmpty():
                self.save_contracts(repo, branch, fresh)
            return
        self.save_contracts(repo, branch, held.without(removed).replaced(fresh))

    def load_links(self) -> LinkSet | None:
        got = [self.tables.read(f"links/{t}") for t in ("edges", "topics", "resources")]
        return None if any(t is None for t in got) else LinkSet(*got)

    def save_links(self, links: LinkSet) -> None:
        for t, df in (("edges", links.edges), ("topics", links.topics), ("resources", links.resources)):
            self.tables.write(f"links/{t}", df)

    def state(self) -> DataFrame:
        got = self.tables.read("state")
        return self.spark.createDataFrame([], STATE) if got is None else got

    def last_sha(self, repo: str, branch: str) -> str | None:
        row = self.state().where((F.col("repo_id") == repo) & (F.col("branch") == branch)).first()
        return None if row is None else row.sha

    def due(self, heads: DataFrame, full: bool = False) -> DataFrame:
        """Heads (repo_id, branch, sha) that are not indexed at their commit."""
        return to_index(heads, self.state().select("repo_id", "branch", F.col("sha").alias("indexed_sha")), full)

    def mark(self, repo: str, branch: str, sha: str) -> None:
        row = self.spark.createDataFrame([(repo, branch, sha, f"unix:{int(time.time())}")], STATE)
        self.tables.write("state", stored(snapshot.upsert(self.state(), row, ["repo_id", "branch"]), "state"))

    def commit(self, store: GraphStore, repo: str, branch: str, sha: str, run: IndexRun, removed: DataFrame | None = None) -> dict[str, int]:
        """Apply a run's delta; snapshot, contracts and state are kept only if no op failed."""
        done = store.apply_delta(run.nodes, run.edges, run.delta)
        if not done.get("errors"):
            self.save_maps(repo, branch, run.nodes, run.edges)
            self.persist_contracts(repo, branch, run.contracts, None)
            self.mark(repo, branch, sha)
        return done


def diff_to_store(store: SparkGraphStore, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ops from what a store holds to a graph."""
    return snapshot.graph_delta(store.nodes, store.edges, nodes, edges, COMPARED_NODE, COMPARED_EDGE)
