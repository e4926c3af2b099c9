"""Workspace configuration and stored state."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import DEPLOYMENT


@dataclass
class Repository:
    id: str
    github: str
    branches: list[str] = field(default_factory=list)
    default_branch: str | None = None
    enabled: bool = True
    languages: list[str] = field(default_factory=list)


@dataclass
class Workspace:
    repositories: list[Repository] = field(default_factory=list)
    default_branches: list[str] = field(default_factory=lambda: ["main"])
    links: dict[str, dict[str, str]] = field(default_factory=dict)

    def validate(self) -> Workspace:
        ids = [r.id for r in self.repositories]
        if twice := {i for i in ids if ids.count(i) > 1}:
            raise ValueError(f"repository ids occur twice: {sorted(twice)}")
        for r in self.repositories:
            if not r.github.strip():
                raise ValueError(f"repository {r.id} has no address")
        if not self.default_branches and any(not r.branches and not r.default_branch for r in self.repositories):
            raise ValueError("there are no branches to index")
        return self

    @staticmethod
    def load(path: str) -> Workspace:
        text, kind = Path(path).read_text(), Path(path).suffix
        if kind not in (".toml", ".json"):
            raise ValueError(f"no reader for {kind or 'files without extension'}")
        raw = tomllib.loads(text) if kind == ".toml" else json.loads(text)
        repos = [Repository(**r) for r in raw.get("repositories", [])]
        return Workspace(repos, raw.get("default_branches", ["main"]), raw.get("links", {})).validate()

    def save(self, path: str) -> None:
        self.validate()
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    def find(self, repo: str) -> Repository:
        for r in self.repositories:
            if r.id == repo:
                return r
        raise ValueError(f"no repository {repo}")

    def add(self, repo: Repository) -> Workspace:
        """With one more repository; an id that is taken or an empty address is an error and changes nothing."""
        return Workspace([*self.repositories, repo], self.default_branches, self.links).validate()

    def replace(self, repo: str, new: Repository) -> Workspace:
        self.find(repo)
        return Workspace([new if r.id == repo else r for r in self.repositories], self.default_branches, self.links).validate()

    def remove(self, repo: str) -> Workspace:
        self.find(repo)
        return Workspace([r for r in self.repositories if r.id != repo], self.default_branches, self.links).validate()

    def with_default_branches(self, branches: list[str]) -> Workspace:
        return Workspace(self.repositories, branches, self.links).validate()

    def selected(self, repo: str | None = None) -> list[Repository]:
        if repo is None:
            return [r for r in self.repositories if r.enabled]
        hit = [r for r in self.repositories if r.id == repo]
        if not hit:
            raise ValueError(f"no repository {repo}")
        if not hit[0].enabled:
            raise ValueError(f"repository {repo} is disabled")
        return hit

    def branches(self, r: Repository) -> list[str]:
        return r.branches or ([r.default_branch] if r.default_branch else self.default_branches) or ["main"]

    def heads(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.id, r.github, b) for r in self.selected() for b in self.branches(r)], "repo_id string, github string, branch string")

    def link_table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.createDataFrame(sorted(self.links.get(name, {}).items()), "key string, value string")


class DeploymentImporter(Protocol):
    """A source of deployment records."""

    def load(self) -> DataFrame: ...


@dataclass
class JsonDeployments:
    """Records in a JSON array; a record that doesn't fit the schema is an error."""

    spark: SparkSession
    path: str

    def load(self) -> DataFrame:
        return read_deployments(self.spark, self.path)


@dataclass
class ListedDeployments:
    """Records given as dictionaries."""

    spark: SparkSession
    records: list[dict]

    def load(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.get(f) for f in DEPLOYMENT.fieldNames()) for r in self.records], DEPLOYMENT)


def read_deployments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEPLOYMENT).json(path, multiLine=True, mode="FAILFAST")


def to_index(heads: DataFrame, state: DataFrame, full: bool = False) -> DataFrame:
    """Heads (repo_id, branch, sha) whose commit differs from the indexed one (repo_id, branch, indexed_sha)."""
    both = heads.join(state, ["repo_id", "branch"], "left")
    return (both if full else both.where(~F.col("sha").eqNullSafe(F.col("indexed_sha")))).select(*heads.columns)


def resolve_heads(refs: DataFrame, branches: DataFrame) -> DataFrame:
    """repo_id, branch, sha: origin's ref of a branch, else the local one, else any other remote's."""
    order = F.when(F.col("ref").startswith("refs/remotes/origin/"), 0).when(F.col("ref").startswith("refs/heads/"), 1).otherwise(2)
    name = F.regexp_replace("ref", r"^refs/(?:heads|remotes/[^/]+)/", "")
    r = refs.where("ref not like '%/HEAD'").select("repo_id", name.alias("branch"), "sha", order.alias("o"))
    return branches.join(r.groupBy("repo_id", "branch").agg(F.min_by("sha", "o").alias("sha")), ["repo_id", "branch"], "left")


def replace_files(stored: DataFrame, fresh: DataFrame, removed: DataFrame) -> DataFrame:
    """Contract rows after an incremental pass: rows of removed and of fresh files go, fresh rows come."""
    gone = removed.select(F.col("path").alias("file")).union(fresh.select("file")).distinct()
    return stored.join(gone, "file", "left_anti").unionByName(fresh)
