"""Symbols, imports and calls of whole files: one pass over the lines of a file with a stack of scopes.

There is no grammar library, so a scope lasts while lines are indented deeper than its definition; lines that begin with
a bracket don't end one. That is right for conventionally formatted code. A file is walked alone, in time linear in its
length, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.extract.rules import IMPORTS, SYMBOLS, W
from graphloom.sources.registry import allowed_languages, detect_languages, is_skipped

#: Words before a bracket that are no calls.
NO_CALLS = frozenset("if for while switch catch return function def fn func fun match sizeof with class elif not and or in await yield new lambda print_r defp defmodule do end".split())
_CALL = re.compile(rf"(?<!def )(?<!fn )(?<!func )(?<!fun )(?<!function )(?<![\w$.:])((?:{W}(?:\.|::))*{W})\s*\(")
_CLOSES = re.compile(r"\s*[\])}{]")
_TYPES = ("CLASS", "INTERFACE", "MODULE")

FACTS = (
    "fact string, repo_id string, branch string, path string, language string, status string, seq long, kind string, id string, name string, qualified_name string, container string, "
    "start_line int, start_column int, end_line int, content_hash string, src string, dst string, detail string, resolved string"
)
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]


class Analyzer(Protocol):
    """What finds facts in a file; a parser with a grammar can stand in for the walker."""

    name: str
    version: str

    def analyze_file(self, repo: str, branch: str, path: str, content: str, language: str | None) -> list[dict]:
        """Facts of one file, as rows of FACTS; the first one tells the status."""
        ...


def canonical(*parts: str | None) -> str:
    return hashlib.sha256("::".join(p for p in parts if p).encode()).hexdigest()


def namespace_of(path: str) -> str:
    return re.sub(r"\.[^./]+$", "", path).replace("/", ".")


def plain_name(expr: str) -> str:
    """The last name of a call expression, without what stands in angle brackets."""
    if "<" in expr or ">" in expr:
        out, depth = [], 0
        for c in expr:
            depth = depth + 1 if c == "<" else max(0, depth - 1) if c == ">" else depth
            if not depth and c not in "<>":
                out.append(c)
        expr = "".join(out)
    return expr.strip().rstrip(":. ").replace(":", ".").rpartition(".")[2].strip()


@dataclass
class _Scope:
    indent: int
    kind: str
    name: str
    id: str
    row: dict


class Walker:
    """The analyzer for all languages that have rules."""

    name, version = "line-walker", "1"

    def __init__(self) -> None:
        self.symbols = [(r, re.compile(r.pattern)) for r in SYMBOLS]
        self.imports = [(r, re.compile(r.pattern)) for r in IMPORTS]
        self.by_language: dict[str | None, tuple[list, list]] = {}

    def rules_of(self, language: str | None) -> tuple[list, list]:
        """The rules of symbols and of imports of a language."""
        if language not in self.by_language:
            self.by_language[language] = tuple([(r, p) for r, p in rules if language in r.languages] for rules in (self.symbols, self.imports))
        return self.by_language[language]

    def analyze_file(self, repo: str, branch: str, path: str, content: str, language: str | None) -> list[dict]:
        base = {"repo_id": repo, "branch": branch, "path": path, "language": language}
        rules, incl = self.rules_of(language)
        ns = namespace_of(path)
        file_id = canonical(language, repo, ns, path)
        out: list[dict] = [base | {"fact": "file", "status": "COMPLETE", "id": file_id}]
        scopes: list[_Scope] = []
        calls: list[tuple[str, str, str]] = []
        lines = content.splitlines()
        found: list[dict] = []

        def close(scope: _Scope, last: int) -> None:
            while last > scope.row["start_line"] and not lines[last - 1].strip():
                last -= 1
            scope.row["end_line"] = last
            scope.row["content_hash"] = hashlib.sha256("\n".join(lines[scope.row["start_line"] - 1 : last]).encode()).hexdigest()

        for n, line in enumerate(lines, 1):
            body = line.lstrip()
            if not body:
                continue
            indent = len(line) - len(body)
            if not _CLOSES.match(line):
                while scopes and indent <= scopes[-1].indent:
                    close(scopes.pop(), n - 1)
            names = [s.name for s in scopes if s.kind in _TYPES]
            container = "::".join(names)
            here = scopes[-1].id if scopes else file_id
            for r, p in incl:
                if m := p.search(line):
                    target = ".".join(x for x in (m[r.value], m[r.extra] if r.extra else None) if x)
                    found.append({"fact": "import", "start_line": n, "src": here, "dst": canonical("import", language, target), "detail": target})
                    break
            for r, p in rules:  # the first rule that a line meets decides
                if m := p.search(line):
                    name = plain_name(m[r.value]) or m[r.value]
                    kind = "METHOD" if r.kind == "FUNCTION" and names else r.kind
                    ident = canonical(language, repo, ns, container, name)
                    row = {
                        "fact": "symbol", "kind": kind, "id": ident, "name": name, "container": container, "start_line": n, "start_column": indent + 1, "end_line": n, "content_hash": "",
                        "qualified_name": "::".join(x for x in (language, repo, ns, container, name) if x),
                    }
                    found.append(row)
                    if kind != "PACKAGE":
                        scopes.append(_Scope(indent, kind, name, ident, row))
                        here = ident
                    else:
                        row["content_hash"] = hashlib.sha256(line.encode()).hexdigest()
                    break
            for m in _CALL.finditer(line):
                name = plain_name(m[1])
                if name and name not in NO_CALLS:
                    calls.append((here, m[1], container))
                    found.append({"fact": "call", "start_line": n, "src": here, "detail": m[1], "container": container, "name": name})
        while scopes:
            close(scopes.pop(), len(lines))
        defs: dict[str, list[tuple[str, str]]] = {}
        for row in found:
            if row["fact"] == "symbol" and row["kind"] in ("FUNCTION", "METHOD"):
                defs.setdefault(row["name"], []).append((row["container"], row["id"]))
        for row in found:
            if row["fact"] == "call":
                known = defs.get(row["name"], [])
                same = [i for c, i in known if c == row["container"]]
                row["dst"] = same[0] if same else known[0][1] if known else canonical(language, repo, ns, row["container"], row["name"])
                row["resolved"] = "local" if known else "unresolved"
        return out + [base | row for row in found]


class Skipping:
    """A stand-in for an analyzer that is not installed: every file is skipped."""

    def __init__(self, name: str, version: str = "0"):
        self.name, self.version = name, version

    def analyze_file(self, repo: str, branch: str, path: str, content: str, language: str | None) -> list[dict]:
        return [{"fact": "file", "repo_id": repo, "branch": branch, "path": path, "language": language, "status": "SKIPPED"}]


def analyze(files: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """FACTS of files (repo_id, branch, path, language, tier, content).

    One row of each file tells its status: FAILED for an unknown language, SKIPPED for one that is known without grammar,
    else COMPLETE. A null text is an empty one. ``seq`` is the order of arrival within a file.
    """
    analyzer = analyzer or Walker()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for f in batch.to_pylist():
                if f["language"] is None or f["tier"] == 3:
                    got = [{"fact": "file", **{k: f[k] for k in ("repo_id", "branch", "path", "language")}, "status": "SKIPPED" if f["language"] else "FAILED"}]
                else:
                    got = analyzer.analyze_file(f["repo_id"], f["branch"], f["path"], f["content"] or "", f["language"])
                for i, row in enumerate(got):
                    row["seq"] = i
                rows += got
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)

    return files.select("repo_id", "branch", "path", "language", "tier", "content").mapInArrow(run, FACTS)


#: Facts of an Arrow batch, but for those of the file that completes it.
BATCH_ROWS = 4_000


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row.get(f.name) for row in rows], f.type) for f in _SCHEMA], schema=_SCHEMA)


_SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in FACTS.split(", ")])


def analyze_paths(files: DataFrame, allow: list[str] | None = None, analyzer: Analyzer | None = None) -> DataFrame:
    """``analyze`` of the files (repo_id, branch, path, content) that are read at all, in the allowed languages (none: all)."""
    known = detect_languages(files.where(~is_skipped(F.col("path"))))
    return analyze(allowed_languages(known, allow or []), analyzer)


def symbols(facts: DataFrame) -> DataFrame:
    """Symbols as spans for the joins of contracts: file, id, name, kind, container, start, end, seq."""
    s = facts.where("fact = 'symbol'")
    return s.select("repo_id", "branch", F.col("path").alias("file"), "language", "kind", "id", "name", "container", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "seq", "content_hash")


def functions(facts: DataFrame) -> DataFrame:
    return symbols(facts).where("kind in ('FUNCTION', 'METHOD')")


def raw_symbols(facts: DataFrame, sha: str, source: str = "TREE_SITTER") -> DataFrame:
    """Symbols as facts to merge: one row a definition, in order of (path, seq)."""
    s = facts.where("fact = 'symbol'")
    place = F.struct(
        F.col("repo_id").alias("repository"), F.lit(sha).alias("commit_sha"), "path", "start_line", "start_column", "end_line", F.lit(1).alias("end_column"), "branch",
    )
    return s.select(
        "id", F.struct("path", "seq").alias("seq"), F.lit(source).alias("source"), "kind", "name", "qualified_name", "language", place.alias("location"), "content_hash",
        F.create_map().cast("map<string,string>").alias("properties"), F.lit("COMPLETE").alias("status"),
    )


def raw_relations(facts: DataFrame, source: str = "TREE_SITTER") -> DataFrame:
    """Calls and imports as facts to merge; a call tells its callee and whether it was resolved in its file."""
    call = F.col("fact") == "call"
    props = F.when(call, F.create_map(F.lit("callee"), F.col("detail"), F.lit("resolved"), F.col("resolved"))).otherwise(F.create_map(F.lit("import_path"), F.col("detail")))
    return facts.where("fact in ('call', 'import')").select(
        F.when(call, "CALLS").otherwise("IMPORTS").alias("kind"), "src", "dst", F.struct("path", "seq").alias("seq"), F.lit(source).alias("source"), props.alias("properties"), F.lit("COMPLETE").alias("status"),
    )
