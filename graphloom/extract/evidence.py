"""Evidence in files that are no code: API descriptions, deployment files, environment files, readmes.

A file's name and first lines choose its scanner. YAML is read as an outline of (line, indent, key, value) entries, which
the scanners query; there is no YAML library, so flow style and anchors are not followed. A file is scanned alone, in one
pass, and nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import ENV_SUFFIXES, TOPIC_STOPWORDS
from graphloom.operators.links import HTTP_METHODS
from graphloom.sources.registry import DEPLOYMENT_DIRS, is_scannable, is_skipped_path

EVIDENCE = "repo_id string, branch string, file string, seq long, kind string, value string, detail string, target_repo string, channel string, broker string, line int"
_SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in EVIDENCE.split(", ")])
_URL = re.compile(r"""https?://[^\s)\]}"'<>`,]*""")
_ENV_KEY = re.compile(rf"[A-Za-z0-9_.-]*(?:{'|'.join(ENV_SUFFIXES)})", re.IGNORECASE)
_TOPIC = re.compile(r"(?=.*[._-])[A-Za-z0-9._-]{3,}")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Entry:
    """A line of an outline: ``key`` is null for a line that has no colon; ``item`` tells a dash before it."""

    line: int
    indent: int
    key: str | None
    value: str
    item: bool
    text: str


def bare(value: str) -> str:
    return value.strip().strip("\"'").strip()


def outline(content: str) -> list[Entry]:
    """The entries of a text, without blank lines and comments."""
    out = []
    for n, line in enumerate(content.splitlines(), 1):
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        plain = text[1:].lstrip() if text.startswith("-") else text
        key, colon, value = plain.partition(":")
        out.append(Entry(n, len(line) - len(line.lstrip()), key.strip() if colon else None, value, text.startswith("-"), text))
    return out


def below(entries: list[Entry], key: str) -> list[Entry]:
    """The entries under the first one whose line begins with a key."""
    at = next((i for i, e in enumerate(entries) if e.text.startswith(f"{key}:")), None)
    if at is None:
        return []
    rest = entries[at + 1 :]
    end = next((i for i, e in enumerate(rest) if e.indent <= entries[at].indent), len(rest))
    return rest[:end]


def _row(kind: str, value: str, detail: str, line: int, channel: str = "", broker: str = "") -> dict:
    return {"kind": kind, "value": value, "detail": detail, "line": line, "target_repo": "", "channel": channel, "broker": broker}


def _line_of(lines: list[str], needle: str) -> int:
    return next((n for n, x in enumerate(lines, 1) if needle in x), 0)


def _json(content: str, key: str) -> dict:
    try:
        spec = json.loads(content)
    except ValueError:
        return {}
    part = spec.get(key) if isinstance(spec, dict) else None
    return part if isinstance(part, dict) else {}


def openapi(content: str, base: str) -> Iterator[dict]:
    """``VERB /route`` of every operation."""
    if base.endswith(".json"):
        lines = content.splitlines()
        for route, item in _json(content, "paths").items():
            n = _line_of(lines, f'"{route}"')
            for verb, operation in item.items() if isinstance(item, dict) else ():
                if verb in HTTP_METHODS and isinstance(operation, dict):
                    yield _row("OPENAPI", f"{verb.upper()} {route}", lines[n - 1].strip() if n else verb, n)
        return
    route, depth = "", 0
    for e in below(outline(content), "paths"):
        named = bare(e.text.rstrip(":")) if e.text.endswith(":") else ""
        if named.startswith("/"):
            route, depth = named, e.indent
        elif e.indent <= depth:
            route = ""
        elif route and e.text.endswith(":") and e.text[:-1].strip().lower() in HTTP_METHODS:
            yield _row("OPENAPI", f"{e.text[:-1].strip().upper()} {route}", e.text, e.line)


#: Words of a channel's description that tell its broker, in order.
BROKER_WORDS = (("kafka", ("kafka",)), ("rabbitmq", ("amqp", "rabbit")), ("sqs", ("sqs", "sns")), ("pubsub", ("pubsub", "googleapis")))


def broker_of(block: str) -> str:
    low = block.lower()
    return next((b for b, words in BROKER_WORDS if any(w in low for w in words)), "")


def asyncapi(content: str, base: str) -> Iterator[dict]:
    """Every channel, with the broker that its description names."""
    if base.endswith(".json"):
        lines = content.splitlines()
        for name, item in _json(content, "channels").items():
            yield _row("ASYNCAPI", name, f'"{name}"', _line_of(lines, f'"{name}"'), name, broker_of(json.dumps(item)))
        return
    entries = below(outline(content), "channels")
    heads = [i for i, e in enumerate(entries) if e.text.endswith(":")]
    level = entries[heads[0]].indent if heads else 0
    heads = [i for i in heads if entries[i].indent == level]
    for i in heads:
        block = []
        for e in entries[i + 1 :]:
            if e.indent <= level:
                break
            block.append(e.text)
        name = bare(entries[i].text.rstrip(":"))
        if name:
            yield _row("ASYNCAPI", name, entries[i].text, entries[i].line, name, broker_of("\n".join(block)))


def is_env_key(key: str) -> bool:
    return bool(_ENV_KEY.fullmatch(key.strip().strip("\"'")))


def _setting(kind: str, key: str, value: str, detail: str, line: int) -> Iterator[dict]:
    up = key.upper()
    if not value.strip():
        return
    words = (("KAFKA", "kafka"), ("RABBIT", "rabbitmq"), ("AMQP", "rabbitmq"), ("SQS", "sqs"), ("PUBSUB", "pubsub"))
    broker = next((b for w, b in words if w in up), "kafka" if up.endswith("_BOOTSTRAP_SERVERS") else "")
    yield _row(kind, value, detail, line, value.strip() if up.endswith(("_TOPIC", "_QUEUE")) else "", broker)


def urls(line: str) -> Iterator[str]:
    for u in _URL.findall(line):
        u = u.rstrip(".;:")
        if len(u) > len("https://" if u.startswith("https://") else "http://"):
            yield u


#: Lines after a name in which its value may stand.
LOOK_AHEAD = 6


def deployment(content: str, base: str) -> Iterator[dict]:
    """Images, URLs, settings, topics, bootstrap servers, and hosts with paths of a deployment or compose file."""
    kind = "DOCKER_COMPOSE" if base.startswith("docker-compose") else "KUBERNETES"
    entries, host = outline(content), ""
    for i, e in enumerate(entries):
        value = bare(e.value)
        if e.key == "image" and value and value[0] not in "$#":
            yield _row(kind, value, e.text, e.line)
        for u in urls(e.text):
            yield _row(kind, u, e.text, e.line)
        if e.key == "name" and is_env_key(value):
            for later in entries[i + 1 :]:
                if later.line > e.line + LOOK_AHEAD or later.key == "name":
                    break
                if later.key == "value":
                    yield from _setting(kind, value, bare(later.value), e.text, e.line)
                    break
        plain = e.text.removeprefix("-").strip()
        key, given, rest = plain.partition("=")
        if not (given and is_env_key(key)):
            key, given, rest = plain.partition(":")
        if given and is_env_key(key):
            yield from _setting(kind, key, bare(rest), e.text, e.line)
        if e.key == "topic" and value:
            yield _row(kind, value, e.text, e.line, value, "kafka")
        if re.search(r"bootstrap[._]servers", e.text.lower()) and ":" in e.text and bare(e.text.partition(":")[2]):
            yield _row(kind, bare(e.text.partition(":")[2]), e.text, e.line, "", "kafka")
        if e.key == "host":
            host = value if value and " " not in value and not value.startswith("$") else host
        elif e.key == "path" and host and value.startswith("/"):
            yield _row(kind, f"{host} {value}", e.text, e.line)


def environment(content: str, base: str) -> Iterator[dict]:
    """``KEY=value`` and ``KEY: value`` of keys that name a target."""
    for n, line in enumerate(content.splitlines(), 1):
        text = line.strip()
        key, given, value = text.partition("=") if "=" in text else text.partition(":")
        if given and text[0] not in "#;" and is_env_key(key):
            yield from _setting("ENV_FILE", key, bare(value), text, n)


def readme(content: str, base: str) -> Iterator[dict]:
    """URLs, routes in backticks, and words shaped like topics on lines that speak of topics or queues."""
    for n, line in enumerate(content.splitlines(), 1):
        text = line.strip()
        for u in urls(text):
            yield _row("README", u, text, n)
        for span in (s.strip() for s in re.findall("`([^`]*)`", text)):
            if span.startswith("/") and " " not in span:
                yield _row("README", span, text, n)
        if "topic" in text.lower() or "queue" in text.lower():
            for word in (w.strip(_PUNCTUATION) for w in text.split()):
                if _TOPIC.fullmatch(word) and word.lower() not in TOPIC_STOPWORDS:
                    yield _row("README", word, text, n, word)


def _marked(content: str, marker: str) -> bool:
    return any(line.startswith(marker) for line in content.splitlines()[:40])


def _env_file(base: str) -> bool:
    ext = base.rpartition(".")[2] if "." in base else ""
    named = base.startswith(".env") or base.endswith(".env") or re.match(r"(?:application|config)(?:$|[.-])", base) or ext == "properties"
    return bool(named) and ext in ("yml", "yaml", "properties", "env", "local", "")


def scanner_of(path: str, content: str) -> Callable[[str, str], Iterator[dict]] | None:
    """The scanner of a file by its path and first lines; null if it is no evidence."""
    lower = path.replace("\\", "/").lower()
    base = lower.rpartition("/")[2]
    yaml, spec = base.endswith((".yml", ".yaml")), base.endswith(".json")
    if (yaml or spec) and (base.startswith("openapi") or "swagger" in base or _marked(content, "openapi:") or _marked(content, "swagger:")):
        return openapi
    if (yaml and _marked(content, "asyncapi:")) or (spec and '"asyncapi":' in content):
        return asyncapi
    if yaml and (any(d in lower for d in DEPLOYMENT_DIRS) or base.startswith(("deployment", "values", "docker-compose"))):
        return deployment
    if _env_file(base):
        return environment
    return readme if base.startswith("readme") or lower.startswith("docs/") or "/docs/" in lower else None


def scan(files: DataFrame) -> DataFrame:
    """EVIDENCE of files (repo_id, branch, path, content) in the order of their lines; files that are no evidence give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                content = f["content"] or ""
                scanner = scanner_of(f["path"], content)
                rows = [
                    {"repo_id": f["repo_id"], "branch": f["branch"], "file": f["path"], "seq": i, **row}
                    for i, row in enumerate(scanner(content, f["path"].replace("\\", "/").lower().rpartition("/")[2]) if scanner else ())
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    wanted = files.where(~is_skipped_path(F.col("path")) & is_scannable(F.col("path")))
    return wanted.select("repo_id", "branch", "path", "content").mapInArrow(run, EVIDENCE)
