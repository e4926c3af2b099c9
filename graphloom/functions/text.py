"""Scalar functions over routes, URLs, resource identities and source lines (native column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import ascii_lower, trimmed

#: Routes that say nothing about a service, besides the root.
GENERIC_ROUTES = ("/health", "/healthz", "/ready", "/readiness", "/live", "/metrics", "/favicon.ico")
#: URI schemes that name one database each, and default ports.
SCHEME_ALIASES = {"postgresql": "postgres", "pgsql": "postgres", "mariadb": "mysql", "mssql": "sqlserver", "rediss": "redis", "amqps": "amqp", "mongodb+srv": "mongodb", "cockroachdb": "cockroach"}
DEFAULT_PORTS = {"postgres": "5432", "mysql": "3306", "mongodb": "27017", "redis": "6379", "clickhouse": "8123", "sqlserver": "1433", "amqp": "5672", "cockroach": "26257"}
#: Classes of resources, and the edges that an access gives.
RESOURCE_TYPES = ("database", "bucket", "function", "dataset", "table", "api")
ACCESS_KINDS = {"read": "READS_FROM", "write": "WRITES_TO", "invoke": "INVOKES", "connect": "CONNECTS_TO", "query": "QUERIES"}
#: Words that tell a writing or a reading access.
WRITE_WORDS = ("putobject", "putitem", "putrecord", "putrequest", "write", "insert", "update", "delete", "upload", "overwrite", "copy", "remove", "save")
READ_WORDS = ("getobject", "getitem", "getrecord", "getrequest", "select", "read", "fetch", "download", "list", "scan", "load", "head", "describe", "retrieve", "exists")
#: Endings of environment keys that name a target.
ENV_SUFFIXES = ("_URL", "_URI", "_ENDPOINT", "_TOPIC", "_QUEUE", "_BROKER", "_BOOTSTRAP_SERVERS", "_HOST")
#: Words of prose that are no topics.
TOPIC_STOPWORDS = (
    "topic", "topics", "queue", "queues", "endpoint", "endpoints", "api", "apis", "kafka", "rabbitmq", "amqp", "sqs", "pubsub", "broker", "brokers", "rest", "grpc", "url", "uri", "http",
    "https", "and", "the", "for", "with", "from", "this", "that", "using", "used", "see", "when", "what", "where",
)


def _or(c: Column, *others: Column) -> Column:
    """The first of several texts that is not empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (c, *others)], F.lit(""))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def unify_segment(s: Column) -> Column:
    """``*`` for a placeholder in any notation, else the segment."""
    star = s.contains("*") | (s.contains("{") & s.contains("}")) | s.rlike("^<.+>$") | s.rlike("^:.+$")
    return F.when(star, F.lit("*")).otherwise(s)


def route_segments(raw: Column) -> Column:
    r = F.regexp_replace(trimmed(raw), "^[\"'`]+|[\"'`]+$", "")
    r = F.regexp_replace(F.regexp_replace(r, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.transform(F.filter(F.split(r, "/", -1), lambda s: s != ""), unify_segment)


def normalize_route(raw: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(route_segments(raw), "/"))


def is_generic_route(route: Column) -> Column:
    out = route == "/"
    for r in GENERIC_ROUTES:
        out = out | route.endswith(r)
    return out


def segments_match(a: Column, b: Column) -> Column:
    """Equal length, and each pair equal or one side a wildcard."""
    pair = F.zip_with(a, b, lambda x, y: (x == y) | (x == "*") | (y == "*"))
    return (F.size(a) == F.size(b)) & F.forall(pair, lambda z: F.coalesce(z, F.lit(False)))


def routes_match(a: Column, b: Column) -> Column:
    return ~is_generic_route(a) & ~is_generic_route(b) & ((a == b) | segments_match(F.split(F.substring(a, 2, 1 << 20), "/", -1), F.split(F.substring(b, 2, 1 << 20), "/", -1)))


def has_template(s: Column) -> Column:
    return s.rlike(r"\$\{|\$\(|\{\{")


def url_host(url: Column) -> Column:
    """host[:port] of a URL, lower-cased; empty without a scheme."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]+)", 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?(/[^?#]*)?", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def tail_segment(s: Column) -> Column:
    return F.regexp_extract(s, r"([^/]*)/*$", 1)


def strip_template_prefix(s: Column) -> Column:
    return F.regexp_replace(s, r"^(?:\$\{[^}]*\}|\$\([^)]*\)|\{\{[^}]*\}\})", "")


def first_segment(path: Column) -> Column:
    return F.regexp_extract(path, r"^/*([^/?#]*)", 1)


def http_host(low: Column) -> Column:
    """What stands between http(s):// and the path, as it is."""
    return F.regexp_extract(low, r"^https?://([^/?#]*)", 1)


def http_path(low: Column) -> Column:
    return F.regexp_extract(low, r"(?s)^https?://[^/?#]*(.*)$", 1)


def bare_host(hostport: Column) -> Column:
    """A host without its numeric port; brackets of an IPv6 address stay."""
    inside = F.regexp_extract(hostport, r"^([^\]]*\])", 1)
    return F.when(inside != "", inside).otherwise(F.regexp_replace(hostport, r":[0-9]+$", ""))


def port_of(hostport: Column) -> Column:
    """The port after a host or a bracketed address; empty without one."""
    inside = F.regexp_extract(hostport, r"^([^\]]*\])", 1)
    return F.when(inside != "", F.regexp_extract(hostport, r"\]:(.+)$", 1)).otherwise(F.regexp_extract(hostport, r":([0-9]+)$", 1))


def bucket_identity(raw: Column) -> Column:
    low = ascii_lower(trimmed(raw))
    host, path = http_host(low), http_path(low)
    gcs, s3 = F.regexp_extract(host, r"^(.+)\.storage\.googleapis\.com$", 1), F.regexp_extract(host, r"^(.+?)\.s3\.", 1)
    named = F.when(gcs != "", gcs).when(s3 != "", s3).when(host.startswith("s3.") | (host == "storage.googleapis.com"), first_segment(path)).otherwise(_or(first_segment(path), host))
    scheme = F.regexp_extract(low, r"(?s)^(?:s3|gs|azblob)://(.*)$", 1)
    return F.when(low.rlike("^(?:s3|gs|azblob)://"), first_segment(scheme)).when(low.rlike("^https?://"), named).otherwise(first_segment(low))


def keyword_dsn(s: Column) -> Column:
    """host[:port][/db] of a list of key=value pairs; the last of several spellings of a key counts, quoted values stay whole."""
    tokens = F.regexp_extract_all(s, F.lit(r'((?:"[^"]*"?|[^;&\s"])+)'), F.lit(1))
    pairs = F.transform(F.filter(tokens, lambda t: t.contains("=")), lambda t: F.struct(
        trimmed(F.substring_index(t, "=", 1)).alias("k"), F.regexp_replace(trimmed(F.regexp_extract(t, r"(?s)^[^=]*=(.*)$", 1)), '^"+|"+$', "").alias("v")))

    def value(*keys: str) -> Column:
        known = F.filter(pairs, lambda p: p["k"].isin(*keys) & (p["v"] != ""))
        return F.when(F.size(known) > 0, F.element_at(known, -1)["v"]).otherwise("")

    host, port, db = value("host", "hostname", "server"), value("port"), value("dbname", "database", "db", "defaultdb")
    whole = F.concat(host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), F.when(db != "", F.concat(F.lit("/"), db)).otherwise(""))
    return F.when(host == "", s).otherwise(whole)


def database_identity(raw: Column) -> Column:
    """scheme://host[:port]/db in one spelling: no userinfo, no default port, no query."""
    s = F.regexp_replace(ascii_lower(trimmed(raw)), "^jdbc:", "")
    given = F.regexp_extract(s, r"(?s)^(.*?)://", 1)
    scheme = F.coalesce(_lookup(SCHEME_ALIASES, given), given)
    rest = F.regexp_extract(s, r"(?s)^.*?://(.*)$", 1)
    hostport = F.substring_index(F.regexp_extract(rest, r"^([^/?#]*)", 1), "@", -1)
    host, port = bare_host(hostport), port_of(hostport)
    shown = F.when((port == "") | (port == F.coalesce(_lookup(DEFAULT_PORTS, scheme), F.lit("-"))), "").otherwise(F.concat(F.lit(":"), port))
    db = F.regexp_replace(F.substring_index(F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1), "?", 1), "/+$", "")
    uri = F.when(host == "", "").otherwise(F.concat(scheme, F.lit("://"), host, shown, db))
    tail = F.regexp_replace(F.substring_index(s, "@", -1), "^/+", "")
    return F.when(s.contains("://"), uri).when(s.contains("host="), keyword_dsn(s)).when(s.contains("@"), tail).otherwise(s)


def function_identity(raw: Column) -> Column:
    low = ascii_lower(trimmed(raw))
    host, seg = http_host(low), first_segment(http_path(low))
    cloud = F.when(host.endswith(".cloudfunctions.net") & (seg != ""), F.concat_ws("/", host, seg)).otherwise(host)
    return _or(F.regexp_extract(low, r"^.*?:function:([^:]*)", 1), cloud, low)


def table_identity(raw: Column) -> Column:
    low = ascii_lower(trimmed(raw))
    return _or(F.regexp_extract(low, r"^.*?:table/([^/]*)", 1), low)


def api_identity(raw: Column) -> Column:
    low = ascii_lower(trimmed(raw))
    return F.when(http_host(low) != "", http_host(low)).when(low.startswith("/"), normalize_route(low)).otherwise(low)


def normalize_identity(kind: Column, raw: Column) -> Column:
    """The identity of a resource by its class, in one spelling and without credentials; null where nothing is left."""
    k = ascii_lower(trimmed(kind))
    out = (
        F.when(k == "bucket", bucket_identity(raw)).when(k == "database", database_identity(raw)).when(k == "function", function_identity(raw))
        .when(k == "table", table_identity(raw)).when(k == "api", api_identity(raw)).otherwise(ascii_lower(trimmed(raw)))
    )
    return F.nullif(trimmed(out), F.lit(""))


def resource_edge_kind(access: Column) -> Column:
    return _lookup(ACCESS_KINDS, ascii_lower(trimmed(access)))


def infer_access(line: Column, default: str) -> Column:
    """write if a writing word occurs among the letters and digits of a line, else read, else the default."""
    plain = F.regexp_replace(ascii_lower(line), "[^a-z0-9]+", "")
    return F.when(plain.rlike("|".join(WRITE_WORDS)), F.lit("write")).when(plain.rlike("|".join(READ_WORDS)), F.lit("read")).otherwise(F.lit(default))


QUOTED = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)"""


def quoted_strings(line: Column) -> Column:
    """Contents of all closed quotes, escapes resolved."""
    found = F.regexp_extract_all(line, F.lit(QUOTED), F.lit(1))
    return F.transform(found, lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))


def first_quoted(line: Column) -> Column:
    return F.get(quoted_strings(line), 0)


def find_urls(line: Column) -> Column:
    """http(s) URLs up to a delimiter, without closing punctuation."""
    found = F.regexp_extract_all(line, F.lit(r"""(https?://[^\s"'`<>)\]},]*)"""), F.lit(1))
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, "[.;:]+$", "")), lambda u: u.rlike("^https?://."))


def is_env_name(s: Column) -> Column:
    return s.rlike("^[A-Z0-9_]{1,128}$") & s.rlike("[A-Z]")


def extract_env_vars(line: Column) -> Column:
    """Names of ``${X}``, ``$(X)`` and ``$X`` in their order."""
    found = F.regexp_extract_all(line, F.lit(r"\$(?:\{[^}]*\}|\([^)]*\)|[A-Za-z_][A-Za-z0-9_]*)"), F.lit(0))
    return F.filter(F.transform(found, lambda v: F.regexp_replace(v, r"^\$[{(]?\s*|\s*[})]$", "")), is_env_name)


def env_var_kind(name: Column) -> Column:
    """The class of resource that an environment variable's name tells; null if none."""
    low = ascii_lower(name)
    return (
        F.when(low.contains("bucket"), F.lit("bucket")).when(low.contains("function"), F.lit("function"))
        .when(low.rlike("url|uri|dsn|database|db_|_db$|host|sql|mongo|redis"), F.lit("database")).when(low.contains("dataset"), F.lit("dataset")).otherwise(F.lit(None).cast("string"))
    )


def is_env_key(raw: Column) -> Column:
    key = F.regexp_replace(trimmed(raw), "^[\"']+|[\"']+$", "")
    return key.rlike("^[A-Za-z0-9_.-]+$") & F.upper(key).rlike("(?:" + "|".join(ENV_SUFFIXES) + ")$")


def env_channel(key: Column, value: Column) -> Column:
    return F.when(F.upper(key).rlike("(?:_TOPIC|_QUEUE)$"), trimmed(value)).otherwise("")


def env_broker(key: Column) -> Column:
    up = F.upper(key)
    return (
        F.when(up.contains("KAFKA"), "kafka").when(up.rlike("RABBIT|AMQP"), "rabbitmq").when(up.contains("SQS"), "sqs").when(up.contains("PUBSUB"), "pubsub")
        .when(up.endswith("_BOOTSTRAP_SERVERS"), "kafka").otherwise("")
    )


def backtick_spans(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("`([^`]*)`"), F.lit(1))


def topic_shaped(token: Column) -> Column:
    """At least three characters of names with a dot, dash or underscore, and none of the stop words."""
    return token.rlike("^[A-Za-z0-9._-]{3,}$") & token.rlike("[._-]") & ~ascii_lower(token).isin(*TOPIC_STOPWORDS)


def call_sites(line: Column) -> Column:
    """struct(receiver, method) of every ``receiver.method(``."""
    p = F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)\.([A-Za-z_$][A-Za-z0-9_$]*)\s*\(")
    return F.arrays_zip(F.regexp_extract_all(line, p, F.lit(1)).alias("receiver"), F.regexp_extract_all(line, p, F.lit(2)).alias("method"))


def word_at(line: Column, word: str) -> Column:
    """Position from 1 of a word that no identifier goes on around; 0 without one."""
    return F.length(F.regexp_extract(line, rf"(?s)^(.*?)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])", 1)) + F.when(line.rlike(rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"), 1).otherwise(0)


def receiver_before(line: Column, call: str) -> Column:
    """The identifier before ``.call``."""
    return F.regexp_extract(line, rf"([A-Za-z_$][A-Za-z0-9_$]*)\.{call}\b", 1)


def handler_hint(line: Column, after: Column) -> Column:
    """The last identifier that follows a quoted value on its line: the handler that is passed along."""
    rest = F.call_function("substring_index", line, after, F.lit(-1))
    return F.nullif(F.regexp_extract(rest, r"""^["'`]\s*,\s*(?:.*,\s*)?(?:[A-Za-z_$][A-Za-z0-9_$]*(?:\.|::))*([A-Za-z_$][A-Za-z0-9_$]*)\s*\)""", 1), F.lit(""))


def arg_quoted(line: Column, key: str) -> Column:
    """The quoted value of a keyword argument, whatever its case and underscores; null without one."""
    snake = "".join(f"_{c.lower()}" if c.isupper() and i else c.lower() for i, c in enumerate(key))
    found = []
    for k in dict.fromkeys((key.lower(), key.lower().replace("_", ""), snake)):
        after = F.regexp_extract(line, rf"(?is)^(?:(?!{k}).)*{k}(?=\s*_*\s*[:=(])(.*)$", 1)
        found.append(first_quoted(after))
    return F.coalesce(*found)


def dataset_ref(s: Column) -> Column:
    """Whether a text is a dataset's two names."""
    return s.rlike(r"^(?=[^.]*[A-Za-z])[A-Za-z0-9_-]+\.(?=[^.]*[A-Za-z])[A-Za-z0-9_-]+$")


def table_ref(s: Column) -> Column:
    """project.dataset.table of a query's first backticked name or of a bare text; null if it is none."""
    name = F.when(s.contains("`"), F.regexp_extract(s, "`([^`]*)`", 1)).otherwise(trimmed(s))
    return F.when(name.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"), name)


def table_refs(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(line, "`", ""), F.lit(r"(?i)\b(?:from|join|into|update|table)\s+([A-Za-z_][\w-]*\.[\w.-]*\w)"), F.lit(1)))


def last_segment(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.:]*)$", 1)


def namespace_for_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "/", ".")


def qualified_name(language: Column, repo: Column, namespace: Column, container: Column, symbol: Column) -> Column:
    return F.concat_ws("::", *[F.nullif(c, F.lit("")) for c in (language, repo, namespace, container, symbol)])


def strip_generics(name: Column) -> Column:
    """A name without what stands in angle brackets, however deep: characters outside, by a running count of open brackets."""
    zero = F.struct(F.lit(0).alias("d"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        d = F.when(c == "<", acc["d"] + 1).when((c == ">") & (acc["d"] > 0), acc["d"] - 1).otherwise(acc["d"])
        shown = (acc["d"] == 0) & (c != "<") & (c != ">")
        return F.struct(d.alias("d"), F.when(shown, F.concat(acc["out"], c)).otherwise(acc["out"]).alias("out"))

    return F.when(name.contains("<"), F.aggregate(F.split(name, ""), zero, step, lambda acc: acc["out"])).otherwise(name)


def base_name(expr: Column) -> Column:
    """The last name of a call expression."""
    return trimmed(last_segment(F.regexp_replace(trimmed(strip_generics(expr)), "[:. ]+$", "")))


def safe_segment(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9._-]", "_")


def repo_name_from_url(url: Column) -> Column:
    return F.regexp_replace(tail_segment(F.regexp_replace(url, "/+$", "")), r"\.git$", "")


def branch_from_ref(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, "^refs/heads/(.+)$", 1), F.lit(""))


def broker_mechanism(broker: Column) -> Column:
    """The mechanism that a broker's name stands for, else the name."""
    b = ascii_lower(trimmed(broker))
    return F.when(b.isin("rabbitmq", "rabbit", "amqp"), F.lit("rabbitmq")).when(b.isin("pubsub", "gcp_pubsub", "google_pubsub"), F.lit("pubsub")).otherwise(b)


def infer_channel_type(broker: Column) -> Column:
    return F.when(ascii_lower(broker).rlike("rabbit|amqp|sqs"), F.lit("queue")).otherwise(F.lit("topic"))
