"""What source lines tell, as declarative rules: symbols, imports, calls, routes, channels, resources, evidence.

Files (repo_id, branch, path, language, content) are cut into lines, and every rule is one regular expression over a
line. Rules are plain data: more languages and frameworks are more rows. Without a grammar, nesting is told by braces or
indentation in a line window, which is right for conventionally formatted code only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.functions.ids import canonical_id
from graphloom.operators.joins import enclosing, resolve_handlers

W = r"[A-Za-z_$][A-Za-z0-9_$]*"
Q = r"""["'`]([^"'`]*)["'`]"""


@dataclass(frozen=True)
class Rule:
    """languages (empty: all), what a match is (kind and constants), pattern, and the groups that hold its values."""

    languages: tuple[str, ...]
    kind: str
    pattern: str
    value: int = 1
    extra: int = 0
    constant: str = ""
    gate: str = ""  # the file must contain this


W0 = r"[A-Za-z0-9_$]*"
#: Languages with gRPC clients, methods that are no calls of a service, verbs.
GRPC_LANGUAGES = ("java", "kotlin", "python", "javascript", "typescript", "go", "rust", "csharp")
GRPC_COMMON = ("get", "post", "put", "delete", "send", "recv", "new", "clone", "ok", "len", "to", "from", "eq", "ne", "fmt", "print", "call", "wait", "drop", "iter")
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
JS = ("javascript", "typescript", "vue", "svelte")
JVM = ("java", "kotlin")
SYMBOLS = (
    Rule(("python",), "CLASS", rf"^\s*class\s+({W})"), Rule(("python",), "FUNCTION", rf"^\s*(?:async\s+)?def\s+({W})"),
    Rule(("rust",), "FUNCTION", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+({W})"), Rule(("rust",), "CLASS", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+({W})"),
    Rule(("rust",), "INTERFACE", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+({W})"), Rule(("rust",), "MODULE", rf"^\s*(?:pub\s+)?mod\s+({W})"),
    Rule(JS, "FUNCTION", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+({W})"), Rule(JS, "FUNCTION", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({W})\s*=\s*(?:async\s*)?(?:function|\([^)]*\)\s*(?::[^=]+)?=>|{W}\s*=>)"),
    Rule(JS, "CLASS", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({W})"), Rule(("typescript",), "INTERFACE", rf"^\s*(?:export\s+)?interface\s+({W})"), Rule(("typescript",), "CLASS", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+({W})"),
    Rule(JS, "METHOD", rf"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)({W})\s*\([^)]*\)\s*(?::[^{{]+)?\{{"),
    Rule(("go",), "FUNCTION", rf"^func\s+({W})\s*[\[(]"), Rule(("go",), "METHOD", rf"^func\s*\([^)]*\)\s*({W})\s*\("), Rule(("go",), "CLASS", rf"^type\s+({W})\s+struct"), Rule(("go",), "INTERFACE", rf"^type\s+({W})\s+interface"), Rule(("go",), "PACKAGE", rf"^package\s+({W})"),
    Rule(("java", "csharp", "kotlin", "scala", "php", "swift", "dart", "cpp"), "CLASS", rf"^\s*(?:[a-z]+\s+)*(?:class|enum|record|struct|object)\s+({W})"), Rule(("java", "csharp", "kotlin", "swift", "php"), "INTERFACE", rf"^\s*(?:[a-z]+\s+)*(?:interface|protocol)\s+({W})"),
    Rule(("java", "csharp"), "METHOD", rf"^\s+(?:(?:public|private|protected|internal|static|final|async|override|virtual|abstract|synchronized)\s+)+[\w<>\[\],.? ]+\s+({W})\s*\("),
    Rule(("java", "kotlin", "scala"), "PACKAGE", r"^\s*package\s+([\w.]+)"), Rule(("kotlin", "swift"), "FUNCTION", rf"^\s*(?:[a-z]+\s+)*fun(?:c)?\s+(?:<[^>]*>\s*)?(?:{W}\.)?({W})\s*[(<]"),
    Rule(("ruby",), "FUNCTION", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)"), Rule(("ruby",), "CLASS", r"^\s*class\s+([A-Z]\w*)"), Rule(("ruby",), "MODULE", r"^\s*module\s+([A-Z]\w*)"), Rule(("php",), "FUNCTION", rf"^\s*(?:[a-z]+\s+)*function\s+({W})"),
    Rule(("elixir",), "FUNCTION", r"^\s*defp?\s+([a-z_]\w*[?!]?)"), Rule(("elixir",), "MODULE", r"^\s*defmodule\s+([\w.]+)"), Rule(("scala",), "FUNCTION", rf"^\s*(?:[a-z]+\s+)*def\s+({W})"), Rule(("shell",), "FUNCTION", r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)"),
    Rule(("lua",), "FUNCTION", r"^\s*(?:local\s+)?function\s+([\w.:]+)"), Rule(("c", "cpp"), "FUNCTION", r"^(?:[A-Za-z_][\w:<>,*& ]*\s+)[*&]*([A-Za-z_][\w:~]*)\s*\([^;]*\)\s*\{?\s*$"), Rule(("proto",), "INTERFACE", rf"^\s*service\s+({W})"), Rule(("proto",), "CLASS", rf"^\s*message\s+({W})"),
    Rule(("sql",), "CLASS", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)"), Rule(("terraform", "hcl"), "CLASS", r'^\s*resource\s+"([^"]+)"'), Rule(("julia",), "FUNCTION", r"^\s*function\s+([\w!]+)"), Rule(("r",), "FUNCTION", r"^\s*([\w.]+)\s*(?:<-|=)\s*function\b"), Rule(("zig",), "FUNCTION", rf"^\s*(?:pub\s+)?fn\s+({W})"),
)
IMPORTS = (
    Rule(("python",), "IMPORTS", r"^\s*(?:from\s+([\w.]+)\s+)?import\s+([\w.*]+)", 1, 2), Rule(JS, "IMPORTS", rf"^\s*import\b.*?from\s*{Q}"), Rule(JS, "IMPORTS", rf"\brequire\(\s*{Q}"), Rule(("rust",), "IMPORTS", r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    Rule(("go",), "IMPORTS", rf"^\s*(?:import\s+)?(?:{W}\s+)?\"([\w./-]+)\"\s*$"), Rule(("java", "kotlin", "scala"), "IMPORTS", r"^\s*import\s+(?:static\s+)?([\w.*]+)"), Rule(("csharp",), "IMPORTS", r"^\s*using\s+([\w.]+)\s*;"), Rule(("ruby",), "IMPORTS", rf"^\s*require(?:_relative)?\s+{Q}"), Rule(("php",), "IMPORTS", r"^\s*use\s+([\w\\]+)"), Rule(("c", "cpp"), "IMPORTS", r'^\s*#\s*include\s*[<"]([^>"]+)'),
)
#: Routes that a service offers; the constant is the verb where the pattern does not tell it.
PROVIDES = (
    Rule(("python",), "rest", rf"@\w+\.(get|post|put|delete|patch|head|options)\(\s*{Q}", 2, 1), Rule(("python",), "rest", rf"@\w+\.route\(\s*{Q}(?:.*methods\s*=\s*\[\s*[\"'](\w+))?", 1, 2), Rule(("python",), "websocket", rf"@\w+\.websocket\(\s*{Q}"),
    Rule(JVM, "rest", rf"@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\{{?\s*{Q}", 2, 1), Rule(JS, "rest", rf"@(Get|Post|Put|Delete|Patch)\(\s*{Q}", 2, 1),
    Rule(JS, "rest", rf"\b(?:app|router|server|api|routes?)\.(get|post|put|delete|patch|all)\(\s*{Q}", 2, 1), Rule(JS, "websocket", rf"\bapp\.ws\(\s*{Q}"), Rule(("go",), "rest", rf"\b(?:r|router|mux|e|g|group|api|app|engine)\.(GET|POST|PUT|DELETE|PATCH|Get|Post|Put|Delete|Patch)\(\s*{Q}", 2, 1),
    Rule(("go",), "rest", rf"\bHandle(?:Func)?\(\s*{Q}"), Rule(("rust",), "rest", rf"#\[(get|post|put|delete|patch)\(\s*{Q}", 2, 1), Rule(("rust",), "rest", rf"\.route\(\s*{Q}\s*,\s*(?:web::)?(get|post|put|delete|patch)", 1, 2), Rule(("ruby",), "rest", rf"^\s*(get|post|put|delete|patch)\s+{Q}", 2, 1),
    Rule(("csharp",), "rest", rf"\[Http(Get|Post|Put|Delete|Patch)\(\s*{Q}", 2, 1),
)
CONSUMES = (
    Rule(JS, "rest", rf"\bfetch\(\s*{Q}"), Rule(JS, "rest", rf"\b(?:axios|http|client|ky)\.(get|post|put|delete|patch|head|options)\(\s*{Q}", 2, 1), Rule(JS, "rest", rf"\baxios\(.*\burl:\s*{Q}"), Rule(JS, "websocket", rf"\bnew\s+WebSocket\(\s*{Q}"), Rule(JS, "sse", rf"\bnew\s+EventSource\(\s*{Q}"),
    Rule(JS, "websocket", rf"(?<![\w.])io\(\s*{Q}", gate="socket.io"),
    Rule(("python",), "rest", rf"\b(?:requests|session|sess|client|httpx|aiohttp|http)\.(get|post|put|delete|patch|head|options)\(\s*f?{Q}", 2, 1), Rule(("python",), "rest", rf"\burlopen\(\s*f?{Q}"), Rule(("python",), "websocket", rf"\bwebsockets\.connect\(\s*f?{Q}"),
    Rule(("go",), "rest", rf"\b(?:client|c|hc|http|resty|req|cl|s)\.(Get|Post|Head)\(\s*{Q}", 2, 1), Rule(("go",), "rest", rf"\bNewRequest(?:WithContext)?\([^\"]*\"(\w+)\"\s*,\s*{Q}", 2, 1), Rule(("rust",), "rest", rf"\.(get|post|put|delete|patch)\(\s*{Q}", 2, 1, gate="reqwest"),
    Rule(JVM, "rest", rf"\b(get|post|put|delete|patch)For(?:Object|Entity)\(\s*{Q}", 2, 1), Rule(JVM, "rest", rf"\.uri\(\s*{Q}"), Rule(("ruby",), "rest", rf"\b(?:HTTParty|RestClient|HTTP|Faraday)\.(get|post|put|delete|patch)\(?\s*{Q}", 2, 1), Rule(("csharp",), "rest", rf"\b(Get|Post|Put|Delete)(?:String|FromJson|AsJson)?Async\(\s*\$?{Q}", 2, 1),
    Rule(GRPC_LANGUAGES, "grpc", rf"\b(?i:{W}stub{W0}|stub{W0}|client|c|cc|svc|conn)\.(?!(?i:{'|'.join(GRPC_COMMON)})\s*\()({W})\s*\(", gate="grpc|_pb2|tonic"),
    Rule((), "json_rpc", rf"(?:\.call|makeRequest|client\.request)\(.*?{Q}", gate="jsonrpc|json-rpc"), Rule((), "json_rpc", rf"\bmethod:\s*(?![\"'`](?:{'|'.join(VERBS)})[\"'`]){Q}", gate="jsonrpc|json-rpc"),
)
#: Methods that a JSON-RPC server registers, with the handler that follows the name.
REGISTERED = (Rule((), "json_rpc", rf"(?:add_method|addMethod|create_method|register_method|server\.method)\(\s*{Q}", gate="jsonrpc|json-rpc"),)
CHANNELS = (
    Rule((), "subscribe", rf"@KafkaListener\([^)]*topics\s*=\s*\{{?\s*{Q}", constant="kafka", gate="kafka"), Rule((), "publish", rf"\b(?:kafkaTemplate|producer)\.send\(\s*(?:\{{\s*topic:\s*)?{Q}", constant="kafka", gate="kafka"), Rule((), "subscribe", rf"\b(?:KafkaConsumer|subscribe)\(\s*(?:\{{\s*topics?:\s*)?\[?\s*{Q}", constant="kafka", gate="kafka"),
    Rule((), "publish", rf"\b(?:basic_publish|basicPublish|sendToQueue|convertAndSend)\(.*?{Q}", constant="rabbitmq"), Rule((), "subscribe", rf"\b(?:basic_consume|basicConsume|channel\.consume|assertQueue)\(.*?{Q}", constant="rabbitmq"), Rule((), "subscribe", rf"@RabbitListener\([^)]*queues\s*=\s*\{{?\s*{Q}", constant="rabbitmq"),
    Rule((), "publish", rf"send_?[mM]essage\(.*?QueueUrl\s*[:=]\s*{Q}", constant="sqs"), Rule((), "subscribe", rf"receive_?[mM]essage\(.*?QueueUrl\s*[:=]\s*{Q}", constant="sqs"), Rule((), "publish", rf"\btopic_path\([^,]*,\s*{Q}", constant="pubsub"), Rule((), "subscribe", rf"\bsubscription_path\([^,]*,\s*{Q}", constant="pubsub"),
    Rule((), "publish", rf"\.topic\(\s*{Q}\s*\)", constant="pubsub", gate="pubsub"),
)


def _flag(marker: str) -> str:
    return "__has_" + "".join(c if c.isalnum() else f"_{ord(c)}_" for c in marker)


def lines_of(files: DataFrame, markers: tuple[str, ...] = ()) -> DataFrame:
    """repo_id, branch, path, language, line (from 1), text, and a flag of the file for each marker that its text may hold.

    Flags are found once a file, before it is cut; a line carries no other part of its file.
    """
    low = F.lower("content")
    flags = [F.contains(low, F.lit(m)).alias(_flag(m)) for m in markers]
    cut = files.select("repo_id", "branch", "path", "language", *flags, F.posexplode(F.split("content", "\r?\n", -1)).alias("pos", "text"))
    return cut.withColumn("line", F.col("pos") + 1).drop("pos")


def markers_of(rules: tuple[Rule, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(m for r in rules for m in r.gate.split("|") if m))


def matches(files: DataFrame, rules: tuple[Rule, ...], first: bool = False) -> DataFrame:
    """One row for every rule that a line meets (``first``: for the first one only): kind, value, extra (empty: none), constant, rule."""
    lines = lines_of(files, markers_of(rules))

    def one(i: int, r: Rule) -> Column:
        ok = F.col("language").isin(*r.languages) if r.languages else F.lit(True)
        if r.gate:
            held = F.lit(False)
            for m in r.gate.split("|"):
                held = held | F.col(_flag(m))
            ok = ok & held
        take = lambda g: F.regexp_extract(F.col("text"), r.pattern, g) if g else F.lit("")
        return F.when(
            ok & F.col("text").rlike(r.pattern), F.struct(F.lit(r.kind).alias("kind"), take(r.value).alias("value"), take(r.extra).alias("extra"), F.lit(r.constant).alias("constant"), F.lit(i).alias("rule"))
        )

    hits = F.filter(F.array(*[one(i, r) for i, r in enumerate(rules)]), lambda m: m.isNotNull())
    hit = F.explode(F.slice(hits, 1, 1) if first else hits)
    keep = ("repo_id", "branch", "path", "language", "line", "text")
    return lines.select(*keep, hit.alias("m")).select(*keep, "m.*")


KEY = ["repo_id", "branch", "file"]


def _attached(points: DataFrame, spans: DataFrame | None, column: str) -> DataFrame:
    """Points (KEY, line) with ``column``: the function around the line; null without spans."""
    if spans is None:
        return points.withColumn(column, F.lit(None).cast("string"))
    return enclosing(points, spans, KEY).withColumnRenamed("enclosing", column)


def event_streams(files: DataFrame, spans: DataFrame) -> DataFrame:
    """KEY, id of the functions whose body names the type of an event stream."""
    lines = lines_of(files).where(F.contains(F.lower("text"), F.lit("text/event-stream"))).select("repo_id", "branch", F.col("path").alias("file"), "line")
    return lines.join(spans.select(*KEY, "id", "start", "end"), KEY).where("line between start and end").select(*KEY, "id").distinct()


def provides(files: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Routes and methods that files offer, once each: mechanism, http_method, route, service, method, handler_id, line.

    With spans (functions: KEY, id, name, start, end, seq) a handler is the function that the line names, else the one
    around it, else the next one; a route whose handler answers with an event stream is one of server-sent events.
    """
    base = ("repo_id", "branch", F.col("path").alias("file"))
    m = matches(files, PROVIDES).where(F.col("value") != "").where(~F.col("value").contains("$") & ~F.col("value").contains("{{"))
    rest = m.select(
        *base, F.col("kind").alias("mechanism"), F.nullif(F.upper("extra"), F.lit("")).alias("http_method"), text.normalize_route(F.col("value")).alias("route"),
        F.lit(None).cast("string").alias("service"), F.lit(None).cast("string").alias("method"), "language", "line", text.handler_hint(F.col("text"), F.col("value")).alias("hint"),
    )
    named = matches(files, REGISTERED).where("value <> ''").select(
        *base, F.col("kind").alias("mechanism"), F.lit(None).cast("string").alias("http_method"), F.lit(None).cast("string").alias("route"), F.lit(None).cast("string").alias("service"), F.col("value").alias("method"),
        "language", "line", text.handler_hint(F.col("text"), F.col("value")).alias("hint"),
    )
    out = rest.union(named).union(proto_methods(files))
    if spans is None:
        out = out.withColumn("handler_id", F.lit(None).cast("string"))
    else:
        out = resolve_handlers(out, spans, KEY).withColumnRenamed("handler", "handler_id")
        sse = event_streams(files, spans).withColumnRenamed("id", "handler_id").withColumn("sse", F.lit(True))
        out = out.join(sse, [*KEY, "handler_id"], "left").withColumn("mechanism", F.when((F.col("mechanism") == "rest") & F.col("sse"), "sse").otherwise(F.col("mechanism"))).drop("sse")
    same = [*KEY, "mechanism", "http_method", "route", "service", "method", "handler_id"]
    return out.groupBy(*same).agg(F.min("line").alias("line"), F.min_by("language", "line").alias("language"))


def proto_methods(files: DataFrame) -> DataFrame:
    """The methods of services in proto files, each service with its package."""
    lines = lines_of(files.where("language = 'proto'")).withColumn("t", F.trim(F.regexp_replace("text", r"\s+", " ")))
    t, w = F.col("t"), Window.partitionBy("repo_id", "branch", "path").orderBy("line")
    package = F.when(t.startswith("package "), F.trim(F.regexp_extract(t, r"^package ([^;]*)", 1)))
    service = F.when(t.startswith("service ") & t.contains("{"), F.trim(F.regexp_extract(t, r"^service ([^{]*)", 1))).when(t == "}", "")
    lines = lines.withColumn("package", F.last(package, ignorenulls=True).over(w)).withColumn("of", F.last(service, ignorenulls=True).over(w))
    full = F.when(F.coalesce("package", F.lit("")) == "", F.col("of")).otherwise(F.concat_ws(".", "package", "of"))
    method = F.regexp_extract(t, r"^rpc ([^( ]+)", 1)
    none = F.lit(None).cast("string")
    return lines.where(t.startswith("rpc ") & (F.coalesce("of", F.lit("")) != "") & (method != "")).select(
        "repo_id", "branch", F.col("path").alias("file"), F.lit("grpc").alias("mechanism"), none.alias("http_method"), none.alias("route"), full.alias("service"), method.alias("method"), "language", "line", method.alias("hint")
    )


def consumes(files: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Calls that files make, once a caller: mechanism, http_method, route, service, method, target_hint, caller_id, line."""
    m = matches(files, CONSUMES).withColumn("value", text.strip_template_prefix(F.col("value"))).where("value <> ''").where(~F.col("value").rlike(r"^(?:\$\{|\$\(|\{\{)"))
    rpc = F.col("kind").isin("grpc", "json_rpc")
    none = F.lit(None).cast("string")
    url = F.get(F.filter(text.quoted_strings(F.col("text")), lambda q: q.startswith("http")), 0)
    out = m.select(
        "repo_id", "branch", F.col("path").alias("file"), F.col("kind").alias("mechanism"), F.nullif(F.upper("extra"), F.lit("")).alias("http_method"),
        F.when(~rpc, text.normalize_route(F.col("value"))).when((F.col("kind") == "json_rpc") & url.isNotNull(), text.normalize_route(url)).alias("route"), none.alias("service"),
        F.when(rpc, F.col("value")).alias("method"), F.when(F.col("value").contains("://"), F.col("value")).alias("target_hint"), "language", "line",
    )
    same = [*KEY, "mechanism", "http_method", "route", "service", "method", "target_hint", "caller_id"]
    return _attached(out, spans, "caller_id").groupBy(*same).agg(F.min("line").alias("line"), F.min_by("language", "line").alias("language"))


def channels(files: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Channels that files publish or subscribe to: direction, broker, channel, channel_type, node_id, line."""
    m = matches(files, CHANNELS).withColumn("channel", F.trim(text.tail_segment(F.col("value")))).where(~text.has_template(F.col("value")) & (F.col("channel") != ""))
    kind = F.when(F.col("constant").isin("rabbitmq", "sqs"), "queue").otherwise("topic")
    out = m.select("repo_id", "branch", F.col("path").alias("file"), F.col("kind").alias("direction"), F.col("constant").alias("broker"), "channel", kind.alias("channel_type"), "line")
    return _attached(out, spans, "node_id").groupBy(*KEY, "direction", "broker", "channel", "channel_type", "node_id").agg(F.min("line").alias("line"))


#: What a connection string's scheme tells about the mechanism.
DB_SCHEMES = {
    "postgres://": "postgres", "postgresql://": "postgres", "mysql://": "mysql", "mariadb://": "mysql", "mongodb+srv://": "mongodb", "mongodb://": "mongodb", "redis://": "redis", "rediss://": "redis",
    "clickhouse://": "clickhouse", "sqlserver://": "sqlserver", "mssql://": "sqlserver", "cockroachdb://": "cockroach", "amqp://": "rabbitmq", "amqps://": "rabbitmq", "sqlite://": "sqlite", "file:": "sqlite",
}


def _reference(kind: str, mechanism: str | Column, default: str) -> Column:
    m = F.lit(mechanism) if isinstance(mechanism, str) else mechanism
    return F.struct(F.lit(kind).alias("resource_type"), m.alias("mechanism"), text.infer_access(F.col("text"), default).alias("access"))


def classify_literal(v: Column) -> Column:
    """What a quoted value on the line ``text`` refers to: struct(resource_type, mechanism, access), or null."""
    low = F.lower(F.trim(v))
    scheme, jdbc = F.lit(None).cast("string"), F.regexp_extract(low, "^jdbc:(.*)$", 1)
    for s, m in reversed(DB_SCHEMES.items()):
        scheme = F.when(low.startswith(s), m).otherwise(scheme)
    driver = F.when(jdbc.startswith("postgresql"), "postgres").when(jdbc.rlike("^(?:mysql|mariadb)"), "mysql").when(jdbc.startswith("oracle"), "oracle").when(jdbc.rlike("^(?:sqlserver|jtds)"), "sqlserver").otherwise("jdbc")
    host, seg = text.http_host(low), text.first_segment(text.http_path(low))
    web = (
        F.when((host == "storage.googleapis.com") | host.endswith(".storage.googleapis.com"), F.when(seg != "", _reference("bucket", "gcs", "connect")))
        .when(host == "s3.amazonaws.com", F.when(seg != "", _reference("bucket", "s3", "connect"))).when(host.endswith(".amazonaws.com") & host.contains(".s3."), _reference("bucket", "s3", "connect"))
        .when(host.endswith(".cloudfunctions.net") & (seg != ""), _reference("function", "cloud_function", "invoke")).when(host.endswith(".run.app") & (seg != ""), _reference("function", "cloud_run", "invoke"))
        .when(host.contains(".execute-api.") & host.endswith(".amazonaws.com"), _reference("api", "aws_api_gateway", "connect"))
    )
    arn = (
        F.when(low.startswith("arn:aws:lambda:"), _reference("function", "lambda", "invoke")).when(low.startswith("arn:aws:s3:"), _reference("bucket", "s3", "connect"))
        .when(low.startswith("arn:aws:dynamodb:"), _reference("table", "dynamodb", "connect"))
    )
    keyed = low.contains("host=") & low.rlike("dbname=|database=|db=")
    return (
        F.when(scheme.isNotNull(), _reference("database", scheme, "connect")).when(low.startswith("jdbc:"), _reference("database", driver, "connect"))
        .when(low.startswith("s3://"), _reference("bucket", "s3", "connect")).when(low.startswith("gs://"), _reference("bucket", "gcs", "connect")).when(low.startswith("azblob://"), _reference("bucket", "azure_blob", "connect"))
        .when(low.startswith("arn:aws:"), arn).when(low.rlike("^https?://"), web).when(keyed, _reference("database", "sql", "connect"))
        .when(F.lower("text").contains("bigquery") & text.dataset_ref(low), _reference("dataset", "bigquery", "query"))
    )


@dataclass(frozen=True)
class Argument:
    """An argument of a client library: in a file that holds a marker, on a line that holds a word."""

    languages: tuple[str, ...]
    key: str
    kind: str
    mechanism: str
    default: str = "connect"
    gate: str = ""
    word: str = ""
    fixed: bool = False  # the access is the default, whatever the line says


ARGUMENTS = (
    Argument(("python",), "Bucket", "bucket", "s3", gate="boto3|boto.|boto(|amazonaws", word="bucket"), Argument(JS, "Bucket", "bucket", "s3", gate="s3|aws-sdk|aws_sdk", word="bucket"),
    Argument(("go",), "Bucket", "bucket", "s3", gate='aws-sdk-go|minio-go|"s3"|s3.', word="bucket"), Argument(("java", "kotlin"), "BucketName", "bucket", "s3", gate="s3|amazonaws", word="bucket"),
    Argument(("rust",), "bucket", "bucket", "s3", gate="aws_sdk_s3|aws-sdk-s3|rusoto|s3::", word="bucket"), Argument(("csharp",), "BucketName", "bucket", "s3", gate="s3|awssdk", word="bucket"),
    Argument(("python", *JS, "go", "java", "kotlin", "csharp"), "TableName", "table", "dynamodb", gate="dynamodb"), Argument(("python",), "table", "table", "dynamodb", gate="dynamodb", word="table("), Argument(("rust",), "table", "table", "dynamodb", gate="dynamodb"),
    Argument(("python", *JS), "FunctionName", "function", "lambda", "invoke", fixed=True), Argument(("go",), "FunctionName", "function", "lambda", "invoke", gate="aws-lambda-go|lambda.", fixed=True),
    Argument(("java", "kotlin"), "FunctionName", "function", "lambda", "invoke", gate="aws-lambda|lambda.", fixed=True), Argument(("csharp",), "FunctionName", "function", "lambda", "invoke", gate="lambda", fixed=True),
    Argument(("rust",), "function_name", "function", "lambda", "invoke", gate="aws_lambda|lambda", fixed=True),
    Argument(("python",), "bucket", "bucket", "gcs", gate="google.cloud.storage|google-cloud-storage", word="bucket", fixed=True), Argument(JS, "bucket", "bucket", "gcs", gate="@google-cloud/storage|google-cloud-storage|@googleapis", word="bucket", fixed=True),
    Argument(("go",), "bucket", "bucket", "gcs", gate="cloud.google.com/go/storage|google.golang.org/api/storage", word="bucket", fixed=True), Argument(("java", "kotlin", "csharp"), "bucket", "bucket", "gcs", gate="google.cloud.storage", word="bucket", fixed=True),
    Argument(("rust",), "bucket", "bucket", "gcs", gate="google-cloud-storage|gcp-storage", word="bucket", fixed=True),
)
#: Markers of files that use BigQuery, by language.
BIGQUERY = {("python", "rust", "csharp", *JS): "bigquery", ("go",): "cloud.google.com/go/bigquery", ("java", "kotlin"): "google.cloud.bigquery"}


def bigquery_reference(line: Column) -> Column:
    """struct(resource_type, raw_target) of a line: ids of tables, of datasets, or the first table that a query names."""
    low, q = F.lower(line), text.quoted_strings(line)
    one = lambda kind, target: F.struct(F.lit(kind).alias("resource_type"), target.alias("raw_target"))
    table = F.get(F.filter(F.transform(q, text.table_ref), lambda x: x.isNotNull()), 0)
    return (
        F.when(low.rlike("tableid|table_id") & (F.size(q) >= 3), one("table", F.concat_ws(".", F.slice(q, 1, 3)))).when(low.rlike("datasetid|dataset_id") & (F.size(q) >= 2), one("dataset", F.concat_ws(".", F.slice(q, 1, 2))))
        .when(low.contains("dataset") & (F.size(q) >= 1), one("dataset", F.get(q, 0))).when(low.rlike(r"\.query ?\(") & table.isNotNull(), one("table", table))
    )


def resources(files: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """What lines refer to: resource_type, mechanism, access, raw_target, node_id (the function around, else the repository), line.

    From literals, environment variables (as ``env:NAME``), arguments of client libraries and BigQuery calls.
    """
    markers = tuple(dict.fromkeys(m for g in [a.gate for a in ARGUMENTS] + list(BIGQUERY.values()) for m in g.split("|") if m))
    lines = lines_of(files, markers)
    at = ("repo_id", "branch", "path", "line")
    t, low = F.col("text"), F.lower("text")
    lit = lines.select(*at, "text", F.explode(text.quoted_strings(t)).alias("v")).withColumn("r", classify_literal(F.col("v"))).where("r is not null")
    out = lit.select(*at, "r.resource_type", "r.mechanism", "r.access", F.trim("v").alias("raw_target"))
    env = lines.where(low.rlike(r"environ|getenv|process\.env|\$\{|\$\(")).select(*at, F.explode(F.concat(text.extract_env_vars(t), F.filter(F.transform(text.quoted_strings(t), lambda q: F.trim(q)), text.is_env_name))).alias("v"))
    env = env.withColumn("resource_type", text.env_var_kind(F.col("v"))).where("resource_type is not null")
    out = out.union(env.select(*at, "resource_type", F.lit("").alias("mechanism"), F.lit("connect").alias("access"), F.concat(F.lit("env:"), F.col("v")).alias("raw_target")))

    def held(gate: str) -> Column:
        ok = F.lit(not gate)
        for m in gate.split("|") if gate else ():
            ok = ok | F.col(_flag(m))
        return ok

    def argument(a: Argument) -> Column:
        ok = F.col("language").isin(*a.languages) & held(a.gate)
        ok = ok & low.contains(a.word) if a.word else ok
        access = F.lit(a.default) if a.fixed else text.infer_access(t, a.default)
        return F.when(ok, F.struct(F.lit(a.kind).alias("resource_type"), F.lit(a.mechanism).alias("mechanism"), access.alias("access"), text.arg_quoted(t, a.key).alias("raw_target")))

    told = lines.where(F.col("language").isin(*{x for a in ARGUMENTS for x in a.languages}))
    named = told.select(*at, F.explode(F.filter(F.array(*map(argument, ARGUMENTS)), lambda x: x.isNotNull() & x["raw_target"].isNotNull())).alias("r")).select(*at, "r.*")
    uses = F.lit(False)
    for langs, gate in BIGQUERY.items():
        uses = uses | (F.col("language").isin(*langs) & held(gate))
    big = told.where(uses).select(*at, bigquery_reference(t).alias("b")).where("b is not null").select(*at, "b.resource_type", F.lit("bigquery").alias("mechanism"), F.lit("query").alias("access"), "b.raw_target")
    out = out.union(named).union(big).where(F.trim("raw_target") != "").withColumnRenamed("path", "file")
    own = F.coalesce(F.col("node_id"), canonical_id(F.col("repo_id"), F.lit("repo")))
    return _attached(out, spans, "node_id").withColumn("node_id", own).groupBy(*KEY, "resource_type", "mechanism", "access", "raw_target", "node_id").agg(F.min("line").alias("line"))
