"""Queries of extraction, index run, link pass and scalar functions; each part or page of the tables makes a case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.extract import evidence, rules, walker
from graphloom.functions import ids, text
from graphloom.operators import deploy, indexing, joins, links, snapshot, traverse
from graphloom.plans import bridge
from graphloom.plans.storage import stored
from graphloom.queries import _C, _MATCH, _P, _api, _contracts, _pairs, _root_id, query
from graphloom.sources import config, registry


#: Files that a task walks.
TASK_FILES = 5_000


def _part_files(spark, sf, path: str, language: str | None, source: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    fill = lambda t: F.regexp_replace(F.lit(t), F.lit(r"\{k\}"), k)
    p = bridge.tables(spark, sf)["part"].select("p_partkey", "p_brand")
    p = p.repartition(max(1, -(-p.count() // TASK_FILES)), "p_partkey")  # rows are short, the work on each is not
    return p.select(F.col("p_brand").alias("repo_id"), F.lit("main").alias("branch"), fill(path).alias("path"), F.lit(language).cast("string").alias("language"), F.lit(1).alias("tier"), fill(source).alias("content"))


def _quote(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def case(name: str, path: str, language: str | None, source: str, columns: str, make, rows: list[tuple], spans_needed: bool = True) -> None:
    """Register a query that extracts from one small file for each part, and its SQL: the expected rows for each part."""
    names = columns.split()
    values = ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in rows)
    shown = ", ".join(f"CAST(v.{c} AS INT) AS {c}" if c == "line" else f"replace(CAST(v.{c} AS VARCHAR), '{{k}}', CAST(p.p_partkey AS VARCHAR)) AS {c}" for c in names)
    sql = f"SELECT p.p_brand AS repo_id, replace({_quote(path)}, '{{k}}', CAST(p.p_partkey AS VARCHAR)) AS path, {shown} FROM part p, (VALUES {values}) v({', '.join(names)})"

    def run(spark, sf):
        files = _part_files(spark, sf, path, language, source)
        spans = walker.functions(stored(walker.analyze(files), "case-facts")) if language and spans_needed else None
        out = make(files, spans)
        out = out.withColumn("path", F.col("file")) if "file" in out.columns else out
        return out.select("repo_id", "path", *[F.col(c).cast("int" if c == "line" else "string").alias(c) for c in names])

    run.__name__ = name
    run.__doc__ = f"What one {language or 'text'} file for each part holds."
    query(sql)(run)


def _handled(df: DataFrame, spans: DataFrame, column: str, out: str) -> DataFrame:
    """With the name of the function that an id stands for."""
    return df.join(spans.select("repo_id", "branch", "file", F.col("id").alias(column), F.col("name").alias(out)), ["repo_id", "branch", "file", column], "left")


def _provided(files, spans):
    return _handled(rules.provides(files, spans), spans, "handler_id", "handler").withColumn("target", F.coalesce("route", F.concat_ws("/", "service", "method")))


def _consumed(files, spans):
    return _handled(rules.consumes(files, spans), spans, "caller_id", "caller").withColumn("target", F.coalesce("route", F.lit("")))


def _channels(files, spans):
    return _handled(rules.channels(files, spans), spans, "node_id", "node")


def _resources(files, spans):
    out = _handled(rules.resources(files, spans), spans, "node_id", "node")
    repo = ids.canonical_id(F.col("repo_id"), F.lit("repo"))
    return out.withColumn("node", F.when(F.col("node_id") == repo, "repository").otherwise(F.col("node")))


def _facts(files, spans):
    f = walker.analyze(files).where("fact <> 'file'")
    value = F.when(F.col("fact") == "symbol", F.concat_ws(" ", "kind", F.concat_ws(".", F.nullif("container", F.lit("")), "name"))).otherwise(F.col("detail"))
    return f.withColumn("value", value).withColumn("line", F.col("start_line")).withColumn("last", F.coalesce("end_line", F.lit(0)))


def _targets(files, spans):
    """Calls with the symbols that they lead to: the files are walked once."""
    facts = stored(walker.analyze(files).where("fact in ('call', 'symbol')").drop("src", "qualified_name", "content_hash"), "case-targets")
    known = facts.where("fact = 'symbol'").select("repo_id", "branch", "path", F.col("id").alias("dst"), F.concat_ws(".", F.nullif("container", F.lit("")), "name").alias("target"))
    return facts.where("fact = 'call'").withColumn("line", F.col("start_line")).join(known, ["repo_id", "branch", "path", "dst"], "left")


PROVIDED, CONSUMED = "mechanism http_method target handler line", "mechanism http_method target method caller line"

case(
    "x1_symbols", "src/m{k}.py", "python",
    "import lib_{k}\nfrom a.b import c\n\nclass Part{k}:\n    def price{k}(self):\n        def inner(x):\n            return lookup{k}(x)\n        return inner(1)\n\n    def other(self):\n        return self.price{k}()\n\ndef top():\n    pass\n",
    "fact value line last", _facts,
    [
        ("import", "lib_{k}", 1, 0), ("import", "a.b.c", 2, 0), ("symbol", "CLASS Part{k}", 4, 11), ("symbol", "METHOD Part{k}.price{k}", 5, 8), ("symbol", "METHOD Part{k}.inner", 6, 7), ("call", "lookup{k}", 7, 0),
        ("call", "inner", 8, 0), ("symbol", "METHOD Part{k}.other", 10, 11), ("call", "self.price{k}", 11, 0), ("symbol", "FUNCTION top", 13, 14),
    ],
    spans_needed=False,
)
case(
    "x2_call_targets", "src/n{k}.py", "python", "class A{k}:\n    def run(self):\n        helper{k}()\n        self.stop()\n    def stop(self):\n        pass\n\ndef helper{k}():\n    ghost{k}()\n",
    "detail resolved target line",
    _targets,
    [("helper{k}", "local", "helper{k}", 3), ("self.stop", "local", "A{k}.stop", 4), ("ghost{k}", "unresolved", None, 9)],
    spans_needed=False,
)
case(
    "x3_statuses", "src/s{k}.xyz", None, "whatever", "status", lambda files, spans: walker.analyze(files.withColumn("tier", F.lit(None).cast("int"))).withColumn("file", F.col("path")), [("FAILED",)],
)
case(
    "x10_spring", "src/C{k}.java", "java", "class C{k} {\n    @GetMapping(\"/items/{id}\")\n    public Item find(int id) {\n        return null;\n    }\n    @PostMapping(\"/items/p{k}\")\n    public void add(Item i) {\n    }\n}\n",
    PROVIDED, _provided, [("rest", "GET", "/items/*", "find", 2), ("rest", "POST", "/items/p{k}", "add", 6)],
)
case(
    "x11_python_routes", "src/r{k}.py", "python",
    "@app.get('/parts/{id}/p{k}')\ndef read(id):\n    return stream\n\n@app.route('/form{k}', methods=['PUT'])\ndef form():\n    pass\n\n@app.get('/feed{k}')\ndef feed():\n    return Response(media_type='text/event-stream')\n",
    PROVIDED, _provided, [("rest", "GET", "/parts/*/p{k}", "read", 1), ("rest", "PUT", "/form{k}", "form", 5), ("sse", "GET", "/feed{k}", "feed", 9)],
)
case(
    "x12_nest", "src/c{k}.ts", "typescript", "export class C{k} {\n  @Get('/cats/:id')\n  one(id) {\n    return id;\n  }\n  @Delete('/cats/p{k}')\n  drop() {\n  }\n}\n",
    PROVIDED, _provided, [("rest", "GET", "/cats/*", "one", 2), ("rest", "DELETE", "/cats/p{k}", "drop", 6)],
)
case(
    "x13_express", "src/s{k}.js", "javascript", "function show(req, res) {\n  res.send(1);\n}\nrouter.get('/shows/:id', show);\napp.post('/shows/p{k}', auth, show);\n",
    PROVIDED, _provided, [("rest", "GET", "/shows/*", "show", 4), ("rest", "POST", "/shows/p{k}", "show", 5)],
)
case(
    "x14_go", "src/g{k}.go", "go", "package main\nfunc list(c *gin.Context) {\n\tc.JSON(200, nil)\n}\nfunc main() {\n\tr.GET(\"/things/:id\", list)\n\thttp.HandleFunc(\"/old{k}\", list)\n}\n",
    PROVIDED, _provided, [("rest", "GET", "/things/*", "list", 6), ("rest", None, "/old{k}", "list", 7)],
)
case(
    "x15_rust", "src/r{k}.rs", "rust", "#[get(\"/rows/{id}\")]\nasync fn row() -> String {\n    String::new()\n}\nfn app() -> Router {\n    Router::new().route(\"/all{k}\", post(row))\n}\n",
    PROVIDED, _provided, [("rest", "GET", "/rows/*", "row", 1), ("rest", "POST", "/all{k}", "app", 6)],
)
case("x16_sinatra", "src/s{k}.rb", "ruby", "get '/words/:id' do\n  show\nend\n", PROVIDED, _provided, [("rest", "GET", "/words/*", None, 1)])
case(
    "x17_aspnet", "src/c{k}.cs", "csharp", "public class C{k} {\n    [HttpGet(\"/orders/{id}\")]\n    public Order Find(int id) {\n        return null;\n    }\n}\n", PROVIDED, _provided, [("rest", "GET", "/orders/*", "Find", 2)],
)
case(
    "x18_js_calls", "src/w{k}.ts", "typescript", "export async function load() {\n  await fetch(`/api/items/{k}`);\n  return axios.post('https://svc.local/orders/{k}', {});\n}\nnew EventSource('/feed{k}');\n",
    CONSUMED, _consumed, [("rest", None, "/api/items/{k}", None, "load", 2), ("rest", "POST", "/orders/{k}", None, "load", 3), ("sse", None, "/feed{k}", None, None, 5)],
)
case(
    "x19_python_calls", "src/p{k}.py", "python", "def pull():\n    requests.get('https://svc.local/rows/{k}')\n    session.delete(f'/rows/{k}')\n    urlopen('http://x.local/{k}')\n",
    CONSUMED, _consumed, [("rest", "GET", "/rows/{k}", None, "pull", 2), ("rest", "DELETE", "/rows/{k}", None, "pull", 3), ("rest", None, "/{k}", None, "pull", 4)],
)
case(
    "x20_go_calls", "src/c{k}.go", "go", "func pull() {\n\thttp.Get(\"http://a.local/g{k}\")\n\thttp.NewRequest(\"PUT\", \"/n{k}\", nil)\n}\n",
    CONSUMED, _consumed, [("rest", "GET", "/g{k}", None, "pull", 2), ("rest", "PUT", "/n{k}", None, "pull", 3)],
)
case("x21_rust_calls", "src/q{k}.rs", "rust", "use reqwest::Client;\nasync fn pull() {\n    client.get(\"http://a.local/r{k}\").send();\n}\n", CONSUMED, _consumed, [("rest", "GET", "/r{k}", None, "pull", 3)])
case(
    "x22_java_calls", "src/J{k}.java", "java", "class J{k} {\n    public void pull() {\n        rest.getForObject(\"http://a.local/j{k}\", String.class);\n        client.get().uri(\"/u{k}\");\n    }\n}\n",
    CONSUMED, _consumed, [("rest", "GET", "/j{k}", None, "pull", 3), ("rest", None, "/u{k}", None, "pull", 4)],
)
case("x23_ruby_calls", "src/c{k}.rb", "ruby", "def pull\n  HTTParty.get('http://a.local/b{k}')\nend\n", CONSUMED, _consumed, [("rest", "GET", "/b{k}", None, "pull", 2)])
case("x24_js_realtime", "src/t{k}.js", "javascript", "const socket = new WebSocket('wss://a.local/live{k}');\napp.ws('/chat{k}', talk);\n", PROVIDED, _provided, [("websocket", None, "/chat{k}", None, 2)])
case("x25_python_realtime", "src/t{k}.py", "python", "@app.websocket('/live{k}')\nasync def live(ws):\n    pass\n", PROVIDED, _provided, [("websocket", None, "/live{k}", "live", 1)])
case(
    "x26_kafka", "src/k{k}.py", "python", "from kafka import KafkaConsumer\ndef run():\n    producer.send('orders-{k}', b'')\nKafkaConsumer('bills-{k}')\n", "direction broker channel channel_type node line", _channels,
    [("publish", "kafka", "orders-{k}", "topic", "run", 3), ("subscribe", "kafka", "bills-{k}", "topic", None, 4)],
)
case(
    "x27_rabbitmq", "src/q{k}.js", "javascript", "function run() {\n  ch.sendToQueue('jobs-{k}', b);\n}\nch.assertQueue('done-{k}');\n", "direction broker channel channel_type node line", _channels,
    [("publish", "rabbitmq", "jobs-{k}", "queue", "run", 2), ("subscribe", "rabbitmq", "done-{k}", "queue", None, 4)],
)
case(
    "x28_sqs_pubsub", "src/s{k}.py", "python", "def run():\n    sqs.send_message(QueueUrl='https://sqs.local/1/q-{k}')\n    publisher.topic_path('proj', 'news-{k}')\n", "direction broker channel channel_type node line", _channels,
    [("publish", "sqs", "q-{k}", "queue", "run", 2), ("publish", "pubsub", "news-{k}", "topic", "run", 3)],
)
case(
    "x29_proto", "src/s{k}.proto", "proto", "syntax = \"proto3\";\npackage shop.v{k};\nservice Cart {\n  rpc Add (Item) returns (Empty);\n  rpc Drop(Item) returns (Empty);\n}\nrpc Stray (Item)\n",
    "mechanism target line", _provided, [("grpc", "shop.v{k}.Cart/Add", 4), ("grpc", "shop.v{k}.Cart/Drop", 5)],
)
case(
    "x30_rpc_calls", "src/g{k}.py", "python", "import shop_pb2\ndef pull():\n    cart_stub.AddItem{k}(x)\n    stub.get(x)\n    jsonrpc.call('sum{k}', 1)\n", CONSUMED, _consumed,
    [("grpc", None, "", "AddItem{k}", "pull", 3), ("json_rpc", None, "", "sum{k}", "pull", 5)],
)
case(
    "x31_literals", "src/l{k}.py", "python",
    "def run():\n    a = connect('postgresql://u:p@db.local:5432/app{k}')\n    s3.upload('s3://bucket-{k}/x')\n    b = 'arn:aws:lambda:eu:1:function:fn{k}'\nc = 'host=db{k} dbname=x'\nd = 'https://f.cloudfunctions.net/go{k}'\ne = 'plain{k}'\n",
    "resource_type mechanism access raw_target node line", _resources,
    [
        ("database", "postgres", "connect", "postgresql://u:p@db.local:5432/app{k}", "run", 2), ("bucket", "s3", "write", "s3://bucket-{k}/x", "run", 3), ("function", "lambda", "invoke", "arn:aws:lambda:eu:1:function:fn{k}", "run", 4),
        ("database", "sql", "connect", "host=db{k} dbname=x", "repository", 5), ("function", "cloud_function", "invoke", "https://f.cloudfunctions.net/go{k}", "repository", 6),
    ],
)
case(
    "x33_env_references", "src/e{k}.js", "javascript", "const a = process.env['DATABASE_{k}'];\nconst b = `${BUCKET_{k}}/x`;\nconst c = process.env['COLOR_{k}'];\n", "resource_type mechanism access raw_target node line", _resources,
    [("database", "", "connect", "env:DATABASE_{k}", "repository", 1), ("bucket", "", "connect", "env:BUCKET_{k}", "repository", 2)],
)
case(
    "x34_client_arguments", "src/a{k}.py", "python",
    "import boto3\ndef run():\n    s3.put_object(Bucket='b-{k}', Key='x')\n    lam.invoke(FunctionName='f-{k}')\n    db = dynamodb\n    t.get_item(table_name='t-{k}')\n", "resource_type mechanism access raw_target node line", _resources,
    [("bucket", "s3", "write", "b-{k}", "run", 3), ("function", "lambda", "invoke", "f-{k}", "run", 4), ("table", "dynamodb", "read", "t-{k}", "run", 6)],
)
case(
    "x35_bigquery", "src/b{k}.py", "python", "import bigquery\ndef run():\n    c.query('select * from `proj.ds.t{k}`')\n    d = c.dataset('sales{k}')\n", "resource_type mechanism access raw_target node line", _resources,
    [("table", "bigquery", "query", "proj.ds.t{k}", "run", 3), ("dataset", "bigquery", "query", "sales{k}", "run", 4)],
)
_evidence = lambda files, spans: evidence.scan(files)
case(
    "x37_openapi", "api/openapi-{k}.yaml", None, "openapi: 3.0.0\npaths:\n  /items/{id}:\n    get:\n      summary: x\n    post:\n      summary: y\n  /p{k}:\n    delete:\n      summary: z\ncomponents:\n  get:\n", "kind value detail line", _evidence,
    [("OPENAPI", "GET /items/{id}", "get:", 4), ("OPENAPI", "POST /items/{id}", "post:", 6), ("OPENAPI", "DELETE /p{k}", "delete:", 9)],
)
case(
    "x37_openapi_json", "api/swagger-{k}.json", None, '{"paths": {\n"/p{k}": {"get": {}, "x-note": 1},\n"/q": {"put": {}}}}', "kind value line", _evidence, [("OPENAPI", "GET /p{k}", 2), ("OPENAPI", "PUT /q", 3)],
)
case(
    "x38_asyncapi", "api/events-{k}.yaml", None, "asyncapi: 2.0.0\nchannels:\n  orders.{k}:\n    publish:\n      bindings:\n        kafka: x\n  plain.{k}:\n    subscribe:\n      message: y\ninfo:\n  title: t\n", "kind value channel broker line", _evidence,
    [("ASYNCAPI", "orders.{k}", "orders.{k}", "kafka", 3), ("ASYNCAPI", "plain.{k}", "plain.{k}", "", 7)],
)
case(
    "x39_deployment", "k8s/app-{k}.yaml", None,
    "image: repo/app:{k}\nenv:\n  - name: ORDERS_TOPIC\n    value: orders-{k}\n  - name: COLOR\n    value: red\nrules:\n  - host: shop{k}.local\n    path: /cart\n", "kind value channel line", _evidence,
    [("KUBERNETES", "repo/app:{k}", "", 1), ("KUBERNETES", "orders-{k}", "orders-{k}", 3), ("KUBERNETES", "shop{k}.local /cart", "", 8 + 1)],
)
case("x40_env_files", "conf/.env", None, "API_URL=https://a{k}.local\n# no\nCOLOR=red\nJOBS_QUEUE: jobs{k}\n", "kind value channel line", _evidence, [("ENV_FILE", "https://a{k}.local", "", 1), ("ENV_FILE", "jobs{k}", "jobs{k}", 4)])
case(
    "x41_readme", "README.md", None, "See https://docs{k}.local/x.\nCall `/v1/p{k}` or `GET /v2`.\nThe topic order.created-{k} and the queue.\n", "kind value channel line", _evidence,
    [("README", "https://docs{k}.local/x", "", 1), ("README", "/v1/p{k}", "", 2), ("README", "order.created-{k}", "order.created-{k}", 3)],
)


# Paths and languages.
_NAMES = ("a.py", "B.TSX", "c.h", "Makefile", "makefile", "GNUmakefile", "d.hxx", "e.php3", "CMakeLists.txt", "Dockerfile", "f.unknown", "g.R", "h.pyw", ".py", "i.tar.gz", "j.fish", "k.el", "l.cl")
_PATH = "('src/' || p_partkey || '/' || CASE p_partkey % 18 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END)"


def _paths(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return bridge.tables(spark, sf)["part"].select("p_partkey", F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit("/"), name).alias("path"))


@query(f"""SELECT {_PATH} AS path, CASE p_partkey % 18 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'c' WHEN 3 THEN 'make' WHEN 4 THEN 'make' WHEN 5 THEN 'make' WHEN 6 THEN 'cpp' WHEN 7 THEN 'php'
WHEN 8 THEN 'cmake' WHEN 9 THEN 'dockerfile' WHEN 11 THEN 'r' WHEN 12 THEN 'python' WHEN 15 THEN 'shell' WHEN 16 THEN 'common-lisp' END AS language FROM part""")
def s9_languages(spark, sf):
    return registry.detect_languages(_paths(spark, sf)).select("path", "language")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'cpp' WHEN 2 THEN 'python' WHEN 3 THEN 'terraform' WHEN 4 THEN 'perl' END AS language, p_partkey % 6 < 4 AS grammar FROM part""")
def s10_languages_by_name(spark, sf):
    names = F.element_at(F.array(*map(F.lit, ("golang", " C++ ", "Python3", "hcl", "perl", "klingon"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return registry.languages_by_name(bridge.tables(spark, sf)["part"].select("p_partkey", names.alias("n")), "n").select("p_partkey", "language", "grammar")


_TREE = ("src/a.py", "target/a.py", "x/node_modules/a.js", ".git/config", "img/a.PNG", "lib/b.so", "data/c.parquet", "docs/d.md", "README", "conf/.env.local", "k8s/x.yaml", "api/openapi.json", "api/other.json", "application-dev.yml", "docs", "src/targets.rs")


@query("""SELECT p_partkey, p_partkey % 16 IN (0, 7, 8, 9, 10, 11, 12, 13, 14, 15) AS listed, p_partkey % 16 IN (3, 7, 8, 9, 10, 11, 13) AS scannable FROM part""")
def s5_tree_scan(spark, sf):
    """Which paths are read (no build folders, no binary files), and which hold evidence."""
    path = F.element_at(F.array(*map(F.lit, _TREE)), (F.col("p_partkey") % 16 + 1).cast("int"))
    return bridge.tables(spark, sf)["part"].select("p_partkey", (~registry.is_skipped(path)).alias("listed"), registry.is_scannable(path).alias("scannable"))


_REFS = """(SELECT c_custkey, CAST(c_nationkey AS STRING) AS repo_id, 'b' || c_custkey % 7 AS branch, 'sha' || c_custkey AS sha, c_custkey % 3 AS place FROM customer)"""


def _refs(spark, sf):
    c = bridge.tables(spark, sf)["customer"]
    place = F.when(F.col("c_custkey") % 3 == 0, "refs/remotes/origin/").when(F.col("c_custkey") % 3 == 1, "refs/heads/").otherwise("refs/remotes/fork/")
    r = c.select(F.col("c_nationkey").cast("string").alias("repo_id"), F.concat(place, F.lit("b"), (F.col("c_custkey") % 7).cast("string")).alias("ref"), F.concat(F.lit("sha"), F.col("c_custkey").cast("string")).alias("sha"), F.col("c_custkey").alias("n"))
    one = r.groupBy("repo_id", "ref").agg(F.max_by("sha", "n").alias("sha"))
    return one.union(one.select("repo_id", F.lit("refs/remotes/origin/HEAD"), "sha"))


@query(f"""WITH r AS (SELECT repo_id, branch, place, arg_max(sha, c_custkey) AS sha FROM {_REFS} GROUP BY repo_id, branch, place)
SELECT b.repo_id, b.branch, arg_min(r.sha, r.place) AS sha FROM (SELECT DISTINCT repo_id, 'b' || n AS branch FROM {_REFS}, range(9) x(n)) b LEFT JOIN r ON r.repo_id = b.repo_id AND r.branch = b.branch GROUP BY b.repo_id, b.branch""")
def s3_resolve_heads(spark, sf):
    """origin's ref of a branch, else the local one, else another remote's; null for branches that no ref names."""
    refs = _refs(spark, sf)
    wanted = refs.select("repo_id").distinct().crossJoin(spark.range(9)).select("repo_id", F.concat(F.lit("b"), F.col("id").cast("string")).alias("branch"))
    return config.resolve_heads(refs, wanted)


@query(f"SELECT DISTINCT repo_id, branch FROM {_REFS}")
def s4_branches(spark, sf):
    from graphloom.sources import git

    return git.branches(_refs(spark, sf))


@query("""SELECT CAST(o_orderkey AS STRING) AS repo_id, 'main' AS branch, 'sha' || o_custkey AS sha FROM orders WHERE o_orderkey % 4 <> 0 AND (o_orderkey % 4 = 1 OR o_custkey % 2 = 1)""")
def p10_due_heads(spark, sf):
    """Heads whose commit is not the indexed one: never indexed, or indexed at another commit."""
    o = bridge.tables(spark, sf)["orders"]
    heads = o.select(F.col("o_orderkey").cast("string").alias("repo_id"), F.lit("main").alias("branch"), F.concat(F.lit("sha"), F.col("o_custkey").cast("string")).alias("sha"), "o_orderkey", "o_custkey")
    state = heads.where("o_orderkey % 4 <> 1").select("repo_id", "branch", F.when((F.col("o_orderkey") % 4 == 0) | (F.col("o_custkey") % 2 == 0), F.col("sha")).otherwise(F.lit("older")).alias("indexed_sha"))
    return config.to_index(heads.select("repo_id", "branch", "sha"), state)


@query("SELECT kind, src, dst FROM edges WHERE src = (SELECT id FROM parts WHERE p_partkey = 1) UNION ALL SELECT kind, src, dst FROM edges WHERE dst = (SELECT id FROM parts WHERE p_partkey = 1)")
def s19_edges_of_all_kinds(spark, sf):
    e, root = stored(bridge.view(spark, sf, "edges")), _root_id(spark, sf)
    return traverse.edges_at(e, root, False).union(traverse.edges_at(e, root, True))


@query("SELECT id, name FROM nodes WHERE name = 'NATION_7' OR qualified_name = 'NATION_7' ORDER BY id LIMIT 50")
def s18_exact_names(spark, sf):
    return _api(spark, sf).find_symbol("NATION_7", mode="exact").rows.select("id", "name")


# Facts of nodes and edges.
_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


def _relations(spark, sf):
    from pyspark.sql import Window

    l = bridge.tables(spark, sf)["lineitem"]  # noqa: E741
    order = Window.partitionBy("l_partkey", "l_suppkey").orderBy(*_ORDER.replace("l_suppkey, ", "").split(", "), "l_returnflag", "l_linestatus")
    source = F.when(F.col("l_returnflag") == "A", "JOERN").when(F.col("l_returnflag") == "N", "SCIP").otherwise("TREE_SITTER")
    return l.select(
        F.lit("CALLS").alias("kind"), F.col("l_partkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst"), F.row_number().over(order).alias("seq"), source.alias("source"),
        F.create_map(F.lit("flag"), F.col("l_linestatus"), F.col("l_returnflag"), F.col("l_quantity").cast("int").cast("string")).alias("properties"), F.lit("COMPLETE").alias("status"), F.col("l_linestatus").alias("detail"),
    )


_RELATIONS = f"""(SELECT CAST(l_partkey AS STRING) AS src, CAST(l_suppkey AS STRING) AS dst, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {_ORDER.replace('l_suppkey, ', '')}, l_returnflag, l_linestatus) AS seq,
CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS p, CASE l_returnflag WHEN 'A' THEN 'JOERN' WHEN 'N' THEN 'SCIP' ELSE 'TREE_SITTER' END AS source, l_linestatus, l_returnflag, l_quantity FROM lineitem)"""


@query(f"""WITH f AS {_RELATIONS}, g AS (SELECT *, p > coalesce(max(p) OVER (PARTITION BY src, dst ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS above FROM f),
kv AS (SELECT src, dst, seq, above, 'flag' AS k, l_linestatus AS v FROM g UNION ALL SELECT src, dst, seq, above, l_returnflag, CAST(CAST(l_quantity AS INT) AS STRING) FROM g),
kept AS (SELECT src, dst, k, coalesce(arg_max(v, seq) FILTER (above), arg_min(v, seq)) AS v FROM kv GROUP BY src, dst, k),
pr AS (SELECT src, dst, source, l_linestatus, min(seq) AS seq FROM f GROUP BY src, dst, source, l_linestatus)
SELECT k.src, k.dst, string_agg(k.k || '=' || k.v, ',' ORDER BY k.k) AS properties, any_value(q.provenance) AS provenance FROM kept k
JOIN (SELECT src, dst, string_agg(source || '/' || l_linestatus, ',' ORDER BY seq) AS provenance FROM pr GROUP BY src, dst) q ON q.src = k.src AND q.dst = k.dst GROUP BY k.src, k.dst""")
def a2_merge_edges(spark, sf):
    """Properties by the priority of analyzers, provenance once each in order of arrival."""
    m = snapshot.merge_edges(_relations(spark, sf))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return m.select("src", "dst", pairs.alias("properties"), F.array_join(F.transform("provenance", lambda o: F.concat_ws("/", o["source"], o["detail"])), ",").alias("provenance"))


@query("""SELECT l_orderkey AS seq, '[' || CASE l_returnflag WHEN 'A' THEN 'joern' WHEN 'N' THEN 'scip' WHEN 'R' THEN 'unknown' END || '] line ' || l_linenumber AS message FROM lineitem WHERE l_quantity > 40""")
def a3_normalize_messages(spark, sf):
    r = _relations(spark, sf)
    l = bridge.tables(spark, sf)["lineitem"].where("l_quantity > 40")  # noqa: E741
    source = F.when(F.col("l_returnflag") == "A", "JOERN").when(F.col("l_returnflag") == "N", "SCIP")
    errors = l.select(F.col("l_orderkey").alias("seq"), source.alias("source"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("message"))
    symbols = r.select(F.col("src").alias("id"), "kind", "seq", "source", F.lit("h").alias("content_hash"), "properties")
    return snapshot.normalize(symbols, r, errors)[2]


_SNAP = "(SELECT o_orderkey AS id, o_orderstatus AS content_hash, o_orderpriority AS prio, o_custkey FROM orders)"


def _snap(spark, sf):
    o = bridge.tables(spark, sf)["orders"]
    node = lambda df, prio: df.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("content_hash"), F.create_map(F.lit("b"), prio, F.lit("a"), F.lit("1")).alias("properties"))
    flip = lambda prio: F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), prio)
    old = node(o.where("o_orderkey % 11 <> 0"), F.col("o_orderpriority"))
    new = o.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("content_hash"), flip(F.when(F.col("o_custkey") % 5 == 0, "X").otherwise(F.col("o_orderpriority"))).alias("properties"))
    return old, new


@query(f"""SELECT CASE WHEN id % 11 = 0 THEN 'CREATE' WHEN id % 13 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS op, CAST(id AS STRING) AS id FROM {_SNAP}
WHERE (id % 11 = 0) <> (id % 13 = 0) OR (id % 11 <> 0 AND id % 13 <> 0 AND o_custkey % 5 = 0)""")
def p11_property_changes(spark, sf):
    """A changed property is an update; the order of a map's keys is none."""
    return snapshot.diff(*_snap(spark, sf), ["id"], ["content_hash", "properties"])


@query(f"""SELECT count(*) FILTER (id % 11 = 0 AND id % 13 <> 0) AS created, count(*) FILTER ((id % 13 = 0 AND id % 11 <> 0) OR (id % 11 <> 0 AND id % 13 <> 0 AND o_custkey % 5 = 0)) AS changed FROM {_SNAP}""")
def a12_op_counts(spark, sf):
    old, new = _snap(spark, sf)
    none = spark.createDataFrame([], "kind string, src string, dst string, content_hash string")
    return snapshot.count_ops(snapshot.graph_delta(old, none, new, none, ["content_hash", "properties"]))


@query(f"""SELECT 'CREATE' AS op, CAST(id AS STRING) AS a, 'r1' AS target_revision, 0 AS phase FROM {_SNAP} WHERE id % 13 <> 0""")
def d2_first_delta(spark, sf):
    """Without a stored snapshot everything is created."""
    _, new = _snap(spark, sf)
    none = spark.createDataFrame([], "kind string, src string, dst string, content_hash string")
    return snapshot.maps_delta(None, (new, none), None, "r1", ["content_hash", "properties"]).select("op", "a", "target_revision", "phase")


@query(f"""SELECT CAST(id AS STRING) AS id, CASE WHEN o_custkey % 5 = 0 AND id % 13 <> 0 THEN 'X' ELSE prio END AS b FROM {_SNAP} WHERE id % 13 <> 0""")
def k9_ops_on_maps(spark, sf):
    """The ops of a diff applied to the old map give the new one."""
    old, new = _snap(spark, sf)
    none = spark.createDataFrame([], "kind string, src string, dst string, content_hash string")
    ops = stored(snapshot.graph_delta(old, none, new, none, ["content_hash", "properties"]))
    return snapshot.apply_to_maps(old, none, new, none, ops)[0].select("id", F.col("properties")["b"].alias("b"))


@query("""SELECT phase, op, entity, kind, a, b FROM (VALUES (0, 'CREATE', 'node', NULL, 'n1', NULL), (1, 'UPDATE', 'edge', 'CALLS', 'n1', 'n2'), (2, 'DELETE', 'edge', 'IMPORTS', 'n2', 'n1'), (3, 'DELETE', 'node', NULL, 'n3', NULL)) v(phase, op, entity, kind, a, b)""")
def d8_delta_builder(spark, sf):
    return snapshot.DeltaBuilder().create_node("n1").update_edge("CALLS", "n1", "n2").delete_edge("IMPORTS", "n2", "n1").delete_node("n3").ops(spark)


# The index run.
def _changes(spark, sf):
    p = bridge.tables(spark, sf)["part"]
    k = F.col("p_partkey") % 5
    path, null = F.concat(F.lit("f"), F.col("p_partkey").cast("string")), F.lit(None).cast("string")
    status = F.when(k == 0, "A").when(k == 1, "M").when(k == 2, "D").when(k == 3, "R")
    return p.select(status.alias("status"), F.when(k.isin(1, 2), path).when(k == 3, F.concat(path, F.lit("o"))).otherwise(null).alias("old_path"), F.when(k.isin(0, 1, 3), path).alias("new_path")).where("status is not null")


@query("""SELECT 'analyze' AS what, 'f' || p_partkey AS path FROM part WHERE p_partkey % 5 IN (0, 1, 3) UNION ALL SELECT 'remove', 'f' || p_partkey FROM part WHERE p_partkey % 5 IN (0, 1, 2, 3)
UNION ALL SELECT 'remove', 'f' || p_partkey || 'o' FROM part WHERE p_partkey % 5 = 3""")
def d3_incremental_plan(spark, sf):
    analyze, remove = snapshot.incremental_plan(_changes(spark, sf))
    return analyze.select(F.lit("analyze").alias("what"), "path").union(remove.select(F.lit("remove").alias("what"), "path"))


def _symbol_nodes(spark, sf, keep="true"):
    p = bridge.view(spark, sf, "parts").where(keep)
    none = F.lit(None)
    place = F.struct(
        F.lit("acme/shop").alias("repository"), F.lit("s1").alias("commit_sha"), F.concat(F.col("p_brand"), F.lit(".py")).alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("start_column"), F.lit(2).alias("end_line"),
        F.lit(1).alias("end_column"), none.cast("string").alias("branch"),
    )
    nodes = p.select("id", F.when(F.col("p_partkey") % 9 == 0, "TOPIC").otherwise("FUNCTION").alias("kind"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.when(F.col("p_partkey") % 9 != 0, place).alias("location"))
    edges = bridge.view(spark, sf, "edges").where("kind = 'IMPORTS'")
    return stored(nodes), stored(edges)


_SCAFFOLD = """s AS (SELECT id, p_brand || '.py' AS path FROM parts WHERE p_partkey % 9 <> 0), fl AS (SELECT DISTINCT path, sha256('acme/shop::file::' || path) AS fid FROM s),
k AS (SELECT sha256('acme/shop::repo') AS r, sha256('acme/shop::branch::main') AS b, sha256('acme/shop::commit::s2') AS c)"""


@query(f"""WITH {_SCAFFOLD} SELECT kind, src, dst FROM (SELECT 'HAS_BRANCH' AS kind, r AS src, b AS dst FROM k UNION ALL SELECT 'POINTS_TO', b, c FROM k UNION ALL SELECT 'CONTAINS_STATE_OF', c, id FROM s, k
UNION ALL SELECT 'HAS_FILE', c, fid FROM fl, k UNION ALL SELECT 'DEFINED_IN', s.id, sha256('acme/shop::file::' || s.path) FROM s UNION ALL SELECT 'IMPORTS', src, dst FROM imports)""")
def d5_scaffolding(spark, sf):
    return indexing.add_scaffolding(*_symbol_nodes(spark, sf), "acme/shop", "main", "s2")[1].select("kind", "src", "dst")


@query(f"""WITH {_SCAFFOLD} SELECT id, kind, name FROM (SELECT id, CASE WHEN p_partkey % 9 = 0 THEN 'TOPIC' ELSE 'FUNCTION' END AS kind, p_name AS name FROM parts UNION ALL SELECT fid, 'FILE', path FROM fl
UNION ALL SELECT r, 'REPOSITORY', 'acme/shop' FROM k UNION ALL SELECT b, 'BRANCH', 'main' FROM k UNION ALL SELECT c, 'COMMIT', 's2' FROM k)""")
def d5_scaffolding_nodes(spark, sf):
    return indexing.add_scaffolding(*_symbol_nodes(spark, sf), "acme/shop", "main", "s2")[0].select("id", "kind", "name")


@query("""WITH b AS (SELECT DISTINCT p_brand FROM part), gone AS (SELECT p_brand || '.py' AS path FROM b WHERE p_brand LIKE '%1'), cut AS (SELECT id FROM parts WHERE p_partkey % 9 <> 0 AND p_brand || '.py' IN (SELECT path FROM gone) AND p_partkey % 4 <> 0),
left_ AS (SELECT id FROM parts WHERE id NOT IN (SELECT id FROM cut))
SELECT 'node' AS what, id AS a, '' AS b FROM left_ UNION ALL SELECT 'IMPORTS', src, dst FROM imports WHERE src IN (SELECT id FROM left_) AND dst IN (SELECT id FROM left_)
UNION ALL SELECT 'POINTS_TO', sha256('acme/shop::branch::main'), sha256('acme/shop::commit::s3') UNION ALL SELECT 'HAS_BRANCH', sha256('acme/shop::repo'), sha256('acme/shop::branch::main')""")
def d4_incremental_merge(spark, sf):
    """The snapshot after some files changed: their old symbols go, fresh ones come, edges keep both ends, one commit is left."""
    nodes, edges = _symbol_nodes(spark, sf)
    prev = tuple(stored(x) for x in indexing.add_scaffolding(nodes, edges, "acme/shop", "main", "s2"))
    fresh = _symbol_nodes(spark, sf, "p_partkey % 4 = 0 and p_brand like '%1'")[0]
    removed = bridge.tables(spark, sf)["part"].where("p_brand like '%1'").select(F.concat("p_brand", F.lit(".py")).alias("path")).distinct()
    n, e = indexing.merge_incremental(prev, (fresh, edges.limit(0)), removed, "acme/shop", "main", "s3")
    ours = n.where("kind in ('FUNCTION', 'TOPIC')").select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit("").alias("b"))
    return ours.union(e.where("kind in ('IMPORTS', 'POINTS_TO', 'HAS_BRANCH')").select("kind", "src", "dst"))


_RUN = "class Part{k}:\n    def price(self):\n        return lookup(self)\n\ndef lookup(x):\n    return x\n"


def _sym(ns: str, container: str, name: str) -> str:
    """SQL of a symbol's id in the small files of the index run."""
    inside = f" || '::' || {container}" if container else ""
    return f"sha256('python::' || p_brand || '::' || {ns}{inside} || '::' || {name})"


_NS = "'src.m' || p_partkey"


@query(f"""WITH f AS (SELECT p_brand, {_sym(_NS, '', "'Part' || p_partkey")} AS part, {_sym(_NS, "'Part' || p_partkey", "'price'")} AS price, {_sym(_NS, '', "'lookup'")} AS lookup,
sha256('Brand#99::file::src/m' || p_partkey || '.py') AS fid FROM part), c AS (SELECT sha256('Brand#99::commit::s1') AS c, sha256('Brand#99::branch::main') AS b, sha256('Brand#99::repo') AS r)
SELECT 'CALLS' AS kind, price AS src, lookup AS dst FROM f UNION ALL SELECT 'CONTAINS_STATE_OF', c, unnest([part, price, lookup]) FROM f, c UNION ALL SELECT 'DEFINED_IN', unnest([part, price, lookup]), fid FROM f
UNION ALL SELECT 'HAS_FILE', c, fid FROM f, c UNION ALL SELECT 'HAS_BRANCH', r, b FROM c UNION ALL SELECT 'POINTS_TO', b, c FROM c""")
def x42_index_run(spark, sf):
    """Edges of an index run over one file for each part: symbols, calls and scaffolding; imports and unresolved calls dangle."""
    files = _part_files(spark, sf, "src/m{k}.py", None, _RUN).drop("language", "tier")
    return indexing.index_files(files, "Brand#99", "main", "s1").edges.select("kind", "src", "dst")


@query("""SELECT p_brand AS repo_id, 'main' AS branch, f AS file FROM (SELECT p_brand, 'src/m' || p_partkey || '.py' AS f FROM part WHERE p_partkey % 2 = 0 UNION SELECT p_brand, 'src/m' || p_partkey || '.js' FROM part WHERE p_partkey % 3 = 0)""")
def a13_contract_files(spark, sf):
    return _two_inventories(spark, sf)[0].files()


def _two_inventories(spark, sf):
    p = bridge.tables(spark, sf)["part"]
    row = lambda df, ext, v: df.select(F.col("p_brand").alias("repo_id"), F.lit("main").alias("branch"), F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(ext)).alias("file"), F.lit(v).alias("value"))
    old = indexing.Contracts({"provides": row(p.where("p_partkey % 2 = 0"), ".py", "old"), "consumes": row(p.where("p_partkey % 3 = 0"), ".js", "old")})
    fresh = indexing.Contracts({"provides": row(p.where("p_partkey % 4 = 0"), ".py", "new"), "consumes": row(p.where("p_partkey % 5 = 0"), ".js", "new")})
    return old, fresh


@query("""SELECT 'src/m' || p_partkey || '.py' AS file, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE 'old' END AS value FROM part WHERE p_partkey % 4 = 0 OR (p_partkey % 2 = 0 AND p_partkey % 7 <> 0)
UNION ALL SELECT 'src/m' || p_partkey || '.js', CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE 'old' END FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 3 = 0""")
def u6_replaced_files(spark, sf):
    """Contracts after a run over changed files: rows of removed files go, fresh rows stand for all of their files."""
    old, fresh = _two_inventories(spark, sf)
    gone = bridge.tables(spark, sf)["part"].where("p_partkey % 7 = 0").select(F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    out = old.without(gone).replaced(fresh)
    return out.tables["provides"].union(out.tables["consumes"]).select("file", "value")


@query("""SELECT p_brand AS repo_id, 'src/m' || p_partkey || '.py' AS file, count(*) AS n FROM part, (VALUES ('old'), ('new')) v(x) WHERE (x = 'old' AND p_partkey % 2 = 0) OR (x = 'new' AND p_partkey % 4 = 0) GROUP BY 1, 2""")
def u1_merged_contracts(spark, sf):
    old, fresh = _two_inventories(spark, sf)
    return old.merged(fresh).tables["provides"].groupBy("repo_id", "file").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p.file, p.line, arg_min(s.id, s.seq) AS handler FROM (SELECT DISTINCT l_orderkey % 100 AS file, CAST(l_partkey % 320 AS INT) AS line, 'n' || l_partkey % 40 AS hint FROM lineitem) p
JOIN (SELECT o_orderkey % 100 AS file, CAST(o_orderkey AS STRING) AS id, 'n' || o_custkey % 30 AS name, o_orderkey AS seq FROM orders) s ON s.file = p.file AND s.name = p.hint GROUP BY p.file, p.line, p.hint""")
def j17_handlers_by_name(spark, sf):
    """The first function of a file that bears the name which a line hints at."""
    t = bridge.tables(spark, sf)
    spans = t["orders"].selectExpr("o_orderkey % 100 AS file", "CAST(o_orderkey AS STRING) AS id", "concat('n', o_custkey % 30) AS name", "1 AS start", "0 AS end", "o_orderkey AS seq")
    points = t["lineitem"].selectExpr("l_orderkey % 100 AS file", "CAST(l_partkey % 320 AS INT) AS line", "concat('n', l_partkey % 40) AS hint").distinct()
    return joins.resolve_handlers(points, spans, ["file"], forward=False).where("handler is not null").select("file", "line", "handler")


@query("""WITH c AS (SELECT DISTINCT l_orderkey % 50 AS file, 'c' || l_suppkey % 5 AS container, 'n' || l_partkey % 60 AS callee FROM lineitem), d AS (SELECT o_orderkey % 50 AS file, 'c' || o_custkey % 5 AS container, 'n' || o_orderkey % 45 AS name, CAST(o_orderkey AS STRING) AS id, o_orderkey AS seq FROM orders)
SELECT c.file, c.container, c.callee, arg_min(d.id, CASE WHEN d.container = c.container THEN 0 ELSE 1 END * 100000000 + d.seq) AS target, CASE WHEN count(d.id) = 0 THEN 'unresolved' ELSE 'local' END AS resolved
FROM c LEFT JOIN d ON d.file = c.file AND d.name = c.callee GROUP BY c.file, c.container, c.callee""")
def j18_resolve_calls(spark, sf):
    t = bridge.tables(spark, sf)
    calls = t["lineitem"].selectExpr("l_orderkey % 50 AS file", "concat('c', l_suppkey % 5) AS container", "concat('n', l_partkey % 60) AS callee").distinct()
    defs = t["orders"].selectExpr("o_orderkey % 50 AS file", "concat('c', o_custkey % 5) AS container", "concat('n', o_orderkey % 45) AS name", "CAST(o_orderkey AS STRING) AS id", "o_orderkey AS seq")
    return joins.resolve_calls(calls, defs)


# The link pass.
def _hinted(spark, sf):
    """Contracts whose consumer names a configured base URL on every third page, and evidence of a target on every fifth."""
    consumes, provides = _contracts(spark, sf)
    hint = F.when(F.col("cid") % 3 == 0, F.concat(F.lit("https://API"), (F.col("cid") % 6).cast("string"), F.lit(".local:8080/x")))
    consumes = consumes.withColumn("target_hint", hint).withColumn("caller_id", F.concat(F.lit("c"), F.col("cid").cast("string")))
    provides = provides.withColumn("handler_id", F.concat(F.lit("p"), F.col("pid").cast("string")))
    urls = spark.createDataFrame([("https://api0.local", "none-such"), ("http://api3.local", "never")], "prefix string, value string")
    ev = consumes.where("cid % 5 = 0").select(
        "repo_id", "branch", F.lit("OPENAPI").alias("kind"), F.concat(F.lit("GET https://h"), F.col("route")).alias("value"), F.lit("").alias("detail"), F.lit(".env").alias("file"), F.lit("").alias("channel"), F.lit("").alias("broker"),
        F.regexp_replace("repo_id", "^[^.]*[.]([^.]*[.]example)", "$1").alias("target_repo"), F.col("cid").alias("seq"),
    )
    return consumes, provides, urls, ev


_ALLOWED = f"""e AS (SELECT repo_id, branch, route, regexp_replace(repo_id, '^[^.]*[.]([^.]*[.]example)', '\\1') AS target, cid AS seq FROM {_C} WHERE cid % 5 = 0),
k AS (SELECT c.cid, -1 AS seq, 'none-such' AS repo FROM {_C} c WHERE c.cid % 6 = 0
  UNION ALL SELECT c.cid, e.seq, e.target FROM {_C} c JOIN e ON e.repo_id = c.repo_id AND e.branch = c.branch AND e.route = c.route),
lim AS (SELECT cid, CASE WHEN count(DISTINCT repo) = 1 THEN any_value(repo) ELSE arg_min(repo, seq) END AS repo FROM k GROUP BY cid),
m AS (SELECT x.*, lim.cid IS NOT NULL AS restricted FROM ({_MATCH}) x LEFT JOIN lim ON lim.cid = x.cid WHERE lim.repo IS NULL OR lim.repo = x.p_repo)"""


@query(f"""WITH {_ALLOWED} SELECT cid, pid, restricted, CASE WHEN count(DISTINCT p_repo) OVER (PARTITION BY cid) > 1 THEN 'low' WHEN restricted THEN 'high' ELSE 'medium' END AS confidence FROM m""")
def j6_restricted_matches(spark, sf):
    """Matches that base URLs and API descriptions leave; several limits are intersected, or else the first one counts."""
    consumes, provides, urls, ev = _hinted(spark, sf)
    return links.matched_services(consumes, provides, urls, ev).select("cid", "pid", "restricted", "confidence")


@query(f"""SELECT c.cid, e.cid AS seq FROM {_C} c JOIN (SELECT * FROM {_C} WHERE cid % 5 = 0) e ON e.repo_id = c.repo_id AND e.branch = c.branch AND e.route = c.route""")
def j8_evidence_routes(spark, sf):
    consumes, _, _, ev = _hinted(spark, sf)
    return links.evidence_constraints(consumes, ev).select("cid", "seq")


@query("""WITH c AS (SELECT page_id, 'm' || page_id % 40 AS method, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/rpc' WHEN 2 THEN '/health' ELSE '/v' || page_id % 3 END AS route FROM pages)
SELECT a.page_id AS cid, b.page_id AS pid FROM c a JOIN c b ON a.method = b.method AND (a.route = '' OR b.route = '' OR a.route = b.route) AND a.route <> '/health' AND b.route <> '/health'""")
def j4_jsonrpc_join(spark, sf):
    n = F.col("page_id")
    route = F.when(n % 4 == 0, "").when(n % 4 == 1, "/rpc").when(n % 4 == 2, "/health").otherwise(F.concat(F.lit("/v"), (n % 3).cast("string")))
    p = bridge.tables(spark, sf)["pages"].select("page_id", F.concat(F.lit("m"), (n % 40).cast("string")).alias("method"), route.alias("route"))
    return joins.jsonrpc_matches(p.withColumnRenamed("page_id", "cid"), p.withColumnRenamed("page_id", "pid"))


@query(f"""WITH {_ALLOWED}, c AS (SELECT *, CASE cid % 6 WHEN 0 THEN 'api0.local:8080' WHEN 3 THEN 'api3.local:8080' ELSE route END AS alone FROM {_C})
SELECT DISTINCT 'c' || m.cid AS src, 'p' || m.pid AS dst, CASE WHEN count(DISTINCT m.p_repo) OVER (PARTITION BY m.cid) > 1 THEN 'low' WHEN restricted THEN 'high' ELSE 'medium' END AS confidence,
c.route AS route, c_repo || '@' || c_branch || ' -> ' || p_repo || '@' || p_branch AS pairs FROM m JOIN c ON c.cid = m.cid
UNION ALL SELECT 'c' || cid, sha256('resource::api::' || lower(alone)), 'low', route, repo_id || '@' || branch FROM c WHERE cid NOT IN (SELECT cid FROM m)""")
def l2_call_edges(spark, sf):
    """CALLS_API edges with properties and branch pairs, and those of unmatched routes to external APIs."""
    e = links.call_edges(*_hinted(spark, sf))
    return e.select("src", "dst", F.col("properties")["confidence"].alias("confidence"), F.col("properties")["route"].alias("route"), F.array_join("branch_pairs", ",").alias("pairs"))


@query(f"""WITH {_ALLOWED}, n AS (SELECT cid, string_agg(DISTINCT p_repo, ',' ORDER BY p_repo) AS repos, count(DISTINCT p_repo) AS k FROM m GROUP BY cid)
SELECT DISTINCT 'c' || m.cid AS src, 'p' || m.pid AS dst, 'route=' || c.route || CASE WHEN n.k > 1 THEN ';candidates=' || n.repos ELSE '' END AS evidence FROM m JOIN {_C} c ON c.cid = m.cid JOIN n ON n.cid = m.cid WHERE NOT m.restricted""")
def l3_link_evidence(spark, sf):
    """What matches without restriction rest on: the route, and the candidates where there are several."""
    e = links.call_edges(*_hinted(spark, sf)).where(~F.exists("evidence", lambda x: x["kind"].isin("unmatched", "target_hint", "openapi")))
    return e.select("src", "dst", F.array_join(F.transform("evidence", lambda x: F.concat_ws("=", x["kind"], x["detail"])), ";").alias("evidence"))


@query("""SELECT DISTINCT CASE k WHEN 0 THEN 'a.b' WHEN 1 THEN '/v1/*' WHEN 2 THEN 'host.c' ELSE NULL END AS identity, k FROM (SELECT page_id % 5 AS k FROM pages)""")
def l5_external_apis(spark, sf):
    k = F.col("page_id") % 5
    hint = F.when(k == 0, "HTTPS://A.b/x?y").when(k == 2, "Host.c/path").when(k == 3, "").otherwise(F.lit(None))
    route = F.when(k == 1, "/v1/{id}").when(k == 3, "/api/health").otherwise("/")
    return bridge.tables(spark, sf)["pages"].select(links.api_identity_of(hint, route).alias("identity"), k.alias("k")).distinct()


def _link_sets(spark, sf):
    """Two link sets of the same services: later, other brokers are configured and a third of the channels has gone."""
    e = bridge.tables(spark, sf)["events"]
    n = F.col("user_id")
    heads = spark.createDataFrame([("r0", "main", "commit-0"), ("r1", "main", "commit-1"), ("r2", "main", "commit-2")], "repo_id string, branch string, commit_id string")
    channels = e.select(
        F.concat(F.lit("r"), (n % 3).cast("string")).alias("repo_id"), F.lit("main").alias("branch"), F.concat(F.col("event_type"), F.lit("-"), (n % 20).cast("string")).alias("channel"), F.lit("sqs").alias("broker"), F.lit("").alias("channel_type"),
        F.when(F.col("event_id") % 2 == 0, "publish").otherwise("subscribe").alias("direction"), n.cast("string").alias("node_id"), F.col("event_id").alias("seq"), "user_id",
    )
    brokers = e.select(F.upper(F.concat(F.col("event_type"), F.lit("-1"))).alias("key"), F.lit("Kafka").alias("value")).distinct()
    contract = {k: spark.createDataFrame([], v) for k, v in _EMPTY.items()}

    def make(ch, br):
        found = links.compute_links(heads, contract["provides"], contract["consumes"], ch, contract["resources"], contract["evidence"], _pairs(spark, "prefix"), br, _pairs(spark, "key"))
        return links.LinkSet(stored(found.edges, "case-edges"), stored(found.topics, "case-topics"), stored(found.resources, "case-resources"))

    return make(channels.drop("user_id"), _pairs(spark, "key")), make(channels.where("user_id % 4 <> 0").drop("user_id"), brokers)


_EMPTY = {
    "provides": "pid long, repo_id string, branch string, mechanism string, http_method string, route string, service string, method string, handler_id string",
    "consumes": "cid long, repo_id string, branch string, mechanism string, http_method string, route string, service string, method string, target_hint string, caller_id string",
    "resources": "repo_id string, branch string, resource_type string, mechanism string, access string, raw_target string, node_id string, seq long",
    "evidence": "repo_id string, branch string, file string, seq long, kind string, value string, detail string, target_repo string, channel string, broker string",
}
_CH = """(SELECT user_id, event_id, event_type || '-' || user_id % 20 AS channel, 'commit-' || user_id % 3 AS c, user_id % 4 AS g, user_id % 20 = 1 AS kafka FROM events)"""


@query(f"""SELECT sha256('topic::sqs::' || lower(channel)) AS id, 'sqs' AS broker, channel, 'queue' AS channel_type, string_agg(DISTINCT c, ',' ORDER BY c) AS commits FROM {_CH} GROUP BY channel""")
def a5_topic_hubs(spark, sf):
    """Topics with the commits that hold them."""
    return _link_sets(spark, sf)[0].topics.select("id", "broker", "channel", "channel_type", F.array_join("commits", ",").alias("commits"))


@query(f"""WITH o AS (SELECT *, sha256('topic::sqs::' || lower(channel)) AS id, CASE WHEN event_id % 2 = 0 THEN 'PUBLISH_TO' ELSE 'CONSUME_FROM' END AS kind FROM {_CH}),
n AS (SELECT *, sha256('topic::' || CASE WHEN kafka THEN 'kafka' ELSE 'sqs' END || '::' || lower(channel)) AS id, CASE WHEN event_id % 2 = 0 THEN 'PUBLISH_TO' ELSE 'CONSUME_FROM' END AS kind FROM {_CH} WHERE g <> 0),
t AS (SELECT 'TOPIC' AS entity, a.id AS o, b.id AS n FROM (SELECT DISTINCT id FROM o) a FULL JOIN (SELECT DISTINCT id FROM n) b ON a.id = b.id),
e AS (SELECT 'EDGE' AS entity, a.x AS o, b.x AS n FROM (SELECT DISTINCT kind || chr(31) || user_id || chr(31) || id AS x FROM o) a FULL JOIN (SELECT DISTINCT kind || chr(31) || user_id || chr(31) || id AS x FROM n) b ON a.x = b.x),
h AS (SELECT 'CONTAINS' AS entity, a.x AS o, b.x AS n FROM (SELECT DISTINCT c || chr(31) || id AS x FROM o) a FULL JOIN (SELECT DISTINCT c || chr(31) || id AS x FROM n) b ON a.x = b.x)
SELECT CASE entity WHEN 'TOPIC' THEN CASE WHEN o IS NULL THEN 0 ELSE 8 END WHEN 'EDGE' THEN CASE WHEN o IS NULL THEN 4 ELSE 5 END ELSE CASE WHEN o IS NULL THEN 6 ELSE 7 END END AS phase,
CASE WHEN o IS NULL THEN 'CREATE' ELSE 'DELETE' END AS op, entity, coalesce(o, n) AS key FROM (SELECT * FROM t UNION ALL SELECT * FROM e UNION ALL SELECT * FROM h) WHERE o IS NULL OR n IS NULL""")
def l4_link_delta(spark, sf):
    """Topics, edges and containment between two whole link sets."""
    return links.link_delta(*_link_sets(spark, sf))


@query(f"""SELECT DISTINCT sha256('topic::' || b || '::' || lower(channel)) AS id, 'TOPIC' AS kind, channel AS name, b || '/' || channel AS qualified_name, 'broker=' || b || ',channel=' || channel || ',channel_type=' || CASE b WHEN 'sqs' THEN 'queue' ELSE 'topic' END AS properties
FROM (SELECT *, CASE WHEN kafka THEN 'kafka' ELSE 'sqs' END AS b FROM {_CH} WHERE g <> 0)""")
def l7_topic_nodes(spark, sf):
    n = links.topic_nodes(_link_sets(spark, sf)[1].topics)
    return n.select("id", "kind", "name", "qualified_name", F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("properties"))


@query(f"""SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'PUBLISH_TO' ELSE 'CONSUME_FROM' END AS kind, CAST(user_id AS STRING) AS src, sha256('topic::' || b || '::' || lower(channel)) AS dst, CASE b WHEN 'kafka' THEN 'high' ELSE 'medium' END AS confidence, b AS mechanism, 'r' || user_id % 3 || '@main' AS pairs
FROM (SELECT *, CASE WHEN kafka THEN 'kafka' ELSE 'sqs' END AS b FROM {_CH} WHERE g <> 0)""")
def l1_compute_links(spark, sf):
    e = _link_sets(spark, sf)[1].edges
    return e.select("kind", "src", "dst", F.col("properties")["confidence"].alias("confidence"), F.col("properties")["mechanism"].alias("mechanism"), F.array_join("branch_pairs", ",").alias("pairs"))


@query("SELECT 'unchanged' AS what, 0 AS n")
def l8_equal_link_sets(spark, sf):
    """An equal link set changes nothing."""
    a = _link_sets(spark, sf)[0]
    return links.link_delta(a, a).agg(F.lit("unchanged").alias("what"), F.count(F.lit(1)).cast("int").alias("n"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'bucket' WHEN 3 THEN 'api' ELSE 'database' END AS resource_type, CASE p_partkey % 4 WHEN 0 THEN 'b' || p_partkey WHEN 1 THEN 'postgres://db/p' || p_partkey WHEN 2 THEN 'odd:' || p_partkey ELSE 'h.local' END AS identity FROM part""")
def j13_registry(spark, sf):
    """A registry entry resolves a target, in any case; a known class before a colon overrides the reference's one."""
    p = bridge.tables(spark, sf)["part"]
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    value = F.when(k == 0, F.concat(F.lit("Bucket: S3://B"), n, F.lit("/x"))).when(k == 1, F.concat(F.lit("postgresql://u:p@db:5432/p"), n)).when(k == 2, F.concat(F.lit("odd:"), n)).otherwise("api:https://H.local/x")
    refs = p.select("p_partkey", F.lit("r").alias("repo_id"), F.lit("b").alias("branch"), F.lit("database").alias("resource_type"), F.concat(F.lit("${DB_"), n, F.lit("}")).alias("raw_target"))
    table = p.select(F.concat(F.lit("${db_"), n, F.lit("}")).alias("key"), value.alias("value"))
    none = spark.createDataFrame([], _EMPTY["evidence"])
    return links.resolve_resources(refs, table, none).select("p_partkey", "resource_type", "identity")


# Scalar functions over texts made from ids; the SQL builds the answer from the same ids.
def scalar(name: str, sql: str, *exprs) -> None:
    """Register a query of (name, expression of the part's key as text) columns over all parts."""

    def run(spark, sf):
        k = F.col("p_partkey").cast("string")
        return bridge.tables(spark, sf)["part"].select("p_partkey", *[make(k).alias(out) for out, make in exprs])

    run.__name__ = name
    query(f"SELECT p_partkey, {sql.replace('{k}', 'CAST(p_partkey AS VARCHAR)')} FROM part")(run)


def _text(*parts):
    """A text around the key: strings and, for None, the key."""
    return lambda k: F.concat(*[k if p is None else F.lit(p) for p in parts])


def _of(f, *parts):
    return lambda k: f(_text(*parts)(k))


def _ident(kind: str, *parts):
    return lambda k: text.normalize_identity(F.lit(kind), _text(*parts)(k))


scalar(
    "f2_segments", "'/a/*/' || {k} AS braces, '/*' AS colon, '/*/' || {k} AS angle, '/v' || {k} AS host, '/*/x' AS mixed, '/' AS empty",
    ("braces", _of(text.normalize_route, "/a/{id}//", None, "/")), ("colon", _of(text.normalize_route, "/:x", None)), ("angle", _of(text.normalize_route, "'/<i>/", None, "'")),
    ("host", _of(text.normalize_route, "https://h:8/v", None, "?q=/a#b")), ("mixed", _of(text.normalize_route, "/a${b", None, "}/x")), ("empty", _of(text.normalize_route, "  ")),
)
scalar(
    "p13_generic_routes", "true AS health, false AS longer, true AS icon, true AS root, true AS nested, false AS probe",
    ("health", lambda k: text.is_generic_route(F.lit("/health"))), ("longer", lambda k: text.is_generic_route(F.concat(F.lit("/healthcheck"), k))), ("icon", lambda k: text.is_generic_route(F.concat(F.lit("/x"), k, F.lit("/favicon.ico")))),
    ("root", lambda k: text.is_generic_route(F.lit("/"))), ("nested", lambda k: text.is_generic_route(F.concat(F.lit("/v"), k, F.lit("/readiness")))), ("probe", lambda k: text.is_generic_route(F.concat(F.lit("/livez"), k))),
)
scalar(
    "p14_templates", "true AS dollar, true AS shell, true AS braces, false AS plain",
    ("dollar", _of(text.has_template, "a${X", None, "}")), ("shell", _of(text.has_template, "a$(X", None, ")")), ("braces", _of(text.has_template, "{{x", None, "}}")), ("plain", _of(text.has_template, "a{x", None, "}")),
)
scalar(
    "f4_buckets", "'data' || {k} AS s3, 'data' || {k} AS gcs, 'data' || {k} AS virtual, 'data' || {k} AS path, 'data' || {k} AS bare, 'h.local' AS other",
    ("s3", _ident("bucket", "s3://Data", None, "/x/y")), ("gcs", _ident("bucket", "https://storage.googleapis.com/data", None, "/key")), ("virtual", _ident("bucket", "https://data", None, ".s3.us-east-1.amazonaws.com/key")),
    ("path", _ident("bucket", "https://s3.amazonaws.com/data", None, "/key")), ("bare", _ident("Bucket", " DATA", None, " ")), ("other", lambda k: text.normalize_identity(F.lit("bucket"), F.lit("https://h.local"))),
)
scalar(
    "f5_databases", """'postgres://db.internal/app' || {k} AS plain, 'postgres://db:6543/app' || {k} AS port, 'sqlserver://h/d' || {k} AS mssql, 'amqp://[::1]/v' || {k} AS six, 'cockroach://c/x' || {k} AS roach,
    'db:1521/svc' || {k} AS thin, 'mysql://h/d' || {k} AS jdbc, CAST(NULL AS VARCHAR) AS nohost""",
    ("plain", _ident("database", "postgres://App:S3@db.internal:5432/app", None, "?ssl=1")), ("port", _ident("database", "pgsql://db:6543/app", None)), ("mssql", _ident("database", "mssql://h:1433/d", None, "/")),
    ("six", _ident("database", "amqps://u@[::1]:5672/v", None)), ("roach", _ident("database", "cockroachdb://c:26257/x", None)), ("thin", _ident("database", "user/pass@db:1521/svc", None)), ("jdbc", _ident("database", "jdbc:mariadb://h:3306/d", None)),
    ("nohost", _ident("database", "postgres:///x", None)),
)
scalar(
    "f6_keyword_dsn", "'db.internal:5432/app' || {k} AS words, 'h/my db' || {k} AS quoted, 's:1/last' || {k} AS other, 'hostname=' AS none",
    ("words", _ident("database", "host=db.internal dbname=app", None, " port=5432")), ("quoted", _ident("database", 'host="h" dbname="my db', None, '"')), ("other", _ident("database", "server=s;host=;port=1&db=x&database=last", None)),
    ("none", lambda k: text.normalize_identity(F.lit("database"), F.lit("hostname="))),
)
scalar(
    "f7_functions_tables_apis", "'go' || {k} AS arn, 'f.cloudfunctions.net/w' || {k} AS gcf, 'b' || {k} || '.run.app' AS run, 'orders' || {k} AS tarn, 'orders' || {k} AS bare, 'x.amazonaws.com' AS api, '/o/*/' || {k} AS route",
    ("arn", _ident("function", "arn:aws:lambda:eu:1:function:Go", None, ":live")), ("gcf", _ident("function", "https://F.cloudfunctions.net/w", None, "/x")), ("run", _ident("function", "https://b", None, ".run.app/v1")),
    ("tarn", _ident("table", "arn:aws:dynamodb:eu:1:table/Orders", None, "/index/i")), ("bare", _ident("table", "Orders", None)), ("api", _ident("api", "https://X.amazonaws.com/p", None)), ("route", _ident("api", "/O/{id}/", None)),
)
scalar(
    "f9_hosts_ports", "'h' || {k} AS host, '80' AS port, 'h:x' || {k} AS kept, '' AS none, '[::1]' AS six, '8' || {k} AS sixport, 'a' || {k} AS seg",
    ("host", _of(text.bare_host, "h", None, ":80")), ("port", _of(text.port_of, "h", None, ":80")), ("kept", _of(text.bare_host, "h:x", None)), ("none", _of(text.port_of, "h:x", None)), ("six", _of(text.bare_host, "[::1]:8", None)),
    ("sixport", _of(text.port_of, "[::1]:8", None)), ("seg", _of(text.first_segment, "//a", None, "/b?c")),
)
scalar(
    "f10_access_edges", "'READS_FROM' AS r, 'WRITES_TO' AS w, 'QUERIES' AS q, CAST(NULL AS VARCHAR) AS none",
    ("r", lambda k: text.resource_edge_kind(F.lit(" Read "))), ("w", lambda k: text.resource_edge_kind(F.lit("write"))), ("q", lambda k: text.resource_edge_kind(F.lit("query"))), ("none", lambda k: text.resource_edge_kind(F.lit("frobnicate"))),
)
scalar(
    "f11_access", "'write' AS put, 'read' AS got, 'connect' AS plain, 'write' AS wins",
    ("put", lambda k: text.infer_access(F.concat(F.lit("s3.put_object("), k), "connect")), ("got", lambda k: text.infer_access(F.concat(F.lit("x.Get-Item("), k), "connect")),
    ("plain", lambda k: text.infer_access(F.concat(F.lit("input = compute(x"), k), "connect")), ("wins", lambda k: text.infer_access(F.concat(F.lit("read and delete"), k), "connect")),
)
scalar(
    "f13_identifiers", "4 AS at, 0 AS inside, 'svc' AS receiver, 'c' || {k} AS last, 'show' || {k} AS hint",
    ("at", lambda k: text.word_at(F.concat(F.lit("a, rpc x"), k), "rpc")), ("inside", lambda k: text.word_at(F.concat(F.lit("grpcs"), k), "rpc")), ("receiver", lambda k: text.receiver_before(F.lit("x = svc.call(1)"), "call")),
    ("last", _of(text.last_segment, "a::b.c", None)), ("hint", lambda k: text.handler_hint(F.concat(F.lit("app.get('/x', auth, ctl.show"), k, F.lit(")")), F.lit("/x"))),
)
scalar(
    "f14_call_sites", "'a.b,c.d' || {k} AS sites",
    ("sites", lambda k: F.array_join(F.transform(text.call_sites(F.concat(F.lit("x = a.b(c.d"), k, F.lit("(1)) + e.f"))), lambda s: F.concat_ws(".", s["receiver"], s["method"])), ",")),
)
scalar(
    "f15_url_pieces", "'h' || {k} || ':8' AS host, '/p/q' AS path, 'q' || {k} AS tail, '/x' || {k} AS stripped",
    ("host", _of(text.url_host, "HTTP://u@H", None, ":8/p")), ("path", _of(text.url_path, "http://h", None, "/p/q?x")), ("tail", _of(text.tail_segment, "a/q", None, "/")), ("stripped", _of(text.strip_template_prefix, "${BASE}/x", None)),
)
scalar(
    "f16_arguments", "'t' || {k} AS camel, 'u' || {k} AS snake, 'v' || {k} AS call, CAST(NULL AS VARCHAR) AS none",
    ("camel", lambda k: text.arg_quoted(F.concat(F.lit("get(TableName='t"), k, F.lit("')")), "TableName")), ("snake", lambda k: text.arg_quoted(F.concat(F.lit("table_name: \"u"), k, F.lit("\"")), "TableName")),
    ("call", lambda k: text.arg_quoted(F.concat(F.lit("x.table('v"), k, F.lit("')")), "table")), ("none", lambda k: text.arg_quoted(F.concat(F.lit("TableName t"), k), "TableName")),
)
scalar(
    "f17_environment", "'A' || {k} || ',B_C,D' AS names, 'bucket' AS bucket, 'database' AS uri, 'function' AS fn, 'dataset' AS ds, CAST(NULL AS VARCHAR) AS none",
    ("names", lambda k: F.array_join(text.extract_env_vars(F.concat(F.lit("${A"), k, F.lit("} $( B_C ) $D $lower ${x}"))), ",")), ("bucket", _of(text.env_var_kind, "DB_BUCKET", None)), ("uri", _of(text.env_var_kind, "SOME_URI", None)),
    ("fn", _of(text.env_var_kind, "FUNCTION_URL", None)), ("ds", _of(text.env_var_kind, "DATASET", None)), ("none", _of(text.env_var_kind, "COLOR", None)),
)
scalar(
    "f18_tables", "'p.d.t' || {k} AS ticked, 'p.d.t' || {k} AS bare, CAST(NULL AS VARCHAR) AS two, true AS ds, false AS digits",
    ("ticked", _of(text.table_ref, "select 1 from `p.d.t", None, "`")), ("bare", _of(text.table_ref, " p.d.t", None)), ("two", _of(text.table_ref, "d.t", None)), ("ds", _of(text.dataset_ref, "d.t", None)), ("digits", _of(text.dataset_ref, "1.", None)),
)
scalar(
    "f20_spans_topics", "'a' || {k} || ',b' AS spans, true AS topic, false AS word, false AS short, false AS stop",
    ("spans", lambda k: F.array_join(text.backtick_spans(F.concat(F.lit("x `a"), k, F.lit("` y `b` `z"))), ",")), ("topic", _of(text.topic_shaped, "order.created-", None)), ("word", _of(text.topic_shaped, "order", None)),
    ("short", lambda k: text.topic_shaped(F.lit("a."))), ("stop", lambda k: text.topic_shaped(F.lit("https"))),
)
scalar(
    "f21_env_keys", "true AS url, true AS dotted, false AS color, 'orders' || {k} AS channel, 'kafka' AS broker, 'rabbitmq' AS amqp, '' AS none",
    ("url", lambda k: text.is_env_key(F.lit('"api_url"'))), ("dotted", lambda k: text.is_env_key(F.lit("spring.jobs_queue"))), ("color", lambda k: text.is_env_key(F.lit("COLOR"))),
    ("channel", lambda k: text.env_channel(F.lit("X_TOPIC"), F.concat(F.lit(" orders"), k))), ("broker", lambda k: text.env_broker(F.lit("X_BOOTSTRAP_SERVERS"))), ("amqp", lambda k: text.env_broker(F.lit("my_amqp_url"))), ("none", lambda k: text.env_broker(F.lit("URL"))),
)
scalar(
    "f22_names", "'src.a' || {k} AS ns, 'py::r::src::C::f' || {k} AS qualified, 'get' || {k} AS base, 'List.of' || {k} AS bare, 'Map' || {k} AS deep",
    ("ns", _of(text.namespace_for_path, "src/a", None, ".py")), ("qualified", lambda k: text.qualified_name(F.lit("py"), F.lit("r"), F.lit("src"), F.lit("C"), F.concat(F.lit("f"), k))), ("base", _of(text.base_name, "a<b<c>>::d.get", None, " ")),
    ("bare", _of(text.strip_generics, "List<A<B>>.of", None)), ("deep", _of(text.strip_generics, "Map<a<b<c<d<e<f>>>>>>", None)),
)
scalar(
    "f23_safe_names", "'a_b_' || {k} AS safe, 'shop' || {k} AS repo", ("safe", _of(text.safe_segment, "a/b ", None)), ("repo", _of(text.repo_name_from_url, "https://g.local/acme/shop", None, ".git/")),
)
scalar(
    "f24_branches", "'feat/x' || {k} AS branch, CAST(NULL AS VARCHAR) AS tag", ("branch", _of(text.branch_from_ref, "refs/heads/feat/x", None)), ("tag", _of(text.branch_from_ref, "refs/tags/v", None)),
)
scalar(
    "f25_brokers", "'rabbitmq' AS amqp, 'pubsub' AS gcp, 'my-kafka' || {k} AS other, 'queue' AS queue, 'topic' AS topic",
    ("amqp", lambda k: text.broker_mechanism(F.lit(" AMQP "))), ("gcp", lambda k: text.broker_mechanism(F.lit("gcp_pubsub"))), ("other", _of(text.broker_mechanism, "My-Kafka", None)), ("queue", lambda k: text.infer_channel_type(F.lit("AWS-SQS"))),
    ("topic", lambda k: text.infer_channel_type(F.lit("kafka"))),
)


# Questions with branches, analytics modes, deployments.
@query("""WITH m AS (SELECT DISTINCT dst AS id FROM holds h JOIN heads c ON c.commit_id = h.src WHERE c.branch = 'F') SELECT kind, src, dst FROM dep WHERE dst = (SELECT id FROM parts WHERE p_partkey = 1) AND src IN (SELECT id FROM m)
ORDER BY CASE kind WHEN 'DEPENDS_ON' THEN 1 WHEN 'IMPORTS' THEN 2 ELSE 3 END, kind, src LIMIT 50""")
def g7_dependents_on_branch(spark, sf):
    return _api(spark, sf).get_dependents(_root_id(spark, sf), branch="F").rows.select("kind", "src", "dst")


@query("""WITH m AS (SELECT DISTINCT dst AS id FROM holds h JOIN heads c ON c.commit_id = h.src WHERE c.branch = 'F') SELECT kind, src, dst FROM dep WHERE src = (SELECT id FROM parts WHERE p_partkey = 1) AND dst IN (SELECT id FROM m)
ORDER BY CASE kind WHEN 'DEPENDS_ON' THEN 1 WHEN 'IMPORTS' THEN 2 ELSE 3 END, kind, dst LIMIT 50""")
def g8_dependencies_on_branch(spark, sf):
    return _api(spark, sf).get_dependencies(_root_id(spark, sf), branch="F").rows.select("kind", "src", "dst")


def _named_edges(spark, sf, kind: str):
    nodes, edges = bridge.graph(spark, sf)
    return nodes, edges.where("kind = 'IMPORTS'").withColumn("kind", F.lit(kind))


@query("SELECT src, dst FROM imports WHERE dst = (SELECT id FROM parts WHERE p_partkey = 1) ORDER BY src LIMIT 5")
def g9_references(spark, sf):
    from graphloom.operators.api import GraphApi

    return GraphApi(*_named_edges(spark, sf, "REFERENCES")).get_references(_root_id(spark, sf), 5).rows.select("src", "dst")


@query("SELECT src, dst FROM imports WHERE dst = (SELECT id FROM parts WHERE p_partkey = 1) ORDER BY src LIMIT 50")
def g10_implementations(spark, sf):
    from graphloom.operators.api import GraphApi

    return GraphApi(*_named_edges(spark, sf, "IMPLEMENTS")).get_implementations(_root_id(spark, sf)).rows.select("src", "dst")


@query("""WITH r AS (SELECT id FROM parts WHERE p_partkey IN (1, 2)), hit AS (SELECT id AS root, id, 0 AS depth FROM r UNION ALL
SELECT r.id, CASE WHEN e.src = r.id THEN e.dst ELSE e.src END, 1 FROM r JOIN edges e ON e.src = r.id OR e.dst = r.id)
SELECT root, id, min(depth) AS depth FROM hit GROUP BY root, id""")
def g21_code_context(spark, sf):
    wanted = [r.id for r in bridge.view(spark, sf, "parts").where("p_partkey in (1, 2)").collect()]
    return _api(spark, sf).get_code_context(ids=wanted, depth=1).rows.select("root", "id", "depth")


@query("SELECT id FROM nodes WHERE path LIKE '%ECONOMY.py' OR name = 'ECONOMY.py' ORDER BY id LIMIT 50")
def g21_paths(spark, sf):
    return _api(spark, sf).get_code_context(paths=["ECONOMY.py"], depth=0).parts["path_matches"].select("id")


@query("""SELECT n.id, n.name, CAST(count(e.src) AS DOUBLE) AS score FROM nodes n LEFT JOIN dep e ON e.dst = n.id WHERE n.kind = 'RESOURCE' GROUP BY n.id, n.name ORDER BY score DESC, n.id LIMIT 10""")
def t3_top_resources(spark, sf):
    from graphloom.operators import analytics

    return analytics.in_degree(*bridge.graph(spark, sf)).orderBy(F.desc("score"), "id").limit(10)


@query("""RECURSIVE WITH r(id, depth) AS (SELECT id, 0 FROM parts WHERE p_partkey = 1 UNION SELECT e.src, r.depth + 1 FROM r JOIN dep e ON e.dst = r.id WHERE r.depth < 2)
SELECT id, min(depth) AS distance FROM r WHERE id <> (SELECT id FROM parts WHERE p_partkey = 1) GROUP BY id ORDER BY distance, id LIMIT 50""")
def g22_blast_radius_report(spark, sf):
    """The bounded analytics question: the nearest dependents, by distance and id."""
    return _api(spark, sf).get_dependency_analytics("blast_radius", _root_id(spark, sf), 2)["rows"].select("id", "distance")


@query("""SELECT sha256('deployment-environment::' || environment) AS id, environment AS name, environment IN ('1-URGENT', '2-HIGH') AS is_production FROM (SELECT DISTINCT environment FROM deployments) UNION ALL SELECT sha256('deployment-environment::spare'), 'spare', false""")
def d6_environments(spark, sf):
    """Declared environments, and those that only records name, which are no production."""
    declared = spark.createDataFrame([("1-URGENT", True, 1), ("2-HIGH", True, 2), ("spare", False, 3), ("spare", True, 4)], "name string, is_production boolean, seq long")
    return deploy.environment_nodes(bridge.view(spark, sf, "deployments"), declared).select("id", "name", "is_production")


@query("""SELECT phase, op, entity, kind, a, b FROM (SELECT DISTINCT 0 AS phase, 'CREATE' AS op, 'node' AS entity, CAST(NULL AS VARCHAR) AS kind, sha256('deployment-environment::' || environment) AS a, CAST(NULL AS VARCHAR) AS b FROM deployments
UNION ALL SELECT DISTINCT 0, 'CREATE', 'node', NULL, sha256(repository || '::deployment::' || environment || '::' || commit_sha || '@' || deployed_at), NULL FROM deployments
UNION ALL SELECT DISTINCT 1, 'CREATE', 'edge', 'DEPLOYED_TO', sha256(repository || '::commit::' || commit_sha), sha256('deployment-environment::' || environment) FROM deployments)""")
def d6_deployment_delta(spark, sf):
    return deploy.deployment_delta(bridge.view(spark, sf, "deployments"))
