import json

import pytest
from pyspark.sql import functions as F

from graphloom import jsonrpc
from graphloom.extract import rules
from graphloom.functions import text
from graphloom.operators import joins, links, snapshot, traverse
from graphloom.operators.api import Budget, GraphApi
from graphloom.sources import config, registry
from graphloom.streaming import watch

NODE = "id string, kind string, name string, qualified_name string, language string, repository string, path string"
EDGE = "kind string, src string, dst string, branch_pairs array<string>"


def api(spark, edges, nodes=None, **budget):
    names = sorted({x for _, a, b, *_ in edges for x in (a, b)})
    nodes = nodes or [(n, "FUNCTION", n, f"m.{n}", "python", "r", f"src/{n}.py") for n in names]
    return GraphApi(spark.createDataFrame(nodes, NODE), spark.createDataFrame([(*e, None)[:4] for e in edges], EDGE), Budget(**budget))


def test_call_chain_is_cut_at_depth_and_budget(spark):
    chain = [("CALLS", f"n{i}", f"n{i + 1}") for i in range(1, 5)]
    got = api(spark, chain).get_callers("n5", 99)
    assert (got.rows.count(), got.truncated) == (3, True)
    got = api(spark, chain, max_depth=10).get_callers("n5", 10)
    assert (got.rows.count(), got.truncated) == (4, False)


def test_fan_in_limit_cycles_and_arguments(spark):
    star = [("CALLS", f"c{i:02}", "root") for i in range(60)] + [("CALLS", "root", "c00")] + [("DEPENDS_ON", f"d{i}", "root") for i in range(6)]
    a = api(spark, star)
    got = a.get_callers("root", 1)
    assert (got.rows.count(), got.truncated) == (50, True)
    assert a.get_dependents("root", 5).rows.count() == 5
    assert a.get_change_impact("c00", 2).rows.where("id = 'c00'").count() == 0
    with pytest.raises(ValueError):
        a.get_callers(" ")
    with pytest.raises(ValueError):
        a.get_dependency_analytics("clusters", "root")


def test_edge_branch_gate(spark):
    from graphloom.operators.traverse import edge_branch_gate

    rows = [("CALLS_API", "a", "b", ["main"]), ("CALLS_API", "a", "c", ["r@dev -> s@main"]), ("CALLS_API", "a", "d", ["r@dev"]), ("CALLS", "a", "e", ["r@dev"]), ("QUERIES", "a", "f", None)]
    e = spark.createDataFrame(rows, EDGE)
    gate = lambda exact: {r.dst for r in edge_branch_gate(e, "main", ("CALLS_API", "QUERIES"), exact).collect()}
    assert gate(False) == {"b", "c", "e", "f"} and gate(True) == {"b", "e", "f"}


def test_guarded_delete_keeps_what_a_commit_holds(spark):
    nodes = spark.createDataFrame([("n",), ("m",), ("c",)], "id string")
    edges = spark.createDataFrame([("CONTAINS_STATE_OF", "c", "n"), ("CALLS", "m", "n")], "kind string, src string, dst string")
    left, rest, kept = snapshot.guarded_delete(nodes, edges, spark.createDataFrame([("n",), ("m",), ("x",)], "id string"))
    assert {r.id for r in left.collect()} == {"n", "c"} and rest.count() == 1 and [r.id for r in kept.collect()] == ["n"]


def test_merge_facts_follows_priority_and_order(spark):
    rows = [("x", 1, "TREE", "A", None, "h1", {"a": "1"}), ("x", 2, "JOERN", "B", "py", "h2", {"a": "2", "b": "9"}), ("x", 3, "SCIP", "C", "go", "h3", {"a": "3", "c": "4"})]
    facts = spark.createDataFrame(rows, "id string, seq int, source string, kind string, language string, content_hash string, properties map<string,string>")
    r = snapshot.merge_facts(facts, ["id"], ["kind"]).first()
    assert (r.kind, r.language, r.content_hash, r.properties) == ("B", "py", "h2", {"a": "2", "b": "9", "c": "4"})


@pytest.mark.parametrize(
    "raw, want",
    [("/users/{id}", "/users/*"), ("users//:id/", "/users/*"), ("https://h:1/a/<x>?q=1#f", "/a/*"), ("'/v1/*'", "/v1/*"), ("", "/"), ("/A/b", "/A/b")],
)
def test_normalize_route(spark, raw, want):
    assert spark.range(1).select(text.normalize_route(F.lit(raw))).first()[0] == want


@pytest.mark.parametrize(
    "kind, raw, want",
    [
        ("bucket", "s3://Data/x", "data"), ("bucket", "https://data.s3.eu-west-1.amazonaws.com/k", "data"), ("bucket", "https://storage.googleapis.com/data/k", "data"), ("bucket", "data", "data"),
        ("database", "jdbc:postgresql://u:p@db:5432/App?x=1", "postgres://db/app"), ("database", "host=db port=1 dbname=app", "db:1/app"), ("database", "mssql://h:1433/d", "sqlserver://h/d"), ("database", "user/pass@db:1521/svc", "db:1521/svc"), ("bucket", " ", None), ("api", "/o/{id}/", "/o/*"), ("function", "arn:aws:lambda:eu:1:function:Go:3", "go"), ("table", "arn:aws:dynamodb:eu:1:table/T", "t"), ("api", "https://Api.x:8080/y", "api.x:8080"),
    ],
)
def test_normalize_identity(spark, kind, raw, want):
    assert spark.range(1).select(text.normalize_identity(F.lit(kind), F.lit(raw))).first()[0] == want


PY = """import os
from app.db import connect
class Shop:
    def list(self):
        def inner():
            return 1
        return requests.get("https://api.test/items/1")

@app.get("/users/{id}")
def user(id):
    url = os.environ["DATABASE_URL"]
    return s3.upload("s3://bucket-a/key")
"""


def test_extraction_rules(spark):
    from graphloom.extract import evidence, walker

    rows = [("r", "main", "app/shop.py", PY), ("r", "main", "web/a.js", "import x from 'y'\nfetch(`/api/items`)\nrouter.post('/items', f)\n"), ("r", "main", ".env", "DB_HOST=db.internal\n"), ("r", "main", "README.md", "Call `GET` at `/v1/items`, topic order.created, see https://x.test/a.\n"), ("r", "main", "x.unknown", None)]
    files = spark.createDataFrame(rows, "repo_id string, branch string, path string, content string")
    facts = walker.analyze_paths(files).cache()
    s = {(r.name, r.kind, r.container): (r.start, r.end) for r in walker.symbols(facts).collect()}
    assert s == {("Shop", "CLASS", ""): (3, 7), ("list", "METHOD", "Shop"): (4, 7), ("inner", "METHOD", "Shop"): (5, 6), ("user", "FUNCTION", ""): (10, 12)}
    assert {r.detail for r in facts.where("fact = 'import'").collect()} == {"os", "app.db.connect", "y"}
    assert {r.path: r.status for r in facts.where("fact = 'file'").collect()} == {"app/shop.py": "COMPLETE", "web/a.js": "COMPLETE", "README.md": "COMPLETE", ".env": "FAILED", "x.unknown": "FAILED"}
    code, spans = registry.detect_languages(files), walker.functions(facts)
    ids = {r.id: r.name for r in spans.collect()}
    assert {(r.http_method, r.route, ids.get(r.handler_id)) for r in rules.provides(code, spans).collect()} == {("GET", "/users/*", "user"), ("POST", "/items", None)}
    assert {(r.route, r.target_hint, ids.get(r.caller_id)) for r in rules.consumes(code, spans).collect()} == {("/items/1", "https://api.test/items/1", "list"), ("/api/items", None, None)}
    assert {(r.resource_type, r.raw_target, r.access, ids.get(r.node_id)) for r in rules.resources(code, spans).collect()} == {("bucket", "s3://bucket-a/key", "write", "user"), ("database", "env:DATABASE_URL", "connect", "user")}
    assert {(r.kind, r.value) for r in evidence.scan(files).collect()} == {("ENV_FILE", "db.internal"), ("README", "/v1/items"), ("README", "order.created"), ("README", "https://x.test/a")}
    assert facts.where("fact = 'call' and detail = 'requests.get'").first().resolved == "unresolved"
    assert [r.status for r in walker.analyze(code.where("language = 'python'"), walker.Skipping("other")).collect()] == ["SKIPPED"]


def test_handlers_and_calls(spark):
    spans = spark.createDataFrame([("f", "a", "A", 1, 10, 1), ("f", "b", "B", 3, 5, 2), ("f", "c", "C", 20, 30, 3)], "file string, id string, name string, start int, end int, seq int")
    points = spark.createDataFrame([("f", 4, "x"), ("f", 12, "x"), ("f", 2, "C"), ("f", 40, "x")], "file string, line int, hint string")
    got = {r.line: r.handler for r in joins.resolve_handlers(points, spans, ["file"]).collect()}
    assert got == {4: "b", 12: "c", 2: "c", 40: None}


def _contracts(spark):
    cols = "repo_id string, branch string, mechanism string, http_method string, route string, service string, method string"
    c = [
        (1, "web", "main", "rest", "get", "/items/7", None, None, "caller", None), (2, "web", "main", "rest", None, "/none", None, None, "caller2", "https://ext.test/none"), (3, "web", "main", "grpc", None, None, "shop.Cart", "Add", "caller3", None),
        (4, "web", "main", "grpc", None, None, "", "Add", "caller4", None), (5, "web", "main", "rest", None, "/health", None, None, "caller5", None), (6, "web", "main", "rest", None, "/both", None, None, "caller6", "https://cfg/both"),
    ]
    p = [
        (9, "api", "main", "rest", "GET", "/items/*", None, None, "handler"), (8, "web", "main", "rest", None, "/items/7", None, None, "self"), (7, "api", "main", "grpc", None, None, "Cart", "Add", "handler3"),
        (6, "api", "main", "rest", None, "/both", None, None, "handler6"), (5, "old", "main", "rest", None, "/both", None, None, "handler7"),
    ]
    return spark.createDataFrame(c, f"cid int, {cols}, caller_id string, target_hint string"), spark.createDataFrame(p, f"pid int, {cols}, handler_id string")


def test_links_between_services(spark):
    cs, ps = _contracts(spark)
    urls = spark.createDataFrame([("https://cfg", "api")], "prefix string, value string")
    got = {(r.src, r.dst): (r.properties["confidence"], r.properties.get("http_method"), [tuple(e) for e in r.evidence], r.branch_pairs) for r in links.call_edges(cs, ps, urls).collect()}
    ext = next(k for k in got if k[0] == "caller2")
    assert got == {
        ("caller", "handler"): ("medium", "GET", [("route", "/items/7")], ["web@main -> api@main"]), ext: ("low", None, [("unmatched", "ext.test")], ["web@main"]),
        ("caller3", "handler3"): ("medium", None, [("rpc", "shop.Cart/Add")], ["web@main -> api@main"]), ("caller4", "handler3"): ("low", None, [("rpc", "Add")], ["web@main -> api@main"]),
        ("caller6", "handler6"): ("high", None, [("route", "/both"), ("target_hint", "https://cfg/both")], ["web@main -> api@main"]),
    }


def test_restrictions_intersect_or_fall_back(spark):
    cs, ps = _contracts(spark)
    none = spark.createDataFrame([], "prefix string, value string")
    ev = lambda *targets: spark.createDataFrame([("web", "main", "a.yaml", i, "OPENAPI", v, "", t, "", "") for i, (v, t) in enumerate(targets)], "repo_id string, branch string, file string, seq int, kind string, value string, detail string, target_repo string, channel string, broker string")
    repos = lambda *t: {r.p_repo for r in links.matched_services(cs, ps, none, ev(*t)).where("cid = 6").collect()}
    assert repos(("GET /both", "old")) == {"old"} and repos(("https://h/both", "api"), ("/both", "old")) == {"api"} and repos(("/other", "old")) == {"api", "old"} and repos(("/both", "gone")) == set()


def test_wildcard_routes_match_like_all_pairs(spark):
    import random

    r = random.Random(5)
    routes = sorted({"/" + "/".join(r.choice(["*", "a", "b", "c"]) for _ in range(r.randrange(1, 4))) for _ in range(60)})
    df = spark.createDataFrame([(x,) for x in routes], "route string").withColumn("k", F.lit(1))
    got = {(x.l, x.r) for x in joins.match_routes(df, df, ["k"]).collect()}
    seg = lambda x: x[1:].split("/")
    assert got == {(x, y) for x in routes for y in routes if len(seg(x)) == len(seg(y)) and all(a == b or "*" in (a, b) for a, b in zip(seg(x), seg(y)))}


def test_deltas_count_outcomes(spark):
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    e = lambda *x: spark.createDataFrame(list(x), "kind string, src string, dst string")
    old_edges = e(("CALLS", "a", "ghost"), ("CONTAINS_STATE_OF", "c", "b"), ("CALLS", "a", "b"))
    ops = snapshot.DeltaBuilder().create_node("a").create_node("new").create_edge("CALLS", "new", "nowhere").create_edge("CALLS", "new", "a").delete_edge("CALLS", "a", "b").delete_node("b").delete_node("a").delete_node("missing").ops(spark)
    nodes, edges, counters = snapshot.apply_delta(n("a", "b", "c"), old_edges, n("a", "new"), e(("CALLS", "new", "nowhere"), ("CALLS", "new", "a")), ops)
    assert {r.outcome: r.n for r in counters.collect()} == {"created_nodes": 1, "updated_nodes": 1, "errors": 1, "created_rels": 1, "deleted_rels": 1, "deleted_nodes": 1, "nodes_retained": 1}
    assert {r.id for r in nodes.collect()} == {"b", "c", "new"} and {(r.src, r.dst) for r in edges.collect()} == {("c", "b")}
    with pytest.raises(ValueError):
        snapshot.DeltaBuilder().create_edge("calls", "a", "b")


def _engine(spark, tmp_path):
    from graphloom.jobs import Engine

    ws = config.Workspace([config.Repository("web", "acme/web"), config.Repository("api", "acme/api")], links={"channel_brokers": {"ORDERS": "kafka"}})
    return Engine(spark, ws, str(tmp_path / "home"))


def _files(spark, repo, files):
    return spark.createDataFrame([(repo, "main", p, t) for p, t in files.items()], "repo_id string, branch string, path string, content string")


def test_index_and_link_runs(spark, tmp_path):
    """Two services are indexed and linked; a second link pass changes nothing; a changed file replaces its own facts only."""
    g = _engine(spark, tmp_path)
    web, api_ = g.workspace.repositories
    done = g.index_files(web, "main", "s1", _files(spark, "web", {"a.py": "def pull():\n    return requests.get('https://x.test/items/7')\n", "b.py": "def other():\n    return pull2()\n"}))
    assert done["created_nodes"] == 7 and "errors" not in done
    g.index_files(api_, "main", "t1", _files(spark, "api", {"s.py": "@app.get('/items/{id}')\ndef item(id):\n    producer.send('orders', kafka)\n"}))
    first = g.link()
    assert first["created_nodes"] == 1 and first["created_rels"] == 3
    names = {r.id: r.name for r in g.store.nodes.collect()}
    found = {(r.kind, names[r.src], names[r.dst]) for r in g.store.edges.where("kind in ('CALLS_API', 'PUBLISH_TO', 'CONTAINS_STATE_OF')").collect()}
    assert {("CALLS_API", "pull", "item"), ("PUBLISH_TO", "item", "orders"), ("CONTAINS_STATE_OF", "t1", "orders")} <= found
    assert g.link() == {}
    removed = spark.createDataFrame([("b.py",)], "path string")
    g.index_files(web, "main", "s2", _files(spark, "web", {"b.py": "def fresh():\n    return 2\n"}), removed)
    names = {(r.kind, r.name) for r in g.store.nodes.collect()}
    assert {("FUNCTION", "pull"), ("FUNCTION", "fresh"), ("COMMIT", "s2")} <= names and ("FUNCTION", "other") not in names and g.state.last_sha("web", "main") == "s2"
    assert {r.file for r in g.state.load_contracts("web", "main").tables["consumes"].collect()} == {"a.py"}
    assert {(r.repo_id, r.sha) for r in g.status().collect()} == {("web", "s2"), ("api", "t1")}
    assert g.store.health() and g.store.find_nodes("PULL", 5).count() == 1 and g.store.get_edges_from("none", None, 5).count() == 0
    g.store.reset()
    assert g.store.nodes.count() == 0


def test_git_repositories(spark, tmp_path):
    """Head, branches, listings, blobs and changes of a small repository; an index run over its two versions."""
    import subprocess

    from graphloom.sources import git

    repo = tmp_path / "repo"
    sh = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    repo.mkdir()
    sh("init", "-q", "-b", "main")
    (repo / "a.py").write_text("def one():\n    return 1\n")
    (repo / "old.py").write_text("def moved():\n    return 'a long enough body to be told as renamed'\n")
    (repo / "x.png").write_text("no text")
    sh("add", "."), sh("commit", "-q", "-m", "1")
    g = _engine(spark, tmp_path)
    web = g.workspace.repositories[0]
    assert git.is_repository(repo) and not git.is_repository(tmp_path / "none")
    first = git.head_commit(repo)
    assert {r.path for r in git.files_at(spark, repo, "web", "main", first).collect()} == {"a.py", "old.py"} and git.file_at(repo, first, "none") is None
    assert [r.branch for r in git.branches(git.refs(spark, repo, "web")).collect()] == ["main"]
    assert [(b, s) for b, s, _ in g.index_repository(web, repo)] == [("main", first)] and g.index_repository(web, repo) == []
    (repo / "a.py").write_text("def two():\n    return 1\n")
    sh("mv", "old.py", "new.py"), sh("commit", "-q", "-a", "-m", "2")
    second = git.head_commit(repo)
    assert {(r.status, r.old_path, r.new_path) for r in git.changes(spark, repo, first, second).collect()} == {("M", "a.py", "a.py"), ("R", "old.py", "new.py")}
    g.index_repository(web, repo)
    assert {r.name for r in g.store.nodes.where("kind = 'FUNCTION'").collect()} == {"two", "moved"} and {r.name for r in g.store.nodes.where("kind = 'FILE'").collect()} >= {"a.py", "new.py"}
    with pytest.raises(git.GitError):
        git.clone_or_open("x", tmp_path / "home")


def test_languages_and_paths(spark):
    df = spark.createDataFrame([("a/B.PY",), ("Makefile",), ("x.tsx",), ("node_modules/a.js",), ("q.unknown",), ("docs/a.md",)], "path string")
    got = {r.path: (r.language, r.s, r.e) for r in registry.detect_languages(df).withColumn("s", registry.is_skipped(F.col("path"))).withColumn("e", registry.is_scannable(F.col("path"))).collect()}
    assert got["a/B.PY"][0] == "python" and got["Makefile"][0] == "make" and got["x.tsx"][0] == "typescript" and got["q.unknown"][0] is None
    assert got["node_modules/a.js"][1] and got["docs/a.md"][2] and not got["a/B.PY"][1]


def test_workspace(tmp_path):
    w = config.Workspace([config.Repository("a", "x/a", ["dev"]), config.Repository("b", "x/b", enabled=False)])
    w.save(str(tmp_path / "w.json"))
    assert config.Workspace.load(str(tmp_path / "w.json")) == w and w.branches(w.repositories[1]) == ["main"]
    with pytest.raises(ValueError):
        w.selected("b")
    with pytest.raises(ValueError):
        config.Workspace([config.Repository("a", ""), config.Repository("a", "y")]).validate()
    assert [r.id for r in w.add(config.Repository("c", "x/c")).remove("a").repositories] == ["b", "c"] and w.replace("a", config.Repository("a", "z/a")).find("a").github == "z/a"
    for bad in (lambda: w.add(config.Repository("a", "x")), lambda: w.remove("none"), lambda: w.with_default_branches([])):
        with pytest.raises(ValueError):
            bad()


def test_watch_indexes_each_head_once(spark, tmp_path):
    heads, seen = tmp_path / "heads", []
    heads.mkdir()
    run = lambda: watch.watch(watch.head_stream(spark, str(heads)), str(tmp_path / "state"), str(tmp_path / "cp"), lambda df: seen.extend((r.repo_id, r.sha) for r in df.collect())).awaitTermination()
    for i, sha in enumerate(["s1", "s1", "s2"]):
        (heads / f"{i}.json").write_text(json.dumps({"repo_id": "r", "branch": "main", "sha": sha}))
        run()
    assert seen == [("r", "s1"), ("r", "s2")]


def test_jsonrpc(spark):
    import io

    a = api(spark, [("CALLS", "x", "y")])
    ask = lambda m, **p: jsonrpc.handle(a, json.dumps({"jsonrpc": "2.0", "id": 1, "method": m, "params": p}))
    call = lambda tool, **args: ask("tools/call", name=tool, arguments=args)["result"]
    tools = {t["name"]: t["inputSchema"] for t in ask("tools/list")["result"]["tools"]}
    assert len(tools) == 16 and tools["get_callers"]["required"] == ["id"] and tools["get_callers"]["properties"]["depth"]["maximum"] == 255 and tools["get_code_context"]["required"] == []
    got = call("get_callers", id="y")
    assert got["structuredContent"]["data"][0]["src"] == "x" and json.loads(got["content"][0]["text"]) == got["structuredContent"] and got["isError"] is False
    assert ask("initialize", protocolVersion="2025-01-01")["result"]["protocolVersion"] == "2025-01-01" and ask("initialize")["result"]["protocolVersion"] == jsonrpc.PROTOCOL
    for tool, args in (("get_callers", {}), ("get_callers", {"id": 3}), ("get_callers", {"id": " "}), ("get_callers", {"id": "y", "depth": 256}), ("get_callers", {"id": "y", "depth": True}), ("get_implementation_status", {"repo": "r", "capability": "c", "branches": []}), ("get_dependency_analytics", {"mode": "nope"})):
        assert call(tool, **args)["isError"] is True
    assert ask("nope")["error"]["code"] == -32601 and ask("tools/call", name="nope")["error"]["code"] == -32602 and ask("tools/call")["error"]["code"] == -32602
    assert jsonrpc.handle(a, "{")["error"]["code"] == -32700 and jsonrpc.handle(a, "[]")["error"]["code"] == -32600 and jsonrpc.handle(a, "{}")["error"]["code"] == -32600
    assert jsonrpc.handle(a, json.dumps({"jsonrpc": "2.0", "method": "ping"})) is None
    out = io.StringIO()
    jsonrpc.serve(a, io.StringIO('\n{"id": 1, "method": "ping"}\n'), out)
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 1, "result": {}}


def test_own_branch_and_repository_of_nodes(spark):
    """Nodes that name their branch or repository themselves, in a column, the location or the properties."""
    from graphloom.operators import traverse

    schema = "id string, kind string, name string, location struct<repository:string,branch:string,path:string>, properties map<string,string>"
    nodes = spark.createDataFrame([("a", "FUNCTION", "a", ("r", "dev", "x/a.py"), {}), ("b", "FUNCTION", "b", None, {"branch": "dev", "repository": "r"}), ("c", "FUNCTION", "c", None, {})], schema)
    edges = spark.createDataFrame([], EDGE)
    assert {r.node_id for r in traverse.branch_members(edges, nodes).collect()} == {"a", "b"}
    q = GraphApi(nodes, edges)
    assert {r.id for r in q.find_symbol("a", repo="r").rows.union(q.find_symbol("b", repo="r").rows).collect()} == {"a", "b"}
    assert q.get_code_context(paths=["a.py"], depth=0).parts["path_matches"].count() == 1


def test_unions_of_clusters_are_numbered(spark):
    from graphloom.operators import analytics

    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    edges = spark.createDataFrame([("IMPORTS", "f", "b"), ("IMPORTS", "b", "e"), ("CALLS", "a", "c")], "kind string, src string, dst string")
    got = [(r.id, r.component, r.size) for r in analytics.clusters(nodes, edges).collect()]
    assert got == [("b", 2, 3), ("e", 2, 3), ("f", 2, 3), ("a", 1, 1), ("c", 3, 1), ("d", 4, 1)]


def test_command_line(spark, tmp_path, capsys):
    from graphloom.__main__ import main, parser

    (tmp_path / "w.toml").write_text('default_branches = ["main"]\n[[repositories]]\nid = "web"\ngithub = "acme/web"\n')
    assert main(["--config", str(tmp_path / "w.toml"), "--home", str(tmp_path / "h"), "status"]) == 0
    assert json.loads(capsys.readouterr().out.strip())["repo_id"] == "web"
    assert parser().parse_args(["index", "--repo", "web", "--full"]).full and parser().parse_args(["watch"]).interval == 30


def test_no_level_reads_no_edges_and_nodes_alone_store_none(spark):
    edges = spark.createDataFrame([("CALLS", "a", "b"), ("CALLS", "b", "c"), ("CALLS", "c", "a")], "kind string, src string, dst string")
    broken = edges.withColumn("src", F.raise_error(F.lit("read")).cast("string"))
    start = spark.createDataFrame([("a",)], "id string")
    for starts, depth in ((start, 0), (start.limit(0), 2)):
        met, reached = traverse.bfs(broken, starts, depth, both=True)
        assert {r.id for r in reached.collect()} == {r.id for r in starts.collect()}
        assert traverse.bfs(broken, starts, depth, with_edges=False)[0] is None
    assert {(r.id, r.depth) for r in traverse.bfs(edges, start, 2, both=True, with_edges=False)[1].collect()} == {("a", 0), ("b", 1), ("c", 1)}


def test_wide_views_meet_as_numbers(spark, tmp_path):
    """No id in hex is shuffled for calls, imports and containment; suppliers that share an id stay one node."""
    import re

    from graphloom.plans import bridge

    sf = "/root/testdata/sf0.001"
    for name in ("calls", "imports", "holds"):
        plan = bridge.view(spark, sf, name)._jdf.queryExecution().executedPlan().toString()
        assert not re.findall(r"hashpartitioning\([^)]*\bid#", plan), name
    for t in bridge.TABLES:
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        if t == "supplier":
            df = df.withColumn("s_name", F.lit("Same"))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    deps, keys = bridge.view(spark, str(tmp_path), "deps").collect(), bridge.view(spark, str(tmp_path), "edge_keys").where("src % 8 = 0 and dst % 8 = 1").collect()
    assert len(set(deps)) == len(deps) == len(keys) and len({d.dst for d in deps}) == 6
