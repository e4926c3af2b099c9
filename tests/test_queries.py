"""Every graph query against its SQL on the smallest tables."""

import duckdb
import pytest

from graphloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(str).replace({"nan": "None", "<NA>": "None"})
    return sorted(map(tuple, df.values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_betweenness_matches_brandes(spark):
    from graphloom.operators.analytics import betweenness

    pairs = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e")]
    edges = spark.createDataFrame([("DEPENDS_ON", x, y) for x, y in pairs], "kind string, src string, dst string")
    ids = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    got = {r.id: round(r.score, 6) for r in betweenness(edges, ids).collect() if r.score}
    assert got == {"b": 1.0, "d": 1.0, "c": 3.0}  # a-c: two paths; a-e, b-e, d-e go through c


def test_components_of_long_paths(spark):
    """Shuffled paths of many hundred links, and one whose smallest id meets falling ids, settle on one smallest id each."""
    import random

    from graphloom.operators import analytics
    from graphloom.operators.contract import smallest_reachable
    from graphloom.plans.storage import stored

    r = random.Random(4)
    ids = r.sample(range(10**9), 900)
    falling = [10**9, *range(10**9 + 300, 10**9 + 1, -1)]
    links = [*zip(ids, ids[1:]), *zip(falling, falling[1:])]
    want = {i: min(ids) for i in ids} | {i: 10**9 for i in falling}
    got = {x.id: x.comp for x in smallest_reachable(stored(spark.createDataFrame([*links, *((b, a) for a, b in links)], "a long, b long")), stored).collect()}
    assert got == want
    name = "{:012d}".format
    edges = spark.createDataFrame([("DEPENDS_ON", name(a), name(b)) for a, b in links], "kind string, src string, dst string")
    nodes = spark.createDataFrame([(name(i),) for i in [*want, 5 * 10**9]], "id string")
    got = {x.id: (x.component, x.size) for x in analytics.components(nodes, edges).collect()}
    assert got == {name(i): (name(c), 900 if c < 10**9 else 300) for i, c in want.items()} | {name(5 * 10**9): (name(5 * 10**9), 1)}


def test_betweenness_of_the_whole_graph(spark, monkeypatch):
    """All sources in several blocks and paths of any length, against Brandes over the bridged graph."""
    from graphloom.operators import analytics
    from graphloom.plans import bridge

    monkeypatch.setattr(analytics, "BLOCK_SOURCES", 128)
    out = {}
    for x in analytics.projection(bridge.view(spark, SF, "edges")).select("src", "dst").distinct().collect():
        out.setdefault(x.src, []).append(x.dst)
    want = {}
    for s in out:
        depth, sigma, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in out.get(v, ()):
                if w not in depth:
                    depth[w], sigma[w] = depth[v] + 1, 0.0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    sigma[w] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for w in out.get(v, ()):
                if depth[w] == depth[v] + 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if v != s:
                want[v] = want.get(v, 0.0) + delta[v]
    got = {x.id: x.score for x in queries.n7_betweenness(spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_case_files_are_dealt_out_and_walked_once(spark, monkeypatch):
    from graphloom import case_queries
    from graphloom.extract import walker

    walks, walk = [], walker.analyze
    monkeypatch.setattr(walker, "analyze", lambda files, *a: walks.append(files.rdd.getNumPartitions()) or walk(files, *a))
    monkeypatch.setattr(case_queries, "TASK_FILES", 50, raising=False)
    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    for name, n in (("x1_symbols", 10), ("x2_call_targets", 3)):
        assert queries.QUERIES[name](spark, sf).count() == n * parts
        assert walks == [-(-parts // 50)], name
        walks.clear()


def test_facts_of_many_files_share_a_batch():
    import pyarrow as pa

    from graphloom.extract import walker

    class Files:  # stands for a table: what a task does with its batches
        select = lambda self, *_: self

        def mapInArrow(self, run, schema):
            rows = [{"repo_id": "r", "branch": "b", "path": f"{i}.py", "language": "python", "tier": 1, "content": "def f():\n    g()\n"} for i in range(300)]
            return list(run(iter([pa.RecordBatch.from_pylist(rows)])))

    got = walker.analyze(Files())
    assert len(got) == 1 and got[0].num_rows == 900


def test_betweenness_in_arrays_agrees_with_the_joins(spark, monkeypatch):
    from graphloom.operators import analytics

    links = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a"), ("e", "e"), ("x", "d")]
    edges = spark.createDataFrame([("DEPENDS_ON", *x) for x in links], "kind string, src string, dst string")
    some = spark.createDataFrame([("a",), ("x",), ("alone",)], "id string")
    monkeypatch.setattr(analytics, "BLOCK_CELLS", 16)
    walked, walk = [], analytics._betweenness_in_arrays
    monkeypatch.setattr(analytics, "_betweenness_in_arrays", lambda *x: walked.append(1) or walk(*x))
    for args in ((None, None), (some, 2)):
        near = {x.id: x.score for x in analytics.betweenness(edges, *args).collect()}
        with monkeypatch.context() as m:
            m.setattr(analytics, "SMALL_EDGES", 0)
            assert near == pytest.approx({x.id: x.score for x in analytics.betweenness(edges, *args).collect()})
    assert walked == [1, 1]


def test_betweenness_walks_edges_into_ends_once_a_source(monkeypatch):
    """A path whose nodes all point at the same ends: past the first step no edge into an end is looked at again."""
    import numpy as np

    from graphloom.operators import analytics

    n, ends = 60, 50
    src = np.concatenate([np.arange(n - 1), np.repeat(np.arange(n), ends)]).astype(np.int32)
    dst = np.concatenate([np.arange(1, n), np.tile(np.arange(n, n + ends), n)]).astype(np.int32)
    graph, total, walked, ranges = analytics._graph_arrays(src, dst, n + ends), n + ends, [], analytics._ranges
    monkeypatch.setattr(analytics, "_ranges", lambda a, b: walked.append(int((b - a).sum())) or ranges(a, b))
    score, met = np.zeros(total), np.zeros(total, dtype=bool)
    depth, place = np.full(7 * total, -1, dtype=np.int32), np.zeros(7 * total, dtype=np.int32)
    for i in range(0, total, 7):
        analytics._brandes(np.arange(i, min(i + 7, total)), total, graph, None, depth, place, score, met)
    assert score.tolist() == [*(j * (n - 1 - j) for j in range(n)), *[0.0] * ends]
    assert met.tolist() == [False, *[True] * (total - 1)] and (depth == -1).all()
    assert sum(walked) <= total * 2 * (n + ends)  # of 60 * 60 / 2 * 50 edges into ends on all paths
