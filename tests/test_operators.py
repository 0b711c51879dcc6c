import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stemma import queries
from stemma.operators import graph, ordered, relational, spatial


def test_hierarchy_equals_a_fold(spark):
    rng = random.Random(1)
    ranks = ["class", "order", "family"]
    rows = [(d, i, rng.choice([*ranks, None, None]), f"n{i}") for d in "ab" for i in range(120)]
    got = {(r["d"], r["i"]): tuple(r[x] for x in ranks) for r in ordered.hierarchy_fill(spark.createDataFrame(rows, "d string, i int, rank string, name string"), ["d"], "i", "rank", "name", ranks).collect()}
    for d in "ab":
        now = {}
        for dd, i, rank, name in rows:
            if dd == d:
                if rank:
                    now = {k: v for k, v in now.items() if ranks.index(k) < ranks.index(rank)} | {rank: name}
                assert got[d, i] == tuple(now.get(r) for r in ranks)


def test_row_numbers_over_many_partitions(spark):
    rows = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("x"))
    assert sorted((r["x"], r["n"]) for r in ordered.numbered(rows, ["x"], "n").collect()) == [(i, i) for i in range(1000)]


def test_first_fit_depends_on_order(spark):
    step = 0.001  # about 111 m
    points = [(0, "w", 10.0, 100.0), (1, "w", 10.0 + step, 100.0), (2, "w", 10.0 + 2 * step, 100.0), (3, "v", 10.0, 100.0)]
    out = spatial.numbered_clusters(spatial.first_fit_clusters(spark.createDataFrame(points, "n long, wb string, lat double, lon double"), "wb", "n"))
    assert sorted((r["n"], r["site_uid"]) for r in out.collect()) == [(0, "S001"), (1, "S001"), (2, "S002"), (3, "S003")]
    turned = [(0, "w", 10.0 + step, 100.0), (1, "w", 10.0, 100.0), (2, "w", 10.0 + 2 * step, 100.0)]
    out = spatial.first_fit_clusters(spark.createDataFrame(turned, "n long, wb string, lat double, lon double"), "wb", "n")
    assert {r["anchor"] for r in out.collect()} == {0}


def test_close_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    points = [(i, "g", 13 + rng.random() * 0.02, 108 + rng.random() * 0.02) for i in range(150)]
    got = {(r["a"], r["b"]) for r in spatial.close_pairs(spark.createDataFrame(points, "k int, grp string, lat double, lon double"), "grp", "k", 400.0).collect()}
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and spatial._metres(a[2], a[3], b[2], b[3]) < 400}
    assert got == want and got


@pytest.mark.parametrize("lat, lon, metres", [(89.99, 0, 900.0), (-89.97, 175, 2000.0), (60, 179.98, 1500.0), (0, -0.01, 500.0)])
def test_close_pairs_around_the_globe(spark, lat, lon, metres):
    """At the poles, where a row has few cells, and where longitudes jump."""
    rng = random.Random(4)
    points = [(i, "g", max(-90.0, min(90.0, lat + rng.random() * 0.05 - 0.025)), (lon + rng.random() * (360 if abs(lat) > 89 else 0.05) + 180) % 360 - 180) for i in range(120)]
    out = spatial.close_pairs(spark.createDataFrame(points, "k int, grp string, lat double, lon double"), "grp", "k", metres)
    rows = [(r["a"], r["b"]) for r in out.collect()]
    assert set(rows) == {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and spatial._metres(a[2], a[3], b[2], b[3]) < metres} and rows
    assert len(rows) == len(set(rows))


def test_a_large_predicate_is_dealt_to_several_tasks(spark, tmp_path):
    triples = spark.range(100).selectExpr("concat('s', id) AS s", "if(id < 90, 'type', 'p') AS p", "'c' AS o", "'iri' AS o_kind", "cast(null AS string) AS o_datatype", "cast(null AS string) AS o_lang")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    back = graph.stored(triples, str(tmp_path / "t"), rows=20)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "t" / "p=type").glob("*.parquet"))) > 1 and sorted(back.collect()) == sorted(triples.collect())


def test_cells(spark):
    columns = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(n).alias("name")) for x, n in ((10.0, "M1"), (20.0, "M2"))))
    marks = lambda *m: F.array(*(F.struct(F.lit(x).alias("x"), F.lit(c).alias("mark")) for x, c in m))
    full, sparse, far = (relational.cells_by_column(m, columns) for m in (marks((13.0, "+"), (27.0, "-")), marks((19.0, "+")), marks((50.0, "+"))))
    row = spark.range(1).select(full.alias("a"), sparse.alias("b"), far.alias("c"), relational.nearest_column(F.lit(15.0), columns, 8).alias("d")).first()
    assert [tuple(x) for x in row["a"]] == [("M1", "+"), ("M2", "-")] and [tuple(x) for x in row["b"]] == [("M2", "+")] and row["c"] == [] and row["d"] == "M1"


def test_measures_keep_multiplicities(spark):
    facts = spark.createDataFrame([("s", "t", 1.0), ("u", "t", 2.0)], "site string, time string, density double")
    measures = spark.createDataFrame([("s", "t", "A", 1.0), ("s", "t", "A", 2.0), ("s", "t", "B", 3.0)], "site string, time string, label string, value double")
    out = relational.measures_beside(facts, measures, ["site", "time"], "label", "value", {"a": "A", "b": "B"})
    assert sorted((r["density"], r["a"], r["b"]) for r in out.collect() if r["a"]) == [(1.0, 1.0, 3.0), (1.0, 2.0, 3.0)] and out.count() == 3


def test_second_pass(spark):
    rows = spark.createDataFrame([("a", "a1"), ("b", "b1"), ("c", "c1"), ("d", "d1")], "k1 string, k2 string")
    answers = spark.createDataFrame([("a", "exact"), ("a1", "exact"), ("b", "none"), ("b1", "exact"), ("c", "none"), ("c1", "higherrank")], "cache_key string, answer string")
    out = relational.second_pass(rows, answers, ("k1", "k2"), lambda a: F.coalesce(a, F.lit("none")))
    assert sorted((r["k1"], r["match"], r["pass"]) for r in out.collect()) == [("a", "exact", 1), ("b", "exact", 2), ("c", "none", 1), ("d", "none", 1)]


def test_graph_operators(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r"), ("x", "a", "s"), ("a", "gone", "r")], "src string, dst string, rel string")
    nodes = spark.createDataFrame([(x, "T", x.upper(), ["i"]) for x in "abcdx"], "id string, type string, label string, issues array<string>")
    start = nodes.where("id = 'a'").select("id")
    near = {r["id"]: r["hop"] for r in graph.neighbourhood(edges, start, 2).collect()}
    assert near == {"a": 0, "b": 1, "x": 1, "gone": 1, "c": 2}
    assert graph.neighbourhood(edges, start, 2, most=2).count() == 2
    assert graph.induced(edges, spark.createDataFrame([("a",), ("b",), ("x",)], "id string")).count() == 2
    lists = {(r["id"], r["direction"]): (r["n"], r["links"]) for r in graph.link_lists(edges, shown=1).collect()}
    assert lists["a", "out"] == (2, ["b"]) and lists["a", "in"] == (1, ["x"])
    assert [r["id"] for r in graph.search(nodes, "B", ["label"], types=["T"], issue="i").collect()] == ["b"]


@pytest.mark.parametrize("bad", ["", "none"])
def test_scores_without_hits(spark, bad):
    rows = spark.createDataFrame([("k", False, True)], "k string, p boolean, g boolean")
    assert tuple(relational.scores(rows, ["k"], "p", "g").first()) == ("k", 0, 1, 0, 0.0, 0.0, 0.0)


def test_first_match_of_equal_line_numbers_is_the_tables_first(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey FROM range(300) r(i)")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(3):  # later files are larger, and read earlier by Spark
        rows = f"SELECT i % 250 AS l_orderkey, i + {k} * 100000 AS l_partkey, i * 7 % 90 AS l_suppkey, (i % 2 + 1)::INT AS l_linenumber FROM range(500 * {k + 1} * {k + 1}) r(i)"
        con.execute(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet/part-{k}.parquet'")
    con.execute(f"SET threads = 1; CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = queries.QUERIES["join_first_match"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['join_first_match']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
