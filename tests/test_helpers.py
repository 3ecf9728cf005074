import datetime as dt
import json

from pyspark.sql import functions as F
from tidelog.operators import pull, utility
from tidelog.operators.hypergraph import Hypergraph
from tidelog.sources import datoms as D
from tidelog.sources.catalog import idents
from tidelog.streaming import stream as S


def test_pull(spark):
    flat = spark.createDataFrame([("t1", "a1", "JP", 1), ("t1", "a2", None, 2), ("t2", "a1", "JP", 1), ("t3", None, None, None)], "track_name string, artist_name string, artist_country string, id long")
    got = {r.track_name: [tuple(x) for x in r.artist] for r in pull.pull(flat, ["track_*", {"artist": ["artist_name", "artist_*"]}]).collect()}
    assert got == {"t1": [("a1", "JP"), ("a2", None)], "t2": [("a1", "JP")], "t3": []}
    deep = pull.pull(flat, ["artist_country", {"artist": ["artist_name", {"tracks": ["track_name"]}]}]).where("artist_country = 'JP'").collect()[0]
    assert [(a.artist_name, [t.track_name for t in a.tracks]) for a in deep.artist] == [("a1", ["t1", "t2"])]
    assert pull.pull(flat, ["*"]).count() == 4
    both = pull.pull(flat, ["track_name", {"a": ["artist_name"]}, {"b": ["id"]}], {"b": lambda d: d.withColumn("id", F.col("id") * 10)}).where("track_name = 't1'").collect()[0]
    assert [x.artist_name for x in both.a] == ["a1", "a2"] and [x.id for x in both.b] == [10, 20]


def test_hypergraph(spark):
    g = Hypergraph.empty(spark).add_vertex(9).add_vertex(9).add_hyperedge(1, 2, 3).add_hyperedge(3, 2, 1).add_hyperedge().add_hyperedge(3, 4)
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(g.vertices) == [1, 2, 3, 4, 9]
    assert {r.edge_id: r.vertices for r in g.hyperedges().collect()} == {0: [1, 2, 3], 1: [3, 4]}
    assert ids(g.neighbors(3)) == [1, 2, 4] and ids(g.edges_of(3)) == [0, 1] and ids(g.vertices_of(1)) == [3, 4]
    assert g.incident(0, 2) and not g.incident(1, 2)
    assert {r.edge_id: r.vertices for r in g.remove_vertex(4).remove_vertex(3).hyperedges().collect()} == {0: [1, 2]}
    assert ids(g.remove_hyperedge(1).vertices) == [1, 2, 3, 9]
    sets = spark.createDataFrame([(3, [1, 2]), (1, [2, 1, 1]), (2, []), (4, [5])], "o long, s array<long>")
    assert {r.edge_id: r.vertices for r in Hypergraph.from_sets(sets, "o", "s").hyperedges().collect()} == {0: [1, 2], 1: [5]}


def test_sources(spark, tmp_path):
    (tmp_path / "x.edn").write_text('[{:db/id -1 :movie/title "A \\"q\\"" :movie/cast [-2 -3] :movie/year 1984 :x nil} {:db/id -2 :person/born #inst "1954-08-16"}]\n[5 :a true 7 false]')
    got = sorted(map(tuple, D.read_edn(spark, str(tmp_path / "x.edn")).collect()))
    assert got == sorted([(1, -1, "movie/title", 'A "q"', 1), (1, -1, "movie/cast", "-2", 1), (1, -1, "movie/cast", "-3", 1), (1, -1, "movie/year", "1984", 1), (1, -2, "person/born", "1954-08-16 00:00:00", 1), (7, 5, "a", "true", -1)])
    (tmp_path / "items.json").write_text("\n".join(json.dumps(x) for x in [{"id": 1, "by": "u", "kids": [2, 3]}, {"id": 2, "by": None, "kids": None}]))
    items = D.unpivot(spark.read.json(str(tmp_path / "items.json")), "id", {"by": "item/by", "kids": "item/kid"})
    assert sorted(map(tuple, items.collect())) == [(1, 1, "item/by", "u", 1), (1, 1, "item/kid", "2", 1), (1, 1, "item/kid", "3", 1)]
    log = D.datoms(spark, [(1, [(1, "a", "x")]), (2, [(1, "a", "x", False), (2, "a", "y")]), (5, [(3, "b", 2.5)])])
    assert [r.tx for r in D.all_transactions(D.log_range(log, 1, 5)).collect()] == [1, 2]
    assert [(r.e, r.v) for r in D.last_datoms(log, 2).collect()] == [(3, "2.5"), (2, "y")]
    now, new = spark.createDataFrame([(1, "x"), (2, "y")], "e long, v string"), spark.createDataFrame([(1, "z"), (2, "y"), (3, "n")], "e long, v string")
    assert sorted(map(tuple, D.overwrite(now, new).collect())) == [(1, "x", -1), (1, "z", 1), (3, "n", 1)]
    named = idents(spark.createDataFrame([(1, 10, "x")], "e long, attr_id long, v string"), spark.createDataFrame([(10, "a/b")], "attr_id long, attr string"))
    assert [(r.e, r.a, r.v) for r in named.collect()] == [(1, "a/b", "x")]


def test_readers(spark, tmp_path):
    from tidelog.sources import readers

    (tmp_path / "x.csv").write_text("id,name,tx\n1,a,5\n2,,6\n")
    got = readers.read_table(spark, str(tmp_path / "x.csv"), "csv", "id long, name string, tx long", "id", {"name": "x/name"}, "tx", header="true")
    assert sorted(map(tuple, got.collect())) == [(5, 1, "x/name", "a", 1)]
    log = D.datoms(spark, [(1, [(1, "a/b", "x"), (1, "c", "z")]), (2, [(1, "a/b", "x", False)]), (3, [(1, "a/b", "y")])])
    readers.write_datoms(log, str(tmp_path / "log"))
    part = readers.read_datoms(spark, str(tmp_path / "log"), ["a/b"], 1, 3)
    assert sorted(map(tuple, part.collect())) == [(1, 1, "a/b", "x", 1), (2, 1, "a/b", "x", -1)]
    assert "PartitionFilters: [" in part._jdf.queryExecution().executedPlan().toString()
    assert readers.read_datoms(spark, str(tmp_path / "log")).count() == 4


def test_pull_entities(spark):
    import films

    catalog = films.catalog(spark, films.film_datoms(), films.SCHEMA)
    some = spark.createDataFrame([(1,), (3,), (999,)], "e long")
    got = {r.e: r.pulled for r in pull.pull_entities(catalog, some, ["movie/title", {"movie/cast": ["person/name"]}, "movie/sequel"]).collect()}
    assert got[1].title == ["The Terminator"] and [c.name for c in got[1].cast] == [["Arnold Schwarzenegger"], ["Linda Hamilton"]] and got[1].sequel == [2]
    assert got[3].sequel is None and got[999].title is None and got[999].cast is None


def test_utilities(spark):
    df = spark.range(0, 1000).selectExpr("id * 3 as id")
    assert sorted(r.id for r in utility.keep_every_nth(df, 10, "id").collect()) == list(range(0, 3000, 30))
    assert utility.keep_every_nth(df.where("id < 0"), 10, "id").count() == 0
    two = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    assert {r.k: r.x for r in utility.group_and_map(two, ["k"], F.upper("v"), "x").collect()} == {1: ["A", "B"], 2: ["C"]}
    assert sorted(r.v for r in utility.cat_when(two, F.col("k") == 2, "v", F.array(F.lit("x"), F.lit("y"))).collect()) == ["a", "b", "x", "y"]
    assert sorted(r.v for r in utility.map_when(two, F.col("k") == 1, "v", F.upper).collect()) == ["A", "B", "c"]
    assert [r.k for r in utility.map_filter_values(two, "k", lambda c: c + 1, lambda c: c > 2).collect()] == [3]


def test_intake(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 59, 58) + dt.timedelta(seconds=s)
    events = spark.createDataFrame([(i, at(s), n) for i, (s, n) in enumerate([(0, 1), (0.5, 2), (1.0, 4), (2.4, 8), (2.4, 16)])], "id long, ts timestamp_ntz, n long")
    assert [r.n for r in S.intake(events, n="n").orderBy("start").collect()] == [3, 4, 24]
    assert [r.n for r in S.sliding_intake(events).orderBy("id").collect()] == [1, 2, 2, 2, 2]


def test_edn_import_where_workers_lack_the_package(tmp_path):
    """In a session of its own, started elsewhere, so that workers don't find the package beside them."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from tidelog.queries import QUERIES
print("rows", QUERIES["edn_import"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 30" in out.stdout, out.stderr[-2000:]
