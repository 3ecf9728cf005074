import random

import films
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tidelog import View, run_query
from tidelog.errors import UnsupportedQueryError
from tidelog.sources.datoms import datoms
from tidelog.streaming import stream as S
from tidelog.streaming.view import UnknownTransactionError

TEAM = "[:find ?c (sum ?p) (sum ?q) (count ?e) :where [?t :team/name ?n] [?e :event/team ?t] [?e :event/country ?c] [?e :points/a ?p] [?e :points/b ?q]]"
TYPES = {"team/name": "string", "event/team": "long", "event/country": "string", "points/a": "long", "points/b": "long"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def event(e, team, country, a, b):
    return [(e, "event/team", team), (e, "event/country", country), (e, "points/a", a), (e, "points/b", b)]


def test_sums_and_retractions(spark, tmp_path):
    view = View(spark, TEAM, TYPES, str(tmp_path / "v"))
    view.apply([(1, "team/name", "A"), (2, "team/name", "B"), *event(10, 1, "Japan", 25, 6), *event(11, 2, "Japan", 18, 8), *event(12, 1, "Australia", 25, 3), *event(13, 2, "Australia", 4, 5)], 5)
    assert rows(view.result()) == [("Australia", 29, 8, 2), ("Japan", 43, 14, 2)]
    view.apply([(10, "points/a", 25, False), (11, "event/country", "Japan", False), (12, "event/team", 1, False)], 9)
    assert rows(view.result()) == [("Australia", 4, 5, 1)]
    assert rows(view.as_of(5)) == [("Australia", 29, 8, 2), ("Japan", 43, 14, 2)] and view.history_index() == [5, 9]
    assert rows(view.as_of(7, exact=False)) == rows(view.as_of(5))
    with pytest.raises(UnknownTransactionError):
        view.as_of(7)
    assert view.apply([(99, "team/name", "C")], 9)["skipped"] and view.stats["last_tx"] == 9
    with pytest.raises(ValueError, match="comes after"):
        view.apply([(99, "team/name", "C")], 3)
    again = View(spark, TEAM, TYPES, str(tmp_path / "v"))
    again.apply([(10, "points/a", 25), (10, "points/b", 6, False), (10, "points/b", 0)], 10)
    assert rows(again.result()) == [("Australia", 4, 5, 1), ("Japan", 25, 0, 1)]
    again.compact()
    assert rows(again.result()) == [("Australia", 4, 5, 1), ("Japan", 25, 0, 1)] and again.history_index() == [10]
    again.apply([(13, "points/a", 4, False), (10, "points/b", 0, False)])
    assert rows(again.result()) == []


def test_cartesian_and_self_join(spark, tmp_path):
    facts = [(1, "movie/title", "one"), (2, "movie/title", "two"), (1, "movie/cast", 7), (1, "movie/cast", 8), (2, "movie/cast", 7)]
    kinds = {"movie/title": "string", "movie/cast": "long"}
    product = View(spark, "[:find ?a ?b :where [?x :movie/title ?a] [?y :movie/title ?b]]", kinds, str(tmp_path / "p"))
    pairs = View(spark, "[:find ?a ?b :where [?m :movie/cast ?a] [?m :movie/cast ?b] [(distinct? ?a ?b)]]", kinds, str(tmp_path / "s"))
    for v in (product, pairs):
        v.apply(facts)
    assert len(rows(product.result())) == 4 and rows(pairs.result()) == [(7, 8), (8, 7)]
    for v in (product, pairs):
        v.apply([(2, "movie/title", "two", False), (1, "movie/cast", 8, False), (2, "movie/cast", 9)])
    assert rows(product.result()) == [("one", "one")] and rows(pairs.result()) == [(7, 9), (9, 7)]


def test_a_large_batch_is_added_up_in_many_tasks(spark, tmp_path):
    from tidelog.streaming.view import ROWS_PER_TASK

    n, parts = 1_500_000, 1_500_000 // ROWS_PER_TASK + 1
    log = spark.range(n).coalesce(1).selectExpr("id % 2 + 1 as tx", "id div 2 as e", "'a' as a", "cast(id % 3 as string) as v", "1L as w")
    wanted = [(0, n // 3), (1, n // 3), (2, n // 3)]
    for name, run in (("r", lambda v: v.replay(log)), ("b", lambda v: v.apply_batch(log, 0)), ("t", lambda v: v.apply(log.drop("tx"), 1))):
        view = View(spark, "[:find ?v (count ?e) :where [?e :a ?v]]", {"a": "long"}, str(tmp_path / name))
        run(view)
        assert len(list((tmp_path / name / "g0" / "log").glob("*/i=0/*.parquet"))) == parts
        assert rows(view.result()) == wanted
    with pytest.raises(UnknownTransactionError):
        view.as_of(2)


def test_stream_files_grow_in_number_and_batches_do_not(spark, monkeypatch):
    from tidelog import queries as Q

    monkeypatch.setattr(Q, "STREAM_FILE_BYTES", 2**10)
    small = "/root/testdata/sf0.001"
    for batches in (1, 2):
        path, stream, view = Q._event_stream(spark, small, batches)
        assert len(spark.read.parquet(f"{path}/in").inputFiles()) > batches
        running = S.maintain(view, stream, f"{path}/checkpoint")
        running.awaitTermination()
        assert len({p["batchId"] for p in running.recentProgress if p["numInputRows"]}) == batches
        assert rows(view.result()) == rows(Q.QUERIES["registry_served"](spark, small))


def test_refusals(spark, tmp_path):
    with pytest.raises(UnsupportedQueryError):
        View(spark, "[:find ?v :where [1 _ ?v]]", {})
    with pytest.raises(UnsupportedQueryError):
        View(spark, "[:find ?v :where [1 :a ?v]]", {})
    view = View(spark, "[:find ?v :where [_ :a ?v]]", {"a": "long"}, str(tmp_path / "v"), keep_history=False, validate=True)
    view.apply([(1, "a", 3)])
    with pytest.raises(ValueError, match="does not hold"):
        view.apply([(1, "a", 4, False)])
    assert rows(view.result()) == [(3,)]
    with pytest.raises(UnknownTransactionError):
        view.as_of(1)


QUERIES = [
    "[:find ?x ?z :where [?x :r ?y] [?y :r ?z]]",
    "[:find ?x (count ?y) (sum ?v) :where [?x :r ?y] [?y :v ?v]]",
    "[:find ?a ?b :where [?x :v ?a] [?y :v ?b] [(< ?a ?b)]]",
]
change = st.tuples(st.integers(1, 3), st.sampled_from(["r", "v"]), st.integers(1, 3))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(asserted=st.lists(st.lists(change, max_size=5), min_size=1, max_size=3), gone=st.integers(0, 5), pick=st.integers(0, 2), seed=st.integers(0, 99))
def test_incremental_equals_batch(spark, tmp_path_factory, asserted, gone, pick, seed):
    kinds, flat = {"r": "long", "v": "long"}, [f for tx in asserted for f in tx]
    removed = random.Random(seed).sample(flat, min(gone, len(flat)))
    txs = [*asserted, [(*f, False) for f in removed]]
    random.Random(seed).shuffle(txs[-1])
    view = View(spark, QUERIES[pick], kinds, str(tmp_path_factory.mktemp("v") / "v"))
    for tx in txs:
        view.apply(tx)
    assert rows(view.result()) == rows(run_query(QUERIES[pick], films.catalog(spark, [f for tx in txs for f in tx], kinds)))


def test_replay_and_range(spark, tmp_path):
    log = datoms(spark, [(1, [(1, "a", "x"), (2, "a", None)]), (3, [(1, "a", "x", False), (1, "a", "y")]), (4, [(3, "a", "z")])])
    view = View(spark, "[:find ?v :where [_ :a ?v]]", {"a": "string"}, str(tmp_path / "v"))
    view.replay(log, 1, 4)
    assert rows(view.result()) == [("y",)] and rows(view.as_of(1)) == [("x",)] and view.history_index() == [1, 3]


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    datoms(spark, [(1, [(1, "a", "x"), (2, "a", "x")])]).coalesce(1).write.parquet(path)
    registry = S.Registry(spark)
    make = lambda: View(spark, "[:find ?v (count ?e) :where [?e :a ?v]]", {"a": "string"}, str(tmp_path / "v"))
    view, seen = make(), []
    listener = S.on_progress(spark, seen.append)
    S.maintain(view, S.read_datoms(spark, path), str(tmp_path / "c")).awaitTermination()
    datoms(spark, [(2, [(1, "a", "x", False), (3, "a", "y")])]).coalesce(1).write.mode("append").parquet(path)
    S.maintain(view, S.read_datoms(spark, path), str(tmp_path / "c")).awaitTermination()
    registry.sync("counts", view)
    registry.serve("counts")
    assert rows(spark.sql("select * from counts")) == [("x", 1), ("y", 1)] and rows(registry.result("counts")) == [("x", 1), ("y", 1)]
    assert view.history_index() == [1, 2] and registry.status()["counts"]["transactions"] == 2 and not registry.status()["counts"]["active"]
    registry.stop()
    spark.streams.removeListener(listener)


def test_delta_join_emits_each_pair_once(spark, tmp_path):
    left, right = str(tmp_path / "l"), str(tmp_path / "r")
    put = lambda rows, schema, path: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    put([(1, "Alice", 1)], "c long, n string, w long", left)
    put([(1, "USA", 1)], "c long, k string, w long", right)
    out = []
    for step in range(2):
        streams = [spark.readStream.schema(s).parquet(p) for s, p in (("c long, n string, w long", left), ("c long, k string, w long", right))]
        S.delta_join(*streams, ["c"]).writeStream.foreachBatch(lambda d, _: out.extend(map(tuple, d.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        if not step:
            put([(1, "Bob", 1)], "c long, n string, w long", left)
            put([(1, "USA", -1), (1, "US", 1)], "c long, k string, w long", right)
    assert sorted(out) == sorted([(1, "Alice", "USA", 1), (1, "Alice", "USA", -1), (1, "Alice", "US", 1), (1, "Bob", "USA", 1), (1, "Bob", "USA", -1), (1, "Bob", "US", 1)])


def test_a_log_at_once_equals_its_transactions_one_by_one(spark, tmp_path):
    rnd = random.Random(4)
    kinds, made = {"r": "long", "v": "long"}, []
    for tx in range(2, 9):
        made.append((tx, [(rnd.randint(1, 4), rnd.choice(["r", "v"]), rnd.randint(1, 4), rnd.random() < 0.7) for _ in range(6)]))
    for k, query in enumerate(QUERIES):
        one, all_ = (View(spark, query, kinds, str(tmp_path / f"{n}{k}")) for n in "ab")
        for tx, items in made:
            one.apply(items, tx)
        assert all_.replay(datoms(spark, made[:3]))["tx"] == 4
        all_.replay(datoms(spark, made))
        assert all_.history_index() == one.history_index() == [tx for tx, _ in made] and all_.replay(datoms(spark, made))["skipped"]
        for tx in (2, 4, 5, 8):
            assert rows(all_.as_of(tx)) == rows(one.as_of(tx))


def test_a_crash_in_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    from tidelog.streaming import view as module

    def filled(name):
        view = View(spark, "[:find ?v (count ?e) :where [?e :a ?v]]", {"a": "string"}, str(tmp_path / name))
        view.apply([(1, "a", "x"), (2, "a", "y")])
        view.apply([(2, "a", "y", False), (3, "a", "x")])
        return view

    want = [("x", 2)]
    for step in ("write_text", "delete"):
        for nth in range(4):
            view, calls = filled(f"{step}{nth}"), []

            def fails(*args, real=getattr(module, step), nth=nth, calls=calls):
                calls.append(args)
                if len(calls) > nth:
                    raise OSError("lost")
                return real(*args)

            with monkeypatch.context() as m:
                m.setattr(module, step, fails)
                try:
                    view.compact()
                except OSError:
                    pass
            again = View(spark, view.query, {"a": "string"}, view.path)
            assert rows(again.result()) == want
            again.apply([(1, "a", "x", False)])
            again.compact()
            assert rows(again.result()) == [("x", 1)] and again.history_index() == [3]
            if len(calls) <= nth:
                break


def test_stream_keeps_transaction_times(spark, tmp_path):
    path = str(tmp_path / "in")
    for tx, part in [(5, [(1, "a", "x")]), (7, [(2, "a", "x")]), (7, [(1, "a", "x", False)]), (6, [(9, "a", "late")])]:
        datoms(spark, [(tx, part)]).coalesce(1).write.mode("append").parquet(path)
    view = View(spark, "[:find ?v (count ?e) :where [?e :a ?v]]", {"a": "string"}, str(tmp_path / "v"))
    S.maintain(view, S.read_datoms(spark, path, files_per_batch=1), str(tmp_path / "c")).awaitTermination()
    assert view.history_index() == [5, 6, 7]
    assert [rows(view.as_of(t)) for t in (5, 6, 7)] == [[("x", 1)], [("late", 1), ("x", 1)], [("late", 1), ("x", 1)]]
    assert view.apply_batch(datoms(spark, [(8, [(1, "a", "z")])]), 3)["skipped"]
