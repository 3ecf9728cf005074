import random

import pytest
from pyspark.sql import functions as F
from tidelog.operators import joins
from tidelog.operators.zframe import ZFrame


def zs(spark, rows, schema="k string"):
    return ZFrame.of(spark, rows, schema)


def got(z):
    return {tuple(r)[:-1] if len(r) > 2 else r[0]: r["w"] for r in z.df.collect()}


def test_algebra(spark):
    a, b = zs(spark, [("x", 1), ("y", 2), ("z", -1), ("x", 1)]), zs(spark, [("x", -2), ("y", 1), ("z", 5)])
    assert got(a.consolidate()) == {"x": 2, "y": 2, "z": -1}
    assert got(a.plus(b)) == {"y": 3, "z": 4}
    assert got(a.plus(b, b)) == {"x": -2, "y": 4, "z": 9}
    assert got(a.pos_plus(zs(spark, []))) == {"x": 2, "y": 2}
    assert got(a.minus(a)) == {}
    assert got(a.negate().consolidate()) == {"x": -2, "y": -2, "z": 1}
    assert got(a.consolidate().times(b.select(F.col("k").alias("l")))) == {("x", "x"): -4, ("x", "y"): 2, ("x", "z"): 10, ("y", "x"): -4, ("y", "y"): 2, ("y", "z"): 10, ("z", "x"): 2, ("z", "y"): -1, ("z", "z"): -5}
    assert sorted(r.k for r in a.distinct_set().collect()) == ["x", "y"]


def test_indexed(spark):
    a = zs(spark, [("k1", 1, 2), ("k1", 2, 1), ("k2", 1, 1), (None, 9, 1)], "k string, v long")
    b = zs(spark, [("k1", "p", 3), ("k3", "q", 1), (None, "r", 1)], "k string, u string")
    assert got(a.indexed_times(b, ["k"])) == {("k1", 1, "p"): 6, ("k1", 2, "p"): 3}
    assert got(a.index("k").indexed_plus(a)) == {("k1", 1): 4, ("k1", 2): 2, ("k2", 1): 2, (None, 9): 1}
    assert len(a.index("k").df.collect()) == 3
    assert {r.k: (r.s, r.n) for r in a.group(["k"], {"s": "v"}, ["n"]).collect()} == {"k1": (4, 3), "k2": (1, 1), None: (9, 1)}


def test_changes(spark):
    df = spark.createDataFrame([("a", True), ("b", False)], "k string, added boolean")
    assert got(ZFrame.from_changes(df)) == {"a": 1, "b": -1}
    with pytest.raises(Exception, match="neither true nor false"):
        ZFrame.from_changes(spark.createDataFrame([("a", None)], "k string, added boolean")).df.collect()


def test_joins(spark):
    a, b = zs(spark, [("x", 2), ("y", 1), ("n", 1)]), zs(spark, [("x", 1, 1), ("x", 2, 2), ("y", 1, -1)], "k string, v long")
    assert got(joins.left_outer(a, b, ["k"])) == {("x", 1): 2, ("x", 2): 4, ("y", None): 1, ("n", None): 1}
    assert got(joins.anti(a, b, ["k"])) == {"y": 1, "n": 1} and got(joins.semi(a, b, ["k"])) == {"x": 2}
    assert got(joins.theta(a, b.select("v"), F.col("v") > 1).consolidate()) == {("x", 2): 4, ("y", 2): 2, ("n", 2): 2}
    assert got(joins.set_difference(a, b.select("k"))) == {"y": 1, "n": 1} and got(joins.intersection(a, b.select("k"))) == {"x": 1}
    assert got(joins.difference(a, zs(spark, [("x", 3)]))) == {"x": -1, "y": 1, "n": 1}


@pytest.mark.parametrize("seed", range(5))
def test_laws(spark, seed):
    rnd = random.Random(seed)
    make = lambda: zs(spark, [(rnd.choice("abcdef"), rnd.randint(-3, 3)) for _ in range(rnd.randint(0, 30))])
    a, b, c = make(), make(), make()
    assert 0 not in got(a.plus(b)).values()
    assert got(a.plus(a.negate())) == {}
    assert got(a.plus(b)) == got(b.plus(a)) and got(a.plus(b).plus(c)) == got(a.plus(b.plus(c)))
    assert a.plus(b).total_weight().collect()[0][0] == a.total_weight().collect()[0][0] + b.total_weight().collect()[0][0]
    right = c.select(F.col("k").alias("l"))
    assert got(a.plus(b).times(right).consolidate()) == got(a.times(right).plus(b.times(right)))
