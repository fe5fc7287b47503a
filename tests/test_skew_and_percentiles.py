import math
import random

import pytest
from pyspark.sql import functions as F

from driftline.functions.ordered import with_code
from driftline.operators import hot_keys, joins, ranks
from tests.conftest import rows

SCHEMA = "tenant_id string, value double, code string, n int, cell int"  # the last three clash with inner names


def nearest(values, permille):
    values = sorted(values)
    return values[max(1, -(-len(values) * permille // 1000)) - 1]


def test_codes_order_as_doubles(spark):
    vs = [-math.inf, -1e308, -2.5, -1e-320, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 3e10, math.inf]
    df = with_code(spark.createDataFrame([(v,) for v in vs], "value double"), "value", "c").collect()
    codes = [r.c for r in df]
    assert codes == sorted(codes)
    assert codes[4] == codes[5]
    assert len(set(codes)) == len(vs) - 1


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(5)
    data = [("hot", random.choice([1.0, 2.0, random.uniform(-1e6, 1e12)])) for _ in range(900)]
    data += [(f"t{i % 40}", random.choice([0.0, -0.0, float(i), 1.0])) for i in range(400)]
    data += [("nulls", None), ("nulls", None), ("nan", math.nan), ("nan", 3.0), (None, 7.0), ("tie", 4.0), ("tie", 4.0), ("big", 1e300), ("big", -5.0)]
    return data, spark.createDataFrame([(t, v, "x", 1, 2) for t, v in data], SCHEMA)


def test_profile_matches_brute_force(skewed):
    data, df = skewed
    got = {r[0]: r for r in hot_keys.profile(df, "tenant_id", "value").collect()}
    assert set(got) == {t for t, _ in data}
    for key in got:
        mine = [v for t, v in data if t == key]
        ok = [v for v in mine if v is not None and not math.isnan(v)]
        r = got[key]
        assert (r["rows"], r["values"]) == (len(mine), len(ok))
        assert r["total"] == pytest.approx(math.fsum(ok), rel=1e-9, abs=1e-3)
        for p, c in ((500, "p50"), (900, "p90"), (990, "p99")):
            assert r[c] == (nearest(ok, p) if ok else None)


def test_hot_keys(skewed, spark):
    data, df = skewed
    assert [(r.key, r.n) for r in hot_keys.hot(hot_keys.histograms(df, "tenant_id", "value"), 0.5).collect()] == [("hot", 900)]


def test_histograms_of_parts_add_up(skewed):
    _, df = skewed
    one, two = df.randomSplit([0.5, 0.5], seed=1)
    both = hot_keys.histograms(one, "tenant_id", "value").unionByName(hot_keys.histograms(two, "tenant_id", "value")).groupBy("key", "cell").agg(F.sum("n").alias("n"))
    assert rows(both) == rows(hot_keys.histograms(df, "tenant_id", "value"))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hot_keys.profile(empty, "tenant_id", "value").count() == 0
    assert hot_keys.hot(hot_keys.histograms(empty, "tenant_id", "value"), 0.02).count() == 0


@pytest.mark.parametrize("limit", [100, 0])
def test_lookup_join_is_the_same_broadcast_or_salted(spark, limit):
    big = spark.range(200).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, "a").alias("j"), "id")
    small = spark.createDataFrame([(0, "a", "x"), (1, None, "y")], "k long, j string, v string")
    got = joins.lookup_join(big, small, ["k", "j"], "left", salt_by="id", limit=limit)
    want = [(k, j, i, "x" if (k, j) == (0, "a") else "y" if (k, j) == (1, None) else None) for i in range(200) for k, j in [(i % 3, "a" if i % 2 == 0 else None)]]
    assert rows(got, "k", "j", "id", "v") == sorted(want, key=repr)


def test_column_names():
    assert [ranks.column_of(p) for p in (500, 990, 1, 999)] == ["p50", "p99", "p0_1", "p99_9"]


def test_only_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    big = spark.range(300).select(F.when(F.col("id") < 100, 0).when(F.col("id") < 200, None).otherwise(F.col("id") % 7 + 1).alias("k"), "id")
    small = spark.createDataFrame([(0, "hot", 100), (None, "null", 100), *[(i, f"v{i}", 15) for i in range(1, 8)], (99, "none", 0)], "k long, v string, m long")
    for limit in (0, 5, 100):
        got = joins.lookup_join(big, small, ["k"], salt_by="id", limit=limit, rows_of="m")
        assert rows(got, "id", "v") == sorted([(i, "hot" if i < 100 else "null" if i < 200 else f"v{i % 7 + 1}") for i in range(300)], key=repr)


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 10)
    small = spark.createDataFrame([(1, "x" * 50)], "k long, v string")
    got = joins.lookup_join(spark.range(3).select(F.col("id").alias("k")), small, ["k"])
    assert "Broadcast" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 1


@pytest.mark.parametrize("rows_of,hot_rows", [(None, 50), ("m", 50), ("m", 5)])
def test_what_is_counted_too_large_is_not_broadcast(spark, monkeypatch, rows_of, hot_rows):
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    small = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit(10).alias("m"))  # far below Spark's own threshold
    got = joins.lookup_join(spark.range(200).select((F.col("id") % 20).alias("k"), "id"), small, ["k"], salt_by="id", limit=0, rows_of=rows_of)
    assert rows(got, "id", "v") == sorted([(i, i % 20 * 2) for i in range(200)], key=repr)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
