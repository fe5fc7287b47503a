import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.llm import percentiles

SCHEMA = "tenant_id string, value double, code string, n int, cell int"  # the last three clash with inner names


def nearest(values, permille):
    values = sorted(values)
    return values[max(1, -(-len(values) * permille // 1000)) - 1]


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(5)
    data = [("hot", random.choice([1.0, 2.0, random.uniform(-1e6, 1e12)])) for _ in range(900)]
    data += [(f"t{i % 40}", random.choice([0.0, -0.0, float(i), 1.0])) for i in range(400)]
    data += [("nulls", None), ("nulls", None), ("nan", math.nan), ("nan", 3.0), (None, 7.0), ("tie", 4.0), ("tie", 4.0), ("big", 1e300), ("big", -5.0)]
    return data, spark.createDataFrame([(t, v, "x", 1, 2) for t, v in data], SCHEMA)


def test_percentiles_combine_over_any_split(skewed, spark):
    data, df = skewed
    parts = None
    for i, piece in enumerate(df.randomSplit([0.2, 0.5, 0.3], seed=3)):
        p = percentiles.partial(piece.withColumn("day", F.lit(i)), ["day", "tenant_id"], "value")
        parts = p if parts is None else parts.unionByName(p)
    got = {r.tenant_id: r for r in percentiles.percentiles(parts, ["tenant_id"]).collect()}
    for key in {t for t, _ in data}:
        ok = [v for t, v in data if t == key and v is not None and not math.isnan(v)]
        if not ok:
            assert key not in got
            continue
        assert [got[key][c] for c in ("p10", "p50", "p90", "p99")] == [nearest(ok, p) for p in (100, 500, 900, 990)]
        assert got[key]["values"] == len(ok)


def test_rounded_partials_keep_their_bound(skewed):
    data, df = skewed
    got = {r.tenant_id: r for r in percentiles.percentiles(percentiles.partial(df, ["tenant_id"], "value", mantissa_bits=6), ["tenant_id"]).collect()}
    for key in ("hot", "t1", "tie"):
        ok = [v for t, v in data if t == key]
        for c, p in (("p10", 100), ("p50", 500), ("p99", 990)):
            exact = nearest(ok, p)
            assert abs(got[key][c] - exact) <= abs(exact) * 2**-6


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, width=64), min_size=1, max_size=40))
def test_any_doubles(spark, values):
    df = spark.createDataFrame([("a", v) for v in values], "g string, value double")
    r = percentiles.percentiles(percentiles.partial(df, ["g"], "value"), ["g"], [1, 500, 1000]).first()
    assert [r["p0_1"], r["p50"], r["p100"]] == [nearest(values, p) for p in (1, 500, 1000)]


def test_one_part_needs_no_adding_up(skewed):
    _, df = skewed
    part = percentiles.partial(df, ["tenant_id"], "value")
    assert sorted(map(tuple, percentiles.percentiles(part, ["tenant_id"], one_part=True).collect()), key=repr) == sorted(
        map(tuple, percentiles.percentiles(part, ["tenant_id"]).collect()), key=repr)


def test_no_values(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert percentiles.percentiles(percentiles.partial(empty, ["tenant_id"], "value"), ["tenant_id"]).count() == 0
