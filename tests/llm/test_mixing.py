import pytest
from pyspark.sql import functions as F

from driftline.llm import mixing
from tests.conftest import rows

DOCS = "doc_id long, source string, n_tokens long, slot int, use int"
TARGETS = "source string, target_share double, max_repeats int, weight string"


def docs(spark, sizes):
    return spark.createDataFrame([(i, s, n, 1, 2) for i, (s, n) in enumerate(sizes)], DOCS)


def targets(spark, *rows_):
    return spark.createDataFrame([(*r, "clash") for r in rows_], TARGETS)


def fair_queue(items, shares, repeats, budget):
    """Tokens per source by brute force from the mix's own order."""
    taken, total = {}, 0
    for finish, source, doc, use, n in sorted(items):
        if total + n > budget:
            break
        total += n
        taken[source] = taken.get(source, 0) + n
    return taken


def test_shares_and_repeats(spark):
    d = docs(spark, [("big", 10)] * 300 + [("small", 10)] * 20 + [("none", 10)] * 5 + [(None, 10), ("big", 0), ("big", None)])
    t = targets(spark, ("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.1, 5))
    mixed, report = mixing.mix(d, t)
    got = {r.source: r for r in report.collect()}
    assert got["absent"].actual_share == 0.0 and set(got) == {"big", "small", "absent"}
    assert got["small"].tokens == 600 and got["small"].uses == 60 and got["small"].documents == 20
    assert got["big"].actual_share == pytest.approx(0.7, abs=0.01)
    per_doc = mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("use").alias("u"), F.count_distinct("use").alias("k"))
    assert per_doc.where("n <> u OR n <> k").count() == 0
    assert per_doc.where("source = 'big' AND n > 1").count() == 0 and per_doc.where("n > 3").count() == 0


@pytest.mark.parametrize("budget", [0, 37, 1000, 2500, 10**9])
def test_cut_at_the_budget_is_the_prefix_of_the_merged_order(spark, budget):
    d = docs(spark, [("a", 1 + i % 13) for i in range(200)] + [("b", 5) for _ in range(100)] + [("b", 500)])
    t = targets(spark, ("a", 0.5, 2), ("b", 0.5, 2))
    everything, _ = mixing.mix(d, t, budget=10**9)
    items = [(r.finish, r.source, r.doc_id, r.use, r.n_tokens) for r in everything.collect()]
    mixed, report = mixing.mix(d, t, budget=budget)
    want = fair_queue(items, None, None, budget)
    assert {r.source: r.tokens for r in report.collect() if r.tokens} == want
    assert mixed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] == sum(want.values())
    order = [r.finish for r in mixing.in_order(mixed).collect()]
    assert order == sorted(order)


def test_same_seed_same_mix(spark):
    d, t = docs(spark, [("a", 3)] * 50 + [("b", 2)] * 50), targets(spark, ("a", 0.9, 1), ("b", 0.1, 1))
    a, b, c = (mixing.mix(d, t, budget=60, seed=s)[0] for s in (1, 1, 2))
    assert rows(a) == rows(b) != rows(c)


def test_repeated_rows_and_odd_targets(spark):
    d = docs(spark, [("a", 4)] * 10).withColumn("doc_id", F.lit(1))
    t = targets(spark, ("a", 1.0, None), ("b", None, 2), (None, 0.5, 2), ("c", -1.0, 1))
    mixed, report = mixing.mix(d, t)
    assert mixed.count() == 10
    assert {r.source: r.tokens for r in report.collect()} == {"a": 40, "b": 0, None: 0, "c": 0}


def test_nothing_to_mix(spark):
    mixed, report = mixing.mix(docs(spark, [("a", 1)]).where("false"), targets(spark, ("a", 1.0, 2)))
    assert mixed.count() == 0 and rows(report, "source", "tokens", "actual_share") == [("a", 0, 0.0)]
    mixed, report = mixing.mix(docs(spark, [("a", 1)]), targets(spark, ("a", 1.0, 2)).where("false"))
    assert mixed.count() == 0 and report.count() == 0
