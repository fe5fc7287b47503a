"""Queries p1, p3 and p8 to p10, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import scratch
from driftline.llm import bpe_automaton, mixing, percentiles, pii_bootstrap, prose_model
from driftline.plans.core import _ranked
from driftline.sources.tables import read, spread


def _pii(spark: SparkSession, d: str):
    texts = spread(pii_bootstrap.texts_of(spark, lambda t: read(spark, d, t)))
    return texts, pii_bootstrap.learn(texts, read(spark, d, "given_names"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    texts, reader = _pii(spark, d)
    return pii_bootstrap.find(texts, reader, ["tab", "row_id"])


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts, reader = _pii(spark, d)
    return pii_bootstrap.redact(texts, reader)


def p3_tenant_type_percentiles(spark: SparkSession, d: str) -> DataFrame:
    groups = ["tenant_id", "event_type"]
    return percentiles.percentiles(percentiles.partial(read(spark, d, "usage_events"), groups, "value"), groups, one_part=True)


def p3_type_percentiles(spark: SparkSession, d: str) -> DataFrame:
    part = percentiles.partial(read(spark, d, "usage_events"), ["event_type"], "value")
    return percentiles.percentiles(part, ["event_type"], one_part=True)


def p3_combined_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per event type from the partial results of each day, combined afterwards."""
    events = read(spark, d, "usage_events").withColumn("day", F.to_date("received_at"))
    daily = scratch.table(percentiles.partial(events, ["day", "tenant_id", "event_type"], "value"), "daily-partials")
    return percentiles.percentiles(daily, ["event_type"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe_automaton.encode(spread(read(spark, d, "documents").select("doc_id", "text")))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text does not come back from its ids; none, for an exact encoding."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    ids = bpe_automaton.encode(docs.withColumn("original", docs["text"]), keep=["doc_id", "original"])
    back = bpe_automaton.decode(ids)
    return back.where("coalesce(original, '') <> text").select("doc_id")


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text that comes back from each document's ids; that of an empty or null text is empty."""
    return bpe_automaton.decode(p8_ids(spark, d)).select("doc_id", "text")


def _mix(spark: SparkSession, d: str):
    docs = spread(read(spark, d, "documents").select("doc_id", "source", "text"))
    sized = scratch.table(bpe_automaton.count_tokens(docs), "mix-sizes")
    return mixing.mix(sized, read(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.in_order(_mix(spark, d)[0])


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_on_target(spark: SparkSession, d: str) -> DataFrame:
    """Of each source: whether it is used, whether its tokens are its share of the mix but for one document, whether no document is used too often."""
    mixed, shares = _mix(spark, d)
    mixed = scratch.table(mixed, "mix")
    # One row per source with a target, and one in all.
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.count_distinct("use").alias("rows"))
    most = per_doc.groupBy("source").agg(F.max("rows").alias("most"))
    sizes = mixed.agg(F.max("n_tokens").alias("largest"), F.sum("n_tokens").alias("all")).first()
    whole = shares.where("tokens > 0").agg(F.sum("target_share")).first()[0] or 1.0
    off = F.abs(F.col("tokens") - F.col("target_share") / F.lit(whole) * F.lit(sizes["all"] or 0))
    return shares.join(F.broadcast(most), "source", "left").select(
        "source", (F.col("tokens") > 0).alias("used"), ((F.col("tokens") == 0) | (off <= F.lit(sizes["largest"] or 0))).alias("on_target"),
        (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = scratch.table(prose_model.coded(spread(read(spark, d, "documents").select("doc_id", "text"))), "prose-codes")
    return prose_model.score(docs, prose_model.train(docs))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("flagged").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p3_tenant_type_percentiles, p3_type_percentiles, p3_combined_days, p8_ids, p8_round_trip, p8_texts, p9_mix, p9_shares, p9_on_target, p10_found, p10_scores)}

ORACLE = {
    "p3_tenant_type_percentiles": _ranked("tenant_id, event_type", [100, 500, 900, 990]),
    "p3_type_percentiles": _ranked("event_type", [100, 500, 900, 990]),
    "p3_combined_days": _ranked("event_type", [100, 500, 900, 990]),
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_on_target": """SELECT source, target_share > 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = m.source AND length(d.text) > 0) AS used, true AS on_target, true AS within_repeats FROM mix_targets m""",
    "p8_round_trip": "SELECT doc_id FROM documents WHERE false",
}
