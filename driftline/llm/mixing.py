"""Mixing sources to target shares of the total size in tokens.

Weighted fair queueing. Each source's documents stand in a queue in shuffled order (by a seeded hash),
and behind them the same queue again for each further use, up to the source's max_repeats. A document's
virtual finish time is the number of its source's tokens up to and with it, divided by the source's
weight. The mix is all queues merged in order of finish time, cut at the total budget: at any cut, each
source has its share up to one document.

The default budget is the largest at which no source runs dry: the least, over sources with tokens,
of max_repeats * tokens / weight. Weights are the target shares of the sources that have tokens, scaled
to 1; a target without documents is reported with an actual share of 0.

Cumulative sums are made in two levels (hash slots within a source, documents within a slot; time slots
within the budget, documents within the one that holds the cut), so that neither a source with most
documents nor the merged order is ever one task.

Defined results: documents without tokens (null, empty) and documents whose source is null or has no
target are not used; a null or negative target_share counts as 0 and max_repeats below 1 or null as 1; equal finish times go by
source, document and use; a document that stands in the table twice is two documents of one id and
each is used up to max_repeats times; an empty table gives an empty mix and a report of zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline import scratch

SLOTS = 4096


def _queued(docs: DataFrame, seed: int) -> DataFrame:
    """Documents with ``cum``: their source's tokens up to and with them, in shuffled order."""
    h = F.xxhash64(F.lit(seed), "source", "doc_id")
    docs = docs.withColumn("h", h).withColumn("slot", F.shiftright(F.col("h"), 52))
    # Repeated rows of one id are told apart, so that the order is total.
    slots = docs.groupBy("source", "slot").agg(F.sum("n_tokens").alias("slot_tokens"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_tokens").over(before), F.lit(0)))  # at most 4096 rows a source
    slots = slots.select("source", "slot", "before", F.sum("slot_tokens").over(Window.partitionBy("source")).alias("source_tokens"))
    inside = Window.partitionBy("source", "slot").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    # Both sides of the join are partitioned by (source, slot) already.
    return docs.withColumn("within", F.sum("n_tokens").over(inside)).join(slots, ["source", "slot"]).select(
        "source", "doc_id", "n_tokens", "source_tokens", (F.col("before") + F.col("within")).alias("cum"))


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(the mix, the report).

    ``docs``: doc_id, source, n_tokens. ``targets``: source, target_share, max_repeats; one row per
    source, a configuration table, counted before it is broadcast. The mix has doc_id, source, use
    (1 for the first), n_tokens, finish; the report has source, target_share, max_repeats,
    documents, uses, tokens, actual_share.
    """
    docs = docs.where("n_tokens > 0").select("doc_id", "source", "n_tokens")
    targets = targets.groupBy("source").agg(
        F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(1)).alias("max_repeats"))
    if targets.count() > SLOTS:
        raise ValueError(f"a mix takes at most {SLOTS} sources")
    queued = scratch.table(_queued(docs.join(F.broadcast(targets.where("target_share > 0").select("source")), "source", "left_semi"), seed), "mix-queues")
    # One row per source with a target: at most SLOTS rows reach the driver.
    sizes = {r["source"]: r["t"] for r in queued.groupBy("source").agg(F.max("source_tokens").alias("t")).collect()}
    plan = [r for r in targets.where("target_share > 0").collect() if sizes.get(r["source"])]
    whole = sum(r["target_share"] for r in plan)
    weights = {r["source"]: r["target_share"] / whole for r in plan}
    most = int(min((r["max_repeats"] * sizes[r["source"]] / weights[r["source"]] for r in plan), default=0))
    budget = most if budget is None else budget
    spark = docs.sparkSession
    weighted = spark.createDataFrame([(r["source"], weights[r["source"]], r["max_repeats"]) for r in plan], "source string, weight double, repeats int")
    uses = (
        queued.join(F.broadcast(weighted), "source")
        # No use whose tokens begin beyond the budget can be in the mix.
        .withColumn("use", F.explode(F.sequence(F.lit(1), F.least("repeats", F.greatest(F.lit(1), F.ceil(
            F.lit(float(budget)) / F.col("source_tokens")).cast("int"))))))
        .withColumn("finish", (F.col("cum") + (F.col("use") - 1) * F.col("source_tokens")) / F.col("weight"))
        .select("doc_id", "source", "use", "n_tokens", "finish")
    )
    step = max(budget, 1) / SLOTS
    uses = scratch.table(uses.withColumn("slot", F.least(F.floor(F.col("finish") / step), F.lit(2 * SLOTS)).cast("long")), "mix-uses")
    # Tokens per slot of time; beyond the budget's end lies one last slot. At most 2 * SLOTS + 1 rows.
    filled, cut, before = 0, None, 0
    for r in uses.groupBy("slot").agg(F.sum("n_tokens").alias("t")).orderBy("slot").collect():
        if filled + r["t"] > budget:
            cut, before = r["slot"], filled
            break
        filled += r["t"]
    if cut is None:
        taken = uses
    else:
        order = Window.partitionBy("slot").orderBy("finish", "source", "doc_id", "use").rowsBetween(Window.unboundedPreceding, 0)
        edge = uses.where(F.col("slot") == cut).withColumn("sum", F.sum("n_tokens").over(order)).where(F.col("sum") <= budget - before).drop("sum")
        taken = uses.where(F.col("slot") < cut).unionByName(edge)
    taken = taken.drop("slot")
    got = taken.groupBy("source").agg(F.sum(F.when(F.col("use") == 1, 1).otherwise(0)).alias("documents"), F.count("*").alias("uses"),
                                      F.sum("n_tokens").alias("tokens"))
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())  # over one row per source
    report = targets.join(F.broadcast(got), "source", "left").select(
        "source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "uses", "tokens")],
        F.coalesce(F.try_divide(F.coalesce("tokens", F.lit(0)), total), F.lit(0.0)).alias("actual_share"))
    return taken.select("doc_id", "source", "use", "n_tokens", "finish"), report


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix in training order: range-sorted by finish time."""
    return mixed.orderBy("finish", "source", "doc_id", "use")
