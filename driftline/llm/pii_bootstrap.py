"""Personal information in free text by bootstrapped contextual extraction.

1. One pass finds candidates (numbers of any notation, pairs of capitalised words, street-like
   spans; e-mail addresses prove themselves) and the lexical patterns around each: the JSON or label
   key before it, the words before and after.
2. Spark holds the graph of patterns and instances as counted edges. Seeds are instances whose form alone
   tells their kind (a number with a country code, a number with the letters of an identity paper, a street
   with a town, a listed given name). Round by round, patterns are scored by the share of their
   instances that are positive, and high-confidence patterns make new instances positive: number notations
   (masks) that mostly occur in a kind's patterns, given names and surnames seen there with several partners.
   A pattern needs diverse instances, so labels that repeat a few fixed phrases don't pass.
3. A second pass applies the learned patterns, notations and names to every text, in any case and notation.

Edges are counted over different texts, so that a text posted over and over counts once. The support asked of a pattern or name is the same at every size of the corpus: partners are capped by the stock
of names, so a floor that grew with the corpus would lose the rare ones first. What the second pass needs is
broadcast if counted to be at most ``BROADCAST_KEYS`` patterns and words. Beyond, it stays a table, and each text is
joined to the patterns and words that reading it can look up, in two rounds: addresses first, as they hide what is inside them.

Defined results: null and empty texts hold nothing; texts that aren't JSON, or are cut off, are read like
others; JSON numbers are no items; names inside e-mail addresses and links are none; rows with the same
id are each read; a corpus too small for any pattern still yields all self-proving items; other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from driftline import scratch
from driftline.llm import pii_text as T
from driftline.operators.joins import BROADCAST_ROWS, lookup_join

#: Learned patterns and words are broadcast only if there are at most so many of them.
BROADCAST_KEYS = 300_000
#: Least share of positive instances in each round: seeds are a part of what a pattern holds, so it starts low.
NAME_SHARE = (0.35, 0.6, 0.7)
NUMBER_SHARE = (0.12, 0.5, 0.6, 0.6)
ADDRESS_SHARE = 0.5
INSIDE = 0.3
BACKED = 0.1
MASK_SHARE = 0.1
#: Least support of a pattern and least partners of a given name and of a surname, at any size of the corpus.
LEAST = 4
GIVEN_PARTNERS = 3
SURNAME_PARTNERS = 1
EDGE = "family string, pattern string, cls string, instance string, given string, surname string, seed string, n long"


def edges(texts: DataFrame, text: str = "text") -> DataFrame:
    """The pattern-instance graph: edges counted over different texts, so that what is posted again adds nothing.

    Counted per batch; copies of a text collapse before they are exchanged, and the edges of all texts before theirs.
    """
    edge = ["family", "pattern", "cls", "instance", "given", "surname", "seed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = T.Gate()
        for batch in batches:
            graph: Counter = Counter()
            read = set()
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                span = gate.opening(t) if t and h not in read else None
                if span is None:
                    continue
                read.add(h)
                plain, _ = T.unescape(t[span[0]:span[1]])
                rest = T.without_links(plain, T.emails(plain))
                found = T.addresses(rest)
                for c in found:
                    for p in T.contexts(rest, c.start, c.end):
                        graph["address", p, "", c.instance, "", "", "address" if c.sure else "", h] += 1
                if found:
                    rest = T._blank(rest, [(c.start, c.end) for c in found])
                for c in T.numbers(rest):
                    found_in = T.contexts(rest, c.start, c.end)
                    seed = T.seed_kind(c, found_in)
                    for p in found_in:
                        graph["number", p, c.cls, c.instance, "", "", seed, h] += 1
                for c in T.names(rest):
                    for p in T.contexts(rest, c.start, c.end):
                        graph["name", p, c.cls, c.instance, c.given, c.surname, "", h] += 1
            columns = list(zip(*graph)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:7]], pa.array(columns[7], pa.int64()), pa.array(list(graph.values()), pa.int64())], names=[*edge, "h", "n"])

    schema = ", ".join(f"{c} string" for c in edge) + ", h long, n long"
    got = texts.select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).where("t IS NOT NULL").mapInArrow(run, schema)
    return got.groupBy(*edge, "h").agg(F.max("n").alias("n")).groupBy(*edge).agg(F.sum("n").alias("n"))


def _small(df: DataFrame) -> DataFrame:
    """For a join: broadcast if counted small, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _patterns(marked: DataFrame, share: float) -> DataFrame:
    """Patterns of ``marked`` edges (column ``positive``) that are confident and diverse."""
    scored = marked.groupBy("pattern").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("good"),
        F.count_distinct(F.when(F.col("positive"), F.col("instance"))).alias("kinds"))
    return scored.where((F.col("good") >= share * F.col("total")) & (F.col("good") >= LEAST)
                        & (F.col("kinds") >= F.greatest(F.lit(LEAST), F.least(F.lit(200), (F.col("good") * 0.3).cast("long"))))).select("pattern")


def _flag(df: DataFrame, words: DataFrame, column, flag: str) -> DataFrame:
    """``df`` with ``flag``: whether ``column`` is among the words."""
    marked = words.select(F.col("w").alias(f"__{flag}"), F.lit(True).alias(flag))
    return df.join(_small(marked), column == F.col(f"__{flag}"), "left").drop(f"__{flag}").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _learn_names(graph: DataFrame, given_names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patterns, given names, surnames.

    A word is learned by shares, not only by support, so that a large corpus doesn't make accidents into
    names: it stands in accepted patterns in ``INSIDE`` of its uses, with several partners, more often in
    its own place than in the other, and next to words of the other sort.
    """
    name = graph.where("family = 'name'").withColumn("head", F.element_at(F.split("surname", "-"), 1))
    listed = given_names.select(F.lower("given_name").alias("w")).where("w IS NOT NULL").distinct()
    given, surnames = listed, None
    for share in NAME_SHARE:
        marked = _flag(name, given, F.col("given"), "g")
        if surnames is None:
            marked = marked.withColumn("positive", F.col("g") & F.col("cls").isin("full", "turned"))
        else:
            marked = _flag(marked, surnames, F.col("head"), "s")
            marked = marked.withColumn("positive", F.when(F.col("cls").isin("full", "turned"), F.col("g") & F.col("s")).otherwise(F.col("s")))
        # Initials and titles without a known surname say nothing against a pattern.
        patterns = scratch.table(_patterns(marked.where("positive OR cls IN ('full', 'turned')"), share), "pii-name-patterns")
        full = _flag(name.where("cls = 'full'").join(_small(patterns.withColumn("inside", F.lit(True))), "pattern", "left"), given, F.col("head"), "next_is_given")
        full = scratch.table(full.groupBy("given", "surname", "head", "next_is_given").agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("n_in")), "pii-pairs")
        as_given = full.groupBy(F.col("given").alias("w")).agg(
            F.sum("n").alias("uses"), F.sum("n_in").alias("n_in"), F.sum(F.when(F.col("next_is_given"), F.col("n")).otherwise(0)).alias("before_given"),
            F.count_if((F.col("n_in") > 0) & ~F.col("next_is_given")).alias("partners"))
        as_surname = full.groupBy(F.col("head").alias("w")).agg(F.sum("n").alias("other_uses"))
        learned = as_given.join(as_surname, "w", "left").where(
            (F.col("partners") >= GIVEN_PARTNERS) & (F.col("n_in") >= INSIDE * F.col("uses")) & (F.col("before_given") < 0.5 * F.col("uses"))
            & (F.coalesce("other_uses", F.lit(0)) < F.col("uses"))).select("w")
        scratch.drop(given if given is not listed else None)
        given = scratch.table(listed.unionByName(learned).distinct(), "pii-given")
        found = _flag(full, given, F.col("given"), "g").withColumn("w", F.explode(F.split("surname", "-"))).groupBy("w").agg(
            F.sum("n").alias("uses"), F.sum(F.when(F.col("g"), F.col("n")).otherwise(0)).alias("after_given"),
            F.sum("n_in").alias("n_in"), F.count_distinct(F.when(F.col("g") & (F.col("n_in") > 0), F.col("given"))).alias("partners"))
        found = found.join(as_given.select("w", F.col("uses").alias("other_uses")), "w", "left")
        surnames = scratch.table(_flag(found, given, F.col("w"), "is_given").where(
            (F.col("partners") >= SURNAME_PARTNERS) & (F.col("n_in") >= INSIDE * F.col("uses")) & (F.col("after_given") >= 0.5 * F.col("uses"))
            & (F.coalesce("other_uses", F.lit(0)) < F.col("uses")) & ~F.col("is_given")).select("w"), "pii-surnames")
    return patterns, given, surnames


def _learn_numbers(graph: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    number = graph.where("family = 'number'")
    masks = None
    for r in range(len(NUMBER_SHARE)):
        patterns = {}
        for kind in ("phone", "ident"):
            positive = F.col("seed") == kind
            marked = number
            if masks is not None:
                marked = number.join(F.broadcast(masks), "cls", "left")  # masks are bounded by the notations of NUMBER
                positive = positive | (F.col("kind") == kind)
            patterns[kind] = scratch.table(_patterns(marked.withColumn("positive", F.coalesce(positive, F.lit(False))), NUMBER_SHARE[r]), "pii-number-patterns")
        # A notation belongs to the kind in whose keys and words before it enough of its instances stand; each
        # occurrence still needs a pattern of the kind, so notations shared with order numbers do no harm.
        where = patterns["phone"].withColumn("kind", F.lit("phone")).unionByName(patterns["ident"].withColumn("kind", F.lit("ident")))
        mentions = number.join(_small(where.where("pattern LIKE 'K %' OR pattern LIKE 'L %'")), "pattern", "left")
        per_instance = mentions.groupBy("cls", "instance").agg(
            *[F.max(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k) for k in ("phone", "ident")])
        shares = per_instance.groupBy("cls").agg(F.sum(F.greatest("phone", "ident")).alias("m"), *[F.avg(k).alias(k) for k in ("phone", "ident")])
        masks = scratch.table(shares.where(F.col("m") >= LEAST).where(F.greatest("phone", "ident") >= MASK_SHARE).select(
            "cls", F.when(F.col("phone") >= F.col("ident"), "phone").otherwise("ident").alias("kind")), "pii-masks")
    # A key that holds nothing but a notation isn't thereby a key of the kind: some of its instances must be seeds,
    # or stand under another pattern of the kind as well.
    for kind in ("phone", "ident"):
        p = patterns[kind]
        known = number.join(_small(p.where("pattern NOT LIKE 'K %'")), "pattern", "left_semi").select("instance").distinct().withColumn("known", F.lit(True))
        keyed = number.where("pattern LIKE 'K %'").join(_small(p), "pattern", "left_semi").join(known, "instance", "left")
        backed = keyed.groupBy("pattern").agg(F.avg(F.when((F.col("seed") == kind) | F.col("known"), 1.0).otherwise(0.0)).alias("b")).where(F.col("b") >= BACKED).select("pattern")
        patterns[kind] = scratch.table(p.where("pattern NOT LIKE 'K %'").unionByName(backed), "pii-number-patterns")
    return patterns, masks


class Learned(NamedTuple):
    """What was learned, too much to broadcast: ``keys`` are (key, kinds), kinds joined by commas."""

    keys: DataFrame
    masks: dict[str, str]


def _reader(rows: Iterable[tuple[str, str]], masks: dict[str, str]) -> T.Reader:
    """A reader of (kinds, key) rows."""
    sets: dict[str, set[str]] = {k: set() for k in T.KEY_KINDS}
    for kinds, key in rows:
        for kind in kinds.split(","):
            sets[kind].add(key)
    given, surnames = sets.pop("given"), sets.pop("surname")
    return T.Reader(sets, masks, given, surnames)


def learn(texts: DataFrame, given_names: DataFrame, text: str = "text") -> T.Reader | Learned:
    """Bootstrap over all texts."""
    graph = scratch.table(edges(texts, text), "pii-graph")
    names, given, surnames = _learn_names(graph, given_names)
    numbers, masks = _learn_numbers(graph)
    address = _patterns(graph.where("family = 'address'").withColumn("positive", F.col("seed") == "address"), ADDRESS_SHARE)
    parts = {"name": names, "phone": numbers["phone"], "ident": numbers["ident"], "address": address, "given": given, "surname": surnames}
    keys = reduce(DataFrame.unionByName, [df.select(F.col(df.columns[0]).alias("key"), F.lit(kind).alias("kind")) for kind, df in parts.items()])
    keys = scratch.table(keys.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")), "pii-learned")
    notations = {r["cls"]: r["kind"] for r in masks.collect()}
    if keys.count() > BROADCAST_KEYS:
        return Learned(keys, notations)
    return _reader(keys.select("kinds", "key").collect(), notations)


def _with_known(texts: DataFrame, learned: Learned, text: str) -> DataFrame:
    """``texts`` with ``__known``: the learned (kinds, key) rows that reading the text can look up, or null.

    Equal texts ask once. They are told apart by their SHA-256, as row numbers aren't stable when a task is repeated.
    """
    known = "array<struct<kinds: string, key: string>>"

    def asking(addresses: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gate = T.Gate()
            for batch in batches:
                out = set()
                for h, t, got in zip(batch["h"], batch["t"], batch["known"]):
                    span = gate.opening(t) if t else None
                    if span is not None:
                        reader = None if addresses else _reader(_pairs(got), {})
                        out.update((h, k) for k in T.asked(T.unescape(t[span[0]:span[1]])[0], reader))
                yield pd.DataFrame(list(out), columns=["h", "key"])
        return run

    def answers(asks: DataFrame) -> DataFrame:
        got = lookup_join(asks.distinct(), learned.keys, ["key"], salt_by="h")
        return got.groupBy("h").agg(F.collect_list(F.struct("kinds", "key")).alias("known"))

    h = F.sha2(F.col(text), 256)
    once = texts.select(h.alias("h"), F.col(text).alias("t")).where("t IS NOT NULL").dropDuplicates(["h"])
    first = once.withColumn("known", F.lit(None).cast(known)).mapInPandas(asking(True), "h string, key string")
    streets = answers(first)
    second = once.join(streets, "h", "left").mapInPandas(asking(False), "h string, key string")
    all_known = scratch.table(answers(first.unionByName(second)), "pii-known").select(F.col("h").alias("__h"), F.col("known").alias("__known"))
    return texts.join(all_known, h == F.col("__h"), "left").drop("__h")


def _pairs(known) -> list[tuple[str, str]]:
    return [] if known is None else [(k["kinds"], k["key"]) for k in known]


def find(texts: DataFrame, reader: T.Reader | Learned, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, kind): one row per text and kind of item in it."""
    schema = StructType([*[texts.schema[k] for k in keys], StructField("kind", StringType())])
    joined = isinstance(reader, Learned)
    masks = reader.masks
    shared = None if joined else texts.sparkSession.sparkContext.broadcast(reader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = T.Gate()
        for batch in batches:
            rows, kinds = [], []
            known = batch.column(len(keys) + 1).to_pylist() if joined else None
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                by = _reader(_pairs(known[i]), masks) if joined else shared.value
                for kind in sorted({k for _, _, k in T.items(t, gate, by)}) if t else ():
                    rows.append(i)
                    kinds.append(kind)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(keys))], pa.array(kinds, pa.string())], names=[*keys, "kind"])

    if joined:
        texts = _with_known(texts, reader, text)
    return texts.select(*keys, F.col(text).alias("__t"), *(["__known"] if joined else [])).where("__t IS NOT NULL").mapInArrow(run, schema)


def redact(texts: DataFrame, reader: T.Reader | Learned, text: str = "text") -> DataFrame:
    """The same rows with placeholders for the items of ``text``."""
    if isinstance(reader, Learned):
        masks = reader.masks

        @F.udf(StringType())
        def clean_joined(t: str | None, known) -> str | None:
            return T.redact(t, T.Gate(), _reader(_pairs(known), masks)) if t else t

        return _with_known(texts, reader, text).withColumn(text, clean_joined(text, "__known")).drop("__known")
    shared = texts.sparkSession.sparkContext.broadcast(reader)

    @F.pandas_udf(StringType())
    def clean(col: pd.Series) -> pd.Series:
        gate = T.Gate()
        return col.map(lambda t: T.redact(t, gate, shared.value) if t else t)

    return texts.withColumn(text, clean(text))


def texts_of(spark: SparkSession, read) -> DataFrame:
    """(tab, row_id, text): payloads and details. ``read`` gives a table by name."""
    events = read("usage_events").select(F.lit("usage_events").alias("tab"), F.col("delivery_id").alias("row_id"), F.col("payload").alias("text"))
    audit = read("audit_log").select(F.lit("audit_log").alias("tab"), F.col("id").alias("row_id"), F.col("details").alias("text"))
    return events.unionByName(audit)
