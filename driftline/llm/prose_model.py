"""Keyword-stuffed pages, link lists and product-tag pages by a prose-trained n-gram model.

A text becomes a sequence of classes, once: function words stand for themselves, other words for their
shape and their place in a run of content words, numbers, prices, links, markup and punctuation for
their kind. A trigram model of these classes is trained on the sentences of the whole corpus: units
that end in a full stop or the like, have function words (or Japanese particles), and neither links nor
markup nor a run of ``RUN`` content words. Counts are summed in Spark; the model's size is bounded by
the number of classes, whatever the corpus.

High side: a line or sentence is abnormal if its perplexity lies ``HIGH_DEVIATIONS`` standard deviations above the mean of
the corpus' sentences (both of the logarithm): links, tags, separators and endless runs of keywords are forms prose doesn't have.

Low side: the model foretells classes; the word itself, given its class, is foretold by the words the same passage
(about ``PASSAGE`` words) had before it. A passage whose word perplexity lies ``LOW_DEVIATIONS`` deviations below the median of the
corpus' passages of its size foretells itself, as keywords dressed up as sentences do. (Median and lower quartile
stand for mean and deviation there, as spam is part of the corpus.)

A page is flagged if abnormal lines and passages hold most of its words (a link weighs as ``LINK_WORDS``).

Defined results: null, empty and blank texts are never flagged, nor are texts of fewer than ``LEAST``
words and links; code, logs and table rows count neither way, unless they hold links; a corpus without any sentence gives an empty
model, under which nothing is abnormal; passages of fewer than ``LEAST_FORETOLD`` words, and of sizes of which there are fewer than
``LEAST_PASSAGES``, have no low side; rows with the same id are each scored; texts
are read whole; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline import scratch

# Frequent function words of the corpus' languages.
FUNCTION_WORDS = {
    "en": "the a an of to and in is are was were for on that this with it be as at by from or not we you if when so no has have had they he she its our your all can will do does did but which who what how why there been than then into out up about any each every them us me my i one two first second per since because although while once unless even without before after until if only also just nobody someone anyone whether more most other another such these those their here now again both few many much never no nor own same so some still too under over through during against between",
    "de": "der die das und ist nicht ein eine einen einem einer des dem den von zu mit auf für im am es sich auch nach wie bei aus oder wir sie war werden wird wurde hat haben seit ohne sobald bevor weil vor keine keinen kein mehr noch wieder nur obwohl während wenn dass als bis dann doch jeder jede jeden jedes alle allen alles viel viele etwa zum zur ins unter über durch gegen um man ihr ihre sein seine uns wird sollte kann",
    "fr": "le la les l un une et est de d du des à au aux en dans pour que qu qui ne n pas plus sur par son sa ses ce cette il elle a été depuis avant après sans dès si alors mais ou où comme tout tous toute toutes chaque encore très même deux parce afin lors jusque sous leur leurs nous vous ils elles était sont être peu",
    "es": "el los las y con por para su al lo como más del se sin desde antes tras cuando porque aunque ya es una uno que no si un de del al en sus este esta estos cada todo todos pero otra otro hasta sobre sin muy fue son ha han era ser entre donde mientras solo aún",
    "ru": "и в не на что как по с для из от у к за но если это его после когда хотя потому было каждый без до о же больше каждое каждые если хотя один одно одному раз сначала все всё только чем так также или мы вы они он она быть был была были нет уже ещё во",
}
WORDS = {w: f"{lang}:{w}" for lang, ws in reversed(FUNCTION_WORDS.items()) for w in ws.split()}

#: Links with their caption stand as units of their own, so that the sentence beside them is scored by itself.
LINKED = re.compile(r"(\[[^\]\n]{0,300}\]\([^)\n]{0,600}\)|<a\s[^>\n]{0,600}>[^<\n]{0,300}</a>|(?:https?://|www\.)[^\s)>\]\"']+)")
_LINK = r"(?:https?://|www\.)[^\s)>\]\"']+|"
_TOKEN = (r"[^\W\d_぀-ヿ㐀-鿿々]+(?:[-'’][^\W\d_]+)*|</?[a-zA-Z][^<>\n]{0,300}>|[.!?](?:[\s\"')\]]|\Z)|[\n\r]+|\d+(?:[.,:]\d+)*(?:\s?[€£¥])?|[$€£¥]\s?\d[\d.,]*"
          r"|[ぁ-ゟ]+|[゠-ヿ]+|[㐀-鿿々]+|[^\W\d_]+|[^\w\s]|_")
#: Texts without links are read by the plain one.
TOKEN, PLAIN = re.compile(_LINK + _TOKEN), re.compile(_TOKEN)
#: Code, logs and table rows say nothing for or against prose and are left out.
NEUTRAL = re.compile(r"^```.*?^```[^\n]*$|^ {4}[^\n]*$|^\t[^\n]*$|^\d{4}-\d\d-\d\dT[^\n]*$|^\s*\|[^\n]*\|\s*$", re.M | re.S)
MAY_BE_NEUTRAL = re.compile(r"^(?:```|    |\t|\d{4}-|\s*\|)", re.M)
KEPT_PUNCT = ".,;:!?()[]<>|/»«*-#\"'`$%&=@·•。、—{}\\+~^！？"
ENDS = ".!?。！？"

RUN = 8
LEAST = 8
HIGH_DEVIATIONS = 5.0
LOW_DEVIATIONS = 5.5
PASSAGE = 96
LEAST_PASSAGES = 100
#: Deviations count as so much at least: a corpus of a few sentences said over and over has next to none.
LEAST_DEVIATION = 0.2
#: Passages of fewer words have no low side: they hardly had words before.
LEAST_FORETOLD = 32
MAIN = 0.5
LINK_WORDS = 3
#: Of the words a passage could have and of the weight of one it has not had yet.
CACHE_WORDS, CACHE_NEW = 2000.0, 0.5
#: A model of so many trigrams at most is collected: the classes are a closed set, so this bounds it by construction.
MODEL_ROWS = 2_000_000
#: Tokens kept in a worker's memo, and how long they may be.
MEMO, MEMO_CHARS = 200_000, 32

# Classes: numbers of the shapes with their places in a run, then all others. 0 parts units.
_SHAPES = ("word", "Title", "UPPER")
_NAMES = ["", *[f"{shape}{i}" for shape in _SHAPES for i in range(1, RUN + 1)], "start", "end", "elided", "caption", "link", "tag", "price", "num", "punct",
          "kana", "kata", "han", *KEPT_PUNCT, *sorted(set(WORDS.values()))]
CODE = {name: i for i, name in enumerate(_NAMES)}
CLASSES = len(_NAMES)
_FIRST_RUN = {shape: CODE[f"{shape}1"] for shape in _SHAPES}
_CONTENT = np.zeros(CLASSES, bool)
_CONTENT[1:1 + RUN * len(_SHAPES)] = True
_FUNCTION = np.array([":" in name and len(name) > 1 or name == "elided" for name in _NAMES])
_IS_WORD = _CONTENT | np.array([":" in name and len(name) > 1 or name in ("kana", "kata", "han") for name in _NAMES])
_WEIGHT = _IS_WORD.astype(np.int64)
_WEIGHT[CODE["link"]] = LINK_WORDS
_FUNCTIONAL = _FUNCTION | np.array([name == "kana" for name in _NAMES])
_IS_END = np.array([name in ENDS and len(name) == 1 for name in _NAMES])
_NO_PROSE = np.array([name in ("link", "caption", "tag") or name.endswith(str(RUN)) and name[:-1] in _SHAPES for name in _NAMES])
#: Classes as characters, so that a text's are joined in one string.
_CHAR = 0x100
BREAK, CAPTION = "\n", "￼"


def _code(name: str) -> str:
    return chr(_CHAR + CODE[name])


def token_classes(token: str) -> str:
    """The classes of a token as characters, words without their place in a run. A sentence's end is followed by a break."""
    c = token[0]
    if c.isalpha():
        if token.startswith(("http://", "https://", "www.")):
            return _code("link")
        if "ぁ" <= c <= "ゟ":
            return _code("kana")
        if "゠" <= c <= "ヿ":
            return _code("kata")
        if "㐀" <= c <= "鿿" or c == "々":
            return _code("han")
        low, before = token.lower(), ""
        cls = WORDS.get(low)
        if cls is None and ("'" in low or "’" in low):
            head, _, tail = low.partition("'") if "'" in low else low.partition("’")
            if len(head) <= 2:  # elided article
                before, cls = _code("elided"), WORDS.get(tail)
        return before + _code(cls or ("UPPER1" if token.isupper() and len(token) > 1 else "Title1" if c.isupper() else "word1"))
    if c in "\n\r":
        return _code("")
    if c in ENDS and (len(token) > 1 or c not in ".!?"):
        after = token[1:].strip()
        return _code(c) + _code("") + (_code(after) if after else "")
    if c == CAPTION:
        return _code("caption")
    if c.isdigit() or len(token) > 1 and c in "$€£¥":
        return _code("price" if set(token) & set("$€£¥") else "num")
    if len(token) > 1:
        return _code("tag")
    return _code(c if c in KEPT_PUNCT else "punct")


class _Memo(dict):
    """What a function gives for tokens, kept for short ones."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, token):
        got = self.of(token)
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[token] = got
        return got


def _neutral(m: re.Match) -> str:
    part = m.group()
    return part if part[:3] != "```" and ("://" in part or "www." in part) else ""


def tokens(text: str) -> list[str]:
    """Tokens of a text; breaks part units, and a caption beside a link is marked as belonging to it."""
    if MAY_BE_NEUTRAL.search(text):
        text = NEUTRAL.sub(_neutral, text.replace("\r\n", "\n").replace("\r", "\n"))
    if "://" not in text and "www." not in text and "](" not in text and "<a" not in text:
        return PLAIN.findall(text)
    out = []
    for line in text.replace("\r", "\n").split("\n"):
        parts = LINKED.split(line)
        for i, part in enumerate(parts):
            got = TOKEN.findall(part)
            out += got
            if i % 2 == 0 and got and len(parts) > 1 and got[-1].rstrip()[-1:] not in ENDS:
                out.append(CAPTION)
            out.append(BREAK)
    return out


def _codes(chars: str) -> np.ndarray:
    """Codes of joined class characters, with each content word's place in its run."""
    raw = np.frombuffer(chars.encode("utf-16-le"), "<u2").astype(np.int64) - _CHAR
    content = _CONTENT[raw]
    seen = np.cumsum(content)
    # A run ends at a function word and where a unit ends.
    run = seen - np.maximum.accumulate(np.where(_FUNCTION[raw] | (raw == 0), seen, 0)) if len(raw) else seen
    return np.where(content, raw + np.minimum(run, RUN) - 1, raw).astype(np.int16)


def _rank(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many equal keys stand before each, and a number for each different key."""
    order = np.argsort(keys, kind="stable")
    ranked, at = keys[order], np.arange(len(keys))
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    out, number = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    number[order] = np.cumsum(new)
    return out, number


def _passages(n_words: np.ndarray) -> np.ndarray:
    """How many passages of about equal size texts of so many words have."""
    return np.maximum(1, -(-n_words // PASSAGE))


def _passage_of(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage of each word of consecutive texts, numbered through, and the first passage of each text."""
    k = _passages(n_words)
    first = np.cumsum(k) - k
    at = np.arange(n_words.sum()) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    return np.repeat(first, n_words) + at * np.repeat(k, n_words) // np.maximum(1, np.repeat(n_words, n_words)), first


def _cache_bits(words: np.ndarray, passage: np.ndarray, passages: int) -> np.ndarray:
    """Per passage, how badly its words are foretold by those before them: bigrams backed off to words."""
    n = len(words)
    if not n:
        return np.zeros(passages)
    size = int(words.max()) + 2
    fresh = np.r_[True, passage[1:] != passage[:-1]]
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    seen, number = _rank(passage * size + words)
    before = np.where(fresh, size - 1, np.r_[0, words[:-1]])
    pair, _ = _rank(number * size + before)
    context = np.where(fresh, 0, np.r_[0, seen[:-1] + 1])
    p = (seen + CACHE_NEW) / (np.arange(n) - start + CACHE_NEW * CACHE_WORDS)
    p = (pair + p) / (context + 1.0)
    return np.bincount(passage, -np.log(p), passages)


def coded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, codes, cache): each text's class codes (16 bits each, 0 between units), and what the words of its passages cost."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, ids = _Memo(token_classes), {}
        words = {chr(_CHAR + i) for i in np.flatnonzero(_IS_WORD)}
        word_id = _Memo(lambda t: ids.setdefault(t.lower(), len(ids)) if memo[t][-1] in words else -1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # so that long texts don't pile up
                part = batch.slice(at, 512)
                if len(ids) > MEMO:
                    ids.clear()
                    word_id.clear()
                found = [tokens(t) if t else [] for t in part.column(1).to_pylist()]
                chars = ["".join(map(memo.__getitem__, x)) + _code("") for x in found]
                sizes, n_tokens = (np.fromiter(map(len, x), np.int64, len(x)) for x in (chars, found))
                codes = _codes("".join(chars))
                said = np.fromiter((i for x in found for i in map(word_id.__getitem__, x)), np.int64, int(n_tokens.sum()))
                n_words = np.bincount(np.repeat(np.arange(len(found)), n_tokens)[said >= 0], minlength=len(found))
                passage, first = _passage_of(n_words)
                k = _passages(n_words)
                cost = _cache_bits(said[said >= 0], passage, int(k.sum()))
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([codes[b - n:b].tobytes() for b, n in zip(ends, sizes)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.r_[first, k.sum()].astype(np.int32)), pa.array(cost))], names=["doc_id", "codes", "cache"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, codes binary, cache array<double>")


def _coded(docs: DataFrame) -> DataFrame:
    return docs if "codes" in docs.columns else coded(docs)


class Units:
    """The units of consecutive texts: their codes with two starts before and an end after each."""

    def __init__(self, column: pa.Array):
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        codes = np.frombuffer(column.buffers()[2], np.int16)[at[0] // 2:at[-1] // 2] if at[-1] > at[0] else np.zeros(0, np.int16)
        doc = np.repeat(np.arange(len(column)), np.diff(at) // 2)
        kept = codes != 0
        number = np.cumsum(~kept)[kept]
        self.codes, self.doc = codes[kept].astype(np.int64), doc[kept]
        self.new = np.r_[True, number[1:] != number[:-1]] if len(number) else np.zeros(0, bool)
        self.unit = np.cumsum(self.new) - 1
        self.starts = np.flatnonzero(self.new)
        self.n = len(self.starts)
        lengths = np.diff(np.r_[self.starts, len(self.codes)])
        self.at = np.arange(len(self.codes)) + 3 * self.unit + 2
        padded = np.full(len(self.codes) + 3 * self.n, CODE["start"], np.int64)
        padded[self.at] = self.codes
        self.ends = self.starts + lengths - 1
        self.end_at = self.at[self.ends] + 1
        padded[self.end_at] = CODE["end"]
        self.padded, self.lengths = padded, lengths

    def sum(self, per_code: np.ndarray) -> np.ndarray:
        return np.bincount(self.unit, per_code, self.n)

    def sentences(self) -> np.ndarray:
        """Which units are sentences of prose."""
        if not self.n:
            return np.zeros(0, bool)
        return (_IS_END[self.codes[self.ends]] & (self.sum(_FUNCTIONAL[self.codes]) >= 1) & (self.sum(_IS_WORD[self.codes]) >= 4)
                & (self.sum(_NO_PROSE[self.codes]) == 0))

    def trigrams(self, at: np.ndarray) -> np.ndarray:
        """The trigrams that end at these places of ``padded``, as one number each."""
        return (self.padded[at - 2] * CLASSES + self.padded[at - 1]) * CLASSES + self.padded[at]


class Model:
    """Interpolated trigram model of classes."""

    STRENGTH, FLOOR = 5.0, 0.1

    def __init__(self, counts: dict[int, int]):
        self.keys = np.array(sorted(counts), np.int64)
        self.n = np.array([counts[k] for k in self.keys.tolist()], np.float64)
        ab, c = self.keys // CLASSES, self.keys % CLASSES
        bi = np.bincount(ab % CLASSES * CLASSES + c, self.n, CLASSES * CLASSES).reshape(CLASSES, CLASSES)
        uni, k = bi.sum(0), self.STRENGTH
        self.total = uni.sum()
        p = (uni + self.FLOOR) / (self.total + self.FLOOR * (np.count_nonzero(uni) + 1))
        self.bigram = ((bi + k * p) / (bi.sum(1, keepdims=True) + k)).ravel()
        self.context = np.bincount(ab, self.n, CLASSES * CLASSES)

    def bits(self, trigrams: np.ndarray) -> np.ndarray:
        """What each trigram costs, in nats."""
        at = np.minimum(np.searchsorted(self.keys, trigrams), max(0, len(self.keys) - 1))
        n = np.where(self.keys[at] == trigrams, self.n[at], 0.0)
        return -np.log((n + self.STRENGTH * self.bigram[trigrams % (CLASSES * CLASSES)]) / (self.context[trigrams // CLASSES] + self.STRENGTH))

    def units(self, u: Units) -> np.ndarray:
        """Logarithm of each unit's perplexity."""
        return (u.sum(self.bits(u.trigrams(u.at))) + self.bits(u.trigrams(u.end_at))) / (u.lengths + 1)


def trigrams(docs: DataFrame) -> DataFrame:
    """(key, n): class trigrams of the corpus' sentences. Summed per batch, then by Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = Units(batch.column(0))
            prose = u.sentences()
            at = np.concatenate([u.at[prose[u.unit]], u.end_at[prose]]) if u.n else np.zeros(0, np.int64)
            keys, n = np.unique(u.trigrams(at), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    return _coded(docs).select("codes").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> dict[int, int]:
    """Trigram counts over all documents (with text, or coded)."""
    counts = scratch.table(trigrams(docs), "prose-model")
    if counts.count() > MODEL_ROWS:
        raise ValueError("the classes are not the closed set they should be")
    return {r["key"]: r["n"] for r in counts.collect()}


#: Logarithms of perplexities are counted in cells of this width.
CELL, CELLS = 0.05, 100_000


class _Scored:
    """A batch of coded texts under a model: units, passages, and where each code belongs."""

    def __init__(self, model: Model, codes: pa.Array, cache: pa.Array):
        self.u = u = Units(codes)
        n = len(codes)
        is_word = _IS_WORD[u.codes]
        n_words = np.bincount(u.doc[is_word], minlength=n)
        k = _passages(n_words)
        first = np.cumsum(k) - k
        at = np.cumsum(is_word) - 1  # a code goes with the last word up to it
        at = np.clip(at - (np.cumsum(n_words) - n_words)[u.doc], 0, None)
        self.passage = first[u.doc] + np.minimum(at * k[u.doc] // np.maximum(1, n_words[u.doc]), k[u.doc] - 1)
        self.unit_cost = model.units(u)
        self.size = np.bincount(self.passage[is_word], minlength=int(k.sum()))
        self.passage_cost = np.asarray(cache.flatten(), np.float64) / np.maximum(1, self.size)
        self.bin = np.log2(np.maximum(1, self.size)).astype(np.int64)
        self.docs = n


def limits(docs: DataFrame, counts: dict[int, int]) -> tuple[float, dict[int, float]]:
    """From all documents: above which logarithm of perplexity a unit is abnormal, and below which a passage, by size."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # bounded by MODEL_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            s = _Scored(model, batch.column(0), batch.column(1))
            prose = s.unit_cost[s.u.sentences()]
            of = np.r_[np.full(len(prose), -1), s.bin]
            cell = np.rint(np.r_[prose, s.passage_cost] / CELL).astype(np.int64)
            keys, n = np.unique(of * CELLS + np.clip(cell, 0, CELLS - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys // CELLS), pa.array(keys % CELLS), pa.array(n)], names=["bin", "cell", "n"])

    # A few hundred cells, whatever the corpus.
    got = docs.select("codes", "cache").mapInArrow(count, "bin long, cell long, n long").groupBy("bin", "cell").agg(F.sum("n").alias("n")).collect()
    prose = [(r["cell"] * CELL, r["n"]) for r in got if r["bin"] == -1]
    total = sum(n for _, n in prose)
    if not total:
        return math.inf, {}
    mean = sum(x * n for x, n in prose) / total
    high = mean + HIGH_DEVIATIONS * max(LEAST_DEVIATION, math.sqrt(sum(n * (x - mean) ** 2 for x, n in prose) / total))
    low = {}
    for size in {r["bin"] for r in got if r["bin"] >= math.log2(LEAST_FORETOLD)}:
        cells = sorted((r["cell"] * CELL, r["n"]) for r in got if r["bin"] == size)
        if (whole := sum(n for _, n in cells)) >= LEAST_PASSAGES:
            quarter, half = _quantile(cells, 0.25 * whole), _quantile(cells, 0.5 * whole)
            low[size] = half - LOW_DEVIATIONS * max(LEAST_DEVIATION, (half - quarter) / 0.6745)
    return high, low


def _quantile(cells: list[tuple[float, int]], rank: float) -> float:
    for x, n in cells:
        rank -= n
        if rank <= 0:
            return x
    return cells[-1][0]


def score(docs: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(doc_id, weight, high, low, flagged) for every document: its words and links, the share of them in units above and
    in passages below what is normal, and the verdict."""
    docs = docs if "codes" in docs.columns else scratch.table(coded(docs), "prose-codes")
    high, low = limits(docs, counts) if counts else (math.inf, {})
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # bounded by MODEL_ROWS
    floor = np.full(64, -math.inf)
    for size, x in low.items():
        floor[size] = x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value) if counts else None
        for batch in batches:
            ids, n = batch.column(0), batch.num_rows
            if model is None:
                u = Units(batch.column(1))
                weight, above, below, abnormal = np.bincount(u.doc, _WEIGHT[u.codes], n), np.zeros(n), np.zeros(n), np.zeros(n)
            else:
                s = _Scored(model, batch.column(1), batch.column(2))
                w = _WEIGHT[s.u.codes]
                up = (s.unit_cost > high)[s.u.unit] if s.u.n else np.zeros(0, bool)
                down = (s.passage_cost < floor[s.bin])[s.passage]
                weight, above, below, abnormal = (np.bincount(s.u.doc, w * x, n) for x in (1, up, down, up | down))
            of = np.maximum(1, weight)
            flagged = (weight >= LEAST) & (abnormal >= MAIN * of)
            yield pa.RecordBatch.from_arrays([ids, pa.array(weight.astype(np.int64)), pa.array(above / of), pa.array(below / of), pa.array(flagged)],
                                             names=["doc_id", "weight", "high", "low", "flagged"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "codes", "cache").mapInArrow(run, f"doc_id {kind}, weight long, high double, low double, flagged boolean")
