"""Encoding text with a public byte-level BPE tokenizer by a tokenization automaton.

The merges are compiled, one after another, into a deterministic automaton whose arcs carry
tokens. It starts as one state that loops on all bytes. The gadget of merge (a, b) -> ab turns every
"a then b" into one arc ab: the state after a splits off a version that no longer allows b, the
new arc ab leaves from wherever a may leave, and it ends where b ended at that moment. A state is
therefore a version of a line: the line of token a grows by one forbidden token with each merge whose
left part is a, and token ab starts on the version of b's line that stood when it was made. What a state
forbids, it also forbids of tokens that were later grown from it on their left. Exactly one path
accepts a word, and its labels are the BPE encoding; decoding emits the labels' bytes.

Words come from the tokenizer's pre-splitting. Transitions are looked up in a table that is filled as
arcs are first walked; words seen before are read from a bounded memo.

Defined results: null and empty texts have no ids (an empty list); strings of special tokens are
ordinary text; texts are encoded whole, whatever their length; other columns pass through unread.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.json"
# Fixed value: the pre-splitting pattern of the tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words longer than this aren't kept in the memo, which holds at most so many words.
MEMO_WORD, MEMO_WORDS = 48, 300_000
#: Transitions kept in the table; when it is full it is filled anew.
TABLE_ENTRIES = 2_000_000


def _byte_of_char() -> dict[str, int]:
    """Printable Latin-1 characters stand for themselves in the file, all other bytes for 256, 257, ..."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_merges(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Ids by token bytes, and merges in order of priority. Bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = _byte_of_char()
    special = {k for k in model["vocab"] if any(c not in of for c in k)}
    ids = {bytes(of[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return ids, [(bytes(of[c] for c in a), bytes(of[c] for c in b)) for a, b in pairs]


class Automaton:
    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = ids
        self.label = {i: t for t, i in ids.items()}
        #: line[a][b]: when b was forbidden after a. born[c]: when c was made; parts[c]: of what.
        self.line: dict[int, dict[int, int]] = {}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        #: Tokens that some arc carries; one whose parts never meet has none.
        self.arcs = {ids[bytes([b])] for b in range(256) if bytes([b]) in ids}
        for when, (a, b) in enumerate(merges):
            self._gadget(ids[a], ids[b], ids[a + b], when)
        #: Prefix tree of arc labels: prefix -> id, or -1 where no token ends.
        self.tree: dict[bytes, int] = {}
        for t, i in ids.items():
            if i in self.arcs:
                for n in range(1, len(t)):
                    self.tree.setdefault(t[:n], -1)
                self.tree[t] = i
        self.table: dict[int, bool] = {}
        self.memo: dict[str, list[int]] = {}
        self.split = regex.compile(SPLIT)

    def _gadget(self, a: int, b: int, ab: int, when: int) -> None:
        if a not in self.arcs or b not in self.arcs or not self._has_arc(a, b):
            return
        self.line.setdefault(a, {})[b] = when
        if ab not in self.arcs:
            self.arcs.add(ab)
            self.born[ab], self.parts[ab] = when, (a, b)

    def allows(self, last: int, arc: int) -> bool:
        """Whether the state after ``last`` has an arc ``arc``; filled into the table."""
        key = last << 20 | arc
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= TABLE_ENTRIES:
                self.table.clear()
            known = self.table[key] = self._has_arc(last, arc)
        return known

    def _has_arc(self, last: int, arc: int) -> bool:
        never = 1 << 60
        state, version = last, never
        while True:
            forbidden = self.line.get(state)
            if forbidden:
                token, child_born = arc, never
                while True:
                    when = forbidden.get(token)
                    # In the version, and before the token's child was made from it (or by the same gadget).
                    if when is not None and when < version and when <= child_born:
                        return False
                    if token not in self.parts:
                        break
                    child_born, token = self.born[token], self.parts[token][0]
            if state not in self.parts:
                return True
            version, state = self.born[state], self.parts[state][1]

    def word(self, w: bytes) -> list[int]:
        """Labels of the one path that accepts ``w``."""
        n, tree, allows = len(w), self.tree, self.allows
        last, back = [None] * (n + 1), [0] * (n + 1)
        last[0] = -1
        for i in range(n):
            at = last[i]
            if at is None:
                continue
            for j in range(i + 1, n + 1):
                arc = tree.get(w[i:j])
                if arc is None:
                    break
                if arc >= 0 and last[j] is None and (at < 0 or allows(at, arc)):
                    last[j], back[j] = arc, i
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for w in self.split.findall(text):
            got = memo.get(w)
            if got is None:
                got = self.word(w.encode("utf-8"))
                if len(w) <= MEMO_WORD:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[w] = got
            out.extend(got)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", errors="replace")


_COMPILED: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Compiled once per Python worker; the vocabulary file is on every node, its path a parameter."""
    if path not in _COMPILED:
        _COMPILED[path] = Automaton(*read_merges(path))
    return _COMPILED[path]


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str = f"{TOKENIZERS}/{TOKENIZER}",
           keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but text by default) and ``out``, the ids as array<int>."""
    return _mapped(df, text, out, path, keep, T.ArrayType(T.IntegerType(), False))


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str = f"{TOKENIZERS}/{TOKENIZER}",
                 keep: list[str] | None = None) -> DataFrame:
    """As :func:`encode`, with the number of ids instead of the ids."""
    return _mapped(df, text, out, path, keep, T.LongType())


def _mapped(df: DataFrame, text: str, out: str, path: str, keep: list[str] | None, kind: T.DataType) -> DataFrame:
    keep = [c for c in df.columns if c not in (text, out)] if keep is None else keep
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, kind)])
    counts_only = isinstance(kind, T.LongType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            # A few hundred texts at a time, so that long ones don't pile up.
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [a.encode(t) for t in texts.slice(start, 256).to_pylist()]
                sizes = np.fromiter((len(x) for x in ids), np.int64, len(ids))
                if counts_only:
                    col = pa.array(sizes)
                else:
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    col = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], col], names=[*keep, out])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", path: str = f"{TOKENIZERS}/{TOKENIZER}") -> DataFrame:
    """Add ``out``, the text of ``ids``; null ids give null."""
    @F.pandas_udf(T.StringType())
    def text_of(col):
        a = automaton(path)
        return col.map(lambda x: None if x is None else a.decode(list(x)))

    return df.withColumn(out, text_of(ids))
