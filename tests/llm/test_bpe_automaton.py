import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftline.llm import bpe_automaton as B

PATH = f"{B.TOKENIZERS}/{B.TOKENIZER}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("text", ["", "Hello world", "  two  spaces ", "it's we've I'll", "naïve café 日本語 😀", "a" * 20_000, "<|endoftext|> x", "\r\n\t  x", "x" + "​" * 9,
                                  "0123456789" * 50, "____====----", "ab" * 5_000])
def test_same_ids_as_the_library(library, text):
    a = B.automaton(PATH)
    assert a.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert a.decode(a.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    a = B.automaton(PATH)
    assert a.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert a.decode(a.encode(text)) == text


def test_gadgets_on_a_small_alphabet():
    """Against merging by hand: the pair of least rank first, from the left."""
    import itertools
    merges = [(b"a", b"b"), (b"a", b"a"), (b"ab", b"ab"), (b"b", b"a"), (b"aa", b"b"), (b"b", b"b"), (b"aa", b"aa")]
    ids = {bytes([i]): i for i in range(256)}
    for x, y in merges:
        ids[x + y] = len(ids)
    rank = {m: i for i, m in enumerate(merges)}
    auto = B.Automaton(ids, merges)
    for n in range(1, 9):
        for w in itertools.product((b"a", b"b", b"c"), repeat=n):
            parts = list(w)
            while True:
                best = min((rank.get((p, q), 99), i) for i, (p, q) in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else (99, 0)
                if best[0] == 99:
                    break
                pair, out, i = merges[best[0]], [], 0
                while i < len(parts):
                    if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                        out.append(parts[i] + parts[i + 1])
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            assert auto.word(b"".join(w)) == [ids[p] for p in parts]


def test_on_tables(spark, library):
    df = spark.createDataFrame([(1, "a b", "clash"), (2, None, "c"), (3, "", "c"), (4, "a b", None), (4, "long " * 30_000, None)], "doc_id long, text string, ids string")
    got = {(r.doc_id, len(r.ids)): r.ids for r in B.encode(df.select("doc_id", "text")).collect()}
    assert got[2, 0] == [] and got[3, 0] == [] and got[1, 2] == library.encode("a b").ids
    assert max(n for d, n in got if d == 4) == len(library.encode("long " * 30_000).ids)
    assert B.encode(df).columns == ["doc_id", "ids"]
    counts = sorted((r.doc_id, r.n_tokens) for r in B.count_tokens(df).collect())
    assert counts[:3] == [(1, 2), (2, 0), (3, 0)] and B.count_tokens(df).columns == ["doc_id", "ids", "n_tokens"]
    back = [r.text for r in B.decode(B.encode(df.where("doc_id < 4"), keep=["doc_id"])).orderBy("doc_id").collect()]
    assert back == ["a b", "", ""]
    assert B.encode(df.where("false")).count() == 0
