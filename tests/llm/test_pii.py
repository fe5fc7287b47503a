import json
import random

import pytest

from driftline.llm import pii_bootstrap as B
from driftline.llm import pii_text as T
from tests.conftest import rows

GIVEN = ["Ada", "Boris", "Carla", "Dmitri", "Edith", "Franz", "Grit", "Hilda"]
OTHER = ["Ilse", "Jorge", "Kemal", "Lina"]  # not listed
SURNAMES = [a + b for a in ("Ost", "Hal", "Bren", "Tol") for b in ("ric", "mark", "wick", "enko")]


def corpus():
    random.seed(3)
    out = []
    for i in range(900):
        g, s = random.choice(GIVEN + OTHER), random.choice(SURNAMES)
        phone = random.choice([f"+1 303-555-0{i % 900 + 100}", f"303.555.0{i % 900 + 100}"])
        ident = random.choice([f"QQ {i % 90 + 10} 11 22 A", f"9{i % 90 + 10}-44-1{i % 900 + 100}"])
        out.append(random.choice([
            json.dumps({"page": "/x", "note": f"reported by {g} {s} again"}), json.dumps({"full_name": f"{g} {s}", "n": i}), json.dumps({"note": f"Call me on {phone} after lunch."}),
            json.dumps({"mobile": phone}), json.dumps({"note": f"They pasted {ident} into the form."}), json.dumps({"order_ref": f"9{i % 90 + 10}-44-1{i % 900 + 100}"}),
            json.dumps({"button": "Grit Mode", "trace": 10_000_000_00 + i}), json.dumps({"note": "Nothing in the log for new workspaces."})]))
    return out


@pytest.fixture(scope="module")
def reader(spark):
    texts = spark.createDataFrame([(t,) for t in corpus()], "text string")
    return B.learn(texts, spark.createDataFrame([(g,) for g in [*GIVEN, None]], "given_name string"))


CASES = [
    ('{"a": "write to ada.x+1@mail.host.example now"}', {"email"}), ("ADA@HOST.EXAMPLE", {"email"}), ("x at host (dot) example", {"email"}), ("x＠host.example", {"email"}),
    ("https://a.example/?to=ada%40host.example", {"email"}), ("x [at] host DOT example", {"email"}), ("tracker@2.78.1 and worker@rack68, p95 @ 41ms in the EU, @channel", set()),
    ("Call me on 303.555.0188 after lunch.", {"phone"}), ("+44 (0)7700 900 978", {"phone"}), ('{"trace": 1000000001, "x": "10.20.84.7"}', set()), ("release 1.303.39.2 of the sdk", set()),
    ("They pasted 912-44-1234 into the form.", {"ident"}), ('{"order_ref": "912-44-1234"}', set()), ("QQ123456C", {"ident"}), ("99.475.734-K", {"ident"}),
    ("Lindenweg 178a, 99498 Ashfeld", {"address"}), ("80B Larkspur Avenue\\nSteinville QM9 9DN", {"address"}), ("57 chemin de la Source, 99744 Quarrymere", {"address"}),
    ("Calle del Olmo, nº 216, 99685 Marmoor", {"address"}), ("The 24 Lane swimlane board; Section 12 Drive failures; Quarry Row 3 rack; Wall Street theme", set()),
    ("reported by Kemal Tolwick again", {"name"}), ('{"full_name": "TOLWICK, LINA"}', {"name"}), ('{"full_name": "LINA TOLWICK"}', {"name"}), ("lina tolwick", {"name"}), ("Mr. Tolwick", {"name"}),
    ("Tolwick, Lina", {"name"}), ("X. Halric", {"name"}), ('{"button": "Grit Mode"}', set()), ("Iris Sample dataset is gone.", set()), (None, set()), ("", set()), ("\\", set()), ('{"cut": "off', set()),
    ('{"inner": "{\\"note\\": \\"reported by Jorge Halenko again\\"}"}', {"name"}), ("Jos\\u00e9 Halmark reported by Lina Ostric", {"name"}),
]


@pytest.mark.parametrize("text,kinds", CASES)
def test_found(reader, text, kinds):
    gate = T.Gate()
    assert {k for _, _, k in (T.items(text, gate, reader) if text else [])} == kinds


def test_learned_what_no_list_has(reader):
    assert {g.lower() for g in OTHER} <= reader.given
    assert {s.lower() for s in SURNAMES} <= reader.surnames
    assert reader.masks.get("999-99-9999") == "ident" and reader.masks.get("999.999.9999") == "phone"


def test_redaction_keeps_json_and_the_rest(reader):
    doc = {"page": "/x", "n": 3, "note": 'Ärger: "reported by Kemal Tolwick again"\nCall me on 303.555.0188 after lunch.', "mail": "a@b.example", "inner": json.dumps({"to": "ü a@b.example"})}
    for raw in (json.dumps(doc), json.dumps(doc, ensure_ascii=False)):
        got = json.loads(T.redact(raw, T.Gate(), reader))
        assert got["note"] == 'Ärger: "reported by [NAME] again"\nCall me on [PHONE] after lunch.'
        assert (got["page"], got["n"], got["mail"]) == ("/x", 3, "[EMAIL]")
        assert json.loads(got["inner"]) == {"to": "ü [EMAIL]"}
    assert T.redact('{"a": "nothing here"}', T.Gate(), reader) == '{"a": "nothing here"}'


def test_long_text(reader):
    text = "Nothing in the log. " * 50_000 + "mail a@b.example"
    assert T.redact(text, T.Gate(), reader).endswith("mail [EMAIL]")


def test_on_tables(spark, reader):
    df = spark.createDataFrame([("t", 1, "a@b.example and +44 7700 900978", "x"), ("t", 1, "a@b.example", "x"), ("t", 2, None, "x"), (None, None, "", "x")], "tab string, row_id long, text string, kind string")
    assert rows(B.find(df, reader, ["tab", "row_id"])) == [("t", 1, "email"), ("t", 1, "email"), ("t", 1, "phone")]
    assert rows(B.redact(df, reader), "text") == sorted([("[EMAIL] and [PHONE]",), ("[EMAIL]",), (None,), ("",)], key=repr)
    assert B.find(df.where("false"), reader, ["tab", "row_id"]).count() == 0


def test_nothing_to_learn_from(spark):
    r = B.learn(spark.createDataFrame([(None,), ("",)], "text string"), spark.createDataFrame([], "given_name string"))
    assert {k for _, _, k in T.items("a@b.example +44 7700 900978", T.Gate(), r)} == {"email", "phone"}


def test_support_does_not_grow_with_the_corpus(spark, reader, monkeypatch):
    # As many edges as a corpus thousands of times as large has, of one number that nobody asks for.
    row = spark.createDataFrame([("number", "K trace", "9", "1", "", "", "", 150_000_000)], B.EDGE)
    edges = B.edges
    monkeypatch.setattr(B, "edges", lambda texts, text="text": edges(texts, text).unionByName(row))
    got = B.learn(spark.createDataFrame([(t,) for t in corpus()], "text string"), spark.createDataFrame([(g,) for g in GIVEN], "given_name string"))
    assert (got.given, got.surnames, got.masks, got.patterns) == (reader.given, reader.surnames, reader.masks, reader.patterns)


def test_texts_posted_again_change_nothing(spark, reader):
    got = B.learn(spark.createDataFrame([(t,) for t in corpus() * 10], "text string"), spark.createDataFrame([(g,) for g in GIVEN], "given_name string"))
    assert (got.given, got.surnames, got.masks, got.patterns) == (reader.given, reader.surnames, reader.masks, reader.patterns)


def test_joined_as_broadcast(spark, reader, monkeypatch):
    monkeypatch.setattr(B, "BROADCAST_KEYS", 0, raising=False)
    learned = B.learn(spark.createDataFrame([(t,) for t in corpus()], "text string"), spark.createDataFrame([(g,) for g in GIVEN], "given_name string"))
    assert isinstance(learned, B.Learned)
    texts = [t for t, _ in CASES] + corpus()[:60] + [None, "Lindenweg 178a, reported by Jorge Halenko again", "o'hal tolwick, lina hal-tolwick"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id int, text string")
    assert rows(B.find(df, learned, ["row_id"])) == rows(B.find(df, reader, ["row_id"]))
    assert rows(B.redact(df, learned)) == rows(B.redact(df, reader))


@pytest.mark.parametrize("text,kinds", [
    ('{"contact": "tel:+442079460958"}', {"phone"}), ('{"n": "SSN:536-90-4399"}', {"ident"}), ("jane(at)example(dot)com", {"email"}), ("jane [at] example.com", {"email"}),
    ('{"a": "jane{AT}example.com"}', {"email"}), ("reported by Kemal\u00a0Tolwick again", {"name"}), ('{"who": "Lina\u00a0Tolwick"}', {"name"}), ("lina\u00a0tolwick", {"name"}),
    ('He said "call", +1 555-123-4567', {"phone"}), ('{"ts": 1700000000, "v": [1, 2.5, -3], "ip": "10.20.84.7"}', set()), ('{"id": "a1b2c3d4-e5f6"}', set())])
def test_gate_passes_every_notation(reader, text, kinds):
    assert {k for _, _, k in T.items(text, T.Gate(), reader)} == kinds


@pytest.mark.parametrize("text", ['x "y", 555-123-4567', '{"a": "five-five-five-one-two-three-four"}', '{"n": ["a", 5551234567]}', "01.23.45.67", ":1234567"])
def test_gate_opens_where_numbers_finds_one(text):
    assert T.numbers(text) and T.Gate().opening(text) is not None
