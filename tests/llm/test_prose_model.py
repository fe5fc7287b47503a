import pytest

from driftline.llm import prose_model as P

PROSE = [
    "The report shows {} rows, because the export had not been finished before midnight.",
    "If you need the numbers of the last {} days, open the settings page and pick the weekly view.",
    "We looked at every filter that failed last week, and nobody complained about the new one.",
    "It took us {} minutes to find out that the key had expired, so the team wrote a note.",
    "A good page answers one question and leaves the rest out of the way of the reader.",
]
SPAM = {
    "links": "Our partners\n" + "\n".join(f"https://www.x{i}.example/seo/growth?id={i}" for i in range(30)),
    "anchors": "".join(f'<a href="http://y{i}.test/kpi">best web counter tool</a>\n' for i in range(20)),
    "keywords": "best web counter cheap funnel tracker free seo plugin top growth script online heatmap widget " * 6,
    "lines": "\n".join(["growth (51)", "seo (20)", "» web counter tool »", "metrics (9)"] * 8),
    "products": "\n".join(f"Visitor Testing Plugin Pro €{i}.99 SALE [seo, growth, kpi, widget]" for i in range(10)),
    "dressed": "Our cheap web counter plugin is the cheap web counter plugin for web counter plugin users. Buy the web counter plugin now. " * 6,
    "towns": ", ".join(f"funnel stats download in Town{i}" for i in range(20)),
    "dressed in French": "Cherchez outil de suivi pour boutique et trouvez outil de suivi pour boutique avec outil de suivi pour boutique. " * 8,
    "table of links": "\n".join(f"| {i} | https://www.x{i}.example/seo/growth?id={i} |" for i in range(30)),
    "mixed": PROSE[2] + "\n" + "best web counter cheap funnel tracker free seo plugin top growth script online heatmap widget " * 6,
}
FINE = {
    "prose": " ".join(p.format(7) for p in PROSE),
    "short": "Which events count towards the quota?",
    "list with links": "\n".join(f"{i}. [About the report](https://a.example/seo/{i}) " + PROSE[i].format(3) for i in range(5)),
    "code": PROSE[0].format(3) + "\n```json\n{\"a\": 1, \"b\": [1, 2, 3]}\n```\n    GET /v1/x?limit=7\n2025-05-07T07:12:25Z WARN lag=2\n| p95 | 51 ms |",
    "tags beside": " ".join(p.format(7) for p in PROSE) + "\nTags: growth #export #seo",
    "code only": "```\nSELECT event_type, count(*) FROM log WHERE tenant_id = 1 GROUP BY 1\n```",
}


@pytest.fixture(scope="module")
def flagged(spark):
    corpus = [(1000 + i, PROSE[i % 5].format(i) + " " + PROSE[(i + 1 + i // 5) % 5].format(i + 1)) for i in range(400)]
    cases = list(SPAM.items()) + list(FINE.items()) + [("null", None), ("empty", ""), ("blank", " \n\t "), ("long", " ".join(PROSE[i % 5].format(i) for i in range(20_000)))]
    docs = spark.createDataFrame(corpus + [(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id for r in P.score(docs, P.train(docs)).where("flagged").collect()}
    return {name for i, (name, _) in enumerate(cases) if i in got}, got


@pytest.mark.parametrize("name", SPAM)
def test_spam_is_flagged(flagged, name):
    assert name in flagged[0]


@pytest.mark.parametrize("name", [*FINE, "null", "empty", "blank", "long"])
def test_pages_that_say_something_are_not(flagged, name):
    assert name not in flagged[0]


def test_prose_is_not(flagged):
    assert not [i for i in flagged[1] if i >= 1000]


def test_counts_add_up_whatever_the_partitions(spark):
    docs = spark.createDataFrame([(i, PROSE[i % 5].format(i)) for i in range(60)], "doc_id long, text string")
    assert P.train(docs.repartition(7)) == P.train(docs.coalesce(1))


def test_classes():
    def names(text):
        memo = P._Memo(P.token_classes)
        return [P._NAMES[c] for c in P._codes("".join(memo[t] for t in P.tokens(text)))]

    assert names("Best web counter. The app") == ["Title1", "word2", "word3", ".", "", "en:the", "word1"]
    assert names("l'outil 3.5, €9 <b> #x") == ["elided", "word1", "num", ",", "price", "tag", "#", "word2"]
    assert names("see [a page](https://a.example/x) now") == ["word1", "caption", "", "[", "en:a", "word1", "]", "(", "link", ")", "", "en:now", "caption", ""]
    assert names("更新は x") == ["han", "kana", "word1"] and names("one\r\n\r\ntwo") == ["en:one", "", "en:two"]
    assert names(" ".join(["seo"] * 10)) == [f"word{min(i, P.RUN)}" for i in range(1, 11)]


def test_words_said_before_cost_less():
    import numpy as np
    once, again = P._cache_bits(np.arange(40), np.zeros(40, int), 1)[0], P._cache_bits(np.arange(40) % 4, np.zeros(40, int), 1)[0]
    assert again < once / 2
    two = P._cache_bits(np.arange(40) % 4, np.repeat([0, 1], 20), 2)  # a passage knows nothing of the one before
    assert two[0] == pytest.approx(two[1]) and two.sum() > again


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.train(docs) == {}
    assert P.score(docs, {}).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h i j", "x"), (1, None, "y")], "doc_id long, text string, flagged string")
    assert [r.flagged for r in P.score(one, {}).collect()] == [False, False]
