import math
import random

import numpy as np
import pytest

from statweave.llm import language, queries

SF = "/root/testdata/sf0.01"
SAID = {"en": "the house and the garden with some trees ", "de": "das haus und der garten mit einigen bäumen ", "es": "la casa y el jardín con unos árboles ñ "}


def judged(docs, **options):
    return {r.doc_id: r for r in language.identified(docs, **options).select("row.doc_id", "language", "probability", "accepted").collect()}


def test_declared_documents_are_recognised(spark):
    rows = queries.op6_language(spark, SF).collect()
    assert len(rows) == 1000 and all(r.accepted for r in rows)
    assert sum(r.language == r.declared for r in rows) >= 990
    pages = queries.page_languages(spark, SF).collect()
    assert len(pages) == 250 and sum(r.language == r.declared for r in pages) >= 247


@pytest.mark.parametrize("clash", [False, True])
def test_fusion(documents, clash):
    rows = [(i, SAID[lang] * 3, lang, f"host-{lang}") for i, lang in enumerate(list(SAID) * 30)]
    odd = [(1000, SAID["de"] * 5, "en", "host-en"), (1001, "xx", "es", "host-es"), (1002, None, "en", "host-en"), (1003, "", None, None),
           (1004, "12 34 !!", "de", "host-de"), (1005, "a", None, "host-de"), (1006, "日本語のテキストです" * 40, None, None), (1000, SAID["de"] * 5, "en", "host-en")]
    got = judged(documents(rows + odd, clash))
    assert len(got) == 97 and all(got[i].language == lang and got[i].accepted for i, _, lang, _ in rows)
    assert got[1000].language == "de" and got[1000].accepted  # a long text overrules its declaration
    assert got[1001].language == "es" and got[1005].language == "de"  # short ones follow declaration and host
    assert [got[i].accepted for i in (1002, 1003, 1004, 1006)] == [False] * 4
    assert got[1004].language == "de"


def test_priors_are_smoothed_towards_the_suffix(spark):
    counts = spark.createDataFrame([("de", "big.de", "de", 90.0, 10.0, 0.0), ("de", "new.de", "de", 0.0, 1.0, 0.0), ("com", "c", None, 0.0, 99.0, 0.0)],
                                   "suffix string, host string, declared string, n0 double, n1 double, n2 double")
    hosts, shares = language._priors(counts, 3)
    above = {r.of_host: r.above for r in hosts.collect()}
    assert above["new.de"] == above["big.de"] and above["big.de"][0] > 0.75 > above["c"][0]
    assert all(sum(a) == pytest.approx(1) for a in above.values())
    assert shares.count() == 1


def test_page_evidence(spark):
    page = spark.createDataFrame([('<HTML class=x lang="DE-at"><script>var a = "no";</script><p>ja &amp; gut</p><!-- nein -->', "https://me@Sub.Example.DE:80/a?b"),
                                  (None, None), ("<p lang=fr>oui", "not a url")], "html string, url string")
    rows = page.select(*[c.alias(n) for n, c in language.page_evidence(page.html, page.url).items()]).collect()
    assert rows[0].declared == "de" and rows[0].host == "sub.example.de" and rows[0].suffix == "de" and rows[0].text.split() == ["ja", "&amp;", "gut"]
    assert rows[1] == (None, None, None, None) and rows[2][1:] == (None, None, None)


def test_edge_cases(documents):
    assert judged(documents([])) == {}
    got = judged(documents([(1, "some words", None, "a"), (2, None, None, None)]))
    assert all(r.language is None and not r.accepted for r in got.values())
    long = [(i, SAID["en"] * (20_000 if i == 7 else 2), "en", "a") for i in range(10)]
    assert all(r.language == "en" for r in judged(documents(long)).values())


def made_up(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("size", [80, 130])
def test_every_declared_language_is_modelled(documents, size):
    """More languages than 64, half of them declared by one to four documents."""
    rng = random.Random(size)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(size)]
    rows = [(1000 * i + k, made_up(rng, letters, 60), f"l{i}", "web") for i, letters in enumerate(alphabets) for k in range(1 + i % 4 if i % 2 else 6)]
    unknown = [(-1, "日本語のテキストです" * 40, None, "web"), (-2, "日本語の文です" * 40, None, "other")]
    got = judged(documents(rows + unknown))
    assert all(got[i].language == lang and got[i].accepted for i, _, lang, _ in rows)
    assert not got[-1].accepted and not got[-2].accepted


def test_rare_language_beside_frequent_ones(documents):
    rows = [(i, SAID[lang] * 3, lang, "web") for i, lang in enumerate(list(SAID) * 30)]
    rare = "talo ja puutarha jossa on muutamia puita sekä pieni järvi metsän takana "
    got = judged(documents([*rows, (500, rare * 2, "fi", "web"), (501, "puutarha ja metsän puita", None, "web"), (502, "the house and some trees", "en", "web"),
                            (503, "日本語のテキストです" * 40, None, "web"), (504, "1 2", "zz", "web")]))
    assert (got[500].language, got[500].accepted) == ("fi", True) and (got[501].language, got[501].accepted) == ("fi", True)
    assert got[502].language == "en" and not got[503].accepted and not got[504].accepted
    assert all(got[i].language == lang and got[i].accepted for i, _, lang, _ in rows)


def test_counts_are_those_of_all_documents(documents):
    """Few distinct texts in many copies: no hash of a text leaves a language without counts."""
    rows = [(3000 * i + k, said, lang, "web") for i, (lang, said) in enumerate(SAID.items()) for k in range(2500)]
    model = language.train(documents(rows))
    want = sum(2500 * len(set(language.trigrams(said.encode()).tolist())) for said in SAID.values()) / 2500
    assert model.languages == tuple(sorted(SAID)) and len(model.at) == want
    spread = 0.5
    for i, lang in enumerate(model.languages):
        total = 2500 * len(language.trigrams(SAID[lang].encode()))
        assert model.unseen[i] == pytest.approx(math.log(spread / (total + spread * language.BUCKETS)))


def test_counting_makes_no_pandas_copy_of_the_texts(documents, monkeypatch):
    docs = documents([
        (1, "Äpfel und Birnen", "de", "a"), (2, None, "de", "a"), (3, "", "fr", "a"),
        (4, "apples and pears " * 3000, "en", "a"), (5, "lost", None, "a")])

    def refused(*_):
        raise AssertionError("texts go through pandas")

    monkeypatch.setattr(type(docs), "mapInPandas", refused)
    model = language.train(docs)
    assert model.languages == ("de", "en")
    counts = np.bincount(language.trigrams(("apples and pears " * 3000).encode()), minlength=language.BUCKETS)
    gains = np.zeros(language.BUCKETS)
    for bucket in range(language.BUCKETS):
        for i in range(model.starts[bucket], model.starts[bucket + 1]):
            if model.at[i] == 1:
                gains[bucket] = model.gains[i]
    assert np.allclose(gains, np.log1p(counts / min(0.5, counts.sum() / language.BUCKETS)))
