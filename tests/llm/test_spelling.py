import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from statweave.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute_words(rows, min_length=6, min_count=5):
    n = Counter()
    for r in rows:
        for run in RUN.findall(r[1] or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}


def apart(a, b):
    """Exactly one edit, by trying them all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [x for x in n if apart(w, x)] for w in n}
    form, out = {}, []
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def variants(words, **sizes):
    found = spelling.variants(words, **sizes)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in found.collect())


def vocabulary(rng, size=900):
    """Words in clusters of edits, with anagrams and accents."""
    letters, out = "abcdeéèñß÷t", set()
    while len(out) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 8, 12, 45])))
        for _ in range(6):
            out.add(w)
            i, c = rng.randrange(len(w)), rng.choice(letters)
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[::-1]])
    return {w: rng.choice([1, 3, 6, 40, 300, 2000]) for w in sorted(out)}


@pytest.mark.parametrize("shard", [8192, 64, 5])
def test_equals_brute_force(spark, shard):
    n = vocabulary(random.Random(5))
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert variants(words, shard=shard) == brute_variants(n)


def test_one_leaf_larger_than_a_shard(spark):
    """Anagrams share all counts, so that no level splits them: the shard goes in pieces."""
    rng = random.Random(6)
    n = {"".join(rng.sample("aaabbbbccd", 10)): k for k in range(1, 250)}
    n |= {w + "e": 3000 for w in list(n)[:20]} | {w[1:]: 5 for w in list(n)[20:30]}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    marked = words.select("word", "n", spelling._top_counts("word").alias("top"))
    assert max(spelling.top_trie(marked, 16).values()) > 16
    assert variants(words, shard=16) == brute_variants(n)


def test_chains_lead_to_the_last_form(spark):
    n = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "abjihg": 3125, "akjihg": 15625}
    found = {r[0]: r[1:3] for r in variants(spark.createDataFrame(list(n.items()), "word string, n long"))}
    assert found["abcdef"] == ("abcdeg", "akjihg") and found["abjihg"] == ("akjihg", "akjihg") and found["akjihg"] == (None, "akjihg")


def test_counted_words(spark, documents):
    rng = random.Random(7)
    words = ["Straße", "naïveté", "letters", "LETTERS", "École", "écoles", "coöperate", "short", "multi×plied"] + ["w" + "xyz"[k % 3] * (k % 9) for k in range(30)]
    rows = [(i if i % 17 else None, " ".join(rng.choice(words) for _ in range(60))) for i in range(200)]
    rows += [(5, rows[5][1]), (900, None), (901, ""), (902, "12 !!"), (903, "y" * 50_000), (904, "letters\n" * 20_000)]
    found = spelling.counted_words(documents(rows, clash=True))
    assert {r.word: r.n for r in found.collect()} == brute_words(rows)
    assert any(len(w) == 50_000 for w in brute_words(rows * 5, min_count=5))
    assert spelling.counted_words(documents([])).count() == 0
    assert variants(spelling.counted_words(documents([]))) == []


def test_very_long_words(spark):
    n = {"y" * 50_000: 7, "y" * 49_999: 70, "y" * 49_998: 700, "z" + "y" * 49_999: 3}
    assert variants(spark.createDataFrame(list(n.items()), "word string, n long")) == brute_variants(n)


def test_verification_of_pairs():
    rng = random.Random(8)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([6, 7, 8, 39, 40, 41]))) for _ in range(120)]
    words += [w[:-1] for w in words[:40]] + [w + "a" for w in words[:40]] + ["b" + w[1:] for w in words[:40]]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    got = spelling.Words(words).near(i, spelling.Words(words), j)
    want = [apart(words[a], words[b]) for a, b in zip(i, j, strict=True)]
    assert got.tolist() == want == [spelling.one_edit(words[a], words[b]) for a, b in zip(i, j, strict=True)]


def test_search_spends_one_surplus_and_one_deficit(monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS", 1)  # down to the last level
    rng = np.random.default_rng(9)
    held, asked = rng.integers(0, 3, (300, spelling.GROUPS)), rng.integers(0, 3, (200, spelling.GROUPS))
    asked[:100] = held[:100] + np.eye(spelling.GROUPS, dtype=int)[rng.integers(0, 12, 100)] - np.eye(spelling.GROUPS, dtype=int)[rng.integers(0, 12, 100)]
    found = sorted((int(a), int(b)) for q, w in spelling.Trie(held).search(asked) for a, b in zip(q, w, strict=True))
    over = asked[:, None] - held[None]
    want = np.argwhere((np.maximum(over, 0).sum(2) <= 1) & (np.maximum(-over, 0).sum(2) <= 1))
    assert found == sorted(map(tuple, want.tolist())) and len(found) >= 100


def test_best_near_of_nothing():
    assert spelling.best_near([], [], ["abcdef"]).num_rows == 0
