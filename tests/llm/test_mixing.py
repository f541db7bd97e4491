import random

import pytest

from statweave.llm import mixing


def brute_targets(sizes):
    """Water-filling as the rule says it: cap, reshare, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def make(rng, sources, n):
    return [(i, " ".join("w" for _ in range(int(rng.paretovariate(1.1) * 3) % 4000)), "en", rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("sources", [["b", "a", None, "é", "Z", "zz", "c"], ["only"], [None]])
def test_targets_and_taken(documents, sources, clash):
    rows = make(random.Random(len(sources)), sources, 1500)
    got = mixing.mix(documents(rows, clash)).collect()
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    source = {i: s for i, _, _, s in rows}
    total = {}
    for i, n in size.items():
        total[source[i]] = total.get(source[i], 0) + n
    want = brute_targets(total)
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken = dict.fromkeys(total, 0)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == total[s] and r.target == pytest.approx(want[s])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    for s, n in taken.items():
        assert n == pytest.approx(want[s], rel=0.01, abs=10)


def test_rates_solve_the_dual(spark):
    rows = spark.createDataFrame([("a", 1000, 1.0), ("b", 10, 20.0), ("c", 7, 7.0), ("d", 0, 0.0), ("e", 9, 0.0)],
                                 "source string, source_size long, target double")
    got = {r.source: r.rate for r in mixing.rates(rows).collect()}
    assert got == pytest.approx({"a": 0.001, "b": 2.0, "c": 1.0, "d": 0.0, "e": 0.0}, abs=1e-9)


def test_edge_cases(documents):
    assert mixing.mix(documents([])).count() == 0
    rows = mixing.mix(documents([(1, None, "en", "a"), (None, "", "en", None), (2, " \t", "en", "b")])).collect()
    assert len(rows) == 3 and all(r["size"] == 0 and r.taken == 0 and r.target == 0 for r in rows)
    twice = [(None, "x y z", "en", "a"), (3, "p q", "en", "a"), (3, "p q", "en", "a"), (4, "long " * 50_000, "en", "b")]
    first, second = ([tuple(r) for r in mixing.mix(documents(twice)).collect()] for _ in range(2))
    assert sorted(first, key=repr) == sorted(second, key=repr) and len(first) == 4
    assert len({r for r in first if r[0] == 3}) == 1
