import random
from collections import defaultdict

import pytest

from statweave.llm import linededup


def brute(rows, min_words):
    """Per document the lines left, by comparing every two positions."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0]))
    lines = [(d, k, s) for d, (_, text) in enumerate(rows) if text is not None for k, s in enumerate(text.split("\n"))]
    last = {}
    for i, (d, _, _) in enumerate(lines):
        last[d] = i
    gone, seen = defaultdict(set), defaultdict(list)
    for i, (d, k, said) in enumerate(lines):
        best = 0
        for j in seen[said]:
            n = 0
            while i + n <= last[d] and j + n <= last[lines[j][0]] and lines[i + n][2] == lines[j + n][2]:
                n += 1
            best = max(best, n)
        seen[said].append(i)
        if best and sum(len(lines[i + x][2].split()) for x in range(best)) >= min_words:
            gone[d] |= set(range(k, k + best))
    return {rows[d]: (len(gone[d]), None if rows[d][1] is None else "\n".join(
        s for k, s in enumerate(rows[d][1].split("\n")) if k not in gone[d])) for d in range(len(rows))}


def result(docs, min_words):
    return [((r.doc_id, r.text), (r.n_removed, r.left)) for r in linededup.deduplicated(docs, min_words=min_words).select(
        "doc_id", "row.text", "n_removed", "left").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_equal_brute_force(documents, seed):
    rng = random.Random(seed)
    alphabet = ["a", "b c", "d e f", "", "long " * 6][: 2 + seed]
    rows = [(i, "\n".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30)))) for i in range(25)]
    passage = "\n".join(f"line {k} of a passage" for k in range(11))
    rows += [(100 + i, f"{rng.random()}\n{passage}\nown end {i}") for i in range(6)]
    rows += [(200, passage), (201, passage + "\nmore"), (202, "\n".join(passage.split("\n")[3:]))]
    assert dict(result(documents(rows, clash=seed == 1), 8)) == brute(rows, 8)


def test_edge_cases(documents):
    assert result(documents([]), 5) == []
    assert result(documents([(1, None), (2, ""), (3, "only")]), 5) == [((1, None), (0, None)), ((2, ""), (0, "")), ((3, "only"), (0, "only"))]
    run = "one two three\nfour five six"
    rows = [(None, run), (1, run), (1, run), (1, run + "\nx"), (2, "\n".join(["same line here"] * 70)), (3, "x " * 30_000), (4, "x " * 30_000)]
    got = result(documents(rows), 5)
    assert len(got) == len(rows) and dict(got) == brute(rows, 5)
    assert dict(got)[2, rows[4][1]] == (69, "same line here")


def test_short_runs_stay(documents):
    boilerplate = "all rights reserved"
    rows = [(i, f"text {i}\n{boilerplate}\nend {i}") for i in range(50)]
    assert all(n == 0 and left == text for (_, text), (n, left) in result(documents(rows), 50))


def test_levels_are_ordered_like_suffixes(spark, documents):
    rows = [(i, "\n".join("abc"[(i * k + k // 3) % 3] for k in range(12))) for i in range(8)]
    lines = linededup.positions(documents(rows))
    said = {r.pos: r for r in lines.collect()}
    first = {}
    for pos in sorted(said):
        first.setdefault((said[pos].a, said[pos].b), pos)
    for k, level in enumerate(linededup.levels(lines)):
        ranks = {r.pos: r["rank"] for r in level.collect()}
        block = {p: tuple(first[said[p + x].a, said[p + x].b] for x in range(1 << k)) for p in ranks}
        order = sorted(ranks, key=lambda p: block[p])
        assert [ranks[p] for p in order] == sorted(ranks.values())
        assert len({(block[p], ranks[p]) for p in ranks}) == len(set(block.values()))


def test_small_levels_are_not_shuffled(spark, documents, monkeypatch):
    """A level of few rows stays in one partition, whatever the number of shuffle partitions; results do not depend on it."""
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(40))) for i in range(12)] + [(50, "same\n" * 130)]
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = linededup.levels(linededup.positions(documents(rows)))
        assert len(found) > 6 and all(level.rdd.getNumPartitions() == 1 for level in found)
        monkeypatch.setattr(linededup, "FEW", 100)
        parts = [level.rdd.getNumPartitions() for level in linededup.levels(linededup.positions(documents(rows)))]
        assert len(parts) == len(found) and parts[0] > 1 and parts[-1] == 1
        assert dict(result(documents(rows), 8)) == brute(rows, 8)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
