import random
import re

import numpy as np
import pytest
import xxhash

from statweave.llm import simhash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest reachable index per fingerprint."""
    values, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(values ^ values[i]) <= 2)[0]:
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    return [find(i) for i in range(len(fps))]


TEXTS = [None, "", " \t\n", "One", "one two", "One Two THREE four", "ÀÉ über Ünï x y z", "a b c\x0bd\x0ce", "x " * 70_000,
         " ".join(str(i * i) for i in range(20_000))]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    assert len(masks) == 7 and all(30 <= m.bit_count() <= 40 for m in masks)
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_links_and_components_equal_brute_force(spark):
    rng = random.Random(7)
    fps = [0, 1, 3, 7, 15, (1 << 64) - 1, (1 << 64) - 2]
    for _ in range(40):  # chains whose ends are far apart
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            fps.append(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    fps += [hub ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)][:700]
    fps = sorted(set(fps))
    rows = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    found = {simhash._signed(f): i for i, f in enumerate(fps)}
    got = {found[r.fp]: r.component_id for r in simhash.classes(rows).collect()}
    want = brute_components(fps)
    assert [got.get(i, i) for i in range(len(fps))] == want


@pytest.mark.parametrize("clash", [False, True])
def test_documents(documents, clash):
    near = " ".join(f"w{i}" for i in range(3000))
    texts = [*TEXTS, near, near + " end", near, "One", None]
    docs = documents([(100 - i, t) for i, t in enumerate(texts)], clash)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in reversed(texts)]  # by rising doc_id
    first = 100 - len(texts) + 1
    assert got == {first + i: (f"{f:016x}", first + c) for i, (f, c) in enumerate(zip(fps, brute_components(fps), strict=True))}
    kept = simhash.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_null_ids_repeated_rows_and_empty(documents):
    docs = documents([(None, "alone here"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "a b c")])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, None), (None, 5), (5, 5), (5, 5), (9, 5)], key=repr)
    assert sorted((r.doc_id for r in simhash.one_per_class(docs).collect()), key=repr) == [5, None]
    twice = documents([(5, "a b c"), (5, "a b c"), (5, "a  b c"), (None, "no id"), (None, "no id"), (7, "own words")])
    assert sorted((r.doc_id for r in simhash.one_per_class(twice).collect()), key=repr) == [5, 7, None]
    empty = documents([])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_per_class(empty).count() == 0
