"""Every stage, and the whole, beside brute force on a small corpus."""

import pytest

import corpus_pipeline
from statweave.llm import linededup

from .test_decontaminate import WORD, low
from .test_linededup import brute as brute_lines
from .test_mixing import brute_targets
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def with_letters(rows):
    return [r for r in rows if any(c.isascii() and c.isalpha() or ord(c) > 127 for c in r[1] or "")]


def without_repeats(rows):
    left = brute_lines([(r[0], r[1]) for r in rows], linededup.MIN_WORDS)
    out = []
    for doc_id, text, *rest in rows:
        removed, kept = left[doc_id, text]
        if not removed:
            out.append((doc_id, text, *rest))
        elif kept.strip(" "):
            out.append((doc_id, kept, *rest[:2], len(kept)))
    return out


def one_per_class(rows):
    rows = sorted(rows)
    parts = brute_components([brute_fingerprint(r[1]) for r in rows])
    return [r for i, r in enumerate(rows) if parts[i] == i]


def uncontaminated(rows, items):
    windows = set()
    for text in items:
        w = WORD.findall(low(text))
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))} if w else set()

    def hit(text):
        w = WORD.findall(low(text))
        return any(tuple(w[k:k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))

    return [r for r in rows if not hit(r[1])]


def check_mix(got, rows):
    size = {r[0]: len(r[1].split()) for r in rows}
    total = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + size[r[0]]
    want, source = brute_targets(total), {r[0]: r[3] for r in rows}
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken = dict.fromkeys(total, 0)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.target == pytest.approx(want[source[r.doc_id]]) and 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    # With ten documents in a source, whole copies can miss by half of a long one.
    longest = {s: max(n for i, n in size.items() if source[i] == s) for s in total}
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in total)


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(tuple(r) for r in docs.collect())
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = [with_letters, without_repeats, one_per_class, lambda x: uncontaminated(x, items)]
    for k, ((_, stage), brute) in enumerate(zip(corpus_pipeline.STAGES, steps, strict=False)):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs, rows = spark.read.parquet(f"{tmp_path}/{k}"), sorted(brute(rows))
        assert sorted(tuple(r) for r in docs.collect()) == rows
    check_mix(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), rows)
    check_mix(corpus_pipeline.run(spark, SF).collect(), rows)


def test_stages_take_odd_rows(spark, documents):
    text = "\n".join(f"the line number {i} of a text with many plain words in it" for i in range(8))
    rows = [(1, text), (2, text), (2, text), (None, text + "\nown words"), (None, None), (4, ""), (5, "12 !!"), (6, "y " * 50_000)]
    rows += [(10 + i, f"some plain words of document {i} and its own {i * i} end") for i in range(8)]
    docs = documents(rows, clash=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.where("false"), SF).count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
    left = {r.doc_id for r in docs.collect()}
    assert {10 + i for i in range(8)} <= left and 6 in left and not left & {4, 5}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
