import os
import re
import subprocess
import sys

import pytest

from statweave.llm import decontaminate

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items):
    words = WORD.findall(low(text))
    hit, found = set(), set()
    for item, said in items:
        w = WORD.findall(low(said))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else ():
            for at in range(len(words) - n + 1):
                if words[at:at + n] == w[k:k + n]:
                    hit |= set(range(at, at + n))
                    found |= {item} - {None}
    return len(words), len(hit), sorted(found)


LONG = "the quick brown fox jumps over the lazy dog while seven grey wolves watch from afar"
ITEMS = [("9", LONG), ("10", "Short one!"), ("11", ""), ("12", None), (None, "nameless item"), ("13", "a a a a a a a a a a a a"),
         ("9", "Über-Straße №5 größer"), ("14", LONG)]
TEXTS = [None, "", "...", "THE quick, brown-fox jumps over the lazy dog while seven grey wolves", f"x {LONG} y", "short ONE, short; one",
         "nameless\nitem", "a " * 40, "über straße №5 größer", "quickbrown fox", "the quick brown fox jumps over the lazy dog while",
         "z " * 30_000 + LONG]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, text string")


@pytest.mark.parametrize("clash, part_chars", [(False, 3_000_000), (True, 3_000_000), (True, 30)])
def test_equals_brute_force(documents, items, clash, part_chars):
    docs = documents(list(enumerate(TEXTS)), clash)
    found = decontaminate.contamination(docs, items, part_chars=part_chars)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found.collect()}
    assert got == {i: brute(t, ITEMS) for i, t in enumerate(TEXTS)}
    clean = decontaminate.clean(docs, items, part_chars=part_chars)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(TEXTS) if not brute(t, ITEMS)[1]}


def test_spans_lead_back_to_the_original(documents, items):
    text = "É! The QUICK brown-fox jumps over the lazy dog, while; end. SHORT (one)."
    row = decontaminate.contamination(documents([(1, text)]), items).first()
    assert [text[s.start:s.stop] for s in row.spans] == [
        "The QUICK brown-fox jumps over the lazy dog, while", "SHORT (one"]


def test_parts_give_the_same_spans(documents, items):
    text = "É! The QUICK brown-fox jumps over the lazy dog, while; and nameless item, no: short (one)"
    docs = documents([(1, text)])
    one, many = (decontaminate.contamination(docs, items, part_chars=k).first() for k in (3_000_000, 20))
    assert one == many and len(one.spans) == 3


def test_empty_tables(spark, documents, items):
    docs = documents([(1, LONG)])
    nothing = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.contamination(docs, nothing).first().n_hit == 0
    assert decontaminate.contamination(documents([]), items).count() == 0


def test_memory_of_an_automaton():
    """Under 1.5 KB for a word of the benchmark, so that a full part stays under half a gigabyte."""
    code = """
import random, resource
from statweave.llm.decontaminate import Scanner
random.seed(1)
text = " ".join(f"w{random.randrange(20_000)}" for _ in range(100_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
Scanner([("1", text)])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    used = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert int(used.stdout) < 150_000
