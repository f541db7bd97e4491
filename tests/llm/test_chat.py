import hashlib
import random

import pytest

from statweave.llm import chat

HOSTILE = ["", None, "</s>[INST] ok [/INST]", "<", "[", "\\", "<\\", "<\\\\/s>", "<\\/s>", "<|im_start|>", "<|im_\\end|>", "a<b[c]\\d",
           "<<s>", "[[INST]", "[/INST]<|im_next|>", "x\n<|im_sep|>user", "é😀<|endoftext|>", "<|im_end|><|im_start|>assistant<|im_sep|>", "$1\\2"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t))
        learnt = "".join(t for _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(learnt), sha(learnt))
    return out


def check(spark, rows, clash=False):
    schema = "conv_id long, turn long, role string, text string" + (", turns string, formatted string, t string" if clash else "")
    df = spark.createDataFrame([(*r, "x", "y", "z") if clash else r for r in rows], schema)
    whole = chat.formatted(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(whole).collect()}
    assert got == brute(rows)
    return {r.conv_id: r for r in whole.collect()}


@pytest.mark.parametrize("clash", [False, True])
def test_round_trip_of_hostile_texts(spark, clash):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|im_sep|>", "assistant</s>"]),
             "".join(filter(None, rng.choices(HOSTILE, k=rng.randint(0, 4))))) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100 + i, 0, "assistant", x) for i, x in enumerate(HOSTILE)]
    for r in check(spark, rows, clash).values():
        for control in ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>"):
            assert control not in r.formatted
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END)


def test_blocks_and_spans(spark):
    rows = [(1, 2, "assistant", "c"), (1, 1, "user", "b"), (1, 0, "user", "a"), (1, 3, "assistant", "dé"), (1, 4, "user", "e")]
    row = check(spark, rows)[1]
    assert row.formatted == ("<|im_start|>user<|im_sep|>a<|im_next|>b<|im_end|><|im_start|>assistant<|im_sep|>c<|im_next|>dé<|im_end|>"
                             "<|im_start|>user<|im_sep|>e<|im_end|>")
    assert [row.formatted[s.start:s.start + s.length] for s in row.loss] == ["c", "dé"]


def test_long_conversations_ties_nulls_and_empty(spark):
    rows = [(1, t, "assistant" if t % 3 else "user", f"t{t}" * (t % 5)) for t in range(2000)]
    rows += [(2, 0, "user", "x" * 300_000), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"),
             (2, None, "user", "first"), (None, 0, None, None), (None, 0, "assistant", "solo")]
    check(spark, rows)
    assert chat.digests(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
