"""Personal data in texts: generous candidates, judged by boosted trees.

*Base spans.* Four patterns (e-mail, IP address, card number, phone number), leftmost and without
overlaps per kind, with their checks; they always stay. Digit runs are found once and chained, so
that the time is linear in the text, also for texts of digits only.

*Candidates.* High-recall generators propose overlapping spans for what the patterns miss: every
window of up to six digit groups with small gaps (as phone, card and, with four groups, as
address), and words around any way of writing "at" and "dot".

*Judgement.* Per kind, gradient-boosted trees score a candidate by its format (groups, separators,
check digit, ranges) and its context (characters on both sides, log odds of the words before and
after). Isotonic calibration on held-out examples turns scores into probabilities, and a threshold
on these selects. Of overlapping candidates the likeliest stays; none may overlap a base span.

*Training.* No table labels personal data. Examples come from excerpts of the corpus: candidates
that are base spans are true, those that are not are false; and into each excerpt an item written
by rule is put, in a layout that the patterns do not know (true), or a number that is no personal
data, such as a date, price, version or serial number (false), with or without a telling word. At
most ``max_docs`` documents (lowest hashes) and ``max_examples`` examples take part; the trees are
fitted in the driver. The held-out examples are those of a quarter of the documents.

Defined cases: a NULL text is empty and has no spans; a NULL ``doc_id`` keeps its row; repeated
rows are judged alike; offsets are code points of the whole text; of equal probabilities the longer
candidate wins, then the earlier; an empty table gives an empty result. A corpus without usable
excerpts is trained on the written items alone.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from statweave.llm.trees import Calibration, Trees, boost, calibrate

KINDS = ("email", "ip", "card", "phone")
MAX_DOCS = 2_000
MAX_EXAMPLES = 60_000
#: Calibrated probability from which a candidate is redacted, and the share of true ones assumed among candidates.
THRESHOLD = 0.9
PRIOR = 0.1

_DIGITS = re.compile("[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int]


# -- base spans ----------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def addresses(text: str, runs: list[Span]) -> list[Span]:
    found, i = [], 0
    while i + 3 < len(runs):
        four = runs[i:i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            if all(_byte(text[a:b]) for a, b in four):
                found.append((four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    return found


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def cards(text: str, runs: list[Span]) -> list[Span]:
    found, i = [], 0
    while i < len(runs):
        j, digits = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            digits += runs[j][1] - runs[j][0]
        if 14 <= digits <= 19 and luhn("".join(text[a:b] for a, b in runs[i:j + 1])):
            found.append((runs[i][0], runs[j][1]))
        i = j + 1
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]


def base_spans(text: str, runs: list[Span] | None = None) -> dict[str, list[Span]]:
    runs = [m.span() for m in _DIGITS.finditer(text)] if runs is None else runs
    return {"email": emails(text), "ip": addresses(text, runs), "card": cards(text, runs), "phone": phones(text)}


# -- candidates ----------------------------------------------------------------

#: What may stand between two groups of one number.
_GAP = frozenset(" .-()/_,[] ‐‑–")
WINDOW = 6
_AT = re.compile(r"[(\[{] ?at ?[)\]}]|[@＠]| at ", re.IGNORECASE)
_FAR = re.compile(r" ?([A-Za-z0-9-]+(?:(?:\.| ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| dot )[A-Za-z0-9-]+){1,4})", re.IGNORECASE)


def candidates(text: str, runs: list[Span]) -> list[tuple[str, int, int]]:
    """Overlapping spans that may be personal data."""
    found = []
    for i, (start, _) in enumerate(runs):
        digits = 0
        for j in range(i, min(len(runs), i + WINDOW)):
            a, b = runs[j]
            if j > i and not (a - runs[j - 1][1] <= 3 and all(c in _GAP for c in text[runs[j - 1][1]:a])):
                break
            digits += b - a
            if digits > 19:
                break
            if 7 <= digits <= 15:
                lead = start
                while lead and start - lead < 2 and text[lead - 1] in "+(":
                    lead -= 1
                found.append(("phone", lead, b))
            if 13 <= digits:
                found.append(("card", start, b))
            if j - i == 3 and digits <= 12:
                found.append(("ip", start, b))
    for m in _AT.finditer(text):
        far = _FAR.match(text, m.end())
        near = m.start() - (text[m.start() - 1:m.start()] == " ")
        start = near
        while start and near - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        if far and start < near:
            found.append(("email", start, far.end()))
    return found


FEATURES = (
    "digits", "groups", "first", "last", "longest", "shortest", "length", "separators", "blank", "dot", "hyphen", "slash", "bracket",
    "other", "plus", "zero", "check", "bytes", "year", "distinct", "wide_gap", "even", "labels", "ending", "local", "worded", "spaced",
    "before", "after", "touches", "digits_before", "digits_after", "odds_before", "odds_after",
)
_WORD = re.compile(r"[^\W\d_]{2,}")


def _side(c: str) -> int:
    """What stands beside a span: nothing, space, closing or opening mark, symbol, digit, letter."""
    if not c:
        return 0
    return 1 if c.isspace() else 5 if c.isdigit() else 6 if c.isalpha() else 2 if c in ".,;:!?" else 3 if c in "()[]{}\"'<>" else 4


def words_around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The last three words before and the next two after, lower case."""
    before = _WORD.findall(text[max(0, start - 40):start].lower())[-3:]
    return before, _WORD.findall(text[end:end + 25].lower())[:2]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and neighbourhood of a candidate; the last two places are for the words' odds."""
    said = text[start:end]
    groups = _DIGITS.findall(said)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    between = _DIGITS.sub("", said)
    gaps = _DIGITS.split(said)[1:-1]
    marks = [between.count(c) for c in " .-/"]
    brackets = sum(map(between.count, "()[]{}"))
    if kind == "email":
        low, worded = said.lower(), "@" not in said
        labels = re.split(r"\.| dot |[(\[{] ?(?:dot|\.) ?[)\]}]", low)
        local, ending = len(re.split(r"@|＠|[(\[{] ?at| at ", low)[0]), len(labels[-1].strip())
    else:
        worded, labels, local, ending = False, [], 0, 0
    nums = [int(g) if len(g) < 6 else 10**6 for g in groups]
    left, right = text[start - 1:start], text[end:end + 1]
    return [
        len(digits), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), len(said), len(set(between)), *marks, brackets,
        len(between) - sum(marks) - brackets, said[:1] == "+", digits[:1] == "0", bool(digits) and len(digits) < 40 and luhn(digits),
        bool(nums) and max(nums) <= 255, any(1900 <= v <= 2099 and len(g) == 4 for v, g in zip(nums, groups, strict=True)),
        len(set(digits)), max(map(len, gaps), default=0), len(set(sizes)) == 1, len(labels), ending, local, worded, said.count(" "),
        _side(left), _side(right), left.isalnum() or right.isalnum(), sum(map(str.isdigit, text[max(0, start - 4):start])),
        sum(map(str.isdigit, text[end:end + 4])), 0.0, 0.0,
    ]


# -- written examples ----------------------------------------------------------

#: Words that tell, and words that tell of something else; written examples bear one of them half of the time.
CUES = {
    "email": ("mail", "email", "contact", "write to", "reach me"), "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "payment", "credit card", "paid with"), "phone": ("phone", "tel", "call", "mobile", "fax"),
}
OTHER_CUES = ("order", "invoice", "page", "version", "isbn", "serial", "on", "total", "price", "ref", "id", "code", "release", "at")


def written(kind: str, true: bool, rng: random.Random) -> str:
    """An item of the kind in a layout beyond the base patterns, or something that only looks like it."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9)))
    if kind == "email":
        local, host, end = rng.choice([word(), f"{word()}.{word()}", word() + number(2)]), word(), rng.choice(["com", "org", "net", "de", "co.uk", "io"])
        if true:
            at = rng.choice([" (at) ", " [at] ", " at ", " @ ", "(at)", "[at]", "＠", "{at}", " {at} "])
            dot = rng.choice([".", " dot ", " (dot) ", "[dot]", " [dot] ", "[.]"]) if at not in (" at ", "＠") else " dot " if at == " at " else "."
            return local + at + host + dot + end.replace(".", dot)
        return rng.choice([f"{word()} at {word()}.{word().title()}", f"{word()} at {word()}.", f"{word()}@{word()}", f"{word()} (at {word()})", f"{word()} at {number(2)}.{number(2)}"])
    if kind == "ip":
        parts = [str(rng.randrange(1, 255)) for _ in range(4)]
        if true:
            return rng.choice(["[.]", " . ", "(.)", "[.]"]).join(parts)
        return rng.choice([f"{number(1)}, {number(1)}, {number(1)}, {number(2)}", f"1.{number(1)}.{number(1)}", f"{number(2)}-{number(2)}-{number(2)}-{number(2)}",
                           f"{number(3)} {number(3)} {number(3)} {number(3)}", f"{number(1)}.{number(1)}.{number(1)}.{number(4)}", ".".join([*parts[:3], "9" + parts[3].zfill(3)])])
    if kind == "card":
        digits = rng.choice("3456") + number(14)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        cut = lambda sep: sep.join(digits[k:k + 4] for k in range(0, 16, 4))
        if true:
            return rng.choice([cut(rng.choice([".", "/", "  ", "_", " - "])), rng.choice([digits, digits, cut(" "), cut("-")])])
        digits = digits[:-1] + rng.choice([c for c in "0123456789" if not luhn(digits[:-1] + c)])
        return rng.choice([digits, number(13), number(18), cut("."), cut(" "), f"978-3-{number(2)}-{number(6)}-{number(1)}", cut("-"), number(20)])
    a, b, c = number(3), number(3), number(4)
    country = rng.choice(["1", "44", "49", "33"])
    if true:
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{country} {a} {b} {c}", f"+{country}/{a}/{b}{c}", f"+{country}_{a}_{b}_{c}",
                           f"0{a}/{b}{c}", f"+{country} ({a}) {b}-{c}", f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}"])
    year, month, day = rng.randrange(1950, 2060), rng.randrange(1, 13), rng.randrange(1, 29)
    return rng.choice([f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{day:02}/{month:02}/{year} 12:{number(2)}", number(8), number(10), number(7),
                       f"{number(1)},{a},{b}.{number(2)}", f"{number(2)}.{number(6)}, {number(2)}.{number(6)}", f"{number(2)} {a} {b}", f"{year}-{year + 2}", f"{number(5)}-{c}"])


def examples(text: str, seed: int) -> Iterator[tuple[str, bool, list[float], list[str], list[str]]]:
    """Labelled candidates from a text: its own, and those of written items put between its words."""
    rng = random.Random(seed)

    def judged(said: str, true: set[tuple[str, int, int]]):
        runs = [m.span() for m in _DIGITS.finditer(said)]
        known = true | {(k, *s) for k, spans in base_spans(said, runs).items() for s in spans}
        for kind, a, b in candidates(said, runs):
            yield kind, (kind, a, b) in known, features(said, kind, a, b), *words_around(said, a, b)

    blanks = [m.start() for m in re.finditer(" ", text)] or [0]
    for kind in KINDS:
        for true in (True, False):
            at = rng.choice(blanks)
            cue = rng.choice(CUES[kind] if true or rng.random() < 0.1 else OTHER_CUES) + rng.choice(["", ":", " is", " no."]) + " " if rng.random() < 0.5 else ""
            item = written(kind, true, rng)
            parts = [text[max(0, at - 80):at] + " " + cue, (kind if true else "", written(kind, true, rng))]
            # Sometimes another item stands right beside it, as in lists: the patterns then run over both.
            for side in (1, 3):
                if rng.random() < 0.25:
                    other = rng.choice([kind, rng.choice(KINDS)])
                    parts[side:side] = [(other, written(other, True, rng)), " "][::2 - side]
            parts.append(rng.choice(["", ".", ",", ""]) + " " + text[at + 1:at + 60])
            said, spans = "", set()
            for part in parts:
                if isinstance(part, tuple):
                    if part[0]:
                        spans.add((part[0], len(said), len(said) + len(part[1])))
                    part = part[1]
                said += part
            yield from judged(said, spans)
    for a in range(0, len(text), 4000):  # its own numbers, a few thousand characters at a time
        yield from judged(text[a:a + 4000], set())


# -- model ---------------------------------------------------------------------

@dataclass
class Judge:
    trees: dict[str, Trees] = field(default_factory=dict)
    calibration: dict[str, Calibration] = field(default_factory=dict)
    odds: dict[str, dict[str, float]] = field(default_factory=dict)

    def fill(self, kind: str, row: list[float], before: list[str], after: list[str]) -> list[float]:
        """Put the odds of the words around into their places."""
        known = self.odds.get(kind, {})
        row[-2] = max((known.get("<" + w, 0.0) for w in before), key=abs, default=0.0)
        row[-1] = max((known.get(">" + w, 0.0) for w in after), key=abs, default=0.0)
        return row

    def probabilities(self, kinds: list[str], rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(kinds))
        of = np.array(kinds)
        for kind, trees in self.trees.items():
            mine = np.nonzero(of == kind)[0]
            if len(mine):
                out[mine] = self.calibration[kind](trees.raw(rows[mine]))
        return out


def _odds(rows: list[tuple[bool, list[str], list[str]]], smooth: float = 4.0) -> dict[str, float]:
    """Smoothed log odds of a true candidate beside each word, against all candidates."""
    true, false = {}, {}
    for label, before, after in rows:
        side = true if label else false
        for w in {*("<" + w for w in before), *(">" + w for w in after)}:
            side[w] = side.get(w, 0) + 1
    a, b = max(1, sum(r[0] for r in rows)), max(1, sum(not r[0] for r in rows))
    return {w: log((true.get(w, 0) + smooth) / (a + smooth) * (b + smooth) / (false.get(w, 0) + smooth)) for w in true.keys() | false.keys()
            if true.get(w, 0) + false.get(w, 0) >= 5}


def fit(rows: list[tuple[str, bool, list[float], list[str], list[str], bool]], prior: float = PRIOR) -> Judge:
    """``rows``: kind, label, features, words before, words after, held out."""
    judge = Judge()
    for kind in KINDS:
        mine = [r for r in rows if r[0] == kind]
        seen, kept = [r for r in mine if not r[5]], [r for r in mine if r[5]]
        if not seen or not kept:
            continue
        judge.odds[kind] = _odds([(r[1], r[3], r[4]) for r in seen])
        x, z = (np.array([judge.fill(kind, list(r[2]), r[3], r[4]) for r in part], float) for part in (seen, kept))
        judge.trees[kind] = boost(x, np.array([r[1] for r in seen], float))
        judge.calibration[kind] = calibrate(judge.trees[kind].raw(z), np.array([r[1] for r in kept]), prior)
    return judge


_EXAMPLE = "kind string, label boolean, x array<double>, before array<string>, after array<string>, held_out boolean, turn long"


def train(docs: DataFrame, text: str = "text", max_docs: int = MAX_DOCS, max_examples: int = MAX_EXAMPLES) -> Judge:
    """Fit on excerpts of at most about ``max_docs`` documents."""
    turn = F.xxhash64(F.col(text))
    n = docs.count()
    least = int(-(2**63) + 2**64 * min(1.0, max_docs / max(n, 1)))
    some = docs.where(turn <= F.lit(min(least, 2**63 - 1))).select(F.coalesce(F.col(text), F.lit("")).alias("text"), turn.alias("turn")).distinct()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for said, seed in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = list(examples(said.as_py(), seed))
                if found:
                    kind, true, x, before, after = zip(*found, strict=True)
                    turns = [hash((seed, k)) for k in range(len(found))]
                    yield pa.RecordBatch.from_pydict({
                        "kind": pa.array(kind), "label": pa.array(list(map(bool, true))), "x": pa.array([list(map(float, r)) for r in x], pa.list_(pa.float64())),
                        "before": pa.array(before, pa.list_(pa.string())), "after": pa.array(after, pa.list_(pa.string())),
                        "held_out": pa.array([seed % 4 == 2] * len(found)), "turn": pa.array(turns, pa.int64())})

    taken = some.mapInArrow(label, _EXAMPLE).orderBy("turn", "kind", "x").limit(max_examples).toArrow().to_pylist()
    if not taken:
        taken = [dict(zip(("kind", "label", "x", "before", "after", "held_out"), (*e, seed % 4 == 2), strict=True))
                 for seed in range(400) for e in examples("", seed)]
    return fit([(r["kind"], bool(r["label"]), r["x"], r["before"], r["after"], r["held_out"]) for r in taken])


# -- detection -----------------------------------------------------------------

def _clash(span: Span, taken: list[Span]) -> bool:
    """Whether the span meets one of the sorted, disjoint spans in ``taken``."""
    at = bisect_left(taken, (span[1],))
    return at > 0 and taken[at - 1][1] > span[0]


def detect(texts: list[str], judge: Judge, threshold: float = THRESHOLD) -> list[tuple[dict[str, list[Span]], list[tuple[str, int, int]]]]:
    """Per text its base spans and the added ones; the candidates of all texts are scored together."""
    based, kinds, rows, where = [], [], [], []
    for k, text in enumerate(texts):
        runs = [m.span() for m in _DIGITS.finditer(text)]
        base = base_spans(text, runs)
        taken = _merged([s for spans in base.values() for s in spans])
        based.append((base, taken))
        for kind, a, b in candidates(text, runs):
            if not _clash((a, b), taken):
                kinds.append(kind)
                rows.append(judge.fill(kind, features(text, kind, a, b), *words_around(text, a, b)))
                where.append((k, a, b))
    p = judge.probabilities(kinds, np.array(rows, float).reshape(len(rows), len(FEATURES)))
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    held: list[list[Span]] = [[] for _ in texts]
    for i in sorted(np.nonzero(p >= threshold)[0].tolist(), key=lambda i: (where[i][0], -p[i], where[i][1] - where[i][2], where[i][1])):
        k, a, b = where[i]
        if not _clash((a, b), held[k]):
            held[k].insert(bisect_left(held[k], (a, b)), (a, b))
            added[k].append((kinds[i], a, b))
    return [(base, more) for (base, _), more in zip(based, added, strict=True)]


def _merged(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_FOUND = T.StructType([T.StructField("base", _SPAN), T.StructField("added", _SPAN)])


def found(docs: DataFrame, judge: Judge, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (all columns) with ``base`` and ``added`` spans, sorted by start, then kind as in ``KINDS``."""
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    order = {kind: k for k, kind in enumerate(KINDS)}
    listed = lambda spans: [{"kind": k, "start": a, "stop": b} for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]]))]

    @F.arrow_udf(_FOUND)
    def detected(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 64):  # a few texts at a time in Python's form
            some = [x.as_py() or "" for x in texts[at:at + 64]]
            out += [{"base": listed((k, *s) for k, spans in base.items() for s in spans), "added": listed(more)} for base, more in detect(some, shared.value, threshold)]
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        return pa.array(out, pa.struct([("base", span), ("added", span)]))

    return docs.select(F.struct("*").alias("row"), detected(F.col(text)).alias("f")).select("row", "f.base", "f.added")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])
