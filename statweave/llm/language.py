"""Language identification by Bayesian fusion of three kinds of evidence.

*Text.* A multinomial model over hashed letter trigrams, one distribution per language and a
flat one for anything else. Evidence of neighbouring trigrams is not independent, so that the
log likelihood of a whole text counts as that of at most ``strength`` trigrams.

*Declaration.* The language that the markup (or the table) declares, through the share of each
language's documents that declare it.

*Address.* The prior of a host, smoothed towards that of its address suffix, which is smoothed
towards that of the corpus. A document's own vote is taken out of its host's counts.

Shares and priors come from one grouped aggregation of the text-only posteriors over all
documents, by (suffix, host, declaration), and its roll-ups. A document is rejected when it has
no letters, or when no language reaches ``least`` (the flat model may have won).

The trigram counts are those of all declared documents. Every declared language with any
letters in its documents is modelled, from one document on: the model holds the counts above 0
only. Counts are smoothed by half a count for each bucket, and by at most as many as the language
has trigrams: what a rare language has not seen is then half as likely as in the flat model, so
that it wins texts of its own but not those that nothing knows.

Defined cases: NULL and empty texts have no letters: they get the language of the other
evidence and are rejected; a NULL declaration is no evidence; NULL hosts and suffixes form a
group of their own; repeated rows count each; with no declared language at all nothing is
modelled, all languages are NULL and rejected; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from statweave.llm.common import durable

BUCKETS = 8192
STRENGTH = 40.0
LEAST = 0.5
#: Prior of "none of the modelled languages".
OTHER = 1e-3
#: Weight of the wider group, in documents.
SMOOTHING = 20.0
#: Hosts up to which their priors are broadcast; beyond, the join is a shuffle.
BROADCAST_HOSTS = 100_000
#: Languages up to which sums over them are columns; beyond, they are rows.
COLUMNS = 100
#: Count arrays that a task holds at a time.
HELD = 64

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigrams(text: bytes | None) -> np.ndarray:
    """Hash buckets of the letter trigrams of a text, words kept apart by one blank."""
    found = (text or b"").translate(_LETTERS).split()
    if not found:
        return np.empty(0, np.int64)
    c = np.frombuffer(b" " + b" ".join(found) + b" ", np.uint8).astype(np.int64)
    return ((c[:-2] * 961 + c[1:-1]) * 31 + c[2:]) * 2654435761 % 4294967296 // (4294967296 // BUCKETS)


@dataclass(frozen=True)
class Model:
    """Counts above 0, bucket by bucket: those of bucket i are at starts[i] to starts[i + 1]."""

    languages: tuple[str, ...]
    starts: np.ndarray
    at: np.ndarray  # numbers of the languages
    gains: np.ndarray  # log likelihood above that of an unseen bucket
    unseen: np.ndarray  # log likelihood of an unseen bucket; the last is the flat model's

    def evidence(self, text: bytes | None, strength: float = STRENGTH) -> np.ndarray | None:
        """Tempered log likelihoods, or None without any letter."""
        at = trigrams(text)
        if not len(at):
            return None
        counts = np.bincount(at, minlength=BUCKETS)
        buckets = np.flatnonzero(counts)
        sizes = self.starts[buckets + 1] - self.starts[buckets]
        ends = np.cumsum(sizes)
        held = np.arange(ends[-1]) + np.repeat(self.starts[buckets] - (ends - sizes), sizes)
        gains = np.bincount(self.at[held], self.gains[held] * np.repeat(counts[buckets], sizes), len(self.unseen))
        return (gains + self.unseen * len(at)) * min(1.0, strength / len(at))


def model_of(table: pd.DataFrame) -> Model:
    """The model of the counts ``n`` by ``lang`` and ``bucket``."""
    table = table.sort_values(["bucket", "lang"])
    languages, at = np.unique(table["lang"].to_numpy(dtype=str), return_inverse=True)
    n = table["n"].to_numpy(float)
    totals = np.bincount(at, n, len(languages))
    spread = np.minimum(0.5, totals / BUCKETS)
    unseen = np.log(spread / (totals + spread * BUCKETS))
    return Model(tuple(languages.tolist()), np.searchsorted(table["bucket"], np.arange(BUCKETS + 1)), at.astype(np.int32),
                 np.log1p(n / spread[at]), np.append(unseen, -np.log(BUCKETS)))


def _bytes(text: pa.Scalar) -> bytes | None:
    """UTF-8 of one text, taken from its batch, of which no copy is made: a batch may hold long pages."""
    return text.as_buffer().to_pybytes() if text.is_valid else None


def train(docs: DataFrame, declared: str = "lang", text: str = "text") -> Model:
    """Trigram counts of all declared documents, summed in the tasks; only the counts above 0 are collected."""
    given = docs.select(F.col(declared).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                bucket = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"lang": pa.repeat(lang, len(bucket)), "bucket": bucket, "n": counts[bucket]})
            held.clear()

        for batch in batches:
            for said_in, text_of in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang, said = said_in.as_py(), _bytes(text_of)
                if said:
                    if lang not in held and len(held) == HELD:
                        yield from told()
                    counts = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    counts += np.bincount(trigrams(said), minlength=BUCKETS)
        yield from told()

    return model_of(given.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())


def _evidence(model: Model):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((model.evidence(_bytes(x)) for x in texts), pa.list_(pa.float64()), size=len(texts))

    return score


def _let(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once, not again for each element of a lambda."""
    return F.transform(F.array(value), then)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _normalised(logs: Column) -> Column:
    """Probabilities from an array of logarithms."""
    weights = _let(logs, lambda v: _let(F.array_max(v), lambda most: F.transform(v, lambda x: F.exp(x - most))))
    return _let(weights, lambda v: _let(_total(v), lambda total: F.transform(v, lambda w: w / total)))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _summed(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """Sums of the arrays ``votes`` for each group."""
    if size <= COLUMNS:
        sums = rows.groupBy(*by).agg(*[F.sum(F.col("votes")[i]).alias(f"n{i}") for i in range(size)])
        return sums.select(*by, F.array(*[F.coalesce(F.col(f"n{i}"), F.lit(0.0)) for i in range(size)]).alias("votes"))
    sums = rows.select(*by, F.posexplode("votes").alias("i", "n")).groupBy(*by, "i").agg(F.sum("n").alias("n"))
    listed = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("all"))
    return listed.select(*by, F.col("all.n").alias("votes"))


def _priors(counts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Smoothed shares from ``counts``: (suffix, host, votes, above) and (declared, shares)."""
    if "votes" not in counts.columns:
        counts = counts.withColumn("votes", F.array(*[F.col(f"n{i}") for i in range(size)]))
    votes = F.col("votes")
    total = _summed(counts, [], size).first()["votes"] or [0.0] * size
    corpus = [(x + 1) / (sum(total) + size) for x in total]

    def smoothed(own: Column, wider: Column) -> Column:
        return _let(_total(own), lambda n: F.zip_with(own, wider, lambda x, w: (x + SMOOTHING * w) / (n + SMOOTHING)))

    suffixes = _summed(counts, ["suffix"], size).select(
        F.col("suffix").alias("suffix_of"), smoothed(votes, F.lit(corpus)).alias("above"))
    hosts = _summed(counts, ["suffix", "host"], size).join(
        suffixes, F.col("suffix").eqNullSafe(F.col("suffix_of"))).select(
        F.col("suffix").alias("of_suffix"), F.col("host").alias("of_host"), "votes", "above")
    kinds = _summed(counts.where("declared IS NOT NULL"), ["declared"], size)
    n_kinds = kinds.count()
    # Share of the language's documents that declare this, one unseen kind allowed for.
    shares = kinds.select(F.col("declared").alias("of_declared"), F.transform(
        F.arrays_zip(votes.alias("v"), F.lit(total).alias("t")),
        lambda z: F.log((z["v"] + 0.5) / (z["t"] + 0.5 * (n_kinds + 1)))).alias("said"))
    return hosts, shares


def identified(docs: DataFrame, text: str = "text", declared: Column | str = "lang", suffix: Column | str | None = None,
               host: Column | str | None = "source", model: Model | None = None, least: float = LEAST) -> DataFrame:
    """Each row as the struct ``row``, with ``language``, ``probability`` and ``accepted``."""
    as_column = lambda c: F.lit(None).cast("string") if c is None else (F.col(c) if isinstance(c, str) else c).cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), as_column(declared).alias("declared"),
                       as_column(suffix).alias("suffix"), as_column(host).alias("host"))
    model = model or train(rows, "declared", "text")
    size = len(model.languages) + 1
    if size == 1:
        return rows.select("row", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), F.lit(False).alias("accepted"))
    scored = rows.withColumn("logs", _evidence(model)("text")).drop("text")
    flat = [float(np.log((1 - OTHER) / (size - 1)))] * (size - 1) + [float(np.log(OTHER))]
    voted = scored.withColumn("vote", F.when(F.col("logs").isNotNull(), _normalised(_plus(F.col("logs"), F.lit(flat)))))
    counts = durable(_summed(voted.where("vote IS NOT NULL").withColumnRenamed("vote", "votes"), ["suffix", "host", "declared"], size))
    hosts, shares = _priors(counts, size)
    few = counts.select("suffix", "host").distinct().count() <= BROADCAST_HOSTS
    own = F.coalesce(F.col("vote"), F.array(*[F.lit(0.0)] * size))
    joined = voted.join(F.broadcast(hosts) if few else hosts, F.col("suffix").eqNullSafe(F.col("of_suffix"))
                        & F.col("host").eqNullSafe(F.col("of_host")), "left")
    # Declared values with counts: as many as the counted groups at most.
    joined = joined.join(F.broadcast(shares) if few else shares, F.col("declared") == F.col("of_declared"), "left")
    others = F.zip_with("votes", own, lambda n, x: F.greatest(n - x, F.lit(0.0)))
    prior = F.when(F.col("votes").isNotNull(), _let(others, lambda v: _let(_total(v), lambda n: F.zip_with(
        v, F.col("above"), lambda x, w: F.log((x + SMOOTHING * w) / (n + SMOOTHING)))))).otherwise(F.lit(flat))
    nothing = F.array(*[F.lit(0.0)] * size)
    sums = _plus(_plus(F.coalesce("logs", nothing), F.coalesce("said", nothing)), prior)
    fused = joined.select("row", "logs", _normalised(sums).alias("p"))
    languages = F.array(*[F.lit(x) for x in model.languages])
    known = F.slice("p", 1, size - 1)
    best = F.array_max(known)
    return fused.select(
        "row", F.get(languages, (F.array_position(known, best) - 1).cast("int")).alias("language"),
        best.alias("probability"), (F.col("logs").isNotNull() & (best >= least)).alias("accepted"))


def page_evidence(html: Column, url: Column) -> dict[str, Column]:
    """Text, declared language, address suffix and host of raw pages."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return {
        "text": bare, "declared": F.nullif(declared, F.lit("")), "host": F.nullif(host, F.lit("")),
        "suffix": F.nullif(F.substring_index(host, ".", -1), F.lit(""))}
