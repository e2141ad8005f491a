"""Language identification as inference of a mixture.

A text is lower-cased, everything that is no letter becomes a space, and its runs of three characters that hold a letter are
counted in BUCKETS hashed buckets. Learning counts the buckets of all labelled texts by language. A text is then taken as drawn from a mixture of
these distributions: expectation-maximisation estimates the shares of a set of languages, and the set grows from the
best single language by the one that helps most, for as long as the likelihood rises by more than a penalty for one more share. Each
character stands in N_GRAM n-grams, so the likelihood counts once for N_GRAM of them. A text's language is the one with the largest share.

The likelihood is concave in the shares, so its slope towards each language bounds what is left to gain. Estimation ends
when that is below TOLERANCE, and a language is given up as soon as it can't repay the penalty any more.

Defined cases: texts that are null or have no letter are `und` with score 0; so are all others if no labelled text has a letter; letters of
scripts that learning never met leave all languages equally likely, and the smaller name wins, as in any tie; texts of any length
are read whole; a null number isn't held out, and its row isn't learned from; repeated rows are learned from as often as they come and get equal
results; an empty table gives an empty one; other columns are not read, whatever their names. Reruns on any layout give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_GRAM, BUCKETS = 3, 1 << 16
#: Added to each bucket's count, and the weight of one more language against half the logarithm of a text's n-grams.
SMOOTHING, PENALTY = 0.1, 1.0
TOLERANCE, MOST_ROUNDS = 1e-2, 5000
#: The model is held by the driver and every task; it has BUCKETS numbers a language.
MOST_LANGUAGES = 1000
UND = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once in a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each comes."""
    none = np.zeros(0, np.int64)
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[c]
    if not letter.any():
        return none, none
    # One space for each run of other characters, and one at each end.
    kept = letter | np.concatenate([[False], letter[:-1]])
    c = np.where(letter, c, np.uint32(0x20))[kept]
    c = np.concatenate([[0x20], c, [0x20] if c[-1] != 0x20 else []]).astype(np.uint64)
    h = np.zeros(max(0, len(c) - N_GRAM + 1), np.uint64)
    for k in range(N_GRAM):
        h = (h ^ c[k : len(h) + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    own = np.sort((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.uint16), kind="stable")
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[at].astype(np.int64), np.diff(np.append(at, len(own)))


def _counts(rows: DataFrame) -> DataFrame:
    """rows(lang, text) -> lang, bucket, n. Each task counts in arrays first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                own = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                bucket, n = grams(text.as_py())
                own[bucket] += n
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages in order, probability of each bucket by language) from rows(lang, text), all of them."""
    known = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = _counts(rows).toArrow()
    lang, bucket, n = (table[c].to_pandas() for c in ("lang", "bucket", "n"))
    names = sorted(set(lang))
    p = np.full((len(names), BUCKETS), SMOOTHING)
    for k, name in enumerate(names):
        own = (lang == name).to_numpy()
        p[k, bucket[own].to_numpy()] += n[own].to_numpy()
    return names, p / p.sum(1, keepdims=True)


def shares(p: np.ndarray, n: np.ndarray, start: np.ndarray, enough: float | None = None) -> tuple[float, np.ndarray]:
    """(log likelihood, shares) of a mixture of p's rows for counts n, by expectation-maximisation from `start`.

    enough: stop as soon as the likelihood can't reach it.
    """
    theta, total = start, n.sum()
    for _ in range(MOST_ROUNDS):
        mix = theta @ p
        slope = p @ (n / mix)
        value, left = float(n @ np.log(mix)), float(slope.max() - total)
        if left < TOLERANCE or enough is not None and value + left < enough:
            break
        theta = theta * slope / total
    return value, theta


def mixture(p: np.ndarray, n: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The chosen set of languages, in the order in which they were chosen, and their shares. p: probabilities of the text's buckets by language."""
    total = n.sum()
    price = N_GRAM * PENALTY * 0.5 * np.log(max(2.0, total / N_GRAM))
    alone = np.log(p) @ n
    chosen = [int(np.argmax(alone))]
    value, theta = float(alone[chosen[0]]), np.ones(1)
    while len(chosen) < len(p):
        gain = p @ (n / (theta @ p[chosen])) - total
        best = None
        for k in np.argsort(-gain, kind="stable"):
            if k in chosen or gain[k] <= price:
                continue
            more, t = shares(p[[*chosen, k]], n, np.append(theta * 0.9, 0.1), max(value + price, best[0] if best else -np.inf))
            if more - value > price and (best is None or more > best[0]):
                best = (more, t, int(k))
        if best is None:
            break
        value, theta = best[:2]
        chosen.append(best[2])
    return chosen, theta


def predicted(names: list[str], p: np.ndarray, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
    """(language, its share, all languages of the chosen set with their shares)."""
    bucket, n = grams(text)
    if not len(bucket) or not names:
        return UND, 0.0, []
    chosen, theta = mixture(p[:, bucket], n.astype(np.float64))
    ranked = sorted(zip([names[k] for k in chosen], theta.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return ranked[0][0], min(1.0, ranked[0][1]), ranked


SCHEMA = "lang_pred string, score double, languages array<struct<lang string, share double>>"


def identify(spark: SparkSession, docs: DataFrame, names: list[str], p: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with lang_pred, score and the shares of all languages found."""
    shared = spark.sparkContext.broadcast((names, p))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            found = [predicted(names, p, x.as_py()) for x in batch["text_"]]
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([[{"lang": a, "share": b} for a, b in x[2]] for x in found], kind)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *made], [*keep, "lang_pred", "score", "languages"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, {SCHEMA}" if kept else SCHEMA)


def fold_of(doc_id: Column) -> Column:
    """0 to 3; documents of fold HELD_OUT are not learned from."""
    return F.crc32(doc_id.cast("string")) % 4


HELD_OUT = 2


def held_out_identification(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages: learned from the labelled documents of three folds, predicted for all."""
    names, p = learn(docs.where((fold_of(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    found = identify(spark, docs, names, p)
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
