"""Quality filtering by weak supervision. All that grows with the corpus is done in DataFrame operations.

Rules look at a document and vote for good, vote for bad or abstain. Expectation-maximisation on the counted vote
patterns (at most 3 to the number of rules, so a table of bounded size) estimates how often a rule's vote is right
on good and on bad documents, without labels. A document stays if its posterior probability of being good is at
least one half and it does not fail the base rules.

Words are runs of characters other than the six ASCII spaces. A window is three words in a row; windows are compared
by 64-bit hashes within one document, of whatever length. Every rule looks at
the whole text; the rule of common words counts different ones, which levels off with length (at sf0.1 the median is 15
in texts of 50 to 400 words and 22 in those of over 1,000), so its thresholds are counts for texts of any length.

Defined cases: null and empty texts have no words and fail the base rules; null ids and repeated rows are rows like any
other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Workspace

LEAST_WORDS, REPEATED = 50, 50
#: Frequent function words of the corpus languages.
COMMON_WORDS = (
    "the of and to in is that for it as with was on be by at this from or are "
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par sur au pas plus "
    "el y a los se del las por con no su para al lo como"
).split()
START = {"prior": 0.8, "right_on_good": 0.9, "right_on_bad": 0.7}
#: The estimation ends when no value moves by CLOSE or more in a round; ROUNDS only keeps it from going on forever.
ROUNDS, CLOSE = 10_000, 1e-9


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """The columns `more`, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(*more, F.col(id_col).cast("long").alias("doc_id"), t.alias("t"))
    df = df.withColumns({"words": F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))})
    kept = lambda pattern: F.length(F.regexp_replace("t", pattern, "")).cast("long")
    df = df.select(
        *more,
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        kept(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        kept(r"[^\p{Lu}]+").alias("n_upper"),
        kept(r"[^\p{L}]+").alias("n_letters"),
        kept(r"[^!]+").alias("n_shouts"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>](?![^\x20\x09-\x0D])", ""))).cast("long").alias("n_ends"),
        F.size(F.array_intersect(F.split(F.lower("t"), r"[\x20\x09-\x0D]+"), F.array(*[F.lit(w) for w in dict.fromkeys(COMMON_WORDS)]))).cast("long").alias("n_common"),
    )
    df = df.withColumn("hashes", F.expr("CASE WHEN n_words < 3 THEN array() ELSE transform(sequence(0, cast(n_words AS int) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END")).drop("words")
    # Equal windows become neighbours; a pair of places is packed into one number. Most texts have none and are not sorted.
    df = df.withColumn("windows", F.expr("CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN sort_array(transform(hashes, (h, i) -> struct(h, i))) ELSE array() END")).drop("hashes")
    after = "slice(windows, {}, greatest(size(windows) - 1, 0))"
    df = df.withColumn("pairs", F.expr(f"""filter(zip_with({after.format(1)}, {after.format(2)},
        (a, b) -> CASE WHEN a.h = b.h THEN shiftleft(cast(a.i AS bigint), 32) | cast(b.i AS bigint) ELSE -1L END), p -> p >= 0)""")).drop("windows")
    df = df.withColumn("places", F.expr("sort_array(array_distinct(concat(transform(pairs, p -> shiftright(p, 32)), transform(pairs, p -> p & 4294967295L))))")).drop("pairs")
    covered = "CASE WHEN size(places) = 0 THEN 0L ELSE 3L + aggregate(zip_with(slice(places, 1, size(places) - 1), slice(places, 2, size(places) - 1), (a, b) -> least(3L, b - a)), 0L, (s, x) -> s + x) END"
    return df.withColumn("n_repeat_words", F.expr(covered)).drop("places")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def rules() -> dict[str, Column]:
    """name -> vote: 1 good, 0 bad, null abstains."""
    c = F.col
    words, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))
    letters, lines = F.greatest(c("n_letters"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    return {
        "symbols": _vote(c("n_symbols") * 100 <= chars, c("n_symbols") * 20 > chars),
        "endings": _vote(c("n_ends") * 100 <= words, c("n_ends") * 10 > words),
        "lines": _vote((c("n_dup_lines") == 0) & (lines >= 3), c("n_dup_lines") * 10 > lines * 3),
        "repeats": _vote(c("n_repeat_words") * 10 <= words, c("n_repeat_words") * 10 > words * 3),
        "capitals": _vote(c("n_upper") * 5 <= letters, c("n_upper") * 2 > letters),
        "shouts": _vote(c("n_shouts") * 50 <= words, c("n_shouts") * 5 > words),
        "lengths": _vote((chars >= words * 3) & (chars <= words * 9), (chars < words * 2) | (chars > words * 14)),
        "common": _vote(c("n_common") >= 6, (c("n_common") <= 1) & (words >= LEAST_WORDS)),
        "letters": _vote(letters * 100 >= chars * 93, letters * 100 < chars * 90),
    }


def estimate(ws: Workspace, votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict:
    """Prior and, for each rule, how often it is right on good and on bad documents.

    Only the counted patterns come to the driver, a table of bounded size, so that rounds are cheap and can go on until nothing moves.
    """
    known = sorted(tuple(-1 if x is None else x for x in r) for r in votes.groupBy(*names).agg(F.count("*").alias("n")).collect())
    good, bad = np.full(len(names), START["right_on_good"]), np.full(len(names), START["right_on_bad"])
    prior = START["prior"]
    table = np.array(known, np.int64).reshape(-1, len(names) + 1)
    n, yes, no = table[:, -1].astype(float), (table[:, :-1] == 1).astype(float), (table[:, :-1] == 0).astype(float)
    for _ in range(rounds if len(known) else 0):
        odds = np.log(prior / (1 - prior)) + yes @ np.log(good / (1 - bad)) + no @ np.log((1 - good) / bad)
        p = 1 / (1 + np.exp(-odds))
        w, v = n * p, n * (1 - p)
        # Two imagined documents at the starting values keep rules that rarely vote in bounds. No rule may turn round:
        # a vote for bad is at least as likely on a bad document as on a good one.
        new_good = np.clip((w @ yes + 2 * START["right_on_good"]) / (w @ (yes + no) + 2), 0.55, 0.995)
        new_bad = np.clip((v @ no + 2 * START["right_on_bad"]) / (v @ (yes + no) + 2), 1 - new_good, 0.995)
        new_prior = min(0.99, max(0.05, w.sum() / n.sum()))
        moved = max(abs(new_prior - prior), np.abs(new_good - good).max(), np.abs(new_bad - bad).max())
        prior, good, bad = float(new_prior), new_good, new_bad
        if moved < CLOSE:
            break
    return {"prior": prior, "good": dict(zip(names, good.tolist(), strict=True)), "bad": dict(zip(names, bad.tolist(), strict=True))}


def posterior(prior: float | Column, good: dict, bad: dict) -> Column:
    """Probability that a document with these votes is good. The values may be numbers or columns."""
    at = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    odds = F.log(at(prior) / (1 - at(prior)))
    for x in good:
        odds = odds + F.when(F.col(x) == 1, F.log(at(good[x]) / (1 - at(bad[x])))).when(F.col(x) == 0, F.log((1 - at(good[x])) / at(bad[x]))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def judge(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good: one row per document, in a written table."""
    ws = Workspace(spark, "quality")
    seen = ws.table(measures(docs, id_col, text_col).withColumns(rules()), "measures")
    names = list(rules())
    fit = estimate(ws, seen, names, rounds)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    out = seen.withColumn("base_failed", failed).withColumn("p_good", posterior(fit["prior"], fit["good"], fit["bad"]))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("p_good") >= 0.5)).alias("kept"), "p_good", *names)


def kept_rows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    The rows are written with their votes, so that texts are measured once and never joined by an id that may repeat.
    """
    ws = Workspace(spark, "quality")
    names = list(rules())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text_col}`").alias("text_"))
    seen = measures(whole, "id_", "text_", ("whole",)).withColumns(rules())
    seen = ws.table(seen.select("whole", *names, "n_words", "n_repeat_words"), "votes")
    fit = estimate(ws, seen, names, rounds)
    stay = (F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= REPEATED * F.col("n_words")) & (posterior(fit["prior"], fit["good"], fit["bad"]) >= 0.5)
    return seen.where(stay).select("whole.*")
