"""Operator 10: quality rules that vote, weighed by expectation-maximisation (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored

BLANK, SYMBOLS = r"\x20\x09-\x0D", "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Each rule votes to keep (1), to reject (0), or abstains (null): value below the first bound keeps,
#: at or above the second rejects (or the other way round where the bounds fall).
RULES = {
    "symbols_per_word": (0.10, 0.40),
    "symbol_share": (0.02, 0.08),
    "dup_line_share": (0.10, 0.50),
    "repeat_share": (0.10, 0.30),
    "word_length": (9.0, 12.0),
    "short_word_length": (3.0, 2.2),
    "upper_share": (0.15, 0.40),
    "digit_share": (0.10, 0.30),
    "mark_share": (0.20, 0.35),
}
ROUNDS, SMOOTHING = 60, 1.0


def _at(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the shares the rules use.

    Null texts count as empty; all figures are 0 there. Windows of three words are compared by 64-bit
    hashes, sorted inside the row together with their places; a text without a repeated window skips the sort.
    With ``whole`` a column ``row`` carries all columns of the input.
    """
    text = F.coalesce(text_col, F.lit(""))
    more = ["row"] if whole else []
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), *[F.struct(*docs.columns).alias(c) for c in more])
    plain = F.regexp_replace("t", f"[{BLANK}]+", "")
    hashes = F.transform(F.regexp_extract_all("t", F.lit(f"[^{BLANK}]+"), F.lit(0)), lambda w: F.xxhash64(w))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{BLANK}]"))
    d = d.select("doc_id", "t", plain.alias("p"), hashes.alias("w"), lines.alias("l"), *more)
    three = _at(_at("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.xxhash64(a, b)), F.slice("w", 3, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    d = d.select("doc_id", "t", "p", "l", *more, F.size("w").alias("n"), F.when(F.size("w") >= 3, F.slice(three, 1, F.greatest(F.size("w") - 2, F.lit(1)))).otherwise(F.array().cast("array<bigint>")).alias("g"))
    # places of windows that are found again: neighbours in the order of (hash, place)
    ordered = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size("g") > F.size(F.array_distinct("g")), ordered))
    up = _at("s", F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), lambda a, b: F.struct(a["i"].alias("a"), b["i"].alias("b"), (a["x"] == b["x"]).alias("same")))
    pairs = F.filter(up, lambda x: F.coalesce(x["same"], F.lit(False)))
    d = d.withColumn("q", F.when(F.col("s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda x: F.array(x["a"], x["b"])))))))
    gaps = _at("q", F.slice("q", 2, F.greatest(F.size("q"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    repeat = F.when(F.col("q").isNotNull(), F.aggregate(gaps, F.lit(0), lambda s, x: s + x)).otherwise(0)
    marks = F.length("p") - F.length(F.regexp_replace("p", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", ""))
    letters = F.length(F.regexp_replace("p", r"\P{L}+", ""))
    d = d.select(
        "doc_id",
        *more,
        F.col("n").cast("long").alias("n_words"),
        F.length("p").cast("long").alias("word_chars"),
        (F.length("p") - F.length(F.translate("p", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("p", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        letters.cast("long").alias("n_letters"),
        F.length(F.regexp_replace("p", r"[^0-9]+", "")).cast("long").alias("n_digits"),
        marks.cast("long").alias("n_marks"),
    )
    return d


def votes(d: DataFrame) -> list[Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    values = {
        "symbols_per_word": share("n_symbols", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "short_word_length": share("word_chars", "n_words"),
        "upper_share": share("n_upper", "n_letters"),
        "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
    }
    out = []
    for name, (keep, reject) in RULES.items():
        v = values[name]
        yes, no = (v < keep, v >= reject) if keep < reject else (v > keep, v <= reject)
        out.append(F.when(yes, 1).when(no, 0).cast("int").alias(name))
    return out


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the share of good texts, and for each rule the chances that it votes to keep a good text and a
    bad one, among the texts on which it votes. Begins with rules that seldom reject good texts and
    that pass most bad ones, as each knows one kind of fault. No labels are used.
    """
    n = len(patterns[0][0]) if patterns else len(RULES)
    prior, rates = 0.8, [(0.97, 0.7)] * n
    for _ in range(rounds):
        good = bad = 0.0
        sums = [[SMOOTHING * 0.97, SMOOTHING, SMOOTHING * 0.7, SMOOTHING] for _ in range(n)]
        for pattern, count in patterns:
            p = posterior(pattern, prior, rates)
            good, bad = good + p * count, bad + (1 - p) * count
            for s, v in zip(sums, pattern, strict=True):
                if v is not None:
                    s[0] += v * p * count
                    s[1] += p * count
                    s[2] += v * (1 - p) * count
                    s[3] += (1 - p) * count
        prior = min(max((good + 1) / (good + bad + 2), 0.01), 0.99)
        # a rule is never taken to be worse than none: keeping must speak for the text
        rates = []
        for a, b, c, d in sums:
            x, y = min(max(a / b, 0.01), 0.99), min(max(c / d, 0.01), 0.99)
            rates.append((x, y) if x > y else ((x + y) / 2,) * 2)
    return prior, rates


def posterior(pattern: tuple[int | None, ...], prior: float, rates: list[tuple[float, float]]) -> float:
    score = math.log(prior / (1 - prior))
    for v, (x, y) in zip(pattern, rates, strict=True):
        if v is not None:
            score += math.log(x / y) if v else math.log((1 - x) / (1 - y))
    return 1 / (1 + math.exp(-max(min(score, 500), -500)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict on each row: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality).

    ``base_failed``: under 50 words, or more than half of them repeated. The other rules vote or abstain;
    the counts of their vote patterns over all rows (at most 3 to the number of rules) are what the fit
    needs. A row is kept if it does not fail the base and its posterior ``quality`` is 0.5 or more.
    Null and empty texts have no words and fail. Repeated rows are judged one by one, alike.
    """
    d = base_columns(docs, id_col, text_col)
    d, quality, failed = _fitted(docs.sparkSession, d.select("*", *votes(d)))
    out = d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), quality.alias("quality"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def _fitted(spark: SparkSession, voted: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The rows with their votes, stored, and what the fit over all of them makes of a row: quality, failed."""
    d = stored(spark, voted, "quality")
    names = list(RULES)
    counted = d.where("n_words > 0").groupBy(*names).count().collect()
    prior, rates = fit(sorted(((tuple(r[n] for n in names), r["count"]) for r in counted), key=repr))
    score = F.lit(math.log(prior / (1 - prior)))
    for name, (x, y) in zip(names, rates, strict=True):
        score = score + F.when(F.col(name) == 1, math.log(x / y)).when(F.col(name) == 0, math.log((1 - x) / (1 - y))).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d, 1 / (1 + F.exp(-score)), failed


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, row by row; null and empty texts fail, repeated rows are judged alike.

    The rows are stored with their votes, so that the verdict is a filter and no text is shuffled.
    """
    d = base_columns(docs, whole=True)
    d, quality, failed = _fitted(spark, d.select("*", *votes(d)))
    return d.where(~failed & (quality >= 0.5)).select("row.*")
