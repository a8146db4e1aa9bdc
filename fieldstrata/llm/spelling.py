"""Operator 12: words one edit apart by pivotal grams, and the form each rare spelling goes back to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored, temporary

LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, LEAST, RATIO = 6, 5, 5
#: Grams of two letters; one edit touches two of them at most, so three make a prefix, and two that share no letter pivots.
GRAM, PREFIX = 2, 3
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000


def _count(edit: Callable[[int, str], str] | None, shortest: int):
    run = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = run.findall((text.as_py() or "").translate(_LOWER))
                doc = doc_id.as_py()
                if edit is None or doc is None:
                    total.update(found)
                else:
                    for word, n in Counter(found).items():
                        total[edit(doc, word)] += n
                if len(total) > COUNTED:
                    yield told()
        yield told()

    return count


def vocabulary(docs: DataFrame, edit: Callable[[int, str], str] | None = None, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of all words of ``shortest`` letters that the texts hold ``least`` times or more.

    Words are maximal runs of the letters, lower-cased for A-Z. ``edit`` (doc_id, word) gives the word to count
    instead; it is asked once a document and word, not for rows without a doc_id. Tasks count before the shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_count(edit, shortest), "word string, n long")
    return rows.where(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def pivots(places: list[tuple[int, int]], weight: list[int]) -> tuple[int, int]:
    """The two of a word's prefix grams (start, gram) that share no letter and whose weights sum to the least.

    Dynamic programming over the grams by start: the lightest gram that ends before each one starts, then the best pair.
    """
    best: tuple[int, int, int] | None = None
    lightest: list[int] = []  # lightest gram among the first i + 1
    for i, (start, _) in enumerate(places):
        j = i - 1
        while j >= 0 and places[j][0] + GRAM > start:
            j -= 1
        if j >= 0 and (best is None or weight[lightest[j]] + weight[i] < best[0]):
            best = (weight[lightest[j]] + weight[i], lightest[j], i)
        lightest.append(i if not lightest or weight[i] < weight[lightest[-1]] else lightest[-1])
    return best[1:]


def signature(word: str, rank: dict[str, int], counts: dict[str, int]) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
    """(rank of the last prefix gram, pivots, prefix grams), grams as (rank, start).

    The prefix holds the three rarest grams, and all with the same letters as the last of them.
    """
    grams = sorted((rank[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    last = grams[PREFIX - 1][0]
    first = sorted((i, g) for g, i in grams[:PREFIX])
    a, b = pivots(first, [counts[word[i : i + GRAM]] for i, _ in first])
    prefix = [g for g in grams if g[0] <= last]
    return last, [(first[a][1], first[a][0]), (first[b][1], first[b][0])], prefix


#: What one edit does to the length of a word and to the place of a gram it leaves whole.
SHIFTS = [(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)]


def _sign(counts: dict[str, int]):
    rank = {g: r for r, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last, chosen, prefix = signature(word, rank, counts)
                rows += [(word, n, last, True, g, len(word), i) for g, i in chosen]
                rows += [(word, n, last, False, g, len(word), i) for g, i in prefix]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["word", "n", "last", "pivot", "gram", "size", "place"])

    return sign


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, a_n, b, b_n), a < b, of distinct words (word, n) that differ by one inserted, deleted or replaced letter.

    Grams are ordered from rare to frequent. Of two near words that whose prefix ends first has two pivots, of which the edit
    leaves one whole; it is then among the prefix grams of the other, at a place and length that fit. So pivots
    meet prefix grams by (gram, length, place) in one join, and the edit distance decides. Gram counts are one
    number a pair of letters (8,100 at most), known to all tasks. Words are of six letters or more.
    """
    spark = words.sparkSession
    each = words.select(F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length(word) - {GRAM - 1}), i -> substr(word, i, {GRAM}))"))).alias("gram"))
    counts = {r.gram: r["count"] for r in each.groupBy("gram").count().collect()}
    signed = stored(spark, words.select("word", "n").mapInArrow(_sign(counts), "word string, n long, last int, pivot boolean, gram int, size int, place int"), "grams")
    shift = F.explode(F.array(*[F.struct(F.lit(d).alias("size"), F.lit(p).alias("place")) for d, p in SHIFTS])).alias("shift")
    asked = signed.where("pivot").select("word", "n", "last", "gram", "size", "place", shift)
    asked = asked.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"), "gram", (F.col("size") + F.col("shift.size")).alias("size"), (F.col("place") + F.col("shift.place")).alias("place"))
    held = signed.where("not pivot").select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"), "gram", "size", "place")
    asked, held = asked.alias("p"), held.alias("q")
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("gram", "size", "place")]
    met = asked.join(held, same[0] & same[1] & same[2] & (F.col("a_last") <= F.col("b_last")) & (F.levenshtein("a", "b", 1) == 1))
    first = F.col("a") < F.col("b")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return met.select(pick("a", "b", "a"), pick("a_n", "b_n", "a_n"), pick("b", "a", "b"), pick("b_n", "a_n", "b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the rows (word, form): the word that forms lead to in the end. No form leads back to its word.

    Pointers double each round: as many rounds as the longest way has binary digits.
    """
    spark = forms.sparkSession
    now = stored(spark, forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = now.join(on, F.col("root") == F.col("_w"), "left")
        step = stored(spark, step.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (distinct word of six letters or more, n).

    The form is the near word of largest n (of equal ones the first in code-point order) if that n is ``ratio`` (2 or
    more) times the word's n or more, else null; the root is the last word that forms lead to, the word itself if it has no form.
    """
    spark = words.sparkSession
    with temporary():
        words = stored(spark, words.select("word", "n"), "words")
        near = stored(spark, near_words(words), "near")
        sides = near.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
        sides = sides.unionByName(near.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
        found = sides.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"))
        strong = -F.col("best.n") >= ratio * F.col("n")
        found = stored(spark, found.select("word", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n")), "forms")
        last = roots(found.where("form is not null"))
        out = words.join(found, "word", "left").join(last, "word", "left")
        out = out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
        return stored(spark, out, "variants", keep=True)


def spelling_variants(docs: DataFrame, edit: Callable[[int, str], str] | None = None) -> DataFrame:
    """Spelling variants among the words of the texts, see ``vocabulary`` and ``variants``.

    Null and empty texts hold no words; repeated rows count each; rows without a doc_id are counted without ``edit``; other columns
    are ignored. Tables without a word give no rows.
    """
    return variants(vocabulary(docs, edit))


def dropped_letter(doc_id: int, word: str) -> str:
    """The word without its letter h % length if 199 divides h, the crc32 of ``<doc_id>:<word>``."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    return word if h % 199 else word[: (at := h % len(word))] + word[at + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), dropped_letter)
