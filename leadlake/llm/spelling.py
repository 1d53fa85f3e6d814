"""Spelling variants: words one edit apart, by asymmetric chunks, and the form each word is a variant of."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import drop, whole_text, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What lies between words: all but a-z and the letters of Latin-1 (texts are lower-cased in A-Z before).
BETWEEN = "[^a-zÀ-ÿ]+"


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = 5) -> DataFrame:
    """(doc, run): every occurrence of a run of letters, lower-cased in A-Z, with at least ``letters`` code points.

    Null texts have no runs, a null id is the empty string; other columns are not read.
    """
    parts = F.split(F.translate(whole_text(text), UPPER, UPPER.lower()), BETWEEN)
    return docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.explode(parts).alias("run")).where(F.length("run") >= letters)


def counted(words: DataFrame, word: str | Column = "word", letters: int = 5, least: int = 3) -> DataFrame:
    """(word, n): distinct words of at least ``letters`` code points with at least ``least`` occurrences."""
    w = F.col(word) if isinstance(word, str) else word
    return words.select(w.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _piece(word: Column, start: Column, size: Column) -> Column:
    """Hash of ``size`` code points from ``start`` (from 0). A collision only costs a comparison."""
    return F.xxhash64(F.substring(word, start + 1, size))


def chunks(words: DataFrame) -> DataFrame:
    """(c, l, h, word, n): the two halves of each word, c is 0 or 1, l its length. They are disjoint, so one edit spares one."""
    l, w = F.length("word"), F.col("word")
    q = F.floor(l / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("c"), _piece(w, F.lit(0), q).alias("h")), F.struct(F.lit(1).alias("c"), _piece(w, q, l - q).alias("h")))
    return words.select("word", "n", l.alias("l"), F.explode(halves).alias("k")).select("k.c", "l", "k.h", "word", "n")


def grams(words: DataFrame) -> DataFrame:
    """(c, l, h, other, other_n): the positional grams of each word, as long as the chunks of words of its length or one less.

    A chunk that one edit spares is found where it was or one place further, so only grams there are emitted, six for each word.
    """
    m, w = F.length("word"), F.col("word")

    def at(l: Column, more: int) -> list[Column]:
        q = F.floor(l / 2).cast("int")
        places = [(0, F.lit(s), q) for s in range(more + 1)] + [(1, q + s, l - q) for s in range(more + 1)]
        return [F.struct(F.lit(c).alias("c"), l.alias("l"), _piece(w, start, size).alias("h")) for c, start, size in places]

    # Equal grams at both places count once.
    keys = F.array_distinct(F.array(*at(m, 0), *at(m - 1, 1)))
    return words.select(w.alias("other"), F.col("n").alias("other_n"), F.explode(keys).alias("k")).select("k.c", "k.l", "k.h", "other", "other_n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways: all pairs of ``words`` (word, n) that differ by exactly one code point put in, left
    out or replaced.

    The shorter word of a pair gives the chunks (of two of equal length the smaller one), the other the grams; they meet under
    (chunk, length, gram) and every meeting is verified. A pair that meets under both chunks belongs to the first one.
    """
    q = F.floor(F.col("l") / 2).cast("int")
    head, longer = F.substring("word", F.lit(1), q), F.length("other") > F.col("l")
    by_first = (F.substring("other", F.lit(1), q) == head) | (longer & (F.substring("other", F.lit(2), q) == head))
    met = chunks(words).join(grams(words), ["c", "l", "h"])
    met = met.where((longer | (F.col("word") < F.col("other"))) & ((F.col("c") == 0) | ~by_first) & (F.levenshtein("word", "other", 1) == 1))
    sides = lambda a, an, b, bn: F.struct(F.col(a).alias("word"), F.col(an).alias("n"), F.col(b).alias("near"), F.col(bn).alias("near_n"))
    return met.select(F.explode(F.array(sides("word", "n", "other", "other_n"), sides("other", "other_n", "word", "n"))).alias("e")).select("e.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of ``forms`` (word, form): where following the forms ends. Each round doubles the steps taken.

    Forms must have no circle; here each form is more frequent than its word. The driver sees one count a round.
    """
    spark = forms.sparkSession
    now, path = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then, next_path = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(spark, path)
        now, path = then.drop("moved"), next_path
        if not then.where("moved").limit(1).count():
            return now


def grouped(words: DataFrame, ratio: int = 2) -> DataFrame:
    """One row for each row of ``words`` (word, n): word, form, root, n, n_near, form_n.

    A word's form is its near word of the largest n, of several the first in code-point order, if that n is ``ratio`` times the
    word's own or more, else null. root is where the forms lead, the word itself if it has none; n_near counts its near words.
    ``words`` has each word once; an empty table gives no rows, and very long words are compared whole.
    """
    # Read by both sides of the join and again below: counted once, kept in the shared folder.
    words = written(words)[0]
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left").withColumn("fits", -F.col("best.minus") >= ratio * F.col("n"))
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("best.near")).alias("form"), F.when(F.col("fits"), -F.col("best.minus")).alias("form_n")))[0]
    ends = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
