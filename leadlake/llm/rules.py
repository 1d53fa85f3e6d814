"""Quality rules as a bitmask ledger: every rule once per text, policies and ablations by bits."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import free_name, whole_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Rule -> when it fails, over the measurements. A rule's bit is its place in this list; new rules go to the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("capitals", "2 * n_capital_words > n_words"),
]
#: Policy version -> the rules it applies.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "repeated_lines"],
    "v2": [name for name, _ in RULES],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capital_words"]
BLANK = " \t\n\v\f\r"
CAPITALS = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0Da-z]*[A-Z][^\x20\x09-\x0Da-z]*[A-Z][^\x20\x09-\x0Da-z]*(?![^\x20\x09-\x0D])")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, the first one included; ``window`` is a power of two.

    Windows get numbers that are equal when the windows are: words first, then pairs of numbers 1, 2, 4 words apart.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    if len(numbers) == n:
        return 0
    step, most = 1, len(numbers)
    while step < window:
        pairs = at[:-step] * most + at[step:]
        seen, at, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        step *= 2
        most = len(seen)
        if most == len(at):  # no window of this width occurs twice, so no wider one does
            return 0
    starts = counts[at] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: len(starts)] += starts
    edge[window : window + len(starts)] -= starts
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: at 0x20 and 0x09-0x0D only
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANK)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(CAPITALS.findall(text)),
    )


def _measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=MEASURES, dtype="int64")


def measures(text: Column) -> Column:
    """Text -> struct of measurements. Not pure to the planner, so that it is evaluated once however often it is used."""
    return F.pandas_udf(_measures, ", ".join(f"{m} long" for m in MEASURES)).asNondeterministic()(text)


def failures() -> Column:
    """The ledger: bit i is set if rule i fails; reads the measurement columns."""
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(name) for name in POLICIES[policy])


def passes(policy: str, failed: str | Column = "failed") -> Column:
    """Whether a ledger row passes a policy; no text is read again."""
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(mask(policy))) == 0


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str | Column = "text") -> DataFrame:
    """One row for each row of ``docs``: ``keep``, the measurements, failed (bits of RULES).

    Words are runs outside 0x20 and 0x09-0x0D of the whole text. Null and empty texts have no words and fail ``few_words``;
    repeated rows are measured each; an empty table gives no rows; other columns of ``docs`` are not read. One narrow stage.
    """
    got = docs.select(*keep, measures(whole_text(text)).alias("_m"))
    return got.select(*keep, *(F.col(f"_m.{m}").alias(m) for m in MEASURES)).withColumn("failed", failures())


def judged(docs: DataFrame, policy: str = "v2", keep: tuple[str, ...] = ("doc_id",), text: str | Column = "text") -> DataFrame:
    """The ledger with base_failed (policy ``base``) and kept (``policy`` on top of it)."""
    rows = ledger(docs, keep, text)
    return rows.withColumn("base_failed", ~passes("base")).withColumn("kept", passes("base") & passes(policy))


def only_passing(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were."""
    m = free_name(docs, "_measures")
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(re.sub(r"\b([a-z]\w+)\b", rf"{m}.\1", fails)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return docs.withColumn(m, measures(whole_text(text))).where(passes("base", bits) & passes(policy, bits)).drop(m)


def ablations(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """What each rule of a policy decides, from the ledger alone: rule, n_failed, n_only (rows no other rule of the policy rejects).

    One aggregation over bits; ``n_only`` is what the policy would keep without the rule.
    """
    own = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    names = [name for name, _ in RULES]
    sums = []
    for name in POLICIES[policy]:
        bit = 1 << names.index(name)
        sums += [F.count_if(own.bitwiseAND(F.lit(bit)) != 0).alias(f"failed_{name}"), F.count_if(own == bit).alias(f"only_{name}")]
    one = rows.agg(*sums)
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"failed_{n}").alias("n_failed"), F.col(f"only_{n}").alias("n_only")) for n in POLICIES[policy]))).alias("r")).select("r.*")
