"""Small column builders shared by all rule families."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def present(c: Column) -> Column:
    """True where the value counts as given; never null."""
    return text(c) != ""


def any_in(c: Column, words) -> Column:
    """Substring test against a word list.

    Longer lists become one alternation of quoted words: the generated code stays small enough for the
    whole-stage compiler, which a chain of ``contains`` calls per list would overflow.
    """
    words = list(words)
    if len(words) <= 2:
        return reduce(or_, [c.contains(w) for w in words])
    return c.rlike("|".join(re.sub(r"([^\w\s@-])", r"\\\1", w) for w in words))


def ends_any(c: Column, tails) -> Column:
    return c.rlike("(?:" + "|".join(re.escape(t) for t in tails) + r")$")


def cases(arms, otherwise) -> Column:
    """``arms`` is a list of (condition, value), tried in order."""
    out = None
    for cond, value in arms:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def tiers(c: Column, bands, otherwise) -> Column:
    return cases([(c >= low, label) for low, label in bands], otherwise)


def points(cond: Column, yes, no=0.0) -> Column:
    yes = yes if isinstance(yes, Column) else F.lit(float(yes))
    no = no if isinstance(no, Column) else F.lit(float(no))
    return F.when(cond, yes).otherwise(no)


def add(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, cols)


def count_true(*conds: Column) -> Column:
    return add(*[c.cast("int") for c in conds])


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def say(cond: Column, message) -> Column:
    """The message where the condition holds, null elsewhere (for ``compact``)."""
    return F.when(cond, message if isinstance(message, Column) else F.lit(message))


def lookup(c: Column, table: dict, otherwise) -> Column:
    return cases([(c == k, v) for k, v in table.items()], otherwise)


def age_days(ts: Column, as_of: str) -> Column:
    """Whole days, floored, so that it agrees with a timedelta's ``days``."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))
    return F.floor(seconds / 86400).cast("int")


def recent(ts: Column, as_of: str, days: int) -> Column:
    return ts >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    return F.when(den > 0, num * scale / den).otherwise(0.0)


def words_in(c: Column) -> Column:
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def alphabetic(c: Column) -> Column:
    return F.regexp_replace(c, "[-']", "").rlike(r"^\p{L}+$")
