"""Duplicate detection and similarity search (ER-*).

Duplicate groups follow the sequential scan: in id order, a lead not yet claimed becomes a leader and claims every
later unclaimed lead whose pair score reaches the threshold. Here:

* leads with the same compared fields collapse to one profile, so a mass of copies is one row;
* without the e-mail term a pair scores at most .60, so e-mails must be equal or of a rounded ratio above .9; without equal
  phones at most .85 is left, so between .75 and .85 the names must be near as well. Only leads of such a scope meet (phone,
  name or pair of near names); below .75 the scope is the tenant, down to a floor below which the call is refused;
* the leads of a scope meet in tiles of bounded size. Each carries lengths and a few bits for the characters of its texts, so
  that nearly all pairs are settled by arithmetic on numbers where they meet; only ids of pairs that reach the threshold leave
  the task. Scopes too large for that are first divided by an exact partition index for the edit distance of e-mails;
* where pairs are many the scan goes by ranges of ids, the lowest first: its leaders claim what they reach among the later ones,
  and what is claimed is met by nobody any more. Within a range the pairs are settled by rounds over the edges.

Every step is written down and the loops run to their fix points.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import match_phone
from ..functions.exprs import compact, say
from ..functions.rules import PAIR_WEIGHTS
from ..functions.similarity import indel_ratio, ratio
from ..session import cut_lineage, drop, spread, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIELDS = ["email", "name", "phone", "linkedin", "company", "title"]
FLOOR = 0.61


def _norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^\s+|\s+$", "")


def profiles(leads: DataFrame, tenant: str | None = None) -> DataFrame:
    """Compared fields, normalised; null counts as ''. ``tenant`` names a column whose values are never paired across."""
    owner = F.coalesce(F.col(tenant).cast("string"), F.lit("")) if tenant else F.lit("")
    name = F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit("")))
    return leads.select("id", owner.alias("tenant"), _norm(F.col("email")).alias("email"), _norm(name).alias("name"), match_phone(F.col("phone")).alias("phone"),
                        _norm(F.col("linkedin_url")).alias("linkedin"), _norm(F.col("company.name")).alias("company"), _norm(F.col("title")).alias("title"))


def _pair(f: str) -> tuple:
    return F.col(f"a.{f}"), F.col(f"b.{f}")


def _both(f: str) -> Column:
    a, b = _pair(f)
    return (a != "") & (b != "")


def _bound(f: str, edits: bool = False) -> Column:
    """Upper bound of a rounded text ratio from the lengths alone or, with ``edits``, from the edit distance, which bounds
    insertions and deletions from below."""
    a, b = _pair(f)
    la, lb = F.length(a), F.length(b)
    apart = F.levenshtein(a, b) if edits else F.abs(la - lb)
    return F.when(~_both(f), 0.0).when(a == b, 1.0).otherwise(F.least(F.lit(1.0), 1 - apart / (la + lb) + 0.005))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """ER-1 over rows with structs ``a`` and ``b``: field scores, total, matching fields and confidence."""
    k = PAIR_WEIGHTS

    def fuzzy(f):
        a, b = _pair(f)
        ask = _both(f) & (a != b)
        return F.when(~_both(f), 0.0).when(a == b, 1.0).otherwise(F.coalesce(ratio(F.when(ask, a), F.when(ask, b)) / 100.0, F.lit(0.0)))

    pa, pb = _pair("phone")
    s = pairs.withColumns({f"s_{f}": fuzzy(f) for f in FIELDS if f != "phone"})
    s = s.withColumns({"s_email": F.when(F.col("s_email") > 0.9, F.col("s_email")).otherwise(0.0), "s_phone": F.when(_both("phone") & (pa == pb), 1.0).otherwise(0.0)})
    total = F.lit(0.0)
    for f, x in k.items():
        total = total + F.col(f"s_{f}") * x
    given = sum((F.when(F.col(f"s_{f}") > 0, 1).otherwise(0) for f in FIELDS), F.lit(0))
    return s.withColumn("score", total).withColumns({
        "confidence": F.least(F.lit(0.95), given / 6.0 * F.col("score")),
        "matching_fields": compact(
            F.when(F.col("s_email") == 1.0, "email").when(F.col("s_email") > 0, "email_similar"), say(F.col("s_name") > 0.8, "name"), say(F.col("s_phone") > 0, "phone"),
            say(_both("linkedin") & (F.col("a.linkedin") == F.col("b.linkedin")), "linkedin"), say(F.col("s_company") > 0.8, "company"), say(F.col("s_title") > 0.7, "title"))})


def self_score() -> Column:
    """Pair score of two copies: the weight of the fields that are given, summed in the scorer's order."""
    total = F.lit(0.0)
    for f, x in PAIR_WEIGHTS.items():
        total = total + F.when(F.col(f) != "", 1.0).otherwise(0.0) * x
    return total


#: Rounded ratios: a sum of insertions and deletions above this share of both lengths rules an e-mail pair out.
EMAIL_CUT = 0.095
#: Up to so many distinct values of a scope are compared with each other - about as many comparisons as a value has probes -
#: more of them go through the partition index.
SMALL_SCOPE = 256
#: Longer values share a key per length band instead of being cut.
LONGEST_CUT = 64


def _start(i: Column, l: Column, pieces: Column) -> Column:
    """Where segment ``i`` of ``pieces`` even ones of a text of length ``l`` starts; the last ones are one longer."""
    return i * F.floor(l / pieces) + F.greatest(F.lit(0), i - (pieces - l % pieces))


def _size(i: Column, l: Column, pieces: Column) -> Column:
    return F.floor(l / pieces) + (i >= pieces - l % pieces).cast("int")


def _key(*parts: Column) -> Column:
    return F.concat_ws("\u0001", *[c.cast("string") for c in parts])


def _probe_starts(p: Column, size: Column, l: Column, edits: Column, longer: Column) -> Column:
    """Where a segment that started at ``p`` can start in a text of length ``l``, ``longer`` than the one it is from."""
    low = F.greatest(F.lit(0).cast("long"), p - F.floor((edits - longer) / 2))
    high = F.least((l - size).cast("long"), p + F.floor((edits + longer) / 2))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))


def _segments(rows: DataFrame, edits: Column, name: list[Column], text: str) -> DataFrame:
    """(key, scope, value): each ``text`` cut into e + 1 segments for each e of the array ``edits``, if it is long enough."""
    l, e, i = F.length(text), F.col("e"), F.col("i")
    cuts = rows.withColumn("e", F.explode(F.filter(edits, lambda x: (x >= 0) & (x < l)))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), e)))
    return cuts.select(_key(*name, l, e, i, F.substring(text, (_start(i, l, e + 1) + 1).cast("int"), _size(i, l, e + 1).cast("int"))).alias("key"), "scope", "value")


def _probes(rows: DataFrame, name: list[Column], text: str) -> DataFrame:
    """(key, scope, value): where the segments of partners could be in each ``text``; ``rows`` has a row for each number of edits
    ``e`` and each length ``longer`` by which the text may be longer than its partner's.
    """
    l, e, i = F.length(text), F.col("e"), F.col("i")
    met = rows.withColumn("of", l - F.col("longer")).where("e >= 0 AND e < of AND abs(longer) <= e").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), e)))
    met = met.withColumns({"p": _start(i, F.col("of"), e + 1), "g": _size(i, F.col("of"), e + 1)})
    met = met.withColumn("at", F.explode(_probe_starts(F.col("p"), F.col("g"), l, e, F.col("longer"))))
    return met.select(_key(*name, F.col("of"), e, i, F.substring(text, (F.col("at") + 1).cast("int"), F.col("g").cast("int"))).alias("key"), "scope", "value")


def partition_keys(values: DataFrame, cut: float, split: bool) -> tuple[DataFrame, DataFrame]:
    """(key, scope, value) of segments and of probes, so that two values of a scope within floor(cut * both lengths) insertions
    and deletions meet: one by a segment, the other by a probe.

    A value with e edits to spare is cut into e + 1 segments, one of which survives as a substring, moved by no more than the
    edits; segments carry length, edits and number in their key and probes look only where they can be.

    With ``split`` values are addresses, whose domains would make the same segments of all. Of two with one @ each the signs
    are taken to correspond: with the same domain the local parts take all edits (d), with two domains one edit less (x), and
    only local parts are cut. Addresses with no @ or more are cut whole, and all probe for them (o).
    """
    f = 2 * cut / (1 - cut)
    n, zero = F.col("n"), F.lit(0).cast("long")
    rows = values.select("scope", "value", F.length("value").alias("n"))
    head, tail = (F.split_part("value", F.lit("@"), F.lit(1)), F.regexp_replace("value", "^[^@]*", "")) if split else (F.col("value"), F.lit(""))
    # The shorter of two near values bounds the other's length.
    rows = rows.withColumns({"head": head, "tail": tail, "r": F.floor(n * f), "one": F.lit(True) if not split else F.length(F.translate("value", "@", "")) == n - 1})
    short, r = rows.where(n <= LONGEST_CUT), F.col("r")
    plain = short.where("one")
    more = F.sequence(zero, r)
    edits = lambda deltas, sign, spared: F.array_distinct(F.transform(deltas, lambda d: F.floor((2 * n + sign * d) * cut) - spared))
    name = [F.lit("d"), F.col("scope"), F.col("tail")]
    own = [_segments(plain, edits(more, 1, 0), name, "head")]
    probes = [_probes(plain.withColumn("longer", F.explode(more)).withColumn("e", F.floor((2 * n - F.col("longer")) * cut)), name, "head")]
    rough = n > LONGEST_CUT / (1 + f) - 1
    if split:
        name = [F.lit("x"), F.col("scope")]
        own.append(_segments(plain, edits(more, 1, 1), name, "head"))
        spared = plain.withColumn("e", F.explode(edits(more, -1, 1))).where("e >= 0")
        probes.append(_probes(spared.withColumn("longer", F.explode(F.sequence(-F.col("e"), F.col("e")))), name, "head"))
        odd, either, name = short.where("NOT one"), F.sequence(-r, r), [F.lit("o"), F.col("scope")]
        own.append(_segments(odd, edits(either, 1, 0), name, "value"))
        met = short.join(odd.select("scope").distinct(), "scope", "left_semi").withColumn("longer", F.explode(either))
        probes.append(_probes(met.withColumn("e", F.floor((2 * n - F.col("longer")) * cut)), name, "value"))
        rough = rough | (F.length("head") <= 2 * r)
    # What cannot be cut: long values, and local parts no longer than the edits, with all that such a value could be near.
    band = F.floor(F.log(n) / F.log(F.lit(1.04 + f)))
    rest = rows.where(rough).select(F.explode(F.array(_key(F.lit("b"), F.col("scope"), band), _key(F.lit("b"), F.col("scope"), band + 1))).alias("key"), "scope", "value")
    return tuple(reduce(DataFrame.unionByName, [*parts, rest]).distinct() for parts in (own, probes))


def near_values(values: DataFrame, cut: float, split: bool) -> DataFrame:
    """(scope, a, b), a < b: the pairs of ``values`` (scope, value), each given once, whose edit distance is at most
    floor(cut * both lengths). A scope of up to SMALL_SCOPE values is compared throughout, a larger one by :func:`partition_keys`.
    """
    sizes = values.groupBy("scope").agg(F.count("*").alias("of")).where("of > 1")
    sized = cut_lineage(values.join(sizes, "scope"))
    few, many = sized.where(F.col("of") <= SMALL_SCOPE), sized.where(F.col("of") > SMALL_SCOPE)
    reach = F.floor((F.length("a") + F.length("b")) * cut)
    near = (F.abs(F.length("a") - F.length("b")) <= reach) & (F.levenshtein("a", "b") <= reach)
    pairs = few.select("scope", F.col("value").alias("a")).join(few.select("scope", F.col("value").alias("b")), "scope").where((F.col("a") < F.col("b")) & near)
    if many.isEmpty():
        return pairs
    own, probes = partition_keys(many.select("scope", "value"), cut, split)
    met = own.select("key", "scope", F.col("value").alias("x")).join(probes.select("key", F.col("value").alias("y")), "key").where("x <> y")
    met = met.select("scope", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where(near).distinct()
    return pairs.unionByName(met)


def _given(p: DataFrame, loss: float) -> DataFrame:
    """Leads that have every field whose whole weight is more than a pair may lose."""
    for f in FIELDS:
        if f != "phone" and PAIR_WEIGHTS[f] > loss + 1e-9:
            p = p.where(F.col(f) != "")
    return p


def _scopes(p: DataFrame, threshold: float) -> DataFrame:
    """``p`` with the columns scope and phoned: within which leads a partner can be for the pair to reach ``threshold``, and
    whether all of the scope share their phone.

    Without equal phones at most .85 - threshold may be lost on the rest. If that is nothing, all other texts are equal. If it is
    less than .1, the names are given and of a rounded ratio of 1 - loss / .25 or more: such pairs share a name or a pair of near
    names. If it is more, the tenant is all they share.
    """
    def scoped(rows, *key):
        return rows.withColumns({"scope": _key(*key), "phoned": F.lit(key[0] is PHONED)})

    PHONED, tenant = F.lit("p"), F.col("tenant")
    keys = [scoped(_given(p.where("phone <> ''"), 1 - threshold), PHONED, tenant, F.col("phone"))]
    loss = 1 - PAIR_WEIGHTS["phone"] - threshold
    if loss <= 1e-9:
        # A rounded ratio of 100 means equality below 200 characters in total; longer texts share one key.
        texts = [F.when(F.length(f) >= 99, F.lit("*")).otherwise(F.col(f)) for f in FIELDS if f != "phone"]
        keys.append(scoped(_given(p, 0.0), F.lit("a"), tenant, *texts))
    elif loss < 0.1:
        named = _given(p.where("name <> ''"), loss)
        keys.append(scoped(named, F.lit("n"), tenant, F.col("name")))
        # A ratio rounds up by at most half a percent.
        near = near_values(named.select(F.col("tenant").alias("scope"), F.col("name").alias("value")).distinct(), loss / PAIR_WEIGHTS["name"] + 0.005 + 1e-9, False)
        near = cut_lineage(near.select(F.col("scope").alias("tenant"), "a", "b", F.explode(F.array("a", "b")).alias("name")))
        keys.append(scoped(named.join(near, ["tenant", "name"]), F.lit("m"), tenant, F.col("a"), F.col("b")).drop("a", "b"))
    else:
        keys.append(scoped(_given(p, loss), F.lit("t"), tenant))
    return reduce(DataFrame.unionByName, keys)


#: Leads of a scope that meet throughout, at some 20 ns a pair; more of them meet by equal and by near e-mails.
LARGE_SCOPE = 1 << 18


def blocks(p: DataFrame, threshold: float) -> DataFrame:
    """``p`` once for each of its blocks, with the columns key and phoned; keys of a single member are dropped. Any two that reach
    ``threshold`` share a key, and with equal phones one with ``phoned``. Keys are hashes: two that collide only propose more pairs.
    """
    if threshold < FLOOR:
        raise ValueError(f"thresholds below {FLOOR} have no lossless e-mail block")
    scoped = _scopes(p.where("email <> ''"), threshold)
    sizes = cut_lineage(scoped.groupBy("scope").agg(F.count("*").alias("n")).where("n > 1"))
    members = scoped.join(sizes.where(F.col("n") <= LARGE_SCOPE).select("scope"), "scope", "left_semi").withColumn("key", F.xxhash64("scope")).drop("scope")
    large = sizes.where(F.col("n") > LARGE_SCOPE).select("scope")
    if large.isEmpty():
        return members
    wide = scoped.join(large, "scope", "left_semi")
    equal = wide.withColumn("key", F.xxhash64(_key(F.lit("e"), F.col("scope"), F.col("email")))).drop("scope")
    near = near_values(wide.select("scope", F.col("email").alias("value")).distinct(), EMAIL_CUT, True)
    near = near.select("scope", F.xxhash64(_key(F.lit("s"), F.col("scope"), F.col("a"), F.col("b"))).alias("key"), F.explode(F.array("a", "b")).alias("email"))
    return members.unionByName(equal).unionByName(wide.join(near, ["scope", "email"]).drop("scope"))


#: Texts whose characters are counted in a signature: ten digits up to three of each, 17 groups of other characters up to two.
SIGNED = ["email", "name", "linkedin"]
CAPS = np.array([3] * 10 + [2] * 17, dtype=np.uint64)
STARTS = np.concatenate([[0], np.cumsum(CAPS)[:-1]]).astype(np.uint64)


def _signatures(texts: pd.Series) -> pd.Series:
    """A bit for each of the first few characters of a kind, so that two texts are at least as many insertions and deletions
    apart as their bits differ."""
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    kind = np.where((chars >= 48) & (chars < 58), chars - 48, 10 + chars % 17)
    counts = np.bincount(np.repeat(np.arange(len(size)), size) * len(CAPS) + kind, minlength=len(size) * len(CAPS)).reshape(len(size), len(CAPS))
    bits = ((np.uint64(1) << np.minimum(counts.astype(np.uint64), CAPS)) - np.uint64(1)) << STARTS
    return pd.Series(np.bitwise_or.reduce(bits, axis=1).view(np.int64))


def with_signatures(p: DataFrame) -> DataFrame:
    """``p`` with the signatures of its longer texts."""
    signature = F.pandas_udf(_signatures, T.LongType())
    return p.withColumns({f"s_{f}": signature(f) for f in SIGNED})


#: Members of a tile, pairs that a task compares and that are compared at once, and text ratios that a task keeps.
TILE, TASK_PAIRS, SLAB, KEPT_RATIOS = 8192, 20_000_000, 1 << 19, 1 << 20
TEXTS = [f for f in FIELDS if f != "phone"]


def _candidates(rows: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, apart: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one of ``left`` and one of ``right``, that can reach ``threshold`` by lengths and signatures alone; with
    ``apart`` the two sides have no row in common and either id may be the lower one."""
    ids, n, sign, most = rows["id"], rows["n_email"], rows["s_email"], int(EMAIL_CUT * 1000)
    found = []
    for at in range(0, len(left), step := max(1, SLAB // len(right))):
        part = left[at:at + step]
        gap = np.maximum(np.bitwise_count(sign[part][:, None] ^ sign[right][None, :]), np.abs(n[part][:, None] - n[right][None, :]))
        met = gap * 1000 <= (n[part][:, None] + n[right][None, :]) * most
        met &= (ids[part][:, None] != ids[right][None, :]) if apart else (ids[part][:, None] < ids[right][None, :])
        i, j = np.nonzero(met)
        if not len(i):
            continue
        i, j = part[i], right[j]
        alike = (rows["phone"][i] == rows["phone"][j]) & (rows["phone"][i] != "")
        # Pairs with equal phones meet under their phone.
        keep = alike | ~rows["phoned"][i]
        keep &= rows["phoned"][i] | ~alike
        top = np.where(alike, PAIR_WEIGHTS["phone"], 0.0)
        for f in TEXTS:
            x, y = rows[f"n_{f}"][i], rows[f"n_{f}"][j]
            gap = np.abs(x - y)
            if f in SIGNED:
                gap = np.maximum(gap, np.bitwise_count(rows[f"s_{f}"][i] ^ rows[f"s_{f}"][j]))
            top += np.where((x > 0) & (y > 0), np.minimum(1.0, 1.005 - gap / np.maximum(x + y, 1)), 0.0) * PAIR_WEIGHTS[f]
        keep &= top >= threshold - 1e-9
        found.append((i[keep], j[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))


def _pair_score(rows: dict[str, np.ndarray], i: int, j: int, seen: dict, threshold: float) -> float:
    """The score of :func:`score_pairs`, or 0 as soon as the pair cannot reach ``threshold``."""
    total, left = 0.0, 1.0
    for f, weight in PAIR_WEIGHTS.items():
        x, y = rows[f][i], rows[f][j]
        if not x or not y:
            s = 0.0
        elif x == y:
            s = 1.0
        elif f == "phone":
            s = 0.0
        else:
            s = seen.get((x, y))
            if s is None:
                s = seen[x, y] = indel_ratio(x, y) / 100.0
            if f == "email" and s <= 0.9:
                s = 0.0
        total += s * weight
        left -= weight
        if total + left < threshold - 1e-9:
            return 0.0
    return total


def _tile_pairs(threshold: float):
    """(leader, id) of the pairs of each tile (key, ti, tj) that reach ``threshold``; the rows of a tile follow each other. A row
    is on the left (side 0), on the right (1) or, where a tile meets itself, on both (2)."""
    def pairs(rows: dict[str, np.ndarray], seen: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        side = rows["side"]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return []
        i, j = _candidates(rows, left, right, bool(rows["apart"][0]), threshold)
        ok = np.fromiter((_pair_score(rows, a, b, seen, threshold) >= threshold for a, b in zip(i.tolist(), j.tolist())), dtype=bool, count=len(i))
        x, y = rows["id"][i[ok]], rows["id"][j[ok]]
        if len(seen) > KEPT_RATIOS:
            seen.clear()
        return [(np.minimum(x, y), np.maximum(x, y))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rest = {}, []
        for pdf in itertools.chain(batches, [None]):
            out = []
            if pdf is not None and not len(pdf):
                continue
            held = pd.concat(rest, ignore_index=True) if rest and (pdf is None or not _same_tile(rest[-1], pdf)) else None
            if pdf is not None:
                at = pdf[["key", "ti", "tj"]].to_numpy()
                starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
                if held is not None or not rest:
                    whole, rest = starts[:-1], [pdf.iloc[starts[-2]:]]
                elif len(starts) == 2:
                    rest.append(pdf)
                    continue
                else:
                    # The first rows end the tile that is held.
                    held = pd.concat([*rest, pdf.iloc[:starts[1]]], ignore_index=True)
                    whole, rest = starts[1:-1], [pdf.iloc[starts[-2]:]]
                tiles = [(a, b) for a, b in zip(whole, whole[1:]) if b - a > 1]
                if tiles:
                    rows = _columns(pdf)
                    for a, b in tiles:
                        out += pairs({c: v[a:b] for c, v in rows.items()}, seen)
            if held is not None and len(held) > 1:
                out += pairs(_columns(held), seen)
            if out:
                yield pd.DataFrame({"leader": np.concatenate([x for x, _ in out]), "id": np.concatenate([y for _, y in out])})

    return run


def _same_tile(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return all(a[c].iloc[-1] == b[c].iloc[0] for c in ("key", "ti", "tj"))


def _columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """The columns of a tile and the lengths of its texts."""
    # numpy counts the bits of absolute values.
    rows = {c: pdf[c].to_numpy().view(np.uint64) if c.startswith("s_") else pdf[c].to_numpy() for c in pdf.columns}
    return rows | {f"n_{f}": np.fromiter(map(len, rows[f]), dtype=np.int32, count=len(pdf)) for f in TEXTS}


def _tiled(members: DataFrame, name: str) -> DataFrame:
    """``members`` with the number of their tile in their block, as column ``name``, and of how many, as ``name`` + "s"."""
    many = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("key", F.ceil(F.col("n") / TILE).cast("int").alias(f"{name}s"))
    # At most one row for each TILE members.
    out = members.join(F.broadcast(many), "key", "left").withColumn(f"{name}s", F.coalesce(f"{name}s", F.lit(1)))
    return out.withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.col(f"{name}s")).cast("int"))


def _met(rows: DataFrame, pairs: float, threshold: float) -> DataFrame:
    """(leader, id) of the rows that meet in a tile (key, ti, tj) and reach ``threshold``."""
    at = ["key", "ti", "tj"]
    tasks = int(min(max(pairs / TASK_PAIRS, rows.sparkSession.sparkContext.defaultParallelism), 4096))
    dealt = rows.select(*at, "side", "apart", "phoned", "id", *FIELDS, *[f"s_{f}" for f in SIGNED]).repartition(tasks, *at).sortWithinPartitions(*at)
    return dealt.mapInPandas(_tile_pairs(threshold), "leader long, id long")


def _pairs_of(members: DataFrame) -> float:
    """Pairs of members that meet in a block."""
    size = members.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum(F.expr("CAST(n AS DOUBLE) * (n - 1) / 2")).alias("pairs")).first()
    return size.pairs or 0.0


def _pairs_among(members: DataFrame, threshold: float) -> DataFrame:
    """(leader, id) of the members of a block that reach ``threshold`` with each other."""
    # Each tile meets itself and the others.
    rows = _tiled(members, "t").withColumn("u", F.explode(F.sequence(F.lit(0), F.col("ts") - 1)))
    side = F.when(F.col("t") == F.col("u"), 2).when(F.col("t") < F.col("u"), 0).otherwise(1)
    rows = rows.withColumns({"ti": F.least("t", "u"), "tj": F.greatest("t", "u"), "side": side, "apart": F.col("t") != F.col("u")})
    return _met(rows, _pairs_of(members), threshold)


def _pairs_between(leaders: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """(leader, id) of the members of a block that reach ``threshold``, one of ``leaders`` and a later one of ``others``."""
    counts = [side.groupBy("key").agg(F.count("*").alias(n)) for side, n in ((leaders, "n"), (others, "m"))]
    pairs = counts[0].join(counts[1], "key").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
    a, b = _tiled(leaders, "t"), _tiled(others, "u")
    counted = lambda side, n: F.broadcast(side.where(f"{n}s > 1").select("key", f"{n}s").distinct())
    # A few rows as well: blocks of several tiles.
    left = a.join(counted(b, "u"), "key", "left").withColumn("us", F.coalesce("us", F.lit(1)))
    left = left.withColumns({"ti": F.col("t"), "tj": F.explode(F.sequence(F.lit(0), F.col("us") - 1)), "side": F.lit(0), "apart": F.lit(False)})
    right = b.join(counted(a, "t"), "key", "left").withColumn("ts", F.coalesce("ts", F.lit(1)))
    right = right.withColumns({"ti": F.explode(F.sequence(F.lit(0), F.col("ts") - 1)), "tj": F.col("u"), "side": F.lit(1), "apart": F.lit(False)})
    columns = ["key", "ti", "tj", "side", "apart", "phoned", "id", *FIELDS, *[f"s_{f}" for f in SIGNED]]
    return _met(left.select(*columns).unionByName(right.select(*columns)), pairs, threshold)


#: Shares of the leads at which the ranges of the scan end, and the pairs from which it goes by ranges.
RANGES, MANY_PAIRS = (1 / 16, 1 / 4), 20_000_000


def _lowest_independent(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaders among ``nodes``: no lower neighbour is a leader. Each round settles nodes whose lower neighbours are settled."""
    inner = cut_lineage(edges.select("leader", "id").join(nodes, "id", "left_semi"))
    open_nodes, led = nodes, None
    while not open_nodes.isEmpty():
        waiting = inner.join(open_nodes.select(F.col("id").alias("leader")), "leader", "left_semi").select("id").distinct()
        new = cut_lineage(open_nodes.join(waiting, "id", "left_anti"))
        led = new if led is None else led.unionByName(new)
        beaten = inner.join(new.select(F.col("id").alias("leader")), "leader", "left_semi").select("id")
        open_nodes = cut_lineage(open_nodes.join(new, "id", "left_anti").join(beaten, "id", "left_anti"))
    return led.select(F.col("id").alias("leader"))


def duplicate_groups(leads: DataFrame, threshold: float = 0.85, tenant: str | None = None) -> DataFrame:
    """ER-2: (primary_lead_id, duplicate_lead_id, score, confidence, matching_fields), one row per claimed lead.

    With ``tenant`` the scan runs over the leads of each of its values by themselves, all in the same job.
    """
    read = ["id", *([tenant] if tenant else []), "first_name", "last_name", "email", "phone", "linkedin_url", "title"]
    rows = cut_lineage(profiles(spread(leads.select(*read, F.struct("company.name").alias("company")), "id"), tenant))
    classes = rows.groupBy("tenant", *FIELDS).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    # Copies that do not reach the threshold among themselves reach it with nobody.
    live, _ = written(with_signatures(classes.where(self_score() >= threshold)))
    members, at = written(blocks(live.where("id IS NOT NULL"), threshold).drop("tenant", "copies"))
    ends = live.approxQuantile("id", list(RANGES), 0.01) if _pairs_of(members) > MANY_PAIRS else []
    claims = None
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        def inside(rows, low=low, high=high):
            rows = rows if low is None else rows.where(F.col("id") > low)
            return rows if high is None else rows.where(F.col("id") <= high)

        free = members if claims is None else members.join(claims.select("id"), "id", "left_anti")
        edges, listed = written(_pairs_among(inside(free), threshold))
        nodes = cut_lineage((edges.select(F.col("leader").alias("id")) if high is None else inside(free).select("id")).union(edges.select("id")).distinct())
        if nodes.isEmpty():
            continue
        led = _lowest_independent(edges, nodes)
        won = edges.join(led, "leader", "left_semi")
        if high is not None:
            met = _pairs_between(free.join(led, F.col("id") == F.col("leader"), "left_semi"), free.where(F.col("id") > high), threshold)
            won = won.unionByName(met)
        # The first leader has it; ranges after this one no longer meet it.
        won, _ = written(won.groupBy("id").agg(F.min("leader").alias("leader")).select("leader", "id"))
        drop(rows.sparkSession, listed)
        claims = won if claims is None else claims.unionByName(won)
    drop(rows.sparkSession, at)
    cls = live.select("tenant", *FIELDS, F.col("id").alias("class_id"))
    expanded = rows.join(cls, ["tenant", *FIELDS]).select(F.col("id").alias("duplicate_lead_id"), "class_id")
    own = live.where("copies > 1").select(F.col("id").alias("class_id"), self_score().alias("score"), *FIELDS)
    own = own.select("class_id", F.col("class_id").alias("primary_lead_id"), "score", F.least(F.lit(0.95), sum((F.when(F.col(f) != "", 1).otherwise(0) for f in FIELDS), F.lit(0)) / 6.0 * F.col("score")).alias("confidence"),
                     compact(*[say(F.col(f) != "", f) for f in FIELDS]).alias("matching_fields"))
    if claims is None:
        grouped = own
    else:
        side = lambda name, key: live.select(F.col("id").alias(key), F.struct(*FIELDS).alias(name))
        scored = score_pairs(claims.join(side("a", "leader"), "leader").join(side("b", "id"), "id"))
        best = scored.select(F.col("id").alias("class_id"), F.col("leader").alias("primary_lead_id"), "score", "confidence", "matching_fields")
        grouped = own.join(best.select("class_id"), "class_id", "left_anti").unionByName(best)
    out = expanded.join(grouped, "class_id").where(F.col("duplicate_lead_id") != F.col("primary_lead_id"))
    return out.select("primary_lead_id", "duplicate_lead_id", "score", "confidence", "matching_fields")


def merge_recommendation() -> Column:
    """ER-3."""
    exact = F.array_contains("matching_fields", "email") | F.array_contains("matching_fields", "phone")
    s = F.col("score")
    return F.when(s >= 0.95, "auto_merge").when(s >= 0.85, F.when(exact, "high_confidence_merge").otherwise("manual_review")).when(s >= 0.7, "manual_review").otherwise("no_merge")


def merge_strategies(groups: DataFrame) -> DataFrame:
    """ER-3 per group."""
    g = groups.groupBy("primary_lead_id").agg(F.count("*").alias("duplicates"), F.count(F.when(F.col("confidence") > 0.9, 1)).alias("high"), F.avg("confidence").alias("group_confidence"))
    strategy = F.when((F.col("high") == F.col("duplicates")) & (F.col("duplicates") <= 3), "batch_merge").when(F.col("high") >= F.col("duplicates") * 0.8, "selective_merge").otherwise("manual_review_required")
    return g.withColumn("merge_strategy", strategy)


def same_email(leads: DataFrame) -> DataFrame:
    """ER-4: lower-cased e-mail repeated; the lowest id is primary."""
    given = leads.where(F.coalesce(F.col("email"), F.lit("")) != "").select("id", F.lower("email").alias("e"))
    first = given.groupBy("e").agg(F.min("id").alias("primary_lead_id"), F.count("*").alias("n")).where("n > 1")
    return given.join(first, "e").where("id <> primary_lead_id").select("primary_lead_id", F.col("id").alias("duplicate_lead_id"))


def duplicate_records(groups: DataFrame, as_of: str, auto_threshold: float = 0.95) -> DataFrame:
    """SNK-17/ER-8: rows for the duplicate table."""
    c = F.col("confidence")
    return groups.select(
        "primary_lead_id", "duplicate_lead_id", F.round(c * 100, 6).alias("match_score"), F.when(c < 0.9, "fuzzy").otherwise("exact").alias("match_type"),
        F.to_json("matching_fields").alias("matching_fields"), (c >= auto_threshold).alias("auto_merge_recommended"),
        F.when(c >= auto_threshold, "auto_merge").otherwise("manual_review").alias("merge_strategy"), F.lit("pending").alias("status"), F.lit(as_of).cast("timestamp_ntz").alias("detected_at"))


# ---- vector similarity ------------------------------------------------------------------------------------------


def similar_to_references(refs: DataFrame, candidates: DataFrame, on: str, similarity: Column, threshold: float = 0.7, k: int = 10) -> DataFrame:
    """ER-5/JN-13: candidates of each reference's tenant, scored, thresholded and cut to the best k per reference.

    Both sides carry struct columns ``r`` and ``c``; refs hold one row per tenant, so the equi-join on the tenant key
    replaces a cross join and the planner broadcasts refs only when they are small.
    """
    j = candidates.join(refs, on).where(F.col("c.id") != F.col("r.id"))
    s = j.withColumn("similarity_score", F.round(similarity, 6)).where(F.col("similarity_score") >= threshold)
    w = Window.partitionBy("r.id").orderBy(F.desc("similarity_score"), F.col("c.id"))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _tile_top(k: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["ti"].iloc[0], pdf["tj"].iloc[0]
        left = pdf[pdf["tile"] == i].sort_values("id")
        right = left if i == j else pdf[pdf["tile"] == j].sort_values("id")
        out = []
        if len(left) and len(right):
            b, bid = np.vstack(right["unit"].to_numpy()), right["id"].to_numpy()
            # Row slabs keep the product small next to the tile itself.
            step = max(1, min(512, (1 << 21) // len(right)))
            for s in range(0, len(left), step):
                part = left.iloc[s:s + step]
                sim = np.round(np.clip(np.vstack(part["unit"].to_numpy()) @ b.T, 0, 1), 6)
                aid = part["id"].to_numpy()
                ok = sim >= threshold
                if i == j:
                    ok &= aid[:, None] < bid[None, :]
                r, c = np.nonzero(ok)
                lo, hi = np.minimum(aid[r], bid[c]), np.maximum(aid[r], bid[c])
                order = np.lexsort((hi, lo, -sim[r, c]))[:k]
                out.append(pd.DataFrame({"id1": lo[order], "id2": hi[order], "score": sim[r, c][order]}))
        if not out:
            return pd.DataFrame({"id1": pd.Series(dtype="int64"), "id2": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return pd.concat(out).sort_values(["score", "id1", "id2"], ascending=[False, True, True]).head(k)

    return run


#: Most clusters that vectors are dealt into; their centres and radii are all the driver holds.
CENTRES = 256


def _near_centre(centres: np.ndarray):
    """Adds the nearest centre of each vector and the angle to it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sim = np.vstack(pdf["unit"].to_numpy()) @ centres.T
                yield pdf.assign(cluster=sim.argmax(axis=1).astype("int32"), angle=np.arccos(np.clip(sim.max(axis=1), -1, 1)))

    return run


def meeting_clusters(centres: np.ndarray, radii: np.ndarray, floor: float) -> list[tuple[int, int]]:
    """Pairs of clusters, each both ways and with itself, that may hold a pair with a score of ``floor`` or more.

    Two vectors are no closer than the angle between their centres less both radii. The slack covers the rounding of scores
    to six digits and of the angles.
    """
    apart = np.arccos(np.clip(centres @ centres.T, -1, 1)) - radii[:, None] - radii[None, :] - 1e-6
    best = np.maximum(np.cos(np.clip(apart, 0, np.pi)), 0)
    return [(int(a), int(b)) for a, b in np.argwhere(best + 1e-6 >= floor)]


def _pairs_of_low(distinct: DataFrame, low: int, upto: int, n: int, tile_rows: int, k: int, threshold: float) -> DataFrame:
    """The k best pairs of distinct unit vectors of which one has an id up to ``upto``; ``low`` of the ``n`` have."""
    # Tiles of the low ones come first and meet all tiles, the others only those.
    first, rest = -(-low // tile_rows), -(-(n - low) // tile_rows)
    at = F.xxhash64("id")
    tile = F.when(F.col("id") <= upto, F.pmod(at, F.lit(first))).otherwise(F.pmod(at, F.lit(max(rest, 1))) + first).cast("int")
    last = F.when(F.col("id") <= upto, first + rest - 1).otherwise(first - 1)
    met = distinct.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    met = met.select("id", "unit", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"))
    return met.groupBy("ti", "tj").applyInPandas(_tile_top(k, threshold), "id1 long, id2 long, score double")


def _clustered_pairs(distinct: DataFrame, tiles: int, tile_rows: int, k: int, threshold: float) -> DataFrame:
    """The k best pairs of distinct unit vectors: tiles with themselves first, then those pairs of tiles that can beat them."""
    spark, schema = distinct.sparkSession, "id1 long, id2 long, score double"
    centres = np.array([r.unit for r in distinct.orderBy(F.xxhash64("id"), "id").select("unit").limit(min(tiles, CENTRES)).collect()])
    placed = cut_lineage(distinct.mapInPandas(_near_centre(centres), "id long, unit array<double>, cluster int, angle double"))
    radii, parts, starts = np.zeros(len(centres)), {}, {}
    for r in placed.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).orderBy("cluster").collect():
        radii[r.cluster], starts[r.cluster], parts[r.cluster] = r.radius, sum(parts.values()), -(-r.n // tile_rows)
    own = spark.createDataFrame([(c, starts[c], parts[c]) for c in parts], "cluster int, start int, parts int")
    # A cluster of any size is cut into tiles of bounded size.
    tile = F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = placed.join(own, "cluster").select("id", "unit", "cluster", tile.alias("tile"))
    alone = dealt.withColumns({"ti": F.col("tile"), "tj": F.col("tile")}).groupBy("ti", "tj").applyInPandas(_tile_top(k, threshold), schema)
    best = alone.orderBy(F.desc("score"), "id1", "id2").limit(k).collect()
    floor = best[-1].score if len(best) == k else threshold
    meet = [(a, starts[b], parts[b]) for a, b in meeting_clusters(centres, radii, floor) if a in parts and b in parts]
    others = spark.createDataFrame(meet, "cluster int, start int, parts int")
    spread = dealt.join(others, "cluster").withColumn("other", F.explode(F.sequence("start", F.col("start") + F.col("parts") - 1))).where("other <> tile")
    spread = spread.select("id", "unit", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"))
    across = spread.groupBy("ti", "tj").applyInPandas(_tile_top(k, floor), schema)
    return across.unionByName(spark.createDataFrame(best, schema))


#: Tiles that vectors are dealt into where nothing else is asked for: each vector is copied to the tiles it meets, so their number
#: must not grow with the table. A tile has at least SMALL_TILE rows and, beyond that, at most LARGE_TILE numbers (16 MB).
TILES, SMALL_TILE, LARGE_TILE = 16, 4096, 1 << 21


def rows_of_tile(n: int, width: int) -> int:
    return max(SMALL_TILE, min(-(-n // TILES), LARGE_TILE // max(width, 1)))


def top_similar_pairs(vectors: DataFrame, k: int = 20, threshold: float = 0.7, tile_rows: int | None = None) -> DataFrame:
    """ER-7: the k most similar pairs (score desc, ids) at or above the threshold, exact.

    Equal vectors collapse to their lowest ids first. Distinct vectors are dealt by their nearest centre into tiles of bounded
    size; a pair of tiles is one small matrix product that returns at most k pairs, so no pair list is ever built. Tiles are
    compared with themselves first; two tiles meet only if the angle between their centres, less both radii, can beat the
    k-th score found so far.

    Equal vectors have the highest score there is. Once they make k pairs, a pair of others can only come before the last of
    these if its lower id is no higher: the vectors with such an id, mostly few, are compared with all, and nothing else is.
    """
    v = F.transform("vector", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select("id", v.alias("v"), norm.alias("norm")).where("norm > 0")
    unit = rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))
    ranked = unit.withColumn("rn", F.row_number().over(Window.partitionBy("unit").orderBy("id"))).where(F.col("rn") <= k + 1)
    kept = cut_lineage(ranked)
    # Pairs inside one distinct vector: k + 1 lowest ids give its k lowest pairs.
    a, b = kept.select("unit", F.col("id").alias("id1")), kept.select("unit", F.col("id").alias("id2"))
    same = a.join(b, "unit").where("id1 < id2").select("id1", "id2", F.lit(1.0).alias("score"))
    distinct = kept.where("rn = 1").select("id", "unit")
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("unit")), F.lit(0)).alias("width")).first()
    n, tile_rows = size.n, tile_rows or rows_of_tile(size.n, size.width)
    tiles = max(1, -(-n // tile_rows))
    equal = same.orderBy("id1", "id2").limit(k).collect() if tiles > 1 else []
    low, upto = n, None
    if len(equal) == k:
        # Only pairs at the highest score are left to find.
        upto, threshold = equal[-1].id1, max(threshold, 1.0)
        low = distinct.where(F.col("id") <= upto).count()
    if upto is not None and low * 8 <= n:
        found = _pairs_of_low(distinct, low, upto, n, tile_rows, k, threshold)
    elif tiles == 1:
        whole = distinct.withColumns({"tile": F.lit(0), "ti": F.lit(0), "tj": F.lit(0)})
        found = whole.groupBy("ti", "tj").applyInPandas(_tile_top(k, threshold), "id1 long, id2 long, score double")
    else:
        found = _clustered_pairs(distinct, tiles, tile_rows, k, threshold)
    best = found.orderBy(F.desc("score"), "id1", "id2").limit(k)
    # Expand each vector pair to the ids that share its vectors.
    rep = kept.where("rn = 1").select("unit", F.col("id").alias("rep"))
    ids = kept.join(rep, "unit").select("rep", "id")
    wide = best.join(ids.select(F.col("rep").alias("id1"), F.col("id").alias("x")), "id1").join(ids.select(F.col("rep").alias("id2"), F.col("id").alias("y")), "id2")
    across = wide.select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"), "score")
    return same.unionByName(across).orderBy(F.desc("score"), "id1", "id2").limit(k)
