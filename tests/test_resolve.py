"""Duplicate groups and similar pairs against brute force on small fixtures."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadlake.functions.rules import PAIR_WEIGHTS
from leadlake.functions.similarity import block_ratio, indel_ratio, lcs_length
from leadlake.operators import resolve as ER
from leadlake.sources.bindings import Tables
from leadlake.functions.record import with_company

SCHEMA = "id long, first_name string, last_name string, email string, phone string, linkedin_url string, title string, company struct<name:string>"


def brute_score(a, b):
    def text(x, *ks):
        return " ".join((x[k] or "") for k in ks).strip().lower()

    def fuzzy(x, y):
        return indel_ratio(x, y) / 100 if x and y else 0.0

    def phone(x):
        d = "".join(c for c in (x["phone"] or "") if c.isdigit() or c == "+")
        return d[2:] if d.startswith("+1") else d[1:] if d.startswith("1") and len(d) == 11 else d

    s = {}
    e1, e2 = text(a, "email"), text(b, "email")
    r = fuzzy(e1, e2)
    s["email"] = (1.0 if e1 == e2 else r if r > 0.9 else 0.0) if e1 and e2 else 0.0
    s["name"] = fuzzy(text(a, "first_name", "last_name"), text(b, "first_name", "last_name"))
    s["phone"] = 1.0 if phone(a) and phone(a) == phone(b) else 0.0
    s["linkedin"] = fuzzy(text(a, "linkedin_url"), text(b, "linkedin_url"))
    s["company"] = fuzzy((a["company"] or {}).get("name", "").lower(), (b["company"] or {}).get("name", "").lower())
    s["title"] = fuzzy(text(a, "title"), text(b, "title"))
    total = 0.0
    for f, w in PAIR_WEIGHTS.items():
        total += s[f] * w
    return total


def brute_groups(rows, threshold):
    out, done = {}, set()
    for i, a in enumerate(rows):
        if i in done:
            continue
        for j in range(i + 1, len(rows)):
            if j not in done and brute_score(a, rows[j]) >= threshold:
                out[rows[j]["id"]] = a["id"]
                done.add(j)
    return out


def make_rows(seed, n=90):
    rng = random.Random(seed)
    people = [("Anna", "Smith"), ("Jon", "Doe"), ("Maria", "Garcia"), ("Wei", "Chen"), ("Olga", "Novak")]
    rows = []
    for i in range(n):
        f, l = rng.choice(people)
        local = f"{f}.{l}".lower() if rng.random() < 0.7 else f"info{rng.randint(1, 12)}"
        if rng.random() < 0.5:
            k = rng.randrange(len(local))
            local = local[:k] + rng.choice(["", "x", "1", local[k] * 2]) + local[k + 1:]
        email = f"{local}@{rng.choice(['acme.com', 'acme.co', 'novalabs.ai'])}"
        rows.append({"id": i, "first_name": f if rng.random() < 0.9 else f + "a", "last_name": l, "email": email if rng.random() < 0.95 else None,
                     "phone": rng.choice(["555-987-1234", "+1 555 987 1234", "1111111111", "", None]), "linkedin_url": rng.choice(["", f"https://linkedin.com/in/{f}-{l}".lower()]),
                     "title": rng.choice(["CEO", "CTO", "Sales Manager", ""]), "company": {"name": rng.choice(["Acme", "Acme Corp", "Nova"])}})
    return rows


@pytest.mark.parametrize("seed,threshold", [(1, 0.85), (2, 0.85), (3, 0.8)])
def test_groups_equal_the_sequential_scan(spark, seed, threshold):
    rows = make_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.duplicate_lead_id: r.primary_lead_id for r in ER.duplicate_groups(df, threshold).collect()}
    want = brute_groups(rows, threshold)
    assert want and got == want


def test_leader_not_component(spark):
    # A-B and B-C match, A-C does not: A leads B and C stays alone; with B first, B leads both.
    edges = spark.createDataFrame([(1, 2), (2, 3)], "leader long, id long")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert sorted(r.leader for r in ER._lowest_independent(edges, nodes).collect()) == [1, 3]
    edges = spark.createDataFrame([(1, 2), (1, 3)], "leader long, id long")
    assert [r.leader for r in ER._lowest_independent(edges, nodes).collect()] == [1]


def test_threshold_floor(spark):
    with pytest.raises(ValueError):
        ER.blocks(spark.createDataFrame([], "id long, email string, name string, phone string"), 0.5)


def test_ratio_is_symmetric_and_matches_definition():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc.") for _ in range(rng.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(a, b) == t[-1][-1]
        assert indel_ratio(a, b) == indel_ratio(b, a)


def test_copy_scores_one(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = ER.profiles(with_company(t.leads(dates=False), t.companies())).where("email <> '' AND phone <> '' AND linkedin <> '' AND company <> '' AND title <> '' AND name <> ''")
    pairs = p.select(F.struct("*").alias("a"), F.struct("*").alias("b"))
    r = ER.score_pairs(pairs).select(F.min("score").alias("s"), F.min("confidence").alias("c")).first()
    assert r.s == pytest.approx(1.0) and r.c == pytest.approx(0.95)


@pytest.mark.parametrize("tile_rows", [8, 4096])
def test_top_pairs_equal_brute_force(spark, tile_rows):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5)).round(1)
    v[10] = v[11] = v[12]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(np.clip(u @ u.T, 0, 1), 6)
    want = sorted(((-s[i, j], i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.7))[:20]
    got = [(-r.score, r.id1, r.id2) for r in ER.top_similar_pairs(df, 20, 0.7, tile_rows).collect()]
    assert [(i, j) for _, i, j in got] == [(i, j) for _, i, j in want]


def test_clustered_tiles_that_cannot_win_do_not_meet(spark):
    """Eight clusters far apart, one of them cut into several tiles: the pairs of brute force, and few cluster pairs meet."""
    rng = np.random.default_rng(8)
    centres = np.eye(8)
    v = np.repeat(centres, [100, *[20] * 7], axis=0) + 0.05 * rng.normal(size=(240, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(np.clip(u @ u.T, 0, 1), 6)
    want = sorted(((-s[i, j], i, j) for i in range(240) for j in range(i + 1, 240) if s[i, j] >= 0.7))[:20]
    got = [(-r.score, r.id1, r.id2) for r in ER.top_similar_pairs(df, 20, 0.7, 16).collect()]
    assert [(i, j) for _, i, j in got] == [(i, j) for _, i, j in want]
    radii = np.array([max(np.arccos(np.clip(u[a:b] @ centres[c], -1, 1))) for c, (a, b) in enumerate(zip([0, *range(100, 240, 20)], range(100, 241, 20)))])
    assert set(ER.meeting_clusters(centres, radii, -want[-1][0])) == {(c, c) for c in range(8)}


def test_vectors_are_copied_no_more_often_in_larger_tables():
    """16 tiles for 64 numbers a vector up to half a million vectors; wide vectors keep small tiles."""
    assert [-(-n // ER.rows_of_tile(n, 64)) for n in (1_000, 10_000, 125_000, 500_000)] == [1, 3, 16, 16]
    assert ER.rows_of_tile(10_000_000, 64) == 32768 and ER.rows_of_tile(10_000_000, 4096) == 4096


@pytest.mark.parametrize("small", [8, 64])
def test_default_tiles_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(ER, "SMALL_TILE", small)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 6)).round(2)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(np.clip(u @ u.T, 0, 1), 6)
    want = sorted(((-s[i, j], i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.7))[:20]
    assert [(-r.score, r.id1, r.id2) for r in ER.top_similar_pairs(df, 20, 0.7).collect()] == want


@pytest.mark.parametrize("first", [0, 150])
def test_enough_equal_vectors_bound_the_pairs_to_compare(spark, monkeypatch, first):
    """Copies make more than k pairs: brute force's pairs, near ones that round to 1 among them, without all tiles meeting."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 5)).round(1)
    for i in range(first, first + 40, 2):
        v[i + 200] = v[i]
        v[i + 1] = v[(i * 7) % 399] + 1e-6
    v[301] = v[first + 3] + 2e-6
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(np.clip(u @ u.T, 0, 1), 6)
    want = sorted(((-s[i, j], i, j) for i in range(400) for j in range(i + 1, 400) if s[i, j] >= 0.7))[:5]
    if not first:
        monkeypatch.setattr(ER, "_clustered_pairs", None)
    got = [(-r.score, r.id1, r.id2) for r in ER.top_similar_pairs(df, 5, 0.7, 8).collect()]
    assert got == want
    assert any(not np.array_equal(v[i], v[j]) for _, i, j in want)


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_groups_of_each_tenant_equal_its_own_scan(spark, threshold):
    rows = make_rows(4)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("owner", F.col("id") % 3)
    got = {r.duplicate_lead_id: r.primary_lead_id for r in ER.duplicate_groups(df, threshold, "owner").collect()}
    want = {}
    for o in range(3):
        want |= brute_groups([r for r in rows if r["id"] % 3 == o], threshold)
    assert want and got == want


def test_block_ratio_is_the_matching_block_ratio():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc.") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert block_ratio(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()


@pytest.mark.parametrize("split,cut", [(True, ER.EMAIL_CUT), (False, 0.205)])
def test_partition_index_finds_every_near_pair(spark, split, cut, monkeypatch):
    rng = random.Random(11)
    def value():
        head = "".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 6, 9, 12, 20, 40, 70])))
        return head + rng.choice(["@ab.co", "@ab.com", "@example.org", "@x", ""]) if split else head
    values = {(s, v) for s in ("p", "q") for v in (value() for _ in range(150))}
    for s, v in list(values):
        w = list(v)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.randrange(2)] = rng.choice(["", "a", "z"])
        if w:
            values.add((s, "".join(w)))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
        return row[-1]

    def reach(a, b):
        return int((len(a) + len(b)) * cut)

    df = spark.createDataFrame(sorted(values), "scope string, value string")
    monkeypatch.setattr(ER, "SMALL_SCOPE", 1)
    got = [tuple(r) for r in ER.near_values(df, cut, split).collect()]
    pairs = [(s, a, b) for s, a in values for t, b in values if s == t and a < b]
    # Insertions and deletions are what counts; the index may find pairs within as many edits of any kind as well.
    def corresponds(a, b):
        """Of two addresses with one @ each the signs are taken to correspond."""
        (h, t), (i, u) = ((x.split("@")[0], x[len(x.split("@")[0]):]) for x in (a, b))
        return not split or a.count("@") != 1 or b.count("@") != 1 or t == u or edits(h, i) < reach(a, b)

    must = {(s, a, b) for s, a, b in pairs if len(a) + len(b) - 2 * lcs_length(a, b) <= reach(a, b) and corresponds(a, b)}
    may = {(s, a, b) for s, a, b in pairs if abs(len(a) - len(b)) <= reach(a, b) and edits(a, b) <= reach(a, b)}
    assert len(got) == len(set(got)) and must <= set(got) <= may and len(must) > 100


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_two_thousand_leads_with_one_phone(spark, threshold):
    """One placeholder phone, so that one scope holds all e-mails and goes through the partition index."""
    rng = random.Random(12)
    firsts, lasts = ["Anna", "Jon", "Maria", "Wei", "Olga", "Hanna", "Jonas", "Mario"], ["Smith", "Smyth", "Doe", "Garcia", "Chen", "Novak", "Novack", "Do"]
    rows = []
    for i in range(2000):
        f, l = rng.choice(firsts), rng.choice(lasts)
        local = "".join(c if rng.random() > 0.03 else rng.choice("aeiou1") for c in f"{f}.{l}{rng.randrange(400):03}".lower())
        rows.append({"id": i, "first_name": f, "last_name": l, "email": f"{local}@{rng.choice(['acme-widgets.com', 'acme-widgets.org', 'novalabs.ai'])}", "phone": "1111111111",
                     "linkedin_url": rng.choice(["", f"https://linkedin.com/in/{f}-{l}".lower()]), "title": rng.choice(["CEO", "CTO", "Sales Manager", ""]), "company": {"name": rng.choice(["Acme", "Acme Corp", "Nova"])}})
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.duplicate_lead_id: r.primary_lead_id for r in ER.duplicate_groups(df, threshold).collect()}
    # Without similar e-mails no pair reaches .61, so brute force asks for those first.
    near = {}
    for e1, e2 in itertools.combinations(sorted({r["email"] for r in rows}), 2):
        if (len(e1) + len(e2)) * 0.095 >= abs(len(e1) - len(e2)) and indel_ratio(e1, e2) > 90:
            near.setdefault(e1, set()).add(e2)
            near.setdefault(e2, set()).add(e1)
    by_email = {}
    for r in rows:
        by_email.setdefault(r["email"], []).append(r)
    want = {}
    for a in rows:
        if a["id"] in want:
            continue
        for e in {a["email"], *near.get(a["email"], ())}:
            for b in by_email[e]:
                if b["id"] > a["id"] and b["id"] not in want and brute_score(a, b) >= threshold:
                    want[b["id"]] = a["id"]
    assert len(want) > 300 and got == want


def test_pairs_without_equal_phones_need_all_other_fields_at_the_highest_threshold(spark):
    """Copies that differ in phone and title share no block at .85, where they cannot reach it."""
    row = lambda i, title: (i, "t", "ann@x.org", "ann lee", f"555{i:04}", "in/ann", "x", title)
    p = spark.createDataFrame([row(i, f"title {i}") for i in range(30)] + [row(i, "cto") for i in (40, 41)],
                              "id long, tenant string, email string, name string, phone string, linkedin string, company string, title string")
    assert sorted(r.id for r in ER.blocks(p, 0.85).collect()) == [40, 41]


def test_edit_distance_bounds_the_rounded_ratio_from_above(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("ab. ") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    rows = spark.createDataFrame(list(zip(words[::2], words[1::2])), "x string, y string")
    bound = rows.select("x", "y", F.struct(F.col("x").alias("name")).alias("a"), F.struct(F.col("y").alias("name")).alias("b")).select("x", "y", ER._bound("name", True).alias("top"), ER._bound("name").alias("rough"))
    for r in bound.collect():
        assert indel_ratio(r.x, r.y) / 100 <= r.top + 1e-9 and r.top <= r.rough + 1e-9


def one_phone(n, seed=15):
    """Leads of one placeholder phone with numbered addresses, nearly all of which are near each other."""
    rng = random.Random(seed)
    rows = make_rows(seed, n)
    for r in rows:
        r |= {"email": f"{rng.choice(['test', 'Test.'])}{rng.randrange(3000):04}@10minutemail.com", "phone": "1111111111"}
    return rows


def test_members_of_blocks_do_not_grow_with_near_addresses(spark):
    """A lead is listed once for its phone and for its name and near names, not once for each near address."""
    p = ER.profiles(spark.createDataFrame(one_phone(400), SCHEMA))
    assert ER.blocks(p, 0.85).count() <= 2 * 400
    assert ER.blocks(p, 0.8).count() <= 8 * 400


@pytest.mark.parametrize("threshold,large,batch", [(0.8, 1 << 18, 7), (0.85, 1 << 18, 1000), (0.8, 20, 1000)])
def test_tiles_and_ranges_give_the_sequential_scan(spark, monkeypatch, threshold, large, batch):
    """Many tiles, ranges of ids and batches that cut tiles, and scopes divided by near addresses: the groups of brute force."""
    rows = one_phone(120) + make_rows(16, 60)
    for i, r in enumerate(rows):
        r["id"] = i
    for name, value in (("TILE", 16), ("SLAB", 64), ("MANY_PAIRS", 0), ("LARGE_SCOPE", large)):
        monkeypatch.setattr(ER, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        # A lead without an id pairs with nobody.
        df = spark.createDataFrame([*rows, rows[3] | {"id": None}], SCHEMA)
        got = {r.duplicate_lead_id: r.primary_lead_id for r in ER.duplicate_groups(df, threshold).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_groups(rows, threshold)
    assert len(want) > 20 and got == want


def test_signatures_bound_the_edits():
    rng = random.Random(17)
    texts = ["".join(rng.choice("aabcz019.@é") for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["zyxwv98765" * 8]
    signs = ER._signatures(pd.Series(texts)).to_numpy().view(np.uint64)
    for _ in range(3000):
        i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
        assert np.bitwise_count(signs[i] ^ signs[j]) <= len(texts[i]) + len(texts[j]) - 2 * lcs_length(texts[i], texts[j])


def test_leads_are_dealt_before_their_texts_are_normalised(spark, monkeypatch):
    """A file of short rows is one task, which would normalise all texts by itself."""
    seen, dealt, normalised = [], ER.spread, ER.profiles
    monkeypatch.setattr(ER, "spread", lambda df, *keys: seen.append(keys) or dealt(df, *keys))
    monkeypatch.setattr(ER, "profiles", lambda df, tenant=None: seen.append("profiles") or normalised(df, tenant))
    rows = make_rows(18, 20)
    got = {r.duplicate_lead_id: r.primary_lead_id for r in ER.duplicate_groups(spark.createDataFrame(rows, SCHEMA), 0.8).collect()}
    assert seen == [("id",), "profiles"] and got == brute_groups(rows, 0.8)
