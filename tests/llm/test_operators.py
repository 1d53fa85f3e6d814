"""Operators against brute force, and the odd cases that all of them define."""

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadlake.llm import bpe, classifier, licenses, mixing, pivots, queries, rules, shards, simhash, tokens, urls
from leadlake.llm.base import components, table

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, fp string, _fp int, n_tokens string, shard int, _measures int, topic string, probability int, digest int"
LONG = "lorem ipsum dolor " * 40_000
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One two three four. \n\n  five\t\tsix  <|endoftext|> it's 123 ÉΣ 漢字 😀"), (5, "x" * 50_000), (6, LONG),
    (7, "One two three"), (8, "ONE TWO THREE"), (9, "one  two\nthree"), (10, "\x1c \x85a  b\xa0c"), (10, "\x1c \x85a  b\xa0c"), (None, "one two three"), (12, "Licensed under the MIT Licence!\nmore"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 else "src0", None, 7, 0.5, "x", 1, "y", 3, 4, "t", 5, 6) for k, (i, t) in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").cache()


def test_counts_are_the_library_s(spark, odd, docs):
    lib = Tokenizer.from_file(BYTE)
    for df in (odd, docs):
        texts = Counter((r.doc_id, r.text or "") for r in df.collect())
        got = Counter({(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit): n for r, n in Counter(tokens.token_counts(df, BYTE).collect()).items()})
        want = Counter()
        for (i, t), n in texts.items():
            k = len(lib.encode(t, add_special_tokens=False).ids)
            want[(i, len(t.encode()), k, k > 1024)] += n
        assert got == want
    assert tokens.token_counts(odd.limit(0), BYTE).count() == 0


def test_ids_and_text_are_the_library_s(spark, odd, docs):
    lib = Tokenizer.from_file(WORD)
    for df in (odd, docs):
        want = Counter()
        for r in df.collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            sha = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))]
            want[(r.doc_id, len(ids), *sha)] += 1
        assert Counter(map(tuple, bpe.encoding_digests(df, WORD).collect())) == want
    one = bpe.encoded(odd.where("doc_id = 4"), WORD).first()
    assert one.decoded == lib.decode(list(one.ids), skip_special_tokens=False)
    assert bpe.encoding_digests(odd.limit(0), WORD).count() == 0


def test_licenses_in_other_spellings(spark, odd):
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n" + licenses.MIT.replace("sublicense", "SUB-LICENSE").replace('"', "“")
    rows = spark.createDataFrame([(1, mit), (2, licenses.BSD_3), (3, licenses.BSD_2), (4, "Some words\nReleased under the MIT licence\nCopyright rules"), (5, licenses.ISC + " and more"), (5, licenses.ISC + " and more"), (6, None)], "doc_id long, text string")
    got = {(r.doc_id, r.license_id, r.notices, r.n_notices) for r in licenses.scanned(rows).collect()}
    assert got == {(1, "MIT", "", 0), (2, "BSD-3-Clause", "", 0), (3, "BSD-2-Clause", "", 0), (4, None, "MIT", 1), (5, None, "", 0), (6, None, "", 0)}
    assert licenses.scanned(rows).count() == 7
    assert {r.doc_id: r.notices for r in licenses.scanned(odd).collect()}[12] == "MIT"
    assert licenses.scanned(odd.limit(0)).count() == 0


def test_mixture_meets_its_margins(spark, docs, odd):
    cells = mixing.plan(docs).collect()
    for m in mixing.MARGINS:
        base, got = defaultdict(float), defaultdict(float)
        for c in cells:
            base[c[m]] += c.tokens
            got[c[m]] += c.tokens * c.probability
        total, mass = sum(v**mixing.TEMPER for v in base.values()), sum(got.values())
        assert all(abs(got[v] / mass - base[v] ** mixing.TEMPER / total) < 2e-3 for v in base)
    rows = mixing.mixed(odd).collect()
    assert len(rows) == len(TEXTS) and {r.source for r in rows} == {"src0", mixing.NONE}
    assert mixing.mixed(odd.limit(0)).count() == 0 and mixing.sampled(odd.limit(0)).count() == 0
    kept = mixing.sampled(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.sampled for r in rows)


def heap_loads(sizes, n):
    heap = [(0, k) for k in range(n)]
    for s in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + s, k))
    return sorted(x for x, _ in heap)


@pytest.mark.parametrize("sizes", [[5] * 37, [100, 1, 1, 1] * 9, list(range(1, 200)), [10_000] + [7] * 500, [3], [4, 4, 4, 9, 1, 1]])
def test_runs_are_the_heap_item_by_item(sizes):
    loads, histogram = [0.0] * 8, [(s, n, s * n) for s, n in Counter(sizes).items()]
    for size, _, runs in shards.schedule(histogram, 8):
        n = Counter(sizes)[size]
        for k in range(n):
            start, turns = [r for r in runs if r[0] <= k][-1]
            loads[turns[(k - start) % len(turns)]] += size
    assert sorted(loads) == heap_loads(sizes, 8)


def test_shards(docs, odd):
    for df in (docs, odd):
        rows = shards.sharded(df).collect()
        where, slots, load, groups = defaultdict(set), defaultdict(list), Counter(), Counter()
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in rows:
            t = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
            where[t].add(r.shard)
            slots[r.shard].append(r.slot)
            load[r.shard] += r.size
            groups[t] += r.size
        assert all(len(s) == 1 for s in where.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        best = heap_loads(groups.values(), 8)
        assert abs(max(load.values()) - best[-1]) <= best[-1] * 0.001
        assert len(rows) == df.count()
    assert shards.sharded(odd.limit(0)).count() == 0


def test_classifier_ranks_held_out_rows(spark, sf_dir, odd):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    known = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = [r for r in classifier.scored(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_classifier_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.scored(odd, none).collect()} == {0.5}
    mess = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (8, None), (9, 5), (6, 1)], "doc_id long, quality int")
    assert {r.score for r in classifier.scored(odd, mess).collect()} <= {0.5, 1.0}
    assert classifier.scored(odd.limit(0), mess).count() == 0 and classifier.only_good(odd, none).columns == odd.columns


def test_held_out_labels_are_not_read(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels")
    other = labels.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, classifier.scored(docs, labels).collect())) == sorted(map(tuple, classifier.scored(docs, other).collect()))


def test_copyright_lines_of_every_form(spark):
    forms = ["Copyright The Foo Authors", "Copyright Jane Doe 2020", "Portions Copyright (c) 2020 X", "(c) Jane", "© 2020 Jane", " * Copyright 2020, Jane. All rights reserved.", "Copyright"]
    wrapped = licenses.BSD_2.replace("above copyright notice", "above\ncopyright notice").replace("THE COPYRIGHT HOLDERS", "THE\nCOPYRIGHT HOLDERS")
    other = [licenses.MIT.replace("The above copyright", "The\ncopyright"), licenses.MIT + "\n\nCopyrighted by nobody"]
    rows = spark.createDataFrame([(i, f"MIT License\n\n{f}\n\n{licenses.MIT}") for i, f in enumerate(forms)] + [(10, wrapped), *((20 + i, t) for i, t in enumerate(other))], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scanned(rows).collect()}
    assert got == {**dict.fromkeys(range(len(forms)), "MIT"), 10: "BSD-2-Clause", 20: None, 21: None}


def test_whole_licences_inside_documents(spark):
    """Runs of paragraphs as long as a known text; a changed paragraph, a missing one or another order is none."""
    a, b, c = licenses.MIT.split("\n\n")
    rows = spark.createDataFrame([(1, f"A readme.\n\n{licenses.MIT}\n\nMore."), (2, f"Intro\n\nMIT License\n\nCopyright Jane\n \n{a}\n\n{b}\n\n{c}\n\n{licenses.ZLIB}"), (3, f"Intro\n\n{a}\n\n{c}"), (4, f"Intro\n\n{b}\n\n{a}\n\n{c}"), (5, licenses.BSD_3 + "\n\nEnd")], "doc_id long, text string")
    assert {r.doc_id: (r.license_id, r.notices) for r in licenses.scanned(rows).collect()} == {1: (None, "MIT"), 2: (None, "MIT,Zlib"), 3: (None, ""), 4: (None, ""), 5: (None, "BSD-3-Clause")}


def test_url_lists_by_time(spark):
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = spark.createDataFrame([("A.com", "add", at(5)), ("a.com", "remove", at(10)), ("a.com", "add", at(20)), ("x.a.com", "add", at(8)), ("x.a.com", "add", at(9)), ("x.a.com", "remove", at(12)), ("b.com", "add", at(3)), ("b.com", "remove", at(3)), (None, "add", at(1)), ("c.com", "block", at(1))], "pattern string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    shots = [(1, "http://a.com/", 4), (2, "http://a.com/", 5), (3, "http://user@X.a.com:80/p", 9), (4, "https://x.a.com", 10), (5, "https://x.a.com", 12), (6, "http://a.com?q", 25), (7, "http://b.com", 3), (8, "nonsense", 9), (9, None, 9), (10, "http://c.com", 9), (11, "http://xa.com/", 9), (2, "http://a.com/", 5)]
    pages = spark.createDataFrame([(i, u, at(d), "own") for i, u, d in shots] + [(12, "http://a.com", None, "own")], "page_id long, url string, fetched_at string, pattern string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = sorted((r.page_id, r.n_active, r.pattern, r.blocked) for r in urls.filtered(pages, entries).collect())
    hit = {2: (1, "a.com"), 3: (2, "x.a.com"), 4: (1, "x.a.com"), 6: (1, "a.com")}
    want = sorted((i, *hit.get(i, (0, None)), i in hit) for i, *_ in [*shots, (12,)])
    assert got == want
    assert urls.filtered(pages.limit(0), entries).count() == 0 and not urls.filtered(pages, entries.limit(0)).where("blocked").count()


def test_url_lists_and_a_far_future_fetch(spark):
    """One capture of year 9999 costs one row a running entry; intervals over many cells hold in the middle and end in time."""
    entries = spark.createDataFrame([("a.com", "add", "2010-01-01"), ("a.com", "remove", "2020-06-15"), ("a.com", "add", "2021-01-01"), ("b.com", "add", "1960-01-01"), ("b.com", "remove", "1980-01-01")], "pattern string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    shots = [(1, "a.com", "9999-12-31", 1), (2, "a.com", "2015-05-05", 1), (3, "a.com", "2020-06-14", 1), (4, "a.com", "2020-06-16", 0), (5, "a.com", "2009-12-31", 0), (6, "b.com", "1965-01-01", 1), (7, "b.com", "1990-01-01", 0), (8, "b.com", "9999-12-31", 0)]
    pages = spark.createDataFrame([(i, f"http://{h}/", d) for i, h, d, _ in shots], "page_id long, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    # Hours of 9999 are beyond Python's dates in some zones, so times stay in the table.
    assert sorted(map(tuple, urls.filtered(pages, entries).select("page_id", "n_active").collect())) == [(i, n) for i, _, _, n in shots]
    asked = spark.createDataFrame([("a.com", 0), ("a.com", 600), ("a.com", 97000), ("b.com", -50), ("b.com", -122)], "pattern string, cell long")
    assert urls.in_cells(urls.intervals(entries), asked).count() == 3 + 3


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, linked):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(n)]


def test_simhash_against_all_pairs(docs, odd):
    for df in (docs, odd.where("doc_id <> 6")):
        rows = df.select("doc_id", "text").collect()
        prints = [brute_fingerprint(r.text) for r in rows]
        roots = brute_components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
        least = {}
        for r, k in zip(rows, roots, strict=True):
            if r.doc_id is not None:
                least[k] = min(least.get(k, r.doc_id), r.doc_id)
        want = Counter((r.doc_id, f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, roots, strict=True))
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
        kept = simhash.one_of_each(df)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.one_of_each(odd.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_balls_lose_no_link(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(2**62), 2**62, 12)
    prints = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 3), replace=False)) for b in base for _ in range(12)})
    edges = simhash.near_pairs(spark.createDataFrame([(p,) for p in prints], "fp long"), radius=radius)
    pairs = [(r.a, r.b) for r in edges.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= radius for a, b in pairs)
    got = dict(map(tuple, components(edges).collect()))
    want = brute_components(len(prints), lambda i, j: ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= radius)
    assert [got.get(p, p) for p in prints] == [prints[k] for k in want]


def test_long_chain_of_components(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(1000, 999), (999, 1000), (5, 5), (None, 3)], "a long, b long"))
    got = dict(map(tuple, components(chain).collect()))
    assert got == {i: 0 for i in range(301)} | {999: 999, 1000: 999}


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_rules_against_brute_force(docs, odd):
    for df in (docs, odd):
        want = Counter((r.doc_id, *brute_rules(r.text)) for r in df.collect())
        rows = rules.judged(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        for r in rows:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (r.failed & rules.mask("v2") == 0)
        kept = rules.only_passing(df)
        assert kept.columns == df.columns and kept.count() == sum(r.kept for r in rows)
        by_rule = {r.rule: (r.n_failed, r.n_only) for r in rules.ablations(rules.ledger(df)).collect()}
        assert by_rule["few_words"] == (sum(r.failed & 1 for r in rows), sum(r.failed == 1 for r in rows))
    assert rules.judged(odd.limit(0)).count() == 0


def test_good_labels_pass_the_rules(spark, docs, sf_dir):
    judged = rules.judged(docs).join(table(spark, sf_dir, "labels"), "doc_id").where("quality = 1 AND NOT base_failed")
    assert judged.where("kept").count() >= 0.98 * judged.count()


def brute_vectors(rows, threshold=0.93):
    unit = []
    for r in rows:
        v = None if r.embedding is None or any(x is None for x in r.embedding) else np.array(r.embedding, dtype=float)
        ok = v is not None and r.label is not None and r.vec_id is not None and len(v) and np.isfinite(v).all() and v.any()
        unit.append(v / np.linalg.norm(v) if ok else None)

    def linked(i, j):
        return unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i].label == rows[j].label and float(unit[i] @ unit[j]) >= threshold - 1e-12

    roots = brute_components(len(rows), linked)
    return [(sum(linked(i, j) for j in range(len(rows)) if j != i), roots[i]) for i in range(len(rows))]


def test_vectors_with_odd_components(spark):
    a, b = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    rows = [(1, a, 1), (2, a, 1), (3, a, 2), (4, [2.0, 0.0, 0.4], 1), (5, b, 1), (6, None, 1), (7, [0.0] * 3, 1), (8, [1.0, None, 0.0], 1), (9, [float("nan"), 1.0, 0.0], 1), (10, [float("inf"), 1.0, 0.0], 1), (11, a, None), (None, a, 1), (12, [1.0, 0.0], 1), (13, [], 1), (14, [0.95, 0.1, 0.2], 1)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(df).collect()}
    assert {i: got[i] for i in (1, 2, 4, 14)} == {1: (3, 1, True), 2: (3, 1, False), 4: (3, 1, False), 14: (3, 1, False)}
    assert all(got[i] == (0, i, True) for i in (3, 5, 6, 7, 8, 9, 10, 11, 12, 13)) and got[None] == (0, None, False)
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_vector_recall_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    x = np.concatenate([base, *(base[:20] + rng.normal(size=(20, 32)) * s for s in (0.05, 0.15, 0.25)), base[:1] + rng.normal(size=(80, 32)) * 0.1, base[:5]])
    df = spark.createDataFrame([(i, v.tolist(), int(i % 60 % 20 if i < 120 else 0)) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    rows = df.orderBy("vec_id").collect()
    want = brute_vectors(rows)
    for block in (pivots.BLOCK, 16):
        monkeypatch.setattr(pivots, "BLOCK", block)
        got = {r.vec_id: r for r in pivots.near_duplicates(df).collect()}
        assert sum(got[r.vec_id].n_links for r in rows) >= 0.95 * sum(n for n, _ in want)
        assert all(got[r.vec_id].n_links <= n and got[r.vec_id].component_id >= rows[k].vec_id for r, (n, k) in zip(rows, want, strict=True))


def test_every_operator_has_its_query():
    assert sorted(k.split("_")[0] for k in queries.QUERIES if k != "rule_ablations") == sorted(f"op{n}" for n in range(1, 14))


def around(rng, n, dim, mean):
    """Unit vectors whose mean cosine is ``mean``."""
    u = rng.normal(size=(n, dim))
    x = np.sqrt(1 - mean) * u / np.linalg.norm(u, axis=1, keepdims=True)
    x[:, 0] += np.sqrt(mean)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.8])
def test_pivots_of_vectors_around_a_common_direction(mean):
    """Fitted on 4 * 1024 vectors: partners just above the threshold are found, and few other pairs are compared."""
    rng = np.random.default_rng(5)
    index = pivots._fitted(around(rng, 4096, 64, mean), 1024, 2, 0.93)
    x = around(rng, 3000, 64, mean)
    side = rng.normal(size=x.shape)
    side -= np.sum(side * x, axis=1, keepdims=True) * x
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    near = [pivots._closest(pivots._around(z, index.middle), index.pivots, index.nearest) for z in (x, y)]
    assert len(index.pivots) > 900 and np.mean((near[0][:, :, None] == near[1][:, None, :]).sum(axis=(1, 2)) >= 2) >= 0.93
    on = np.zeros((len(x), len(index.pivots)))
    np.put_along_axis(on, near[0], 1, 1)
    assert np.mean(on @ on.T >= 2) < 0.02


def test_pivots_are_fewer_where_the_nearest_do_not_suffice():
    """Around a direction nearly as close as the threshold fewer pivots keep the rate."""
    rng = np.random.default_rng(7)
    index = pivots._fitted(around(rng, 4096, 64, 0.9), 1024, 2, 0.93)
    assert index.found >= pivots.FOUND and len(index.pivots) < 1024


@pytest.mark.parametrize("shared", [2, 3])
def test_lists_count_each_pair_once(spark, monkeypatch, shared):
    """Few pivots, so that most pairs meet in many lists; links equal brute force."""
    monkeypatch.setattr(pivots, "SHARED", shared)
    monkeypatch.setattr(pivots, "LARGE", ())
    rng = np.random.default_rng(6)
    x = np.repeat(around(rng, 40, 8, 0.5), 4, axis=0) + 0.1 * rng.normal(size=(160, 8))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: int(n) for i, n in enumerate((u @ u.T >= 0.93).sum(axis=1) - 1)}
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(df).collect()}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.95 * sum(want.values()) > 0
