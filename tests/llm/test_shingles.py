"""Near copies by five-word shingles against all pairs."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlake.llm import shingles
from leadlake.llm.base import table
from tests.llm.test_operators import brute_components


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    """The smallest doc_id of each component of all pairs at a Jaccard similarity of 0.8 or more."""
    sets = [brute_set(r.text) for r in rows]
    roots = brute_components(len(rows), lambda i, j: len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4)
    least = {}
    for r, k in zip(rows, roots, strict=True):
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    return sorted(least.values())


def test_against_all_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rng, rows = random.Random(5), [(r.doc_id, r.text) for r in docs.collect()]
    for k, (_, text) in enumerate(rows[:120]):
        words = (text or "").split(" ")[:400]
        for _ in range(max(1, len(words) * (k % 4) // 100)):
            words[rng.randrange(len(words))] = f"changed{rng.random()}"
        rows.append((10_000 + k, " ".join(words)))
    rows += [(20_000, None), (20_001, " \n"), (20_002, "One two"), (20_003, "one  TWO"), (20_004, "one two three"), (20_005, "a b c d e"), (20_006, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(df.collect())
    assert sorted(r.doc_id for r in shingles.one_of_each(df).collect()) == want and len(want) < len(rows) - 60


def test_large_crowd_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{rng.random()}" for _ in range(400)]
    rows = []
    for k in range(150):
        words = list(base)
        words[rng.randrange(400)] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(500 + k, " ".join([*base[:60], *(f"y{k}_{i}" for i in range(200))])) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.one_of_each(df).collect()) == brute_kept(df.collect())


@pytest.mark.parametrize("size", [100, 300, 1000])
def test_crowds_in_which_no_text_links_to_all(spark, size):
    """Texts of 13 of 16 shared paragraphs, among them no leader to whom all link."""
    rng = random.Random(size)
    paragraphs = [[f"p{k}_{rng.random()}" for _ in range(25)] for k in range(16)]
    rows = [(k, " ".join(w for p in sorted(rng.sample(range(16), 13)) for w in paragraphs[p])) for k in range(size)]
    # The same passage in texts that are otherwise their own.
    rows += [(5000 + k, " ".join([*paragraphs[0], *paragraphs[1], *(f"y{k}_{i}" for i in range(300))])) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.one_of_each(df).collect()) == brute_kept(df.collect())


@pytest.mark.parametrize("size", [150, 450])
def test_copies_out_of_reach_are_not_compared_with_their_crowd(spark, monkeypatch, size):
    """A third of a crowd has so many changes of its own that it links to none; pairs to check grow with the texts, not their square."""
    rng, base = random.Random(size), [f"w{k}" for k in range(150)]
    rows = []
    for k in range(size):
        words = list(base)
        for at in rng.sample(range(10, 140, 7), (1, 2, 4)[k % 3]):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, whole = [], shingles.Sets.verified
    monkeypatch.setattr(shingles.Sets, "verified", lambda self, pairs: (seen.append(pairs.count()), whole(self, pairs))[1])
    assert sorted(r.doc_id for r in shingles.one_of_each(df).collect()) == brute_kept(df.collect())
    assert sum(seen) <= 4 * size


def test_link_whose_first_shared_hashes_are_crowded_for_one_of_them_only(spark):
    """Nine crowded hashes are many for the text of 100 shingles, few for that of 125 that holds all of them."""
    words = [f"w{k}" for k in range(129)]
    small = " ".join(words[:104])
    of = {int(shingles.hashes(" ".join(words[k : k + 5]))[0]): words[k : k + 5] for k in range(100)}
    first = [of[int(h)] for h in shingles.hashes(small)[:9]]
    rows = [(1, " ".join(words)), (2, small)]
    rows += [(10 + k, " ".join(w for j, five in enumerate(first) for w in [*five, *(f"y{k}_{j}_{i}" for i in range(6))])) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(df.collect())
    assert sorted(r.doc_id for r in shingles.one_of_each(df).collect()) == want and 2 not in want


def test_every_near_pair_shares_a_key():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = list(x)
        for _ in range(int(rng.integers(0, 2 + len(x) // 4))):
            if rng.random() < 0.5 and y:
                y.pop(int(rng.integers(len(y))))
            else:
                y.append(np.uint64(rng.integers(0, 1 << 63)))
        y = np.unique(np.array(y, dtype=np.uint64))
        shared = len(np.intersect1d(x, y))
        if len(y) and shared * 5 >= (len(x) + len(y) - shared) * 4:
            assert len(np.intersect1d(shingles.signatures(x, {}), shingles.signatures(y, {}))), (len(x), len(y), shared)


def test_very_long_texts(spark):
    words = [f"w{k}" for k in range(120_000)]
    changed = [*words]
    changed[::60] = ["x"] * len(changed[::60])
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:60_000]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.one_of_each(df).collect()) == brute_kept(df.collect()) == [1, 3]


def test_repeated_and_missing_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "x y z"), (1, "x y z"), (1, "other words here"), (2, "x  Y z"), (None, "p q r")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, sid int")
    out = shingles.one_of_each(df)
    assert out.columns == df.columns and sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", "other words here"), ("1", "x y z"), ("None", "a b c d e f"), ("None", "p q r")]
    assert shingles.one_of_each(df.limit(0)).count() == 0


def test_pipeline_keeps_no_near_copy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = docs.where("length(text) > 2000").orderBy("doc_id").first().text
    words = text.split(" ")
    words[len(words) // 2] = "changed"
    near = spark.createDataFrame([(1, text), (2, " ".join(words))], "doc_id long, text string").select(*(F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
    for name, stage in corpus_pipeline.STAGES:
        if name.endswith("near_dedup"):
            near = stage(spark, near, sf_dir)
    assert [r.doc_id for r in near.collect()] == [1]
