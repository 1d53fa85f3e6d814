"""The pipeline against the operators' brute-force rules, stage by stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadlake.llm import simhash
from leadlake.llm.base import table
from tests.llm.test_shingles import brute_kept
from tests.llm.test_operators import WORD, brute_components, brute_fingerprint, brute_rules


def test_run_is_what_the_stages_say(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns
        rows, left = kept.collect(), {r.doc_id for r in out.collect()}
        if name == "quality_rules":
            for r in rows:
                n, _, symbols, _, repeats = brute_rules(r.text)
                assert r.doc_id not in left or (n >= 20 and 100 * repeats <= 30 * n and 10 * symbols <= n)
        if name == "simhash_near_dedup":
            rows.sort(key=lambda r: r.doc_id)
            prints = [brute_fingerprint(r.text) for r in rows]
            roots = brute_components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)  # noqa: B023
            # Of these, one of each group by shingles.
            assert left == set(brute_kept([rows[k] for k in sorted(set(roots))]))
        kept = out
    lib = Tokenizer.from_file(WORD)
    want = {(r.doc_id, len(lib.encode(r.text, add_special_tokens=False).ids)) for r in kept.collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.n_tokens) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("rows", [0, 4])
def test_odd_tables(spark, sf_dir, rows):
    docs = table(spark, sf_dir, "documents").limit(rows).withColumn("_fp", F.lit(1)).withColumn("_score", F.lit("x"))
    if rows:
        docs = docs.unionByName(docs.withColumn("text", F.lit(None).cast("string"))).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    corpus_pipeline.encoding(spark, docs, sf_dir).collect()
    assert simhash.one_of_each(docs).count() <= docs.count()
