"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, licenses, mixing, pii, pivots, rules, shards, simhash, spelling, tokens, urls, whitening
from .base import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"), 8)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time that follows from their id: within half a year from the start of 2024."""
    second = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 6), 16, 10).cast("long")
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + second).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts of the pages and their parent domains: a quarter of them, listed once or twice."""
    names = pages.select(urls.host().alias("h")).where("h IS NOT NULL").distinct().select(F.explode(urls.domains(F.col("h"))).alias("pattern")).where("contains(pattern, '.')").distinct()
    day = lambda at: F.conv(F.substring(F.md5("pattern"), at, 2), 16, 10).cast("long")
    start = F.lit(1704067200) + (day(3) % 100) * 86400
    steps = F.array(*(F.struct(F.lit(a).alias("action"), (start + F.lit(d * 86400)).alias("s")) for a, d in (("add", 0), ("remove", 40), ("add", 70))))
    rows = names.where(day(1) % 4 == 0).withColumn("e", F.explode(F.when(day(5) % 2 == 0, steps).otherwise(F.slice(steps, 1, 2))))
    return rows.select("pattern", "e.action", F.timestamp_seconds("e.s").alias("at"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filtered(captures(pages), list_entries(pages)).select("page_id", "host", F.unix_timestamp("fetched_at").alias("fetched_s"), "n_active", "pattern", "blocked")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Misspellings: where 97 divides the checksum of document and run, one code point is left out.
    runs = spelling.runs(table(spark, sf_dir, "documents"))
    h, size = F.crc32(F.concat("doc", F.lit(":"), "run")), F.length("run")
    gap = (h % size).cast("int")
    word = F.when(h % 97 == 0, F.concat(F.substring("run", F.lit(1), gap), F.substring("run", gap + 2, size))).otherwise(F.col("run"))
    return spelling.grouped(spelling.counted(runs, word))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), 4)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the base spans, n_added counts what the field adds to them."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    of = {f"n_{k}": count(k) for k in pii.KINDS}
    rows = found.withColumns({**of, "base_sha256": F.sha2(joined(base), 256), "n_added": (F.size("spans") - F.size(base)).cast("long")})
    return rows.select("doc_id", *of, "base_sha256", joined(F.col("spans")).alias("spans"), "n_added")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_bpe_codec, op3_license_scan, op4_mixing, op5_sharding, op6_quality_classifier, op7_url_filter, op8_simhash,
        op9_quality_rules, rule_ablations, op10_embedding_near_dedup, op11_spelling, op12_whitening, op13_pii,
    )
}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _license_sql() -> str:
    def canonical(x: str) -> str:
        out = f"regexp_replace(lower({x}), {_text(licenses.SENTENCE)}, '\\1' || chr(1) || '\\2', 'g')"
        out = f"regexp_replace({out}, {_text(licenses.COPYRIGHT)}, '\\1', 'g')"
        for old, new in licenses.SPELLINGS:
            out = f"replace({out}, {_text(old)}, {_text(new)})"
        return f"sha256(trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"

    def marks(x: str) -> str:
        return f"list_filter(list_transform(regexp_split_to_array({x}, '\\n[ \\t\\r]*\\n'), lambda p: {canonical('p')}), lambda s: s <> sha256(''))"

    texts = ", ".join(f"({_text(n)}, {_text(t)})" for n, t in licenses.TEXTS)
    speaks = lambda c: f"(contains(lower({c}), 'licen') OR contains(lower({c}), 'permi') OR contains(lower({c}), 'copyright'))"
    return f"""
WITH texts AS (SELECT n, t, {marks("t")} AS m FROM (VALUES {texts}) v(n, t)),
cat AS (SELECT digest, min(n) AS license_id FROM (SELECT {canonical("t")} AS digest, n FROM texts UNION ALL SELECT sha256(array_to_string(m, '')), n FROM texts WHERE len(m) BETWEEN 2 AND 6) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
p AS (SELECT r, unnest(list_concat(string_split(x, chr(10)), regexp_split_to_array(x, '\\n[ \\t\\r]*\\n'))) AS part FROM d WHERE {speaks("x")}),
h AS (SELECT r, license_id, false AS run FROM p JOIN cat ON cat.digest = {canonical("part")} WHERE {speaks("part")}
 UNION ALL SELECT r, license_id, true FROM (SELECT r, n, unnest(range(1, len(m) - n + 2)) AS i, m FROM (SELECT r, {marks("x")} AS m FROM d WHERE {speaks("x")}), (VALUES (2), (3), (4), (5), (6)) v(n)) JOIN cat ON cat.digest = sha256(array_to_string(m[i:i + n - 1], ''))),
f AS (SELECT r, list_sort(list(DISTINCT license_id)) AS l FROM h JOIN d USING (r) WHERE NOT run OR {canonical("x")} NOT IN (SELECT digest FROM cat) GROUP BY r)
SELECT doc_id, {canonical("x")} AS digest, cat.license_id, coalesce(len(l), 0)::BIGINT AS n_notices, coalesce(array_to_string(l, ','), '') AS notices
FROM d LEFT JOIN f USING (r) LEFT JOIN cat ON cat.digest = {canonical("x")}"""


def _mixing_sql() -> str:
    steps, now = [], "c0"
    for k in range(mixing.ROUNDS):
        for m in mixing.MARGINS:
            then = f"c{k}_{m}"
            steps.append(f"{then} AS MATERIALIZED (SELECT c.* EXCLUDE (factor), CASE WHEN s > 0 AND target IS NOT NULL THEN factor * target * total / s ELSE factor END AS factor FROM (SELECT *, sum(tokens * factor) OVER (PARTITION BY {m}) AS s FROM {now}) c LEFT JOIN t_{m} USING ({m}), total)".replace("c.* EXCLUDE (factor)", "source, lang, topic, tokens"))
            now = then
    goals = ", ".join(f"t_{m} AS MATERIALIZED (SELECT {m}, pow(sum(tokens)::DOUBLE, {mixing.TEMPER}) / sum(pow(sum(tokens)::DOUBLE, {mixing.TEMPER})) OVER () AS target FROM c0 GROUP BY {m} HAVING sum(tokens) > 0)" for m in mixing.MARGINS)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '{mixing.NONE}') AS source, coalesce(lang, '{mixing.NONE}') AS lang,
  CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'legal' WHEN contains(lower(text), ' | ') THEN 'table' WHEN contains(lower(text), '@') THEN 'contact' ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_words FROM documents),
c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_words)::DOUBLE AS tokens, 1.0::DOUBLE AS factor FROM d GROUP BY ALL),
total AS MATERIALIZED (SELECT sum(tokens) AS total FROM c0), {goals}, {", ".join(steps)},
p AS (SELECT source, lang, topic, least(1.0, factor / (SELECT max(factor) FROM {now} WHERE tokens > 0)) AS probability FROM {now})
SELECT doc_id, source, lang, topic, n_words, round(probability, 9) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < probability AS sampled
FROM d JOIN p USING (source, lang, topic)"""


_HOST = f"lower(regexp_extract(url, {_text(urls.HOST)}, 1))"
_URL_SQL = f"""
WITH pg AS (SELECT page_id, nullif({_HOST}, '') AS host, 1704067200 + ('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT AS fetched_s FROM pages),
up AS (SELECT host, array_to_string(string_split(host, '.')[i:], '.') AS pattern FROM (SELECT DISTINCT host FROM pg WHERE host IS NOT NULL), unnest(range(1, len(string_split(host, '.')) + 1)) AS u(i)),
nm AS (SELECT DISTINCT pattern, md5(pattern) AS m FROM up WHERE contains(pattern, '.')),
st AS (SELECT pattern, m, 1704067200 + (('0x' || substr(m, 3, 2))::BIGINT % 100) * 86400 AS s FROM nm WHERE ('0x' || substr(m, 1, 2))::BIGINT % 4 = 0),
iv AS (SELECT pattern, s AS since, s + 40 * 86400 AS until FROM st UNION ALL SELECT pattern, s + 70 * 86400, NULL FROM st WHERE ('0x' || substr(m, 5, 2))::BIGINT % 2 = 0),
ac AS (SELECT host, fetched_s, count(DISTINCT pattern) AS n, max_by(pattern, length(pattern)) AS pattern FROM (SELECT DISTINCT host, fetched_s FROM pg) JOIN up USING (host) JOIN iv USING (pattern) WHERE since <= fetched_s AND (until IS NULL OR fetched_s < until) GROUP BY 1, 2)
SELECT page_id, pg.host, pg.fetched_s, coalesce(n, 0)::BIGINT AS n_active, ac.pattern, ac.pattern IS NOT NULL AS blocked FROM pg LEFT JOIN ac ON ac.host = pg.host AND ac.fetched_s = pg.fetched_s"""

_LEDGER_SQL = r"""
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM dup, unnest(range(0, 8)) AS v(o) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda y: regexp_matches(y, '[A-Z][^a-z]*[A-Z]') AND NOT regexp_matches(y, '[a-z]')))::BIGINT AS n_capital_words
  FROM (SELECT *, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM d) LEFT JOIN rep USING (r)),
"""
_LEDGER_SQL += "led AS (SELECT *, (" + " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(rules.RULES)) + ")::BIGINT AS failed FROM m)"

# crc32 over the bytes of a text, by a table of its 256 one-byte remainders; 3988292384 is the reversed polynomial.
_SPELLING_SQL = r"""
WITH RECURSIVE rem AS MATERIALIZED (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS r FROM range(256) AS u(i))),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
d AS MATERIALIZED (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM (SELECT doc_id, run, count(*) AS c FROM o WHERE length(run) >= 5 GROUP BY ALL)),
h AS MATERIALIZED (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM d, rem),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
g AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM w, unnest(range(length(word))) AS u(i)),
e AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.rest = w.word UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.rest = w.word),
b AS MATERIALIZED (SELECT word, count(*) AS n_near, min({'m': -near_n, 'w': near}) AS best FROM e GROUP BY word),
k AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS last, 0 AS step FROM k UNION ALL SELECT r.word, k.form, step + 1 FROM r JOIN k ON k.word = r.last WHERE k.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM k JOIN (SELECT word, max_by(last, step) AS root FROM r GROUP BY word) USING (word)"""

CHECKS: dict[str, str] = {
    "op3_license_scan": _license_sql(),
    "op4_mixing": _mixing_sql(),
    "op7_url_filter": _URL_SQL,
    "op9_quality_rules": f"WITH {_LEDGER_SQL.strip()} SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed = 0 AS kept FROM led",
    "rule_ablations": f"WITH {_LEDGER_SQL.strip()} " + " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER (WHERE failed & {1 << i} <> 0) AS n_failed, count(*) FILTER (WHERE failed = {1 << i}) AS n_only FROM led" for i, (name, _) in enumerate(rules.RULES)),
    "op11_spelling": _SPELLING_SQL,
    "op10_embedding_near_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
k AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
c AS (SELECT vec_id AS n, vec_id AS r FROM embeddings UNION SELECT k.b, c.r FROM c JOIN k ON k.a = c.n WHERE c.r < k.b),
m AS (SELECT n, min(r) AS component_id FROM c GROUP BY n)
SELECT vec_id, (SELECT count(*) FROM k WHERE k.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON n = vec_id""",
}
