"""Spelling variants, whitening and personal data against brute force, and the odd cases that they define."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from leadlake.llm import pii, queries, spelling, whitening
from leadlake.llm.base import table

SCHEMA = "doc_id long, text string, word string, n long, run string, h string, spans string, x int, base int"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Straße straße STRASSE ÀÉÎ àéî tokens tokens tokens token's"), (5, "x" * 20_000), (6, "lorem ipsum dolor " * 20_000),
    (7, "hello hello hello helo helo helo jello jello jello"), (7, "hello hello hello helo helo helo jello jello jello"), (None, "hello there"), (8, "😀hello😀 漢字hello"), (9, "x" * 20_000), (10, "x" * 20_001), (11, ("y" * 19_999 + " ") * 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "w", 1, "r", "h", "s", 2, 3) for i, t in ODD], SCHEMA).repartition(3)


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    by_gap = defaultdict(set)
    for w in words:
        if len(w) < 1000:
            for i in range(len(w)):
                by_gap[len(w) - 1, i, w[:i] + w[i + 1 :]].add(w)
            by_gap[len(w), -1, w].add(w)
    near = defaultdict(set)
    for (size, i, rest), same in by_gap.items():
        for a in same:
            near[a] |= {b for b in same if b != a} if i >= 0 else set()
            if i >= 0 and rest in words:
                near[a].add(rest)
                near[rest].add(a)
    long = [w for w in words if len(w) >= 1000]
    for a in long:
        near[a] |= {b for b in long if a != b and one_edit(a, b)}
    form = {}
    for w, c in words.items():
        best = min(near[w], key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= 2 * c else None
    out = set()
    for w, c in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, c, len(near[w]), None if form[w] is None else words[form[w]]))
    return out


def test_spelling_variants_are_those_of_brute_force(spark, odd, sf_dir, monkeypatch):
    for df in (odd, table(spark, sf_dir, "documents")):
        monkeypatch.setattr(queries, "table", lambda *a, df=df: df)
        got = queries.op11_spelling(spark, sf_dir).collect()
        want = spelled([(r.doc_id, r.text) for r in df.collect()])
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    monkeypatch.setattr(queries, "table", lambda *a: odd.limit(0))
    assert queries.op11_spelling(spark, sf_dir).count() == 0


def test_near_words_meet_once_whatever_the_edit(spark):
    words = ["aaaaa", "aaaaaa", "aaaab", "baaaa", "abaaa", "abcde", "abde", "abcdef", "xabcde", "abxcde", "abxde", "bacde", "aaaaaaa", "éabcde", "ébcde", "abcdé"]
    got = Counter((r.word, r.near) for r in spelling.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect())
    assert got == Counter({(a, b): 1 for a in words for b in words if a != b and one_edit(a, b)})


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(100)]
    assert {tuple(r) for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {(w, "w100") for w, _ in chain}


def reference(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, s, e[::-1], u[:, ::-1]


def test_whitening_is_that_of_a_full_eigendecomposition(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    rows = emb.collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], dtype=np.float64)).astype(np.int64)
    n, s, e, u = reference(x)
    got = queries.op12_whitening(spark, sf_dir).toPandas()
    assert len(got) == 4 * len(rows) and set(got.n) == {n}
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r.vec_id for r in rows]].to_numpy()
    want = (x - s / n) @ u[:, :4] / np.sqrt(e[:4])
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-9
    one = got[got.component == 1].set_index("vec_id").deviation
    assert [one[r.vec_id] for r in rows] == ((n * x - s) ** 2).sum(axis=1).tolist()
    assert np.allclose(got.groupby("component").explained.first(), e[:4] / e.sum(), rtol=1e-10) and got.identity_error.max() < 1e-10 and got.residual.max() < 1e-12


@pytest.mark.parametrize("kind", ["flat", "falling", "double", "low rank", "narrow"])
def test_jacobi_davidson_finds_the_leading_values_of_any_spectrum(kind):
    rng = np.random.default_rng(3)
    d = 3 if kind == "narrow" else 120
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = {"flat": np.linspace(2, 1, d), "falling": 1 / (1.0 + np.arange(d)), "double": np.append([5, 5, 5, 3, 3], np.full(d - 5, 0.5)) if d > 5 else None, "low rank": np.append([2, 1], np.zeros(d - 2)), "narrow": np.array([3.0, 2, 1])[:d]}[kind]
    v = (q * e) @ q.T
    values, u, residuals = whitening.jacobi_davidson(lambda x: v @ x, d, 4)
    k = min(4, d)
    assert np.allclose(values, e[:k], atol=1e-12 * e[0]) and np.abs(u.T @ u - np.eye(k)).max() < 1e-12 and np.abs(v @ u - u * values).max() < 1e-12 * e[0] and residuals.max() < 1e-12 * e[0]


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(5)
    d = 30
    a = rng.standard_normal((d, d))
    v, q = a + a.T, np.linalg.qr(rng.standard_normal((d, 2)))[0]
    p = np.eye(d) - q @ q.T
    r = p @ rng.standard_normal((d, 1))
    t = whitening.corrections(lambda x: v @ x, np.array([0.3]), [q], r, 200, 1e-13)
    assert np.abs(p @ (v - 0.3 * np.eye(d)) @ p @ t + r).max() < 1e-8 and np.abs(q.T @ t).max() < 1e-10


def test_whitening_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, x int, w int, label int"
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (2, [0.5, -1.0, 4.0]), (None, [2.0, 2.0, 1.0]), (4, None), (5, [1.0, None, 3.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 0.0, 0.0]), (8, []), (9, [1.0, 2.0]), (10, [-0.0, 1e-9, -1e-9])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    got = whitening.whitened(df).collect()
    kept = [v for v in rows if v[0] in (1, 2, None, 10)]
    x = np.floor(256 * np.array([v[1] for v in kept])).astype(int)
    n, s, e, u = reference(x)
    assert Counter(r.vec_id for r in got) == Counter({i: 3 * c for i, c in Counter(v[0] for v in kept).items()}) and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((v[0], int(d)) for v, d in zip(kept, ((n * x - s) ** 2).sum(axis=1)))
    for none in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id IN (4, 5, 6, 7, 8)")):
        assert whitening.whitened(none).count() == 0
    big = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [5.0, 3.0])], "vec_id long, embedding array<double>")
    assert all(r.deviation is None for r in whitening.whitened(big).where("vec_id < 3").collect())


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            g = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(g) <= 19 and luhn(g) or k == 3 and 10 <= len(g) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_plain_patterns():
    rng = np.random.default_rng(0)
    alphabet = list("aZ1234567890..@@+-_% ()\né😀")
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert plain(text) == pii.base_spans(text), text
    assert len(pii.base_spans("a" * 300_000 + "@" + "1" * 300_000 + "@a.b")) == 1


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.examples())


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    ok = pii.allowed()
    emit, steps, first = rng.standard_normal((12, pii.LABELS)), np.where(ok, rng.standard_normal(ok.shape), pii.NEVER), np.where(ok[0], rng.standard_normal(pii.LABELS), pii.NEVER)
    labels, starts = np.array([0, 1, 2, 0, 3, 4, 4, 0, 0, 5, 6, 0]), np.array([0, 4, 9])
    value, d_emit, d_steps, d_first = pii.gradient(emit, steps, first, labels, starts)

    def total(e, s, f):
        return pii.gradient(e, s, f, labels, starts)[0]

    for a, d, at in ((emit, d_emit, (5, 4)), (emit, d_emit, (0, 1)), (steps, d_steps, (3, 4)), (steps, d_steps, (0, 0)), (first, d_first, (0,))):
        more = a.copy()
        more[at] += 1e-5
        args = [more if x is a else x for x in (emit, steps, first)]
        assert abs((total(*args) - value) / 1e-5 - d[at]) < 1e-3


def test_viterbi_is_the_best_path_and_leaving_lines_out_changes_nothing(field):
    rng = np.random.default_rng(2)
    shapes = pii.Shapes()
    texts = [" ".join(rng.choice(["call", "at", "dot", "com", "12", "555", "-", "(", ")", "Anna", "x", "4111", ".", "\n", "+1", "of"], rng.integers(0, 40))) for _ in range(400)] + ["", "\n", "x"]
    classes, starts, _, tokens = pii.lines(texts, shapes)
    assert ["".join(t) for t in tokens] == texts
    table_ = field.table(shapes)
    got = pii.decode(field, classes, starts, table_)
    assert (got == pii.decode(field, classes, starts, table_, whole=True)).all() and got.any()
    emit = field.emissions(pii.neighbours(classes, starts), table_)
    for s, e in list(zip(starts, np.append(starts[1:], len(classes))))[:200]:
        best = emit[s] + field.first
        for t in range(s + 1, e):
            best = emit[t] + (best[:, None] + field.steps).max(axis=0)
        own = emit[s, got[s]] + field.first[got[s]] + sum(emit[t, got[t]] + field.steps[got[t - 1], got[t]] for t in range(s + 1, e))
        assert abs(best.max() - own) < 1e-3


def test_the_field_adds_what_the_patterns_miss(spark, field):
    rows = [(1, "reach anna at myhost dot org please"), (2, "Ring 212-555-0198 tonight."), (3, "pay 4111.1111.1111.1111 now\nor call 212 555 0198"), (4, "we looked at the house dot"), (5, "see page 12-15, it is 3.14 at noon"), (None, None), (7, "")]
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    texts = dict(rows)
    assert {i: [(k, texts[i][s:e]) for k, s, e, _ in f] for i, f in got.items()} == {
        1: [("email", "anna at myhost dot org")], 2: [("phone", "212-555-0198")], 3: [("card", "4111.1111.1111.1111"), ("phone", "212 555 0198")], 4: [], 5: [], None: [], 7: []}
    # Held out from the labelled table: data made with other numbers, in all written forms.
    seen, hit, wrong = 0, 0, 0
    for text, spans in pii.examples(each=9, plain=0):
        classes, starts, _, tokens = pii.lines([text], s := pii.Shapes())
        base = pii.base_spans(text)
        more = pii.added(text, tokens[0], pii.decode(field, classes, starts, field.table(s)), base)
        found = base + more
        for start, end, kind in spans:
            if kind == "card" and not luhn(re.sub("[^0-9]", "", text[start:end])):
                continue
            seen += 1
            hit += (start, pii.KINDS.index(kind), end) in found
        wrong += not spans and bool(more)
    assert hit / seen > 0.9 and wrong == 0


def test_personal_data_of_odd_and_whole_tables(spark, odd, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    long = spark.createDataFrame([(1, "word " * 200_000 + "a@b.cc 10.0.0.1 " + "7" * 100_000), (1, "a@b.cc"), (1, "a@b.cc")], "doc_id long, text string")
    for df in (odd, docs, long, odd.limit(0)):
        monkeypatch.setattr(queries, "table", lambda *a, df=df: df)
        got = queries.op13_pii(spark, sf_dir).collect()
        want = Counter()
        for r in df.collect():
            base = plain(r.text or "")
            joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
            want[(r.doc_id, *(sum(k == x for _, k, _ in base) for x in range(4)), hashlib.sha256(joined.encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
        # Added spans leave the base ones in place.
        assert all(r.n_added + r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in r.spans.split(",") if x]) for r in got)


def test_one_s_own_labelled_table(spark):
    rows = [(f"badge number {k:04} here", [(13, 17, "card")]) for k in range(40)] + [("nothing to see here", [])] * 20
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int,kind:string>>")
    own = pii.train(pii.labelled(df))
    classes, starts, _, _ = pii.lines(["badge number 9999 here"], s := pii.Shapes())
    assert pii.decode(own, classes, starts, own.table(s)).tolist() == [0, 0, 5, 0]
