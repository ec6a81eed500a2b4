"""Token counts, source divergence, whitening: against brute force and on odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from harrow.llm import queries
from harrow.llm.divergence import source_divergence
from harrow.llm.token_counts import PrefixCounts, longest_prefix, prefix_tokens, stored_counts, token_counts, total, truncations
from harrow.llm.whitening import BLOCK_ROWS, primes_above, remaindered, whiten
from tests.oracle import spark_rows, sql_rows

BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, "same text here", 5, "x"), (2, "same  text\there ", 5, "y"), (2, "same  text\there ", 5, "y"), (None, "same text here", 5, None), (3, None, None, None),
    (4, "", 0, "z"), (5, " \n\t", 1, "z"), (6, "Ünï cödé 😀 naïve <|endoftext|> it's 'S we're", 2, "z"), (7, "word " * 3000, 9, "long"), (8, "x" * 9000, 9, "long"),
]
DDL = "doc_id long, text string, n_bytes long, steps string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL).repartition(3)


def library_counts(texts: list[str]) -> list[int]:
    return [len(e.ids) for e in Tokenizer.from_file(BYTE_FILE).encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def prefixes() -> PrefixCounts:
    return PrefixCounts(BYTE_FILE)


PARTS = ["a", "the", "ing", "Xy", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'ll", "re", "l", "12", ".", "!!", "é", "ß", "　", "\xa0", "漢字", "😀", "\x1c", "<|endoftext|>", "<|endof", "://"]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.text(max_size=20)))
def test_count_of_every_prefix_is_the_librarys(prefixes, text):
    text = text.encode("utf-8", "replace").decode()
    steps = prefixes.steps(text.encode())
    assert len(steps) == len(text)
    ends = range(len(text) + 1)
    expected = library_counts([text[:i] for i in ends])
    assert [total(steps[:i]) for i in ends] == expected
    for budget in (0, 1, 2, 5):
        assert longest_prefix(steps, budget) == max(i for i in ends if expected[i] <= budget)


def test_token_counts_of_whole_documents(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    expected = dict(zip(texts, library_counts(list(texts.values())), strict=True))
    rows = queries.op13_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), expected[r.doc_id], expected[r.doc_id] > 1024)
    long = [r for r in rows if r.over_limit]
    assert long
    assert max(library_counts([texts[r.doc_id][: r.fitting_chars] for r in long])) <= 1024
    assert min(library_counts([texts[r.doc_id][: r.fitting_chars + 1] for r in long])) > 1024


def test_token_counts_of_odd_rows(spark, odd):
    texts = [t or "" for _, t, _, _ in ODD]
    expected = sorted(zip([str(i) for i, *_ in ODD], [len(t.encode()) for t in texts], library_counts(texts), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(odd, BYTE_FILE, 10).collect()) == expected
    assert token_counts(odd.limit(0), BYTE_FILE, 10).collect() == []
    stored = stored_counts(odd, BYTE_FILE)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in stored.collect()) == expected
    assert stored_counts(odd.limit(0), BYTE_FILE).collect() == []


def test_stored_counts_answer_later_questions(spark, odd):
    stored = stored_counts(odd.where("doc_id IN (6, 7, 3)"), BYTE_FILE).selectExpr("*", "if(doc_id = 7, 100, NULL) AS budget")
    by_row = {r.doc_id: r for r in truncations(stored, stored.budget).collect()}
    assert by_row[6].fitting_chars is None and by_row[7].fitting_chars == len("word " * 100) - 1
    text = next(t for i, t, _, _ in ODD if i == 6)
    for chars in (-1, 0, 3, 11, 25, 31, 999):
        got = {r.doc_id: r.prefix_tokens for r in prefix_tokens(stored, chars).collect()}
        assert got[6] == library_counts([text[: max(chars, 0)]])[0] and got[3] == 0
    assert truncations(stored.limit(0), 5).collect() == []


def plain_divergence(rows: list[tuple], min_docs: int, top: int) -> set[tuple]:
    """(lang, source, part, item, value, rank) by the definitions, over every term of every group."""
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(words)
        found[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in found[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c: Counter) -> dict[str, int]:
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources - {s}]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, t, v, i) for i, (t, v) in enumerate(ranked, 1) if part == "pair" or i <= top}
    return out


DIVERGENT = [
    ("en", "a", "The cat the dog"), ("en", "a", "the THE cat"), ("en", "b", "the fox the fox"), ("en", "b", "fox cat The"), ("en", None, "the cat"),
    ("en", "c", None), ("en", "d", "9 + 9"), (None, "a", "the \xa0 the"), (None, "", "über Über the"), (None, "a", "the"), (None, None, "the"), ("fr", "a", "un"), ("fr", "b", ""),
    ("de", "a", "Ähre ähre x" * 500), ("de", "a", "Ähre ähre x" * 500), ("de", "b", "Ähre " * 4000), ("de", "b", "x y z z"), ("de", "c", "x x z"), ("de", "c", "z"),
]


def test_divergence_equals_the_definitions(spark, odd):
    docs = spark.createDataFrame([(*r, "t", 1) for r in DIVERGENT], "lang string, source string, text string, term string, n int").repartition(5)
    for min_docs, top, most in ((3, 200, 1000), (1, 2, 2)):
        got = source_divergence(docs, min_docs=min_docs, top=top, most=most).collect()
        assert {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got} == plain_divergence(DIVERGENT, min_docs, top)
        assert len(got) == len(set(got))
    assert source_divergence(docs.limit(0)).collect() == []


def test_divergence_query_matches_sql(spark, sf):
    assert spark_rows(queries.op12_divergence(spark, sf)) == sql_rows(queries.ORACLE_SQL["op12_divergence"], sf)


def check_whitening(rows: list, source: list[tuple], components: int = 16) -> None:
    """Exact figures against whole numbers, components against the covariance, over all rows."""
    usable = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in source if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, dims = len(fit), len(fit[0])
    sums = [sum(col) for col in zip(*fit, strict=True)]
    y = np.array([[n * v - s for v, s in zip(x, sums, strict=True)] for x in fit], object)
    scatter = y.T @ y
    trace = Fraction(sum(scatter[i][i] for i in range(dims)), n**3)
    covariance = np.array([[float(Fraction(v, n**3)) for v in row] for row in scatter])
    values = np.linalg.eigvalsh(covariance)[::-1]
    k = min(components, dims)
    got = defaultdict(list)
    for r in rows:
        assert r.n == n and r.identity_error <= 1e-4 and 1 <= r.component <= k
        got[r.vec_id].append(r)
    wanted = defaultdict(list)
    for i, x in usable:
        wanted[i].append(x)
    assert {i: len(v) for i, v in got.items()} == {i: k * len(v) for i, v in wanted.items()}
    deviation = {i: sorted(sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)) for x in xs for _ in range(k)) for i, xs in wanted.items()}
    assert {i: sorted(int(r.deviation) for r in v) for i, v in got.items()} == deviation
    for c in range(k):
        shares = {r.explained for r in rows if r.component == c + 1}
        assert len(shares) == 1 and shares.pop() == pytest.approx(float(Fraction(values[c]) / trace) if values[c] > 1e-12 * values[0] else 0.0, rel=1e-6, abs=1e-12)
    live = [c for c in range(k) if values[c] > 1e-12 * values[0]]
    single = {i: xs[0] for i, xs in wanted.items() if len(xs) == 1}
    whitened = {tuple(x): np.array([r.whitened for r in sorted(got[i], key=lambda r: r.component)], float) for i, x in single.items()}
    if len(whitened) < n:
        return
    w = np.array([whitened[x] for x in fit])[:, live]
    assert np.abs(np.cov(w.T, bias=True) - np.eye(len(live))).max() < 1e-6
    x = np.array([[float(Fraction(v, n)) for v in row] for row in y])
    columns = np.linalg.lstsq(x, w, rcond=None)[0] if n > dims else None
    if columns is not None:  # what whitens is an eigenvector over the root of its variance
        turned = covariance @ columns
        assert np.abs(turned - columns * values[live]).max() < 1e-6 * np.abs(turned).max()


def test_whitening_query(spark, sf):
    source = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = queries.op11_whiten(spark, sf).collect()
    check_whitening(rows, source)
    assert dict(queries.op11_whiten(spark, sf).dtypes)["deviation"] == "bigint"


def test_whitening_of_odd_rows(spark):
    random = np.random.default_rng(7)
    source = [(i, (random.normal(size=5) * [1e4, 1e3, 1.0, 0.3, 0.01]).tolist()) for i in range(60)]
    source += [(100 + i, source[3][1]) for i in range(40)] + [(100, source[4][1]), (None, source[5][1])]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.nan, 0.0, 0.0, 0.0, 0.0]), (203, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "t", 1) for r in source + odd], "vec_id long, embedding array<double>, x string, n int").repartition(4)
    check_whitening(whiten(df).collect(), source)
    check_whitening(whiten(df, components=2).collect(), source, 2)
    assert whiten(df.limit(0)).collect() == [] and whiten(df.where("vec_id >= 200")).collect() == []
    lone = whiten(df.where("vec_id BETWEEN 101 AND 139")).collect()
    assert len(lone) == 39 * 5 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in lone} == {(1, 0, None, 0.0, 0.0)}
    flat = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in flat if r.whitened is None} == {2, 3} and max(r.identity_error for r in flat) < 1e-9
    with pytest.raises(ValueError, match="entries"):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_whitening_is_exact_far_from_zero(spark):
    random = np.random.default_rng(8)
    source = [(i, [float(a * 2**45 + b) for a, b in zip(random.integers(-9, 9, 4), random.integers(0, 9, 4), strict=True)]) for i in range(50)]
    rows = whiten(spark.createDataFrame(source, "vec_id long, embedding array<double>")).collect()
    check_whitening(rows, source)


@given(st.lists(st.integers(-(10**40), 10**40), min_size=1, max_size=5))
def test_remaindering_gives_back_numbers(values):
    primes = primes_above(2 * 10**40)
    assert math.prod(primes) > 2 * 10**40 and (max(primes) // 2) ** 2 * BLOCK_ROWS < 1 << 53
    assert remaindered({p: np.array([v % p for v in values]) for p in primes}) == values
