"""Packing, BPE, exact dedup, language-model scores, language, SimHash: against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from harrow.llm import langid, packing, queries, simhash
from harrow.llm.bpe import ForcedBoundaryBPE
from harrow.llm.dedup import drop_exact_duplicates, exact_duplicates
from harrow.llm.lm import Levels, lm_scores, unpacked
from harrow.llm.word_tokens import WordTokens
from tests.oracle import spark_rows, sql_rows

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, "same text here", 5, "x"), (2, "same  text\there ", 5, "y"), (2, "same  text\there ", 5, "y"), (None, "same text here", 5, None), (3, None, None, None),
    (4, "", 0, "z"), (5, " \n\t", 1, "z"), (6, "Ünï cödé 😀 naïve <|endoftext|> it's 'S", 2, "z"), (7, "word " * 3000, 9, "long"), (8, "x" * 9000, 9, "long"),
]
DDL = "doc_id long, text string, length long, __row string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL).repartition(3)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def check_packing(pieces: list, source: list, capacity: int) -> int:
    """Every id lies in exactly one piece, sequences are gapless; the padding is returned."""
    t = tokenizer(WORD_FILE)
    expected = Counter()
    for doc_id, text in source:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        expected[doc_id, struct.pack(f"<{len(ids)}I", *ids)] += 1
    rows = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    fill, by_doc = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r.offset == fill[r.sequence_id] and r.length * 4 == len(r.ids) > 0
        fill[r.sequence_id] += r.length
        by_doc[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    assert max(fill.values()) <= capacity
    total = sum(len(ids) * n for (_, ids), n in expected.items())
    assert sum(fill.values()) * 4 == total
    for (doc_id, ids), n in expected.items():  # repeated rows have each piece n times
        mine = Counter(by_doc[doc_id, len(ids) // 4])
        assert all(ids[4 * start : 4 * start + len(part)] == part for start, part in mine) or n == 1
        at = 0
        while at < len(ids):
            part = next(p for start, p in mine if 4 * start == at and ids[at : at + len(p)] == p)
            at += len(part)
    return sum(capacity - f for f in fill.values() if f & (f - 1))


def test_packing_keeps_every_id_with_little_padding(spark, sf, texts):
    pieces = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), WORD_FILE).collect()
    padding = check_packing(pieces, texts, 2048)
    assert padding <= 0.01 * sum(r.length for r in pieces)


def test_packing_of_odd_rows(odd):
    pieces = packing.pack(odd, WORD_FILE, capacity=64).collect()
    check_packing(pieces, [(r[0], r[1]) for r in ODD], 64)
    assert packing.pack(odd.limit(0), WORD_FILE).count() == 0


def test_level_choice_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    windows = packing.Windows(32, 0, 10_000)
    for _ in range(400):
        size = int(rng.integers(1, 32))
        before = windows.count[1:32].copy()

        def cost(level: int, size: int = size, before: np.ndarray = before) -> int | None:
            after = before.copy()
            if level:
                if not after[level - 1]:
                    return None
                after[level - 1] -= 1
            if level + size < 32:
                after[level + size - 1] += 1
            return int((after**2).sum())

        costs = [c for level in range(32 - size + 1) if (c := cost(level)) is not None]
        list(windows.place((1, 0, b"\0" * 4 * size, size)))
        assert int((windows.count[1:32] ** 2).sum()) == min(costs)


@pytest.mark.parametrize("documents", [0, 1, 7, 300, 3000])
def test_windows_are_filled_up_without_moving_more_than_their_gaps(documents):
    rng = np.random.default_rng(documents)
    windows = packing.Windows(256, 0, 500)
    source = {i: rng.integers(0, 9, int(rng.integers(1, 400)), dtype=np.uint32) for i in range(documents)}
    out = [p for i, ids in source.items() for p in windows.add(i, ids.tobytes())]
    gaps = sum((256 - level) * n for level, n in enumerate(windows.count.tolist()))
    before = windows.moved
    out += list(windows.flush())
    assert windows.moved - before <= gaps and windows.n_open == 0
    fill = Counter()
    for _, _, length, _, _, sequence, _ in out:
        fill[sequence] += length
    assert all(n == 256 or not n & (n - 1) for n in fill.values()) and sum(n < 256 for n in fill.values()) <= 8 * (1 + documents // 500)
    for i, ids in source.items():
        mine = sorted((start, part) for d, start, _, part, *_ in out if d == i)
        assert b"".join(part for _, part in mine) == ids.tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAé'’sSltdT  \n\t09-.<|>")), max_size=60))
def test_tokens_equal_the_library(text):
    for cls, path in ((ForcedBoundaryBPE, BYTE_FILE), (WordTokens, WORD_FILE)):
        own = _held.setdefault(path, (cls(path), tokenizer(path)))
        assert np.frombuffer(own[0].encode(text), "<u4").tolist() == own[1].encode(text, add_special_tokens=False).ids


_held: dict = {}


def test_bpe_of_the_whole_table_and_odd_rows(spark, sf, odd, texts):
    t = tokenizer(BYTE_FILE)

    def expected(doc_id, text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        return doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    assert Counter(map(tuple, queries.op6_bpe(spark, sf).collect())) == Counter(expected(*x) for x in texts)
    got = queries.encode_decode(odd, BYTE_FILE).collect()
    for r in got:
        assert r.decoded == t.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False)
    assert len(got) == len(ODD) and queries.encode_decode(odd.limit(0), BYTE_FILE).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == sql_rows(queries.ORACLE_SQL[name], sf)


def test_exact_duplicates_of_odd_rows(odd):
    rows = exact_duplicates(odd).collect()
    assert len(rows) == len(ODD) and sum(r.kept for r in rows) == 5
    same = [r for r in rows if r.doc_id in (1, 2, None)]
    assert {(r.keep_id, r.group_size) for r in same} == {(2, 4)} and sum(r.kept for r in same) == 1
    blank = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert {(r.keep_id, r.group_size) for r in blank} == {(5, 3)}
    kept = drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 5
    assert drop_exact_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("slice_rows", [1, 20, 100_000])
def test_exact_duplicates_over_many_runs_and_slices(spark, slice_rows):
    rng = np.random.default_rng(slice_rows)
    rows = [(int(i) if i % 9 else None, f"text {rng.integers(120)}" + " " * int(rng.integers(4))) for i in range(900)]
    rows += [(5000 + i, "hot text") for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(70)
    got = exact_duplicates(docs, slice_rows=slice_rows).collect()
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups["".join(text.split())].append((-len(text), doc_id is None, doc_id or 0))
    expected = Counter()
    for bare, some in groups.items():
        _, no_id, keep = min(some)
        digest = hashlib.sha256(bare.encode()).hexdigest()
        expected.update((None if n else d, None if no_id else keep, len(some), digest) for _, n, d in some)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def brute_scores(rows: list, weights: tuple[float, float]) -> dict:
    tokens = {i: (text or "").encode().lower().split() for i, text in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, ws in tokens.items():
        if not held[i]:
            s = ["START", *ws, "END"]
            c1.update(s)
            c2.update(zip(s, s[1:], strict=False))
            c3.update(zip(s, s[1:], s[2:], strict=False))
    n = sum(v for k, v in c1.items() if k != "START")
    v = sum(k != "START" for k in c1)
    unknown = (sum(x == 1 for k, x in c1.items() if k != "START") + 1) / (n + 2)
    out = {}
    for i, ws in tokens.items():
        base = score = 0.0
        s = ["START", *ws, "END"]
        for j, w in enumerate(s[1:], 1):
            base += math.log10((c1[w] + 1) / (n + v + 1))
            p = (1 - unknown) * c1[w] / n if c1[w] else unknown
            a = weights[0] * c1[s[j - 1]] / (c1[s[j - 1]] + 1)
            p = a * c2[s[j - 1], w] / max(c1[s[j - 1]], 1) + (1 - a) * p
            if j > 1:
                h = c2[s[j - 2], s[j - 1]]
                a = weights[1] * h / (h + 1)
                p = a * c3[s[j - 2], s[j - 1], w] / max(h, 1) + (1 - a) * p
            score += math.log10(p)
        out[i] = (held[i], len(ws) + 1, sum(c1[w] > 0 for w in [*ws, "END"]), n, base, score)
    return out


def test_lm_scores_equal_brute_force_and_beat_the_base(spark, sf, texts):
    expected = brute_scores(texts, (0.2, 0.6))
    small = lm_scores(spark.read.parquet(f"{sf}/documents.parquet"), block_bytes=20_000, bucket_bytes=30_000)
    hops = lm_scores(spark.read.parquet(f"{sf}/documents.parquet"), block_bytes=20_000, bucket_bytes=30_000, max_fan=3)
    for rows in (queries.op3_lm_score(spark, sf).collect(), small.collect(), hops.collect()):  # whatever the blocks, buckets and hops
        assert len(rows) == len(texts)
        for r in rows:
            assert tuple(r)[1:5] == expected[r.doc_id][:4]
            assert tuple(r)[5:] == pytest.approx(expected[r.doc_id][4:], rel=1e-9)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_rows_of_n_grams_grow_with_the_text():
    def sent(blocks: int, fan: int) -> int:
        """Rows on all levels for blocks of 40 n-grams each, and as many key ranges as blocks."""
        draw, levels, rows = np.random.default_rng(blocks), Levels(blocks, fan), 0
        members = [(b, 0, np.sort(draw.integers(0, 1 << 64, 40, np.uint64, endpoint=False))) for b in range(blocks)]
        for level in range(1, levels.depth + 1):
            groups = {}
            for member, above, keys in members:
                for bundle, bucket, _, sizes, data, _ in levels.rows(level, member, above, [(keys, np.ones(len(keys), np.int64))]):
                    rows += 1
                    assert bucket // levels.fan == above and 0 < sizes[0] == len(unpacked(data))
                    groups.setdefault((bundle, bucket), []).append(unpacked(data))
            members = [(bundle, bucket, np.unique(np.concatenate(parts))) for (bundle, bucket), parts in groups.items()]
        assert {bundle for bundle, _, _ in members} == {0}  # on the last level every range is whole
        return rows

    rows = [sent(blocks, 8) for blocks in (64, 512, 4096)]  # two, three and four hops of eight ways
    assert rows[1] < 8 * rows[0] * 2 and rows[2] < 8 * rows[1] * 2
    assert rows[2] < 4096 * 8 * 4


def test_lm_scores_of_odd_rows(odd):
    rows = lm_scores(odd).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert lm_scores(odd.limit(0)).count() == 0


def test_language_of_held_out_documents(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op9_language(spark, sf).collect()
    assert len(rows) == len(truth)
    scored = [(r.lang_pred, truth[r.doc_id]) for r in rows if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(scored) > 30 and sum(a == b for a, b in scored) >= 0.95 * len(scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows_and_mixed_text(spark, odd):
    rows = [("en", "the cat sat on the mat and then the dog ran to the house " * 5), ("de", "der Hund lief durch die Straße und das Haus war nicht weit " * 5)]
    model = langid.train(spark.createDataFrame([*rows, (None, "x"), ("en", None)], "lang string, text string"), size=4096)
    mixed = spark.createDataFrame([(1, "the cat sat on the mat with the dog " * 4 + "der Hund und das Haus waren nicht weit weg " * 4), (2, "12 34 !!"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.language for r in langid.identify(mixed, model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and 0.4 < got[1].score < 0.7
    assert (got[2].lang_pred, got[2].score, got[3].lang_pred) == ("und", 0.0, "und")
    assert langid.identify(odd, model).count() == len(ODD) and langid.identify(odd.limit(0), model).count() == 0
    none = langid.train(spark.createDataFrame([], "lang string, text string"), size=64)
    assert {r.language.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def test_best_path_is_the_best_of_all_paths():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(60):
        scores, penalty = rng.normal(0, 3, (6, 3)).astype(np.float32), float(rng.uniform(0, 6))

        def value(path, scores=scores, penalty=penalty):
            return sum(float(scores[i, s]) for i, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))

        best = max(value(p) for p in itertools.product(range(3), repeat=6))
        assert value(langid.best_path(scores, penalty).tolist()) == pytest.approx(best, abs=1e-4)


def components(n: int, pairs) -> list[int]:
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_components(rows: list, source: list) -> None:
    marks = np.array([brute_fingerprint(t) for _, t in source], dtype=np.uint64)
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 4
    place = components(len(source), zip(*np.nonzero(near), strict=True))
    lowest: dict[int, list] = defaultdict(list)
    for (doc_id, _), p in zip(source, place, strict=True):
        lowest[p].append(doc_id)
    expected = Counter((d, f"{int(m):016x}", min((x for x in lowest[p] if x is not None), default=None)) for (d, _), m, p in zip(source, marks, place, strict=True))
    assert Counter(map(tuple, rows)) == expected


def test_simhash_components_equal_brute_force(spark, sf, texts, odd):
    check_components(queries.op7_simhash(spark, sf).collect(), texts)
    check_components(simhash.near_duplicates(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("size", [6, 40, 300])
def test_forest_connects_what_all_pairs_connect(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**63, (max(1, size // 8), 1)).astype(np.uint64)
    values = base[rng.integers(0, len(base), size)][:, 0]
    for _ in range(3):
        values ^= np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64)
    keys = np.sort(rng.integers(0, 3, size))
    pairs = simhash.forest(values, keys, 4, simhash.reference_distances(values))
    near = [(i, j) for i in range(size) for j in range(i) if keys[i] == keys[j] and int(values[i] ^ values[j]).bit_count() <= 4]
    assert components(size, pairs) == components(size, near)
    assert len(pairs) == size - len(set(components(size, near))) and set(pairs) <= {(j, i) for i, j in near}


def test_crowded_buckets_are_split_and_lose_no_link(spark):
    rng = np.random.default_rng(9)
    values = np.repeat(rng.integers(0, 2**63, 3, dtype=np.uint64), 120)
    for _ in range(6):
        values ^= np.uint64(1) << rng.integers(0, 64, len(values)).astype(np.uint64)
    values = np.unique(values).view(np.int64)
    nodes = spark.createDataFrame([(v,) for v in values.tolist()], "fingerprint long")
    near = np.bitwise_count(values.view(np.uint64)[:, None] ^ values.view(np.uint64)[None, :]) <= 4
    place = {v: i for i, v in enumerate(values.tolist())}
    for rows_ in (10, 1_000_000):
        found = [(place[r.a], place[r.b]) for r in simhash.fingerprint_links(nodes, bucket_rows=rows_).collect()]
        assert all(near[i, j] for i, j in found)
        assert components(len(values), found) == components(len(values), zip(*np.nonzero(near), strict=True))


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(5000)]
    originals = [list(rng.choice(words, 300)) for _ in range(30)]
    rows, source = [], []
    for i, text in enumerate(originals):
        for j in range(4):
            copy = list(text)
            for at in rng.choice(300, j, replace=False):
                copy[at] = f"new{i}_{j}_{at}"
            source.append((i * 10 + j, " ".join(copy), None))
    source += [(None, "", 1), (900, None, 2), (901, "one two", None), (902, "one two three", None)]
    docs = spark.createDataFrame(source, "doc_id long, text string, component long").repartition(3)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = sorted(r.doc_id for r in kept.collect())
    assert rows == [*(i * 10 for i in range(30)), 900, 901, 902]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_pairs_at_exactly_the_similarity_are_found(spark):
    rows, expected = [], []
    for i in range(600):
        k = i % 40 + 1  # 4k of 5k shingles are shared: a similarity of 0.8; short texts too
        text = [f"t{i}_{j}" for j in range(4 * k + 4)]
        longer = [*text, *(f"n{i}_{j}" for j in range(k))]
        rows += [(3 * i, " ".join(text)), (3 * i + 1, " ".join(longer))]
        expected.append(3 * i)
        if i % 3 == 0:  # one shingle more that isn't shared: below 0.8
            rows[-1] = (3 * i + 1, " ".join([*longer, f"m{i}"]))
            expected.append(3 * i + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == sorted(expected)


def test_near_copies_sharing_a_common_line_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    line = [f"common{j}" for j in range(12)]
    original = [f"o{j}" for j in range(30)]
    texts = []
    for i in range(150):  # copies resemble the original more than each other; all hold the common line
        copy = list(original)
        for at in rng.choice(30, int(rng.integers(0, 3)), replace=False):
            copy[at] = f"e{i}_{at}"
        texts.append(" ".join([*line, *copy]))
    texts += [" ".join([*line, *(f"u{i}_{j}" for j in range(int(rng.integers(1, 40))))]) for i in range(150)]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    alike = [(i, j) for i in range(300) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted(set(components(300, alike)))
