"""URL filter, nearest neighbours, WARC, HTML, and the pipeline: against brute force and on odd rows."""

from __future__ import annotations

import gzip
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from harrow.llm import langid, queries, simhash, warc
from harrow.llm.ann import nearest
from harrow.llm.common import shared_dir
from harrow.llm.html_text import extract, html_to_text, title_of
from harrow.llm.url_filter import judge_urls

RULES = queries.URL_RULES


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host: str, path: str) -> str | None:
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def test_urls_hosts_paths_and_rules_equal_brute_force(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op2_url_filter(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = split_url(urls[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == RULES[rule] if rule else r.verdict in ("allow", "block")


def test_url_templates_learn_from_labels_and_odd_rows(spark):
    rules = {f"h.test/bad/{i}/": "block" for i in range(30)} | {f"h.test/good/{i}/": "allow" for i in range(30)}
    rows = [(n, f"http://h.test/{kind}/{i}/page") for n, (kind, i) in enumerate((k, i) for k in ("bad", "good") for i in range(60))]
    rows += [(1000, None), (1001, "no scheme"), (1002, "HTTP://H.Test?x"), (1002, "HTTP://H.Test?x"), (None, "http://a/" + "b/" * 3000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, template string")
    got = {r.page_id: r for r in judge_urls(pages, rules).collect()}
    assert judge_urls(pages, rules).count() == len(rows)
    assert {got[i].verdict for i in range(30, 60)} == {"block"} and {got[i].verdict for i in range(90, 120)} == {"allow"}
    assert got[30].template == "/bad/*/page"
    assert (got[1000].host, got[1001].path, got[1002].host, got[1002].path) == ("", "", "h.test", "")
    assert judge_urls(pages.limit(0), rules).count() == 0


def brute_templates(urls: list[tuple[str, str]], min_children: int = 8, min_share: float = 0.05, max_depth: int = 6) -> list[tuple]:
    """The template of each (host, path), built from a plain tree."""
    cut = []
    for _, path in urls:
        parts = [p for p in path.split("/") if p]
        cut.append(parts if len(parts) < max_depth else [*parts[: max_depth - 1], "/".join(parts[max_depth - 1 :])])
    templates = [() for _ in urls]
    for level in range(max_depth):
        children: dict = {}
        for (host, _), parts, t in zip(urls, cut, templates, strict=True):
            if len(parts) > level:
                children.setdefault((host, t), Counter())[parts[level]] += 1
        for i, ((host, _), parts) in enumerate(zip(urls, cut, strict=True)):
            if len(parts) > level:
                node, s = children[host, templates[i]], parts[level]
                literal = (len(node) < min_children or node[s] >= min_share * node.total()) and not re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]+)?", s)
                templates[i] = (*templates[i], s if literal else "*")
    return templates


def brute_purity(labels: dict[tuple, tuple[int, int, int]], max_depth: int = 6) -> dict[tuple, float]:
    """Purity of each (host, template) from its counts of labels, of bad ones and of rows."""
    merged = {key: key[1] for key in labels}
    for level in range(max_depth - 1, -1, -1):
        branches: dict = {}
        below: Counter = Counter()
        shapes: dict = {}
        for key, now in merged.items():
            if len(now) > level and now[level] != "*":
                masked = (key[0], (*now[:level], "+", *now[level + 1 :]))
                branches.setdefault(masked, {}).setdefault(now, Counter()).update(dict(zip("nkr", labels[key], strict=True)))
                shapes.setdefault((key[0], now), Counter())[key[1][level + 1 :]] += labels[key][2]
                below[key[0], now[: level + 1]] += labels[key][2]
        to = {}
        for (host, masked), some in branches.items():
            share = (sum(c["k"] for c in some.values()) + 1) / (sum(c["n"] for c in some.values()) + 2)
            near = {b: abs((c["k"] + 1) / (c["n"] + 2) - share) <= 2 * (share * (1 - share) / c["n"]) ** 0.5 for b, c in some.items() if c["n"]}
            model = near or some
            under = {b: below[host, b[: level + 1]] for b in some}
            whole = sum(under[b] for b in model)
            part = (sum(some[b]["r"] for b in model) + 1) / (whole + 2)
            usual = sum((shapes[host, b] for b in model), Counter())
            kinds = len(set().union(*(shapes[host, b] for b in some)))
            rows = usual.total()
            for b, c in some.items():
                ratio = sum((x / c["r"]) ** 2 * (rows + kinds) / (usual[t] + 1) for t, x in shapes[host, b].items())
                misfit = c["r"] * rows / (c["r"] + rows) * (ratio - 1)
                fits = misfit <= kinds - 1 + 2 * (2 * (kinds - 1)) ** 0.5
                fits = fits and abs(c["r"] / under[b] - part) <= 2 * (part * (1 - part) * (1 / under[b] + 1 / whole)) ** 0.5
                if near[b] if c["n"] else all(near.values()) and fits:
                    to[host, b] = masked
        merged = {key: to.get((key[0], now), now) for key, now in merged.items()}
    sums: dict = {}
    own: Counter = Counter()
    for key, now in merged.items():
        own[key[0], now] += labels[key][0]
        for i in range(len(now) + 1):
            n, k = sums.get((key[0], now[:i]), (0, 0))
            sums[key[0], now[:i]] = (n + labels[key][0], k + labels[key][1])
    out = {}
    for key, now in merged.items():
        for i in range(len(now) + 1):
            n, k = sums[key[0], now[:i]]
            out[key] = (k + 4 * out[key]) / (n + 4) if i else (k + 1) / (n + 2)
        if not own[key[0], now]:
            out[key] = 0.5
    return out


def check_urls(rows: list, rules: dict[str, str]) -> None:
    templates = brute_templates([(r.host, r.path) for r in rows])
    assert [r.template for r in rows] == ["/" + "/".join(t) for t in templates]
    labels: dict = {}
    for r, t in zip(rows, templates, strict=True):
        n, k, all_ = labels.get((r.host, t), (0, 0, 0))
        labels[r.host, t] = (n + (r.rule is not None), k + (rules.get(r.rule) == "block"), all_ + 1)
    purity = brute_purity(labels)
    for r, t in zip(rows, templates, strict=True):
        assert r.purity == pytest.approx(purity[r.host, t], abs=1e-12), (r.host, t)
        assert r.verdict == (rules[r.rule] if r.rule else "block" if r.purity >= 0.8 else "allow")


def test_url_templates_purity_and_verdicts_equal_brute_force(spark, sf):
    check_urls(queries.op2_url_filter(spark, sf).collect(), RULES)
    rng = np.random.default_rng(2)
    rules = {f"{h}.test/{s}/": v for h in "abc" for s, v in (("s1", "block"), ("s2", "block" if h == "a" else "allow"), ("s3/x", "block"))}
    urls = [
        f"http://{h}.test/s{rng.integers(1, 6)}/{'xyz'[rng.integers(3)]}/{rng.choice(['page', 'item', 'view'])}{rng.integers(40)}/{rng.integers(1000)}"
        for h in rng.choice(list("abcd"), 900)
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    check_urls(judge_urls(pages, rules, hot_rows=20).collect(), rules)  # many hot segments
    rows = judge_urls(pages, rules).collect()
    check_urls(rows, rules)
    unruled = Counter((r.host, r.verdict) for r in rows if r.rule is None)
    assert unruled["a.test", "block"] and not unruled["d.test", "block"] and unruled["d.test", "allow"]


def test_one_rule_does_not_block_siblings_of_another_structure(spark):
    urls = [f"http://h.test/{s}/{kind}/{i}" for s in ("de", "at") for kind, n in (("post", 30), ("tag", 10)) for i in range(n)]
    urls += [f"http://h.test/shop/{kind}/{i}" for kind, n in (("item", 38), ("post", 2)) for i in range(n)] + ["http://h.test/about"]
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), {"h.test/de/": "block"}).collect()
    check_urls(rows, {"h.test/de/": "block"})
    verdicts = {(r.path.split("/")[1], r.verdict) for r in rows}
    assert verdicts == {("de", "block"), ("at", "block"), ("shop", "allow"), ("about", "allow")}


def test_nearest_has_exact_scores_and_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got: dict[int, list] = {}
    for r in queries.op5_nearest(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        distance = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        expected = sorted((d, i) for d, i in zip(distance.tolist(), ids.tolist(), strict=True) if i != q)[:10]
        assert got[q] == sorted(got[q]) and all(s == pytest.approx(distance[ids == i][0], abs=1e-12) for s, i in got[q])
        hits, total = hits + len({i for _, i in got[q]} & {i for _, i in expected}), total + len(expected)
    assert hits >= 0.9 * total


def measured(spark, vectors: np.ndarray, **options) -> tuple[float, float]:
    """Recall of 10 nearest against brute force, and the share of all vectors that a query is compared with."""
    table = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>").repartition(3)
    found, compared = {}, {}
    for r in nearest(table, table.where("vec_id % 100 = 0"), counted=True, **options).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        compared.setdefault(r.query_id, {})[r.compared] = r.compared
    hits = 0
    for q in range(0, len(vectors), 100):
        distance = ((vectors - vectors[q]) ** 2).sum(axis=1)
        distance[q] = np.inf
        assert len(found[q]) == 10
        hits += len(found[q] & set(np.argsort(distance)[:10].tolist()))
    asked = len(range(0, len(vectors), 100))
    return hits / asked / 10, float(np.mean([sum(c) for c in compared.values()])) / len(vectors)


def test_nearest_compares_few_vectors_where_neighbours_are_near(spark):
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(300, 24))
    vectors = middles[rng.integers(0, 300, 9000)] + rng.normal(size=(9000, 24)) * 0.15
    for shard_rows in (20_000, 1_500):  # one shard, and several that queries must choose from
        recall, share = measured(spark, vectors, shard_rows=shard_rows)
        print(f"{len(vectors)} vectors, shards of {shard_rows}: recall {recall:.3f}, compared with {share:.3f}")
        assert recall >= 0.9 and share < 0.1


def test_nearest_fills_up_from_all_shards_and_splits_crowded_ones(spark):
    rng = np.random.default_rng(12)
    crowd = rng.normal(size=8) + rng.normal(size=(900, 8)) * 1e-3
    lonely = rng.normal(size=(100, 8)) * 5
    recall, _ = measured(spark, np.concatenate((crowd, lonely)), shard_rows=50, query_rows=4)
    assert recall >= 0.9


def test_nearest_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [2.0, 0.0]), (8, [1.0]), (None, [1.0, 0.0])]
    table = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, dim int")
    got = [tuple(r) for r in nearest(table, table.where("vec_id in (0, 3)"), k=5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 7, 1.0)]
    assert nearest(table.limit(0), table.limit(0)).count() == 0


def test_warc_round_trip_filters_and_odd_rows(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (4, "u", "small")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    warc.register(spark)
    warc.page_records(pages).write.format("warc").mode("append").save(f"{tmp_path}/w")
    read = spark.read.format("warc").load(f"{tmp_path}/w")
    assert Counter(r.record_type for r in read.collect()) == {"response": 5, "revisit": 3}
    revisits = read.where("record_type = 'revisit'").select(warc.page_of("record_id").alias("p"), warc.page_of("refers_to").alias("to"), "payload_length", "payload").collect()
    assert Counter((r.p, r.to, r.payload_length, r.payload) for r in revisits) == Counter([(1, 3, 1200, None), (2, 3, 1200, None), (None, 3, 1200, None)])
    assert bytes(read.where("target_uri is null").first().payload).decode() == big
    assert {r.payload for r in spark.read.format("warc").option("payload", "false").load(f"{tmp_path}/w").collect()} == {None}
    assert warc.page_records(pages.limit(0)).count() == 0


def test_warc_of_an_empty_table_and_leftovers_of_lost_attempts(spark, tmp_path):
    warc.register(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.page_records(pages).write.format("warc").mode("append").save(f"{tmp_path}/w")
    assert spark.read.format("warc").load(f"{tmp_path}/w").count() == 0
    writer = warc.WarcWriter(str(tmp_path / "w"), 1 << 20, 1)
    record = dict.fromkeys([*warc.HEADER_COLUMNS, "payload_length", "payload"]) | {"record_type": "response", "payload": b"x"}
    batch = pa.RecordBatch.from_pylist([record], schema=pa.schema([*((c, pa.string()) for c in warc.HEADER_COLUMNS), ("payload_length", pa.int64()), ("payload", pa.binary())]))
    lost, done = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.files != done.files
    writer.commit([done])
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) == 1 and not list((tmp_path / "w").glob("*.part"))
    assert spark.read.format("warc").load(f"{tmp_path}/w").count() == 1


@pytest.mark.parametrize("zipped", [False, True])
def test_warc_malformed_records_fail_or_are_rows_of_their_own(spark, tmp_path, zipped):
    good = lambda i: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n".encode()
    bad = [
        b"WARC/1.0\r\nWARC-Type: resource\r\n\r\nno length\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: many\r\n\r\nbad length\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 900\r\n\r\ncut",
    ]
    parts = [good(1), bad[0], good(2), bad[1], good(3), bad[2]]
    (tmp_path / "a.warc").write_bytes(b"".join(gzip.compress(p) for p in parts) if zipped else b"".join(parts))
    warc.register(spark)
    with pytest.raises(Exception, match="malformed"):
        spark.read.format("warc").load(str(tmp_path)).collect()
    rows = spark.read.format("warc").option("malformed", "mark").load(str(tmp_path)).collect()
    assert Counter(r.record_type for r in rows) == {"resource": 3, "malformed": 3}
    assert {r.record_id for r in rows if r.record_type == "resource"} == {"<urn:1>", "<urn:2>", "<urn:3>"}
    kept = spark.read.format("warc").option("malformed", "mark").load(str(tmp_path)).where("record_type = 'resource'")
    assert kept.count() == 3


def test_warc_reads_plain_files_and_passes_over_other_records(spark, tmp_path):
    record = lambda kind, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    data = record("warcinfo", b"a: b\r\n\r\n") + record("resource", b"\r\n\r\nhello") + record("metadata", b"")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data[: len(record("warcinfo", b"a: b\r\n\r\n"))]) + gzip.compress(data))
    warc.register(spark)
    read = spark.read.format("warc").load(str(tmp_path))
    assert read.count() == 7
    assert [bytes(r.payload) for r in read.where("record_type = 'resource'").collect()] == [b"\r\n\r\nhello"] * 2
    reader = warc.WarcReader(str(tmp_path), "*.warc*", True)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert [type(f) for f in reader.pushFilters([EqualTo(("record_type",), "resource"), GreaterThan(("payload_length",), 3)])] == [GreaterThan]


def test_html_layout():
    page = """<html><head><title>T</title><style>p{}</style></head><body><h1>Head &amp; more</h1><p>One<p>Two <b>bold</b>
      <div style="display:none">no</div><span hidden>no</span><ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li>y</ol>
      <table><tr><th>Name<th>N<tr><td>long name<td>1</table><pre>k  k\n z</pre><script>no</script>end"""
    text = html_to_text(page)
    assert text == "Head & more\n\nOne\n\nTwo bold\n\n- a\n- b\n\n  - c\n\n3. x\n4. y\n\nName       N\nlong name  1\n\nk  k\n z\n\nend", repr(text)
    assert "no" not in html_to_text("<p>a<noscript>no</noscript><!-- no -->").split()


@pytest.mark.parametrize(
    ("page", "words"),
    [
        ("<table><tbody><td>x</table>", "x"),
        ("<table><td>x<td>y<tr><td>z</table>", "x y z"),
        ("<table><tr>text<td>a</table>", "a text"),
        ("<table><tr><div>text</div><td>a</table>", "a text"),
        ("<table><tbody>text<tr><td>a</tbody></table>", "a text"),
        ("<table><caption>c</caption><tr><td>a</table>", "c a"),
        ("<head><title>T</title>Hello <b>x</b> <span>y</span>", "Hello x y"),
        ("<head><title>T</title><b>x</b> y", "x y"),
        ("<head><meta charset=utf-8><style>no</style></head><p>a", "a"),
        ("<p>a<select><option>b<option>c</select>d", "a b c d"),
        ("<svg><text>a</text></svg> <math><mi>b</mi></math>", "a b"),
        ("<svg><defs/><desc>no</desc><path d='M0'/><text>a</text></svg>b", "ab"),
        ("<table><colgroup><col><tr><td>x</table>", "x"),
        ("<head><template><div>no</div></template><p>a", "a"),
        ("<dialog>no</dialog><dialog open>a</dialog>", "a"),
    ],
)
def test_html_keeps_all_visible_text(page, words):
    assert sorted(html_to_text(page).split()) == sorted(words.split())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>", "A  B\n   C\nD  E"),
        ("<table><tr><td colspan=2>A<td>B<tr><td>1<td>2<td>3</table>", "A     B\n1  2  3"),
        ("<table><tr><td rowspan=0>A<td>B<tr><td>C<tbody><tr><td>D</table>", "A  B\n   C\nD"),
        ("<table>loose<tr><td>a</table>", "loose\n\na"),
        ("<ul><li><p>a</p><li><p>b</p><p>c</p></ul>", "- a\n- b\n\n  c"),
        ("<ul><li><ul><li>x<li>y</ul></ul>", "- - x\n  - y"),
        ("<form><input type=submit value='Send it'><input value=no></form>", "Send it"),
        ("<p title=\"it's>a</p>b", "a\n\nb"),
        ("a <b x", "a <b x"),
    ],
)
def test_html_layout_of_tables_lists_and_forms(page, text):
    assert html_to_text(page) == text


@pytest.mark.parametrize(
    "page", ["<a " * 30_000, '<a ">" ' * 30_000, "<b x='" * 30_000, "<" * 60_000, "<div>" * 30_000 + "deep", "<ul><li>" * 5_000 + "x", "<table><tr><td>" * 1_000 + "x", "<title" * 30_000]
)
def test_html_takes_time_in_proportion_to_its_length(page):
    began = time.process_time()
    html_to_text(page)
    title_of(page)
    assert time.process_time() - began < 20


def test_html_row_spans_take_time_in_proportion():
    def took(n: int) -> float:
        began = time.process_time()
        text = html_to_text("<table>" + "<tr><td rowspan=65534>x" * n)
        assert text.split() == ["x"] * n
        return time.process_time() - began

    took(2000)
    assert took(16000) < 2.5 * max(took(8000), 0.2)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div style='visibility:hidden'>a<span style='visibility:visible'>b</span></div>", "b"),
        ("<table style='visibility:hidden'><tr><td>a<td style='visibility: visible'>b</table>", "b"),
        ("<p style='visibility:visible'>a<b style='display:none'>c</b>", "a"),
        ("<details><summary>s</summary>body <b>c</b></details>d", "s\nd"),
        ("<details open><summary>s</summary>body</details>", "s\nbody"),
        ("<ol><li>a<li value=9>b<li>c</ol>", "1. a\n9. b\n10. c"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<textarea>\nx &amp; y\n z</textarea>", "x & y\n z"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td rowspan=0>e<tr><td>f<td>g</table>", "a  b\n   c\nd  e\nf     g"),
    ],
)
def test_html_shows_what_browsers_show(page, text):
    assert html_to_text(page) == text


class VisibleWords(HTMLParser):
    """Words of the text nodes of a page whose elements are all closed, without those in hidden elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden: list[str] = []
        self.words: Counter = Counter()

    def handle_starttag(self, tag, attrs):
        style = dict(attrs).get("style") or ""
        unseen = tag in ("head", "script", "style", "template", "noscript", "title") or "hidden" in dict(attrs) or "display:none" in style.replace(" ", "")
        if tag == "img":
            self.words.update((dict(attrs).get("alt") or "").split())
        elif tag not in ("br", "meta", "link", "hr", "input") and (self.hidden or unseen):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if self.hidden and tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.words.update(data.split())


def test_html_text_has_the_visible_words_of_every_page(spark, sf):
    mark = re.compile(r"^(-|[0-9]+\.)$")  # of list items
    rows = queries.op10_html_text(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        walk = VisibleWords()
        walk.feed(r.html or "")
        walk.close()
        without = lambda words: Counter({w: n for w, n in words.items() if not mark.match(w)})
        assert without(Counter(r.text.split())) == without(walk.words), r.page_id


def test_html_of_odd_rows(spark, sf):
    rows = [(1, None), (2, ""), (2, ""), (None, "<p>x"), (3, "<" * 2000), (4, "<div>" * 3000 + "deep"), (5, "a < b & c &nope; &#0;"), (6, "<td>cell</p></table>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, html string, n_lines int")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert extract(pages).count() == len(rows) and extract(pages.limit(0)).count() == 0
    assert (got[1], got[None], got[4], got[6]) == ("", "x", "deep", "cell") and got[5].startswith("a < b & c")
    whole = queries.op10_html_text(spark, sf)
    assert whole.count() == spark.read.parquet(f"{sf}/pages.parquet").count() and whole.where("text like '%<p>%' or text like '%</%'").count() == 0


def test_language_stage_drops_only_texts_without_letters(spark, sf):
    parts = {
        "en": "the cat sat on the mat and then the dog ran to the house ",
        "de": "der Hund lief durch die Straße und das Haus war nicht weit ",
        "fr": "le chat est dans la maison avec les enfants et une pomme ",
    }
    rows = [(i, parts[lang] * 40, lang) for i, lang in enumerate(parts)]
    rows += [(10, parts["en"] * 8 + parts["de"] * 7 + parts["fr"] * 6, None), (11, "12 34 !!", None), (12, None, None), (13, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = {r.doc_id: r.language for r in langid.identify(docs, langid.train(docs)).collect()}
    assert {s.lang for s in labels[10].spans} == set(parts) and labels[10].score < 0.5
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, sf).collect()) == [0, 1, 2, 10]


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark, sf):
    text = "the cat sat on the mat and then the dog ran to the house "
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " ", None, "b", 2), (None, text, "en", None, None), (3, None, "en", "c", 0), (4, "", None, "c", 0), (5, "a wholly different sentence that shares no run of words with others " + "x" * 50_000, "en", "d", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row_id string, size int")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5]
    assert {r.doc_id for r in corpus_pipeline.packing(spark, kept, sf).collect()} == {2, 5}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = f"{shared_dir(spark)}/stages"
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(f"{folder}/{name}")
        kept.append(spark.read.parquet(f"{folder}/{name}"))
    rows = [{r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()} for df in kept]
    gone = set(rows[0]) - set(rows[1])
    assert len(gone) < 0.05 * len(rows[0])
    best: dict[str, tuple] = {}
    for i, t in rows[1].items():
        key = "".join(t.split(" ")).translate(dict.fromkeys(b"\t\n\x0b\x0c\r"))
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    assert set(rows[2]) == {i for _, i in best.values()}
    ids = sorted(rows[2])
    shingles = [set(simhash.shingle_set(rows[2][i], 5).tolist()) for i in ids]
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(shingles):
        for j, b in enumerate(shingles[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert set(rows[3]) == {ids[i] for i in range(len(ids)) if root(i) == i}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == set(rows[3])
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
