"""SimHash near-duplicates: distance tables to reference fingerprints, verified links, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import Memory, batched, discard, documents, materialise, mixed, numbered, rows, words_of

BITS = 64
#: Reference fingerprints: any fixed, well spread values do; these come from a rule, the multiples of an odd constant.
REFERENCES = mixed(np.arange(16, dtype=np.uint64), np.uint64(1))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[at : at + 65_536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(words: list[bytes], shingle: int = 4, seed: int = 42) -> int:
    """Bitwise majority of the XXH64 of all runs of ``shingle`` words; the whole sequence if it is shorter, 0 if empty."""
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8"))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (long, the 64 bits as a signed number), one row per document, without a shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for doc_id, text in rows(batches, "doc_id", "text"):
                yield doc_id, _signed(simhash(words_of(text), shingle, seed))

        return batched(out(), schema)

    return documents(docs).mapInArrow(run, "doc_id long, fingerprint long")


def block_masks(distance: int, blocks: int, within: int = (1 << BITS) - 1) -> list[int]:
    """Masks of the bit blocks of which one pair of fingerprints within ``distance`` must agree on at least one mask.

    The bits of ``within`` make ``blocks`` blocks, of which ``distance`` differ at most and ``blocks - distance`` agree.
    """
    bits = [1 << i for i in range(BITS) if within >> i & 1]
    edges = [len(bits) * i // blocks for i in range(blocks + 1)]
    part = [sum(bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def reference_distances(values: np.ndarray) -> np.ndarray:
    """The distance table: a row per fingerprint, a column per reference fingerprint."""
    return np.bitwise_count(values[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def distance_table(nodes: DataFrame) -> DataFrame:
    """``nodes`` with a column ``table``: the Hamming distances of each fingerprint to all references, worked out once."""
    column = F.col("fingerprint")
    return nodes.withColumn("table", F.array(*(F.bit_count(column.bitwiseXOR(F.lit(_signed(int(r))))).cast("tinyint") for r in REFERENCES)))


def _surviving(a: np.ndarray, b: np.ndarray, values: np.ndarray, table: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within ``distance``: those are discarded of which any coordinate of the table differs by more
    (triangle inequality), the others are verified."""
    for column in range(table.shape[1]):
        if not len(a):
            return a, b
        near = np.abs(table[a, column] - table[b, column]) <= distance
        a, b = a[near], b[near]
    near = np.bitwise_count(values[a] ^ values[b]) <= distance
    return a[near], b[near]


#: Neighbours that every row of a bucket is compared with before only the smaller groups of the bucket are.
NEIGHBOURS = 8
PAIRS_AT_ONCE = 1 << 20


def forest(values: np.ndarray, keys: np.ndarray, distance: int, table: np.ndarray) -> list[tuple[int, int]]:
    """Row pairs with equal key and Hamming distance of at most ``distance`` that connect what is not yet connected.

    ``keys`` are sorted; ``table`` has a row of coordinates per fingerprint. First all rows are compared with their
    next neighbours in the bucket, then, as pairs inside a bucket's largest group can add nothing, every other row
    with the whole bucket. Only pairs that join two trees are kept, so memory stays in proportion to the rows.
    """
    n = len(values)
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((new, [n])))
    end = np.repeat(new + size, size)  # of each row's bucket
    inside = np.flatnonzero(np.repeat(size, size) > 1)
    if not len(inside):
        return []
    parent = np.arange(n)
    out: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while i != parent[i]:
            i = parent[i]
        return int(i)

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal parent
        apart = parent[a] != parent[b]
        a, b = _surviving(a[apart], b[apart], values, table, distance)
        before = len(out)
        for i, j in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((i, j))
        if len(out) > before:
            while not np.array_equal(parent, above := parent[parent]):
                parent = above

    for step in range(1, NEIGHBOURS + 1):
        a = inside[inside + step < end[inside]]
        compare(a, a + step)
    large = size > NEIGHBOURS + 1
    for start, stop in zip(new[large].tolist(), (new + size)[large].tolist(), strict=True):
        found, share = np.unique(parent[start:stop], return_counts=True)
        others = start + np.flatnonzero(parent[start:stop] != found[share.argmax()]) if len(found) > 1 else []
        whole = np.arange(start, stop)
        block = max(1, PAIRS_AT_ONCE // (stop - start))
        for at in range(0, len(others), block):
            some = others[at : at + block]
            a, b = np.repeat(some, stop - start), np.tile(whole, len(some))
            compare(a[a != b], b[a != b])
    return out


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by ``bucket``, cut anew so that none ends inside a bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("bucket").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or keys[0] != held[0].column("bucket")[0].as_py()):
            joined = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            yield from joined.to_batches()
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def fingerprint_links(nodes: DataFrame, distance: int = 4, blocks: int = 6, bucket_rows: int = 20_000) -> DataFrame:
    """Links (a, b) that connect fingerprints within ``distance``: a spanning forest of each bucket, not all pairs.

    ``nodes`` has one row per distinct fingerprint; the distance table is worked out once for each and written. A row
    is dealt to a bucket per choice of bit blocks that a near fingerprint may share with it (no pair is missed). A
    bucket of more than ``bucket_rows`` is split in the same way by the bits that are left, so that a task compares
    fingerprints that agree in 35 bits. In a bucket, pairs are discarded by the distance table and survivors verified.
    """
    table = materialise(distance_table(nodes.select("fingerprint")), "distance-table")
    masks = block_masks(distance, blocks)
    finer = [[m | rest for rest in block_masks(distance, blocks, ((1 << BITS) - 1) ^ m)] for m in masks]
    lists = F.array(*(F.array(*(F.lit(_signed(m)) for m in some)) for some in finer))

    def bucket(*parts: str | Column) -> Column:
        return F.xxhash64(*parts)

    banded = table.select("fingerprint", "table", F.posexplode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("band", "mask"))
    banded = banded.withColumn("bucket", bucket("band", F.col("fingerprint").bitwiseAND(F.col("mask"))))
    crowded = materialise(
        banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("bucket", F.lit(True).alias("crowded")), "crowded"
    )
    split = F.when(F.col("crowded"), F.element_at(lists, F.col("band") + 1)).otherwise(F.array("mask"))
    dealt = (
        banded.join(crowded, "bucket", "left")
        .select("fingerprint", "table", "band", F.posexplode(split).alias("part", "mask"))
        .select("fingerprint", "table", bucket("band", "part", F.col("fingerprint").bitwiseAND(F.col("mask"))).alias("bucket"))
        .repartition("bucket")
        .sortWithinPartitions("bucket", "fingerprint")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_buckets(batches):
            values = batch.column("fingerprint").to_numpy()
            coordinates = batch.column("table").flatten().to_numpy().reshape(len(values), -1)
            found = forest(values.view(np.uint64), batch.column("bucket").to_numpy(), distance, coordinates)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(values[j]), pa.array(values[i])], schema=schema)

    return dealt.select("bucket", "fingerprint", "table").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over ``links`` (a, b; long, in signed order); linked nodes only.

    Alternates large-star and small-star rounds until nothing changes; each round is written to the shared folder. The
    lowest neighbours are written before they are joined, so that Spark can split the join at a node with many links.
    """

    def star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = both if large else both.where("b < a")
        lowest = materialise(seen.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), "lowest")
        joined = seen.join(lowest, "a")
        if large:
            moved = joined.where("b > a and b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = joined.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            moved = moved.union(lowest.where("a != low").select("a", F.col("low").alias("b")))
        return materialise(moved.distinct(), "links"), lowest

    def summary(edges: DataFrame) -> tuple:
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialise(links.where("a != b").distinct(), "links")
    state = summary(edges)
    while state[0]:
        wide, lowest = star(edges, large=True)
        narrow, lower = star(wide, large=False)
        discard(edges, wide, lowest, lower)
        edges, new = narrow, summary(narrow)
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, distance: int = 4, blocks: int = 6) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per document.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased. Null, empty and blank texts have the
    fingerprint zero, which is linked like any other. Documents are connected whose fingerprints differ in at most
    ``distance`` bits; component_id is the smallest doc_id reachable (null if no document there has an id).
    Equal fingerprints are one node, however many documents have them. Repeated rows give a row each; an empty
    table gives none; other columns are left out.
    """
    marked = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    comps = components(fingerprint_links(nodes.select("fingerprint"), distance, blocks))
    named = nodes.join(comps, nodes.fingerprint == comps.node, "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component")
    )
    lowest = materialise(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "lowest")
    labels = materialise(named.join(lowest, "component").select("fingerprint", "component_id"), "labels")
    return marked.join(labels, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


class WordHashes(Memory):
    """XXH64 of a word."""

    def __missing__(self, word: bytes) -> int:
        return self.remember(word, xxhash.xxh64_intdigest(word))


_word_hashes = WordHashes()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``shingle`` words; of the whole sequence if it is shorter."""
    words = words_of(text)
    each = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    runs = each[: len(words) - width + 1] if words else each
    for i in range(1, width):
        runs = mixed(runs, each[i : i + len(runs)])
    return np.unique(runs)


def similar(left: str | None, right: str | None, shingle: int, similarity: float) -> bool:
    """Jaccard similarity of the sets of word shingles; two texts without words are alike."""
    a, b = shingle_set(left, shingle), shingle_set(right, shingle)
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def prefix_length(size: int, similarity: float) -> int:
    """How many of a set's first elements, in an order that all sets share, must meet those of any similar set.

    Similar sets share at least ``similarity`` times the size of either, so their common elements can't all lie behind.
    """
    return size - math.ceil(similarity * size - 1e-9) + 1


#: One document of so many is asked which shingles several documents share; so many shingles are kept at most (12 bytes each).
ASKED = 4
MOST_COMMON = 2_000_000


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles of two or more of every fourth document, and the place of each by how often it occurs, the rarest first.

    They only settle an order, in which a document's own shingles come before those of passages that documents share; no
    pair depends on them. If there are more than ``MOST_COMMON``, the most frequent ones are kept.
    """
    some = docs.where(F.pmod(F.xxhash64("row_id"), F.lit(ASKED)) == 0).select("text")
    schema = pa.schema([("item", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (text,) in rows(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle).view(np.int64))], schema=schema)

    counted = materialise(some.mapInArrow(run, "item long").groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "common")
    left, least = MOST_COMMON, None
    for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("n")).toLocalIterator():
        left -= r.items
        if left < 0:
            break
        least = r.n
    kept = counted.where(F.col("n") >= least) if least else counted.limit(0)
    table = kept.toArrow()
    items, n = (table.column(c).to_numpy() for c in ("item", "n"))
    discard(counted)
    by_value = np.argsort(items)
    rank = np.empty(len(items), np.int32)
    rank[np.lexsort((items, n))] = np.arange(1, len(items) + 1, dtype=np.int32)
    return items[by_value], rank[by_value]


def sketches(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """row_id, size, fingerprint, items, from row_id and text: of each document's set of shingles its size, its SimHash
    and the first shingles by rarity and hash, as many as :func:`prefix_length` says.

    All pairs of that similarity share an item. Texts without words share one item, zero, with each other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))
    schema = pa.schema([("row_id", pa.int64()), ("size", pa.int32()), ("fingerprint", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, rank = shared.value
        held: list[tuple[int, int, int, np.ndarray]] = []
        weight = 0

        def batch() -> pa.RecordBatch:
            offsets = np.cumsum([0, *(len(items) for *_, items in held)]).astype(np.int32)
            ids, sizes, marks = (pa.array([h[i] for h in held], t) for i, t in enumerate(schema.types[:3]))
            items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([h[3] for h in held])))
            return pa.RecordBatch.from_arrays([ids, sizes, marks, items], schema=schema)

        for row_id, text in rows(batches, "row_id", "text"):
            whole = shingle_set(text, shingle)
            items, size = whole.view(np.int64), len(whole)
            if size and len(ordered):
                at = np.minimum(np.searchsorted(ordered, items), len(ordered) - 1)
                items = items[np.argsort(np.where(ordered[at] == items, rank[at], 0), kind="stable")]
            items = items[: prefix_length(size, similarity)] if size else np.zeros(1, np.int64)
            held.append((row_id, size, _signed(majority(whole)), items))
            weight += len(items)
            if weight >= 1 << 16:
                yield batch()
                held, weight = [], 0
        if held:
            yield batch()

    return docs.select("row_id", "text").mapInArrow(run, "row_id long, size int, fingerprint long, items array<long>")


def verified_groups(docs: DataFrame, row: str, similarity: float = 0.8, shingle: int = 5, distance: int = 4) -> DataFrame:
    """row_id, doc_id, component: groups by Jaccard similarity of word shingles, one row per document; no similar pair is missed.

    1. Documents whose SimHash fingerprints are equal or linked within ``distance`` bits (:func:`fingerprint_links`) are
       verified on both whole texts; that finds most copies.
    2. Fingerprints miss pairs near the similarity and of short texts. So all pairs that share one of their first shingles
       (:func:`sketches`), can be similar by their sizes and by what is left of both sets behind that shingle, and are
       still in different groups are verified too. First each shingle's documents are compared with one of them, that
       whose shingles occur most (an original has more common ones than its copies); then what is still apart.

    row_id is the column ``row`` of ``docs``, a written number of each row; component is the smallest row_id of the
    group. Null texts count as empty; all texts without words are one group. An empty table gives no rows.
    """
    whole = docs.select(F.col(row).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = whole.select("row_id", "text")
    marked = materialise(sketches(texts, shingle, similarity), "sketches")
    checked_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("alike", pa.bool_())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for a, b, left, right in rows(batches, "a", "b", "left", "right"):
                yield a, b, similar(left, right, shingle, similarity)

        return batched(out(), checked_schema)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with ``alike``; only texts that are in a pair move."""
        found = materialise(pairs, "candidates")
        asked = materialise(found.select(F.explode(F.array("a", "b")).alias("row_id")).distinct(), "asked")
        needed = materialise(texts.join(asked, "row_id", "left_semi"), "texts")
        with_left = found.join(needed.select(F.col("row_id").alias("a"), F.col("text").alias("left")), "a")
        both = with_left.join(needed.select(F.col("row_id").alias("b"), F.col("text").alias("right")), "b")
        out = materialise(both.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long, alike boolean"), "verified")
        discard(found, asked, needed)
        return out

    def grouped(pairs: DataFrame) -> DataFrame:
        return materialise(components(pairs.where("alike").select("a", "b")).withColumnRenamed("node", "row_id"), "groups")

    def possible(left: str, right: str) -> Column:
        """Sizes allow the similarity, and so does what is left behind a shared item, if it is the pair's first."""
        m, n = F.col(f"{left}.size"), F.col(f"{right}.size")
        behind = F.least(m - F.col(f"{left}.place"), n - F.col(f"{right}.place"))
        fits = (F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9) & (behind * (1 + similarity) >= similarity * (m + n) - 1e-6)
        return fits | ((m == 0) & (n == 0))

    ordered = (F.least("x.row_id", "y.row_id").alias("a"), F.greatest("x.row_id", "y.row_id").alias("b"))
    nodes = materialise(marked.groupBy("fingerprint").agg(F.min("row_id").alias("first")), "nodes")
    linked = fingerprint_links(nodes, distance)
    ends = linked.join(nodes.select(F.col("fingerprint").alias("a"), F.col("first").alias("x")), "a").join(
        nodes.select(F.col("fingerprint").alias("b"), F.col("first").alias("y")), "b"
    )
    equal = marked.select("row_id", "fingerprint").join(nodes, "fingerprint").where("row_id != first").select(F.col("first").alias("a"), F.col("row_id").alias("b"))
    first = verified(equal.union(ends.select(F.least("x", "y"), F.greatest("x", "y"))).distinct())
    groups = grouped(first)

    postings = marked.select("row_id", "size", F.posexplode("items").alias("place", "item"))
    counts = materialise(postings.groupBy("item").agg(F.count(F.lit(1)).alias("shared")).where("shared > 1"), "counts")
    held = materialise(postings.join(counts, "item"), "postings")
    weights = held.groupBy("row_id").agg(F.sum("shared").alias("weight"))
    placed = held.drop("shared").join(weights, "row_id").join(groups, "row_id", "left")
    entries = materialise(placed.withColumn("group", F.coalesce("component", "row_id")).drop("component"), "entries")
    discard(counts, held, groups)
    entry = F.struct("weight", -F.col("row_id"), "row_id", "group", "size", "place")
    hubs = materialise(
        entries.groupBy("item").agg(F.max(entry).alias("hub"), F.min("group").alias("low"), F.max("group").alias("high"))
        .where("low < high").select("item", "hub.row_id", "hub.group", "hub.size", "hub.place"), "hubs",
    )
    stars = entries.alias("x").join(hubs.alias("y"), "item").where((F.col("x.group") != F.col("y.group")) & possible("x", "y"))
    second = verified(stars.select(*ordered).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti"))
    known = first.unionAll(second)
    groups = grouped(known)
    regrouped = entries.drop("group", "weight").join(groups, "row_id", "left").withColumn("group", F.coalesce("component", "row_id")).drop("component")
    regrouped = materialise(regrouped, "entries")
    discard(entries, hubs)
    apart = materialise(regrouped.groupBy("item").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("item"), "apart")
    left = materialise(regrouped.join(apart, "item"), "apart")
    across = left.alias("x").join(left.alias("y"), "item").where((F.col("x.group") < F.col("y.group")) & possible("x", "y"))
    rest = verified(across.select(*ordered).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti"))
    discard(regrouped, apart, left)
    final = grouped(known.unionAll(rest))
    return whole.select("row_id", "doc_id").join(final, "row_id", "left").select("row_id", "doc_id", F.coalesce("component", "row_id").alias("component"))


def drop_near_duplicates(docs: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: of each of :func:`verified_groups` the smallest doc_id
    (null last; then the first row)."""
    whole, row = numbered(docs)
    groups = verified_groups(whole, row, **options)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id"))
    kept = groups.groupBy("component").agg(F.min_by("row_id", order).alias(row)).select(row)
    return whole.join(kept, row, "left_semi").drop(row)
