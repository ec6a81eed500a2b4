"""Language-model scores: a weighted backoff automaton over smoothed word n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import crc_bucket, discard, documents, materialise, mixed, portions, words_of

#: Marks of a text's start and end; words never contain the line feed that keeps these apart from them.
START, END = b"\nstart", b"\nend"
START_KEY = np.uint64(xxhash.xxh64_intdigest(START))

COUNT_SCHEMA = pa.schema([
    ("bundle", pa.int64()), ("bucket", pa.int64()), ("member", pa.int64()), ("sizes", pa.list_(pa.int64())), ("keys", pa.binary()), ("counts", pa.binary()),
])
COUNT_DDL = "bundle long, bucket long, member long, sizes array<long>, keys binary, counts binary"
REPLY_SCHEMA = pa.schema([
    ("member", pa.int64()), ("bucket", pa.int64()), ("sizes", pa.list_(pa.int64())), ("totals", pa.binary()),
    ("tokens", pa.int64()), ("types", pa.int64()), ("singles", pa.int64()),
])
REPLY_DDL = "member long, bucket long, sizes array<long>, totals binary, tokens long, types long, singles long"
BLOCK_SCHEMA = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
    ("tokens", pa.binary()), ("keys", pa.binary()),
])
BLOCK_DDL = "block long, doc_ids array<long>, held_out array<boolean>, lengths array<long>, tokens binary, keys binary"
SCORE_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
])
SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(values: np.ndarray) -> bytes:
    """64-bit values, the highest bytes of all first: of sorted keys and of counts those hardly change and compress well."""
    planes = values.astype(">u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return planes.reshape(8, -1).T.copy().view(">u8").reshape(-1).astype(np.uint64)


class Block:
    """The tokens of some documents as numbers, and their distinct n-grams of each order.

    ``keys`` are the sorted 64-bit keys of the distinct words and marks, ``tokens`` each document's start mark, words and end
    mark as places in them. ``places[n - 1]`` has the number of the n-gram that ends at each token, -1 if a text's start
    cuts it short.
    """

    def __init__(self, tokens: np.ndarray, keys: np.ndarray, lengths: np.ndarray, train: np.ndarray, order: int):
        self.tokens, self.lengths, self.size = tokens, lengths, len(keys)
        self.start = int(np.searchsorted(keys, START_KEY))
        weight = np.repeat(train, lengths)
        inner = np.flatnonzero(tokens != self.start)
        self.places = [tokens]
        self.keys = [keys]
        self.counts = [np.bincount(tokens[weight], minlength=self.size)]
        #: For each order from 2 on: the n-gram's history (all but its last word) and suffix (all but its first).
        self.history: list[np.ndarray] = []
        self.suffix: list[np.ndarray] = []
        for _ in range(order - 1):
            below = self.places[-1]
            at = inner[below[inner - 1] >= 0] if len(inner) else inner
            found, number = np.unique(below[at - 1].astype(np.int64) * self.size + tokens[at], return_inverse=True)
            place = np.full(len(tokens), -1, np.int32)
            place[at] = number
            self.counts.append(np.bincount(number[weight[at]], minlength=len(found)))
            suffix = np.zeros(len(found), np.int32)
            suffix[number] = below[at]
            self.history.append(found // self.size if self.size else found)
            self.suffix.append(suffix)
            last = found - self.history[-1] * self.size
            self.keys.append(mixed(self.keys[-1][self.history[-1]], keys[last]))
            self.places.append(place)

    def sorted_keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of an order's n-grams by their keys, and the sorted keys."""
        by_key = np.argsort(self.keys[order - 1], kind="stable")
        return by_key, self.keys[order - 1][by_key]


def numbered_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens``, ``keys`` and ``lengths`` of a :class:`Block`."""
    number: dict[bytes, int] = {START: 0, END: 1}
    parts = []
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in [START, *words, END]), np.int32, len(words) + 2))
    keys = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    tokens = rank[np.concatenate(parts)] if parts else np.zeros(0, np.int32)
    return tokens, keys[order], np.fromiter(map(len, parts), np.int64, len(parts))


class Levels:
    """Paths of n-grams from blocks to key ranges in ``depth`` hops of ``fan`` ways each, so that rows grow with the text.

    On level l a group holds one of fan^l equal key ranges of one of fan^(depth - l) bundles of blocks; its members are about
    fan blocks (level 1) or bundles of the level before, and each sends it what it has in that range. On the last level there
    is one bundle, whose groups have the corpus's totals. Every member sends at most ``fan`` rows a level.
    """

    def __init__(self, buckets: int, max_fan: int):
        self.depth = 1
        while max_fan**self.depth < buckets:
            self.depth += 1
        self.fan = 1
        while self.fan**self.depth < buckets:
            self.fan += 1

    def bundle(self, member: int, level: int) -> int:
        """The bundle on ``level`` of a block (level 1) or of a bundle of the level before."""
        number = xxhash.xxh64_intdigest(member.to_bytes(8, "little")) if level == 1 else member
        return number % self.fan ** (self.depth - level)

    def rows(self, level: int, member: int, above: int, orders: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        """The rows that ``member`` sends to ``level``: sorted keys and counts of all orders, cut by the key ranges in range ``above``."""
        ranges = range(above * self.fan, (above + 1) * self.fan)
        edges = np.array([(i << 64) // self.fan**level for i in ranges[1:]], dtype=np.uint64)
        cuts = [[0, *np.searchsorted(keys, edges).tolist(), len(keys)] for keys, _ in orders]
        for i, bucket in enumerate(ranges):
            parts = [slice(c[i], c[i + 1]) for c in cuts]
            sizes = [s.stop - s.start for s in parts]
            if any(sizes):
                keys, counts = (np.concatenate([o[side][s] for o, s in zip(orders, parts, strict=True)]) for side in (0, 1))
                yield self.bundle(member, level), bucket, member, sizes, packed(keys), packed(counts)


def merged(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a group's rows, for each order: the distinct keys, their sums, each member's keys as places in them, and the members' cuts."""
    sizes = np.array(table.column("sizes").to_pylist(), np.int64)
    ends = np.cumsum(sizes, axis=1)
    keys = [unpacked(k) for k in table.column("keys").to_pylist()]
    counts = [unpacked(c).astype(np.int64) for c in table.column("counts").to_pylist()]
    out = []
    for n in range(sizes.shape[1]):
        spans = [slice(int(e[n] - s[n]), int(e[n])) for e, s in zip(ends, sizes, strict=True)]
        distinct, place = np.unique(np.concatenate([k[s] for k, s in zip(keys, spans, strict=True)]), return_inverse=True)
        total = np.bincount(place, np.concatenate([c[s] for c, s in zip(counts, spans, strict=True)]), len(distinct)).astype(np.int64)
        out.append((distinct, total, place, np.cumsum(sizes[:, n])[:-1]))
    return out


def reply_rows(table: pa.Table, totals: list[np.ndarray], orders: list[tuple], stats: tuple[int, int, int] | None = None) -> pa.Table:
    """A group's answer to each member: the totals of its keys in its own order. With ``stats``, a row of member -1 has them."""
    bucket = table.column("bucket")[0].as_py()
    answers = zip(*(np.split(total[place], cuts) for total, (_, _, place, cuts) in zip(totals, orders, strict=True)), strict=True)
    members, sizes = (table.column(c).to_pylist() for c in ("member", "sizes"))
    rows = [(m, bucket, s, packed(np.concatenate(a)), None, None, None) for m, s, a in zip(members, sizes, answers, strict=True)]
    if stats is not None:
        rows.append((-1, bucket, [], b"", *stats))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), REPLY_SCHEMA.types, strict=True)], schema=REPLY_SCHEMA)


def total_bucket(table: pa.Table) -> pa.Table:
    """On the last level: totals for every member that sent keys to this range, and its tokens, types and types seen once."""
    orders = merged(table)
    words = orders[0][1][orders[0][0] != START_KEY]
    return reply_rows(table, [o[1] for o in orders], orders, (int(words.sum()), int((words > 0).sum()), int((words == 1).sum())))


def passed_on(table: pa.Table, answers: pa.Table) -> pa.Table:
    """On a level before the last: the answers to this group's merged keys, handed to each of its members."""
    orders = merged(table)
    return reply_rows(table, joined_totals(answers, [len(o[0]) for o in orders]), orders)


def joined_totals(answers: pa.Table, sizes: list[int]) -> list[np.ndarray]:
    """The totals of each order, in the order of keys, from the answers of all key ranges."""
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("bucket", "sizes", "totals")), strict=True), key=lambda r: r[0])
    parts = [np.split(unpacked(t).astype(np.int64), np.cumsum(s)[:-1]) for _, s, t in rows]
    out = [np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in range(len(sizes))]
    if [len(o) for o in out] != sizes:
        raise RuntimeError("the documents have changed since their n-grams were counted")
    return out


class Automaton:
    """Backoff automaton of the n-grams that a block needs.

    A state is a history of up to n - 1 words that training has seen, with the root for none. A seen n-gram is an arc of its
    history, of weight log10 P(w|h), where P(w|h) = a * c(h,w) / c(h) + (1 - a) * P(w|h without its first word) and
    a = weight * c(h) / (c(h) + 1). For any other word the failure arc of h leads to the state of the shorter history,
    with weight log10(1 - a); the root has an arc for every word. P(w) = (1 - u) * c(w) / N for words seen in training, and
    u, the share of words seen once, for all others as one class. So what may follow a state has probabilities that sum to one.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], tokens: int, singles: int, weights: tuple[float, ...]):
        unknown = (singles + 1) / (tokens + 2)
        probability = np.where(counts[0] > 0, (1 - unknown) * counts[0] / max(tokens, 1), unknown)
        self.root = np.log10(probability)
        self.seen = [c > 0 for c in counts[1:]]
        self.arcs: list[np.ndarray] = []
        self.fail: list[np.ndarray] = []
        for weight, count, below, history, suffix in zip(weights, counts[1:], counts, block.history, block.suffix, strict=False):
            share = weight * below / (below + 1)
            self.fail.append(np.log10(1 - share))
            probability = share[history] * count / np.maximum(below[history], 1) + (1 - share[history]) * probability[suffix]
            self.arcs.append(np.log10(probability))

    def traverse(self, block: Block) -> np.ndarray:
        """Log probability of each token, left to right; those of start marks are zero.

        A token's state is the longest history before it that training has seen, and a failure arc depends on the state
        alone, so all positions are moved at once: one step for each failure arc of the longest chain.
        """
        weights = np.zeros(len(block.tokens))
        waiting = np.flatnonzero(block.tokens != block.start)
        for n in range(len(self.arcs), 0, -1):
            place = block.places[n][waiting]
            long = place >= 0  # near its start a text has no such history
            at, arc = waiting[long], place[long]
            has = self.seen[n - 1][arc]
            weights[at[has]] += self.arcs[n - 1][arc[has]]
            weights[at[~has]] += self.fail[n - 1][block.history[n - 1][arc[~has]]]
            left = np.ones(len(waiting), dtype=bool)
            left[np.flatnonzero(long)[has]] = False
            waiting = waiting[left]
        weights[waiting] += self.root[block.tokens[waiting]]
        return weights


def score_block(texts: pa.Table, replies: pa.Table, tokens: int, types: int, singles: int, weights: tuple[float, ...]) -> pa.Table:
    """Scores of a block's documents from the totals of its n-grams."""
    row = texts.slice(0, 1).to_pylist()[0]
    order = len(weights) + 1
    numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), "<i4")
    held = np.array(row["held_out"], dtype=bool)
    block = Block(numbers, unpacked(row["keys"]), np.array(row["lengths"], np.int64), ~held, order)
    counts = []
    for n, found in enumerate(joined_totals(replies, [len(k) for k in block.keys])):
        count = np.empty(len(found), np.int64)
        count[block.sorted_keys(n + 1)[0]] = found
        counts.append(count)
    automaton = Automaton(block, counts, tokens, singles, weights)
    inner = numbers != block.start
    base = np.where(inner, np.log10((counts[0][numbers] + 1) / (tokens + types + 1)), 0.0)
    starts = np.cumsum(block.lengths) - block.lengths
    sums = [np.add.reduceat(v, starts) for v in (automaton.traverse(block), base, ((counts[0][numbers] > 0) & inner).astype(np.int64))]
    columns = [row["doc_ids"], held, block.lengths - 1, sums[2], np.full(len(held), tokens), sums[1], sums[0]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, SCORE_SCHEMA.types, strict=True)], schema=SCORE_SCHEMA)


def lm_scores(
    docs: DataFrame,
    modulus: int = 7,
    held_out: int = 2,
    weights: tuple[float, ...] = (0.2, 0.6),
    block_bytes: int = 8 << 20,
    bucket_bytes: int = 8 << 20,
    max_fan: int = 128,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per document.

    Learns n-grams of the order ``len(weights) + 1`` from the documents whose crc32(doc_id as text) mod ``modulus`` is not
    ``held_out`` and scores all. Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lower-cased, then one end.
    Null and empty texts are the end alone; a null doc_id counts as the empty text in the crc; repeated rows count and are
    scored once each; an empty table gives no rows; other columns are left out.

    No table of n-grams is broadcast or collected, and texts are not shuffled. Each task cuts its documents into blocks of
    ``block_bytes`` of text. A block's distinct n-grams with counts go to key ranges, as many as the corpus has
    ``bucket_bytes``, by the hops of :class:`Levels`: one up to ``max_fan`` ranges (1 GB), two up to their square (128 GB), three up to
    16 TB. Totals come back the same way, and the block, now sent as numbers, builds the part of the automaton that its texts
    reach. Rows are at most ``max_fan`` a member and hop, so they grow with the text; a frequent n-gram is one entry a member, so no
    group grows with its frequency. Rows must come in the same order when read again, as files do; else the job fails.
    """
    order = len(weights) + 1
    whole = documents(docs).withColumn("held_out", crc_bucket("doc_id", modulus) == held_out)
    size = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    levels = Levels(math.ceil(size / bucket_bytes), max_fan)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        weight = 0
        for part in portions(batches, "text", size=1 << 20, max_bytes=block_bytes):
            more = part.column("text").nbytes
            if held and weight + more > block_bytes:
                yield number, pa.Table.from_batches(held)
                number, held, weight = number + 1, [], 0
            held.append(part)
            weight += more
        if held:
            yield number, pa.Table.from_batches(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in blocks(batches):
            train = ~table.column("held_out").to_numpy()
            tokens, keys, lengths = numbered_words(table.column("text").to_pylist())
            block = Block(tokens, keys, lengths, train, order)
            found = []
            for n in range(1, order + 1):
                by_key, ordered = block.sorted_keys(n)
                found.append((ordered, block.counts[n - 1][by_key]))
            for row in levels.rows(1, number, 0, found):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, COUNT_SCHEMA.types, strict=True)], schema=COUNT_SCHEMA)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in blocks(batches):
            tokens, keys, lengths = numbered_words(table.column("text").to_pylist())
            row = (
                number, table.column("doc_id").to_pylist(), table.column("held_out").to_pylist(), lengths.tolist(),
                zstandard.ZstdCompressor(level=1).compress(tokens.astype("<i4").tobytes()), packed(keys),
            )
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK_SCHEMA.types, strict=True)], schema=BLOCK_SCHEMA)

    def onward(level: int):
        def forward(key: tuple, table: pa.Table) -> pa.Table:
            bundle, bucket = (k.as_py() for k in key)
            rows = levels.rows(level, bundle, bucket, [(keys, total) for keys, total, _, _ in merged(table)])
            columns = list(zip(*rows, strict=True)) or [()] * len(COUNT_SCHEMA)
            return pa.table([pa.array(c, t) for c, t in zip(columns, COUNT_SCHEMA.types, strict=True)], schema=COUNT_SCHEMA)

        return forward

    def total(key: tuple, table: pa.Table) -> pa.Table:
        return total_bucket(table)

    def back(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return passed_on(table, answers)

    sent = whole.mapInArrow(count, COUNT_DDL)
    held = []
    for level in range(2, levels.depth + 1):
        held.append(materialise(sent, "n-grams-sent"))
        sent = held[-1].groupBy("bundle", "bucket").applyInArrow(onward(level), COUNT_DDL)
    replies = materialise(sent.groupBy("bundle", "bucket").applyInArrow(total, REPLY_DDL), "n-grams")
    tokens, types, singles = (v or 0 for v in replies.where("member = -1").agg(*(F.sum(c) for c in ("tokens", "types", "singles"))).first())
    for below in reversed(held):  # an answer's range lies in the range of the group that asked
        above = replies.where("member >= 0").withColumn("range", F.expr(f"bucket div {levels.fan}"))
        groups = below.groupBy("bundle", "bucket").cogroup(above.groupBy("member", "range"))
        answered = materialise(groups.applyInArrow(back, REPLY_DDL), "n-grams")
        discard(below, replies)
        replies = answered

    def score(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            raise RuntimeError("the documents have changed since their n-grams were counted")
        return score_block(texts, answers, tokens, types, singles, weights)

    packs = whole.mapInArrow(pack, BLOCK_DDL)
    return packs.groupBy("block").cogroup(replies.where("member >= 0").groupBy("member")).applyInArrow(score, SCORE_DDL)
