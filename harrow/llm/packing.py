"""Sum-of-squares online packing of token sequences into windows of fixed length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from harrow.llm.common import batched, documents, rows
from harrow.llm.word_tokens import word_tokens

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int | None, int, bytes, int]  # doc_id, start, ids, doc_tokens


class Windows:
    """Partly filled windows of one task by fill level, and the level array that steers the choice.

    ``count[h]`` windows are filled to level h. A piece of length s goes to the level h (0: a new window)
    that makes the sum of squared counts smallest; full windows no longer count. Ties go to the fullest
    level. At most ``max_open`` windows stay open. Beyond that, and at the end, windows keep what the rule gave them and
    are filled up, the fullest first, with ids cut from the emptiest ones; what then remains is cut into powers of two,
    which need no padding. So memory is bounded, no id is dropped, and only as many ids move as the gaps hold (``moved``).
    """

    def __init__(self, capacity: int, first_id: int, max_open: int):
        self.capacity, self.next_id, self.max_open = capacity, first_id, max_open
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.n_open = self.moved = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        tokens, at = len(ids) // 4, 0
        while tokens - at >= self.capacity:
            yield from self.close([(doc_id, at, ids[4 * at : 4 * (at + self.capacity)], tokens)])
            at += self.capacity
        if at < tokens:
            yield from self.place((doc_id, at, ids[4 * at :], tokens))

    def place(self, piece: Piece) -> Iterator[tuple]:
        size, count, top = len(piece[2]) // 4, self.count, self.capacity
        # Change of the sum of squares for levels 1 .. capacity - size; a full window leaves the sum.
        change = 2 * (count[1 + size : top + 1] - count[1 : top - size + 1]) + 2
        change[-1:] -= 1
        change[count[1 : top - size + 1] == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1
        if best >= 0 and change[best] <= 2 * count[size] + 1:
            level = best + 1
            window = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            level, window = 0, []
        window.append(piece)
        level += size
        if level == top:
            yield from self.close(window)
            return
        self.open[level].append(window)
        self.count[level] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            yield from self.flush()

    def close(self, window: list[Piece]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, tokens in window:
            yield doc_id, start, len(ids) // 4, ids, tokens, self.next_id, offset
            offset += len(ids) // 4
        self.next_id += 1

    def flush(self) -> Iterator[tuple]:
        windows = [w for level in reversed(self.open) for w in level]  # the fullest first
        self.open = [[] for _ in range(self.capacity)]
        self.count[:] = 0
        self.n_open = 0
        first, last = 0, len(windows) - 1
        while first < last:
            window = windows[first]
            gap = self.capacity - sum(len(p[2]) for p in window) // 4
            while gap and first < last:
                doc_id, start, ids, tokens = windows[last].pop()
                keep = max(0, len(ids) // 4 - gap)
                window.append((doc_id, start + keep, ids[4 * keep :], tokens))
                moved = len(ids) // 4 - keep
                gap, self.moved = gap - moved, self.moved + moved
                if keep:
                    windows[last].append((doc_id, start, ids[: 4 * keep], tokens))
                elif not windows[last]:
                    last -= 1
            if gap:
                break
            yield from self.close(window)
            first += 1
        yield from self.in_powers(windows[first] if first <= last else [])

    def in_powers(self, window: list[Piece]) -> Iterator[tuple]:
        """The last window's pieces in sequences of powers of two."""
        rest, room, held = sum(len(p[2]) for p in window) // 4, 0, []
        for doc_id, start, ids, tokens in window:
            while ids:
                if not room:
                    room = 1 << (rest.bit_length() - 1)
                part, ids = ids[: 4 * room], ids[4 * room :]
                size = len(part) // 4
                held.append((doc_id, start, part, tokens))
                start, room, rest = start + size, room - size, rest - size
                if not room:
                    yield from self.close(held)
                    held = []


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, max_open: int = 4096) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` tokens.

    Each task packs its own partition online, in one pass and without a shuffle; sequences of different
    tasks have different ids (task number, then a running number). A document's ids are cut at multiples of
    ``capacity``; its rest is placed by the sum-of-squares rule, see :class:`Windows`.

    Null and empty texts have the end id alone. Repeated rows are packed once each. A null doc_id is kept.
    An empty table gives no rows. Other columns are left out. Texts of any length are packed whole.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode: Callable[[str], bytes] = word_tokens(tokenizer_file).encode
        windows = Windows(capacity, TaskContext.get().partitionId() << 40, max_open)

        def pieces() -> Iterator[tuple]:
            for doc_id, text in rows(batches, "doc_id", "text"):
                yield from windows.add(doc_id, encode(text) + end)
            yield from windows.flush()

        return batched(pieces(), SCHEMA)

    return documents(docs).mapInArrow(run, DDL)
