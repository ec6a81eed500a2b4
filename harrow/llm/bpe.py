"""Byte-level BPE encoding by forced boundaries, and decoding."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from harrow.llm.common import Memory, batched, documents, rows, worker_memory

SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DDL = "doc_id long, ids binary, decoded string"

BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
WORDLIKE = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def forced_cuts(tokens: list[bytes]) -> np.ndarray:
    """256 x 256 table: True where a text may be cut between two bytes without changing its encoding.

    The base is the pairs that occur inside no token: no merge ever joins them. Since the splitter in front of
    the merges looks at its neighbourhood, a pair also has to be a place where it starts anew whatever follows:
    between characters, not after white space (its look-ahead), not before an apostrophe that follows another
    mark (contractions), and after bytes beyond ASCII, whose character class the byte does not tell, only
    before white space.
    """
    inside = np.zeros((256, 256), dtype=bool)
    for token in tokens:
        codes = np.frombuffer(token, dtype=np.uint8)
        inside[codes[:-1], codes[1:]] = True
    left, right = np.arange(256)[:, None], np.arange(256)[None, :]
    character_start = (right < 0x80) | (right >= 0xC0)
    sound = np.where(left >= 0x80, BLANK[right], ~BLANK[left] & character_start)
    apostrophe = (right == 0x27) & ~WORDLIKE[left] & (left < 0x80)
    # A control character or mark before a letter or digit may be part of a contraction only as "'".
    return ~inside & sound & ~apostrophe & ~((left == 0x27) & ~BLANK[right])


class ForcedBoundaryBPE(Memory):
    """Maps a fragment between two forced boundaries to its ids (little-endian unsigned 32-bit); bounded memory."""

    def __init__(self, tokenizer_file: str, max_bytes: int = 96 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(max_bytes)
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(tokenizer_file, encoding="utf-8") as f:
            parts = json.load(f)
        alphabet = byte_alphabet()
        added = {t["id"]: t["content"] for t in parts["added_tokens"]}
        plain = {i: bytes(alphabet[c] for c in t) for t, i in parts["model"]["vocab"].items() if i not in added}
        self.special = sorted((t.encode() for t in added.values()), key=len, reverse=True)
        self.token_bytes = [b""] * (max([*plain, *added]) + 1)
        for i, token in (plain | {i: t.encode() for i, t in added.items()}).items():
            self.token_bytes[i] = token
        self.cut = forced_cuts(list(plain.values())).reshape(-1)

    def __missing__(self, fragment: bytes) -> bytes:
        ids = array("I", self.tokenizer.encode(fragment.decode(), add_special_tokens=False).ids).tobytes()
        return self.remember(fragment, ids, len(ids))

    def encode(self, text: str) -> bytes:
        data = text.encode("utf-8", "replace")
        if any(s in data for s in self.special):  # the library looks for these before all else
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        codes = np.frombuffer(data, dtype=np.uint8)
        pairs = codes[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= codes[1:]
        cuts = (np.flatnonzero(self.cut[pairs]) + 1).tolist()
        return b"".join([self[data[i:j]] for i, j in zip([0, *cuts], [*cuts, len(data)], strict=True)])

    def decode(self, ids: bytes) -> str:
        token_bytes = self.token_bytes
        return b"".join([token_bytes[i] for i in array("I", ids)]).decode("utf-8", "replace")


def forced_boundary_bpe(tokenizer_file: str) -> ForcedBoundaryBPE:
    """One per Python worker and file."""
    return worker_memory(("forced boundaries", tokenizer_file), lambda: ForcedBoundaryBPE(tokenizer_file))


def encode_decode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the text decoded from them, one row per document.

    A narrow map without a shuffle. Null and empty texts have no ids and decode to the empty text. Texts that
    hold a special token's string are encoded in one piece by the library, as it treats that string first.
    Repeated rows are encoded once each; a null doc_id is kept; an empty table gives no rows; other columns are
    left out; texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = forced_boundary_bpe(tokenizer_file)

        def out() -> Iterator[tuple]:
            for doc_id, text in rows(batches, "doc_id", "text"):
                ids = bpe.encode(text)
                yield doc_id, ids, bpe.decode(ids)

        return batched(out(), SCHEMA)

    return documents(docs).mapInArrow(run, DDL)
