"""Token counts at every prefix of a text, by dynamic programming over its bytes, and what they answer without encoding again."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.bpe import byte_alphabet, forced_cuts
from harrow.llm.common import Frequent, documents, portions, worker_memory

COUNTED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("fitting_chars", pa.int64())])
COUNTED_DDL = "doc_id long, n_bytes long, n_tokens long, fitting_chars long"
STORED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("steps", pa.binary())])
STORED_DDL = "doc_id long, n_bytes long, n_tokens long, steps binary"

#: What a contraction's piece may be, in the splitting pattern of byte-level vocabularies; fixed by the pattern.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
#: White space as that pattern's ``\\s`` has it; fixed by Unicode.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: A word of ASCII letters, which that pattern never splits.
WORD = re.compile(b" ?[A-Za-z]+")


class PrefixCounts(Frequent):
    """Maps a fragment between two forced boundaries (UTF-8) to the change of the token count with each of its characters.

    A prefix of a piece has one encoding, and it ends with the one token t such that the encoding of what is before t ends
    with a token u for which the pair u, t encodes to itself. So with the count and last token of every shorter prefix at
    hand, the next prefix is found by trying the vocabulary's tokens that end there, and count = count before t + 1.

    Changes are signed bytes: a character may join up to all tokens of a piece into one, and no token is longer than 128
    bytes. A change at a text's character depends on its fragment alone, so a text's changes are those of its fragments
    in a row. Fragments that a text's end cuts off have the same changes up to there.
    """

    #: Pairs of tokens that are held with whether they stay two; about 100 bytes each.
    MOST_PAIRS = 250_000
    #: Different changes of a fragment that are held.
    MOST_SHARED = 50_000

    def __init__(self, tokenizer_file: str, max_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        super().__init__(max_bytes)
        tokenizer = Tokenizer.from_file(tokenizer_file)
        self.split, self.model = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model
        with open(tokenizer_file, encoding="utf-8") as f:
            parts = json.load(f)
        added = parts["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added) or parts["normalizer"]:
            raise ValueError("a vocabulary with plain added tokens and without a normaliser is needed")
        special = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        alphabet = byte_alphabet()
        plain = {t: i for t, i in parts["model"]["vocab"].items() if t not in {a["content"] for a in added}}
        self.cut = forced_cuts([bytes(alphabet[c] for c in t) for t in plain]).reshape(-1)
        #: Tokens that encode to themselves; no other is ever the last one of an encoding.
        self.tokens = {t: i for t, i in plain.items() if [x.id for x in self.model.tokenize(t)] == [i]}
        self.endings = {t[i:] for t in self.tokens for i in range(len(t))}
        if max(map(len, self.tokens)) > 128:
            raise ValueError("no token may be longer than 128 bytes")
        self.pairs: dict[int, bool] = {}
        self.shared: dict[bytes, bytes] = {}
        self.space = next(c for c, b in alphabet.items() if b == 0x20)

    def follows(self, before: str, token: str) -> bool:
        """Whether two tokens in a row stay two tokens."""
        pair = self.tokens[before] << 32 | self.tokens[token]
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= self.MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = [x.id for x in self.model.tokenize(before + token)] == [self.tokens[before], self.tokens[token]]
        return known

    def of_piece(self, piece: str) -> list[int]:
        """Token count of every prefix of a piece, the empty one included; bytes are written as the vocabulary writes them."""
        tokens, endings = self.tokens, self.endings
        counts, last = [0], [""]
        for end in range(1, len(piece) + 1):
            token = piece[:end]
            if token not in tokens:
                found = []
                for start in range(end - 1, 0, -1):
                    token = piece[start:end]
                    if token not in endings:
                        break
                    if token in tokens and last[start] + token not in tokens:
                        found.append(token)
                token = found.pop()
                while found and not self.follows(last[end - len(token)], token):  # the last one left needs no proof
                    token = found.pop()
            counts.append(counts[end - len(token)] + 1)
            last.append(token)
        return counts

    def __missing__(self, fragment: bytes) -> bytes:
        """Changes of a fragment's pieces in a row, as the vocabulary's pattern splits it.

        Two prefixes are split in another way than the whole: white space before a word gives its last character away, to
        the word or as a piece of its own, but is one piece while the text ends there; and a contraction of three
        characters is two pieces until its third.
        """
        if WORD.fullmatch(fragment):  # one piece, a byte a character
            counts = self.of_piece(fragment.decode().replace(" ", self.space))
            return self.keep(fragment, bytes([b - a & 255 for a, b in pairwise(counts)]))
        text = fragment.decode("utf-8", "replace")
        counts, before, blank = [0], 0, None
        for piece, (start, end) in self.split(text):
            own = self.of_piece(piece)
            here = [before + n for n in own[1:]]
            if blank is not None and WHITE.fullmatch(text[start]):
                run, count = blank
                width = len(text[start].encode())
                here[width - 1] = count + self.of_piece(run + piece[:width])[-1]
            if text[start:end] in LONG_CONTRACTIONS:
                here[1] = before + self.of_piece(piece[0])[-1] + self.of_piece(piece[1])[-1]
            blank = (piece, before) if WHITE.fullmatch(text[start:end]) else None
            counts += here
            before += own[-1]
        at, steps = 0, []
        for c in text:
            end = at + (1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4)
            steps.append(counts[end] - counts[at] & 255)
            at = end
        return self.keep(fragment, bytes(steps))

    def keep(self, fragment: bytes, steps: bytes) -> bytes:
        """Many fragments have the same changes; these are held once."""
        if len(self.shared) >= self.MOST_SHARED:
            self.shared.clear()
        return self.remember(fragment, self.shared.setdefault(steps, steps))

    @staticmethod
    def size_of(value: bytes) -> int:
        return 0

    def steps(self, data: bytes) -> bytes:
        """Change of the token count with each character of a text (UTF-8).

        Strings of added tokens are looked for before all else and are one token; what is before and after them is
        encoded apart, and a prefix that ends in the middle of one is ordinary text.
        """
        parts, at = [], 0
        for found in self.special.finditer(data) if self.special else ():
            open_ = self._plain(data[at : found.end() - 1])
            parts.append(open_)
            closed = total(self._plain(data[at : found.start()])) + 1 - total(open_)
            parts.append(np.int8(closed).tobytes())
            at = found.end()
        parts.append(self._plain(data[at:]))
        return b"".join(parts)

    def _plain(self, data: bytes) -> bytes:
        codes = np.frombuffer(data, dtype=np.uint8)
        pairs = codes[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= codes[1:]
        cuts = (np.flatnonzero(self.cut[pairs]) + 1).tolist()
        return b"".join([self[data[i:j]] for i, j in zip([0, *cuts], [*cuts, len(data)], strict=True)]) if data else b""


def total(steps: bytes) -> int:
    """Tokens of a whole text from its changes."""
    return int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))


def longest_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens; -1 for a budget below zero.

    A longer prefix may have fewer tokens, so the last such prefix is taken, not the first that is over.
    """
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0 if budget >= 0 else -1


def prefix_counts(tokenizer_file: str) -> PrefixCounts:
    """One per Python worker and file."""
    return worker_memory(("prefix counts", tokenizer_file), lambda: PrefixCounts(tokenizer_file))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """doc_ids and texts (UTF-8) of a few rows at a time."""
    for part in portions(batches, "text"):
        yield part.column("doc_id"), pc.cast(part.column("text"), pa.binary()).to_pylist()


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and fitting_chars, one row per document: its length in UTF-8, the tokens of its whole text, and
    the characters of the longest prefix of at most ``limit`` tokens (all of them if the text is within the limit).

    A narrow map without a shuffle; the counts of all prefixes are worked out and read off in the same task. Null and empty
    texts have no tokens. Strings of added tokens inside a text count as that token, as the library does by default.
    Repeated rows are counted once each; a null doc_id is kept; an empty table gives no rows; other columns are left out;
    texts of any length are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = prefix_counts(tokenizer_file)
        for ids, texts in _texts(batches):
            steps = [counts.steps(t) for t in texts]
            columns = [ids, pa.array(map(len, texts), pa.int64()), pa.array(map(total, steps), pa.int64()), pa.array((longest_prefix(s, limit) for s in steps), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=COUNTED_SCHEMA)

    return documents(docs).mapInArrow(run, COUNTED_DDL)


def stored_counts(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and steps, one row per document: the table that later questions are asked of.

    ``steps`` has a signed byte for each character of the text, by which the token count changes with it; so the count at
    every prefix is a running sum, in a byte a character. Nulls, empty and very long texts, repeats, empty tables and other
    columns are as in :func:`token_counts`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = prefix_counts(tokenizer_file)
        for ids, texts in _texts(batches):
            steps = [counts.steps(t) for t in texts]
            columns = [ids, pa.array(map(len, texts), pa.int64()), pa.array(map(total, steps), pa.int64()), pa.array(steps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=STORED_SCHEMA)

    return documents(docs).mapInArrow(run, STORED_DDL)


def _answered(stored: DataFrame, asked: Column, answer, into: str) -> DataFrame:  # noqa: ANN001
    """``stored`` without its steps, with the answer to a whole number for each row; null for a null."""
    kept = [c for c in stored.columns if c not in ("steps", into)]
    table = stored.select(*kept, "steps", asked.cast("long").alias(into))
    schema = table.drop("steps").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                pairs = zip(part.column("steps").to_pylist(), part.column(into).to_pylist(), strict=True)
                answers = pa.array([None if s is None or n is None else answer(s, n) for s, n in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), answers], names=[*kept, into])

    return table.mapInArrow(run, schema)


def truncations(stored: DataFrame, budget: Column | int, into: str = "fitting_chars") -> DataFrame:
    """Rows of :func:`stored_counts` without steps, and in ``into`` the characters of the longest prefix within ``budget`` tokens.

    The budget may be a column of the table; null for a null one, -1 below zero. No text is read or encoded.
    """
    return _answered(stored, F.lit(budget) if isinstance(budget, int) else budget, longest_prefix, into)


def prefix_tokens(stored: DataFrame, chars: Column | int, into: str = "prefix_tokens") -> DataFrame:
    """Rows of :func:`stored_counts` without steps, and in ``into`` the tokens of the prefix of so many characters.

    More characters than the text has give the whole text's tokens, less than one gives 0, null gives null.
    """
    return _answered(stored, F.lit(chars) if isinstance(chars, int) else chars, lambda steps, n: total(steps[: max(n, 0)]), into)
