"""Token ids of the lower-casing word BPE vocabulary, word by word with a bounded memory of words seen."""

from __future__ import annotations

import os
import re
from array import array

from harrow.llm.bpe import byte_alphabet
from harrow.llm.common import Frequent, worker_memory

#: Splits a lower-case word of printable ASCII and accented Latin letters as the vocabulary file's own pattern
#: does; fixed by the vocabulary.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+|[0-9]|[^a-z0-9\u00df-\u017e]+")
#: Words that this pattern covers: composed letters only, each with a lower-case form of one letter.
PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")


class WordTokens(Frequent):
    """Maps a white-space delimited word (UTF-8) to its ids as little-endian unsigned 32-bit integers.

    No token spans white space and normalisation works inside a word, so a text's ids are those of its
    words in a row. Words of printable ASCII and accented Latin letters are cut into pieces that the BPE model
    encodes; every other word goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str, max_bytes: int = 64 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(max_bytes)
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.byte_names = {byte: name for name, byte in byte_alphabet().items()}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if "<|" not in text and PLAIN.fullmatch(text):
            tokenize, named = self.model.tokenize, self._named
            ids = array("I", [t.id for p in PIECES.findall(text.lower()) for t in tokenize(p if p.isascii() else named(p))]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.remember(word, ids, len(ids))

    def _named(self, piece: str) -> str:
        """A piece's bytes as the vocabulary writes them."""
        return piece.encode().decode("latin-1").translate(self.byte_names)

    def encode(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "replace")
        if b"<|" not in data:  # special tokens are looked for in the text as it is, before its case is folded
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))


def word_tokens(tokenizer_file: str) -> WordTokens:
    """One per Python worker and file; its memory of words serves later tasks of the worker too."""
    return worker_memory(("word tokens", tokenizer_file), lambda: WordTokens(tokenizer_file))
