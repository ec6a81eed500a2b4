"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import batched, portions, rows, worker_memory

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: First code point of each script range and its name (fixed values of the Unicode blocks).
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1300, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1900, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFDD, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
_STARTS = [start for start, _ in SCRIPT_RANGES]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})


def script_of(word: str) -> str:
    """Script of most letters of a word; ties go to the one that comes first in the word."""
    if word.isascii() or max(word) < "\u0370":
        return "Latin"
    return Counter(SCRIPT_RANGES[bisect_right(_STARTS, ord(c)) - 1][1] for c in word).most_common(1)[0][0]


def features(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character bigrams and trigrams of lower-case words with a mark at each end.

    Two arrays of features by position of all words laid end to end (-1 where a word ends), and each word's start.
    """
    codes = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))  # characters to the word's end
    second, third = (np.concatenate((codes[i:], np.zeros(i, np.uint64))) for i in (1, 2))
    pair = codes * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    triple = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + third * np.uint64(0x94D049BB133111EB)
    hashed = [((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64) for h in (pair, triple)]
    return np.where(left > 1, hashed[0], -1), np.where(left > 2, hashed[1], -1), starts


@dataclass
class LanguageModel:
    """Log probabilities of hashed features by language, and the scripts that each language is written in.

    Its size is bounded by languages x features, whatever the corpus: a quarter of a megabyte for each language.
    """

    languages: list[str]
    weights: np.ndarray  # features x languages
    scripts: dict[str, np.ndarray] = field(default_factory=dict)  # script -> mask of languages
    penalty: float = 12.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        self.size = len(self.weights)
        self.weights = np.vstack([self.weights, np.zeros((1, len(self.languages)))]).astype(np.float32)  # row -1 for no feature

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each letter run by language, less the best; scripts that a language isn't written in cost more."""
        pairs, triples, starts = features(words, self.size)
        own = np.add.reduceat(self.weights[pairs] + self.weights[triples], starts, axis=0) / 2
        for name in {script_of(w) for w in words}:
            mask = self.scripts.get(name)
            if mask is not None and not mask.all():
                some = np.array([script_of(w) == name for w in words])
                own[np.ix_(some, ~mask)] = own[some].min(axis=1, keepdims=True) - 2 * self.penalty
        return own - own.max(axis=1, keepdims=True)


def train(
    labelled: DataFrame, size: int = 1 << 16, max_documents: int = 20_000, smoothing: float = 0.5, min_script_share: float = 0.01, max_languages: int = 400
) -> LanguageModel:
    """A model from text and lang of ``labelled``; rows without lang or text are left out.

    At most about ``max_documents`` documents are read per language: where there are more, a share of them chosen by
    the hash of their text, whole texts. Executors count features; the driver gets their sums, which are bounded by
    languages x (``size`` + scripts); more than ``max_languages`` different values of lang are an error, as the model is
    sent to every worker. A table without labelled rows gives a model that knows no language.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    languages = sorted(sizes)
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not languages:
        return LanguageModel([], np.zeros((size, 0)))
    share = F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, max_documents / n))))
    chosen = usable.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    schema = pa.schema([("lang", pa.string()), ("feature", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def add_up() -> None:
            for lang, found in words.items():
                total = sums.setdefault(lang, np.zeros(size + len(SCRIPTS), dtype=np.int64))
                known = list(found)
                for at in range(0, len(known), 10_000):
                    part = known[at : at + 10_000]
                    n = np.fromiter((found[w] for w in part), np.int64, len(part))
                    *grams, starts = features(part, size)
                    each = np.repeat(n, np.diff(np.append(starts, len(grams[0]))))
                    for gram in grams:
                        total[:size] += np.bincount(gram[gram >= 0], each[gram >= 0], size).astype(np.int64)
                for word, n in found.items():
                    total[size + SCRIPTS.index(script_of(word))] += n * len(word)
            words.clear()

        for part in portions(batches, "text"):
            for lang, text in rows([part], "lang", "text"):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, words.values())) > 100_000:
                add_up()
        add_up()
        return batched(((lang, int(i), int(v[i])) for lang, v in sums.items() for i in np.flatnonzero(v)), schema)

    summed = chosen.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = np.zeros((size + len(SCRIPTS), len(languages)))
    for r in summed.toLocalIterator():
        counts[r["feature"], languages.index(r["lang"])] = r["n"]
    grams, letters = counts[:size], counts[size:]
    weights = np.log((grams + smoothing) / (grams.sum(axis=0) + smoothing * size))
    shares = letters / np.maximum(letters.sum(axis=0), 1)
    scripts = {name: shares[i] >= min_script_share for i, name in enumerate(SCRIPTS) if (shares[i] >= min_script_share).any()}
    return LanguageModel(languages, weights, scripts)


class WordScores(dict):
    """Maps a white-space delimited word to a row of ``scores`` (languages) and ``letters``.

    It is emptied when it holds ``max_words`` words or ``max_bytes`` of them.
    """

    def __init__(self, model: LanguageModel, max_words: int = 200_000, max_bytes: int = 16 << 20):
        super().__init__()
        self.model, self.max_words, self.max_bytes, self.held_bytes = model, max_words, max_bytes, 0
        self.scores = np.zeros((max_words, len(model.languages)), dtype=np.float32)
        self.letters = np.zeros(max_words, dtype=np.int32)

    def learn(self, new: list[str]) -> None:
        """Score words not seen before, all at once; there must be room for them.

        A word's scores are sums over its runs of letters, relative to its best language and no lower than twice
        the penalty: a single odd word (a name, an address) costs no more than two changes of language.
        """
        first = len(self)
        self.update(zip(new, range(first, first + len(new)), strict=True))
        self.held_bytes += sum(map(len, new))
        found = [LETTERS.findall(w) for w in new]
        parts = [p for some in found for p in some]
        if parts and self.model.languages:
            owner = np.repeat(np.arange(len(new)), np.fromiter(map(len, found), np.int64, len(new)))
            score = np.zeros((len(new), len(self.model.languages)), dtype=np.float32)
            np.add.at(score, owner, self.model.word_scores(parts))
            self.scores[first : first + len(new)] = np.maximum(score, -2 * self.model.penalty)
            self.letters[first : first + len(new)] = np.bincount(owner, np.fromiter(map(len, parts), np.int64, len(parts)), len(new))
        else:
            self.scores[first : first + len(new)] = 0
            self.letters[first : first + len(new)] = 0

    def of(self, words: list[str], part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language and number of letters of each word, looked up in parts that there is always room for."""
        scores, letters = [np.zeros((0, self.scores.shape[1]), np.float32)], [np.zeros(0, np.int32)]
        for at in range(0, len(words), part):
            some = words[at : at + part]
            rows_ = np.fromiter(map(self.get, some, repeat(-1)), np.int64, len(some))
            missing = np.flatnonzero(rows_ < 0)
            if len(missing):
                new = {some[i] for i in missing.tolist()}
                if len(self) + len(new) > self.max_words or self.held_bytes > self.max_bytes:
                    self.clear()
                    self.held_bytes = 0
                    new, missing = set(some), np.arange(len(some))
                self.learn(list(new))
                rows_[missing] = [self[some[i]] for i in missing.tolist()]
            scores.append(self.scores[rows_])
            letters.append(self.letters[rows_])
        return np.concatenate(scores), np.concatenate(letters)


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Language number of each word: the path with the largest sum of scores less ``penalty`` per change (Viterbi)."""
    n, k = scores.shape
    total = scores.sum(axis=0, dtype=np.float64)
    top = int(total.argmax())
    if np.maximum(scores - scores[:, top : top + 1], 0).sum(axis=0).max() <= penalty / 2:
        return np.full(n, top)
    lead = np.cumsum(scores - scores[:, top : top + 1], axis=0, dtype=np.float64)
    floor = np.minimum(np.minimum.accumulate(lead, axis=0), 0)
    if (lead - floor).max() <= penalty / 2:  # no stretch gains enough to pay for leaving the best single language
        return np.full(n, top)
    sums = [scores[0].tolist()]
    for row in scores[1:].tolist():
        best = sums[-1]
        least = max(best) - penalty
        sums.append([(b if b >= least else least) + x for b, x in zip(best, row, strict=True)])
    state = sums[-1].index(max(sums[-1]))
    path = [state]
    for best in reversed(sums[:-1]):
        top_sum = max(best)
        if best[state] < top_sum - penalty:
            state = best.index(top_sum)
        path.append(state)
    return np.array(path[::-1])


def label(words: list[str], scores: np.ndarray, letters: np.ndarray, model: LanguageModel) -> tuple[str, float, list[dict]]:
    """Language of a text, its share of the text's letters, and the labelled spans (first word, words, lang)."""
    if not model.languages or not letters.any():
        return UNKNOWN, 0.0, []
    path = best_path(scores, model.penalty)
    weight = np.bincount(path, letters, len(model.languages))
    top = int(weight.argmax())
    cuts = np.flatnonzero(np.diff(path)) + 1
    starts = np.concatenate(([0], cuts)).tolist()
    spans = [{"first_word": a, "words": b - a, "lang": model.languages[path[a]]} for a, b in zip(starts, [*starts[1:], len(words)], strict=True)]
    return model.languages[top], float(weight[top] / weight.sum()), spans


def label_texts(texts: list[str | None], known: WordScores) -> Iterator[tuple[str, float, list[dict]]]:
    """Labels of texts; their words are looked up together."""
    split = [text.lower().split() if text else [] for text in texts]
    scores, letters = known.of([w for words in split for w in words])
    at = 0
    for words in split:
        end = at + len(words)
        yield label(words, scores[at:end], letters[at:end], known.model)
        at = end


SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
LABEL = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", SPANS)])
LABEL_DDL = "struct<lang_pred:string,score:double,spans:array<struct<first_word:int,words:int,lang:string>>>"


def identify(docs: DataFrame, model: LanguageModel, into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang_pred, score (0 to 1) and spans; a narrow map, no shuffle.

    Only the text is read for the prediction. Null, empty and letterless texts get ``und``, score 0 and no spans.
    All rows and columns stay, repeated ones too; a column already named ``into`` is replaced. Ties go to the
    language that is first in the alphabet. An empty table gives no rows; whole texts are read.
    """
    docs = docs.drop(into)
    schema = docs.schema
    ddl = f"{into} {LABEL_DDL}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_memory(("language", model.key), lambda: WordScores(model))
        for batch in portions(batches, "text", size=200):
            labels = label_texts(batch.column("text").to_pylist(), known)
            found = [{"lang_pred": lang, "score": score, "spans": spans} for lang, score, spans in labels]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, LABEL)], names=[*batch.schema.names, into])

    from pyspark.sql.types import StructType

    out = StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
    return docs.mapInArrow(run, out)


def training_rows(docs: DataFrame, bucket: Column, held_out: int) -> DataFrame:
    """The rows to learn from: all but those whose ``bucket`` is ``held_out``."""
    return docs.where(bucket != held_out)
