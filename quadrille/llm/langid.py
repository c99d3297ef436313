"""Language identification by unigrams of pieces, summed over all segmentations.

The vocabulary is fixed and public; for each language the pieces' probabilities are learned from labelled texts. A word's
probability in a language is the sum over all its segmentations into pieces of the products of their probabilities, by
a forward algorithm; a text's is the product over its words. Prediction reads the text alone.
Training uses at most about TRAIN_DOCS documents a language, those of smallest hash; the model's size is vocabulary times
languages, whatever the input.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import col, staged, table
from quadrille.llm.tokens import public_path

VOCABULARY = "piece_bpe_32k.model"
TRAIN_DOCS = 2000
SMOOTHING = 0.1
CHAR_FLOOR = 1e-8
MAX_PIECE = 16
BATCHED = 24
CACHED_WORDS = 300_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of letters, by id; others are the empty string."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [p if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and len(p) <= MAX_PIECE else "" for i, p in enumerate(out)]


def piece_counts(train: DataFrame, path: str) -> DataFrame:
    """lang, piece, n over (lang, text) rows: the vocabulary's own segmentation gives the first counts."""

    def run(batches):
        import sentencepiece

        sp, counts = sentencepiece.SentencePieceProcessor(model_file=path), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                own = counts.setdefault(lang, Counter())
                own.update(sp.encode(" ".join(words_of(text.as_py())), num_threads=1))
        rows = [(lang, i, n) for lang, own in counts.items() for i, n in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64()))], names=["lang", "piece", "n"])

    return train.mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """Languages, pieces and a probability for each of both."""

    def __init__(self, langs: list[str], prior: np.ndarray, pieces: list[str], counts: np.ndarray):
        self.langs, self.prior = langs, prior
        real = np.array([bool(p) for p in pieces])
        probs = (counts + SMOOTHING) * real[:, None]
        probs /= probs.sum(0, keepdims=True)
        self.table = {p: probs[i] for i, p in enumerate(pieces) if p}
        keys = np.array([self.hash(p) for p in self.table], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.probs = np.concatenate([np.array(list(self.table.values())).reshape(len(self.table), len(langs))[order], np.zeros((1, len(langs)))])
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((CACHED_WORDS, len(langs)))

    def __reduce__(self):
        return _restored, (self.langs, self.prior, self.keys, self.probs, self.table)

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x100000001B3 + ord(c) + 1) & (2**64 - 1)
        return h

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probabilities (words, languages) of words of one length, summed over segmentations."""
        n = len(words[0]) + 1
        codes = np.array([[0x2581, *map(ord, w)] for w in words], np.uint64)
        alpha = np.zeros((n + 1, len(words), len(self.langs)))
        alpha[0] = 1
        with np.errstate(over="ignore"):
            for i in range(n):
                h = np.zeros(len(words), np.uint64)
                for j in range(i + 1, min(n, i + MAX_PIECE) + 1):
                    h = h * np.uint64(0x100000001B3) + codes[:, j - 1] + np.uint64(1)
                    at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                    at = np.where(self.keys[at] == h, at, len(self.keys))
                    p = self.probs[at]
                    alpha[j] += alpha[i] * (np.maximum(p, CHAR_FLOOR) if j == i + 1 else p)
        return np.log(alpha[n])

    def forward_long(self, word: str) -> np.ndarray:
        """The same for one word of any length, rescaled as it goes."""
        s, log = "▁" + word, np.zeros(len(self.langs))
        last = [np.ones(len(self.langs))]  # alpha of the last places, all in units of exp(log)
        for j in range(1, len(s) + 1):
            total = np.zeros(len(self.langs))
            for back, alpha in enumerate(reversed(last[-MAX_PIECE:]), 1):
                p = self.table.get(s[j - back : j])
                if p is not None:
                    total = total + alpha * (np.maximum(p, CHAR_FLOOR) if back == 1 else p)
                elif back == 1:
                    total = total + alpha * CHAR_FLOOR
            unit = np.maximum(total, 1e-300)
            last = [a / unit for a in last[-MAX_PIECE + 1 :]] + [total / unit]
            log = log + np.log(unit)
        return log

    def learn(self, words: set[str]) -> None:
        """Puts words into the cache."""
        if len(self.cache) + len(words) > len(self.scores):
            self.cache.clear()
            if len(words) > len(self.scores):
                self.scores = np.zeros((len(words), len(self.langs)))
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                found = self.forward(part) if n <= BATCHED else np.array([self.forward_long(w) for w in part])
                k = len(self.cache)
                self.scores[k : k + len(part)] = found
                self.cache.update(zip(part, range(k, k + len(part))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counted = [Counter(words_of(t)) for t in texts]
        out = []
        at = 0
        while at < len(counted):  # as many texts at a time as the cache surely holds
            end, new = at, set()
            while end < len(counted) and (end == at or len(new) < CACHED_WORDS // 4):
                new.update(w for w in counted[end] if w not in self.cache)
                end += 1
            if len(self.cache) + len(new) > len(self.scores):
                new = {w for c in counted[at:end] for w in c}
            if new:
                self.learn(new)
            for c in counted[at:end]:
                out.append(self.one(c))
            at = end
        return out

    def one(self, counted: Counter) -> tuple[str, float]:
        if not self.langs or not counted or not has_letter(list(counted)):
            return UNKNOWN, 0.0
        rows = np.fromiter(map(self.cache.__getitem__, counted), np.int64, len(counted))
        total = self.prior + np.fromiter(counted.values(), float, len(counted)) @ self.scores[rows]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def _restored(langs, prior, keys, probs, pieces) -> Model:
    m = Model.__new__(Model)
    m.langs, m.prior, m.keys, m.probs, m.table = langs, prior, keys, probs, pieces
    m.cache, m.scores = {}, np.zeros((CACHED_WORDS, len(langs)))
    return m


def train_model(train: DataFrame, path: str, train_docs: int = TRAIN_DOCS) -> Model:
    """train: key, lang, text with lang and text known. A language has about train_docs documents at most (its hash share).

    No rows give a model without languages. Rows that repeat a key are all taken or none.
    """
    by_lang = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    pieces, langs = vocabulary_pieces(path), sorted(by_lang)
    shares = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_docs / by_lang[lang]))]) if langs else None
    share = F.coalesce(F.element_at(shares, F.col("lang")), F.lit(0.0)) if langs else F.lit(0.0)
    u = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    counts = np.zeros((len(pieces), len(langs)))
    number = {lang: i for i, lang in enumerate(langs)}
    for r in piece_counts(train.where(u < share).select("lang", "text"), path).collect():  # vocabulary times languages at most
        counts[r["piece"], number[r["lang"]]] = r["n"]
    n = np.array([by_lang[x] for x in langs], float)
    return Model(langs, np.log(n / n.sum()) if len(langs) else n, pieces, counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row, from its text alone; `und` and 0 for null, empty and other texts without a letter.

    Texts of any length are read whole. Repeated rows give repeated rows; null ids stay null; other columns are not read, so
    their names do not matter. Ties go to the language that comes first. A model without languages finds `und` everywhere.
    No rows in, none out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(key):
    """Documents that are never learned from; a null id is not held out."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def op5_langid(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("key"), "lang", "text")
    found = identify(docs, train_model(train, public_path(VOCABULARY)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
