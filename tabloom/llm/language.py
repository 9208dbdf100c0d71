"""Language identification: known words first, shorter and shorter character n-grams for the others."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ddl, slices, staged, text_bytes, values, without

LETTERS = regex.compile(r"\p{L}+")
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
SLICE = 1 << 20  # bytes of text whose new parts are scored together


@dataclass(frozen=True)
class Settings:
    """Bounds of the model, the same at every data size."""

    languages: int = 200  # most frequent labels that are learned
    sample_docs: int = 10_000  # expected labelled documents per language to learn from
    words: int = 50_000  # words kept: those with the largest share of a language's words
    grams: int = 20_000  # n-grams kept of each order, chosen alike
    smoothing: float = 0.5
    known: int = 400_000  # remembered word stretches per worker


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from; an id of null is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters(part: str) -> list[str]:
    """The words of a text: runs of letters, so neither digits nor numerals like ² or Ⅷ."""
    return [part] if part.isalpha() else LETTERS.findall(part)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, word, n), summed per batch."""
    for b in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            into = found.setdefault(lang, Counter())
            for part, n in Counter(text.lower().split(" ")).items():
                for word in letters(part):
                    into[word] += n
        rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) to (lang, gram, n), summed per batch."""
    for b in batches:
        found: dict[str, Counter] = {}
        for lang, word, n in zip(*[c.to_pylist() for c in b.columns]):
            into = found.setdefault(lang, Counter())
            for gram in grams(word):
                into[gram] += n
        rows = [(lang, g, n) for lang, gs in found.items() for g, n in gs.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def grams(word: str, orders=ORDERS) -> Iterator[str]:
    marked = f"_{word}_"
    for order in orders:
        for i in range(len(marked) - order + 1):
            yield marked[i : i + order]


def _table(counts: DataFrame, most: int) -> list:
    """The keys with the largest share of any one language, with their counts per language: bounded by ``most``."""
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per learned language
    if not totals:
        return []
    share = F.col("n") / F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, float(n))])[F.col("lang")]
    per = counts.groupBy("word").agg(F.max(share).alias("share"), F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("per"))
    return per.orderBy(F.desc("share"), F.desc("n"), "word").limit(most).collect()


class Model:
    """Log frequency per language of known words and known n-grams."""

    def __init__(self, languages: list[str], words: list, by_order: dict[int, list], s: Settings):
        self.languages = languages
        self.known = s.known
        at = {lang: i for i, lang in enumerate(languages)}

        def logs(rows: list) -> np.ndarray:
            counts = np.full((len(rows), len(languages)), s.smoothing)
            for i, r in enumerate(rows):
                for lang, n in r["per"]:
                    counts[i, at[lang]] += n
            return np.log(counts / counts.sum(axis=0)).astype(np.float32) if rows else counts.astype(np.float32)

        self.words = {r["word"]: i for i, r in enumerate(words)}
        self.word_rows = logs(words)
        self.grams, parts = {}, []
        for order in ORDERS:
            start = len(self.grams)
            self.grams |= {r["word"]: start + i for i, r in enumerate(by_order[order])}
            parts.append(logs(by_order[order]))
        self.gram_rows = np.concatenate(parts)

        self.every = np.concatenate([self.word_rows, self.gram_rows])

    def rows(self, word: str) -> list[int]:
        """The rows of ``every`` whose mean scores a word: its own, or those of the longest known n-grams; none if nothing is known of it."""
        at = self.words.get(word)
        if at is not None:
            return [at]
        known, marked, start = self.grams, f"_{word}_", len(self.word_rows)
        for order in ORDERS:
            found = [known[g] + start for i in range(len(marked) - order + 1) if (g := marked[i : i + order]) in known]
            if found:
                return found
        return []

    def scores(self, words: list[str]) -> np.ndarray:
        """Score per word and language; zeros for words of which nothing is known."""
        found = [self.rows(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        out = np.zeros((len(words), len(self.languages)), np.float32)
        at = np.fromiter((r for rows in found for r in rows), np.int64, int(sizes.sum()))
        known = np.flatnonzero(sizes)
        if len(known):
            starts = np.cumsum(sizes[known]) - sizes[known]
            out[known] = np.add.reduceat(self.every[at], starts, axis=0) / sizes[known, None]
        return out


class Scorer:
    """Scores lists of texts; remembers the scores of up to ``known`` blank-separated stretches."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages) + 1), np.float32)

    def _add(self, parts: list[str]) -> None:
        """Rows for new parts: the sum of their words' scores, and whether they have a letter."""
        first = len(self.at)
        self.at.update(zip(parts, range(first, first + len(parts))))
        while len(self.at) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        found = [letters(p) for p in parts]
        words = [w for ws in found for w in ws]
        place = np.repeat(np.arange(first, first + len(parts)), [len(ws) for ws in found])
        self.rows[first : first + len(parts)] = 0
        if words:
            np.add.at(self.rows[:, :-1], place, self.model.scores(words))
            self.rows[place, -1] = 1

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.at) > self.model.known:
            self._reset()
        cut = [t.lower().split(" ") for t in texts]
        if new := set().union(*cut).difference(self.at):
            self._add(list(new))
        return list(map(self._best, cut))

    def _best(self, parts: list[str]) -> tuple[str, float]:
        languages = self.model.languages
        total = self.rows[np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))].sum(axis=0, dtype=np.float64)
        if not total[-1]:
            return UNKNOWN, 0.0
        best = int(np.argmax(total[:-1]))
        return languages[best], 1.0 / math.fsum(np.exp(total[:-1] - total[best]).tolist())


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", s: Settings = Settings()) -> Model:
    """Learn from labelled documents that are not held out.

    At most ``languages`` labels are learned, each from an expected
    ``sample_docs`` documents picked by a hash of the id, so what reaches the
    driver is bounded by the settings. Without a labelled text the model is
    empty and every prediction is ``und``.
    """
    use = docs.where(~held_out(id_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = use.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(s.languages).collect()
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], [], {o: [] for o in ORDERS}, s)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, s.sample_docs / r["count"]))])
    picked = use.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    words = picked.select("lang", "text").mapInArrow(_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = staged(words, "words")
    found = words.mapInArrow(_gram_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = staged(found, "grams")
    by_order = {o: _table(found.where(F.length("word") == o), s.grams) for o in ORDERS}
    return Model(languages, _table(words, s.words), by_order, s)


_SCORERS: dict[int, Scorer] = {}


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns but the text, with ``lang_pred`` and ``score`` (0 to 1, the posterior of the language).

    Null texts and texts without a letter are ``und`` with score 0. Equal
    scores go to the language with more labelled documents, then by name.
    """
    docs = without(docs, ("lang_pred", "score"))
    rest = [c for c in docs.columns if c != text]
    slim = docs.select(*[F.col(f"`{c}`") for c in rest], text_bytes(text, "__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        score = _SCORERS.get(id(model))
        if score is None:
            _SCORERS.clear()
            score = _SCORERS[id(model)] = Scorer(model)
        for b in batches:
            made = [m for part in slices(values(b.column(b.num_columns - 1)), SLICE) for m in score([t.decode() for t in part])]
            new = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*rest, "lang_pred", "score"])

    return slim.mapInArrow(run, ddl(docs, rest, "lang_pred string, score double"))


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    Null and empty texts, and those without a letter, are ``und``; rows of null id or language are predicted but not
    learned from. Repeated rows are told of each on their own. An empty table gives no rows.
    """
    model = train(docs, s=s)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
