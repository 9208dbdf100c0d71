"""Quality rules: how far a document's character classes and common words are from its language.

The references are the histograms of all documents of a language. Distances are
Jensen-Shannon distances (base 2, 0 to 1); short texts are noisy, so the limits
widen with one over the square root of the sample and texts below the minimum
length are not judged by them.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ddl, staged, text_bytes, values, without

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "blank", "mark", "symbol", "other")
BLANK, SYMBOL = 3, 5
SPACES = (9, 10, 11, 12, 13, 32)


@dataclass(frozen=True)
class Settings:
    window: int = 8
    min_words: int = 20
    max_repeat_pct: int = 30
    word_share: float = 1 / 500  # a common word makes up at least this share of its language's words
    language_share: float = 1 / 1000  # references of languages with at least this share of the documents are broadcast, the others joined
    reference_words: int = 5_000  # a language with fewer words or characters of its own has no reference
    reference_chars: int = 20_000
    guard_chars: int = 200  # texts with fewer characters are not judged by character classes
    guard_words: int = 50  # nor those with fewer words by common words
    max_chars: float = 0.18
    max_words: float = 0.30
    slack: float = 1.0  # widening of both limits, over the square root of the sample


def _class_table() -> np.ndarray:
    kinds = {"Lu": 1, "Lt": 1, "Ll": 0, "Lm": 0, "Lo": 0, "Cc": 3}
    first = {"N": 2, "Z": 3, "P": 4, "S": 5}
    table = np.fromiter((kinds.get(k, first.get(k[0], 6)) for k in map(unicodedata.category, map(chr, range(0x110000)))), np.uint8, 0x110000)
    table[list(SYMBOLS)] = SYMBOL
    return table


_TABLE: list[np.ndarray] = []


def char_classes(text: str) -> tuple[np.ndarray, int]:
    """Characters per class, and those of the six ASCII white-space characters."""
    if not _TABLE:
        _TABLE.append(_class_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_TABLE[0][points], minlength=len(CLASSES)), sum(map(text.count, map(chr, SPACES)))


def repeat_words(words: list[bytes], window: int) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # Equal codes almost always mean equal windows; the words decide.
    places = np.flatnonzero(twice).tolist()
    shown = [tuple(words[i : i + window]) for i in places]
    seen = Counter(shown)
    mark = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(places, shown):
        if seen[w] > 1:
            mark[i] += 1
            mark[i + window] -= 1
    return int((np.cumsum(mark)[:-1] > 0).sum())


def base_counts(text: bytes, s: Settings) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lower-cased words, class histogram."""
    words = text.split()
    decoded = text.decode("utf-8", "surrogatepass")
    classes, blanks = char_classes(decoded)
    symbols = sum(text.count(c) for c in (bytes([b]) for b in SYMBOLS))
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(decoded) - blanks, symbols, again, repeat_words(words, s.window), text.lower().split(), classes


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors (base 2)."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return math.sqrt(max(0.0, total / 2))


def _corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, key, n), summed over as many documents as fit in a small dictionary."""
    most = 150_000

    def out(lang: str, words: Counter) -> pa.RecordBatch:
        n = len(words)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())],
                                          names=["lang", "key", "n"])

    held: dict[str, Counter] = {}
    for b in batches:
        for at, (lang, text) in enumerate(zip(b.column(0).to_pylist(), values(b.column(1)))):
            held.setdefault(lang, Counter()).update(text.lower().split())
            if at % 256 == 0 and sum(map(len, held.values())) > most:
                yield from (out(lang, words) for lang, words in held.items())
                held = {}
    yield from (out(lang, words) for lang, words in held.items())


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), values(b.column(1))):
            counts, _ = char_classes(text.decode("utf-8", "surrogatepass"))
            held[lang] = held.get(lang, 0) + np.append(counts, 1)
    rows = [(lang, i, int(n)) for lang, counts in held.items() for i, n in enumerate(counts)]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["lang", "class", "n"])


Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray]  # class histogram, places of the common words, their counts with all other words first


@dataclass(frozen=True)
class References:
    """References of the frequent languages by language, and of all others as a table."""

    frequent: dict[str, Reference]
    rare: DataFrame | None  # (lang, classes, words, counts); None if there is no further one


def _reference(row) -> Reference:
    return np.array(row["classes"], np.float64), {bytes(w): i + 1 for i, w in enumerate(row["words"])}, np.array(row["counts"], np.float64)


def references(docs: DataFrame, s: Settings = Settings()) -> References:
    """The reference of every language with enough words and characters of its own, counted over every document of it.

    What reaches the driver is bounded by the settings: 1 / language_share
    languages, 1 / word_share words each. The others stay a table.
    """
    use = docs.where("lang is not null and text is not null").select("lang", text_bytes())
    classes = use.mapInArrow(_class_counts, "lang string, class int, n long").groupBy("lang").agg(
        *[F.sum(F.when(F.col("class") == i, F.col("n"))).alias(f"c{i}") for i in range(len(CLASSES) + 1)])
    n_docs = f"c{len(CLASSES)}"
    classes = staged(classes, "classes")
    total = classes.agg(F.sum(n_docs)).first()[0] or 0
    words = use.mapInArrow(_corpus_counts, "lang string, key binary, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    words = staged(words, "words")
    sums = words.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= s.reference_words)
    chars = sum((F.col(f"c{i}") for i in range(len(CLASSES))), F.lit(0))
    enough = classes.where(chars >= s.reference_chars).join(sums, "lang").select(
        "lang", "total", (F.col(n_docs) >= total * s.language_share).alias("frequent"), F.array(*[F.col(f"c{i}") for i in range(len(CLASSES))]).alias("classes"))
    enough = staged(enough, "languages")
    common = words.join(enough.select("lang", "total"), "lang").where(F.col("n") >= F.col("total") * s.word_share)
    own = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("own"))
    table = enough.join(own, "lang", "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<key:binary,n:bigint>>")))
    rest = F.col("total") - F.aggregate("own", F.lit(0).cast("long"), lambda n, w: n + w["n"])
    table = staged(table.select("lang", "frequent", "classes", F.col("own.key").alias("words"), F.concat(F.array(rest), F.col("own.n")).alias("counts")), "references")
    frequent = {r["lang"]: _reference(r) for r in table.where("frequent").collect()}
    rare = table.where("not frequent").drop("frequent")
    return References(frequent, None if rare.isEmpty() else rare)


def distances(words: list[bytes], classes: np.ndarray, refs: list[Reference]) -> tuple[float, float]:
    """Distance of the classes and of the common words to the nearest of the references; zero without any."""
    found = []
    seen = Counter(words)
    for ref_classes, places, ref_words in refs:
        counts = np.zeros(len(ref_words))
        for w, i in places.items():
            counts[i] = seen.get(w, 0)
        counts[0] = len(words) - counts.sum()
        found.append((divergence(classes, ref_classes) if classes.sum() else 0.0, divergence(counts, ref_words) if words else 0.0))
    return min(found, key=sum, default=(0.0, 0.0))


def judge(docs: DataFrame, refs: References, s: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns but the text, with the base counts, ``base_failed``, both distances and ``kept``.

    A null text has no word and fails. A language is compared with its own
    reference only; without one its distances are zero and reject nothing. A null
    language is compared with every frequent one, and the nearest counts.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    docs = without(docs, names)
    rest = [c for c in docs.columns if c != text]
    slim = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(lang).alias("__lang"), text_bytes(text, "__text"))
    kind = "struct<classes:array<bigint>,words:array<binary>,counts:array<bigint>>"
    parts = [slim.withColumn("__ref", F.lit(None).cast(kind))]
    if refs.rare is not None:
        # Only rows of other than the frequent languages are moved to their references.
        known = F.col("__lang").isNull() | F.col("__lang").isin(list(refs.frequent))
        own = refs.rare.select(F.col("lang").alias("__own"), F.struct("classes", "words", "counts").cast(kind).alias("__ref"))
        parts = [parts[0].where(known), slim.where(~known).join(own, F.col("__lang") == F.col("__own"), "left").drop("__own")]
    shared = docs.sparkSession.sparkContext.broadcast(refs.frequent)
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def nearby(lang: str | None, ref: dict | None) -> list[Reference]:
        if lang is None:
            return list(shared.value.values())
        if ref is not None:
            return [_reference(ref)]
        return [shared.value[lang]] if lang in shared.value else []

    def one(near: list[Reference], text: bytes) -> tuple:
        n, chars, symbols, dups, repeats, words, classes = base_counts(text, s)
        failed = n < s.min_words or 100 * repeats > s.max_repeat_pct * n
        far_chars, far_words = distances(words, classes, near)
        total = int(classes.sum())
        odd = total >= s.guard_chars and far_chars > s.max_chars + s.slack / math.sqrt(total)
        odd = odd or n >= s.guard_words and far_words > s.max_words + s.slack / math.sqrt(n)
        return n, chars, symbols, dups, repeats, failed, far_chars, far_words, not failed and not odd

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.num_columns
            made = [one(nearby(x.as_py(), r.as_py()), t.as_py()) for x, t, r in zip(b.column(k - 3), b.column(k - 2), b.column(k - 1))]
            new = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], *new], names=[*rest, *names])

    fields = ", ".join(f"{n} {t}" for n, t in zip(names, ["long"] * 5 + ["boolean", "double", "double", "boolean"]))
    schema = ddl(docs, rest, fields)
    return reduce(DataFrame.unionByName, [p.mapInArrow(run, schema) for p in parts])


def quality(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, the base counts, distances and verdict of every row of ``docs`` (doc_id, text, lang)."""
    return judge(docs.select("doc_id", "lang", "text"), references(docs, s), s).drop("lang")
