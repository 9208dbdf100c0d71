"""Document fingerprints: content-defined chunks by a normalised gear hash.

A rolling gear hash over the last 32 bytes ends a chunk where its top bits are
zero: more bits are asked for before the normal size and fewer after it, so
sizes stay near normal. Boundaries depend on nearby bytes only, so an insertion
moves few of them. A fingerprint is the set of chunk digests with their lengths
in bytes; the likeness of A to B is the share of A's length whose chunks B has.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ddl, text_bytes, without


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes; the strict and loose masks ask for the hash's top bits to be zero."""

    least: int = 16
    normal: int = 64
    most: int = 256
    strict_bits: int = 7
    loose_bits: int = 4
    seed: int = 20


_GEARS: dict[int, np.ndarray] = {}


def gear_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """Gear hash (32 bits) at every byte: sum of gear[byte] << age over the last 32 bytes."""
    if seed not in _GEARS:
        _GEARS[seed] = np.random.default_rng(seed).integers(0, 1 << 32, 256, np.uint32)
    h = _GEARS[seed][data]
    for step in (1, 2, 4, 8, 16):  # hashes over twice as many bytes each time
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    return h


def cut_points(data: bytes, c: Chunking) -> list[int]:
    """Ends of the chunks; none for no data."""
    n = len(data)
    if n <= c.least:
        return [n] if n else []
    h = gear_hashes(np.frombuffer(data, np.uint8), c.seed)
    places = np.flatnonzero(h < np.uint32(1 << (32 - c.loose_bits)))
    loose = (places + 1).tolist()
    strict = (places[h[places] < np.uint32(1 << (32 - c.strict_bits))] + 1).tolist()
    ends, start = [], 0
    while n - start > c.least:
        i = bisect_left(strict, start + c.least)
        if i < len(strict) and strict[i] < start + c.normal:
            end = strict[i]
        else:
            i = bisect_left(loose, start + c.normal)
            end = loose[i] if i < len(loose) else n
        start = min(end, start + c.most, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(data: bytes, c: Chunking = Chunking()) -> dict[int, int]:
    """Digest to length of the distinct chunks."""
    found, start, digest = {}, 0, xxhash.xxh64_intdigest
    for end in cut_points(data, c):
        found[digest(data[start:end])] = end - start
        start = end
    return found


def written(found: dict[int, int]) -> str:
    """A fingerprint as text: ``digest:length`` sorted by digest, joined by blanks."""
    return " ".join([f"{d:016x}:{n}" for d, n in sorted(found.items())])


def read(fingerprint: str) -> dict[int, int]:
    return {int(d, 16): int(n) for d, n in (x.split(":") for x in fingerprint.split())}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of A's length in chunks that B has too; nothing is contained only in nothing."""
    whole = sum(a.values())
    if not whole:
        return 0.0 if b else 1.0
    return sum(n for d, n in a.items() if d in b) / whole


def fingerprints(docs: DataFrame, text: str = "text", c: Chunking = Chunking()) -> DataFrame:
    """All columns but the text, with ``fingerprint``. A null text counts as empty and has the empty one."""
    docs = without(docs, ("fingerprint",))
    rest = [x for x in docs.columns if x != text]
    slim = docs.select(*[F.col(f"`{x}`") for x in rest], text_bytes(text, "__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([written(chunks(t.as_py(), c)) for t in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*rest, "fingerprint"])

    return slim.mapInArrow(run, ddl(docs, rest, "fingerprint string"))


def _below(limits: list[int], key):
    """How many of the sorted limits are below the key, found in two steps of about their square root."""
    width = max(1, math.isqrt(len(limits)))
    rows = [limits[i : i + width] for i in range(0, len(limits), width)]
    if not rows:
        return F.lit(0)
    heads = F.array(*[F.lit(r[0]) for r in rows])
    table = F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    row = F.size(F.filter(heads, lambda x: x < key))
    return F.when(row <= 0, 0).otherwise((row - 1) * width + F.size(F.filter(F.element_at(table, F.greatest(row, F.lit(1))), lambda x: x < key)))


def in_ranges(docs: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows with the number of their key range, ``part``; each range also gets the first rows of the next.

    ``halo`` marks those copies, the first range's rows going to the last one.
    Range limits are sampled quantiles of the key; the number of ranges, and so
    of the limits on the driver, is the number of partitions.
    """
    keys = docs.select(F.col(key).alias("k"))
    limits = sorted(set(keys.where("k is not null").approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []))
    # Quantiles are doubles; exact for ids below 2**53 and good enough as limits above.
    part = F.coalesce(_below([int(x) for x in limits], F.col("k")), F.lit(0))
    firsts = keys.select("k", part.alias("part")).groupBy("part").agg(F.min("k").alias("k"), F.count_if(F.col("k").isNull()).alias("nulls")).orderBy("part").collect()
    if not firsts:
        return docs.withColumns({"part": F.lit(0), "halo": F.lit(False)})
    order = [r["part"] for r in firsts]
    before = {p: order[i - 1] for i, p in enumerate(order)}
    # The smallest key of a range: null for the first range if it has nulls.
    first = F.create_map(*[F.lit(x) for r in firsts for x in (r["part"], None if r["nulls"] else r["k"])])
    previous = F.create_map(*[F.lit(x) for p in order for x in (p, before[p])])
    dealt = docs.withColumn("k", F.col(key)).withColumn("own", part)
    leads = F.col("k").eqNullSafe(first[F.col("own")])
    own = F.struct(F.col("own").alias("part"), F.lit(False).alias("halo"))
    copy = F.struct(previous[F.col("own")].alias("part"), F.lit(True).alias("halo"))
    return dealt.select("*", F.inline(F.when(leads, F.array(own, copy)).otherwise(F.array(own)))).drop("k", "own")


def _edits(batches: Iterator[pa.RecordBatch], c: Chunking) -> Iterator[pa.RecordBatch]:
    """Rows (part, halo, doc_id, text) sorted by part, own rows first, then id and text."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    made: list[tuple] = []
    held: tuple | None = None  # a document of this part that waits for the next one
    part, over = None, True

    def compare(doc: tuple, after: tuple) -> None:
        doc_id, text, own = doc
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        raw = edited.encode("utf-8", "surrogatepass")
        other = chunks(raw, c)
        made.append((doc_id, len(text), hashlib.sha256(raw).hexdigest(), written(own), written(other), containment(own, other), containment(own, after[2])))

    for b in batches:
        for at, halo, doc_id, raw in zip(*[x.to_pylist() for x in b.columns]):
            if at != part:
                part, held, over = at, None, False
            if over:
                continue  # further rows with the id that opens the next range
            text = raw.decode("utf-8", "surrogatepass")
            now = (doc_id, text, chunks(raw, c))
            if held is not None:
                compare(held, now)
            held, over = now, halo
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=names)
            made = []


def neighbours(docs: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last half replaced by the beginning of the next
    document in the order of doc_id (after the last the first). Null ids come
    first; rows with one id follow each other by text. A null text is empty. A
    single document is its own next one.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), "doc_id", parts)
    rows = dealt.select("part", "halo", "doc_id", "text").repartition(parts, "part").sortWithinPartitions("part", "halo", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(lambda batches: _edits(batches, c), schema)
