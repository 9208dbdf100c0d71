"""Near-duplicates by SimHash prints and by the exact Jaccard similarity of their word shingles.

MinHash bands only name candidates: two texts at the least similarity share no
band once in a million pairs (26 bands of four). Every candidate is decided by
the sets themselves. Texts with the same set are one node. In each bucket of
a band the nodes are first compared with one of them; once those links have been
joined, only nodes of different groups are compared with each other, so a group
of n near copies needs about n comparisons and no pair is left out.

Before the sets are brought together, a pair is held against the marks of both:
the parity of the number of shingles in each of 1,024 slots. Every slot that
differs stands for at least one shingle that only one of them has, so a pair
with too many of those cannot be similar enough, and no similar pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import discard, staged, text_bytes, values
from tabloom.llm.components import components
from tabloom.llm.simhash import near_links, open_rows, simhash

SLICE = 1 << 11
MARKS = 16  # 64-bit words of parities per set


@dataclass(frozen=True)
class Settings:
    width: int = 5
    similarity: float = 0.8
    bands: int = 26
    rows: int = 4  # minima per band
    first_bands: int = 4  # buckets of the first turn, which joins most of a large group
    turns: int = 6  # turns that compare with one node per bucket; after them all that is open is compared
    open_pairs: int = 4  # as soon as so many pairs per row of a bucket are open, they are all compared
    stuck: float = 0.8  # and when a turn leaves more than this share of them
    prints: bool = False  # also link texts whose SimHash prints are near


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; words are lower-cased (A-Z only). No word: none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*[words[i:] for i in range(width)]))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, 42) for g in grams), np.uint64))


def band_keys(grams: np.ndarray, s: Settings) -> np.ndarray:
    """One key per band: the minima of the grams under the band's ``rows`` permutations."""
    n = s.bands * s.rows
    rng = np.random.default_rng(5)
    turn, odd = rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(n, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), SLICE):
        np.minimum(low, ((grams[at : at + SLICE, None] ^ turn) * odd).min(axis=0), out=low)
    key = np.zeros(s.bands, np.uint64)
    for column in low.reshape(s.bands, s.rows).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def marks(grams: np.ndarray) -> np.ndarray:
    """Parities of the number of grams in each slot, as ``MARKS`` words."""
    slot = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (64 * MARKS - 1).bit_length())
    return np.packbits(np.bincount(slot.astype(np.int64), minlength=64 * MARKS) & 1).view(np.int64)


def _prints(docs: DataFrame, s: Settings) -> DataFrame:
    """(id, text_hash, node, simhash, size, keys) of every row: its set's hash, its print if wanted, size and band keys. A null text counts as empty."""
    slim = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), text_bytes())
    schema = slim.select("id", "text_hash", *[F.lit(0).cast("long").alias(c) for c in ("node", "simhash", "size")],
                         F.array().cast("array<long>").alias("keys")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, near, sizes, keys = [], [], [], []
            for text in values(b.column(2)):
                grams = shingles(text, s.width)
                nodes.append(xxhash.xxh64_intdigest(grams.tobytes()))
                near.append(simhash(text) if s.prints else 0)
                sizes.append(len(grams))
                keys.append(band_keys(grams, s).view(np.int64) if len(grams) else [])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(near, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "text_hash", "node", "simhash", "size", "keys"])

    return slim.mapInArrow(run, schema)


def _sets(docs: DataFrame, firsts: DataFrame, s: Settings) -> DataFrame:
    """(node, grams, marks) of the rows of ``docs`` named by ``firsts(node, first)``."""
    named = firsts.select("node", F.col("first.id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    here = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    rows = docs.select("doc_id", "text").join(named, here).select("node", text_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, text in enumerate(values(b.column(1))):
                grams = shingles(text, s.width)
                lists = [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in (grams, marks(grams))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1), *lists], names=["node", "grams", "marks"])

    return rows.mapInArrow(run, "node long, grams array<long>, marks array<long>").dropDuplicates(["node"])


def _open_pairs(rows: DataFrame, buckets: DataFrame, whole: bool, s: Settings) -> DataFrame:
    """Distinct (u, v) of different groups in the buckets whose sizes and marks allow it: all of them, or those with the bucket's chosen node."""
    inside = rows.join(buckets, ["band", "key"])
    if whole:
        # One side leaves out the bucket's largest group, whose nodes are joined already.
        a = inside.where("c <> most").select("band", "key", F.col("node").alias("u"), F.col("size").alias("size_u"), F.col("marks").alias("marks_u"), F.col("c").alias("c_u"))
        b = inside.select("band", "key", "most", F.col("node").alias("v"), "size", "marks", "c")
        pairs = a.join(b, ["band", "key"]).where("c_u <> c and (c = most or u < v)")
    else:
        pairs = inside.select(F.col("chosen.node").alias("u"), F.col("chosen.size").alias("size_u"), F.col("chosen.marks").alias("marks_u"),
                              F.col("chosen.c").alias("c_u"), F.col("node").alias("v"), "size", "marks", "c").where("c_u <> c")
    fits = F.least("size_u", "size") >= F.lit(s.similarity) * F.greatest("size_u", "size") - 1e-9
    apart = sum((F.bit_count(F.get("marks_u", F.lit(i)).bitwiseXOR(F.get("marks", F.lit(i)))) for i in range(MARKS)), F.lit(0))
    fits = fits & (apart <= F.lit((1 - s.similarity) / (1 + s.similarity)) * (F.col("size_u") + F.col("size")) + 1e-6)
    return pairs.where(fits).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("grams_u")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("grams").alias("grams_v")), "v")
    counted = both.select("u", "v", F.size(F.array_intersect("grams_u", "grams_v")).alias("n"), (F.size("grams_u") + F.size("grams_v")).alias("total"))
    return counted.where(F.col("n") >= F.lit(s.similarity) * (F.col("total") - F.col("n")) - 1e-9).select("u", "v")


def _links(docs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame | None:
    """(u, v) links that connect all nodes whose sets are similar enough; None if there are none."""
    leaves = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    shared = leaves.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key")
    rows = staged(leaves.join(shared, ["band", "key"], "left_semi"), "buckets")
    if rows.isEmpty():
        return None
    total = rows.count()
    sets = staged(_sets(docs, nodes.join(rows.select("node").distinct(), "node", "left_semi"), s), "sets")
    marked = staged(rows.join(sets.select("node", "marks"), "node"), "buckets")
    discard(rows)
    rows = marked
    links, label, last = None, None, float("inf")
    for turn in range(s.turns + 2):
        if label is None:
            marked = rows.withColumn("c", F.col("node"))
        else:
            marked = rows.join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
        groups = marked.groupBy("band", "key", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order.alias("order"), "node", "size", "c", "marks")).alias("chosen"))
        buckets = groups.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.max_by("c", "n").alias("most"),
                                                    F.min("chosen").alias("chosen")).where("n * n > own")
        buckets = staged(buckets, "open")
        # buckets whose nodes are all joined are done with: the rows left shrink from turn to turn
        still = staged(rows.join(buckets.select("band", "key"), ["band", "key"], "left_semi"), "buckets")
        discard(rows)
        rows = still
        left = buckets.agg(F.sum((F.col("n").cast("double") * F.col("n") - F.col("own")) / 2)).first()[0]
        if not left:
            break
        if label is None:
            marked = rows.withColumn("c", F.col("node"))
        else:
            marked = rows.join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        whole = turn > 0 and (left <= s.open_pairs * total or turn > s.turns or turn > 1 and left > s.stuck * last)
        last = left
        chosen = buckets if turn else buckets.where(F.col("band") < s.first_bands)
        pairs = staged(_open_pairs(marked, chosen.drop("n", "own"), whole, s), "pairs")
        found = staged(_similar(pairs, sets, s), "similar")
        discard(pairs, buckets)
        if whole:
            links = found if links is None else links.unionByName(found)
            break
        # a forest of the links so far connects what they connect
        joined = components(found if links is None else links.unionByName(found))
        fresh = staged(joined, "label")
        discard(label, found)
        label = fresh
        links = label.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    discard(sets, rows)
    return links


def _print_links(prints: DataFrame) -> DataFrame:
    """(u, v) links that connect the sets of texts whose SimHash prints ``simhash.near_links`` connects."""
    told = prints.select("node", "simhash").distinct()
    label = components(near_links(told)).select(F.col("node").alias("simhash"), "component")
    told = staged(told.join(label, "simhash", "left").select("node", F.coalesce("component", "simhash").alias("c")), "prints")
    hubs = told.groupBy("c").agg(F.min("node").alias("u"), F.max("node").alias("most")).where("u <> most")
    return told.join(hubs, "c").where("node <> u").select("u", F.col("node").alias("v"))


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The row of ``docs`` (with doc_id and text) that opens each group of near-duplicates, all columns.

    A group is what links of at least ``similarity`` connect, with ``prints``
    also those of near SimHash prints; texts without a word are one group. The
    opening row is chosen as in ``simhash.keep_one``.
    """
    prints = staged(_prints(docs, s), "shingles")
    opener = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    nodes = prints.groupBy("node").agg(F.min(opener).alias("first"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys"))
    nodes = staged(nodes, "nodes")
    links = _links(docs, nodes, s)
    if s.prints:
        near = _print_links(prints)
        links = near if links is None else links.unionByName(near)
    if links is None:
        firsts = nodes.select(F.col("first").alias("opener"))
    else:
        label = components(links)
        named = nodes.join(label, "node", "left").select("first", F.coalesce("component", "node").alias("c"))
        firsts = named.groupBy("c").agg(F.min("first").alias("opener")).select("opener")
    return open_rows(docs, prints, firsts)
