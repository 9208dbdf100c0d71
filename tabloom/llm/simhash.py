"""SimHash fingerprints and near-duplicate groups found by a binary-trie self-join.

Fingerprints within ``BUDGET`` differing bits agree in at least one of four
16-bit blocks, so each is entered once per block with that block rotated to the
front. A block value is the root of a binary trie over the other 48 bits. Node
pairs are walked together, differing bits add up, and a pair is dropped as soon
as the error budget is exceeded, or when all its leaves are linked already.
Leaves of a root above ``cap`` are dealt into parts, and every pair of parts is
walked by a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import staged, text_bytes, without
from tabloom.llm.components import components

BUDGET = 3
BLOCK = 16
CAP = 1 << 18
CHUNK = 1 << 19
BUFFER = 1 << 18


def simhash(text: bytes, width: int = 3) -> int:
    """64-bit fingerprint of UTF-8 bytes, as a signed long.

    Words are lower-cased (A-Z only); the hashes of all word shingles vote per
    bit, and a bit is set if more than half of them have it. No word: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(g, 42) for g in grams])
    n = len(raw) // 8
    votes = np.zeros(64, np.int64)
    view = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for lo in range(0, n, 1 << 16):
        votes += np.unpackbits(view[lo : lo + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, plus ``simhash`` (long). A null text counts as empty."""
    df = without(df, ("simhash",))
    rest = [c for c in df.columns if c != text]
    slim = df.select(*[F.col(f"`{c}`") for c in rest], text_bytes(text, "__text"))
    schema = df.select(*[F.col(f"`{c}`") for c in rest], F.lit(0).cast("long").alias("simhash")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([simhash(t.as_py()) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], prints], names=[*rest, "simhash"])

    return slim.mapInArrow(run, schema)


class _Links:
    """Smallest leaf per group of linked leaves, updated by batches of links."""

    def __init__(self, n: int):
        self.low = np.arange(n)
        self._index()

    def _index(self) -> None:
        self.cuts = np.concatenate([[0], np.cumsum(self.low[1:] != self.low[:-1])])

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        low = self.low
        while True:
            a, b = low[i], low[j]
            keep = a != b
            if not keep.any():
                break
            i, j, a, b = i[keep], j[keep], a[keep], b[keep]
            np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = low[low]
                if np.array_equal(up, low):
                    break
                low = up
        self.low = low
        self._index()

    def joined(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        """Node pairs whose leaves are all in one group already."""
        cuts, low = self.cuts, self.low
        same = (cuts[hi1 - 1] == cuts[lo1]) & (cuts[hi2 - 1] == cuts[lo2])
        return same & (low[lo1] == low[lo2])


def walk(keys: np.ndarray, pairs: np.ndarray, depth: int, budget: int = BUDGET) -> np.ndarray:
    """Link leaves by walking pairs of trie nodes together.

    ``keys`` are unsigned and sorted inside each node; ``pairs`` has one row
    (lo1, hi1, lo2, hi2) per pair of nodes, a node being a range of keys that
    share their first ``depth`` bits. Returns the smallest linked leaf of every
    leaf. At most ``CHUNK`` node pairs are opened at a time.
    """
    links = _Links(len(keys))
    ones: dict[int, np.ndarray] = {}
    todo = [(depth, np.concatenate([pairs, np.zeros((len(pairs), 1), np.int64)], 1))] if len(pairs) else []
    while todo:
        depth, p = todo.pop()
        if len(p) > CHUNK:
            todo.append((depth, p[CHUNK:]))
            p = p[:CHUNK]
        lo1, hi1, lo2, hi2, cost = p.T
        selfs = lo1 == lo2
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        ends = (single | (depth == 64)) & ~selfs
        if ends.any():
            a, b = lo1[ends], lo2[ends]
            near = np.bitwise_count(keys[a] ^ keys[b]) <= budget
            links.add(a[near], b[near])
        more = ~single & ~links.joined(lo1, hi1, lo2, hi2)
        if depth == 64 or not more.any():
            continue
        lo1, hi1, lo2, hi2, cost, selfs = (x[more] for x in (lo1, hi1, lo2, hi2, cost, selfs))
        if depth not in ones:
            bit = (keys >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        count = ones[depth]
        mid1, mid2 = hi1 - (count[hi1] - count[lo1]), hi2 - (count[hi2] - count[lo2])
        other = ~selfs
        children = np.concatenate([
            np.stack([lo1, mid1, lo2, mid2, cost], 1),
            np.stack([mid1, hi1, mid2, hi2, cost], 1),
            np.stack([lo1, mid1, mid2, hi2, cost + 1], 1),
            np.stack([mid1, hi1, lo2, mid2, cost + 1], 1)[other],
        ])
        keep = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] <= budget)
        if keep.any():
            todo.append((depth + 1, children[keep]))
    return links.low


def _link_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (t, root, p, q, side, key): walk parts p and q of each root, give linked fingerprints."""

    def flush(t, root, p, q, side, key) -> pa.RecordBatch:
        n = len(key)
        head = np.ones(n, bool)
        head[1:] = (t[1:] != t[:-1]) | (root[1:] != root[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        start = np.flatnonzero(head)
        end = np.append(start[1:], n)
        second = np.concatenate([[0], np.cumsum(side.astype(np.int64))])
        mid = end - (second[end] - second[start])  # rows of the second part come last
        own = p[start] == q[start]
        pairs = np.stack([start, np.where(own, end, mid), np.where(own, start, mid), end], 1)
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
        low = walk(key.view(np.uint64), pairs, BLOCK)
        moved = np.flatnonzero(low != np.arange(n))
        left = (t.astype(np.int64) * BLOCK).astype(np.uint64)  # turn back to the right
        right = (np.uint64(64) - left) % np.uint64(64)
        prints = ((key.view(np.uint64) >> left) | np.where(left == 0, np.uint64(0), key.view(np.uint64) << right)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(prints[moved]), pa.array(prints[low[moved]])], names=["u", "v"])

    kept: list[np.ndarray] = []
    for batch in batches:
        cols = [np.array(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
        kept = [np.concatenate(x) for x in zip(kept, cols)] if kept else cols
        if len(kept[0]) < BUFFER:
            continue
        last = np.ones(len(kept[0]), bool)
        for c in kept[:4]:
            last &= c == c[-1]
        cut = int(np.argmax(last))  # the last root may go on in the next batch
        if cut:
            yield flush(*[c[:cut] for c in kept])
            kept = [c[cut:].copy() for c in kept]
    if kept and len(kept[0]):
        yield flush(*kept)


def near_links(prints: DataFrame, cap: int = CAP) -> DataFrame:
    """(u, v) links that connect all fingerprints of ``prints(simhash)`` within the budget of each other.

    Links found in one task are given as stars, so a group of n fingerprints
    yields at most n links per block instead of all its pairs.
    """
    key = F.col("simhash")
    turns = [F.struct(F.lit(t).alias("t"), (key if t == 0 else F.shiftleft(key, BLOCK * t).bitwiseOR(F.shiftrightunsigned(key, 64 - BLOCK * t))).alias("key"))
             for t in range(64 // BLOCK)]
    leaves = prints.where("simhash is not null").select("simhash").distinct().select(F.inline(F.array(*turns)))
    leaves = leaves.withColumn("root", F.shiftrightunsigned("key", 64 - BLOCK).cast("int"))
    roots = leaves.groupBy("t", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    heavy = staged(roots, "heavy")
    one = F.lit(0)
    light = [F.col("t"), F.col("root"), one.alias("p"), one.alias("q"), one.alias("side"), F.col("key")]
    if heavy.isEmpty():
        rows = leaves.select(*light)
    else:
        rows = leaves.join(heavy, ["t", "root"], "left_anti").select(*light)
        cut = leaves.join(heavy, ["t", "root"]).withColumn("k", F.ceil(F.col("n") / cap).cast("int"))
        cut = cut.withColumn("i", F.pmod(F.xxhash64("key"), F.col("k")).cast("int"))
        cut = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        rows = rows.unionByName(cut.select(
            "t", "root", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), (F.col("i") > F.col("j")).cast("int").alias("side"), "key"))
    order = ["t", "root", "p", "q"]
    sorted_rows = rows.repartition(*order).sortWithinPartitions(*order, "side", "key")
    return sorted_rows.mapInArrow(_link_nodes, "u long, v long")


def _labelled(docs: DataFrame, id_col: str, text: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """Prints (id, text_hash, simhash), and per simhash its component, the component's smallest id and its opening document."""
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    prints = staged(fingerprints(named), "simhash")
    opener = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    nodes = prints.groupBy("simhash").agg(F.min(opener).alias("first"))
    label = components(near_links(nodes, cap))
    nodes = nodes.join(label, nodes.simhash == label.node, "left").select("simhash", "first", F.coalesce("component", "simhash").alias("c"))
    nodes = staged(nodes, "nodes")
    roots = nodes.groupBy("c").agg(F.min("first").alias("opener"))
    return prints, nodes.join(roots, "c").select("simhash", "opener")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", cap: int = CAP) -> DataFrame:
    """One row per document: its id, ``simhash`` (long) and ``component_id``.

    ``component_id`` is the smallest id among the documents reachable through
    links of at most ``BUDGET`` differing bits. Texts without a word have
    fingerprint zero and link like any other; repeated rows stay; an id of null
    never becomes a component id, and a component of null ids only has null.
    """
    prints, nodes = _labelled(docs, id_col, text, cap)
    return prints.join(nodes, "simhash").select(F.col("id").alias(id_col), "simhash", F.col("opener.id").alias("component_id"))


def open_rows(docs: DataFrame, prints: DataFrame, openers: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``openers(opener)``, one of each; ``prints`` has the (id, text_hash) of all rows."""
    rows = prints.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("id").eqNullSafe(F.col("opener.id")) & (F.col("text_hash") == F.col("opener.text_hash"))
    chosen = staged(rows.join(openers, same, "left_semi").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "n"), "openers")
    here = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    single = docs.join(chosen.where("n = 1"), here, "left_semi")
    repeated = docs.join(chosen.where("n > 1"), here, "left_semi").withColumn("__hash", F.xxhash64("text"))
    return single.unionByName(repeated.dropDuplicates(["doc_id", "__hash"]).drop("__hash"))


def keep_one(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The row of ``docs`` (with doc_id and text) that opens each near-duplicate group, all columns.

    That is the row with the smallest id (null after all), then text hash; of
    rows that repeat its id and text any one stays.
    """
    prints, nodes = _labelled(docs, "doc_id", "text", cap)
    return open_rows(docs, prints, nodes.select("opener").distinct())


def hex_print(column: str = "simhash"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
