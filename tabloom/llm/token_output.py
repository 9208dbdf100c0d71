"""Token-id output: best-fit-decreasing packing into fixed rows, written as binary matrices.

Each task packs blocks of bounded size. Documents longer than a row are split
without loss; pieces are placed longest first into the open row with the least
room that still holds them, found by a segment tree over the possible rooms.
A written record is one matrix of up to ``rows`` packed rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import slices, text_bytes, values
from tabloom.llm.encoders import encoder, rank_encoder


@dataclass(frozen=True)
class Settings:
    row: int = 2048  # tokens in a packed row
    rows: int = 256  # rows in a written matrix
    block_tokens: int = 8_000_000
    end: int = 50_256  # ends every document
    pad: int = 50_256  # fills a row


class Rooms:
    """Segment tree over the rooms 0..size: open rows by the room they have left."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) with the smallest room of at least ``least``."""
        count, node = self.count, least + self.leaves
        if not count[node]:
            # up to the first right sibling that holds rows, then down its left edge
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """Places of the lengths in rows, longest first, ties in the given order."""
    rooms, packed = Rooms(row), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found is None:
            packed.append([])
            found = row, len(packed) - 1
        room, at = found
        packed[at].append(i)
        if room > lengths[i]:
            rooms.put(room - lengths[i], at)
    return packed


class Block:
    """Pieces of one block, packed and given out as matrices."""

    def __init__(self, s: Settings):
        self.s = s
        self.pieces: list[tuple] = []
        self.tokens = 0

    def add(self, doc, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.s.row):
            self.pieces.append((doc, start, len(ids), ids[start : start + self.s.row].copy()))
        self.tokens += len(ids)

    def matrices(self, first: int) -> Iterator[tuple]:
        """(first row id, rows, ids, cumulative lengths, resets, documents, starts, lengths of the documents).

        Cumulative lengths run through the matrix row by row, a row's padding
        included as a segment of its own; resets are the places in the matrix,
        read as one sequence, where positions go back to zero.
        """
        s = self.s
        packed = best_fit([len(p[3]) for p in self.pieces], s.row)
        for lo in range(0, len(packed), s.rows):
            some = packed[lo : lo + s.rows]
            ids = np.full((len(some), s.row), s.pad, "<u2")
            ends, resets, docs, starts, totals = [0], [], [], [], []
            for r, places in enumerate(some):
                at = 0
                for i in places:
                    doc, start, total, part = self.pieces[i]
                    ids[r, at : at + len(part)] = part
                    resets.append(r * s.row + at)
                    at += len(part)
                    ends.append(r * s.row + at)
                    docs.append(doc)
                    starts.append(start)
                    totals.append(total)
                if at < s.row:
                    resets.append(r * s.row + at)
                    ends.append((r + 1) * s.row)
                    docs.append(None)
                    starts.append(-1)
                    totals.append(0)
            yield first + lo, len(some), ids.tobytes(), ends, resets, docs, starts, totals
        self.pieces, self.tokens = [], 0


def write(docs: DataFrame, out: str, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", s: Settings = Settings()) -> None:
    """Write packed matrices to the folder ``out``, one record per matrix.

    Fields: first_row (id of its first row), n_rows, row_length, ids (binary,
    little-endian unsigned 16-bit, row by row), cu_seqlens, resets and, for each
    segment, doc, start (-1: padding) and doc_tokens. A null text counts as
    empty and holds the end token only; repeated rows are written as they come.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text))
    schema = ("first_row long, n_rows int, row_length int, ids binary, cu_seqlens array<int>, resets array<int>, "
              "doc array<long>, start array<long>, doc_tokens array<long>")
    names = ["first_row", "n_rows", "row_length", "ids", "cu_seqlens", "resets", "doc", "start", "doc_tokens"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(rank_encoder, path, pattern).encode
        block, first = Block(s), TaskContext.get().partitionId() << 32

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal first
            for at, n, *rest in block.matrices(first):
                values = [at, n, s.row, *rest]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)
                first = at + n

        for b in batches:
            ids_of = iter(b.column(0).to_pylist())
            for part in slices(values(b.column(1)), 8 << 20):
                for ids in encode([t.decode("utf-8", "surrogatepass") for t in part]):
                    block.add(next(ids_of), np.append(ids, np.uint16(s.end)))
                    if block.tokens >= s.block_tokens:
                        yield from out()
        yield from out()

    slim.mapInArrow(run, schema).write.option("compression", "zstd").parquet(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """The written matrices."""
    return spark.read.parquet(out)


def pieces(matrices: DataFrame) -> DataFrame:
    """One row per document piece of written matrices: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary)."""
    at = F.posexplode(F.arrays_zip("doc", "start", "doc_tokens", "resets", F.slice("cu_seqlens", 2, F.size("cu_seqlens") - 1).alias("until"))).alias("i", "p")
    flat = matrices.select("first_row", "row_length", "ids", at).where("p.start >= 0")
    length = F.col("p.until") - F.col("p.resets")
    return flat.select(
        F.col("p.doc").alias("doc_id"), F.col("p.start").alias("start"), length.cast("long").alias("length"), F.col("p.doc_tokens").alias("doc_tokens"),
        (F.col("first_row") + F.floor(F.col("p.resets") / F.col("row_length"))).alias("sequence_id"),
        (F.col("p.resets") % F.col("row_length")).cast("long").alias("offset"),
        F.substring("ids", 2 * F.col("p.resets") + 1, 2 * length).alias("ids"))
