"""Sequence packing by non-negative least squares over a length histogram.

Tokens arrive in blocks of bounded size. In a block, documents are cut into
whole windows and a rest; the rests' lengths, in steps of ``grain``, form the
histogram. All combinations of at most ``depth`` lengths that fill a window are
enumerated, least squares gives how often to repeat each, the counts are rounded
up as far as there are pieces, and what remains is packed greedily: one piece after the other, cut where
a window is full. The last, open window of a block goes on in the next block;
at the very end it is cut into windows of power-of-two length without padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import slices, text_bytes, values
from tabloom.llm.encoders import KNOWN, encoder, word_encoder

END = 1


@dataclass(frozen=True)
class Settings:
    window: int = 2048
    grain: int = 8
    depth: int = 3
    block_tokens: int = 8_000_000
    end: int = END
    known: int = KNOWN  # encoded parts a worker remembers
    slice_bytes: int = 8 << 20  # text encoded at a time
    remember: bool = True  # keep encoded parts from task to task; else a worker gives its memory back


@cache
def combinations(steps: int, depth: int) -> tuple[tuple[int, ...], ...]:
    """All non-increasing tuples of at most ``depth`` numbers from 1 that add up to ``steps``."""

    def grow(left: int, most: int, deep: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
        elif deep:
            for x in range(min(left, most), 0, -1):
                if x * deep >= left:
                    for rest in grow(left - x, x, deep - 1):
                        yield (x, *rest)

    return tuple(grow(steps, steps, depth))


@cache
def _matrix(steps: int, depth: int) -> np.ndarray:
    mixes = combinations(steps, depth)
    a = np.zeros((steps + 1, len(mixes)))
    for i, mix in enumerate(mixes):
        for x in mix:
            a[x, i] += 1
    return a


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set of columns (Lawson and Hanson)."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    tiny = 1e-9 * max(1.0, float(np.abs(b).sum()))
    ridge = 1e-9  # keeps nearly dependent columns solvable
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tiny:
            break
        active.append(j)
        while True:
            part = a[:, active]
            z = np.linalg.solve(part.T @ part + ridge * np.eye(len(active)), part.T @ b)
            if z.min() > tiny:
                break
            now = x[active]
            low = np.flatnonzero(z <= tiny)
            room = np.divide(now[low], now[low] - z[low], out=np.zeros(len(low)), where=now[low] > z[low])
            x[active] = now + room.min() * (z - now)
            drop = {active[i] for i in np.flatnonzero(x[active] <= tiny)} or {active[-1]}
            x[list(drop)] = 0
            active = [k for k in active if k not in drop]
            if not active:
                z = np.zeros(0)
                break
        x[:] = 0
        x[active] = z
        if j not in active and gain[j] <= tiny * 10:
            break
    return x


def repeats(histogram: np.ndarray, steps: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which combination; never more pieces of a length than there are."""
    mixes = combinations(steps, depth)
    solved = least_squares(_matrix(steps, depth), histogram.astype(np.float64))
    left = histogram.astype(np.int64).copy()
    out = []
    for i in np.argsort(-solved, kind="stable"):
        if solved[i] <= 0:
            break
        need = np.bincount(mixes[i], minlength=steps + 1)
        used = need > 0
        times = min(int(np.ceil(solved[i])), int((left[used] // need[used]).min()))
        if times:
            left -= times * need
            out.append((mixes[i], times))
    return out


@dataclass
class Piece:
    """Tokens start.. of the document, as ids."""

    doc: object
    tokens: int
    start: int
    ids: np.ndarray


class Packer:
    """Packs the documents of one task; gives (piece, sequence, offset)."""

    def __init__(self, s: Settings, first: int):
        self.s = s
        self.next = first
        self.rests: list[Piece] = []
        self.open: list[Piece] = []
        self.held = 0

    def _sequence(self, pieces: Iterable[Piece]) -> Iterator[tuple[Piece, int, int]]:
        offset = 0
        for p in pieces:
            yield p, self.next, offset
            offset += len(p.ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple[Piece, int, int]]:
        w = self.s.window
        whole = len(ids) // w * w
        for start in range(0, whole, w):
            yield from self._sequence([Piece(doc, len(ids), start, ids[start : start + w])])
        if whole < len(ids):
            self.rests.append(Piece(doc, len(ids), whole, ids[whole:].copy()))
            self.held += len(ids) - whole
        if self.held >= self.s.block_tokens:
            yield from self.block()

    def block(self) -> Iterator[tuple[Piece, int, int]]:
        steps = self.s.window // self.s.grain
        by_step: list[list[Piece]] = [[] for _ in range(steps + 1)]
        for p in self.rests:
            by_step[-(-len(p.ids) // self.s.grain)].append(p)
        for mix, times in repeats(np.array(list(map(len, by_step))), steps, self.s.depth):
            for _ in range(times):
                yield from self._sequence([by_step[x].pop() for x in mix])
        self.rests, self.held = [], 0
        # Greedy: fill window after window, cutting a piece that does not fit.
        queue = [p for pieces in by_step for p in pieces] + self.open[::-1]
        self.open, room = [], self.s.window
        while queue:
            p = queue.pop()
            if len(p.ids) > room:
                queue.append(Piece(p.doc, p.tokens, p.start + room, p.ids[room:]))
                p = Piece(p.doc, p.tokens, p.start, p.ids[:room])
            self.open.append(p)
            room -= len(p.ids)
            if not room:
                yield from self._sequence(self.open)
                self.open, room = [], self.s.window

    def finish(self) -> Iterator[tuple[Piece, int, int]]:
        yield from self.block()
        queue, total = self.open[::-1], sum(len(p.ids) for p in self.open)
        self.open = []
        while total:
            room = size = 1 << (total.bit_length() - 1)
            now = []
            while room:
                p = queue.pop()
                if len(p.ids) > room:
                    queue.append(Piece(p.doc, p.tokens, p.start + room, p.ids[room:]))
                    p = Piece(p.doc, p.tokens, p.start, p.ids[:room])
                now.append(p)
                room -= len(p.ids)
            yield from self._sequence(now)
            total -= size


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", digests: bool = False, s: Settings = Settings()) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (array<int>).

    ``digests`` gives ``ids_crc32`` (of the ids as little-endian unsigned 32-bit
    numbers) in place of the ids. Every document, also one of null or empty
    text, ends with the ``end`` token. Sequence ids are unique and start anew,
    with the partition in the upper bits, in every partition of the input;
    repeated rows and ids are packed as they come.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), text_bytes(text))
    id_type = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    last = ("ids_crc32 long", "ids_crc32", pa.int64()) if digests else ("ids array<int>", "ids", pa.list_(pa.int32()))
    schema = f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, {last[0]}"
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", last[1]]
    kinds = [id_type, *[pa.int64()] * 5, last[2]]

    def shown(p: Piece, sequence: int, offset: int) -> tuple:
        ids = zlib.crc32(p.ids.astype("<u4").tobytes()) if digests else p.ids
        return p.doc, p.start, len(p.ids), p.tokens, sequence, offset, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(word_encoder, path)
        words.most = s.known
        packer = Packer(s, TaskContext.get().partitionId() << 32)
        made: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds[:-1])]
            last = [m[-1] for m in made]
            if digests:
                cols.append(pa.array(last, pa.int64()))
            else:
                ends = np.cumsum([0, *map(len, last)], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(ends, np.concatenate(last).astype(np.int32)))
            made.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            docs_of = iter(b.column(0).to_pylist())
            for part in slices(values(b.column(1)), s.slice_bytes):
                for ids in words.encode([t.decode("utf-8", "surrogatepass") for t in part]):
                    made.extend(shown(*x) for x in packer.add(next(docs_of), np.append(ids, np.uint16(s.end))))
                if len(made) >= 2_000:
                    yield batch()
        made.extend(shown(*x) for x in packer.finish())
        if made:
            yield batch()
        if not s.remember:
            words.forget()
            pa.default_memory_pool().release_unused()

    return slim.mapInArrow(run, schema)
