"""Byte-level BPE by a segment tree over the pair ranks of a piece.

A piece starts as one token per byte. The tree's leaves hold, for each live
token, the rank of the pair it forms with its right neighbour; each inner node
holds the smallest rank below it, the leftmost where ranks tie, as the number
``rank << 32 | position``. A merge takes the root, joins two neighbours in the
linked list, and updates the three leaves that changed, in logarithmic time.
Short pieces of a batch go through the same steps together, one numpy row each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import blank_parts, ddl, slices, text_bytes, values, without

NONE = 1 << 62
WIDE = 64
ROWS = 4_000
KNOWN = 700_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merger:
    """Merges the bytes of a piece by a table ``left id << 32 | right id`` to joined id.

    A smaller joined id is merged earlier. ``last_ids`` are the ids of bytes
    that end a piece, where they differ from ``byte_ids``.
    """

    def __init__(self, found: dict[int, int], byte_ids: np.ndarray, last_ids: np.ndarray):
        self.pairs, self.byte_ids, self.last_ids = found, byte_ids, last_ids
        bits = max(16, (2 * len(found)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int64)
        self.joined = np.full(1 << bits, NONE, np.int64)
        keys, values = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        at = self._slot(keys)
        while len(keys):  # open addressing: the first key at a free slot gets it, the others move on
            free = self.slots[at] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slots[at[put]], self.joined[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it is no token."""
        keys = left << 32 | right
        at = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            got = self.slots[at]
            hit = got == keys[todo]
            out[todo[hit]] = self.joined[at[hit]]
            on = ~hit & (got != -1)
            todo, at = todo[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def _merge_rows(self, pieces: list[bytes], size: int, kind: type) -> list[bytes]:
        """Token ids of pieces of at most ``size`` bytes (a power of two), all merged side by side."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        length = np.fromiter(map(len, pieces), np.int64, n)
        ids = self.byte_ids[raw]
        ids[np.arange(n), length - 1] = self.last_ids[raw[np.arange(n), length - 1]]
        ids[np.arange(size) >= length[:, None]] = -1
        after = np.tile(np.arange(1, size + 1), (n, 1))
        before = np.tile(np.arange(-1, size - 1), (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int64)
        row, col = np.nonzero(ids[:, 1:] >= 0)
        rank = self._pair_ranks(ids[row, col], ids[row, col + 1])
        tree[row, size + col] = np.where(rank == NONE, NONE, rank << 32 | col)
        half = size
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        flat, nodes = tree.reshape(-1), 2 * size

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            base, node = rows * nodes, at + size
            flat[base + node] = value
            while node.size and node[0] > 1:
                node = node >> 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            best = tree[live, 1]
            i = best & 0xFFFFFFFF
            j = after[live, i]
            k = after[live, j]
            ids[live, i] = best >> 32
            ids[live, j] = -1
            after[live, i] = k
            inner = k < length[live]
            before[live[inner], k[inner]] = i[inner]
            put(live, j, np.full(len(live), NONE, np.int64))
            value = np.full(len(live), NONE, np.int64)
            rank = self._pair_ranks(ids[live[inner], i[inner]], ids[live[inner], k[inner]])
            value[inner] = np.where(rank == NONE, NONE, rank << 32 | i[inner])
            put(live, i, value)
            h = before[live, i]
            some = h >= 0
            rows, left, right = live[some], h[some], i[some]
            rank = self._pair_ranks(ids[rows, left], ids[rows, right])
            put(rows, left, np.where(rank == NONE, NONE, rank << 32 | left))
            live = live[tree[live, 1] != NONE]
        keep = ids >= 0
        raw = ids[keep].astype(kind).tobytes()
        ends = (np.dtype(kind).itemsize * np.cumsum(keep.sum(1))).tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same steps for one long piece, on plain lists."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        ids = [*map(int, self.byte_ids[list(piece[:-1])]), int(self.last_ids[piece[-1]])]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        tree = [NONE] * (2 * size)

        def rank(i: int, j: int) -> int:
            got = pairs.get(ids[i] << 32 | ids[j])
            return NONE if got is None else got << 32 | i

        for i in range(n - 1):
            tree[size + i] = rank(i, i + 1)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = size + at
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] != NONE:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = tree[1] >> 32, -1, k
            put(j, NONE)
            if k < n:
                before[k] = i
            put(i, rank(i, k) if k < n else NONE)
            if before[i] >= 0:
                put(before[i], rank(before[i], i))
        return [i for i in ids if i >= 0]

    def merge(self, pieces: list[bytes], kind: type = np.uint32) -> list[bytes]:
        """Token ids of each piece (not empty), as the bytes of numbers of ``kind``."""
        out: list = [None] * len(pieces)
        sized: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            if len(piece) > WIDE:
                out[at] = np.array(self._merge_long(piece), kind).tobytes()
            else:
                sized.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(at)
        for size, places in sized.items():
            for lo in range(0, len(places), ROWS):
                some = places[lo : lo + ROWS]
                for at, ids in zip(some, self._merge_rows([pieces[i] for i in some], size, kind)):
                    out[at] = ids
        return out


class Bpe(Merger):
    """Encoder and decoder for one rank table and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every way to cut a token into two tokens.
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        super().__init__(found, byte_ids, byte_ids)

    def merge(self, pieces: list[bytes], kind: type = np.uint32) -> list[bytes]:
        """Token ids of each match of the pattern; a match that is a token itself stays whole."""
        whole = [self.ranks.get(p) for p in pieces]
        rest = iter(super().merge([p for p, w in zip(pieces, whole) if w is None], kind))
        width = np.dtype(kind).itemsize
        return [next(rest) if w is None else w.to_bytes(width, "little") for w in whole]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TextEncoder:
    """Encodes batches of texts; remembers up to ``KNOWN`` blank-separated parts."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text (unsigned 32-bit)."""
        if len(self.known) > KNOWN:
            self.known.clear()
        known, cut, new, heads = self.known, [], set(), set()
        for text in texts:
            parts = blank_parts(text)
            heads.add(parts[0])
            parts[0] = "\0" + parts[0]  # no other part can be taken for it: it stands for itself
            cut.append(parts)
            new.update(set(parts[1:]).difference(known))
        todo = [" " + p for p in new] + list(heads)
        names = list(new) + ["\0" + h for h in heads]
        matches = list(map(self.bpe.split, todo))
        pieces = list({m for ms in matches for m in ms})
        ids = dict(zip(pieces, self.bpe.merge([p.encode() for p in pieces])))
        first: dict[str, bytes] = {}
        for at, (name, ms) in enumerate(zip(names, matches)):
            raw = ids[ms[0]] if len(ms) == 1 else b"".join([ids[m] for m in ms])
            if at < len(new):
                known[name] = raw
            else:
                first[name] = raw
        return [np.frombuffer(b"".join([first[p[0]], *map(known.__getitem__, p[1:])]), np.uint32) for p in cut]


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder per worker process and rank file."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TextEncoder(Bpe(read_ranks(path), pattern))
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", digests: bool = False) -> DataFrame:
    """All columns but the text, with ``ids`` (array<int>) and ``decoded`` (binary).

    ``digests`` gives ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in
    their place. A null text counts as empty and has no id. Each match of the
    pattern is encoded by itself; the decoded bytes come from the ids alone.
    """
    docs = without(docs, ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"))
    rest = [c for c in docs.columns if c != text]
    slim = docs.select(*[F.col(f"`{c}`") for c in rest], text_bytes(text, "__text"))
    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            made: list[tuple] = []
            for part in slices(values(b.column(b.num_columns - 1)), 8 << 20):
                for ids in enc.encode([t.decode() for t in part]):
                    numbers = ids.tolist()
                    back = enc.bpe.decode(numbers)
                    if digests:
                        listed = ",".join(map(str, numbers)).encode()
                        made.append((len(numbers), hashlib.sha256(listed).hexdigest(), hashlib.sha256(back).hexdigest()))
                    else:
                        made.append((numbers, back))
            kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.binary()]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
            new = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*rest, *names])

    return slim.mapInArrow(run, ddl(docs, rest, extra))
