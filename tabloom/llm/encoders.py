"""Token ids of whole texts from public vocabulary files, part by part.

Both encoders below give exactly what the public encoders give for the whole text.
They cut a text at blanks no token crosses and remember the ids of the parts,
because most parts of a corpus occur again and again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from tabloom.llm.bpe import Merger, read_ranks
from tabloom.llm.common import blank_parts

KNOWN = 500_000
_MARKS = {".", ","}
# One word of composed Latin letters (without İ, which has no single small letter), and a mark.
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[.,]?$"


class PartEncoder:
    """Ids (unsigned 16-bit) of texts; remembers about ``most`` parts, those of late use.

    ``encode_parts`` gives the ids of strings as bytes; parts after the first
    keep their leading blank.
    """

    def __init__(self, encode_parts: Callable[[list[str]], list[bytes]]):
        self.encode_parts = encode_parts
        self.most = KNOWN
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def forget(self) -> None:
        self.known, self.before = {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.most // 2:
            self.before, self.known = self.known, {}
        known, found, new, heads = self.known, [], set(), set()
        for text in texts:
            parts = blank_parts(text)
            heads.add(parts[0])
            ids = list(map(known.get, parts))
            ids[0] = b""  # the first part has no blank in front, so it is looked up apart
            if None in ids:
                gaps = [(at, parts[at]) for at, got in enumerate(ids) if got is None]
                new.update([part for _, part in gaps])
            else:
                gaps = []
            found.append((parts[0], ids, gaps))
        known.update([(p, self.before[p]) for p in new if p in self.before])
        heads, new = list(heads), list(new.difference(known))
        made = self.encode_parts(heads + [" " + p for p in new])
        first = dict(zip(heads, made))
        known.update(zip(new, made[len(heads) :]))
        out = []
        for head, ids, gaps in found:
            ids[0] = first[head]
            for at, part in gaps:
                ids[at] = known[part]
            out.append(np.frombuffer(b"".join(ids), np.uint16))
        return out


def _word(part: str) -> tuple[str, str] | None:
    """A part as lower-cased word and mark, if it is one word of composed Latin letters; else None."""
    mark = part[-1:]
    if mark in _MARKS:
        part = part[:-1]
    else:
        mark = ""
    word = part.lower()
    return (word, mark) if word.isalpha() and (part.isascii() or max(part) < "\u0250") else None


class WordEncoder:
    """Ids (unsigned 16-bit) of texts for a tokenizer that drops white space and lowers case.

    The distinct parts of a list of texts, and of those the distinct words, are found by columnar dictionaries; only
    words not seen of late are merged, and the ids of the texts are gathered by index.
    """

    def __init__(self, merge: Callable[[list[str]], list[bytes]], public: Callable[[list[str]], list[bytes]]):
        self.merge, self.public = merge, public
        self.marks = public([".", ","]) + [b""]
        self.most = KNOWN
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}  # words, and behind a blank parts that are none
        self.before: dict[str, bytes] = {}

    def _ids(self, keys: list[str], make: Callable[[list[str]], list[bytes]], mark: str = "") -> list[bytes]:
        """Ids of distinct words or parts, remembered ones first."""
        names = [mark + k for k in keys] if mark else keys
        found = list(map(self.known.get, names))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            found[i] = self.before.get(names[i])
            if found[i] is None:
                new.append(i)
        for i, ids in zip(new, make([keys[i] for i in new]) if new else []):
            found[i] = ids
        self.known.update((names[i], found[i]) for i in missing)
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.most // 2:
            self.before, self.known = self.known, {}
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        parts = coded.dictionary
        mark = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(parts, -1, None), value_set=pa.array([".", ","], parts.type)), 2)
        word = pc.utf8_lower(pc.if_else(pc.less(mark, 2), pc.utf8_slice_codeunits(parts, 0, -1), parts))
        plain = pc.match_substring_regex(parts, PLAIN).to_numpy(zero_copy_only=False)
        marks = mark.to_numpy(zero_copy_only=False).astype(np.int64)
        words = word.filter(pa.array(plain)).dictionary_encode()
        names = words.dictionary.to_pylist()
        item = np.zeros(len(parts), np.int64)
        item[plain] = words.indices.to_numpy()
        at, others = {w: i for i, w in enumerate(names)}, []
        rest = np.flatnonzero(~plain)
        for i, part in zip(rest.tolist(), parts.take(pa.array(rest)).to_pylist()):
            if found := _word(part):
                item[i] = at.setdefault(found[0], len(at))
                marks[i] = (".", ",", "").index(found[1])
            else:
                others.append((i, part))
        items = self._ids(list(at), self.merge)
        for i, _ in others:
            item[i], marks[i] = len(items), 2
            items.append(b"")
        for (i, _), ids in zip(others, self._ids([p for _, p in others], self.public, " ")):
            items[item[i]] = ids
        first = len(items)
        items += self.marks
        sizes = np.fromiter(map(len, items), np.int64, len(items)) // 2
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(items), np.uint16)
        index = coded.indices.to_numpy()
        both = np.stack([item[index], marks[index] + first], 1).reshape(-1)  # a part is a word and a mark
        length = sizes[both]
        ends = np.cumsum(length)
        ids = flat[np.repeat(starts[both] - (ends - length), length) + np.arange(int(length.sum()))]
        edges = np.concatenate([[0], ends])[2 * cut.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(edges, edges[1:])]


def word_encoder(path: str) -> WordEncoder:
    """A tokenizer file that drops white space, lowers case and marks the ends of words.

    Words of Latin letters, with a full stop or comma or without, are merged in
    batches by the file's merges; all else goes through the public encoder.
    """
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path) as lines:
        model = json.load(lines)["model"]
    vocabulary, end = model["vocab"], model["end_of_word_suffix"]
    # How byte-level files write bytes: printable ones as themselves, the others from U+0100 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    pairs = {}
    for merge in model["merges"]:
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        pairs[vocabulary[left] << 32 | vocabulary[right]] = vocabulary[left + right]
    order = list(pairs.values())
    if order != sorted(order):
        raise ValueError("ids must follow the order of the merges")
    merger = Merger(pairs, np.array([vocabulary[letter[b]] for b in range(256)]), np.array([vocabulary[letter[b] + end] for b in range(256)]))

    def public(parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint16).tobytes() for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    return WordEncoder(lambda words: merger.merge([w.encode() for w in words], np.uint16), public)


def rank_encoder(path: str, pattern: str) -> PartEncoder:
    """A rank file with a pattern whose matches hold a blank only in front."""
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return PartEncoder(lambda parts: [np.array(encoding.encode_ordinary(p), np.uint16).tobytes() for p in parts])


_MADE: dict[tuple, PartEncoder | WordEncoder] = {}


def encoder(make: Callable[..., PartEncoder | WordEncoder], *args: str) -> PartEncoder | WordEncoder:
    """One encoder per worker process, maker and files."""
    key = (make.__name__, *args)
    if key not in _MADE:
        _MADE[key] = make(*args)
    return _MADE[key]
