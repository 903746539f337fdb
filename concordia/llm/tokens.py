"""Token ids of whole texts, by the tokenizers library with a memory of pieces."""

from __future__ import annotations

import ctypes
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The executors' tasks are the parallelism; threads of the library would only add to them.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Texts with anything but printable Latin characters and line feeds, or with three of blank and
#: line feed together, or two at the end, are not cut.
_UNCUT = r"[^\x20-\x7e\n\x{a1}-\x{24f}]|[ \n][ \n]([ \n]|\z)"
#: A worker remembers up to twice as many pieces, then only as many, those used last; under 100 bytes each.
MEMORY = 600_000
#: Marks that the pre-tokenizer always parts from a letter before them.
_MARKS = ".,;:!?#$%&*()[]{}<>|/\\\"`~@^_+=-"
#: Marks the start of a text; never in a text that is cut.
_START = "\x01"
#: Starts pieces that stand right after another one.
_MARK = "\x02"
#: So many pieces pass the library as lines of one string, so many strings at a time: longer ones cost more.
_LINES = 64
_NO_IDS = np.empty(0, np.uint32)
_HASHED = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the lowest so many bytes.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Whether a byte is an ASCII letter or digit.
_ENDS = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: Makes the C library give free memory back, where it can.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that start at ``begin``, one after another."""
    stop = np.cumsum(size)
    return flat[np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]


def _hashes(pieces: pa.LargeStringArray) -> np.ndarray:
    """64 bits of the length and of the first and last _HASHED bytes of each piece."""
    begin = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
    size = np.diff(begin)
    data = np.concatenate((np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]], np.zeros(8, np.uint8)))
    begin = begin[:-1] - begin[0]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    made = size.astype(np.uint64) * _MIX

    def mix(of: np.ndarray, at: np.ndarray, held: np.ndarray) -> None:
        got = (made[of] ^ (eight[at] & _LOWEST[held])) * _MIX
        made[of] = got ^ (got >> np.uint64(31))

    for k in range(0, _HASHED, 8):
        of = np.flatnonzero(size > k)
        mix(of, begin[of] + k, np.minimum(size[of] - k, 8))
    of = np.flatnonzero(size > _HASHED)
    for k in range(8, _HASHED + 1, 8):
        mix(of, begin[of] + size[of] - k, np.full(len(of), 8))
    return made


class Encoder:
    """encode() equals Tokenizer.encode(text, add_special_tokens=False).ids.

    The byte-level pre-tokenizer never joins a blank or line feed to what stands before it,
    and a single blank only to what follows.  So a text may be cut before every blank and
    line feed, unless several of them stand together, and between a letter and the marks
    that end its piece.  The pieces of many texts are cut, parted and numbered by Arrow, each
    new one passes the library, and the ids of the texts are gathered by number.  Other
    texts, and those with special strings or other scripts, pass the library whole.  Ids are
    little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str, memory: int | None = None):
        self.memory = memory
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.uncut = "|".join([_UNCUT, *(re.escape(t.content) for t in added)])
        self.cuts = self._cuts()
        self.line = self._ids("\n")
        # Lines can be told apart by the id of the line feed, unless an added token takes blanks along.
        self.lines = len(self.line) == 1 and not any(t.lstrip or t.rstrip or re.search(r"\s", t.content) for t in added)
        # Pieces without a letter or mark are known from the start and never forgotten.
        fixed = {_START: _NO_IDS, _MARK: _NO_IDS, "": self._ids(" "), "\n": self.line}
        self.fixed = len(fixed)
        self._start(pa.array(list(fixed), pa.large_string()))
        self.flat = np.concatenate(list(fixed.values()))
        self.size = np.array([len(ids) for ids in fixed.values()])
        self.used = np.zeros(len(fixed), np.int64)
        self.turn = 0

    def _cuts(self) -> bool:
        """Whether the tokenizer is of the kind that may be cut: byte-level, nothing before or after."""
        made = json.loads(self.tokenizer.to_str())
        kind = made["pre_tokenizer"] or {}
        return made["normalizer"] is None and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _whole(self, text: str) -> bytes:
        return self._ids(text).astype("<u4").tobytes()

    def _library(self, shown: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, none of which has a line feed or is blank, and how many each has."""
        if self.lines:
            texts = ["\n".join(shown[b : b + _LINES]) + "\n" for b in range(0, len(shown), _LINES)]
            made = (e.ids for b in range(0, len(texts), _LINES) for e in self.tokenizer.encode_batch_fast(texts[b : b + _LINES], add_special_tokens=False))
            flat = np.concatenate([_NO_IDS, *(np.frombuffer(array("I", ids), np.uint32) for ids in made)])
            ends = np.flatnonzero(flat == self.line[0])
            if len(ends) == len(shown):
                return flat[flat != self.line[0]], np.diff(ends, prepend=-1) - 1
        ids = [self._ids(x) for x in shown]
        return np.concatenate([_NO_IDS, *ids]), np.array([len(x) for x in ids], np.int64)

    def _start(self, pieces: pa.LargeStringArray) -> None:
        """Know these pieces and no others: by their hashes, or by themselves if another has the same."""
        self.known, self.other = pieces[:0], {}
        self.hashes, self.places = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._add(pieces, _hashes(pieces))

    def _add(self, pieces: pa.LargeStringArray, hashes: np.ndarray) -> None:
        """Number pieces that are not known."""
        n = len(self.known)
        self.known = pa.concat_arrays([self.known, pieces])
        order = np.argsort(hashes, kind="stable")
        rising = hashes[order]
        at = np.searchsorted(self.hashes, rising)
        free = np.append(True, rising[1:] != rising[:-1])[: len(rising)]
        inner = at < len(self.hashes)
        free[inner] &= self.hashes[at[inner]] != rising[inner]
        self.hashes = np.insert(self.hashes, at[free], rising[free])
        self.places = np.insert(self.places, at[free], n + order[free])
        self.other.update((pieces[i].as_py(), n + i) for i in order[~free].tolist())

    def _find(self, pieces: pa.LargeStringArray, hashes: np.ndarray) -> np.ndarray:
        """Numbers of distinct pieces, or -1."""
        order = np.argsort(hashes)
        at = np.empty(len(order), np.int64)
        at[order] = np.searchsorted(self.hashes, hashes[order])
        at[at == len(self.hashes)] = 0
        met = np.flatnonzero(self.hashes[at] == hashes)
        found = np.full(len(pieces), -1)
        found[met] = self.places[at[met]]
        same = pc.equal(pieces.take(pa.array(met)), self.known.take(pa.array(found[met]))).to_numpy(zero_copy_only=False)
        for i in met[~same].tolist():
            found[i] = self.other.get(pieces[i].as_py(), -1)
        return found

    def _learn(self, new: pa.LargeStringArray, hashes: np.ndarray) -> None:
        """Number pieces that are not known and keep their ids."""
        self._add(new, hashes)
        shown = new.to_pylist()
        flat, size = self._library([p[1:] if p[0] in (_START, _MARK, "\n") else " " + p for p in shown])
        lines = np.array([p[0] == "\n" for p in shown], bool)
        flat = np.insert(flat, np.repeat((np.cumsum(size) - size)[lines], len(self.line)), np.tile(self.line, np.count_nonzero(lines)))
        self.flat = np.concatenate((self.flat, flat))
        self.size = np.concatenate((self.size, size + len(self.line) * lines))
        self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))

    def _forget(self, keep: int) -> None:
        """Keep the pieces that were used last, and the fixed ones."""
        self.used[: self.fixed] = self.turn + 1
        kept = np.sort(np.argsort(-self.used, kind="stable")[: max(keep, self.fixed)])
        self._start(self.known.take(pa.array(kept)))
        self.flat = _gather(self.flat, (np.cumsum(self.size) - self.size)[kept], self.size[kept])
        self.size, self.used = self.size[kept], self.used[kept]

    def _numbers(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """Numbers of pieces, which may repeat; new ones are learned."""
        coded = pieces.dictionary_encode()
        distinct, hashes = coded.dictionary, _hashes(coded.dictionary)
        found = self._find(distinct, hashes)
        lacking = np.flatnonzero(found < 0)
        if len(lacking):
            found[lacking] = len(self.known) + np.arange(len(lacking))
            self._learn(distinct.take(pa.array(lacking)), hashes[lacking])
        self.used[found] = self.turn
        return found[coded.indices.to_numpy()]

    def _parted(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct pieces up to a last letter or ASCII digit, and of the marks after it (or of nothing)."""
        pieces = pieces.cast(pa.large_string())
        size = pc.binary_length(pieces).to_numpy()
        bare = pc.binary_length(pc.ascii_rtrim(pieces, _MARKS)).to_numpy()
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        begin = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
        last = np.flatnonzero((bare > 0) & (bare < size))
        at = begin[last] + bare[last] - 1
        one, two = data[at], data[at - 1]
        # Of the characters beyond ASCII in a text that is cut, all from U+00C0 are letters but U+00D7 and U+00F7.
        lettered = _ENDS[one] | ((one >= 0x80) & (two >= 0xC3) & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7))))
        cut = size.copy()
        cut[last[lettered]] = bare[last[lettered]]
        # Both parts of every piece are views of its bytes.
        bounds = np.empty(2 * len(pieces) + 1, np.int64)
        bounds[0::2], bounds[1::2] = begin, begin[:-1] + cut
        parts = pa.LargeStringArray.from_buffers(2 * len(pieces), pa.py_buffer(bounds), pieces.buffers()[2])
        even = np.arange(0, 2 * len(pieces), 2)
        marks = parts.take(pa.array(even + 1)).dictionary_encode()
        shown = pc.binary_join_element_wise(pa.scalar(_MARK, pa.large_string()), marks.dictionary, pa.scalar("", pa.large_string()))
        both = self._numbers(pa.concat_arrays([parts.take(pa.array(even)), shown]))
        return both[: len(pieces)], both[len(pieces) :][marks.indices.to_numpy()]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text (null: none) as bytes."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if self.cuts:
            whole = pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False)
        else:
            whole = np.ones(len(texts), bool)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._whole(texts[i].as_py())
        at = np.flatnonzero(~whole)
        if not len(at):
            return out
        marked = pc.binary_join_element_wise(_START, texts.take(pa.array(at)), "")
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        number = coded.indices.to_numpy()
        self.turn += 1
        parts = np.stack(self._parted(coded.dictionary), axis=1)
        each = self.size[parts]
        flat = _gather(self.flat, (np.cumsum(self.size) - self.size)[parts.ravel()], each.ravel())
        size = each.sum(axis=1)
        begin = np.cumsum(size) - size
        raw = _gather(flat, begin[number], size[number]).astype("<u4", copy=False).tobytes()
        ends = np.concatenate(([0], np.cumsum(size[number])))[np.asarray(lists.offsets)]
        for k, i in enumerate(at.tolist()):
            out[i] = raw[4 * ends[k] : 4 * ends[k + 1]]
        keep = self.memory or MEMORY
        if len(self.known) > 2 * keep:
            self._forget(keep)
        return out


@cache
def encoder(path: str, memory: int | None = None) -> Encoder:
    """One per worker and tokenizer, with that many pieces remembered (MEMORY, if not given)."""
    return Encoder(path, memory)


def gathered(batches: Iterator[pa.RecordBatch], size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes: many small ones are joined."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def release() -> None:
    """Give back memory that Arrow and malloc keep though nothing uses it: a worker lives on, and its executor has other steps to run."""
    pa.default_memory_pool().release_unused()
    _trim(0)
