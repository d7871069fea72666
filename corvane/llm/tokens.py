"""Token ids of whole texts: pieces are looked up in bulk by their bytes, and only new pieces meet the tokenizer.

The vocabulary's pre-tokenizer never joins anything across a space, so the ids of a text are those of its chunks
between spaces and newlines in order, and marks that end a chunk after a letter are a piece of their own. The
vocabulary is lower case, so ASCII capitals are folded first. A piece of up to 16 bytes is its own key, two words of
eight bytes and its length, in a bounded table; longer ones are keyed by their bytes in a dictionary, and very long
ones go to the tokenizer each time. A text with the opening of a special token is encoded whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

NAME = "word_bpe_49k.json"
END = 2
#: Slots of the table, a power of two; it is emptied when half full, or when it holds so many ids or longer pieces.
SLOTS = 1 << 21
MOST_IDS = 1 << 24
MOST_LONG = 1 << 18
#: Bytes of the longest piece that is remembered.
REMEMBERED = 64
#: Bytes of text that are looked up at once; a longer single text is encoded by the tokenizer as it is.
BATCH_BYTES = 1 << 21
#: Trailing marks that are split off at most.
MOST_MARKS = 4

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Of a word of eight bytes the first n, little-endian.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?#*$%&|")] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def _bytes_to_chars() -> dict[int, str]:
    """Byte-level BPE writes printable Latin-1 bytes as they are and the others, in order, from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_CHARS = _bytes_to_chars()


class Pieces:
    """The table from pieces to their ids, and the tokenizer for what is new."""

    def __init__(self, path: str, slots: int = SLOTS, batch_bytes: int = BATCH_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.slots, self.batch_bytes = slots, batch_bytes
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.clear()

    def clear(self) -> None:
        self.low = np.zeros(self.slots, np.uint64)
        self.high = np.zeros(self.slots, np.uint64)
        self.size = np.zeros(self.slots, np.uint8)  # 0: a free slot
        self.place = np.zeros(self.slots, np.int32)
        self.count = np.zeros(self.slots, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.arena = np.zeros(1 << 16, np.uint32)
        self.used = self.entries = 0

    def ids_of(self, piece: bytes) -> array:
        s = piece.decode("utf-8", "surrogatepass")
        if s.isalpha() and (s.isascii() or max(s) < "Ā"):
            s = s.lower()  # letters only, composed: one piece for the vocabulary's model
            chars = s if s.isascii() else s.encode().decode("latin-1").translate(_CHARS)
            return array("I", [t.id for t in self.model.tokenize(chars)])
        return array("I", self.tok.encode(s, add_special_tokens=False).ids)

    def _slots(self, key: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        low, high, size = key
        with np.errstate(over="ignore"):
            h = low * _MIX[0] ^ (high + size.astype(np.uint64)) * _MIX[1]
            h = (h ^ (h >> np.uint64(29))) * _MIX[2]
            return (h >> self.shift).astype(np.int64)

    def _find(self, key: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Slots of the pieces, -1 where they are not in the table."""
        low, high, size = key
        slot = self._slots(key)
        out = np.full(len(slot), -1, np.int64)
        todo = np.arange(len(slot))
        while len(todo):
            at = slot[todo]
            held = self.size[at]
            hit = (self.low[at] == low[todo]) & (self.high[at] == high[todo]) & (held == size[todo])
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (held != 0)]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)
        return out

    def _store(self, ids: list[array]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids lie in the arena now, and how many they are."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(counts.sum())
        while self.used + total > len(self.arena):
            self.arena = np.concatenate((self.arena, np.zeros(len(self.arena), np.uint32)))
        places = self.used + np.cumsum(counts) - counts
        self.arena[self.used : self.used + total] = np.frombuffer(b"".join(x.tobytes() for x in ids), np.uint32)
        self.used += total
        return places, counts

    def _add(self, key: tuple[np.ndarray, np.ndarray, np.ndarray], ids: list[array]) -> None:
        """Enter pieces that are not in the table and differ from each other."""
        low, high, size = key
        places, counts = self._store(ids)
        self.entries += len(ids)
        slot = self._slots(key)
        todo = np.arange(len(slot))
        while len(todo):
            at, first = np.unique(slot[todo], return_index=True)
            first = first[self.size[at] == 0]  # of several for one slot the first has it
            mine = todo[first]
            at = slot[mine]
            self.low[at], self.high[at], self.size[at] = low[mine], high[mine], size[mine]
            self.place[at], self.count[at] = places[mine], counts[mine]
            todo = np.delete(todo, first)
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)

    def _long_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of ids of pieces over 16 bytes."""
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.long]
        if fresh:
            places, counts = self._store([self.ids_of(p) for p in fresh])
            self.long.update(zip(fresh, zip(places.tolist(), counts.tolist(), strict=True), strict=True))
        got = np.array([self.long[p] for p in pieces], np.int64)
        for p in fresh:
            if len(p) > REMEMBERED:
                del self.long[p]
        return got[:, 0], got[:, 1]

    def encode(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); raw: their UTF-8 bytes, ends: where each ends."""
        n = len(raw)
        heads = np.concatenate(([0], ends[:-1]))
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        low = _LOWER[raw]
        word = (raw != 32) & (raw != 10)
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        some = heads[heads < ends]
        first[some[word[some]]] = True
        tails = ends[heads < ends] - 1
        last[tails[word[tails]]] = True
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        cut = e.copy()
        for _ in range(MOST_MARKS):
            on = (cut > s) & _MARK[low[np.maximum(cut - 1, 0)]]
            if not on.any():
                break
            cut[on] -= 1
        before = low[np.maximum(cut - 1, 0)]
        latin = (cut - 2 >= s) & (low[np.maximum(cut - 2, 0)] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        split = cut[(cut < e) & (cut > s) & (_LETTER[before] | latin)]
        first[split] = True
        last[split - 1] = True
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if self.entries > self.slots // 4 or self.used > MOST_IDS or len(self.long) > MOST_LONG:
            self.clear()
        size = e - s
        place, count = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        bulk = np.flatnonzero(size <= 16)
        bytes_ = np.concatenate((low, np.zeros(16, np.uint8)))
        word8 = np.lib.stride_tricks.sliding_window_view(bytes_, 8)
        n8 = size[bulk]
        lo = np.ascontiguousarray(word8[s[bulk]]).view("<u8")[:, 0] & _FIRST[np.minimum(n8, 8)]
        hi = np.ascontiguousarray(word8[np.minimum(s[bulk] + 8, n)]).view("<u8")[:, 0] & _FIRST[np.maximum(n8, 8) - 8]
        key = (lo, hi, n8.astype(np.uint8))
        slot = self._find(key)
        new = np.flatnonzero(slot < 0)
        if len(new):
            known = {low[a:b].tobytes(): k for k, a, b in zip(new.tolist(), s[bulk[new]].tolist(), e[bulk[new]].tolist(), strict=True)}
            if self.entries + len(known) > self.slots // 2:
                if not self.entries:
                    return self._halves(raw, ends)
                self.clear()
                return self.encode(raw, ends)
            at = np.fromiter(known.values(), np.int64, len(known))
            self._add(tuple(x[at] for x in key), [self.ids_of(p) for p in known])
            slot[new] = self._find(tuple(x[new] for x in key))
        place[bulk], count[bulk] = self.place[slot], self.count[slot]
        rest = np.flatnonzero(size > 16)
        if len(rest):
            place[rest], count[rest] = self._long_pieces([low[a:b].tobytes() for a, b in zip(s[rest].tolist(), e[rest].tolist(), strict=True)])
        stop = np.cumsum(count)
        where = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(place - (stop - count), count)
        stop = np.concatenate(([0], stop))
        per = stop[np.searchsorted(s, ends)] - stop[np.searchsorted(s, heads)]
        return self.arena[where], per

    def _halves(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same as encode, of texts with more pieces than the table has room for; a single one goes to the tokenizer."""
        if len(ends) == 1:
            ids = np.array(self.tok.encode(raw.tobytes().decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, np.uint32)
            return ids, np.array([len(ids)])
        k = len(ends) // 2
        a = self.encode(raw[: ends[k - 1]], ends[:k])
        b = self.encode(raw[ends[k - 1] :], ends[k:] - ends[k - 1])
        return np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))


_loaded: dict[str, Pieces] = {}


def encoder(path: str | None = None, end: int = END) -> Callable[[list | pa.Array], list[np.ndarray]]:
    """Texts to uint32 id arrays, each closed by `end`. Null: empty text. path: the tokenizer's file, the public one by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(NAME)
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    pieces = _loaded[path]

    def encode(texts: list | pa.Array) -> list[np.ndarray]:
        col = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if col.null_count:
            col = col.fill_null("")
        out: list[np.ndarray] = []
        bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + pieces.batch_bytes, "right")) - 1)
            raw = data[bounds[at] : bounds[stop]]
            special = raw.tobytes().find(b"<|") >= 0
            if len(raw) > pieces.batch_bytes or (special and stop == at + 1):
                ids = pieces.tok.encode(raw.tobytes().decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
                out.append(np.array([*ids, end], np.uint32))
            elif special:  # such texts are rare: this batch goes text by text
                for k in range(at, stop):
                    out += encode(col.slice(k, 1))
            else:
                ids, per = pieces.encode(raw, bounds[at + 1 : stop + 1] - bounds[at])
                to = np.cumsum(per)
                closed = np.insert(ids, to, np.uint32(end))
                out += np.split(closed, (to + np.arange(1, len(to) + 1))[:-1])
            at = stop
        return out

    return encode
