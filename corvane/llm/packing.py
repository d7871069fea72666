"""Packing documents into token windows by the sum-of-squares rule, online within each partition."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import encoder

WINDOW = 4096
#: Partly filled windows that a task holds at most, which bounds its memory; beyond it they are topped up and closed.
MAX_OPEN = 4096


class SumOfSquares:
    """counts[g] = number of open windows filled to level g. A piece goes to the level that makes sum(counts^2) smallest.

    Moving a window from level g to g + s changes the sum by 2 (counts[g + s] - counts[g]) + 2, closing it by
    1 - 2 counts[g], opening one by 2 counts[s] + 1. Ties: the fullest window, an open one before a new one.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)

    def place(self, s: int) -> int:
        """The level that the piece of s tokens goes to (0: a new window); counts are updated."""
        w, n = self.window, self.counts
        if s >= w:
            return 0
        best, level = 2 * int(n[s]) + 1, 0
        have = n[1 : w - s + 1]
        if have.any():
            change = 2 * (n[1 + s : w + 1] - have) + 2
            change[-1] = 1 - 2 * int(have[-1])
            change[have == 0] = np.iinfo(np.int64).max
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                level = at + 1
        if level:
            n[level] -= 1
        if level + s < w:
            n[level + s] += 1
        return level


class Packer:
    """Streams (key, ids) to pieces (key, start, ids, total, sequence, offset). Full windows of a long document are cut off first.

    ruled: ids in windows as the rule placed them, full windows of long documents apart; moved: ids cut out of the
    emptiest windows to top up the others.
    """

    def __init__(self, first_sequence: int, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.rule = SumOfSquares(window)
        self.levels: dict[int, deque[int]] = defaultdict(deque)
        self.open: dict[int, list[tuple]] = {}
        self.next = first_sequence
        self.out: list[tuple] = []
        self.ruled = self.moved = 0

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, key, ids: np.ndarray) -> None:
        total, w = len(ids), self.window
        whole = total - total % w
        for s in range(0, whole, w):
            self.out.append((key, s, ids[s : s + w], total, self._new(), 0))
        if whole == total:
            return
        piece = (key, whole, ids[whole:], total)
        size = total - whole
        level = self.rule.place(size)
        seq = self.levels[level].popleft() if level else self._new()
        self.open.setdefault(seq, []).append((*piece, level))
        if level + size == w:
            self._emit(seq)
        else:
            self.levels[level + size].append(seq)
        if len(self.open) > self.max_open:
            self.flush(last=False)

    def _emit(self, seq: int) -> None:
        pieces = self.open.pop(seq)
        self.ruled += sum(len(p[2]) for p in pieces)
        self.out += [(k, s, ids, total, seq, off) for k, s, ids, total, off in pieces]

    def _fill(self, seq: int, at: int, stop: int, pieces: deque[tuple]) -> list[tuple]:
        """Pieces as an open window has them, cut off the front of `pieces`, for the places at..stop of the window."""
        out = []
        while at < stop:
            k, s, ids, total = pieces.popleft()
            take = min(len(ids), stop - at)
            out.append((k, s, ids[:take], total, at))
            if take < len(ids):
                pieces.appendleft((k, s + take, ids[take:], total))
            at += take
        self.moved += sum(len(p[2]) for p in out)
        return out

    def flush(self, last: bool = True) -> None:
        """Close the open windows: the fullest keep what the rule put there and are topped up with cuts of the emptiest.

        As many are kept as the others can fill. What is then left, less than a window, is cut at powers of two, which
        need no padding; or stays an open window while more is to come.
        """
        w = self.window
        fill = {seq: sum(len(p[2]) for p in pieces) for seq, pieces in self.open.items()}
        order = sorted(fill, key=lambda seq: (-fill[seq], seq))
        kept, gaps, rest = 0, 0, sum(fill.values())
        while kept < len(order) and gaps + w - fill[order[kept]] <= rest - fill[order[kept]]:
            gaps += w - fill[order[kept]]
            rest -= fill[order[kept]]
            kept += 1
        pieces = deque(p[:4] for seq in order[kept:] for p in self.open.pop(seq))
        for seq in order[:kept]:
            more = self._fill(seq, fill[seq], w, pieces)
            self._emit(seq)
            self.out += [(*p[:4], seq, p[4]) for p in more]
        self.levels.clear()
        self.rule.counts[:] = 0
        left = rest - gaps
        if left and not last:
            seq = self._new()
            self.open[seq] = [(k, s, ids, total, at) for (k, s, ids, total), at in zip(pieces, np.cumsum([0, *[len(p[2]) for p in pieces]])[:-1].tolist(), strict=True)]
            self.levels[left].append(seq)
            self.rule.counts[left] = 1
            return
        while left:
            size, seq = 1 << (left.bit_length() - 1), self._new()
            self.out += [(*p[:4], seq, p[4]) for p in self._fill(seq, 0, size, pieces)]
            left -= size

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, make_encoder: Callable[[], Callable[[pa.Array], list[np.ndarray]]] | None = None, window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """docs(doc_id, text) -> pieces. Each partition packs its rows as they come; sequence ids are partition * 2^33 + local number.

    Null and empty texts have the end id alone. Repeated rows are packed once each. A null doc_id stays null. Every
    id lies in one piece; offsets in a sequence run from 0 without gaps; sequences hold `window` ids or a power of two.
    """
    make = make_encoder or encoder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        packer = Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 33, window, max_open)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def rows() -> pa.RecordBatch:
            got = [(k, s, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, seq, off) for k, s, ids, total, seq, off in packer.drain()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*got, strict=True) if got else [[]] * 7)], names=names)

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    packer.add(key, ids)
                yield rows()
        packer.flush()
        yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, SCHEMA)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
