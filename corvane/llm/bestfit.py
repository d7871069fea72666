"""Best-fit packing by the configuration linear program over the histogram of piece lengths.

A configuration is a multiset of lengths that fits a window. The covering program, as few windows as cover the
histogram, is solved by multiplicative weights: lengths that are covered least weigh most, and a knapsack by dynamic
programming prices the next configurations. The weights' best price bounds any packing from below. Rounding takes
whole uses of the configurations while the histogram has their pieces; a last part of bounded size goes by best fit
or by bounded knapsacks. The driver sees the histogram alone, which the window bounds, never pieces.

Pieces get their places by rank: a task numbers its pieces of a length, counts of tasks and lengths give the offsets,
and the plan says which ranks of a length lie in which copies of a configuration.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, release, table
from .segments import byte_level

WINDOW = 1024
END = 2
#: Steps in which the whole histogram is covered; a length runs ahead of its share by LEAD steps at most.
STEPS = 20
LEAD = 2
#: Knapsacks of a step at most.
PRICINGS = 60
#: How fast a length's weight fades with its coverage, and how much more a long piece weighs than its tokens.
FADE = 0.02
TILT = 0.5
#: Windows that are left to best fit, or to bounded knapsacks, whichever needs fewer; and uses of a length in one pass.
LAST = 300
SHARE = 0.3


def price_all(weights: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, list[int]]:
    """(value, last length chosen) of the best configuration for each fill level: unbounded knapsack by dynamic programming."""
    value, choice = np.zeros(window + 1), [-1] * (window + 1)
    upto = np.searchsorted(lengths, np.arange(window + 1), "right").tolist()
    for level in range(1, window + 1):
        value[level] = value[level - 1]
        k = upto[level]
        if k:
            tried = weights[:k] + value[level - lengths[:k]]
            at = int(tried.argmax())
            if tried[at] > value[level]:
                value[level], choice[level] = tried[at], at
    return value, choice


def price_bounded(weights: np.ndarray, lengths: np.ndarray, most: np.ndarray, window: int) -> np.ndarray:
    """Copies of each length in the best configuration with a length at most `most` times; bundles of 1, 2, 4, ... copies and a rest."""
    best = np.zeros(window + 1)
    bundles: list[tuple[int, int, np.ndarray]] = []
    for k in np.flatnonzero((weights > 0) & (most > 0)).tolist():
        size, left, m = int(lengths[k]), int(min(most[k], window // lengths[k])), 1
        while left > 0:
            m = min(m, left)
            tried = best[: -m * size] + weights[k] * m
            better = tried > best[m * size :]
            bundles.append((k, m, better))
            best[m * size :] = np.where(better, tried, best[m * size :])
            left -= m
            m *= 2
    copies, at = np.zeros(len(lengths), np.int64), window
    for k, m, better in reversed(bundles):
        step = m * int(lengths[k])
        if at >= step and better[at - step]:
            copies[k] += m
            at -= step
    return copies


def _around(k: int, lengths: list[int], choice: list[int], window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(lengths' positions, copies, free room) of the best configuration that holds length k."""
    copies, level, room = {k: 1}, window - lengths[k], 0
    while level > 0:
        j = choice[level]
        if j < 0:
            room += 1
            level -= 1
        else:
            copies[j] = copies.get(j, 0) + 1
            level -= lengths[j]
    return np.array(list(copies)), np.array(list(copies.values())), room


@dataclass
class Solution:
    """Uses of configurations, each ((position, copies), ...) in order of position; bound: no packing has fewer windows."""

    uses: dict[tuple, float]
    bound: float


def _tilted(lengths: np.ndarray, window: int) -> np.ndarray:
    return lengths * (1 + TILT * lengths / window)


def solve(lengths: np.ndarray, counts: np.ndarray, window: int = WINDOW, steps: int = STEPS) -> Solution:
    """The covering program over the histogram (lengths ascending), by multiplicative weights with knapsack pricing.

    Coverage of a length is the share of its count that the configurations so far hold. In each step every length gains
    a share of 1/steps. Weights fade with coverage; one knapsack prices, for each length that lags, the configuration
    around it, which is used until a length of it has its share; then weights are taken anew. What no configuration
    serves within the lead allowed, or within PRICINGS knapsacks, has windows of its own.
    """
    covered, uses, plain = np.zeros(len(lengths)), {}, lengths.tolist()
    bound, step = float((lengths * counts).sum()) / window, 1 / steps

    def use(at: np.ndarray, copies: np.ndarray, times: float) -> None:
        key = tuple(sorted(zip(at.tolist(), copies.tolist(), strict=True)))
        uses[key] = uses.get(key, 0.0) + times
        covered[at] += times * copies / counts[at]

    for goal in (np.arange(steps) + 1) * step:
        priced = 0
        while (lag := np.flatnonzero(covered < goal - 1e-12)).size:
            priced += 1
            weights = _tilted(lengths, window) * np.exp(np.clip(-FADE * (covered - goal + step) / step, -30, 3))
            value, choice = price_all(weights, lengths, window)
            bound = max(bound, float(weights @ counts) / value[window])
            moved = False
            for k in lag[::-1].tolist():
                if covered[k] >= goal - 1e-12:
                    continue
                at, copies, _ = _around(k, plain, choice, window)
                room = float(((goal + LEAD * step - covered[at]) * counts[at] / copies).min())
                times = min((goal - covered[k]) * counts[k] / copies[0], room)
                if times > 1e-12:
                    use(at, copies, times)
                    moved = True
            if not moved or priced == PRICINGS:
                for k in np.flatnonzero(covered < goal - 1e-12).tolist():
                    use(np.array([k]), np.array([1]), (goal - covered[k]) * counts[k])
    return Solution(uses, bound)


def _best_fit(lengths: np.ndarray, left: np.ndarray, window: int) -> Counter:
    """Best fit, decreasing, in the histogram. Uses of configurations."""
    out, left = Counter(), left.copy()
    while left.any():
        copies, room = np.zeros(len(lengths), np.int64), window
        for k in np.flatnonzero(left)[::-1].tolist():
            n = int(min(left[k], room // lengths[k]))
            copies[k] += n
            room -= n * int(lengths[k])
        _take(out, left, np.flatnonzero(copies), copies[copies > 0])
    return out


def _knapsacks(lengths: np.ndarray, left: np.ndarray, window: int) -> Counter:
    """A bounded knapsack for each window, long pieces first among equals. Uses of configurations."""
    out, left = Counter(), left.copy()
    tilt = lengths * (1 + 1e-6 * lengths / window)
    while left.any():
        copies = price_bounded(tilt, lengths, left, window)
        _take(out, left, np.flatnonzero(copies), copies[copies > 0])
    return out


def _take(out: Counter, left: np.ndarray, at: np.ndarray, copies: np.ndarray, times: int = 1 << 62) -> bool:
    """Use a configuration as often as asked and as the pieces that are left allow; False if not once."""
    times = min(times, int((left[at] // copies).min()))
    if times > 0:
        out[tuple(zip(at.tolist(), copies.tolist(), strict=True))] += times
        left[at] -= times * copies
    return times > 0


def rounded(lengths: np.ndarray, counts: np.ndarray, s: Solution, window: int = WINDOW) -> Counter:
    """Whole uses of configurations for exactly the counts.

    First the whole parts of the solution's uses, of configurations that fill a window; then configurations priced for
    what is left, each used by a share of its longest piece's count, while all of its pieces are there and fill a
    window; the last LAST windows by best fit or by bounded knapsacks, whichever has fewer.
    """
    left, out, plain = counts.astype(np.int64).copy(), Counter(), lengths.tolist()
    for key, n in sorted(s.uses.items(), key=lambda x: (-x[1], x[0])):
        at, copies = np.array(key, np.int64).T
        if int(lengths[at] @ copies) == window:
            _take(out, left, at, copies, int(n))
    moved = True
    while moved and int(lengths @ left) > LAST * window:
        moved = False
        weights = np.where(left > 0, _tilted(lengths, window) * (1 + 0.001 * left / counts), 0.0)
        _, choice = price_all(weights, lengths, window)
        quota = np.ceil(left * SHARE).astype(np.int64)
        for k in np.flatnonzero(left)[::-1].tolist():
            if left[k]:
                at, copies, room = _around(k, plain, choice, window)
                moved |= room == 0 and _take(out, left, at, copies, int(quota[k]))
    rest = _best_fit(lengths, left, window)
    if sum(rest.values()) <= 2 * LAST:
        rest = min(rest, _knapsacks(lengths, left, window), key=lambda c: sum(c.values()))
    return out + rest


@dataclass
class Plan:
    """Runs of ranks by length: ranks from `first` on lie `each` to a copy, in copies numbered from `sequence`, from `offset` on."""

    window: int
    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    bound: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and ranks."""
        at = np.zeros(len(length), np.int64)
        for k in np.unique(length).tolist():
            mine = np.flatnonzero(length == k)
            a, b = np.searchsorted(self.length, [k, k + 1])
            at[mine] = a + np.searchsorted(self.first[a:b], rank[mine], "right") - 1
        copy, slot = np.divmod(rank - self.first[at], self.each[at])
        return self.sequence[at] + copy, self.offset[at] + slot * length


def plan(lengths: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> Plan:
    """The histogram (lengths ascending) packed: solved, rounded, and laid out by ranks. Pieces as long as a window are windows."""
    inner = lengths < window
    full = int(counts[~inner].sum())
    bound = full
    runs: list[tuple[int, int, int, int, int]] = [(window, 0, 1, 0, 0)] if full else []
    sequence = full
    if inner.any():
        sizes, n = lengths[inner], counts[inner].astype(np.int64)
        s = solve(sizes, n, window)
        bound += int(np.ceil(s.bound - 1e-6))
        at = np.zeros(len(sizes), np.int64)
        for key, times in rounded(sizes, n, s, window).items():
            offset = 0
            for k, copies in reversed(sorted(key)):
                runs.append((int(sizes[k]), int(at[k]), copies, sequence, offset))
                at[k] += copies * times
                offset += copies * int(sizes[k])
            sequence += times
    runs.sort()
    return Plan(window, *[np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else [[]] * 5)], sequence, bound)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def pieces_of(docs: DataFrame, make_encoder: Callable[[], Callable[[str], np.ndarray]] | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> PIECES: ids cut where a document is longer than a window, the first piece then the shorter one.

    part and rank: the task, and the number among its pieces of that length. Null and empty texts have the end id alone.
    """
    make = make_encoder or _encoder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        ranks: Counter = Counter()
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                rows = []
                for key, text in zip(*[c.to_pylist() for c in b.slice(lo, 1024).columns], strict=True):
                    ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                    start, n = 0, 0
                    while start < len(ids):
                        stop = start + (((len(ids) - start) % window) or window) if start == 0 else start + window
                        size = stop - start
                        rows.append((key, n, start, size, zlib.crc32(ids[start:stop].tobytes()), part, ranks[size]))
                        ranks[size] += 1
                        start, n = stop, n + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, PIECES)


_loaded: list = []


def _encoder() -> Callable[[str], np.ndarray]:
    """A text's ids; special tokens' strings in a text are their ids, as the tokenizer has them."""
    if not _loaded:
        _loaded.append(byte_level()[0])
    return lambda text: _loaded[0].encode_to_numpy(text, allowed_special="all")


def plan_of(counts: DataFrame, window: int = WINDOW) -> Plan:
    """counts(length, n) -> the plan. At most `window` rows reach the driver, one a length."""
    rows = sorted((r.length, int(r.n)) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect())
    return plan(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), window)


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit(docs: DataFrame, make_encoder: Callable[[], Callable[[str], np.ndarray]] | None = None, window: int = WINDOW) -> tuple[DataFrame, Plan]:
    """docs(doc_id, text) -> (a row a piece (SCHEMA), the plan with its number of sequences and the lower bound).

    Sequences hold at most `window` ids, pieces whole, offsets from 0 without gaps. Null ids and repeated rows stay, a
    row each; other columns are ignored; an empty table gives no rows.
    """
    pieces = materialise(pieces_of(docs, make_encoder, window), "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    p = plan_of(counts, window)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialise(counts.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(before, F.lit(0)).alias("_start")), "starts")
    release(counts)
    ranked = pieces.join(starts, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("_start")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = p.place(length, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, SCHEMA), p


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))[0]
