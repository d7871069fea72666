"""Quality rules: a linear-chain conditional random field labels lines content or boilerplate; the content share decides.

Emissions are a linear score of line features, transitions a 2 x 2 matrix; Viterbi decoding gives each line's label.
The field is fitted to labelled documents: their lines are content in documents of good quality, and boilerplate in
bad ones and wherever a line stands in several documents of the sample.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Labelled documents that the field is fitted to, at most; those whose id hashes lowest. Longer texts are not fitted to.
SAMPLE = 2000
SAMPLE_CHARS = 20000
#: Least share of words in lines labelled content.
CONTENT_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: A line in as many sampled documents is boilerplate for training.
TRAIN_RECURS = 3
#: Added to the content score when decoding: a lost good document costs more than a kept bad one.
CONTENT_BIAS = 1.0
#: Lines of fewer words are short; the place in the document counts for short lines only.
SHORT_LINE = 20
#: Lines of a training sequence; longer documents give several.
TRAIN_LINES = 64
#: Texts that accepted() holds as Python objects at once, whatever the Arrow batch has.
DECIDED = 256

_CLASSES = ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", SYMBOLS, "!", "|", ".,;:?"]
_MEMBER = np.zeros((len(_CLASSES), 256), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _MEMBER[_i, list(_c.encode())] = 1
N_FEATURES = 15


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of the whole text; null: zeros."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = 0
    if len(words) > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
        if len(ids) < 1 << 21:
            keys = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
        else:
            pairs = np.unique((w[:-2] << 32) | w[1:-1], return_inverse=True)[1]
            keys = (pairs << 32) | w[2:]
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        if len(counts) < len(keys):
            again = counts[inverse] > 1
            cover = np.zeros(len(words), bool)
            for k in range(3):
                cover[k : len(words) - 2 + k] |= again
            repeats = int(cover.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, words in each line, and where each text's lines end."""
    if not texts:
        return np.zeros((0, N_FEATURES)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    per = [t.split("\n") for t in texts]
    stops = np.cumsum([len(x) for x in per])
    lines = [x for p in per for x in p]
    n = len(lines)
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(raw == 10)[:-1] + 1))
    size = np.diff(np.append(starts, len(raw))) - 1
    kinds = np.stack([np.add.reduceat(m[raw], starts, dtype=np.int64) for m in _MEMBER])
    split = [x.encode("utf-8", "surrogatepass").split() for x in lines]  # of bytes, so that white space is that of base_counts
    words = np.fromiter(map(len, split), np.int64, n)
    distinct = np.fromiter((len(set(x)) for x in split), np.int64, n)
    dup = np.zeros(n)
    at = 0
    for p in per:
        seen: set[str] = set()
        for k, x in enumerate(p):
            if x in seen:
                dup[at + k] = 1
            else:
                seen.add(x)
        at += len(p)
    w, s = np.maximum(words, 1), np.maximum(size, 1)
    digit, upper, lower, symbol, bang, pipe, mark = kinds
    first = np.zeros(n)
    first[np.concatenate(([0], stops[:-1]))] = 1
    last = np.zeros(n)
    last[stops - 1] = 1
    few = words < SHORT_LINE
    x = np.stack(
        [np.ones(n), few.astype(float), few * np.minimum(words, SHORT_LINE) / SHORT_LINE, np.minimum(size / w, 30) / 10, symbol / w, symbol / s * 5, digit / s * 5, upper / np.maximum(upper + lower, 1),
         bang / w, pipe / w, mark / w, dup, 1 - distinct / w, few * first, few * last], axis=1,
    )
    return x, words, stops


class LineField:
    """Two labels, 0 boilerplate and 1 content. score: weight by feature of content over boilerplate; move[i, j]: from i to j."""

    def __init__(self, score: np.ndarray, move: np.ndarray):
        self.score, self.move = score, move

    def decode(self, e: list[float]) -> list[int]:
        """Viterbi: the best labels for emission scores of content (those of boilerplate are 0). Ties go to content."""
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = 0.0, 0.0
        back = []
        for k, x in enumerate(e):
            if k:
                from0, from1 = a + m00 > b + m10, a + m01 > b + m11
                a, b = (a + m00 if from0 else b + m10), (a + m01 if from1 else b + m11) + x
                back.append((from0, from1))
            else:
                b = x
        label = 0 if a > b else 1
        out = [label]
        for from0, from1 in reversed(back):
            label = 0 if (from1 if label else from0) else 1
            out.append(label)
        return out[::-1] if e else []

    def shares(self, texts: list[str | None]) -> list[float]:
        """Share of words in content lines of each text; no words: 0."""
        x, words, stops = line_features([t or "" for t in texts])
        e = (x @ self.score + CONTENT_BIAS).tolist()
        words_list, out, at = words.tolist(), [], 0
        for stop in stops.tolist():
            w = words_list[at:stop]
            total = sum(w)
            out.append(sum(n for n, y in zip(w, self.decode(e[at:stop]), strict=True) if y) / total if total else 0.0)
            at = stop
        return out


def _likelihood(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, y: np.ndarray, ridge: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean log-likelihood of the sequences, less the ridge, and its gradient at theta, by the scaled forward-backward recursion.

    Sequence k is the lines starts[k] to starts[k] + sizes[k] of x; sizes fall, so at each place the sequences that reach it come first.
    """
    n, places = len(sizes), range(int(sizes[0]))
    reach = [int(np.searchsorted(-sizes, -t, "left")) for t in places]  # sequences with more than t lines
    rows = [starts[:m] + t for t, m in zip(places, reach, strict=True)]
    moves = np.zeros((2, 2))
    for before, after in itertools.pairwise(rows):
        np.add.at(moves, (y[before[: len(after)]], y[after]), 1)
    target = np.concatenate((x.T @ y, moves.ravel())) / n

    def at(theta: np.ndarray) -> tuple[float, np.ndarray]:
        move = np.exp(np.clip(theta[N_FEATURES:], -30, 30)).reshape(2, 2)
        psi = np.exp(np.clip(x @ theta[:N_FEATURES], -30, 30))
        alpha, scale = [], []
        for t, r in enumerate(rows):
            a = alpha[t - 1][: len(r)] @ move if t else np.ones((len(r), 2))
            a[:, 1] *= psi[r]
            scale.append(a.sum(axis=1))
            alpha.append(a / scale[t][:, None])
        p1, pair = np.zeros(len(x)), np.zeros((2, 2))
        beta = np.ones((len(rows[-1]), 2))
        for t in range(len(rows) - 1, -1, -1):
            p1[rows[t]] = alpha[t][:, 1] * beta[:, 1]
            if t:
                beta[:, 1] *= psi[rows[t]]
                beta /= scale[t][:, None]
                pair += alpha[t - 1][: len(beta)].T @ beta
                beta = np.concatenate((beta @ move.T, np.ones((len(rows[t - 1]) - len(beta), 2))))
        value = target @ theta - sum(float(np.log(c).sum()) for c in scale) / n - ridge / 2 * float(theta @ theta)
        return value, target - np.concatenate((x.T @ p1, (pair * move).ravel())) / n - ridge * theta

    return at


def fit(texts: list[str], good: list[int], rounds: int = 200, ridge: float = 1e-3) -> LineField:
    """Maximum conditional likelihood by quasi-Newton steps, at most `rounds`. Without both kinds of labels: everything is content."""
    if not texts or len(set(good)) < 2:
        return LineField(np.eye(N_FEATURES)[0], np.zeros((2, 2)))
    x, _, stops = line_features(texts)
    df = Counter(line for t in texts for line in set(t.split("\n")))
    y, at = np.zeros(len(x), np.int64), 0
    seqs = []
    for t, g, stop in zip(texts, good, stops.tolist(), strict=True):
        y[at:stop] = [int(bool(g) and df[line] < TRAIN_RECURS) for line in t.split("\n")]
        seqs += [(s, min(TRAIN_LINES, stop - s)) for s in range(at, stop, TRAIN_LINES)]
        at = stop
    starts, sizes = np.array(sorted(seqs, key=lambda s: -s[1])).T
    f = _likelihood(x, starts, sizes, y, ridge)
    theta = np.zeros(N_FEATURES + 4)
    value, grad = f(theta)
    inverse = np.eye(len(theta))
    for _ in range(rounds):
        way = inverse @ grad
        if grad @ way <= 0:
            inverse, way = np.eye(len(theta)), grad
        step = 1.0
        while True:
            new = theta + step * way
            v, g = f(new)
            if v >= value + 1e-4 * step * float(grad @ way) or step < 1e-8:
                break
            step /= 2
        s, d = new - theta, grad - g
        if step < 1e-8 or v - value < 1e-9:
            break
        if s @ d > 1e-12:
            left = np.eye(len(theta)) - np.outer(s, d) / (s @ d)
            inverse = left @ inverse @ left.T + np.outer(s, s) / (s @ d)
        theta, value, grad = new, v, g
    return LineField(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineField:
    """The field fitted to `sample` labelled documents at most, those over SAMPLE_CHARS code points left out; their ids and texts alone reach the driver."""
    some = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = {r.doc_id: r.quality for r in some.collect()}
    if not ids:
        return fit([], [])
    named = docs.sparkSession.createDataFrame([(k,) for k in ids], "_cv_id long")
    rows = docs.join(F.broadcast(named), docs["doc_id"] == F.col("_cv_id")).where(F.length("text") <= SAMPLE_CHARS).groupBy("_cv_id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r[0])
    return fit([r.text for r in rows], [int(ids[r[0]] > 0) for r in rows])


def judged(docs: DataFrame, field: LineField, min_share: float = CONTENT_SHARE) -> DataFrame:
    """docs(doc_id, text) -> counts, base_failed, content_share, kept. A null text counts as empty; each row is judged by itself."""

    def rules(ids: list, texts: list) -> list:
        base = [base_counts(t) for t in texts]
        failed = [n < MIN_WORDS or 100 * r > MAX_REPEAT * n for n, _, _, _, r in base]
        shares = []
        for k in range(0, len(texts), 512):
            shares += field.shares(texts[k : k + 512])
        return [ids, *map(list, zip(*base, strict=True)), failed, shares, [not f and s >= min_share for f, s in zip(failed, shares, strict=True)]] if ids else [[]] * 9

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), rules, schema)


def accepted(docs: DataFrame, field: LineField, min_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of docs, all columns, that the rules keep: decided row by row in the scan, without a shuffle."""

    @F.arrow_udf("boolean")
    def keep(texts: pa.Array) -> pa.Array:
        kept = []
        for k in range(0, len(texts), DECIDED):
            part = texts.slice(k, DECIDED).to_pylist()
            base = [base_counts(t) for t in part]
            kept += [n >= MIN_WORDS and 100 * r <= MAX_REPEAT * n and s >= min_share for (n, _, _, _, r), s in zip(base, field.shares(part), strict=True)]
        return pa.array(kept, pa.bool_())

    return docs.where(keep(docs["text"]))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, train(docs, table(spark, sf_dir, "labels")))
