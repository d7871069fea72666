"""Ratcliff-Obershelp ratios of many pairs of names at once: the longest common blocks of all pairs are found together, on numpy arrays."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Code points of the longest name that arrays hold; longer ones are compared one by one (from 200 on SequenceMatcher leaves out popular characters).
LONGEST = 199
#: Segments that are searched together.
TOGETHER = 8192


class Names:
    """Names as a padded matrix of character numbers of an alphabet, and their counts of each character."""

    def __init__(self, names: list[str], alphabet: np.ndarray):
        points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in names]
        self.names, self.size = names, np.array([len(p) for p in points], np.int64)
        self.width = max(1, int(min(self.size.max(initial=0), LONGEST)))
        kind = np.uint8 if len(alphabet) < 250 else np.uint32
        self.chars = np.zeros((len(names), self.width), kind)
        self.counts = np.zeros((len(alphabet), len(names)), np.uint8)
        for k, p in enumerate(points):
            if 0 < len(p) <= LONGEST:
                own = np.searchsorted(alphabet, p)
                self.chars[k, : len(p)] = own + 2
                self.counts[:, k] = np.bincount(own, minlength=len(alphabet))


def pair_of(left: list[str], right: list[str]) -> tuple[Names, Names]:
    """Both lists over one alphabet."""
    alphabet = np.unique(np.frombuffer("".join([*left, *right]).encode("utf-32-le", "surrogatepass"), np.uint32))
    return Names(left, alphabet), Names(right, alphabet)


def likely(a: Names, b: Names, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of which the common characters allow a ratio over `least`, or of which a name is long."""
    both = a.size[:, None] + b.size[None, :]
    common = np.zeros(both.shape, np.uint8)
    for x, y in zip(a.counts, b.counts, strict=True):
        if x.any() and y.any():
            common += np.minimum(x[:, None], y[None, :])
    long = (a.size > LONGEST)[:, None] | (b.size > LONGEST)[None, :]
    return np.nonzero((2 * common.astype(np.int64) > (least - 1e-6) * both) | long)


def fits(a: Names, b: Names, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """What likely() tells, of the pairs (i of a, j of b) alone."""
    both = a.size[i] + b.size[j]
    common = np.zeros(len(i), np.int64)
    for x, y in zip(a.counts, b.counts, strict=True):
        common += np.minimum(x[i], y[j])
    return (2 * common > (least - 1e-6) * both) | (a.size[i] > LONGEST) | (b.size[j] > LONGEST)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, end in a, end in b) of the longest common block of each column of a and b; the first in a on ties, then the first in b."""
    n = a.shape[1]
    m = len(b)
    run = np.zeros((m + 1, n), np.uint16)  # 256 * length of the block that ends here; row 0 is before b
    place = (255 - np.arange(m, dtype=np.uint16))[:, None]
    size, at_a, at_b = np.zeros(n, np.uint16), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, x in enumerate(a):
        run[1:] = (run[:-1] + 256) * (b == x)
        best = (run[1:] | place).max(axis=0)
        more = np.flatnonzero(best >> 8 > size)
        if len(more):
            size[more], at_a[more], at_b[more] = best[more] >> 8, i + 1, 256 - (best[more] & 255)
    return size.astype(np.int64), at_a, at_b


def ratios(a: Names, b: Names, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """The ratio of each pair (i of a, j of b), as SequenceMatcher(None, l, r).ratio() has it; those that turn out not to be over `least` may have less."""
    la, lb = a.size[i], b.size[j]
    total = la + lb
    matched = np.zeros(len(i), np.int64)
    long = (la > LONGEST) | (lb > LONGEST)
    need = np.floor((least - 1e-6) * total / 2)  # characters that must match at least, and one more
    hope = np.minimum(la, lb)  # characters that can match at most: found, and the shorter sides of what is open
    pair = np.flatnonzero(~long & (hope > 0))
    zero = np.zeros(len(pair), np.int64)
    todo = np.stack([pair, zero, la[pair], zero, lb[pair]])
    while todo.shape[1]:
        todo = todo[:, hope[todo[0]] > need[todo[0]]]
        todo = todo[:, np.lexsort((todo[4] - todo[3], todo[2] - todo[1]))]
        found = []
        for at in range(0, todo.shape[1], TOGETHER):
            p, a0, a1, b0, b1 = part = todo[:, at : at + TOGETHER]
            x, y = np.arange((a1 - a0).max())[:, None], np.arange((b1 - b0).max())[:, None]
            left = a.chars.ravel().take(i[p] * a.width + a0 + x, mode="clip") * (x < a1 - a0)
            right = b.chars.ravel().take(j[p] * b.width + b0 + y, mode="clip")
            right[y >= b1 - b0] = 1
            found.append((part, *_longest(left, right)))
        if not found:
            break
        p, a0, a1, b0, b1 = np.concatenate([f[0] for f in found], axis=1)
        size, end_a, end_b = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
        end_a, end_b = end_a + a0, end_b + b0
        sides = np.concatenate([np.stack([p, a0, end_a - size, b0, end_b - size]), np.stack([p, end_a, a1, end_b, b1])], axis=1)
        sides = sides[:, np.tile(size > 0, 2)]
        np.add.at(matched, p, size)
        np.add.at(hope, p, size - np.minimum(a1 - a0, b1 - b0))
        most = np.minimum(sides[2] - sides[1], sides[4] - sides[3])
        np.add.at(hope, sides[0], most)
        todo = sides[:, most > 0]
    out = np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)
    for k in np.flatnonzero(long).tolist():
        out[k] = SequenceMatcher(None, a.names[i[k]], b.names[j[k]]).ratio()
    return out
