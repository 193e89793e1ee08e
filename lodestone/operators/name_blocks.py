"""Names against names in blocks: each pair of blocks is one task that bounds all its pairs by arrays and names the few left.

Two bounds hold for edits and for difflib's ratio alike, since what either keeps is a common subsequence: the characters that two
names share, whatever their order, and the longest common subsequence, 64 places of it in one word. The first is a few additions
of bytes for a pair, the second is taken for the pairs that the first leaves, where a name has at most 64 characters.

Nearest names read the right side piece by piece, and what a name's n best have reached so far is what the next piece must reach, so
bounds leave fewer pairs the more names there are. Pairs that are left are compared by difflib's method, many at once.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a block of the left and of the right side has about so many names
LEFT_ROWS, RIGHT_ROWS = 3000, 50_000
#: the same for the nearest names, whose tasks read the right side in pieces: small ones first, so that there soon is something to reach
NEAREST_LEFT, NEAREST_RIGHT, PIECES = 6000, 1_500_000, (2000, 8000, 32_000, 100_000)
#: so many pairs that bounds leave are compared at once
BATCH = 30_000
#: entries of a table of masks, a row for a left name and a column for a character
MASKS = 4_000_000
#: characters have bins of their own as far as they go; the rest share the last one, which only loosens the bound
BINS = 64
#: so many places of a common subsequence fit a word
PLACES = 64


class _Names:
    """Lengths, characters by number (0 for none) and their counts, for one block."""

    def __init__(self, names: list[str], letters: np.ndarray) -> None:
        self.names = names
        self.length = np.array([len(s) for s in names], dtype=np.int64)
        flat = np.searchsorted(letters, _points(names)) + 1
        row = np.repeat(np.arange(len(names)), self.length)
        # the rows of this table are the bins
        counts = np.bincount(np.minimum(flat - 1, BINS - 1) * len(names) + row, minlength=BINS * len(names)).reshape(BINS, -1)
        self.counts = counts.astype(np.uint8 if self.length.max(initial=0) < 256 else np.int64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        near = place < PLACES
        self.codes = np.zeros((len(names), min(PLACES, int(self.length.max(initial=0)))), dtype=np.int32)
        self.codes[row[near], place[near]] = flat[near]


def _points(names: list[str]) -> np.ndarray:
    return np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32)


def _pairs(left: list[str], right: list[str], keep: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each left name the right ones that `keep` (of bounds on what is common, both lengths) leaves, with their bounds."""
    letters = np.unique(np.concatenate([_points(left), _points(right)]))
    x, y = _Names(left, letters), _Names(right, letters)
    masks = np.zeros(len(letters) + 1, dtype=np.uint64)
    for i, name in enumerate(left):
        m = len(name)
        common = np.zeros(len(right), dtype=y.counts.dtype if m < 256 else np.int64)
        for c in np.flatnonzero(x.counts[:, i]):
            common += np.minimum(y.counts[c], common.dtype.type(x.counts[c, i]))
        bound = common.astype(np.int64)
        some = np.flatnonzero(keep(bound, m, y.length))
        bound = bound[some]
        if 0 < m <= PLACES and len(some):
            short = np.flatnonzero(y.length[some] <= PLACES)
            codes = y.codes[some[short]]
            own = x.codes[i, :m]
            for k, c in enumerate(own):
                masks[c] |= np.uint64(1 << k)
            v = np.full(len(short), (1 << m) - 1, dtype=np.uint64)
            for j in range(codes.shape[1]):
                u = v & masks[codes[:, j]]
                v = (v + u) | (v - u)
            bound[short] = m - np.bitwise_count(v & np.uint64((1 << m) - 1)).astype(np.int64)
            masks[own] = 0
            left_over = keep(bound, m, y.length[some])
            some, bound = some[left_over], bound[left_over]
        yield i, some, bound


def _in_blocks(x: DataFrame, y: DataFrame, run: Callable, schema: str, left: int = LEFT_ROWS, right: int = RIGHT_ROWS, least: tuple[int, int] = (8, 4), spare: int = 1) -> DataFrame:
    """run of the tables of each pair of blocks; x has the column a, y the column b and more.

    least is how many blocks small sides have; spare times as many partitions as pairs leave fewer pairs to share one.
    """
    n, m = x.count(), y.count()
    rows = max(-(-n // left), min(least[0], -(-n // 100)), 1), max(-(-m // right), min(least[1], -(-m // 1000)), 1)
    part = lambda name, k: F.pmod(F.xxhash64(name), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in y.schema.fields]
    sent = x.withColumn("p", part("a", rows[0])).select("p", every(rows[1]).alias("q"), "a", *none).unionByName(
        y.withColumn("q", part("b", rows[1])).select("q", every(rows[0]).alias("p"), F.lit(None).cast("string").alias("a"), *y.columns)
    )
    # as many tasks as pairs, and not fewer for what adaptive execution takes for small
    return sent.repartition(spare * rows[0] * rows[1], "p", "q").groupBy("p", "q").applyInArrow(run, schema)


def pairs_within_edits(x: DataFrame, y: DataFrame, k: int) -> DataFrame:
    """a and b of all pairs of the distinct names a of x and b of y that can be at most k edits apart, and few others."""

    def run(table: pa.Table) -> pa.Table:
        left, right = table.column("a").drop_null().to_pylist(), table.column("b").drop_null().to_pylist()
        a, b = [], []
        for i, some, _ in _pairs(left, right, lambda common, m, n: np.maximum(m, n) - common <= k):
            a += [left[i]] * len(some)
            b += [right[j] for j in some]
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return _in_blocks(x.select("a"), y.select("b"), run, "a string, b string")


def _subsequences(x: _Names, i: np.ndarray, y: _Names, j: np.ndarray, letters: int) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of names of at most PLACES characters."""
    own, at = np.unique(i, return_inverse=True)
    places = PLACES if x.length[own].max(initial=0) > PLACES // 2 else PLACES // 2
    word = np.uint64 if places == PLACES else np.uint32
    masks = np.zeros((len(own), letters + 1), dtype=word)
    for k in range(min(places, x.codes.shape[1])):
        masks[np.arange(len(own)), x.codes[own, k]] |= word(1 << k)
    masks[:, 0] = 0
    full = np.array([(1 << m) - 1 for m in range(places + 1)], dtype=word)[x.length[i]]
    # a row for each place
    v, masks, codes = full.copy(), masks.ravel(), y.codes[j, : int(y.length[j].max(initial=0))].T + at * (letters + 1)
    for row in codes:
        u = v & masks.take(row)
        v = (v + u) | (v - u)
    return x.length[i] - np.bitwise_count(v & full).astype(np.int64)


def _matched(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many characters difflib's blocks match, for pairs of rows of codes and their lengths.

    Of each pair of stretches the longest common block is found, of equal ones the first in a, then in b; what lies before it and
    what lies after it are the next pairs of stretches.
    """
    total = np.zeros(len(a), dtype=np.int64)
    own, alo, ahi, blo, bhi = np.arange(len(a)), np.zeros(len(a), np.int64), m, np.zeros(len(a), np.int64), n
    while len(own):
        p, q = np.arange((ahi - alo).max(initial=0))[:, None], np.arange((bhi - blo).max(initial=0))[:, None]
        # a row for each place, a column for each pair of stretches; beyond their ends nothing is equal
        x = np.where(p < ahi - alo, a[own, np.minimum(alo + p, a.shape[1] - 1)], -1)
        y = np.where(q < bhi - blo, b[own, np.minimum(blo + q, b.shape[1] - 1)], -2)
        size, end_a, end_b = np.zeros(len(own), np.uint8), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        before, run = np.zeros((len(q) + 1, len(own)), np.uint8), np.zeros((len(q) + 1, len(own)), np.uint8)
        for k in range(len(p)):
            np.multiply(before[:-1] + np.uint8(1), y == x[k], out=run[1:])
            longest = run.max(axis=0)
            more = np.flatnonzero(longest > size)
            size[more], end_a[more], end_b[more] = longest[more], k + 1, np.argmax(run[:, more] == longest[more], axis=0)
            before, run = run, before
        size = size.astype(np.int64)
        total += np.bincount(own, weights=size, minlength=len(total)).astype(np.int64)
        i, j = alo + end_a - size, blo + end_b - size
        before, after = (size > 0) & (alo < i) & (blo < j), (size > 0) & (i + size < ahi) & (j + size < bhi)
        joint = lambda u, v, w=before, z=after: np.concatenate([u[w], v[z]])
        own, alo, ahi, blo, bhi = joint(own, own), joint(alo, i + size), joint(i, ahi), joint(blo, j + size), joint(j, bhi)
    return total


class _Nearest:
    """The n best right names of each left one, from pieces of the right side one after the other."""

    def __init__(self, left: list[str], letters: np.ndarray, least: float, n: int) -> None:
        self.x, self.letters, self.least, self.n = _Names(left, letters), letters, least, n
        self.best: list[list[tuple[float, str, str]]] = [[] for _ in left]
        #: the ratio that a further name has to reach
        self.reach = np.full(len(left), least)

    def read(self, right: list[str], first: list[str]) -> None:
        order = np.argsort([len(b) for b in right], kind="stable").tolist()
        right, first = [right[j] for j in order], [first[j] for j in order]
        x, y = self.x, _Names(right, self.letters)
        small = x.counts.dtype == y.counts.dtype == np.uint8
        lengths, starts = np.unique(y.length, return_index=True)
        sizes = np.diff([*starts, len(right)])
        at_most: dict[tuple[int, int], np.ndarray] = {}
        i_s, j_s, held, was = [], [], 0, None
        for i in np.lexsort((self.reach, x.length)).tolist():
            if was != (x.length[i], self.reach[i]):
                was = m, reach = x.length[i], self.reach[i]
                need = np.ceil(reach * (m + lengths) / 2 - 1e-9).astype(np.int64)
                some = np.flatnonzero(need <= np.minimum(m, lengths))
                low, high = (int(starts[some[0]]), int(starts[some[-1]] + sizes[some[-1]])) if len(some) else (0, 0)
                between = slice(some[0], some[-1] + 1) if len(some) else slice(0)
                # no pair of these lengths has more in common than a byte holds, where names are short
                need = np.repeat(need[between], sizes[between]).astype(np.uint8 if small else np.int64)
            if low == high:
                continue
            common = np.zeros(high - low, dtype=np.uint8 if small else np.int64)
            own = x.counts[:, i]
            for c in np.flatnonzero(own).tolist():
                k = int(own[c])
                if (c, k) not in at_most:
                    at_most[c, k] = np.minimum(y.counts[c], y.counts.dtype.type(min(k, 255)) if y.counts.dtype == np.uint8 else k)
                common += at_most[c, k][low:high]
            found = np.flatnonzero(common >= need)
            if len(found):
                i_s.append(np.full(len(found), i))
                j_s.append(found + low)
                held += len(found)
            if held >= BATCH or (len(i_s) + 1) * (len(self.letters) + 1) > MASKS:
                self._compare(y, right, first, np.concatenate(i_s), np.concatenate(j_s))
                i_s, j_s, held = [], [], 0
        if held:
            self._compare(y, right, first, np.concatenate(i_s), np.concatenate(j_s))

    def _compare(self, y: _Names, right: list[str], first: list[str], i: np.ndarray, j: np.ndarray) -> None:
        x = self.x
        both = x.length[i] + y.length[j]
        most = 2.0 * np.minimum(x.length[i], y.length[j]) / np.maximum(both, 1)
        most[both == 0] = 1.0
        short = np.flatnonzero((x.length[i] <= PLACES) & (y.length[j] <= PLACES) & (both > 0))
        if len(short):
            most[short] = 2.0 * _subsequences(x, i[short], y, j[short], len(self.letters)) / both[short]
        left_over = np.flatnonzero(most >= self.reach[i] - 1e-12)
        left_over = left_over[np.lexsort((-most[left_over], i[left_over]))]
        i, j, most = i[left_over], j[left_over], most[left_over]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        # those with the best bounds say what the others have to reach
        for some in (nth < self.n, nth >= self.n):
            at = np.flatnonzero(some & (most >= self.reach[i] - 1e-12))
            for part in np.array_split(at, len(at) * 10 // BATCH + 1):
                self._keep(y, right, first, i[part], j[part])

    def _keep(self, y: _Names, right: list[str], first: list[str], i: np.ndarray, j: np.ndarray) -> None:
        x, ratio = self.x, np.ones(len(i))
        short = (x.length[i] <= PLACES) & (y.length[j] <= PLACES) & (x.length[i] + y.length[j] > 0)
        m, n = x.length[i[short]], y.length[j[short]]
        ratio[short] = 2.0 * _matched(x.codes[i[short]], y.codes[j[short]], m, n) / (m + n)
        for k in np.flatnonzero(~short).tolist():
            ratio[k] = SequenceMatcher(None, x.names[i[k]], right[j[k]]).ratio()
        for k in np.flatnonzero(ratio >= self.reach[i]).tolist():
            r, own = float(ratio[k]), int(i[k])
            best = self.best[own]
            insort(best, (-r, first[j[k]], right[j[k]]))
            del best[self.n :]
            if len(best) == self.n:
                self.reach[own] = -best[-1][0]


def nearest_by_ratio(x: DataFrame, y: DataFrame, least: float, n: int) -> DataFrame:
    """a, b and difflib's ratio, at least `least`, of pairs of distinct names that hold the n best of each a; ties go to the smaller
    `first` of y, of which no two names have the same. Names that by their bounds cannot be among the best are not compared."""

    def run(table: pa.Table) -> pa.Table:
        left, known = table.column("a").drop_null().to_pylist(), table.select(["b", "first"]).filter(table.column("b").is_valid())
        letters = set().union(*left)
        for k in range(0, known.num_rows, PIECES[-1]):
            letters.update("".join(known.column("b").slice(k, PIECES[-1]).to_pylist()))
        found, at, piece = _Nearest(left, np.array(sorted(map(ord, letters)), dtype=np.uint32), least, n), 0, 0
        while at < known.num_rows and left:
            part = known.slice(at, PIECES[piece])
            found.read(part.column("b").to_pylist(), part.column("first").to_pylist())
            at, piece = at + part.num_rows, min(piece + 1, len(PIECES) - 1)
        rows = [(a, b, -r) for a, best in zip(left, found.best, strict=True) for r, _, b in best]
        a, b, ratio = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "ratio": pa.array(ratio, pa.float64())})

    return _in_blocks(x.select("a"), y.select("b", "first"), run, "a string, b string, ratio double", NEAREST_LEFT, NEAREST_RIGHT, (16, 1), 4)
