"""Pairs of a project by what their numbers and words share, found and scored in blocks with arrays.

Store rows in blocks meet supplier rows in parts.  In such a cell the pieces of either side are numbered once, and what a
store row shares with all supplier rows is marked in one line of a matrix; so a pair costs no row of its own until it is
known to be a result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Store rows of a block, supplier rows of a part, elements of the matrices that are filled at once, and marks set at once.
STORES_A_BLOCK, SUPPLIERS_A_PART, AT_ONCE, MARKS = 4000, 40_000, 2_000_000, 1_000_000
#: A number's characters, A-Z and 0-9, as 0 to 35.
_CODES = np.full(256, 255, np.uint8)
_CODES[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8)] = np.arange(36)


def in_cells(s: DataFrame, u: DataFrame, run: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, stores_a_block: int = STORES_A_BLOCK, suppliers_a_part: int = SUPPLIERS_A_PART, only: str = "true") -> DataFrame:
    """What ``run`` makes of each block of store rows and each part of the supplier rows of its project.

    ``s`` and ``u`` have the same columns, project_id and id among them.  ``run`` gets supplier rows in order of their id, and
    the number of ``parts`` with each row; ``only`` picks projects by their numbers of ``blocks`` and ``parts``."""
    cuts = lambda rows, size, name: rows.groupBy("project_id").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    both = cuts(s, stores_a_block, "blocks").join(cuts(u, suppliers_a_part, "parts"), "project_id").filter(only)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    more = ["parts", *(c for c in s.columns if c != "project_id")]
    left = s.join(both, "project_id").select("project_id", place("blocks").alias("block"), every("parts").alias("part"), F.lit(True).alias("is_store"), *more)
    right = u.join(both, "project_id").select("project_id", every("blocks").alias("block"), place("parts").alias("part"), F.lit(False).alias("is_store"), *more)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        a, b = rows.filter(rows["is_store"]), rows.filter(pc.invert(rows["is_store"]))
        if a.num_rows and b.num_rows:
            yield from run(a, b.take(pc.sort_indices(b["id"])))

    keys = ["project_id", "block", "part"]
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, as cells are costly and few bytes: they must not be put together
    return left.unionByName(right).repartition(parts, *keys).groupBy(*keys).applyInArrow(cell, schema)


def strings(c: pa.ChunkedArray) -> pa.Array:
    """One array of a column; large, as what is taken of it may pass 2 GB."""
    return pa.concat_arrays([x.cast(pa.large_string()) for x in c.chunks])


class Marks:
    """By numbered pieces: which rows of ``a`` have which piece, in order of the rows, and which rows of ``b`` hold it."""

    def __init__(self, row: np.ndarray, piece: np.ndarray, held_by: np.ndarray, held: np.ndarray, pieces: int):
        self.row, self.piece = row, piece
        self.holders = held_by[np.argsort(held, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(held, minlength=pieces))])

    def set(self, at: np.ndarray, low: int, value: int) -> None:
        """Sets ``value`` in ``at``, whose lines are the rows of ``a`` from ``low`` on, for each pair with a common piece."""
        i, j = np.searchsorted(self.row, (low, low + len(at)))
        row, piece, line = self.row[i:j] - low, self.piece[i:j], at.reshape(-1)
        first = self.start[piece]
        n = self.start[piece + 1] - first
        end = np.cumsum(n)
        cuts = [0, *np.searchsorted(end, np.arange(MARKS, end[-1], MARKS)), len(n)] if len(n) and end[-1] > MARKS else [0, len(n)]
        for p, q in zip(cuts, cuts[1:]):
            if p < q:
                m = n[p:q]
                shift = np.repeat(first[p:q] - (np.cumsum(m) - m), m)
                line[np.repeat(row[p:q] * at.shape[1], m) + self.holders[np.arange(len(shift)) + shift]] = value


def equal(a: pa.Array, b: pa.Array) -> Marks:
    """Of two columns of texts, of which empty and missing ones equal none."""
    ids = pa.concat_arrays([a, b]).dictionary_encode()
    told = pc.and_(pc.is_valid(ids), pc.not_equal(pa.concat_arrays([a, b]), "")).fill_null(False).to_numpy(zero_copy_only=False)
    id_of = ids.indices.fill_null(0).to_numpy().astype(np.int64)
    x, y = np.flatnonzero(told[: len(a)]), np.flatnonzero(told[len(a) :])
    return Marks(x, id_of[x], y, id_of[y + len(a)], len(ids.dictionary) + 1)


class Runs:
    """The runs that two columns of numbers (of A-Z and 0-9) share, by length from 3 on (until ``most``), and the numbers
    of fewer characters that are equal or lie in one another."""

    def __init__(self, a: pa.Array, b: pa.Array, most: int | None = None):
        self.levels: list[tuple[int, Marks]] = []
        self.equal_short: list[tuple[int, Marks]] = []
        self.short: list[tuple[int, Marks]] = []
        sides = [self._read(x) for x in (a, b)]
        self.sizes = [size for *_, size in sides]
        self.dtype = np.uint8 if min(size.max(initial=0) for size in self.sizes) < 256 else np.uint32
        (row, at, run, code, end, size), (row_b, at_b, run_b, code_b, end_b, size_b) = [(r, np.arange(len(c)), c.astype(np.int64), c, np.cumsum(n), n) for r, c, n in sides]
        runs, k = 36, 1
        while most is None or k <= most:
            seen, seen_b = np.zeros(runs, bool), np.zeros(runs, bool)
            seen[run], seen_b[run_b] = True, True
            seen &= seen_b
            keep, keep_b = seen[run], seen[run_b]
            if not keep.any():
                break
            new = np.cumsum(seen, dtype=np.int32)
            row, at, run, row_b, at_b, run_b, runs = row[keep], at[keep], new[run[keep]].astype(np.int64) - 1, row_b[keep_b], at_b[keep_b], new[run_b[keep_b]].astype(np.int64) - 1, int(new[-1])
            if k < 3:
                w, v = size[row] == k, size_b[row_b] == k
                for some, x, y in ((self.equal_short, w, v), (self.short, w, v | True), (self.short, w | True, v)):
                    if x.any() and y.any():
                        some.append((k, Marks(row[x], run[x], row_b[y], run_b[y], runs)))
            else:
                self.levels.append((k, Marks(row, run, row_b, run_b, runs)))
            keep, keep_b = at + k < end[row], at_b + k < end_b[row_b]
            row, at, run = row[keep], at[keep], run[keep]
            row_b, at_b, run_b = row_b[keep_b], at_b[keep_b], run_b[keep_b]
            run, run_b, runs, k = run * 36 + code[at + k], run_b * 36 + code_b[at_b + k], runs * 36, k + 1

    @staticmethod
    def _read(c: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = pa.concat_arrays([c.fill_null("")])
        ends = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        size = np.diff(ends)
        data = c.buffers()[2]
        code = _CODES[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
        return np.repeat(np.arange(len(c)), size), code, size

    def longest(self, low: int, n: int, short: list[tuple[int, Marks]]) -> np.ndarray:
        """The length of the longest common run of the rows of ``a`` from ``low`` on with each row of ``b``, 0 for none."""
        at = np.zeros((n, len(self.sizes[1])), self.dtype)
        for k, marks in [*short, *self.levels]:
            marks.set(at, low, k)
        return at

    def ratio(self, found: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths found over the longer length of the rows ``i`` and ``j``."""
        return found / np.maximum(np.maximum(self.sizes[0][i], self.sizes[1][j]), 1)


def lines(a: int, b: int) -> Iterator[tuple[int, int]]:
    """Beginnings and numbers of the rows of ``a`` that are taken at once."""
    step = max(1, AT_ONCE // b)
    return ((low, min(step, a - low)) for low in range(0, a, step))


def common_run_pairs(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
    """(store_id, supplier_id, score) of the pairs of a cell that share a join ``key`` or three characters in a row of the
    store's ``number`` and the supplier's or its maker's; the score is that of common_run_similarity of the store's
    ``stored`` number and the maker's ``stored_mfr``."""
    x, y = ({c: strings(t[c]) for c in t.column_names if c in ("id", "key", "number", "mfr", "stored", "stored_mfr")} for t in (a, b))
    runs = Runs(x["stored"], y["stored_mfr"])
    same = x["stored"].equals(x["number"]) and y["stored_mfr"].equals(y["mfr"])  # then a run found there is a key found
    keys = [equal(x["key"], y["key"])]
    for c in ("number",) if same else ("number", "mfr"):
        keys += [m for k, m in Runs(x["number"], y[c], 3).levels if k == 3]
    for low, n in lines(len(a), len(b)):
        found = runs.longest(low, n, runs.short)
        met = found > 2 if same else np.zeros(found.shape, bool)
        for marks in keys:
            marks.set(met, low, True)
        i, j = np.nonzero(met)
        score = runs.ratio(found[i, j], i + low, j)
        for p in range(0, len(i), MARKS):
            q = slice(p, p + MARKS)
            ids = [pc.take(ids, pa.array(at)).cast(pa.string()) for ids, at in ((x["id"], i[q] + low), (y["id"], j[q]))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(score[q])], names=["store_id", "supplier_id", "score"])


def words_of(t: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Rows and words of the lists ``words``."""
    c = pa.concat_arrays(t["words"].chunks)
    return pc.list_parent_indices(c).to_numpy(), pc.list_flatten(c).cast(pa.large_string())


class Words:
    """Which words the lists of two sides share, counted with the repeats of either side."""

    def __init__(self, a: pa.Table, b: pa.Table):
        (row, x), (row_b, y) = words_of(a), words_of(b)
        ids = pa.concat_arrays([x, y]).dictionary_encode()
        n, id_of = len(ids.dictionary) + 1, ids.indices.to_numpy().astype(np.int64)
        pairs, self.times = np.unique(row.astype(np.int64) * n + id_of[: len(x)], return_counts=True)
        held, times_b = np.unique(row_b.astype(np.int64) * n + id_of[len(x) :], return_counts=True)
        self.marks = Marks(pairs // n, pairs % n, held // n, held % n, n)
        again = times_b > 1
        self.again = Marks(pairs[:0], pairs[:0], held[again] // n, held[again] % n, n)
        self.again_times = (times_b[again] - 1)[np.argsort(held[again] % n, kind="stable")]
        self.repeats = self.times.max(initial=1) > 1, bool(again.any())
        self.width = b.num_rows
        longest = max(np.bincount(r).max(initial=0) for r in (row, row_b))
        self.dtype = np.uint8 if longest < 256 else np.uint32
        self.dense: dict[int, np.ndarray] = {}

    def counts(self, low: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For the rows of ``a`` from ``low`` on and each row of ``b``: words of the first that the second has, words of the
        second that the first has."""
        of_a = np.zeros((n, self.width), self.dtype)
        more_a = np.zeros_like(of_a) if self.repeats[0] else None
        more_b = np.zeros_like(of_a) if self.repeats[1] else None
        m = self.marks
        i, j = np.searchsorted(m.row, (low, low + n))
        for r, w, times in zip((m.row[i:j] - low).tolist(), m.piece[i:j].tolist(), self.times[i:j].tolist()):
            p, q = m.start[w], m.start[w + 1]
            if (q - p) * 32 > self.width:  # so there are at most 32 such words for each word of a text
                if w not in self.dense:
                    self.dense[w] = np.zeros(self.width, self.dtype)
                    self.dense[w][m.holders[p:q]] = 1
                of_a[r] += self.dense[w]
            elif p < q:
                of_a[r, m.holders[p:q]] += 1
            if times > 1:
                more_a[r, m.holders[p:q]] += times - 1
            if more_b is not None:
                p, q = self.again.start[w], self.again.start[w + 1]
                if p < q:
                    more_b[r, self.again.holders[p:q]] += self.again_times[p:q].astype(self.dtype)
        return of_a if more_a is None else of_a + more_a, of_a if more_b is None else of_a + more_b


def billionths(x: np.ndarray) -> np.ndarray:
    """Scores rounded to nine places, halves up, times 1e9."""
    scaled = x * 1e9
    whole = np.floor(scaled + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        whole[i] = int(Decimal(repr(float(x[i]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return whole


def ranked_pairs(most: int, fill_to: int) -> Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]:
    """(store_id, supplier_id, score, rank, near, near_here) of a cell: the best ``most`` pairs of each store row that are
    near, and the best of these and the others where fewer than ``fill_to`` are near.  Other parts may hold more near pairs,
    so where there are others both are given; ``near_here``, on the first row, counts those of this part."""

    def run(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y = ({c: strings(t[c]) for c in ("id", "number", "mfr", "line")} for t in (a, b))
        number, mfr, line, words = Runs(x["number"], y["number"]), Runs(x["mfr"], y["mfr"]), equal(x["line"], y["line"]), Words(a, b)
        whole, width = a["parts"][0].as_py() == 1, b.num_rows
        for low, n in lines(a.num_rows, width):
            longest = [r.longest(low, n, r.equal_short) for r in (number, mfr)]
            same = np.zeros((n, width), bool)
            line.set(same, low, True)
            met = (longest[0] > 0) | (longest[1] > 0) | same
            of_a, of_b = words.counts(low, n)
            i, j = np.nonzero(met)
            found = [m[i, j] for m in longest]
            for k, r in enumerate((number, mfr)):
                if r.short:  # of one or two characters and within the other: this tells only of pairs that meet anyway
                    found[k] = np.maximum(found[k], r.longest(low, n, r.short)[i, j])
            nn, ff, alike = number.ratio(found[0], i + low, j), mfr.ratio(found[1], i + low, j), same[i, j]
            near = alike | (ff >= 0.5) | (nn >= 0.45)
            here = np.bincount(i[near], minlength=n)
            few = here < fill_to
            keep = near | ((of_a[i, j] >= 2) & few[i])
            i, j, near, alike, shared = i[keep], j[keep], near[keep], alike[keep], of_b[i[keep], j[keep]]
            bonus = np.where(shared >= 2, np.minimum(0.2, shared * 0.05), 0.0)
            score = billionths(nn[keep] + 0.4 * ff[keep] + np.where(alike, 0.25, 0.0) + bonus)
            order = -score * width + j  # by score, then by id
            cuts = np.searchsorted(i, np.arange(n + 1))
            out: list[list[np.ndarray]] = []
            for r in range(n):
                p, q = cuts[r], cuts[r + 1]
                mine, close = order[p:q], near[p:q]
                if few[r] and np.count_nonzero(score[p:q] > _BONUS[4]) < most:
                    mine = np.concatenate([mine, *_said(of_a[r], of_b[r], met[r], most, width)])
                    close = np.concatenate([close, np.zeros(len(mine) - len(close), bool)])
                best = _least(mine, most)
                if not whole and not close[best].all():
                    nearest = np.flatnonzero(close)
                    best = np.union1d(best, nearest[_least(mine[nearest], most)])
                    best = best[np.argsort(mine[best])]
                if len(best):
                    told = np.zeros(len(best), np.int64)
                    told[0] = here[r]
                    out.append([np.full(len(best), r + low), mine[best], np.arange(1, len(best) + 1, dtype=np.int32), close[best], told])
            if out:
                rows, key, rank, close, told = map(np.concatenate, zip(*out))
                at = key % width
                ids = [pc.take(ids, pa.array(k)).cast(pa.string()) for ids, k in ((x["id"], rows), (y["id"], at))]
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, ((at - key) // width / 1e9, rank, close, told))], names=["store_id", "supplier_id", "score", "rank", "near", "near_here"])

    return run


#: Billionths that shared words alone give, by their number.
_BONUS = [0, 0, 100_000_000, 150_000_000, 200_000_000]


def _said(of_a: np.ndarray, of_b: np.ndarray, met: np.ndarray, most: int, width: int) -> Iterator[np.ndarray]:
    """The first ``most`` pairs of a store row that share nothing but two words or more, best first."""
    said = (of_a >= 2) & ~met
    for n in (4, 3, 2, 0):
        if most > 0:
            at = np.flatnonzero(said & ((of_b >= 4) if n == 4 else (of_b == n) if n else (of_b < 2)))[:most]
            most -= len(at)
            yield at - _BONUS[n] * width


def _least(order: np.ndarray, most: int) -> np.ndarray:
    """Places of the least ``most`` values, in order."""
    best = np.argpartition(order, most - 1)[:most] if len(order) > most else np.arange(len(order))
    return best[np.argsort(order[best])]
