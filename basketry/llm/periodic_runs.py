"""Periodic runs of words, found by longest common extensions on a difference cover.

A run is a stretch of words that repeats with a smallest period q, at least
``times`` periods and ``least`` words long, that no neighbour extends. Runs are
enumerated on the harmonic grid: for each q, the matches ``w[x] == w[x + q]`` of
such a run form a stretch of (times - 1) * q words, which holds times - 1
consecutive multiples of q. Only multiples where all of them match (and the
words half-way between) ask how far the match extends to both sides, so n words
cost n log n comparisons of single words and few extension queries.

``Extensions`` answers those queries. Suffixes are sorted only at positions
whose rest modulo ``V`` is in a difference cover: any two positions reach two
sampled ones after the same shift of less than V words, which are compared one
by one; from there the answer is a range minimum over the sorted samples' common
prefixes, read off a sparse table.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import WORD, slices, utf8

V = 31
COVER = (0, 1, 3, 8, 12, 18)  # every difference modulo 31 occurs once
# Least shift that brings two rests into the cover.
SHIFT = np.array([[next(k for k in range(V) if (a + k) % V in COVER and (b + k) % V in COVER)
                   for b in range(V)] for a in range(V)])
CANDIDATES = 1 << 20  # grid points extended at once
RUNS = "array<struct<start:long,length:long,period:long>>"


class Extensions:
    """Common extensions to the right in ``words``, whose last word is unique (so
    that no two suffixes are equal)."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.blocks = -(-n // V) + 1  # samples of a rest; the last ones lie past the end
        self.w = np.concatenate([words, np.full(V * (self.blocks + 2) - n, -1, words.dtype)])
        self.row = np.full(V, -1)
        self.row[list(COVER)] = np.arange(len(COVER))
        at = (np.array(COVER)[:, None] + V * np.arange(self.blocks)).ravel()
        sampled = np.flatnonzero(at < n)
        rank = np.full(len(at) + 1, -1)  # last: beyond any sample
        rank[sampled] = 0
        open_, snapshots, lcp = sampled, [], np.zeros(len(sampled), np.int64)
        for k in range(V):
            open_ = self._refine(rank, open_, self.w[at[open_] + k], lcp, k)
        step = 1
        while len(open_):
            snapshots.append(rank.copy())
            open_ = self._refine(rank, open_, rank[self._ahead(open_, step)], lcp, -1)
            step *= 2
        self.rank = rank
        order = np.empty(len(sampled), np.int64)
        order[rank[sampled]] = sampled
        self._long_prefixes(order, at, snapshots, lcp)
        # lcp[r]: common prefix of the samples of rank r - 1 and r
        self.table = [lcp]
        while 2 << len(self.table) - 1 <= len(lcp):
            t, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(t[:-half], t[half:]))

    def _ahead(self, sample: np.ndarray, blocks) -> np.ndarray:
        """The sample that many blocks on, of the same rest."""
        inside = sample % self.blocks + blocks < self.blocks
        return np.where(inside, sample + blocks, -1)

    @staticmethod
    def _refine(rank, open_, key, lcp, depth) -> np.ndarray:
        """Order samples of equal rank by ``key``; a rank is the place of the first
        sample that shares it. Notes ``depth`` where a new rank begins (words
        compared so far, -1: not known). Returns the samples still in ties."""
        if not len(open_):
            return open_
        o = np.lexsort((key, rank[open_]))
        open_, key, old = open_[o], key[o], rank[open_[o]]
        at = np.arange(len(open_))
        head = np.concatenate([[True], old[1:] != old[:-1]])
        new = head | np.concatenate([[True], key[1:] != key[:-1]])
        place = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        rank[open_] = place
        lcp[place[new & ~head]] = depth
        return open_[~(new & np.concatenate([new[1:], [True]]))]

    def _long_prefixes(self, order, at, snapshots, lcp) -> None:
        """Prefixes longer than V words, by the ranks that each doubling left."""
        todo = np.flatnonzero(lcp < 0)
        a, b, got = order[todo - 1], order[todo], np.zeros(len(todo), np.int64)
        for k in range(len(snapshots) - 1, -1, -1):
            same = (snapshots[k][a] == snapshots[k][b]) & (a >= 0) & (b >= 0)
            got += np.where(same, V << k, 0)
            a, b = (np.where(same, self._ahead(x, 1 << k), x) for x in (a, b))
        lcp[todo] = got + self._words(at[a], at[b], np.full(len(todo), V))

    def _words(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, up to ``most``, compared one by one."""
        got, live = np.zeros(len(i), np.int64), np.arange(len(i))
        for k in range(V):
            live = live[(k < most[live])]
            live = live[self.w[i[live] + k] == self.w[j[live] + k]]
            if not len(live):
                break
            got[live] = k + 1
        return got

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j (i != j)."""
        shift = SHIFT[i % V, j % V]
        got = self._words(i, j, shift)
        on = np.flatnonzero(got == shift)
        r, s = (self.rank[self.row[x % V] * self.blocks + x // V] for x in (i[on] + shift[on], j[on] + shift[on]))
        lo, hi = np.minimum(r, s) + 1, np.maximum(r, s)
        level = np.frexp(hi - lo + 1)[1] - 1
        least = np.empty(len(on), np.int64)
        for k in np.unique(level):
            x = np.flatnonzero(level == k)
            least[x] = np.minimum(self.table[k][lo[x]], self.table[k][hi[x] - (1 << int(k)) + 1])
        got[on] += least
        return got


def grid(w: np.ndarray, longest: int, times: int):
    """Candidates (x, q): multiples x of q from which on times - 1 multiples and
    the words half-way between match the word q further on."""
    for q in range(1, longest // times + 1):
        a = w[::q]
        m = a[1:] == a[:-1]
        k = np.flatnonzero(m[:len(m) - times + 2])
        for t in range(1, times - 1):
            k = k[m[k + t]]
        x = k * q
        if len(x) and q > 1:
            x = x[w[x + q // 2] == w[x + q // 2 + q]] if times > 2 else x
        if len(x):
            yield x, q


def runs_of(docs: list[np.ndarray], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each of some documents of word numbers, by
    start and period."""
    out: list[list] = [[] for _ in docs]
    if not docs:
        return out
    top = max((int(d.max()) + 1 for d in docs if len(d)), default=0)
    # A separator of its own before each document and at the end: nothing matches across it.
    parts = [x for k, d in enumerate(docs) for x in (np.array([top + k]), d)] + [np.array([top + len(docs)])]
    w = np.concatenate(parts).astype(np.int64)
    first = np.cumsum([0] + [len(d) + 1 for d in docs]) + 1
    found: dict[tuple[int, int], int] = {}
    both = None
    held, size = [], 0

    def extend():
        nonlocal both
        if both is None:
            both = Extensions(w), Extensions(w[::-1].copy())
        x, q = (np.concatenate(c) for c in zip(*held))
        end = x + q + both[0].of(x, x + q)
        back = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(x > 0)
        back[inner] = both[1].of(len(w) - x[inner], len(w) - x[inner] - q[inner])
        start = x - back
        keep = end - start >= np.maximum(least, times * q)
        for s, e, p in np.unique(np.column_stack([start[keep], end[keep], q[keep]]), axis=0).tolist():
            found[s, e] = min(p, found.get((s, e), p))  # longer periods of a stretch are multiples

    for x, q in grid(w, max(len(d) for d in docs), times):
        held.append((x, np.full(len(x), q)))
        size += len(x)
        if size >= CANDIDATES:
            extend()
            held, size = [], 0
    if held:
        extend()
    for (s, e), p in found.items():
        k = int(np.searchsorted(first, s, side="right")) - 1
        out[k].append((s - int(first[k]), e - s, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that any run repeats (all after its first period)."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def _with_candidates(docs: list[np.ndarray], times: int) -> np.ndarray:
    """Numbers of the documents with any grid candidate; the others have no run."""
    first = np.cumsum([0] + [len(d) + 1 for d in docs])
    w = np.concatenate([x for k, d in enumerate(docs) for x in (np.array([-1 - k]), d)])
    hit = np.zeros(len(docs), bool)
    for x, _ in grid(w, max(len(d) for d in docs), times):
        hit[np.searchsorted(first, x, side="right") - 1] = True
    return np.flatnonzero(hit)


def _runs(least: int, times: int):
    def run(batches):
        for part in slices(batches):
            data, offs = utf8(part.column(0))
            raw, o = data.tobytes(), offs.tolist()
            words = [raw[a:z].split() for a, z in zip(o, o[1:])]  # ASCII white space
            number = dict(zip(dict.fromkeys(x for d in words for x in d), count()))
            docs = [np.fromiter(map(number.__getitem__, d), np.int64, len(d)) for d in words]
            runs: list[list] = [[] for _ in docs]
            maybe = _with_candidates(docs, times)
            for k, r in zip(maybe.tolist(), runs_of([docs[k] for k in maybe], least, times)):
                runs[k] = r
            found = pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in runs], pa.list_(
                pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
            text = pa.array([collapsed(d, r) for d, r in zip(words, runs)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[1:], found, text], [*part.schema.names[1:], "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """``doc_id, runs, collapsed`` for every row of ``docs``: all its runs by start
    and period (word numbers from 0), and its text without the words that a run
    repeats, joined by one space.

    Words are what stands between ASCII white space. Null and empty texts have no
    runs and an empty text; null ids are carried; repeated rows give repeated
    results; further columns of ``docs`` are ignored. Texts are read whole.
    """
    if times < 2:
        raise ValueError("a run repeats at least twice")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_runs(least, times), f"doc_id {kind}, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where the tail of every tenth document by crc32 of its id
    repeats: from word a on, word i becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    g = F.floor(F.col("h") / 10).cast("long")
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn(
        "p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("long"))
    index = F.transform(F.sequence(F.lit(0).cast("long"), F.size("words") - F.lit(1).cast("long")),
                        lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    text = F.array_join(F.transform(index, lambda i: F.get("words", i.cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest exponent (ties: smallest start, then
    period) and digests of the runs and of the collapsed text."""
    better = lambda b, r: (r["length"] * b["period"] > b["length"] * r["period"])
    best = F.reduce(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
                    lambda b, r: F.when(better(b, r), r).otherwise(b))  # runs lie by start, then period
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                   F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
