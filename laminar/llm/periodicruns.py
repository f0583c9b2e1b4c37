"""Runs of repeated word sequences by branching tandem repeats in an enhanced suffix array.

A run is a stretch of words with smallest period q (words q apart are identical), at least
`least` words and `exponent` periods long, that no neighbouring word extends. Rows are
independent, so nothing is shuffled; within a task, the words of a slice of texts are handled together:

* A run recurs to itself q words apart, so each window of `window_words` words in it occurs
  twice in the text. Only stretches that such windows cover can hold runs (a hash finds the windows;
  equal hashes of unequal windows make a stretch longer and no more). A stretch is a string of its own.
* Suffixes of all stretches are sorted by prefix doubling, which sorts again only what is still tied; the
  ranks of every doubling are kept. They give the LCP array, and compare any two equally long strings.
* For each split of an LCP interval of depth d, the suffixes i of the smaller side look up
  whether the inverse array has i + d or i - d on the other side: these, and only these, are the branching squares
  of period d. The sides come from the nearest smaller LCP values on either side; no tree is built. Smaller sides
  sum up to n log n.
* A branching square is the last one of its run: it is rotated to the left by powers of two as far as
  words agree, which gives the run's start. Multiples of a period end in the same stretch of words; the smallest stays.

Contract: null and empty texts have no words and no run. Whole texts are read; a text is held by one task,
with about 4 bytes a word and doubling of the stretches that recur in it. Repeated rows get equal results. A kept column named like an
output gives way to it, other extra columns are ignored; an empty table gives an empty table. `least` has to be
positive and `exponent` at least 2, else a ValueError is raised.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from itertools import chain, count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_in_arrow, field

LEAST, EXPONENT = 24, 3
#: Suffixes that are looked up at a time.
LOOK_UPS = 1 << 18
RUN = T.StructType([field("start", T.LongType()), field("length", T.LongType()), field("period", T.LongType())])


def window_words(least: int, exponent: float) -> int:
    """Words of a window that has to recur: a run has at least max(least, exponent * q) words, and of those many each
    window of so many words has its like q words before or behind it within the run."""
    return max(1, min(int(np.ceil(max(least, exponent * q))) - 2 * q + 1 for q in range(1, least + 2)))


def recurring_stretches(ids: np.ndarray, owner: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches, within one owner, that recurring windows cover, if they have `least` words."""
    none = np.empty(0, np.int64)
    if len(ids) < window:
        return none, none
    words = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    words ^= words >> np.uint64(29)
    n = len(ids) - window + 1
    hashes = owner[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(window):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[window - 1 :])
    at = at[np.argsort(hashes[at])]
    twin = np.concatenate([[False], hashes[at[1:]] == hashes[at[:-1]]]) if len(at) else np.empty(0, bool)
    again = at[twin | np.concatenate([twin[1:], [False]])] if len(at) else none
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    covered = np.cumsum(cover[:-1]) > 0
    same = np.concatenate([[False], owner[1:] == owner[:-1]])
    goes_on = covered & same & np.concatenate([[False], covered[:-1]])
    starts = np.flatnonzero(covered & ~goes_on)
    ends = np.flatnonzero(covered & ~np.concatenate([goes_on[1:], [False]])) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def doubled_ranks(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of x, whose last symbol occurs once, and by k the ranks of its substrings of 2^k symbols (equal ranks: equal
    substrings). In the last ranks, those of the suffixes, no two are equal."""
    sa = np.argsort(x, kind="stable")
    group = lambda places, new: places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    kind = np.int32 if len(x) < 1 << 31 else np.int64
    rank = np.empty(len(x), np.int64)
    tied = np.arange(len(x))
    new = np.concatenate([[True], x[sa[1:]] != x[sa[:-1]]])
    rank[sa] = group(tied, new)
    levels, width = [rank.astype(kind)], 1
    while True:
        alone = new & np.concatenate([new[1:], [True]])
        tied = tied[~alone]
        if not len(tied):
            return sa, levels
        at = sa[tied]
        key = rank[at] * len(x) + rank[at + width]  # symbols that occur once end no tie, so at + width is inside
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[tied] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = group(tied, new)
        levels.append(rank.astype(kind))
        width *= 2


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix with that before it in the array; 0 for the first."""
    lcp = np.zeros(len(sa), np.int64)
    k = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b, shared = sa[k - 1], sa[k], np.zeros(len(k), np.int64)
    for t in range(len(levels) - 2, -1, -1):
        shared += (levels[t][a + shared] == levels[t][b + shared]).astype(np.int64) << t
    lcp[k] = shared
    return lcp


def sides(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the next one to the left with an LCP not larger, and to the right with a smaller one."""
    left, right, open_ = [0] * len(lcp), [len(lcp)] * len(lcp), []
    values = lcp.tolist()
    for k, d in enumerate(values):
        while open_ and values[open_[-1]] > d:
            right[open_.pop()] = k
        left[k] = open_[-1] if open_ else 0
        open_.append(k)
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_squares(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares whose word behind them breaks the period."""
    isa = np.empty(len(sa), np.int64)
    isa[sa] = np.arange(len(sa))
    left, right = sides(lcp)
    split = np.flatnonzero(lcp > 0)
    if not len(split):
        return split, split
    # Place `split` divides the interval [left, right) of its depth in two.
    left, right, depth = left[split], right[split], lcp[split]
    first = split - left <= right - split
    small, small_end = np.where(first, left, split), np.where(first, split, right)
    other, other_end = np.where(first, split, left), np.where(first, right, split)
    upto = np.cumsum(small_end - small)
    starts, periods, at = [], [], 0
    while at < len(split):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LOOK_UPS, "right")))
        sizes = (small_end - small)[at:to]
        node = np.repeat(np.arange(at, to), sizes)
        i = sa[np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + small[node]]
        for step in (1, -1):
            j = i + step * depth[node]
            inside = np.flatnonzero((j >= 0) & (j < len(sa)))
            place = isa[j[inside]]
            hit = inside[(place >= other[node[inside]]) & (place < other_end[node[inside]])]
            starts.append(np.minimum(i[hit], j[hit]))
            periods.append(depth[node[hit]])
        at = to
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(x: np.ndarray, least: int, exponent: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of x, by start and period; x's last symbol occurs once."""
    sa, levels = doubled_ranks(x)
    square, period = branching_squares(sa, common_prefixes(sa, levels))
    end, start = square + 2 * period, square.copy()
    for t in range(len(levels) - 2, -1, -1):  # rotate by 2^t words at once
        before = np.maximum(start - (1 << t), 0)
        same = (start >= 1 << t) & (levels[t][before] == levels[t][before + period])
        start[same] = before[same]
    long = end - start >= np.maximum(least, exponent * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least_period = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])]) if len(start) else np.empty(0, bool)
    start, end, period = start[least_period], end[least_period], period[least_period]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def runs_in(texts: list[list], least: int = LEAST, exponent: float = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of every list of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    number = defaultdict(count().__next__)
    ids = np.array(list(map(number.__getitem__, chain.from_iterable(texts))), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin, end = recurring_stretches(ids, owner, window_words(least, exponent), least)
    if not len(begin):
        return out
    # Each stretch with a symbol of its own behind it; words of different stretches are different symbols.
    lengths = end - begin + 1
    stretch = np.repeat(np.arange(len(begin)), lengths)
    first = np.cumsum(lengths) - lengths
    word = np.arange(len(stretch)) - first[stretch] + begin[stretch]
    mark = word == end[stretch]
    symbols = np.where(mark, len(number), ids[np.minimum(word, len(ids) - 1)]) + stretch * (len(number) + 1)
    start, length, period = runs_of(symbols, least, exponent)
    text_first = np.cumsum(sizes) - sizes
    at = word[start]
    for doc, *run in zip(owner[at].tolist(), (at - text_first[owner[at]]).tolist(), length.tolist(), period.tolist(), strict=True):
        out[doc].append(tuple(run))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that a run has behind its first period."""
    if not runs:
        return b" ".join(words)
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(stays).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: float = EXPONENT) -> DataFrame:
    """id, n_words, runs (start, length, period in words, by start and period), the run of the greatest length / period (start,
    length, period, exponent_milli; ties: first start, then period) and the text without repetitions, of every row."""
    if least < 1 or exponent < 2:
        raise ValueError("least has to be positive and exponent at least 2")

    def compute(texts: list[bytes]) -> list:
        words = [t.split() for t in texts]
        runs = runs_in(words, least, exponent)
        best = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else (None,) * 3 for r in runs]
        milli = [b[1] and 1000 * b[1] // b[2] for b in best]
        return [[len(w) for w in words], runs, *map(list, zip(*best, strict=True)), milli, [collapsed(w, r).decode("utf-8", "replace") for w, r in zip(words, runs, strict=True)]]

    fields = [field("n_words", T.LongType()), field("runs", T.ArrayType(RUN)), *RUN.fields, field("exponent_milli", T.LongType()), field("collapsed", T.StringType())]
    return append_in_arrow(docs, text_col, [id_col], fields, compute)


def with_tandem_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, a tenth of whose texts - chosen by the id - go on periodically from a word of their own on (see `op11_periodic_runs`).

    With h the CRC-32 of the decimal id and g = h div 10: if 10 divides h, words i >= a = g % n become word
    a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). A null id changes nothing.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = h % 10 == 0
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.withColumn("__words", F.when(chosen, words)).withColumn("__n", F.size("__words").cast("long"))
    g = F.floor(h / 10)
    a = F.when(F.col("__n") > 0, g % F.col("__n"))
    planned = cut.withColumn("__a", a).withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8)))

    def word(w: Column, i: Column) -> Column:
        there = F.col("__a") + F.pmod(i - F.col("__a"), F.col("__p"))
        return F.when(i < F.col("__a"), w).otherwise(F.element_at("__words", (there + 1).cast("int")))

    text = F.when(chosen & (F.col("__n") > 0), F.array_join(F.transform("__words", word), " ")).otherwise(F.col(text_col))
    return planned.withColumn(text_col, text).select(*docs.columns)
