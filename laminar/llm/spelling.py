"""Spelling variants: words a single edit apart, found by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point makes them equal. Written as rows of
padded code-point matrices, aligned left and right, a pair has a common prefix and a common suffix, and
is near if these reach the longer length minus one together. Matrices are compared block by block.

Tiles: let s be the shorter word's length. Of a near pair the first s // 2 code points agree, or else the last ones
do. So each word is filed under both halves, for s its own length and one less, and pairs meet within a
key. Members of keys beyond HOT are filed anew: what has agreed is taken off either end, and the same is true of
what is left between, so they get finer keys until these are small or a code point is left between. Each pair of a key has
one way down - the prefix where it agrees, else the suffix - and is counted at its end alone, so no pair
is met twice and a tile sends on one row a word: how many near words it found and the most frequent of them.

A word's form is its most frequent near word (ties: the first by code point) if that is `times` as frequent. Forms are
followed to the last, the root, by pointer doubling over written tables; counts grow along them, so they end.

Contract: words are runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z alone are lowered; null and empty texts have none.
Whole texts are counted, repeated rows as often as they occur. Of a table of words, null words and counts are
left out and repeated words' counts are added. Words may have any length: blocks get fewer rows then. Extra columns are
ignored; empty tables give an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import discard
from .common import field, materialise, slices

RUN = re.compile(r"[a-zÀ-ÿ]+")
#: Members of a key beyond which it is cut up.
HOT = 2048
#: Code points and pairs of a block that is compared at a time.
BLOCK_CELLS, BLOCK_PAIRS = 1 << 21, 1 << 20
#: Different words whose counts a task holds.
HELD_WORDS = 200_000
NEAR = T.StructType([field("word", T.StringType()), field("n_near", T.LongType()), field("near_n", T.LongType()), field("near", T.StringType())])


def damaged(word: str, doc_id, every: int) -> str:
    """word, or if `every` divides h, the CRC-32 of `<doc_id>:<word>`, without its code point h % length."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    at = h % len(word)
    return word[:at] + word[at + 1 :] if h % every == 0 else word


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = None) -> DataFrame:
    """(word, n) of all texts; pre-summed in the tasks. `damage`: of every so many of a document's words one loses a code point
    (see `damaged`; rows without an id lose none), which plants misspellings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for part, texts in slices(batch, text_col):
                for doc_id, text in zip(part.column(id_col).to_pylist(), texts, strict=True):
                    found = Counter(RUN.findall(text.lower().decode("utf-8", "replace")))  # of bytes: A-Z alone
                    if damage and doc_id is not None:
                        start, crc = zlib.crc32(f"{doc_id}:".encode()), zlib.crc32
                        hit = [w for w in found if crc(w.encode(), start) % damage == 0]
                        changed = [(damaged(w, doc_id, damage), found.pop(w)) for w in hit]
                        for w, n in changed:
                            found[w] += n
                    total.update(found)
                    if len(total) > HELD_WORDS:
                        yield out()
        if total:
            yield out()

    counted = docs.select(id_col, text_col).mapInArrow(count, "word string, n long")
    return counted.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def filed(words: DataFrame, least_length: int) -> DataFrame:
    """(key, short, head, tail, below, word, n): every word under its halves, as the shorter word and as the longer one.

    `head` and `tail` code points agree on either end, and the pairs that count have a common prefix below `below`.
    """
    size = F.char_length("word")
    rows = words.withColumn("short", F.explode(F.array(size, size - 1))).filter(F.col("short") >= least_length)
    return cut(rows.withColumns({"head": F.lit(0), "tail": F.lit(0), "below": F.lit(1 << 30)}))


def cut(rows: DataFrame) -> DataFrame:
    """Rows under both halves of what is left between head and tail."""
    half = F.floor((F.col("short") - F.col("head") - F.col("tail")) / 2).cast("int")
    by_head = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("below").alias("below"))
    by_tail = F.struct(F.col("head").alias("head"), (F.col("tail") + half).alias("tail"), F.least("below", F.col("head") + half).alias("below"))
    rows = rows.select("word", "n", "short", F.explode(F.array(by_head, by_tail)).alias("at")).select("word", "n", "short", "at.head", "at.tail", "at.below")
    ends = [F.expr("substring(word, 1, head)"), F.expr("if(tail = 0, '', right(word, tail))")]
    return rows.withColumn("key", F.xxhash64("short", "head", "tail", "below", *ends))


KEY = ["key", "short", "head", "tail", "below"]


def tiles(words: DataFrame, least_length: int) -> DataFrame:
    """The rows of `filed` whose keys have several members; hot keys are cut up until they are small or nothing is left to cut."""
    done, rows = None, materialise(filed(words, least_length), "word-keys")
    while True:
        sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        hot = (F.col("members") > HOT) & (F.col("short") - F.col("head") - F.col("tail") > 1)
        met = materialise(rows.join(sizes, KEY).select(*rows.columns, hot.alias("hot")), "tiles")
        discard(rows)
        small = met.filter("not hot").drop("hot")
        done = small if done is None else done.unionByName(small)
        if met.filter("hot").isEmpty():
            return done
        rows = materialise(cut(met.filter("hot").drop(*KEY[:1], "hot")).select(*rows.columns), "word-keys")


def matrix(words: list[str], width: int, right: bool = False) -> np.ndarray:
    """Code points of words, padded with zeros behind them or, if `right`, before them."""
    out = np.zeros((len(words), width), np.uint32)
    for row, w in zip(out, words, strict=True):
        points = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        row[slice(width - len(w), None) if right else slice(len(w))] = points
    return out


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows the number of columns that agree from the first one on."""
    alive = np.ones((len(a), len(b)), bool)
    total = np.zeros(alive.shape, np.int32)
    for k in range(a.shape[1]):
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        total += alive
    return total


def near_in_tile(words: list[str], short: int, head: int, below: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the near words of a key, block by block: each has a word of `short` code points and another one of as many
    or one more, and a common prefix of `head` or more, but fewer than `below`."""
    length = np.array([len(w) for w in words])
    shorts, width = np.flatnonzero(length == short), short + 1
    rows = max(1, min(int(BLOCK_PAIRS**0.5), BLOCK_CELLS // width))
    for x in range(0, len(shorts), rows):
        a = shorts[x : x + rows]
        left, right = matrix([words[k] for k in a], width), matrix([words[k] for k in a], width, True)[:, ::-1]
        for b in (np.arange(y, min(y + rows, len(words))) for y in range(0, len(words), rows)):
            twice = (length[b] == short)[None, :] & (a[:, None] >= b[None, :])  # equally long words meet once
            there = [words[k] for k in b]
            prefix = np.minimum(agreeing(left, matrix(there, width)), short)
            suffix = np.minimum(agreeing(right, matrix(there, width, True)[:, ::-1]), short)
            i, j = np.nonzero((prefix + suffix >= length[b][None, :] - 1) & (prefix >= head) & (prefix < below) & ~twice)
            yield a[i], b[j]


def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, short, head, tail, below, word, n) sorted by key, as (word, n_near, near_n, near) of a key's words."""
    last: tuple | None = None
    words: list[str] = []
    counts: list[int] = []
    made: list[tuple] = []

    def close() -> None:
        found: dict[int, list] = {}
        for i, j in near_in_tile(words, last[1], last[2], last[4]) if len(words) > 1 else ():
            for x, y in chain_pairs(i.tolist(), j.tolist()):
                mine, best = found.setdefault(x, [0, None]), (-counts[y], words[y])
                mine[0] += 1
                mine[1] = best if mine[1] is None else min(mine[1], best)
        made.extend((words[x], n, -best[0], best[1]) for x, (n, best) in found.items())
        words.clear()
        counts.clear()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=NEAR.names)
        made.clear()
        return batch

    for batch in batches:
        *keys, word, n = (c.to_pylist() for c in batch.columns)
        for key, w, k in zip(zip(*keys, strict=True), word, n, strict=True):
            if key != last:
                if last is not None:
                    close()
                last = key
            words.append(w)
            counts.append(k)
        if made:
            yield out()
    if words:
        close()
    if made:
        yield out()


def chain_pairs(i: list[int], j: list[int]) -> Iterator[tuple[int, int]]:
    yield from zip(i, j, strict=True)
    yield from zip(j, i, strict=True)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: chains of forms by pointer doubling."""
    table = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(table.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(table)
        table = moved
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")


def spelling_variants(words: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of (word, n) with at least so many code points and occurrences."""
    kept = words.filter(F.char_length("word") >= max(1, least_length)).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    kept = materialise(kept, "words")
    rows = tiles(kept, max(1, least_length)).select(*KEY, "word", "n").repartition(*KEY).sortWithinPartitions(*KEY)
    met = rows.mapInArrow(near_words, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    joined = kept.join(met, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))
    takes = F.col("near_n") >= times * F.col("n")
    named = materialise(joined.select("word", "n", "n_near", F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(named.filter("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
