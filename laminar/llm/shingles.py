"""Near copies by shingle similarity: candidates, the pigeonring filter, then the whole shingle sets.

A text is the set of its word shingles (five words; A-Z lower-cased; a shorter text is one
shingle). Two texts are linked at a Jaccard similarity of `SIMILARITY` or more. The first candidates
are those of `simhash`: the sets' fingerprints filed under choices of segments, hot keys cut up, and in a key the
pairs that pass the pigeonring filter and the Hamming check at `simhash.BITS` (`segment_pairs`). At the threshold
fingerprints differ in about 10 of 64 bits, more than any choice of segments can select by, so
further candidates come from MinHash: BANDS keys of ROWS minima each are taken from a set; a pair at 0.8
shares a key with probability 1 - (1 - 0.8^6)^32 = 0.99994, and more above it. Every candidate pair
then has to pass

* the pigeonring filter and the Hamming check of its sets' SimHash fingerprints with a budget of
  NEAR_BITS (10 bits is the mean at 0.8; very short texts differ in more, 32 is chance);
* the share of equal minima, of BANDS * ROWS, being LIKELY at least (four deviations below 0.8);
* the comparison of the whole shingle sets, which alone makes a link.

Beside the pairs of segments, each member of a MinHash key is paired with the key's first member, whatever the key's size, and the links found so give
labels. Keys that then still hold several labels are looked at whole, without sampling and without pairs leaving a task: labels with the same smallest label
beside them are one field, a field's sets are dealt into blocks of a bounded weight (a large label fills blocks of its
own), and each two blocks that meet in such a key, other than blocks of one and the same label, make a tile. A tile has the whole shingle sets of its
two blocks. It compares all pairs of different labels that pass the pigeonring filter and the Hamming check - their shared shingles are
the product of two incidence matrices - and sends on which labels are linked, one row a label at most. So every two sets that share a key are linked,
directly or through others, if they are similar enough; the work in a field grows with its pairs, in tiles of bounded size, its rows with its members by its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import components
from .common import append_in_arrow, field, materialise, numbered
from .simhash import majority, near, near_pairs, roots, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
NEAR_BITS, LIKELY = 24, 0.68
#: Weight of a block: its sets' shingles, and for each set as many as SET_WEIGHT more. Columns of an incidence matrix at a time.
BLOCK_WEIGHT, SET_WEIGHT, COLUMNS = 1 << 16, 256, 4096
_random = np.random.default_rng(5)
TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
PLUS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
PAIR = T.StructType([field("a", T.LongType()), field("b", T.LongType())])


def shingle_set(text: bytes, words_per_shingle: int = WORDS) -> np.ndarray:
    """Sorted XXH64 values of a UTF-8 text's shingles, each once."""
    hashes = np.sort(shingle_hashes(text, words_per_shingle))
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])] if len(hashes) else hashes


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The minima of a shingle set."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for first in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[first : first + 2048, None] * TIMES + PLUS).min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A key for each band."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(row.tobytes()) for row in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64).tolist()


def tag(docs: DataFrame, text_col: str, words_per_shingle: int) -> DataFrame:
    """docs with a row key, the key of the shingle set, its size, its bands (an empty set has none), a byte of each minimum, the
    fingerprint and a digest of the text, written once."""

    def compute(texts: list[bytes]) -> list:
        from xxhash import xxh64_intdigest

        cols: list[list] = [[], [], [], [], []]
        for t in texts:
            hashes = shingle_set(t, words_per_shingle)
            least = least_values(hashes)
            for col, x in zip(cols, (xxh64_intdigest(hashes.tobytes(), 7), len(hashes), band_keys(least) if len(hashes) else [], least.astype(np.uint8).tobytes(), majority(hashes)), strict=True):
                col.append(x)
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        return [signed(cols[0]), cols[1], cols[2], cols[3], signed(cols[4]), signed([xxh64_intdigest(t, 11) for t in texts])]

    fields = [field("__set", T.LongType()), field("__size", T.LongType()), field("__bands", T.ArrayType(T.LongType())), field("__minima", T.BinaryType()), field("__fp", T.LongType()), field("__digest", T.LongType())]
    keyed = docs.withColumn("__row", F.monotonically_increasing_id())
    return materialise(append_in_arrow(keyed, text_col, keyed.columns, fields, compute), "shingles")


def star_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a key with the key's first; rows (band, key, set) come sorted by key."""
    last: tuple | None = None
    for batch in batches:
        band, key, member = (c.to_numpy() for c in batch.columns)
        if not len(band):
            continue
        if last is not None:  # the first row stands for the key that may go on
            band, key, member = (np.concatenate([[x], c]) for x, c in zip(last, (band, key, member), strict=True))
        new = np.concatenate([[True], (band[1:] != band[:-1]) | (key[1:] != key[:-1])])
        hub = member[np.maximum.accumulate(np.where(new, np.arange(len(band)), 0))]
        found = np.flatnonzero(member != hub)
        last = (band[-1], key[-1], hub[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(member, hub)[found]), pa.array(np.maximum(member, hub)[found])], names=["a", "b"])


def minima_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, two fingerprints, two texts' minima) that may be similar enough, as (a, b)."""
    for batch in batches:
        if batch.num_rows:
            x = np.bitwise_xor(*(batch.column(k).to_numpy().view(np.uint64) for k in (2, 3)))
            equal = (minima_of(batch.column(4)) == minima_of(batch.column(5))).mean(1)
            kept = near(x, NEAR_BITS)
            kept = pa.array(kept[equal[kept] >= LIKELY])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["a", "b"])


def filed(sets: DataFrame) -> DataFrame:
    """(band, key, set) of every set, dealt by key, in an order of the band's own."""
    rows = sets.select("__set", F.posexplode("__bands").alias("band", "key")).select("band", "key", "__set")
    return rows.repartition("band", "key").sortWithinPartitions("band", "key", F.xxhash64("__set", "band"))


def segment_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints the segments bring together, by the smallest set of a fingerprint, and this with the others of its fingerprint."""
    hubs = materialise(sets.groupBy(F.col("__fp").alias("fp")).agg(F.min("__set").alias("hub")), "fingerprint-sets")
    far = near_pairs(hubs).join(hubs.withColumnRenamed("hub", "a"), "fp").select("a", F.col("to").alias("fp")).join(hubs.withColumnRenamed("hub", "b"), "fp")
    same = sets.select(F.col("__fp").alias("fp"), F.col("__set").alias("b")).join(hubs.withColumnRenamed("hub", "a"), "fp").filter("a <> b")
    return far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(same.select("a", "b"))


def members(pairs: DataFrame) -> DataFrame:
    """The sets of the pairs, each once; either side is made distinct before it is dealt out."""
    return pairs.select(F.col("a").alias("__set")).distinct().union(pairs.select("b").distinct()).distinct()


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that pass the pigeonring filter and have enough equal minima."""
    of = lambda side, n: sets.select(F.col("__set").alias(side), F.col("__fp").alias(f"fp{n}"), F.col("__minima").alias(f"minima{n}"))
    pairs = pairs.join(of("a", 1), "a").join(of("b", 2), "b").select("a", "b", "fp1", "fp2", "minima1", "minima2")
    return pairs.mapInArrow(likely, PAIR)


def whole_sets(needed: DataFrame, tagged: DataFrame, sets: DataFrame, text_col: str, words_per_shingle: int) -> DataFrame:
    """(set, hashes) of the needed sets (set), from one text each, written once."""

    def compute(texts: list[bytes]) -> list:
        return [[shingle_set(t, words_per_shingle).view(np.int64) for t in texts]]

    rows = materialise(sets.join(needed, "__set").select(F.col("best.row").alias("__row")), "needed")
    texts = tagged.select("__row", "__set", text_col).join(rows, "__row", "left_semi")
    return materialise(append_in_arrow(texts, text_col, ["__set"], [field("hashes", T.ArrayType(T.LongType()))], compute), "shingle-sets")


def confirmed(pairs: DataFrame, tagged: DataFrame, sets: DataFrame, text_col: str, words_per_shingle: int, similarity: float) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough."""
    pairs = materialise(pairs, "pairs")
    whole = whole_sets(members(pairs), tagged, sets, text_col, words_per_shingle)
    one = whole.select(F.col("__set").alias("a"), F.col("hashes").alias("one"))
    two = whole.select(F.col("__set").alias("b"), F.col("hashes").alias("two"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("one").alias("m"), F.size("two").alias("n"), F.size(F.array_intersect("one", "two")).alias("shared"))
    return materialise(both.filter(F.col("shared") / (F.col("m") + F.col("n") - F.col("shared")) >= similarity).select("a", "b"), "links")


def incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) of the members of the sets that several sets have, by column, and the number of columns."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    every = np.concatenate(sets) if sets else np.empty(0, np.int64)
    order = np.argsort(every, kind="stable")
    row, every = row[order], every[order]
    same = np.concatenate([[False], every[1:] == every[:-1]]) if len(every) else np.empty(0, bool)
    several = same | np.concatenate([same[1:], [False]]) if len(every) else same
    return row[several], (np.cumsum(~same[several]) - 1), int((~same[several]).sum())


def tile_links(sets: list[np.ndarray], labels: np.ndarray, prints: np.ndarray, first: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked labels, as (label, smallest label reached), by the pairs of sets of two blocks: the first `first` sets
    and those behind them, or, if these are none, of one block."""
    names, at = np.unique(labels, return_inverse=True)
    left, right = slice(0, first), slice(first, len(sets)) if first < len(sets) else slice(0, first)
    near_pairs = np.zeros((len(prints[left]), len(prints[right])), bool)
    near_pairs.ravel()[near((prints[left, None] ^ prints[None, right]).ravel(), NEAR_BITS)] = True
    near_pairs &= at[left, None] != at[None, right]
    if not near_pairs.any():
        return names[:0], names[:0]
    row, column, n = incidence(sets)
    shared = np.zeros(near_pairs.shape, np.float32)  # counts below 2^24 are exact
    for k in range(0, n, COLUMNS):
        a, b = np.searchsorted(column, [k, k + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, n - k)), np.float32)
        part[row[a:b], column[a:b] - k] = 1
        shared += part[left] @ part[right].T
    size = np.array([len(x) for x in sets], float)
    shared = shared.astype(float)
    union = size[left, None] + size[None, right] - shared
    i, j = np.nonzero(near_pairs & (shared / np.maximum(union, 1) >= similarity))
    low = roots(len(names), at[left][i], at[right][j])
    moved = np.flatnonzero(low != np.arange(len(names)))
    return names[moved], names[low[moved]]


def tiles_of(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set, label, block) of the sets in keys of several labels, and (tile, block, second) of the blocks that meet in such a key.

    rows: (band, key, set, label, low), low being the key's smallest label.
    """
    # Only for labels that meet to lie in few blocks: which blocks meet is taken from the keys.
    fields = rows.groupBy("label").agg(F.min("low").alias("field"))
    named = rows.select("__set", "label").distinct().join(sets.select("__set", (F.col("__size") + SET_WEIGHT).alias("weight")), "__set").join(fields, "label")
    named = materialise(named, "field-sets")
    by_label = named.groupBy("field", "label").agg(F.sum("weight").alias("heavy"))
    blocks = lambda weight: F.ceil(F.sum(weight) / BLOCK_WEIGHT)
    large = F.col("heavy") > BLOCK_WEIGHT / 2
    by_label = materialise(by_label.select("field", "label", "heavy", large.alias("large")), "label-weights")
    shares = by_label.groupBy("field").agg(blocks(F.when(~F.col("large"), F.col("heavy")).otherwise(0)).alias("n_small"))
    of = by_label.join(shares, "field").select("label", "large", "field", F.when(F.col("large"), F.ceil(F.col("heavy") / BLOCK_WEIGHT)).otherwise(F.col("n_small")).alias("n_blocks"))
    number = F.when(F.col("large"), F.pmod(F.xxhash64("__set"), "n_blocks")).otherwise(F.pmod(F.xxhash64("label"), "n_blocks"))
    block = F.xxhash64(F.when(F.col("large"), F.col("label")).otherwise(F.col("field")), "large", number)
    dealt = materialise(named.select("__set", "label").join(of, "label").select("__set", "label", block.alias("block"), F.when(F.col("large"), F.col("label")).alias("alone")), "blocks")
    met = rows.select("band", "key", "__set").join(dealt, "__set").groupBy("band", "key").agg(F.collect_set(F.struct("block", "alone")).alias("blocks"))  # blocks of a key, not sets
    two = met.select(F.explode(F.filter(F.flatten(F.transform("blocks", lambda x: F.transform("blocks", lambda y: F.struct(x.alias("x"), y.alias("y"))))), lambda p: (p["x"]["block"] <= p["y"]["block"]) & ~(p["x"]["alone"].isNotNull() & p["x"]["alone"].eqNullSafe(p["y"]["alone"])))).alias("p")).distinct()
    tile = F.xxhash64("p.x.block", "p.y.block")
    one = two.select(tile.alias("tile"), F.col("p.x.block").alias("block"), F.lit(False).alias("second"))
    other = two.filter("p.x.block <> p.y.block").select(tile.alias("tile"), F.col("p.y.block").alias("block"), F.lit(True).alias("second"))
    return dealt.select("__set", "label", "block"), materialise(one.union(other), "tiles")


def crossing_links(rows: DataFrame, tagged: DataFrame, sets: DataFrame, text_col: str, words_per_shingle: int, similarity: float) -> DataFrame:
    """(a, b): labels that are linked by sets which share a key of several labels."""
    dealt, tiles = tiles_of(rows, sets)
    whole = whole_sets(dealt.select("__set"), tagged, sets, text_col, words_per_shingle)
    full = dealt.join(whole, "__set").join(sets.select("__set", "__fp"), "__set")
    placed = tiles.join(full, "block").select("tile", "second", "label", "__fp", "hashes").repartition("tile").sortWithinPartitions("tile", "second")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, firsts, labels, prints, held = None, 0, [], [], []

        def close() -> pa.RecordBatch:
            a, b = tile_links(held, np.array(labels, np.int64), np.array(prints, np.int64).view(np.uint64), firsts, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            values, ends = batch.column(4).flatten().to_numpy(), np.cumsum(batch.column(4).value_lengths().to_numpy()).tolist()
            keys, second, label, print_ = (batch.column(k).to_pylist() for k in range(4))
            for k, key in enumerate(keys):
                if key != tile:
                    if tile is not None:
                        yield close()
                    tile, firsts, labels, prints, held = key, 0, [], [], []
                firsts += not second[k]
                labels.append(label[k])
                prints.append(print_[k])
                held.append(values[ends[k - 1] if k else 0 : ends[k]].copy())
        if tile is not None:
            yield close()

    return materialise(placed.mapInArrow(compare, PAIR), "label-links")


def labelled(tagged: DataFrame, sets: DataFrame, text_col: str, words_per_shingle: int, similarity: float) -> DataFrame:
    """(set, label) of all sets that have a link."""
    star = filed(sets).mapInArrow(star_pairs, PAIR)
    star = materialise(segment_pairs(sets).union(star).distinct(), "candidates")
    links = confirmed(plausible(star, sets), tagged, sets, text_col, words_per_shingle, similarity)
    labels = components(links, "a", "b").withColumnRenamed("node", "__set")
    met = members(star)
    named = materialise(sets.join(met, "__set").join(labels, "__set", "left").select("__set", "__bands", F.coalesce("label", "__set").alias("label")), "labelled")
    keyed = named.select("__set", "label", F.posexplode("__bands").alias("band", "key"))
    mixed = keyed.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band", "key", "low")
    rows = materialise(keyed.join(mixed, ["band", "key"]).select("band", "key", "__set", "label", "low"), "mixed-keys")
    more = crossing_links(rows, tagged, sets, text_col, words_per_shingle, similarity)
    if more.isEmpty():
        return labels
    renamed = components(more, "a", "b").select(F.col("node").alias("label"), F.col("label").alias("to"))
    return named.join(renamed, "label", "left").select("__set", F.coalesce("to", "label").alias("label"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near copies: of each component one row, that with the smallest id.

    Rows are told apart by a key of their own, so null or repeated ids cost no other row its
    place: a null id comes after all others, and rows of equal ids are taken by a digest of
    their text, then by place. Texts without words are copies of each other. Columns may have any names.
    """
    rows, name = numbered(docs)
    id_col, text_col = name[id_col], name[text_col]
    tagged = tag(rows, text_col, words_per_shingle)
    order = F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.col("__digest").alias("digest"), F.col("__row").alias("row"))
    first = [F.first(c).alias(c) for c in ("__bands", "__size", "__minima", "__fp")]
    sets = materialise(tagged.groupBy("__set").agg(F.min(order).alias("best"), *first, F.count(F.lit(1)).alias("n")), "sets")
    named = sets.join(labelled(tagged, sets, text_col, words_per_shingle, similarity), "__set", "left").select("__set", "best", "n", F.coalesce("label", "__set").alias("label"))
    least = named.groupBy("label").agg(F.min("best").alias("first"), F.sum("n").alias("n")).filter("n > 1").select("label", F.col("first.row").alias("stays"))
    shared = materialise(named.select("__set", "label").join(least, "label").select("__set", "stays"), "components")
    gone = materialise(tagged.select("__set", "__row").join(shared, "__set").filter("__row <> stays").select("__row"), "copies")
    return tagged.join(gone, "__row", "left_anti").select(rows.columns).toDF(*docs.columns)
