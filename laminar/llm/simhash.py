"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits come from word shingles. Two fingerprints are linked at
`BITS` or fewer differing bits; a document's component is what links reach.

Candidates: the 64 bits are cut into SEGMENTS ring segments. With at most BITS
differing bits, at least SEGMENTS - BITS segments agree, so every fingerprint is
filed under each choice of so many segments (20 keys of 32 to 33 bits). Within a key
a candidate pair has to pass the pigeonring filter before the full Hamming check:
from some start segment, the sums of differences of 1, 2, 3, ... consecutive
segments all stay within their proportional share of BITS.

Keys of more than HOT members aren't met in one task: the bits that such a key leaves
free are cut into SEGMENTS segments again, and its members are filed anew under each
choice of SEGMENTS - BITS of these, for the same reason. What agrees then is 46 bits or
more; keys that are hot still are cut up the same way once more, to 55 bits, which leaves a key
512 different members, however many documents there are. The work within a key is by blocks of pairs. Each key emits at most one edge per member,
from it to the smallest fingerprint it reaches inside the key, so no group is ever
expanded into pairs. Components of the edges come from min-label propagation with pointer
jumping over checkpointed tables.

`representatives` keeps one document of each group of near copies at a shingle similarity
(see `shingles`): its first candidates are the pairs that the segments give (`near_pairs`); pairs whose fingerprints
differ in more than BITS, where no choice of segments selects, are added to these and pass the pigeonring filter with a larger budget.

Contract: null and empty texts have no word and fingerprint zero, and are linked
like any other. Equal fingerprints are filed once, however many rows share them.
Repeated rows get one result each. Rows with a null id get a component like any
other row, but a null id is never the smallest one; a component of null ids alone
is null. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import components
from .common import append_in_arrow, field, materialise

BITS, SEGMENTS = 3, 6
#: Bit ranges of the ring segments.
EDGES = [0, 11, 22, 33, 44, 54, 64]
#: Members of a key beyond which it is cut up.
HOT = 2000


def shingle_hashes(text: bytes, words_per_shingle: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of a UTF-8 text's shingles, repeats included: A-Z lower-cased, words between ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(words_per_shingle, len(words))
    to = (ends[k - 1 :] - 1).tolist()
    at = [0, *ends[: len(words) - k].tolist()]
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(at, to, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; of none, zero."""
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """SimHash of a UTF-8 text."""
    return majority(shingle_hashes(text, words_per_shingle))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, words_per_shingle: int = 3) -> DataFrame:
    """The kept columns (the id) and `fp`, the fingerprint as a signed long."""

    def compute(texts: list[bytes]) -> list:
        return [np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).view(np.int64)]

    return append_in_arrow(docs, text_col, [id_col] if keep is None else keep, [field("fp", T.LongType())], compute)


CHOICES = list(combinations(range(SEGMENTS), SEGMENTS - BITS))


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def key_masks() -> list[int]:
    """The bits of each choice of SEGMENTS - BITS segments."""
    return [mask_of([b for s in choice for b in range(EDGES[s], EDGES[s + 1])]) for choice in CHOICES]


def finer_masks(mask: int) -> list[int]:
    """A key's bits and each choice of SEGMENTS - BITS of the segments into which its free bits are cut."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [k * len(free) // SEGMENTS for k in range(SEGMENTS + 1)]
    return [mask | mask_of([b for s in choice for b in free[cuts[s] : cuts[s + 1]]]) for choice in CHOICES]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cut_up(hot: DataFrame, masks: list[int]) -> DataFrame:
    """(k, part, fp): the members (k, fp) of keys under the finer choices of their key."""
    finer = [(signed(m), [signed(x) for x in finer_masks(m)]) for m in masks]
    table = hot.sparkSession.createDataFrame(finer, "k long, finer array<long>")  # 20 masks, or 400
    return hot.join(F.broadcast(table), "k").select(F.explode("finer").alias("k"), "fp").withColumn("part", F.col("fp").bitwiseAND(F.col("k"))).select("k", "part", "fp")


def keyed(prints: DataFrame) -> DataFrame:
    """(k, part, fp): every fingerprint under each choice of segments, k its mask; members of a hot key under its finer choices."""
    masks = key_masks()
    filed = prints.select(F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("k"), "fp").withColumn("part", F.col("fp").bitwiseAND(F.col("k"))).select("k", "part", "fp")
    kept = None
    while True:
        final = masks[0].bit_count() > 50  # cut up twice: 512 members at most
        hot = None if final else materialise(filed.groupBy("k", "part").count().filter(F.col("count") > HOT).select("k", "part"), "hot-keys")
        cool = filed if final or hot.isEmpty() else filed.join(hot, ["k", "part"], "left_anti")
        kept = cool if kept is None else kept.union(cool)
        if cool is filed:
            return kept
        filed = materialise(cut_up(filed.join(hot, ["k", "part"], "left_semi").select("k", "fp"), masks).distinct(), "finer-keys")
        masks = sorted({finer for m in masks for finer in finer_masks(m)})


def segment_differences(x: np.ndarray) -> list[np.ndarray]:
    """Differing bits of each ring segment of XORs."""
    return [np.bitwise_count(x & np.uint64((1 << EDGES[s + 1]) - (1 << EDGES[s]))).astype(np.int8) for s in range(SEGMENTS)]


def pigeonring(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether from some start all chains of consecutive segments stay within l * bits / SEGMENTS differences."""
    d = segment_differences(x)
    passed = np.zeros(x.shape, bool)
    for start in range(SEGMENTS):
        ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.int8)
        for length in range(1, SEGMENTS + 1):
            total = total + d[(start + length - 1) % SEGMENTS]
            ok &= total <= length * bits // SEGMENTS
        passed |= ok
    return passed


def near(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of the XORs with at most `bits` bits: those that pass the pigeonring filter are counted in full."""
    kept = np.flatnonzero(pigeonring(x, bits))
    return kept[np.bitwise_count(x[kept]) <= bits]


def links_of(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked members of one key, found in blocks."""
    n = len(members)
    left, right = [], []
    rows = max(1, (1 << 19) // n)
    for a in range(0, n, rows):
        part = members[a : a + rows]
        i, j = np.nonzero(np.arange(a, n)[None, :] > np.arange(a, a + len(part))[:, None])
        x = part[i] ^ members[a + j]
        kept = near(x)
        left.append(i[kept] + a)
        right.append(j[kept] + a)
    return np.concatenate(left), np.concatenate(right)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    return label


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of edges that connect what all edges (left, right) between n indices connect, at most n - 1: each component takes its first edge to another one."""
    label, kept, live = np.arange(n), [np.empty(0, np.int64)], np.arange(len(left))
    while True:
        live = live[label[left[live]] != label[right[live]]]
        if not len(live):
            return np.unique(np.concatenate(kept))
        first = np.full(n, len(left))
        for side in (left, right):
            np.minimum.at(first, label[side[live]], live)
        kept.append(first[first < len(left)])
        every = np.concatenate(kept)
        label = roots(n, left[every], right[every])


def to_roots(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member of a key with the smallest one that it reaches."""
    to = roots(len(members), *links_of(members))
    moved = np.flatnonzero(to != np.arange(len(members)))
    return moved, to[moved]


def spanning(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of members of a key that connect all that are linked."""
    left, right = links_of(members)
    kept = forest(len(members), left, right)
    return left[kept], right[kept]


def key_edges(batches: Iterator[pa.RecordBatch], found: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] = to_roots) -> Iterator[pa.RecordBatch]:
    """Edges (fp, to) of each key, between the places of its members that `found` gives; rows come sorted by key."""
    rest: list[np.ndarray] = [np.empty(0, np.int64)] * 3

    def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, part, fp = cols
        if not len(k):
            return
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (part[1:] != part[:-1])) + 1
        sizes = np.diff(np.concatenate([[0], cuts, [len(k)]]))
        starts = np.concatenate([[0], cuts])
        out_a, out_b = [], []
        for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            members = np.unique(fp[a : a + n]).view(np.uint64)
            one, other = found(members)
            out_a.append(members[one].view(np.int64))
            out_b.append(members[other].view(np.int64))
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["fp", "to"])

    pending: list[list[np.ndarray]] = []
    held = 0
    for batch in batches:
        pending.append([c.to_numpy() for c in batch.columns])
        held += batch.num_rows
        if held < max(1 << 16, len(rest[0])):  # a key that goes on is copied ever more rarely
            continue
        k, part, fp = (np.concatenate(x) for x in zip(rest, *pending, strict=True))
        same = (k == k[-1]) & (part == part[-1])
        cut = int(np.argmax(same))  # the last key may go on
        yield from done([k[:cut], part[:cut], fp[:cut]])
        rest, pending, held = [k[cut:], part[cut:], fp[cut:]], [], 0
    yield from done([np.concatenate(x) for x in zip(rest, *pending, strict=True)])


def edges(prints: DataFrame, found: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(fp, to): the edges of all keys."""
    filed = keyed(materialise(prints.select("fp").distinct(), "distinct-fingerprints")).repartition("k", "part").sortWithinPartitions("k", "part")
    schema = T.StructType([field("fp", T.LongType()), field("to", T.LongType())])
    return filed.mapInArrow(partial(key_edges, found=found), schema)


def linked(prints: DataFrame) -> DataFrame:
    """(fp, label) of all fingerprints that have a link."""
    return components(edges(prints, to_roots), "fp", "to").withColumnRenamed("node", "fp")


def near_pairs(prints: DataFrame) -> DataFrame:
    """(fp, to): pairs of fingerprints at BITS or fewer differing bits that connect all such fingerprints, at most one a member of a key."""
    return edges(prints, spanning).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (the smallest id reachable) of every row."""
    prints = materialise(fingerprints(docs, id_col, text_col, None, words_per_shingle), "fingerprints")
    return with_components(prints, linked(prints), id_col)


def with_components(prints: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    firsts = prints.groupBy("fp").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n"))
    named = firsts.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"), F.sum("n").alias("n")).filter("n > 1")
    shared = materialise(named.select("fp", "label").join(least, "label").select("fp", "component_id"), "components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(shared, "fp", "left").select(id_col, hexed, F.when(F.col("component_id").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each group one row, that with the smallest id (see `shingles.representatives`)."""
    from . import shingles

    return shingles.representatives(docs, id_col, text_col)
