"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A
text that compresses better with the good one is like the good texts: the difference
of its two compressed sizes, normalised by its own size, is all that its score depends on. A
logistic fit of that one number on labelled texts outside the dictionaries calibrates it to a
probability; the share of good labels among all training labels sets the probability's level.

Labels come from the training rows only; language, source and id are never inputs. The
sample for training is at most SAMPLE ids of each label, with their whole texts; half of it
builds the dictionaries, half fits the calibration. Texts stay with the executors: the driver gets at most PIECES
pieces of PIECE bytes of each label (about a hundred times a dictionary's size) to build the dictionaries from, and the
size differences, a number each, to calibrate. Scoring reads whole texts, in blocks of
BLOCK bytes, so that a long text meets the dictionaries as a short one does.

Contract: null and empty texts get the share of good labels, for want of evidence. Without training rows of
both labels every score is 0.5. An id with both labels isn't learnt from; of an id's several texts
one, by hash, is. Rows are independent, repeated rows equal, extra columns ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_in_arrow, field, materialise
from .linecrf import label_counts, labelled_sample

SAMPLE, DICTIONARY, BLOCK = 1500, 96_000, 1024
PIECE, PIECES = 2000, 5000
LEVEL = 3


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3, is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Sizes:
    """Compressed sizes of texts with each dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        quiet = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.by = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, **quiet).compress)

    def difference(self, text: bytes) -> float:
        """Bytes that the good dictionary saves over the bad one, by byte of text."""
        good, bad = self.by
        blocks = [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]
        return sum(len(bad(x)) - len(good(x)) for x in blocks) / max(1, len(text))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) by Newton's method; both labels weigh alike."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + penalty * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def dictionary(pieces: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the pieces themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:size] or b"\n" * 8


def pieces_of(texts: DataFrame, most: int = PIECES) -> list[bytes]:
    """The texts (rank, __text) in pieces of PIECE bytes, by rank; beyond `most` pieces those that a hash picks."""
    raw = F.col("__text").cast("binary")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("__text") - 1) / PIECE).cast("int")), lambda k: F.substring(raw, k * PIECE + 1, F.lit(PIECE)))
    pieces = texts.filter(F.octet_length("__text") > 0).select("rank", F.posexplode(cut).alias("at", "piece"))
    rows = pieces.orderBy(F.xxhash64("rank", "at"), "rank", "at").limit(most).collect()  # at most `most` pieces
    return [bytes(r["piece"]) for r in sorted(rows, key=lambda r: (r["rank"], r["at"]))]


_sizes: dict[int, Sizes] = {}


def sizes_with(good: bytes, bad: bytes) -> Sizes:
    """The compressors of two dictionaries, made once by worker."""
    key = hash((good, bad))
    if key not in _sizes:
        _sizes.clear()
        _sizes[key] = Sizes(good, bad)
    return _sizes[key]


def differences(texts: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """__label, rank and the size difference of each text (rank, __label, __text)."""
    sent = texts.sparkSession.sparkContext.broadcast((good, bad))  # two dictionaries of at most DICTIONARY bytes

    def compute(texts: list[bytes]) -> list:
        sizes = sizes_with(*sent.value)
        return [[sizes.difference(t) for t in texts]]

    return append_in_arrow(texts, "__text", ["__label", "rank"], [field("difference", T.DoubleType())], compute)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """(good dictionary, bad dictionary, calibration, share of good labels), or None without rows of both labels."""
    known = labels.select(id_col, label_col)
    sample = materialise(labelled_sample(docs, known, id_col, text_col, label_col, SAMPLE, ~held_out(id_col)), "labelled")
    ranks = sample.select("__id", "__label", F.row_number().over(Window.partitionBy("__label").orderBy("__id")).alias("rank"))
    sizes = {r["__label"]: r["n"] for r in ranks.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if min(sizes.get(y, 0) for y in (0, 1)) < 2:
        return None
    ranked = sample.join(F.broadcast(ranks), ["__id", "__label"])  # at most 2 * SAMPLE ids
    good, bad = (dictionary(pieces_of(ranked.filter(f"__label = {y} AND rank % 2 = 1")), DICTIONARY) for y in (1, 0))
    rest = sorted(differences(ranked.filter("rank % 2 = 0"), good, bad).collect())  # a number for each of at most SAMPLE ids
    mean, scale, w = logistic(np.array([[d] for _, _, d in rest]), np.array([y for y, _, _ in rest]))
    good_n, bad_n = label_counts(known.filter(~held_out(id_col)), label_col)
    w[0] += math.log(good_n / bad_n)  # the fit weighs both labels alike
    level = good_n / (good_n + bad_n)
    return good, bad, (mean, scale, w), level



def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (the id), score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY bytes

    def compute(texts: list[bytes]) -> list:
        if sent.value is None:
            return [[0.5] * len(texts), [1] * len(texts)]
        good, bad, (mean, scale, w), level = sent.value
        sizes = sizes_with(good, bad)
        x = np.array([[sizes.difference(t)] for t in texts])
        p = 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30)))
        p = np.where([len(t) > 0 for t in texts], p, level)
        return [p, (p >= 0.5).astype(np.int32)]

    fields = [field("score", T.DoubleType()), field("predicted", T.IntegerType())]
    return append_in_arrow(docs, text_col, [id_col] if keep is None else keep, fields, compute)
