"""Quality rules: a linear-chain conditional random field over lines.

Each line is content or boilerplate. Emission scores come from the line's make-up,
transition scores from its neighbours; Viterbi decoding labels all lines of a text
together. A text is kept if its content lines hold at least `least_share` of its
words and it passes the base rules (20 words; at most 30 % of words in repeated
8-word windows).

The field is trained here by gradient ascent on the likelihood of line sequences of
labelled documents: lines of good documents count as content, lines of bad ones as
boilerplate. The sample is at most `SAMPLE` ids of each label, with all lines of their
texts; sequences of more than `STRETCH` lines are learnt from as stretches of so many, at most
`STRETCHES` of them. The features are computed where the texts are, and they alone reach the driver: no more than 25 MB.
These bounds hold for training only. As the sample has
both labels alike, a text's first line starts with the log odds of the labels.

Contract: null and empty texts have no word, fail the base rules and aren't kept.
Texts are read whole. Rows are independent: repeated rows get equal results. Extra
columns are ignored, an empty table gives an empty table. Without labelled rows of
both kinds the start weights decide. An id with both labels isn't learnt from; of an id's
several texts one, by hash, is.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_in_arrow, field, numbered

SAMPLE, STRETCH, STRETCHES = 400, 48, 8000
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Largest transition weight: lines of a document may differ, though the sample's documents have one label each.
MOST_MOVE = 0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Byte classes: columns of the line make-up.
BLANK, UPPER, LOWER, DIGIT, SYMBOL, MARK, TAIL = (1 << k for k in range(7))


def byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[[0x20, *range(9, 14)]] = BLANK
    kinds[ord("A") : ord("Z") + 1] = UPPER
    kinds[ord("a") : ord("z") + 1] = LOWER
    kinds[0xC0:] = LOWER
    kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[list(SYMBOLS)] = SYMBOL
    kinds[list(b"!?.,;:\"'()[]{}=+-_/\\@^~`")] = MARK
    kinds[0x80:0xC0] = TAIL  # the later bytes of a character
    return kinds


KINDS = byte_kinds()
FEATURES = ["bias", "log_words", "upper", "symbol", "digit", "mark", "repeated", "short"]
#: Scores of boilerplate before training: junk marks and repeats speak for it.
START = np.array([-2.0, -0.8, 2.0, 6.0, 1.0, 2.0, 2.0, 0.3])
#: Start transitions: neighbours tend to be alike.
START_MOVES = np.array([[0.5, -0.5], [-0.5, 0.5]])


class Lines:
    """Counts by text and features by line of some texts."""

    def __init__(self, texts: list[bytes]):
        stream = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        kinds = KINDS[stream]
        ends = np.flatnonzero(stream == 10)
        self.lines_in = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
        self.last = np.cumsum(self.lines_in)  # the line after each text's last

        def upto(mask: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)[ends]])

        filled = ((kinds & BLANK) == 0).astype(np.uint8)
        begins = filled.copy()
        begins[1:] &= 1 - filled[:-1]
        n = {"words": upto(begins), "chars": upto(filled & (kinds != TAIL)), "symbol": upto(kinds == SYMBOL), "upper": upto(kinds == UPPER), "lower": upto(kinds == LOWER), "digit": upto(kinds == DIGIT), "mark": upto(kinds == MARK)}
        bounds = np.concatenate([[0], self.last])
        self.n_words, self.word_chars, self.n_symbols = (np.diff(n[k][bounds]) for k in ("words", "chars", "symbol"))
        by = {k: np.diff(v) for k, v in n.items()}
        self.words = by["words"]
        self.texts = texts
        chars = np.maximum(by["chars"], 1)
        letters = np.maximum(by["upper"] + by["lower"], 1)
        repeated = np.zeros(len(ends))
        self.n_dup_lines = np.zeros(len(texts), np.int64)
        first = 0
        words = self.words.tolist()
        for k, t in enumerate(texts):
            lines = t.split(b"\n")
            real = [x for i, x in enumerate(lines) if words[first + i]]
            distinct = len(set(real))
            if distinct < len(real):
                self.n_dup_lines[k] = len(real) - distinct
                met: dict[bytes, int] = {}
                for x in real:
                    met[x] = met.get(x, 0) + 1
                for i, x in enumerate(lines):
                    repeated[first + i] = met.get(x, 0) > 1
            first += len(lines)
        share_upper = by["upper"] / letters
        self.features = np.stack([np.ones(len(ends)), np.log1p(by["words"]) / 8, np.where(by["upper"] > 3, share_upper, 0), np.sqrt(by["symbol"] / chars), by["digit"] / chars, by["mark"] / chars, repeated, (by["words"] < 4).astype(float)], 1)


def repeat_words(text: bytes, window: int = WINDOW) -> int:
    """Words in windows of `window` words that occur twice or more in the text."""
    words = text.split()
    n = len(words) - window + 1
    if n < 2:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    to = (ends[window - 1 :] - 1).tolist()
    at = [0, *ends[: n - 1].tolist()]
    grams = [joined[a:b] for a, b in zip(at, to, strict=True)]
    met: dict[bytes, int] = {}
    first = [met.setdefault(g, k) for k, g in enumerate(grams)]
    if len(met) == n:
        return 0
    first_at = np.array(first)
    again = np.flatnonzero(first_at != np.arange(n))
    hit = np.zeros(n, bool)
    hit[again] = hit[first_at[again]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def viterbi(scores: list[float], moves: np.ndarray) -> list[int]:
    """Best labels (1: boilerplate) of one text; `scores` favour boilerplate over content line by line; ties go to content."""
    (cc, cb), (bc, bb) = moves.tolist()
    content, junk = 0.0, scores[0]
    back = []
    for s in scores[1:]:
        from_c, from_b = content + cc, junk + bc
        to_c, to_b = content + cb, junk + bb
        back.append((from_b > from_c, to_b > to_c))
        content, junk = max(from_c, from_b), max(to_c, to_b) + s
    label = int(junk > content)
    labels = [label]
    for step in reversed(back):
        label = int(step[label])
        labels.append(label)
    return labels[::-1]


def train(stretches: list[np.ndarray], bad: list[int], steps: int = 300, rate: float = 1.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that make the labels of the sample's lines likely (forward-backward, gradient ascent); a stretch holds a line's features in each row."""
    weights, moves = START.copy(), START_MOVES.copy()
    if not 0 < sum(bad) < len(bad):
        return weights, moves
    docs, most = len(stretches), max(map(len, stretches))
    x = np.zeros((docs, most, len(FEATURES)))
    live = np.zeros((docs, most), bool)
    for k, lines in enumerate(stretches):
        x[k, : len(lines)], live[k, : len(lines)] = lines, True
    y = np.array(bad)
    weight = np.where(y == 1, docs / (2 * y.sum()), docs / (2 * (docs - y.sum())))[:, None] / live.sum()
    pairs = live[:, 1:]
    size, size_moves = np.full(len(FEATURES), 1e-12), np.full((2, 2), 1e-12)  # squared gradients so far: each step is scaled by their root
    for _ in range(steps):
        e = np.stack([np.zeros((docs, most)), x @ weights], 2)  # content, boilerplate
        ahead, back = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for t in range(1, most):
            ahead[:, t] = e[:, t] + np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1])
        for t in range(most - 2, -1, -1):
            to = np.where(live[:, t + 1, None], e[:, t + 1] + back[:, t + 1], -np.inf)
            step = np.logaddexp(moves[:, 0] + to[:, :1], moves[:, 1] + to[:, 1:])
            back[:, t] = np.where(live[:, t + 1, None], step, 0)
        total = np.logaddexp(*np.moveaxis(ahead[:, 0] + back[:, 0], 1, 0))[:, None]
        p = np.exp(ahead[..., 1] + back[..., 1] - total)
        gap = np.where(live, (y[:, None] - p) * weight, 0)
        slope, slope_moves = (gap[..., None] * x).sum((0, 1)) - decay * (weights - START), np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                p2 = np.exp(ahead[:, :-1, a] + moves[a, b] + e[:, 1:, b] + back[:, 1:, b] - total)
                want = ((y == a) & (y == b)).astype(float)[:, None]
                slope_moves[a, b] = np.where(pairs, (want - p2) * weight, 0).sum() - decay * (moves[a, b] - START_MOVES[a, b])
        size, size_moves = size + slope**2, size_moves + slope_moves**2
        weights = weights + rate * slope / np.sqrt(size)
        moves = np.clip(moves + rate * slope_moves / np.sqrt(size_moves), -MOST_MOVE, MOST_MOVE)  # a document has one label, so unbounded moves would forbid every change
    return weights, moves


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, each: int, keep=None) -> DataFrame:
    """__id (as text), __label and __text of at most `each` ids of each label, by hash of the id: ids with one label only, one text of each."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if keep is not None:
        known = known.filter(keep)
    known = known.groupBy(id_col).agg(F.min(label_col).alias("__label"), F.max(label_col).alias("__most")).filter("__label = __most").drop("__most")
    picked = None
    for value in (0, 1):
        of = known.filter(F.col("__label") == value).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(each)
        picked = of if picked is None else picked.union(of)
    rows = docs.filter(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(picked), id_col)  # at most 2 * each ids
    return rows.groupBy(F.col(id_col).cast("string").alias("__id"), "__label").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))


def labelled_stretches(sample: DataFrame, most: int = STRETCHES) -> tuple[list[np.ndarray], list[int]]:
    """Line features of the sample's texts, cut into stretches, and 1 for those of bad ones; beyond `most` stretches those that a hash picks."""

    def compute(texts: list[bytes]) -> list:
        got = Lines(texts)
        return [[[got.features[a : min(a + STRETCH, end)].ravel().tolist() for a in range(end - n, end, STRETCH)] for end, n in zip(got.last.tolist(), got.lines_in.tolist(), strict=True)]]

    made = append_in_arrow(sample, "__text", ["__id", "__label"], [field("__lines", T.ArrayType(T.ArrayType(T.DoubleType())))], compute)
    cut = made.select("__id", "__label", F.posexplode("__lines").alias("at", "x"))
    rows = cut.orderBy(F.xxhash64("__id", "at"), "__id", "at").limit(most).collect()  # at most `most` rows of STRETCH lines
    rows.sort(key=lambda r: (r["__id"], r["__label"], r["at"]))
    return [np.array(r["x"]).reshape(-1, len(FEATURES)) for r in rows], [1 - r["__label"] for r in rows]


def label_counts(labels: DataFrame, label_col: str) -> tuple[int, int]:
    """Rows labelled good, rows labelled bad."""
    counts = {r[label_col]: r["count"] for r in labels.filter(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}  # two rows
    return counts.get(1, 0), counts.get(0, 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep=None) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, transitions and the first line's start score, learnt from the labels (those that `keep` holds of)."""
    known = labels.select(id_col, label_col)
    known = known if keep is None else known.filter(keep)
    sample = labelled_sample(docs, known, id_col, text_col, label_col, SAMPLE)
    weights, moves = train(*labelled_stretches(sample))
    good, bad = label_counts(known, label_col)
    return weights, moves, -math.log((good + 1) / (bad + 1))


def decode(got: Lines, model: tuple[np.ndarray, np.ndarray, float]) -> list[list[int]]:
    """Labels of each text's lines, 1 for boilerplate."""
    weights, moves, start = model
    scores = got.features @ weights
    scores[got.last - got.lines_in] += start
    scores = scores.tolist()
    return [viterbi(scores[end - n : end], moves) for end, n in zip(got.last.tolist(), got.lines_in.tolist(), strict=True)]


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, least_share: float = 0.5) -> DataFrame:
    """The kept columns (the id), counts, base_failed, content_share, n_content_lines and kept of every row."""

    def compute(texts: list[bytes]) -> list:
        got = Lines(texts)
        labels = decode(got, model)
        repeats = np.array([repeat_words(t) for t in texts], np.int64)
        share, lines = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for k, (end, n) in enumerate(zip(got.last.tolist(), got.lines_in.tolist(), strict=True)):
            content = 1 - np.array(labels[k])
            share[k] = (content * got.words[end - n : end]).sum() / max(1, got.n_words[k])
            lines[k] = content.sum()
        failed = (got.n_words < 20) | (100 * repeats > 30 * got.n_words)
        return [got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, repeats, failed, share, lines, ~failed & (share >= least_share)]

    fields = [field(c, T.LongType()) for c in BASE] + [field("base_failed", T.BooleanType()), field("content_share", T.DoubleType()), field("n_content_lines", T.LongType()), field("kept", T.BooleanType())]
    return append_in_arrow(docs, text_col, [id_col] if keep is None else keep, fields, compute)


def passing(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", least_share: float = 0.5) -> DataFrame:
    """The rows of docs that `judge` keeps, with all their columns as they are, whatever these are called."""
    rows, name = numbered(docs)
    judged = judge(rows, model, text_col=name[text_col], keep=rows.columns, least_share=least_share)
    return judged.filter("kept").select(rows.columns).toDF(*docs.columns)
