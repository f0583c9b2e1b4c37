"""Secret scans: pattern rules, and a randomness test battery with false-discovery control.

Rules find assignments, access keys and hexadecimal runs. The battery judges all other
long tokens: the encoding is inferred from the alphabet, and
three tests ask whether the token looks uniformly random in it - chi-squared on
symbol groups, a runs test about the alphabet's middle, and lag-one serial
correlation. Fisher's sum of their p-values is the token's score: small for random
strings, large for text. A token that mixes marks of both base64 alphabets is judged in the
alphabet of all characters that a token may have.

False discoveries are controlled against the corpus itself: what a text holds besides base
spans and long tokens is joined over its letters, digits and marks of the alphabets, and cut for each length
band into windows, side by side over the whole text, scored the same way. A token's
p-value is the share of its length band's windows that score as random or more so. A band
with fewer than FEW windows borrows those of the shorter bands (short text looks more
random than long text, so this is on the safe side); if there are too few still, as in a
corpus of other scripts, its tokens count as secrets where the battery doesn't reject
randomness at RATE, by the analytic chi-squared distribution of the score.
Benjamini-Hochberg over all tokens of the corpus sets one p-value limit, hence a
score limit for each length band. Counts are kept by band and score bin (at most
BANDS x BINS rows), so every document takes part and what reaches the driver is bounded.

Contract: null and empty texts have no span. Positions are code points, ends
exclusive. Rows are independent but for the score limits; repeated rows get equal
results; extra columns are ignored or kept as asked; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_in_arrow, field, materialise, slices, span_digest

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: An equals sign ends a name or pads a token; it is never a token's first character.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_-]))?")
#: Cheap linear-time filters for the texts that the rules have to read.
MAYBE = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{14}", "hex": "[0-9a-f]{16}", "token": "[A-Za-z0-9+/_-]{20}"}
KINDS = ["assign", "access", "hex", "random"]
#: Alphabets by the encoding's name, the narrowest first.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "coded": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
SETS = [(n, frozenset(a), {c: k for k, c in enumerate(a)}) for n, a in ENCODINGS.items()]
LENGTHS = (20, 28, 40, 64, 128)  # lower ends of the length bands
BANDS, BINS = len(LENGTHS), 128
#: False-discovery rate, and the score beyond which a token isn't taken for random whatever its rank: the 0.999 quantile of chi-squared at 6 degrees.
RATE, LARGEST = 0.05, 22.458
#: Windows below which a band's own distribution isn't relied on.
FEW = 200
#: Characters of the encodings, the encodings that hold each (a bit each), and each encoding's index of it.
UNCODED = bytes(c for c in range(256) if chr(c) not in ENCODINGS["coded"])
MEMBER = np.array([sum(1 << e for e, (_, alphabet, _) in enumerate(SETS) if chr(c) in alphabet) for c in range(128)], np.uint16)
INDEX = np.array([[index.get(chr(c), 0) for c in range(128)] for _, _, index in SETS], np.uint8)
#: Windows are scored in blocks of about so many characters.
BLOCK = 1 << 18
#: Places of a window's sums within one 64-bit number: of symbols, of their squares, symbols of the upper half, digits, capitals.
#: A window has at most 128 symbols of at most 66, so that no sum reaches the next one's place.
SUM, SQUARES, HIGH, DIGITS, CAPITALS = 0, 14, 34, 42, 50
#: Place of the changes between halves in the sums over neighbours; their products come before it.
CHANGES = 20


def upper_gamma_half(k2: int, x: float) -> float:
    """P(chi-squared with k2 degrees > x), by the series over half-integers."""
    if x <= 0:
        return 1.0
    h = x / 2
    if k2 % 2 == 0:
        term = total = math.exp(-h) if h < 700 else 0.0
        for i in range(1, k2 // 2):
            term *= h / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(h))
    term = math.sqrt(4 * h / math.pi) * math.exp(-h) if h < 700 else 0.0
    for i in range(1, (k2 + 1) // 2):
        total += term
        term *= h / (i + 0.5)
    return min(1.0, total)


def score(token: str) -> float:
    """Fisher's sum over the battery, in the narrowest encoding that has all of a token's characters."""
    body = token.rstrip("=")
    chars = frozenset(body)
    index = next(index for _, alphabet, index in SETS if chars <= alphabet)
    v = np.array([index[c] for c in body])
    n, k = len(v), len(index)
    # Chi-squared: symbol groups of equal width, so few that each expects several symbols.
    groups = max(2, min(8, n // 5))
    share = np.bincount(np.arange(k) * groups // k, minlength=groups) / k
    seen = np.bincount(v * groups // k, minlength=groups)
    uniform = upper_gamma_half(groups - 1, float((((seen - n * share) ** 2) / (n * share)).sum()))
    # Chi-squared: upper, lower, digits and marks in the alphabet's proportions.
    kinds = symbol_kinds(index)
    want = np.bincount(kinds, minlength=3) / k
    got, used = np.bincount(kinds[v], minlength=3), want > 0
    if used.sum() > 1:
        classes = upper_gamma_half(int(used.sum()) - 1, float((((got - n * want) ** 2)[used] / (n * want[used])).sum()))
        uniform = min(1.0, 2 * min(uniform, classes))
    # Runs about the middle of the alphabet.
    high = v >= k / 2
    above, below = int(high.sum()), int(n - high.sum())
    if above and below:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * above * below / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        run_p = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    else:
        run_p = 2.0 ** (1 - n)
    # Serial correlation at lag one.
    centred = v - v.mean()
    power = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    serial_p = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    return -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, run_p, serial_p))


def symbol_kinds(alphabet) -> np.ndarray:
    """0 for digits, 1 for capitals and marks, 2 for small letters."""
    return np.array([0 if c.isdigit() else 2 if c.islower() else 1 for c in alphabet])


def band_of(length: int) -> int:
    return max(k for k, least in enumerate(LENGTHS) if length >= least)


def bin_of(value: float) -> int:
    return min(BINS - 1, int(value * 2))


def base_spans(text: str, kinds: set[str] = frozenset(KINDS)) -> list[tuple[str, int, int]]:
    out = []
    if "assign" in kinds:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "access" in kinds:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    if "hex" in kinds:
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def meets(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether (start, end) overlaps any of the spans, which come by start; in logarithmic time."""
    starts, reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def overlaps(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k > 0 and reach[k - 1] > a

    return overlaps


def upper_gammas(k2: int, x: np.ndarray) -> np.ndarray:
    """`upper_gamma_half` of many values."""
    h = np.maximum(x, 0) / 2
    if k2 % 2 == 0:
        term = total = np.exp(-h)
        for i in range(1, k2 // 2):
            term = term * h / i
            total = total + term
    else:
        total = erfcs(np.sqrt(h))
        term = np.sqrt(4 * h / math.pi) * np.exp(-h)
        for i in range(1, (k2 + 1) // 2):
            total = total + term
            term = term * h / (i + 0.5)
    return np.minimum(1.0, total)


def erfcs(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erfc, x.tolist()), float, len(x))


@cache
def symbol_sums(encoding: int) -> np.ndarray:
    """What each symbol adds to a window's sums."""
    k = len(SETS[encoding][2])
    v, kinds = np.arange(k), symbol_kinds(SETS[encoding][2])
    return (v << SUM | v * v << SQUARES | (v >= k / 2).astype(int) << HIGH | (kinds == 0).astype(int) << DIGITS | (kinds == 1).astype(int) << CAPITALS).astype(np.uint64)


@cache
def group_sums(encoding: int, groups: int) -> np.ndarray:
    """What each symbol adds to the counts of the symbol groups, a byte each."""
    k = len(SETS[encoding][2])
    return np.uint64(1) << (np.arange(k) * groups // k * 8).astype(np.uint64)


@cache
def table(test: str, n: int, encoding: int) -> np.ndarray:
    """p-values by two counts of up to n, as far as they are known."""
    return np.full((n + 1) * (n + 1), np.nan)


def by_counts(known: np.ndarray, make: Callable[[int, int], float], n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """make(a, b) of each pair of counts, called once for each pair ever met."""
    codes = a * (n + 1) + b
    for code in np.flatnonzero(np.bincount(codes[np.isnan(known[codes])])).tolist():
        known[code] = make(*divmod(code, n + 1))
    return known[codes]


def window_scores(v: np.ndarray, encoding: int) -> np.ndarray:
    """`score` of many windows of one length in one encoding: v holds a window's symbols in each column.

    All that the tests need of a window are sums over its symbols, which are taken together as the parts of a number.
    """
    n, k = v.shape[0], len(SETS[encoding][2])
    sums = symbol_sums(encoding).take(v).sum(0)

    def part(at: int, bits: int) -> np.ndarray:
        return (sums >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)

    groups = max(2, min(8, n // 5))
    share = np.bincount(np.arange(k) * groups // k, minlength=groups) / k
    seen = group_sums(encoding, groups).take(v).sum(0).view(np.uint8).reshape(-1, 8)[:, :groups].astype(float)
    uniform = upper_gammas(groups - 1, seen**2 @ (1 / (n * share)) - n)
    want = np.bincount(symbol_kinds(SETS[encoding][2]), minlength=3) / k
    used = np.flatnonzero(want)

    def classes_p(digits: int, capitals: int) -> float:
        got = np.array([digits, capitals, n - digits - capitals])
        return upper_gamma_half(len(used) - 1, float((((got - n * want) ** 2)[used] / (n * want[used])).sum()))

    if len(used) > 1:
        classes = by_counts(table("classes", n, encoding), classes_p, n, part(DIGITS, 8), part(CAPITALS, 8))
        uniform = np.minimum(1.0, 2 * np.minimum(uniform, classes))

    def runs_p(above: int, changes: int) -> float:
        below = n - above
        if not above or not below:
            return 2.0 ** (1 - n)
        mean = 1 + 2 * above * below / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        return math.erfc(abs(1 + changes - mean) / math.sqrt(2 * var)) if var > 0 else 1.0

    high = v >= k / 2
    pairs = v[1:].astype(np.uint16) * v[:-1] + ((high[1:] != high[:-1]).astype(np.uint32) << CHANGES)
    pairs = pairs.sum(0, dtype=np.uint32).astype(np.int64)
    run_p = by_counts(table("runs", n, encoding), runs_p, n, part(HIGH, 8), pairs >> CHANGES)
    total, squares = part(SUM, 14), part(SQUARES, 20)
    mean = total / n
    power = np.where(n * squares == total * total, 0.0, squares - n * mean**2)  # exactly zero for one symbol
    product = (pairs & ((1 << CHANGES) - 1)) - mean * (2 * total - v[0] - v[-1]) + (n - 1) * mean**2
    r = np.divide(product, power, out=np.ones(len(power)), where=power > 0)
    serial_p = erfcs(np.abs(r + 1 / n) * math.sqrt(n / 2))
    return -2 * sum(np.log(np.maximum(p, 1e-300)) for p in (uniform, run_p, serial_p))


def text_windows(texts: list[str]) -> list[tuple[int, int]]:
    """(band * BINS + bin, windows) over all windows of ordinary texts (coded characters only), as the tests would see them."""
    chars = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    counts = np.zeros(BANDS * BINS, np.int64)
    for band, n in enumerate(LENGTHS):
        whole = [c[: len(c) // n * n] for c in chars if len(c) >= n]
        if not whole:
            continue
        windows = np.concatenate(whole).reshape(-1, n)
        rows = max(1, BLOCK // n)
        for first in range(0, len(windows), rows):
            block = np.ascontiguousarray(windows[first : first + rows].T)
            fits = np.bitwise_and.reduce(MEMBER.take(block), axis=0)
            for encoding in range(len(SETS)):  # the narrowest that fits
                mine = np.flatnonzero((fits & ((2 << encoding) - 1)) == 1 << encoding)
                if len(mine):
                    bins = np.minimum(BINS - 1, (window_scores(INDEX[encoding].take(block.take(mine, axis=1)), encoding) * 2).astype(np.int64))
                    counts[band * BINS : (band + 1) * BINS] += np.bincount(bins, minlength=BINS)
    return [(int(c), int(counts[c])) for c in np.flatnonzero(counts)]


def ordinary(text: str, spans: list[tuple[int, int]]) -> str:
    """The coded characters of a text outside the spans."""
    parts, done = [], 0
    for a, b in sorted(spans):
        parts.append(text[done : max(done, a)])
        done = max(done, b)
    return "".join([*parts, text[done:]]).encode("utf-8", "replace").translate(None, UNCODED).decode()


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (the id), base counts and digest, base spans, scored tokens, and the windows' bins (of a slice of texts, with its first row)."""

    def compute(texts: list[bytes]) -> list:
        column = pa.array(texts, pa.binary())
        maybe = {k: pc.match_substring_regex(column, p).to_pylist() for k, p in MAYBE.items()}
        cols: list[list] = [[] for _ in fields]
        plain = []
        for k, raw in enumerate(texts):
            kinds = {x for x in MAYBE if maybe[x][k]}
            text = raw.decode("utf-8", "replace")
            spans = base_spans(text, kinds) if kinds else []
            tokens, long_tokens = [], []
            if "token" in kinds:
                base = meets([s[1:] for s in spans])
                for m in TOKEN.finditer(text):
                    a, b = m.span()
                    long_tokens.append((a, b))
                    if not base(a, b):
                        tokens.append((a, b, band_of(b - a), bin_of(score(m[0]))))
            names = [s[0] for s in spans]
            row = [names.count("assign"), names.count("access"), names.count("hex"), span_digest(spans), [(a, KINDS.index(n), b) for n, a, b in spans], tokens, []]
            plain.append(ordinary(text, [*((s[1], s[2]) for s in spans), *long_tokens]))
            for col, x in zip(cols, row, strict=True):
                col.append(x)
        if texts:
            cols[6][0] = text_windows(plain)
        as_struct = lambda names, rows: [[dict(zip(names, t, strict=True)) for t in r] for r in rows]
        cols[4] = as_struct(("start", "kind", "end"), cols[4])
        cols[5] = as_struct(("start", "end", "band", "bin"), cols[5])
        cols[6] = as_struct(("code", "n"), cols[6])
        return cols

    long = T.LongType()
    span = T.StructType([field("start", long), field("kind", T.IntegerType()), field("end", long)])
    token = T.StructType([field("start", long), field("end", long), field("band", T.IntegerType()), field("bin", T.IntegerType())])
    windows = T.StructType([field("code", long), field("n", long)])
    fields = [field("n_assign", long), field("n_access", long), field("n_hex", long), field("base_sha256", T.StringType()), field("base_spans", T.ArrayType(span)), field("tokens", T.ArrayType(token)), field("windows", T.ArrayType(windows))]
    return append_in_arrow(docs, text_col, ["doc_id"] if keep is None else keep, fields, compute)


def limits(scanned: DataFrame, rate: float = RATE) -> list[int]:
    """For each length band, the score bin below which tokens count as secrets (Benjamini-Hochberg over all tokens)."""
    counts = {"windows": np.zeros((BANDS, BINS)), "tokens": np.zeros((BANDS, BINS))}
    codes = {"windows": (F.col("x.code"), F.sum("x.n")), "tokens": (F.col("x.band") * BINS + F.col("x.bin"), F.count(F.lit(1)))}
    for name, table in counts.items():
        code, n = codes[name]
        for code, n in scanned.select(F.explode(name).alias("x")).groupBy(code.alias("code")).agg(n).collect():  # at most BANDS * BINS rows
            table[divmod(code, BINS)] = n
    null, tokens = counts["windows"].copy(), counts["tokens"]
    for band in range(1, BANDS):
        for shorter in range(band - 1, -1, -1):
            if null[band].sum() < FEW:
                null[band] += counts["windows"][shorter]
    analytic = null.sum(1) < FEW
    p = (1 + null.cumsum(1)) / (1 + null.sum(1, keepdims=True))
    p = np.where(np.arange(BINS) / 2 <= LARGEST, p, 2.0)
    p[analytic] = 2.0
    total, found = tokens[~analytic].sum(), 0.0
    for value in np.unique(p[p <= 1])[::-1]:
        if total and value <= rate * tokens[p <= value].sum() / total:
            found = value
            break
    fits = sum(upper_gamma_half(6, (k + 1) / 2) >= rate for k in range(BINS))
    return [fits if analytic[band] else int((p[band] <= found).sum()) for band in range(BANDS)]


def all_spans(limit: list[int]) -> Column:
    """Base spans and the tokens within the limits, by start, then kind."""
    bound = F.array(*[F.lit(x) for x in limit])
    found = F.filter("tokens", lambda t: t["bin"] < F.element_at(bound, t["band"] + 1))
    extra = F.transform(found, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return F.array_sort(F.concat("base_spans", extra))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, found (start, kind, end of every span) and spans (as text)."""
    scanned = materialise(scan(docs, text_col, [id_col]), "secrets")
    found = scanned.withColumn("found", all_spans(limits(scanned, rate)))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    return found.select(id_col, "n_assign", "n_access", "n_hex", "base_sha256", "found", text.alias("spans"))


def redacted(text: str, kinds: set[str], limit: list[int], mark: str) -> str:
    """text with its base spans, and its tokens within the limits, replaced; spans that overlap count as one."""
    spans = [(a, b) for _, a, b in base_spans(text, kinds)]
    if "token" in kinds:
        base = meets(spans.copy())
        for m in TOKEN.finditer(text):
            a, b = m.span()
            if not base(a, b) and bin_of(score(m[0])) < limit[band_of(b - a)]:
                spans.append((a, b))
    out, done = [], 0
    for a, b in sorted(spans):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", rate: float = RATE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by `mark`; all columns stay, null texts stay null."""
    scanned = materialise(scan(docs, text_col, []).select("tokens", "windows"), "secrets")
    limit = limits(scanned, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part, texts in slices(batch, text_col):
                column = part.column(at)
                maybe = {k: pc.match_substring_regex(column, p).to_pylist() for k, p in MAYBE.items()}
                out = []
                for k, (valid, raw) in enumerate(zip(column.is_valid().to_pylist(), texts, strict=True)):
                    kinds = {x for x in MAYBE if maybe[x][k]}
                    text = raw.decode("utf-8", "replace") if valid else None
                    out.append(redacted(text, kinds, limit, mark) if text and kinds else text)
                cols = [pa.array(out, c.type) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
