"""Token counts by finite-state transducers.

Two compiled machines count the tokens of a byte-level BPE vocabulary without
building a token list:

* `splitter`, a deterministic transducer over character classes, marks where the
  vocabulary's splitting pattern ends one piece and begins the next. A text is cut
  into equal chunks; each chunk becomes a map from any start state to its end
  state and the pieces emitted on the way; the maps compose by parallel prefix scan;
  then all chunks are read once more from their true start states and write their
  piece starts at the places that the scan has counted out.
* `MergeTransducer`, over the bytes of a piece, carries on each transition how many
  tokens the merges of the prefix gain by that byte. A state knows, for every
  suffix that may still grow into a vocabulary entry, the last token before it and
  the count there; the last token of a prefix is the one entry ending there that is
  stable beside the last token before it. States are compiled when first reached,
  at most MOST_STATES of them at a time, also within one piece. They are too many for
  maps from every start state, so pieces, which are independent, are what is counted
  side by side; their counts add up.

Contract: null or empty text has 0 tokens. A special token's string inside a text
is one token, as the library has it. Texts are read whole; a batch of texts is one
stream with an end mark after each text. Rows are independent, so repeated rows
get equal results, an empty table gives an empty table, and extra columns of the
input are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_in_arrow, field

OTHER, APOS, SPACE, BLANK, NUM, LETTER, ONE, R_OR_V, E, L, END, SKIP = range(12)
CLASSES = 12
CHUNK = 1024
#: Compiled states and remembered pieces are dropped beyond these sizes; both are compiled anew when met again.
MOST_STATES, MOST_PIECES = 200_000, 400_000


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point for the pattern of the rank files.

    Python's Unicode tables decide, but for code points that they leave unassigned
    and a newer table calls letters or numbers; for these the library is asked.
    """
    import unicodedata

    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUM}
    unknown = []
    newer = regex.compile(r"[\p{L}\p{N}]")
    for x in [*range(0xD800), *range(0xE000, 0x110000)]:
        category = unicodedata.category(chr(x))
        if category == "Cn" and newer.match(chr(x)):
            unknown.append(x)
        else:
            table[x] = kinds.get(category[0], OTHER)
    split = ByteLevel(add_prefix_space=False)
    for before, kind in (("a", LETTER), ("1", NUM)):
        begins = {at[0] for _, at in split.pre_tokenize_str("".join(f"\n{before}{chr(x)}" for x in unknown))}
        for k, x in enumerate(unknown):
            if 3 * k + 2 not in begins:
                table[x] = kind
    # The white space of the pattern.
    for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[c] = BLANK
    for chars, kind in (("'", APOS), (" ", SPACE), ("stmd", ONE), ("rv", R_OR_V), ("e", E), ("l", L)):
        for c in chars:
            table[ord(c)] = kind
    return table


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state * CLASSES + class. Mark bit 0: a piece begins here; bit 1: one begins a character before."""
    fresh, letters, numbers, others, space, blank, spaces, blanks, apos, apos_rv, apos_l = range(11)
    letter_kinds = {LETTER, ONE, R_OR_V, E, L}
    begin = {OTHER: others, APOS: apos, SPACE: space, BLANK: blank, NUM: numbers, END: fresh} | dict.fromkeys(letter_kinds, letters)
    joined = {OTHER: others, APOS: others, NUM: numbers} | dict.fromkeys(letter_kinds, letters)
    run = {letters: letter_kinds, numbers: {NUM}, others: {OTHER, APOS}}
    step, mark = np.zeros((11, CLASSES), np.uint8), np.zeros((11, CLASSES), np.uint8)
    for s in range(11):
        for c in range(CLASSES):
            to, out = begin.get(c, s), 1
            if c == SKIP:
                to, out = s, 0
            elif s in run and c in run[s]:
                to, out = s, 0
            elif s in (space, blank, spaces, blanks) and c in (SPACE, BLANK):
                to, out = (spaces if c == SPACE else blanks), 0
            elif s == space and c in joined:
                to, out = joined[c], 0
            elif s == spaces and c in joined:
                to, out = joined[c], 2
            elif s == blanks and c != END:
                out = 3
            elif s == apos and c in (OTHER, APOS):
                to, out = others, 0
            elif s == apos and c in (ONE, R_OR_V, L):
                to, out = {ONE: fresh, R_OR_V: apos_rv, L: apos_l}[c], 0
            elif (s, c) in ((apos_rv, E), (apos_l, L)):
                to, out = fresh, 0
            elif s in (apos_rv, apos_l):
                to, out = (letters, 2) if c in letter_kinds else (to, 3)
            step[s, c], mark[s, c] = to, out
    return step.ravel(), mark.ravel()


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Where pieces begin in a stream of character classes."""
    step, mark = splitter()
    n = len(classes)
    width = max(1, -(-n // CHUNK))
    codes = np.full(width * CHUNK, SKIP, np.uint8)
    codes[:n] = classes
    codes = np.ascontiguousarray(codes.reshape(width, CHUNK).T)
    gain = np.bitwise_count(mark)
    states = np.repeat(np.arange(11, dtype=np.uint8)[:, None], width, 1)
    pieces = np.zeros(states.shape, np.int32)
    same = None  # where all start states have led to one: from here on they emit alike
    for k in range(CHUNK):  # the map of every chunk, from all states at once
        key = states * np.uint8(CLASSES) + codes[k]
        states = step[key]
        pieces += gain[key]
        if len(states) > 1 and k in (15, 79) and (states == states[0]).all():
            same, states, pieces = pieces, states[:1], np.zeros((1, width), np.int32)
    if same is not None:
        states, pieces = np.repeat(states, 11, 0), same + pieces
    pieces = pieces.astype(np.int64)
    gap = 1
    while gap < width:  # parallel prefix scan: after it, map i leads from the stream's start through chunk i
        column = np.arange(width - gap)
        pieces[:, gap:] = pieces[:, :-gap] + pieces[:, gap:][states[:, :-gap], column]
        states[:, gap:] = states[:, gap:][states[:, :-gap], column]
        gap *= 2
    at = np.zeros(width, np.uint8)
    at[1:] = states[0, :-1]
    out = np.empty_like(codes)
    for k in range(CHUNK):
        key = at * np.uint8(CLASSES) + codes[k]
        out[k] = mark[key]
        at = step[key]
    out = np.ascontiguousarray(out.T).ravel()[:n]
    begins = (out & 1).astype(bool)
    begins[:-1] |= (out[1:] & 2).astype(bool)
    starts = np.empty(int(pieces[0, -1]), np.int64)
    starts[:] = np.flatnonzero(begins)
    return starts


class MergeTransducer:
    """Counts tokens of a piece; entries and merges are those of a byte-level BPE file."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.parts = {bytes([b]): None for b in range(256)}  # entry -> the two it is merged from
        self.order = {bytes([b]): b for b in range(256)}
        for rank, (a, b) in enumerate(merges):
            self.parts.setdefault(a + b, (a, b))
            self.order.setdefault(a + b, 256 + rank)
        grows = {b""}
        for entry in self.parts:
            grows.update(entry[:k] for k in range(1, len(entry)))
        self.grows = grows  # strings that a longer entry begins with
        self.stable: dict[tuple[bytes, bytes], bool] = {}  # emptied with the states
        self.reset()

    def reset(self) -> None:
        self.stable.clear()
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self.state(((b"", None, 0),))

    def state(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        return self.ids[key]

    def holds(self, left: bytes, right: bytes) -> bool:
        """Whether two neighbouring tokens stay as they are, i.e. no merge across their border comes first."""
        key = (left, right)
        if key in self.stable:
            return self.stable[key]
        # Undo the later of the merges at the border, step by step; a merge across
        # the border takes place if it ranks before the one undone last.
        a, b, before = left, right, 1 << 40
        order, parts = self.order, self.parts
        good = True
        while True:
            across = a + b
            if across in order and parts[across] == (a, b) and order[across] < before:
                good = False
                break
            ra = order[a] if parts[a] else -1
            rb = order[b] if parts[b] else -1
            if ra < 0 and rb < 0:
                break
            # Of equal merges the leftmost comes first: one across the border comes
            # before an equal one on its right, but after an equal one on its left.
            if ra > rb:
                a, before = parts[a][1], ra
            else:
                b, before = parts[b][0], rb + 1
        self.stable[key] = good
        return good

    def build(self, at: int, byte: int) -> tuple[int, int]:
        b = bytes([byte])
        grown = [(suffix + b, last, count) for suffix, last, count in self.states[at]]  # longest first
        found = next((last, count, entry) for entry, last, count in grown if entry in self.parts and (last is None or self.holds(last, entry)))
        gain, token = found[1] + 1, found[2]
        kept = tuple((s, last, count - gain) for s, last, count in grown if s in self.grows)
        made = (self.state((*kept, (b"", token, 0))), gain)
        self.next[at][byte] = made
        return made

    def count(self, piece: bytes) -> int:
        steps, at, total = self.next, 0, 0
        for byte in piece:
            to = steps[at].get(byte)
            if to is None:
                if len(self.states) >= MOST_STATES:  # all but the state that is read from are dropped
                    key = self.states[at]
                    self.reset()
                    steps, at = self.next, self.state(key)
                to = self.build(at, byte)
            at = to[0]
            total += to[1]
        return total


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level files: printable Latin-1 for itself, the rest from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenCounter:
    def __init__(self, path: str, classes: np.ndarray):
        self.classes = classes
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.machine = MergeTransducer([(raw(a), raw(b)) for a, b in pairs])
        self.special = sorted((t["content"] for t in data.get("added_tokens", [])), key=len, reverse=True)
        self.seen: dict[str, int] = {}

    def piece(self, text: str) -> int:
        if len(self.seen) > MOST_PIECES:
            self.seen.clear()
        n = self.seen[text] = self.machine.count(text.encode())
        return n

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of every text."""
        extra = np.zeros(len(texts), np.int64)
        owner = None
        if any(s in t for s in self.special for t in texts):
            import re

            cut = re.compile("|".join(map(re.escape, self.special)))
            parts = [cut.split(t) for t in texts]
            extra = np.array([len(p) - 1 for p in parts], np.int64)
            owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
            texts = [x for p in parts for x in p]
        if not texts:
            return []
        stream = "\0".join(texts) + "\0"
        classes = self.classes[np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        classes[ends] = END
        starts = piece_starts(classes)
        bounds = starts.tolist()
        seen, new = self.seen, self.piece
        got = [seen.get(w) or new(w) for w in [stream[a:b] for a, b in zip(bounds, [*bounds[1:], len(stream)], strict=True)]]
        tokens = np.fromiter(got, np.int64, len(got))
        marks = np.searchsorted(starts, ends)
        tokens[marks] = 0
        total = np.cumsum(tokens)[marks]
        n = np.diff(total, prepend=0)
        if owner is not None:
            n = np.bincount(owner, n, len(extra)).astype(np.int64) + extra
        return n.tolist()


_counters: dict[str, TokenCounter] = {}  # of this Python worker


def counter(path: str, classes) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path, np.frombuffer(classes.value, np.uint8))
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row. `vocabulary`: a path that executors can read."""

    classes = docs.sparkSession.sparkContext.broadcast(char_classes().tobytes())  # 1.1 MB, whatever the input

    def compute(texts: list[bytes]) -> list:
        n = counter(vocabulary, classes).counts([t.decode("utf-8", "replace") for t in texts])
        return [[len(t) for t in texts], n, [x > limit for x in n]]

    fields = [field("n_bytes", T.LongType()), field("n_tokens", T.LongType()), field("over_limit", T.BooleanType())]
    return append_in_arrow(docs, text_col, [id_col], fields, compute, 1 << 20)
