"""Hierarchical packing of documents into training sequences of several lengths.

Each task tokenizes its own documents and packs them as they stream by, so nothing is
shuffled and no state outgrows a bounded pool:

* routing: full windows are cut off a long document; what remains goes to the pool of
  the smallest context tier that holds it;
* a long window opens with a long-tier remainder; its gap is filled from shorter tiers,
  best fit first; only when nothing fits is one piece cut to fill the gap exactly;
* when the long tier has run out, shorter tiers fill windows of their own length;
* at a task's end the remaining tokens go to windows of falling powers of two, so that
  no sequence needs padding;
* step groups: each sequence joins the open group with the fewest tokens; a group is
  closed when it holds its share. At a task's end the sequences of the open groups are dealt
  anew to as many groups as hold about a share each, so no short groups are left over.

Contract: null text is empty; an empty document still has its end token. Every token
id lies in exactly one piece. A sequence has gapless offsets from 0. sequence_id and
step_group carry the partition number in their high bits; over the same files a rerun
of a task makes the same ones. Repeated rows are packed as often as they occur. Extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import field, slices

TIERS = (4096, 1024, 256)
#: Tokens in the pools of a task beyond which windows are packed.
POOL_TOKENS = 1 << 19
#: Remembered words of a Python worker.
MOST_WORDS = 300_000
#: Tokens of a step group, and step groups open at a time.
STEP_TOKENS, OPEN_STEPS = 64 * 4096, 4


#: A run of letters that normalising leaves letter by letter once A-Z are lowered.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
#: The marks that the splitting pattern cuts off behind letters, in one piece: all but the apostrophe.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


class WordIds:
    """Token ids of texts under a tokenizer that drops white space, ignores case and never merges across
    white space or between letters and marks: words are encoded once, as a core and the marks behind it."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words that are one piece already: the same model without normalising and splitting.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes | None] = {b"": b""}  # None: not one piece
        self.marks: dict[bytes, bytes] = {b"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end = array("I", [end_id]).tobytes()

    def one_by_one(self, words: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in got]

    def pieces(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        """Learn words that are one piece each: many in one call, told apart by word ends."""
        for k in range(0, len(words), 5000):
            part = words[k : k + 5000]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
            if len(ends) != len(part):
                into.update(zip(part, self.one_by_one(part), strict=True))
                continue
            raw = ids.astype("<u4").tobytes()
            into.update(zip(part, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def learn(self, new: list[bytes]) -> None:
        cores, marks, known = self.cores, self.marks, self.known
        split = [w.rstrip(MARKS) for w in new]
        fresh = set(split).difference(cores)
        one = [c for c in fresh if c.isalpha() and c.islower() or PLAIN.fullmatch(c.decode("utf-8", "replace"))]  # of bytes: ASCII letters
        self.pieces(one, cores)
        cores.update(dict.fromkeys(fresh.difference(one)))
        tails = [w[len(c) :] for w, c in zip(new, split, strict=True)]
        self.pieces([m for m in set(tails).difference(marks) if m], marks)
        rest = []
        for w, c, m in zip(new, split, tails, strict=True):
            ids = cores[c]
            if ids is None or m and b"<|" in m:
                rest.append(w)
            else:
                known[w] = ids + marks[m]
        known.update(zip(rest, self.one_by_one(rest), strict=True))

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        """Words with A-Z lowered, so that fewer differ; but not where that could make a special token's string, nor
        in words with a combining mark (U+0300 to U+036F): the vocabulary composes before it lowers, and some letters
        compose with a mark in lower case only."""
        if b"<|" in text:
            return text.split()
        if b"\xcc" in text or b"\xcd" in text:
            return [w if b"\xcc" in w or b"\xcd" in w else w.lower() for w in text.split()]
        return text.lower().split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of every text, end id included."""
        # Words that came first are mostly the frequent ones, so they are what stays.
        for name in ("known", "cores", "marks"):
            if len(getattr(self, name)) > MOST_WORDS:
                setattr(self, name, dict(islice(getattr(self, name).items(), MOST_WORDS // 2)))
        words = list(map(self.words, texts))
        every = list(chain.from_iterable(words))
        ids = list(map(self.known.get, every))
        gaps = [k for k, x in enumerate(ids) if x is None]
        if gaps:
            self.learn(list({every[k] for k in gaps}))
            known = self.known
            for k in gaps:
                ids[k] = known[every[k]]
        out, at = [], 0
        for ws in words:
            out.append(b"".join(ids[at : at + len(ws)]) + self.end)
            at += len(ws)
        return out


_encoders: dict[tuple[str, int], WordIds] = {}


def encoder(path: str, end_id: int) -> WordIds:
    key = (path, end_id)
    if key not in _encoders:
        _encoders[key] = WordIds(path, end_id)
    return _encoders[key]


class Packer:
    """Packs (document, start, ids) pieces; `rows` gathers what is packed."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS, with_ids: bool = False):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.pools: list[list[tuple[int, int]]] = [[] for _ in self.tiers]  # (length, piece number), sorted
        self.pieces: dict[int, tuple] = {}
        self.number = self.pooled = 0
        self.pool_tokens = pool_tokens
        self.base = partition << 40
        self.sequences = 0
        self.steps: list[list] = []  # open groups: [tokens, step group, sequences]
        self.step_count = 0
        self.with_ids = with_ids
        self.rows: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        total, longest = len(ids) // 4, self.tiers[0]
        full = total - total % longest
        for start in range(0, full, longest):
            self.emit(longest, [(doc, start, ids[4 * start : 4 * (start + longest)], total)])
        if full < total:
            self.hold((doc, full, ids[4 * full :], total))
        while self.pooled > self.pool_tokens:
            self.window()

    def hold(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        tier = max(k for k, size in enumerate(self.tiers) if n <= size)
        self.number += 1
        self.pieces[self.number] = piece
        insort(self.pools[tier], (n, self.number))
        self.pooled += n

    def take(self, tier: int, at: int) -> tuple:
        n, number = self.pools[tier].pop(at)
        self.pooled -= n
        return self.pieces.pop(number)

    def window(self) -> None:
        """Fill one window of the longest tier that can be filled."""
        held = [sum(n for n, _ in pool) if len(pool) < 64 else size for pool, size in zip(self.pools, self.tiers, strict=True)]
        opens = next((k for k, size in enumerate(self.tiers) if self.pools[k] and sum(held[k:]) >= size), None)
        if opens is None:
            size = 1 << (self.pooled.bit_length() - 1)
            opens = 0
        else:
            size = self.tiers[opens]
        gap, chosen = size, []
        while gap:
            best = None
            for tier in range(opens, len(self.tiers)):
                at = bisect_right(self.pools[tier], (gap, 1 << 62)) - 1
                if at >= 0:
                    best = (tier, at)
                    break  # longer tiers first
            if best:
                piece = self.take(*best)
            else:  # nothing fits: cut the shortest of what is left
                tier = max(k for k in range(len(self.tiers)) if self.pools[k])
                doc, start, ids, total = self.take(tier, 0)
                piece = (doc, start, ids[: 4 * gap], total)
                self.hold((doc, start + gap, ids[4 * gap :], total))
            chosen.append(piece)
            gap -= len(piece[2]) // 4
        self.emit(size, chosen)

    def emit(self, size: int, chosen: list[tuple]) -> None:
        offset, pieces = 0, []
        for doc, start, ids, total in chosen:
            n = len(ids) // 4
            pieces.append((doc, start, n, zlib.crc32(ids), total, self.base + self.sequences, offset, size, ids if self.with_ids else None))
            offset += n
        self.sequences += 1
        if len(self.steps) < OPEN_STEPS:
            self.open_step()
        step = min(self.steps, key=lambda s: s[:2])
        self.deal(step, size, pieces)
        if step[0] >= STEP_TOKENS:
            self.steps.remove(step)
            self.close(step)

    def open_step(self) -> None:
        self.steps.append([0, self.base + self.step_count, []])
        self.step_count += 1

    @staticmethod
    def deal(step: list, size: int, pieces: list[tuple]) -> None:
        step[0] += size
        step[2].append((size, pieces))

    def close(self, step: list) -> None:
        self.rows += [(*p[:8], step[1], p[8]) for _, pieces in step[2] for p in pieces]

    def finish(self) -> None:
        while self.pooled:
            self.window()
        held = sorted((s for step in self.steps for s in step[2]), key=lambda s: -s[0])
        left = sum(size for size, _ in held)
        self.steps = []
        for _ in range(max(1, round(left / STEP_TOKENS)) if held else 0):
            self.open_step()
        for size, pieces in held:  # the longest first, each to the group with the fewest tokens
            self.deal(min(self.steps, key=lambda s: s[:2]), size, pieces)
        for step in self.steps:
            self.close(step)
        self.steps = []


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, with_ids: bool = False, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group and, if wanted, ids.

    `tiers` are powers of two.
    """
    kinds = {c: T.LongType() for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")}
    schema = T.StructType([docs.schema[id_col], *(field(c, k) for c, k in kinds.items())] + [field("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, words, id_type = Packer(TaskContext.get().partitionId(), tiers, with_ids=with_ids), encoder(vocabulary, end_id), None

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [[]] * 10
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:9])]
            if with_ids:
                arrays.append(pa.array([array("i", x) for x in cols[9]], pa.list_(pa.int32())))
            packer.rows = []
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            id_type = batch.column(0).type
            for part, texts in slices(batch, text_col):
                for doc, ids in zip(part.column(0).to_pylist(), words.encode(texts), strict=True):
                    packer.add(doc, ids)
                if packer.rows:
                    yield out()
        if id_type is not None:
            packer.finish()
            yield out()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


