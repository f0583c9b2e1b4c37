"""Token ids in files: frequency ranks in byte-aligned variable length, control bytes apart.

Ids become ranks by falling frequency over all documents, so that frequent ids take one byte. Four ranks share a
control byte of four 2-bit lengths; control bytes come first, the ranks' little-endian bytes behind them, as many as each needs.
Reading looks up a control byte's lengths and places in a table of 256 rows and takes a whole block's ranks in a few numpy operations.

A folder holds `ranks` (rank to id: one block) and `blocks`. A block is a header (BLOCK: magic, number of the part and of the block,
ids of the part before it, documents, ids, bytes of data, CRC-32 of what follows), the documents' ids, null marks and
lengths, the control bytes and the data. It holds whole documents, about `block_ids` ids of them, a longer document alone. A part
is a range of document ids; `blocks_per_file` bounds the files. Writing is a Spark text job whose rows are blocks,
so it is committed and repeated like any other; the line end behind a block is skipped in reading.

Ids come from the tokenizer library. Its splitting pattern always cuts before a run of white space, and between an ASCII letter or
digit and a mark, so texts are cut into units there, and a unit that a worker knows is not encoded again. New units of
one or two pieces go through the library's model, all others through the whole library.

The documents are tokenized once into a table, counted, and range-partitioned by id: what is shuffled are their tokens. Starts are
two-level sums: within a part, counted by the writer; over the parts, of one number each.

Contract: document ids are whole numbers; rows come in ascending order of ids, null ids last, equal ids by their token ids' CRC-32
and then by place. Null texts are empty; every document has its end id, where one is given. A special token's string in a text is that token, as in the
library. Whole texts are read, one in a task's memory at a time. Extra columns are ignored; an empty table gives no blocks and an empty
table. A block that is cut off or fails its CRC-32 raises a ValueError.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import discard
from .common import append_in_arrow, field, fresh_path, materialise
from .tokencount import byte_letters

BLOCK = struct.Struct("<4sIIQIQQI")
MAGIC, RANKS = b"LTB1", b"LTR1"
BLOCK_IDS, BLOCKS_PER_FILE = 1 << 18, 256
#: Bytes of texts that are encoded at a time.
SLICE_BYTES = 8 << 20
#: Remembered units of a Python worker.
MOST_UNITS = 600_000
#: Kinds of bytes: white space of the splitting pattern, other control characters that a newer pattern may count to it, ASCII
#: letters and digits, marks (all but the apostrophe, with which contractions begin).
WHITE, CONTROL, ALNUM, MARK = 1, 2, 4, 8
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(9, 14), 32]] = WHITE
KINDS[28:32] = CONTROL
for _b in range(33, 127):
    KINDS[_b] = ALNUM if chr(_b).isalnum() else MARK * (_b != 39)
MARKS = bytes(b for b in range(128) if KINDS[b] == MARK)


def unit_starts(texts: bytes, starts: np.ndarray, has_special: bool) -> np.ndarray:
    """Places of UTF-8 texts at which no piece goes on: at the texts' starts, before a run of white space, and
    before a mark behind an ASCII letter or digit (not if that could cut a special token's string)."""
    data, kinds = np.frombuffer(texts, np.uint8), np.frombuffer(texts.translate(KINDS.tobytes()), np.uint8)
    behind = np.concatenate([[np.uint8(WHITE)], kinds[:-1]])
    cut = (kinds == WHITE) & (behind & (WHITE | CONTROL) == 0)
    if not has_special:
        cut |= (kinds == MARK) & (behind == ALNUM)
    at = np.flatnonzero(cut)
    # White space beyond ASCII: two bytes from C2, three from E1 to E3 (other characters among these are no reason to cut either).
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A)) & (one >= 0x80)
    cut[at[wide]] = False
    cut[starts] = True
    return np.flatnonzero(cut)


class UnitIds:
    """Token ids of texts under a byte-level BPE file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def piece(self, piece: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]).tobytes() if piece else b""

    def learn(self, units: list[bytes]) -> None:
        """Ids of units: of one or two pieces from the library's model, of others from the whole library."""
        known, piece, rest = self.known, self.piece, []
        for u in units:
            core = u[1:] if u[:1] == b" " else u
            if core.isalpha() or core.isdigit():
                known[u] = piece(u)
                continue
            front = u.rstrip(MARKS)
            core = front[1:] if front[:1] in (b" ", b"\n") else front
            if core.isalpha() or core.isdigit() or core and not core.isascii() and core.decode("utf-8", "replace").isalpha():
                if front[:1] == b"\n":
                    known[u] = piece(b"\n") + piece(core) + piece(u[len(front) :])
                else:
                    known[u] = piece(front) + piece(u[len(front) :])
            else:
                rest.append(u)
        if rest:
            got = self.library.encode_batch_fast([u.decode("utf-8", "replace") for u in rest], add_special_tokens=False)
            known.update((u, array("I", e.ids).tobytes()) for u, e in zip(rest, got, strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The 32-bit ids of every text. Units are told apart once a batch, so a unit costs no step of its own."""
        if len(self.known) > MOST_UNITS:  # what came first is mostly frequent
            self.known = dict(islice(self.known.items(), MOST_UNITS // 2))
        known, joined = self.known, b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        if not joined:
            return [np.empty(0, np.uint32)] * len(texts)
        special = any(x in t for x in self.special for t in texts)
        starts = unit_starts(joined, (ends - sizes)[sizes > 0], special)
        edges = np.append(starts, len(joined))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(joined)]).dictionary_encode()
        different = units.dictionary.to_pylist()
        self.learn([u for u in different if u not in known])
        ids = list(map(known.__getitem__, different))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(lengths) - lengths
        each = units.indices.to_numpy()
        n = lengths[each]
        upto = np.cumsum(n)
        out = flat[np.repeat(first[each] - (upto - n), n) + np.arange(upto[-1])]
        # Units before each text's end, then their ids.
        cuts = np.concatenate([[0], upto])[np.searchsorted(starts, ends)].tolist()
        return [out[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


_encoders: dict[str, UnitIds] = {}  # of this Python worker


def encoder(path: str) -> UnitIds:
    if path not in _encoders:
        _encoders[path] = UnitIds(path)
    return _encoders[path]


def encoded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of ranks."""
    most = int(ranks.max()) if len(ranks) else 0
    width = next(k for k in (1, 2, 3, 4) if most < 1 << 8 * k)
    extra = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    for k in range(1, width):
        extra[: len(ranks)] += ranks >= 1 << 8 * k
    codes = extra.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    kind = np.dtype({1: "<u1", 2: "<u2"}.get(width, "<u4"))
    data = ranks.astype(kind).view(np.uint8).reshape(-1, kind.itemsize)
    return control.tobytes(), data[np.arange(kind.itemsize, dtype=np.uint8) <= extra[: len(ranks), None]].tobytes()


#: By control byte: where each of its four ranks begins, the bytes of all four, and the bits that count of the 32 from there on.
_lengths = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
PLACES = (np.cumsum(_lengths, 1) - _lengths).astype(np.int64)
SIZES = _lengths.sum(1).astype(np.int64)
KEPT_BITS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)[_lengths]


def decoded(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of control bytes and data."""
    if not n:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(control, np.uint8)
    upto = np.cumsum(SIZES[codes])
    places = (PLACES[codes] + (upto - SIZES[codes])[:, None]).ravel()[:n]
    kept = KEPT_BITS[codes].ravel()[:n]
    if places[-1] + int(kept[-1]).bit_length() // 8 != len(data):
        raise ValueError("data and control bytes don't agree")
    words = np.ndarray(len(data), "<u4", data + b"\0\0\0", strides=(1,))  # the four bytes from each place on
    return words[places] & kept


def block_of(part: int, number: int, before: int, docs: list[int | None], ids: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    joined = rank_of[np.concatenate(ids)] if ids else np.empty(0, np.uint32)
    control, data = encoded(joined)
    body = b"".join([np.array([d or 0 for d in docs], "<i8").tobytes(), bytes(d is None for d in docs), np.array([len(x) for x in ids], "<u8").tobytes(), control, data])
    return BLOCK.pack(MAGIC, part, number, before, len(docs), len(joined), len(data), zlib.crc32(body)) + body


def read_blocks(content: memoryview) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(part, ids of the part before the block, document ids, their lengths, ranks) of the blocks of a file."""
    at = 0
    while at < len(content):
        if len(content) - at < BLOCK.size:
            raise ValueError(f"block at {at} is cut off")
        magic, part, _, before, n_docs, n_ids, n_data, crc = BLOCK.unpack_from(content, at)
        cuts = np.cumsum([at + BLOCK.size, 8 * n_docs, n_docs, 8 * n_docs, -(-n_ids // 4), n_data]).tolist()
        if magic != MAGIC or cuts[-1] > len(content) or zlib.crc32(content[cuts[0] : cuts[-1]]) != crc:
            raise ValueError(f"block at {at} is damaged")
        docs, nulls, sizes, control, data = (bytes(content[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
        ids = [None if gone else d for d, gone in zip(np.frombuffer(docs, "<i8").tolist(), nulls, strict=True)]
        yield part, before, ids, np.frombuffer(sizes, "<u8").astype(np.int64), decoded(control, data, n_ids)
        at = cuts[-1] + 1


def tokenized(docs: DataFrame, vocabulary: str, end_id: int | None, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(doc, row, crc, ids) of every row, written once, and the kind of number that ids are stored as."""
    from tokenizers import Tokenizer

    most = max([end_id or 0, *Tokenizer.from_file(vocabulary).get_vocab(True).values()])
    kind = "<u2" if most < 1 << 16 else "<u4"
    end = b"" if end_id is None else np.array([end_id], kind).tobytes()

    def compute(texts: list[bytes]) -> list:
        made = [x.astype(kind).tobytes() + end for x in encoder(vocabulary).encode(texts)]
        return [[zlib.crc32(x) for x in made], made]

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return materialise(append_in_arrow(rows, "text", ["doc", "row"], [field("crc", T.LongType()), field("ids", T.BinaryType())], compute, SLICE_BYTES), "tokens", "zstd"), kind


def frequency_ranks(tokens: DataFrame, kind: str) -> np.ndarray:
    """Ids that occur by falling frequency, ties by id: at most one row an entry of the vocabulary comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=len(total))
            got[: len(total)] += total
            total = got
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    counted = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counted.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, blocks_per_file: int = BLOCKS_PER_FILE) -> None:
    """Token files below `path`."""
    spark = docs.sparkSession
    tokens, kind = tokenized(docs, vocabulary, end_id, id_col, text_col)
    id_of = frequency_ranks(tokens, kind)
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 0, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # as long as the vocabulary, whatever the input

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), shared.value
        held: tuple[list, list] = ([], [])
        number = before = size = 0

        def out() -> pa.RecordBatch:
            # Text to Spark, which passes its bytes on as they are.
            return pa.RecordBatch.from_arrays([pa.array([block_of(part, number, before, *held, ranks)], pa.binary()).view(pa.string())], names=["value"])

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, kind)
                if held[0] and size + len(ids) > block_ids:
                    yield out()
                    number, before, size, held = number + 1, before + size, 0, ([], [])
                held[0].append(doc)
                held[1].append(ids)
                size += len(ids)
        if held[0]:
            yield out()

    order = [F.col("doc").asc_nulls_last(), F.col("crc"), F.col("row")]
    rows = tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "ids")
    write = lambda df: df.write.option("encoding", "ISO-8859-1").option("lineSep", "\n").option("compression", "none")
    write(rows.mapInArrow(blocks, "value string")).option("maxRecordsPerFile", blocks_per_file).text(f"{path}/blocks")
    body = id_of.astype("<u4").tobytes()
    table = spark.createDataFrame([(bytearray(RANKS + struct.pack("<II", len(id_of), zlib.crc32(body)) + body),)], "value binary")
    write(table.select(F.col("value").cast("string").alias("value"))).text(f"{path}/ranks")
    discard(tokens)


def read_ranks(spark: SparkSession, path: str) -> np.ndarray:
    """Ids by rank."""
    content = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/ranks").select("content").first()[0])
    n, crc = struct.unpack_from("<II", content, 4)
    body = content[12 : 12 + 4 * n]
    if content[:4] != RANKS or len(body) != 4 * n or zlib.crc32(body) != crc:
        raise ValueError("the ranks are damaged")
    return np.frombuffer(body, "<u4")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, part, start within the part, n_tokens, ids_crc32) of every document, and on demand `ids`, its ids as 32-bit numbers."""
    shared = spark.sparkContext.broadcast(read_ranks(spark, path))
    names = ["doc_id", "part", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part, before, docs, sizes, ranks in read_blocks(memoryview(content.as_buffer())):
                    raw = memoryview(shared.value[ranks].astype("<u4").tobytes())
                    ends = np.cumsum(sizes)
                    starts = ends - sizes
                    pieces = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    cols = [docs, np.full(len(docs), part), starts + before, sizes, [zlib.crc32(p) for p in pieces]] + [[bytes(p) for p in pieces]] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    schema = T.StructType([field(c, T.BinaryType() if c == "ids" else T.LongType()) for c in names])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/blocks").select("content")
    return files.mapInArrow(read, schema)


def with_starts(rows: DataFrame) -> DataFrame:
    """rows of `read_tokens` with starts over all parts."""
    parts = rows.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("size"))
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    parts = parts.select("part", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    return rows.join(parts, "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every row, from files that were written into the shared folder."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, vocabulary, end_id, id_col, text_col, block_ids)
    rows = materialise(read_tokens(docs.sparkSession, path), "token-index")
    return with_starts(rows).select(F.col("doc_id").alias(id_col), "start", "n_tokens", "ids_crc32")
