"""WARC archives and their index: write, read back, merge by URL key and time.

Writing is one Spark text job. Each record is a gzip member of its own; members are joined to
blocks of about BLOCK_BYTES, a row is a block, and a file has at most BLOCKS of them, so an
archive is bounded by its bytes (a longer record is a block alone). The line separator that the text
writer puts behind a row is an empty gzip member, so every part file is a valid archive, in
which a record can be read from its offset alone. Payloads that occur again become
revisit records of the response with the largest id.

Reading opens each archive in the task that owns it, one member at a time, checks lengths and
digests, and makes a run of index entries sorted by URL key, time and id; offset and
length are those of the stored member. Entries are range-partitioned by the same key - split
points come from Spark's sample, and as time and id belong to the key a URL captured very often
is spread like any other. Each partition merges externally: RUN_ROWS entries at a time, the sorted
stretches that have arrived are merged by a loser tree into a run on the task's disk, runs are merged FAN_IN at
a time, and the last merge streams out; memory is bounded whatever the partition holds. A
URL's captures are numbered over all partitions. Partition after partition, the result is in global order.

Contract: a null payload is empty, a null URL has the empty key and no target header;
line breaks in URLs are percent-encoded. A page's date is `EPOCH` plus its id in
seconds (0 for a null id). A row with a null id whose payload a row with an id has too is a revisit of the
largest such id; payloads of null ids alone are all responses, for want of an id to refer to. Rows with
the same id and payload are equal captures: the first is the
response only where the id is the largest of its payload, and then all rows with it are
responses. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, fresh_path, materialise

EPOCH = "2024-01-01T00:00:00Z"
#: Compressed bytes of a block of records, and blocks of an archive file.
BLOCK_BYTES, BLOCKS = 2 << 20, 16
#: Entries of a run that a task merges in memory, and runs that are merged at a time.
RUN_ROWS, FAN_IN = 50_000, 64
END = "\r\n\r\n"


def zipped(data: bytes) -> bytes:
    """A gzip member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


EMPTY_MEMBER = zipped(b"")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: 5 hexadecimal digits are 4 base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is set where another row holds the payload."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    shared = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialise(shared.select("digest", "first"), "payloads")
    # A skewed join: Spark splits the partitions of payloads that very many rows share.
    joined = rows.join(shared, "digest", "left")
    return joined.select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(id_type: str) -> Column:
    """A whole WARC record without its end mark."""
    lines = lambda *x: F.concat_ws("\r\n", *x)
    urn = lambda c: F.concat(F.lit("<urn:capture:"), c.cast("string"), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + (F.coalesce(F.col("id").cast("long"), F.lit(0)) if id_type == "bigint" else F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    again = F.col("refers_to").isNotNull()
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    body = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    head = lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.coalesce(F.col("id").cast("string"), F.lit("-")))),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    return F.concat(head, F.lit(END), body)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as gzip members, joined to blocks."""
    held: list[bytes] = []
    size = 0

    def out() -> pa.RecordBatch:
        # Text to Spark, which passes its bytes on as they are.
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary()).view(pa.string())], names=["value"])

    for batch in batches:
        for text in batch.column(0):
            member = zipped(text.as_py().encode() + END.encode())
            if held and size + len(member) > BLOCK_BYTES:
                yield out()
                held, size = [], 0
            held.append(member)
            size += len(member)
    if held:
        yield out()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    """WARC files below `path`. Ids are whole numbers for dates to follow them."""
    rows = with_revisits(pages, id_col, url_col, payload_col, least)
    made = rows.select(record(dict(rows.dtypes)["id"]).alias("value")).mapInArrow(blocks, "value string")
    made.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("compression", "none").option("maxRecordsPerFile", BLOCKS).text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, scheme, www and fragment dropped, query parameters sorted."""
    try:
        at = urlsplit(url)
        host = (at.hostname or "").removeprefix("www.")
        port = f":{at.port}" if at.port and at.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    query = "&".join(sorted(at.query.split("&"))) if at.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(at.path or '/').lower()}{'?' + query.lower() if query else ''}"


def members(data: memoryview, window: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that isn't empty, one at a time."""
    at = 0
    while at < len(data):
        unzip, parts, end = zlib.decompressobj(31), [], at
        while not unzip.eof:
            if end == len(data):
                raise ValueError(f"member at {at} is cut off")
            part = data[end : end + window]
            parts.append(unzip.decompress(part))
            end += len(part)
        end -= len(unzip.unused_data)
        content = b"".join(parts)
        if content:
            yield at, end - at, content
        at = end


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head_end = content.index(b"\r\n\r\n")
    first, *lines = content[:head_end].decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no record in a member")
    head = dict(x.split(": ", 1) for x in lines)
    end = head_end + 4 + int(head["Content-Length"])
    if content[end:] != b"\r\n\r\n":
        raise ValueError(f"{head['WARC-Record-ID']} has a wrong length")
    return head, content[head_end + 4 : end]


def entry(offset: int, length: int, head: dict[str, str], block: bytes, run: str) -> tuple:
    """An index entry; digests of responses are checked against their payloads."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{head['WARC-Record-ID']}: payload doesn't match its digest")
    name = lambda x: None if x in (None, "<urn:capture:->") else x[len("<urn:capture:") : -1]
    return (url_key(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else "", head["WARC-Date"], name(head["WARC-Record-ID"]), size, digest, kind, name(head.get("WARC-Refers-To")), run, offset, length)


COLUMNS = ["url_key", "date", "id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"]


def order_of(e: tuple) -> tuple:
    """Entries sort by URL key, time, id and place."""
    return (e[0].encode(), e[1], int(e[2]) if e[2] and e[2].lstrip("-").isdigit() else -1, e[7], e[8])


def index_runs(path: str, spark) -> DataFrame:
    """Index entries of all archives below path; each archive's entries are one sorted run."""
    longs = {"payload_bytes", "offset", "length"}
    schema = T.StructType([field(c, T.LongType() if c in longs else T.StringType()) for c in COLUMNS])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                run = sorted((entry(at, n, *parsed(content), name) for at, n, content in members(memoryview(data.as_buffer()))), key=order_of)
                for k in range(0, len(run), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in longs else pa.string()) for n, c in zip(COLUMNS, zip(*run[k : k + 10_000], strict=True), strict=True)], names=COLUMNS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1), "content").mapInArrow(read, schema)


def loser_tree(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs of (key, entry): inner nodes keep the loser of their last match, so an output costs one path to the root."""
    k = len(runs)
    sources = [iter(r) for r in runs]
    heads = [next(s, None) for s in sources]
    beats = lambda a, b: heads[a] is not None and (heads[b] is None or (heads[a][0], a) < (heads[b][0], b))
    losers = [-1] * k  # node 0 holds the winner
    for leaf in range(k):
        node, winner = (leaf + k) // 2, leaf
        while node:
            if losers[node] < 0:
                losers[node] = winner
                break
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        else:
            losers[0] = winner
    while k and heads[losers[0]] is not None:
        winner = losers[0]
        yield heads[winner][1]
        heads[winner] = next(sources[winner], None)
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner


class Runs:
    """Sorts entries of any number in bounded memory: sorted runs on disk, merged by loser trees."""

    def __init__(self) -> None:
        self.held: list[list[tuple]] = []  # stretches of entries in ascending order
        self.rows = 0
        self.last: tuple | None = None
        self.files: list = []

    def add(self, e: tuple) -> None:
        key = order_of(e)
        if self.last is None or key < self.last:
            self.held.append([])
        self.held[-1].append((key, e))
        self.last = key
        self.rows += 1
        if self.rows >= RUN_ROWS:
            self.spill(self.held)
            self.held, self.rows, self.last = [], 0, None

    def spill(self, runs: list[Iterable[tuple]]) -> None:
        """Merge runs to one in a file that has no name and is gone with the task."""
        file = tempfile.TemporaryFile()
        chunk = []
        for e in loser_tree(runs):
            chunk.append(e)
            if len(chunk) == 1000:
                pickle.dump(chunk, file)
                chunk = []
        pickle.dump(chunk, file)
        self.files.append(file)

    @staticmethod
    def stored(file) -> Iterator[tuple]:
        file.seek(0)
        while True:
            try:
                chunk = pickle.load(file)
            except EOFError:
                file.close()
                return
            for e in chunk:
                yield order_of(e), e

    def merged(self) -> Iterator[tuple]:
        while len(self.files) >= FAN_IN:
            some, self.files = self.files[:FAN_IN], self.files[FAN_IN:]
            self.spill([self.stored(f) for f in some])
        yield from loser_tree([*map(self.stored, self.files), *self.held])


def merged_index(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """All entries in global order, with capture_no, a capture's place in its URL's whole history.

    Partitions count their stretches of a history; two rows a partition, the captures of its
    first and of its last key, tell how many captures of a key lie in the partitions before.
    """
    spark = runs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = runs.withColumn("__id", F.expr("try_cast(id as bigint)")).repartitionByRange(n, "url_key", "date", F.coalesce("__id", F.lit(-1)), "archive", "offset").drop("__id")
    schema = T.StructType([*runs.schema.fields, field("capture_no", T.LongType()), field("__part", T.LongType()), field("__seq", T.LongType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        here = Runs()
        for batch in batches:
            for e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here.add(e)
        out, last, count = [], None, 0
        for seq, e in enumerate(here.merged()):
            count = count + 1 if e[0] == last else 1
            last = e[0]
            out.append((*e, count, part, seq))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), target, strict=True)], schema=target)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    longs = {"payload_bytes", "offset", "length", "capture_no", "__part", "__seq"}
    target = pa.schema([(f.name, pa.int64() if f.name in longs else pa.string()) for f in schema])
    merged = materialise(spread.mapInArrow(merge, schema), "merged")
    ends = merged.groupBy("__part").agg(F.min_by("url_key", "__seq").alias("low"), F.max_by("url_key", "__seq").alias("high"), F.max_by("capture_no", "__seq").alias("n"))
    both = ends.select("__part", F.explode(F.array(F.struct(F.col("high").alias("url_key"), "n"), F.struct(F.col("low").alias("url_key"), F.lit(0).cast("long").alias("n")))).alias("x")).select("__part", "x.*")
    earlier = Window.partitionBy("url_key").orderBy("__part").rangeBetween(Window.unboundedPreceding, -1)
    before = both.withColumn("before", F.sum("n").over(earlier)).filter("before > 0").select("__part", "url_key", "before").distinct()
    whole = merged.join(F.broadcast(before), ["__part", "url_key"], "left").withColumn("capture_no", F.col("capture_no") + F.coalesce("before", F.lit(0)))
    return whole.repartitionByRange(n, "__part", "__seq").sortWithinPartitions("__part", "__seq").select(*runs.columns, "capture_no")


def capture_histories(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write pages as WARC archives into the shared folder, read them back, and give the merged index; ids as in the input."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, least)
    index = merged_index(index_runs(path, spark))
    kind = pages.schema[id_col].dataType
    rest = [c for c in index.columns if c not in ("id", "refers_to", id_col)]
    return index.select(F.col("id").cast(kind).alias(id_col), F.col("refers_to").cast(kind).alias("refers_to"), *rest)
