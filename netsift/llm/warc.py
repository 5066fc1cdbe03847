"""WARC archives: written by Spark's text writer, read back in byte ranges.

Writing: a record's text is built in SQL and the writer ends each with the two
line ends that close a WARC record, so archives are plain (not compressed) WARC
files on any store, under Spark's commit. A response record is an HTTP message,
whose body is the payload; a revisit names its profile and has no block. Pages with equal payloads of at least
``MIN_REVISIT`` bytes are written once, as the response with the smallest
page_id; the others are revisits that refer to it.

Reading, by boundary-chain verification: tasks take byte ranges of the archives
and emit each place where a record could start with the place where the next
would (candidate, successor); candidates within a range are chained there, so a
range gives for each candidate the place at which its chain leaves the range.
Pointer jumping from each file's start over those exits, doubling each round,
leaves only what is reachable: a record's magic inside a payload is not. Each
range then reads its reachable records, payloads included.

Defined results: null html is an empty payload; a null page_id or url leaves its
header out (read as null); line ends in a url are written as %0D and %0A; equal
page_ids with equal payloads: one is the response, the others revisit it. A url
of more than MAX_URL bytes leaves its header out; a record whose header has more
than MAX_HEADER bytes isn't read. Payloads may hold anything, magics included: a
candidate's header is read to its first line that isn't one. A file
that is cut or damaged gives the records up to there. An empty folder or table
gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm.common import stored, with_row_id
from netsift.session import scratch_path

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
MIN_REVISIT = 100
RANGE = 8 << 20
HEAD = 1 << 16  # header bytes read at a time
MAX_HEADER, MAX_URL = 1 << 20, 1 << 16
HTTP = "application/http; msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
PATH = "file string, size long, no long, low long, high long"


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _urn(rid: Column) -> Column:
    return F.concat(F.lit("<urn:page-record:"), rid.cast("string"), F.lit(">"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` (page_id, url, html), a table scan."""
    pages, rid = with_row_id(pages.select("page_id", "url", "html"))
    pages = pages.withColumnsRenamed({rid: "rid"})
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = stored(pages.select("rid", "page_id", F.octet_length(body).alias("n"), F.sha2(body, 256).alias("digest")), "page-digests")
    # One row for each payload that occurs more than once.
    first = (slim.where(F.col("n") >= MIN_REVISIT).groupBy("digest")
             .agg(F.min_by("rid", F.struct(F.col("page_id").isNull(), "page_id", "rid")).alias("first"), F.count(F.lit(1)).alias("c"))
             .where(F.col("c") > 1).select("digest", "first"))
    again = stored(slim.join(stored(first, "page-firsts"), "digest").where(F.col("rid") != F.col("first")).select("rid", "first"), "revisits")
    met = pages.join(again, "rid", "left")
    old = F.col("first").isNotNull()
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    url = F.when(F.octet_length(url) <= MAX_URL, url)
    message = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                       F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    text = F.concat(
        F.lit(MAGIC), _line("WARC-Type", F.when(old, "revisit").otherwise("response")), _line("WARC-Record-ID", _urn(F.col("rid"))),
        _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", url), _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(body, 256))),
        _line("WARC-Refers-To", F.when(old, _urn(F.col("first")))),
        _line("WARC-Profile", F.when(old, F.lit(PROFILE))),
        _line("Content-Type", F.when(~old, F.lit(HTTP))),
        _line("Content-Length", F.when(old, 0).otherwise(F.octet_length(message) + F.octet_length(body))), F.lit("\r\n"),
        F.when(old, F.lit("")).otherwise(F.concat(message, F.coalesce("html", F.lit("")))))
    met.select(text.alias("value")).write.option("lineSep", END).text(path)


def _open(path: str):
    """A file on whatever store: local and mounted folders by name, others by Arrow."""
    if re.match(r"file:/*|/", path):
        return open("/" + re.sub(r"^(file:)?/*", "", path), "rb")
    import pyarrow.fs as fs
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _header(data: bytearray, at: int):
    """(header fields, their end) of a record at ``at``; None if the header isn't
    whole, False if it isn't a record's. Read line by line: a line without a colon,
    as another record's first one is, ends it."""
    fields, pos, stop = {}, at + len(MAGIC), at + MAX_HEADER
    while True:
        end = data.find(b"\r\n", pos, stop)
        if end < 0:
            return False if len(data) >= stop else None
        if end == pos:
            break
        name, colon, value = data[pos:end].partition(b":")
        if not colon:
            return False
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        pos = end + 2
    n = fields.get("content-length", "")
    return (fields, pos + 2) if n.isdecimal() and "warc-type" in fields else False


def _payload(fields: dict, block: bytes) -> bytes:
    """A record's payload: the body of an HTTP message, else the whole block."""
    head = block.find(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else -1
    return block if head < 0 else block[head + 4:]


def _candidates(data: bytearray, n: int, more):
    """(offset, successor) of each candidate that starts in the first ``n``
    bytes; ``more`` gives the bytes that follow ``data``."""
    magic = MAGIC.encode()
    at = data.find(magic, 0, n + len(magic) - 1)
    while at >= 0:
        got = _header(data, at)
        while got is None:
            rest = more()
            if not rest:
                got = False
                break
            data += rest
            got = _header(data, at)
        if got:
            yield at, got[1] + int(got[0]["content-length"]) + len(END)
        at = data.find(magic, at + 1, n + len(magic) - 1)


def _scan(batches):
    for batch in batches:
        for file, size, no, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            with _open(file) as f:
                f.seek(low)
                data = bytearray(f.read(high - low + HEAD))
                found = [(low + a, low + s) for a, s in _candidates(data, high - low, lambda: f.read(HEAD))]
            exits = {}
            for at, to in reversed(found):  # a chain that meets no candidate within the range ends
                exits[at] = to if to >= high else exits.get(to)
            rows = [(at, to, exits[at]) for at, to in found]
            yield pa.RecordBatch.from_arrays([
                pa.array([file] * len(rows), pa.string()), pa.array([size] * len(rows), pa.int64()), pa.array([no] * len(rows), pa.int64()),
                *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], [])))],
                ["file", "size", "no", "offset", "successor", "exit"])


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(F.col("path").alias("file"), F.col("length").alias("size")).where(F.col("size") > 0))
    return (files.select("file", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / size))).alias("no"))
            .select("file", "size", "no", (F.col("no") * size).alias("low"), F.least((F.col("no") + 1) * size, "size").alias("high")))


def _dealt(ranges: DataFrame) -> DataFrame:
    """A range for each task, about."""
    n = ranges.count()
    return ranges.repartition(max(1, min(n, 100_000)))


def entries(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, size, no, low, high, entry): where in each byte range the first
    record that is reachable from the file's start begins."""
    ranges = stored(_ranges(spark, path, size), "ranges")
    found = stored(_dealt(ranges).mapInArrow(_scan, "file string, size long, no long, offset long, successor long, exit long"), "candidates")
    # Only chains that a chain before leads to matter, and those at a file's start.
    jump = found.select("file", "offset", F.col("exit").alias("to"))
    led = jump.select("file", F.col("to").alias("offset")).where(F.col("offset").isNotNull()).distinct()
    reach = jump.where(F.col("offset") == 0).select("file", "offset")
    jump = stored(jump.join(led, ["file", "offset"], "left_semi").unionByName(jump.where(F.col("offset") == 0)), "jump")
    reach = stored(reach, "reach")
    rounds = (ranges.agg(F.max("no")).first()[0] or 0).bit_length()  # a file's chain has at most a jump for each range
    for _ in range(rounds):
        ahead = reach.join(jump.where(F.col("to").isNotNull()), ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reach = stored(reach.unionByName(ahead).distinct(), "reach")
        far = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("next"))
        jump = stored(jump.join(far, ["file", "to"]).select("file", "offset", F.col("next").alias("to")), "jump")
    at = reach.withColumn("no", F.floor(F.col("offset") / size))
    return stored(ranges.join(at, ["file", "no"]).select("file", "size", "no", "low", "high", F.col("offset").alias("entry")), "entries")


def _records(batches):
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("header", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
    for batch in batches:
        for file, size, _, _, high, at in zip(*(c.to_pylist() for c in batch.columns)):
            out, held = [], 0
            with _open(file) as f:
                while at is not None and at < high:
                    f.seek(at)
                    data, got = bytearray(f.read(1 << 12)), None
                    while (got := _header(data, 0) if data.startswith(MAGIC.encode()) else False) is None:
                        rest = f.read(HEAD)
                        if not rest:
                            got = False
                            break
                        data += rest
                    if not got:
                        break
                    n = int(got[0]["content-length"])
                    data = bytes(data[got[1]:got[1] + n])
                    if len(data) < n:
                        f.seek(at + got[1] + len(data))
                        data += f.read(n - len(data))
                    if len(data) < n:
                        break  # the file ends inside this record
                    out.append({"file": file, "offset": at, "header": list(got[0].items()), "payload": _payload(got[0], data)})
                    held += n
                    at += got[1] + n + len(END)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)


def read_warc(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, offset, header, payload) of every record of the archives under
    ``path``; header names are in lower case. Without archives there are no rows."""
    return _dealt(entries(spark, path, size)).mapInArrow(
        _records, "file string, offset long, header map<string,string>, payload binary")


def read_pages(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for each record;
    a revisit has the payload of the response it refers to. Where that response
    can't be read, it has its own digest header, and null bytes and refers_to."""
    h = lambda name: F.element_at("header", name)
    records = stored(read_warc(spark, path, size).select(
        h("warc-record-id").alias("id"), h("warc-page-id").cast("long").alias("page_id"), h("warc-type").alias("record_type"),
        h("warc-refers-to").alias("to"), F.regexp_replace(h("warc-payload-digest"), "^sha256:", "").alias("named_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest")), "records")
    old = F.col("record_type") == "revisit"
    named = records.where(~old).select(F.col("id").alias("to"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (records.where(~old).withColumn("refers_to", F.lit(None).cast("long")).select(cols)
            .unionByName(records.where(old).drop("payload_bytes", "payload_digest").join(named, "to", "left")
                         .withColumn("payload_digest", F.coalesce("payload_digest", "named_digest")).select(cols)))


def report(pages: DataFrame) -> DataFrame:
    out = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, out)
    return read_pages(pages.sparkSession, out)
