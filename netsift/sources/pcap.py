"""Capture files as a Spark data source: ``spark.read.format("pcap")``.

* Batch read (A1): one input partition per capture file; each task streams its
  file record by record (never holding the whole file) and yields Arrow
  batches of ``raw_packets`` rows. ``packet_no`` is the 0-based record index.
  Reading stops at the first bad record (short header, ``incl_len`` above the
  snap length or 65535, short data); earlier records are kept.
* ``option("mode", "headers")`` (A2): one ``captures`` row per file with the
  global header fields; a file with an unknown magic gets an ``error`` and
  yields no packets.
* Write (A4): rows ``(capture_id, packet_no, ts_sec, ts_usec, data)`` are
  grouped into chunks of packet numbers; each (capture, chunk) becomes one
  little-endian capture file, ``<capture>-<hash>-chunk-<n>-<job>.pcap``, in
  capture order (the hash is of the whole capture id, so captures that share a
  base name never meet in a file). Each task writes temporary files; the
  driver's commit renames them, so a lost or retried task never leaves a partial
  file behind. Overwriting removes what was there at commit; appending adds
  files of its own.
* :func:`read_captures` with ``split_size``: huge files are read as parallel
  ranges of records. The index pass is parallel within files too
  (``record_index``) and gives each range its exact start and first record number.
* :func:`stream_captures` (A8): a folder receiving rotated capture files, found
  by Spark's own file source, whose log of seen files is in the checkpoint.

Files are opened through ``pyarrow.fs``, so local paths and cluster file
systems (HDFS, S3, GCS) work alike.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import sys
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage,
)

from netsift.schema import (
    CAPTURES, PCAP_GLOBAL_HEADER_LEN, PCAP_MAGIC, PCAP_MAGIC_SWAPPED, PCAP_MAX_RECORD_LEN,
    PCAP_RECORD_HEADER_LEN, RAW_PACKETS,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
#: Bytes that a file is read by, and rows that are written at once.
PIECE_BYTES, PIECE_ROWS = 128 << 10, 1024
OUT_SNAPLEN, OUT_LINKTYPE = 65535, 1
_GLOBAL_HEADER = struct.pack("<IHHiIII", PCAP_MAGIC, 2, 4, 0, 0, OUT_SNAPLEN, OUT_LINKTYPE)


def _fs_path(path: str):
    from pyarrow import fs
    if "://" in path and not path.startswith("file://"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path[7:] if path.startswith("file://") else path


def list_captures(path: str) -> list[str]:
    """Capture files under ``path`` (a file, a folder, or a comma list), sorted."""
    return [f for f, _ in sized_captures(path)]


def sized_captures(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of the capture files under ``path``, sorted.

    A name that exists as it stands is one path, commas included. A path that
    doesn't exist raises ``FileNotFoundError``; an empty folder has no files."""
    from pyarrow import fs as pafs

    def info_of(one):
        filesystem, p = _fs_path(one)
        return filesystem, p, filesystem.get_file_info(p)

    whole = info_of(path)[2].type != pafs.FileType.NotFound
    out: list[tuple[str, int]] = []
    for one in [path] if whole else [x.strip() for x in path.split(",")]:
        filesystem, p, info = info_of(one)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no capture file or folder: {one}")
        if info.type == pafs.FileType.File:
            out.append((one, info.size))
            continue
        for f in filesystem.get_file_info(pafs.FileSelector(p, recursive=True)):
            inside = f.path[len(p.rstrip("/")):].lstrip("/").split("/")
            if f.type == pafs.FileType.File and not any(x.startswith(("_", ".")) for x in inside):
                out.append((f.path if "://" not in one else one.rstrip("/") + f.path[len(p.rstrip("/")):], f.size))
    return sorted(out)


@dataclass
class Header:
    magic: int
    order: str            # '>' big-endian or '<' little-endian
    version_major: int
    version_minor: int
    thiszone: int
    sigfigs: int
    snaplen: int
    link_type: int


def parse_header(b: bytes) -> Header | None:
    """Global header; the magic read big-endian tells the byte order."""
    if len(b) < PCAP_GLOBAL_HEADER_LEN:
        return None
    magic = struct.unpack(">I", b[:4])[0]
    if magic == PCAP_MAGIC:
        order = ">"
    elif magic == PCAP_MAGIC_SWAPPED:
        order = "<"
    else:
        return None
    vmaj, vmin, zone, sig, snap, link = struct.unpack(order + "HHiIII", b[4:24])
    return Header(magic, order, vmaj, vmin, zone, sig, snap, link)


def iter_records(stream, header: Header):
    """(ts_sec, ts_usec, incl_len, orig_len, data) until the first bad record."""
    unpack, limit = struct.Struct(header.order + "IIII").unpack_from, min(header.snaplen, PCAP_MAX_RECORD_LEN)
    held, at = b"", 0
    while piece := stream.read(PIECE_BYTES):
        held, at = held[at:] + piece, 0
        while (start := at + PCAP_RECORD_HEADER_LEN) <= len(held):
            ts_sec, ts_usec, incl, orig = unpack(held, at)
            if incl > limit:
                return
            if start + incl > len(held):
                break
            at = start + incl
            yield ts_sec, ts_usec, incl, orig, held[start:at]


class CapturePartition(InputPartition):
    def __init__(self, path: str | None, capture_id: str | None = None):
        super().__init__(path)
        self.path, self.capture_id = path, capture_id


def _batches(rows):
    """Arrow batches of ``raw_packets`` rows, bounded by rows and bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[6])
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(zip(*held))
            held, size = [], 0
    if held:
        yield _batch(zip(*held))


def _records(path: str, capture_id: str | None, base: int = 0, start: int | None = None, count: int | None = None):
    """Rows of one file, or of the ``count`` records from byte ``start`` on."""
    filesystem, p = _fs_path(path)
    with filesystem.open_input_file(p) as f:
        header = parse_header(f.read(PCAP_GLOBAL_HEADER_LEN))
        if header is None:
            return
        if start is not None:
            f.seek(start)
        for i, (ts_sec, ts_usec, incl, orig, data) in enumerate(iter_records(f, header)):
            if i == count:
                return
            yield capture_id or path, base + i, ts_sec, ts_usec, incl, orig, data


def _header_row(path: str):
    filesystem, p = _fs_path(path)
    with filesystem.open_input_stream(p) as stream:
        hb = stream.read(PCAP_GLOBAL_HEADER_LEN)
    header = parse_header(hb)
    if header is None:
        magic = struct.unpack(">I", hb[:4])[0] if len(hb) >= 4 else None
        return (path, magic, None, None, None, None, None, None, None,
                "short file" if len(hb) < PCAP_GLOBAL_HEADER_LEN else "unknown magic")
    return (path, header.magic, header.version_major, header.version_minor, header.thiszone, header.sigfigs,
            header.snaplen, header.link_type, "big" if header.order == ">" else "little", None)


_ARROW_RAW = pa.schema([
    pa.field("capture_id", pa.string(), False), pa.field("packet_no", pa.int64(), False),
    pa.field("ts_sec", pa.int64(), False), pa.field("ts_usec", pa.int64(), False),
    pa.field("incl_len", pa.int64(), False), pa.field("orig_len", pa.int64(), False),
    pa.field("data", pa.binary(), False),
])


def _batch(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _ARROW_RAW)],
                                      schema=_ARROW_RAW)


class PcapReader(DataSourceReader):
    """Batch reader: a partition for each file; ``packet_no`` is the record index."""

    def __init__(self, options: dict):
        self.path = options.get("path") or options.get("paths")
        self.headers_only = options.get("mode", "packets") == "headers"
        self.capture_id = options.get("captureId")

    def partitions(self):
        # Spark reads a source without partitions as one that isn't named: give it one without a file.
        return [CapturePartition(p, self.capture_id) for p in list_captures(self.path)] or [CapturePartition(None)]

    def read(self, partition: CapturePartition):
        if partition.path is None:
            return
        if self.headers_only:
            yield _header_row(partition.path)
        else:
            yield from _batches(_records(partition.path, partition.capture_id, _first_no(partition.path, partition.capture_id)))


@dataclass
class WrittenFiles(WriterCommitMessage):
    moves: list


def _values(column) -> list:
    """What ``to_pylist`` gives, without an object for each value on the way."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _runs(batches, names: tuple[str, ...]):
    """The capture records of each run of rows that are equal in ``names`` (None where a column isn't there), as bytes.

    Rows stay in Arrow batches: as ``Row`` objects each would cost several times what its record does."""
    pack = struct.Struct("<IIII").pack
    for piece in (batch.slice(at, PIECE_ROWS) for batch in batches for at in range(0, batch.num_rows, PIECE_ROWS)):
        cols = {n: _values(piece.column(n)) for n in piece.schema.names if n != "packet_no"}
        keys = zip(*(cols.get(n) or itertools.repeat(None, piece.num_rows) for n in names))
        rows = zip(keys, cols["ts_sec"], cols["ts_usec"], cols["data"])
        for key, run in itertools.groupby(rows, key=lambda r: r[0]):
            yield *key, b"".join(b for _, sec, usec, data in run for b in (pack(int(sec), int(usec), len(data), len(data)), data))


class PcapWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, batches) -> WrittenFiles:
        from pyspark import TaskContext
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        filesystem, base = _fs_path(self.path)
        filesystem.create_dir(f"{base}/_temporary-{self.job}", recursive=True)
        moves, out, current = [], None, None
        try:
            for cap, chunk, records in _runs(batches, ("capture_id", "chunk")):
                if (cap, chunk) != current:
                    if out is not None:
                        out.close()
                    current = (cap, chunk)
                    label = f"part-{part:05d}" if chunk is None else f"chunk-{chunk:010d}"
                    name = f"{_safe_name(cap)}-{label}-{self.job}.pcap"
                    tmp = f"{base}/_temporary-{self.job}/{attempt}-{part:05d}-{name}"
                    out = filesystem.open_output_stream(tmp)
                    out.write(_GLOBAL_HEADER)
                    moves.append((tmp, f"{base}/{name}"))
                out.write(records)
        finally:
            if out is not None:
                out.close()
        return WrittenFiles(moves)

    def commit(self, messages) -> None:
        from pyarrow import fs as pafs
        filesystem, base = _fs_path(self.path)
        filesystem.create_dir(base, recursive=True)
        if self.overwrite:
            for f in filesystem.get_file_info(pafs.FileSelector(base)):
                if f.type == pafs.FileType.Directory and f.base_name != f"_temporary-{self.job}":
                    filesystem.delete_dir(f.path)
                elif f.type == pafs.FileType.File:
                    filesystem.delete_file(f.path)
        for m in messages:
            for tmp, final in m.moves if m is not None else ():
                filesystem.move(tmp, final)
        self._drop_temporary(filesystem, base)
        with filesystem.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        self._drop_temporary(*_fs_path(self.path))

    def _drop_temporary(self, filesystem, base: str) -> None:
        from pyarrow import fs as pafs
        tmp = f"{base}/_temporary-{self.job}"
        if filesystem.get_file_info(tmp).type == pafs.FileType.Directory:
            filesystem.delete_dir(tmp)


class PcapStreamWriter(DataSourceStreamArrowWriter):
    """Streaming sink: the files of a micro-batch appear when it commits, under names
    that carry its number, and the batch is noted under ``_batches``.

    A batch that Spark repeats after a failure is left as it is if it was noted;
    otherwise what it had moved before goes first. So each packet is there once
    over restarts. A folder belongs to one checkpoint, as the numbers are its own.
    Files hold each flow's packets in order; groups of flows follow one another."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, batches) -> WrittenFiles:
        from pyspark import TaskContext
        ctx = TaskContext.get()
        filesystem, base = _fs_path(self.path)
        tmp = f"{base}/_temporary-stream-{uuid.uuid4().hex[:12]}"
        moves, out, current = [], None, None
        try:
            for cap, records in _runs(batches, ("capture_id",)):
                if out is None or cap != current:
                    if out is not None:
                        out.close()
                    current = cap
                    name = f"{_safe_name(current)}-part-{ctx.partitionId():05d}-{len(moves):05d}"
                    if not moves:
                        filesystem.create_dir(tmp, recursive=True)
                    out = filesystem.open_output_stream(f"{tmp}/{name}")
                    out.write(_GLOBAL_HEADER)
                    moves.append((f"{tmp}/{name}", name))
                out.write(records)
        finally:
            if out is not None:
                out.close()
        return WrittenFiles(moves)

    def commit(self, messages, batchId: int) -> None:
        from pyarrow import fs as pafs
        filesystem, base = _fs_path(self.path)
        filesystem.create_dir(f"{base}/_batches", recursive=True)
        noted, ending = f"{base}/_batches/{batchId:012d}", f"-batch-{batchId:012d}.pcap"
        if filesystem.get_file_info(noted).type == pafs.FileType.NotFound:
            for f in filesystem.get_file_info(pafs.FileSelector(base)):
                if f.type == pafs.FileType.File and f.base_name.endswith(ending):
                    filesystem.delete_file(f.path)
            for tmp, name in (move for m in messages if m is not None for move in m.moves):
                filesystem.move(tmp, f"{base}/{name}{ending}")
            with filesystem.open_output_stream(noted):
                pass
        self._drop_temporary(filesystem, base)

    def abort(self, messages, batchId: int) -> None:
        self._drop_temporary(*_fs_path(self.path))

    def _drop_temporary(self, filesystem, base: str) -> None:
        """Also what lost tasks and killed runs have left: batches follow one another."""
        from pyarrow import fs as pafs
        for f in filesystem.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if f.type == pafs.FileType.Directory and f.base_name.startswith("_temporary-stream-"):
                filesystem.delete_dir(f.path)


def _safe_name(capture_id: str) -> str:
    """The base name of a capture, with a hash of the whole id."""
    name = capture_id.rstrip("/").split("/")[-1]
    if name.endswith(".pcap"):
        name = name[:-5]
    name = "".join(ch if ch.isalnum() or ch in "-_." else "_" for ch in name)[:100].lstrip("_.") or "capture"
    return f"{name}-{hashlib.sha1(capture_id.encode()).hexdigest()[:12]}"


class PcapDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self):
        return CAPTURES if self.options.get("mode") == "headers" else RAW_PACKETS

    def reader(self, schema):
        return PcapReader(self.options)

    def writer(self, schema, overwrite: bool):
        return PcapWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool):
        return PcapStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("pcap")`` available in this session."""
    spark.dataSource.register(PcapDataSource)


def read_captures(spark: SparkSession, path: str | list[str], split_size: int | None = None, capture_id: str | None = None):
    """``raw_packets`` of every capture file under ``path`` (A1), or under each of
    several paths (I6): the union of the captures, each under its own id.

    ``split_size`` (bytes): each file is indexed and read as ranges of that size,
    by as many tasks as it has ranges; rows are the same. ``capture_id`` names the
    one capture that the files are parts of; ``packet_no`` then goes on from file to
    file: the file's number times 2^32, plus the record's index."""
    if not isinstance(path, str):
        from functools import reduce
        return reduce(lambda a, b: a.unionByName(b), [read_captures(spark, p, split_size, capture_id) for p in path])
    register(spark)
    if not split_size:
        reader = spark.read.format("pcap")
        return (reader.option("captureId", capture_id) if capture_id else reader).load(path)
    from netsift.sources.record_index import range_tasks
    ranges = capture_index(spark, path, split_size)
    n = range_tasks(spark, sized_captures(path), split_size)

    def read(batches):
        for batch in batches:
            for file, start, first, count in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _batches(_records(file, capture_id, _first_no(file, capture_id) + first, start, count))
    return ranges.repartition(n).mapInArrow(read, RAW_PACKETS)


def capture_index(spark: SparkSession, path: str, split_size: int):
    """Stored table (file, start, first_no, records) of the ranges of every file."""
    from netsift.sources.record_index import record_ranges
    return record_ranges(spark, sized_captures(path), split_size)


def stream_captures(spark: SparkSession, path: str, capture_id: str | None = None, max_files: int | None = None):
    """Streaming ``raw_packets`` of a folder receiving rotated captures.

    Files are found by Spark's file source: each is read once, whatever its
    name, also after a restart, and may be deleted once it is read. Writers
    should move finished files in (names that start with ``_`` or ``.`` are
    skipped). ``capture_id`` names the capture that the files are parts of;
    ``packet_no`` then goes on from file to file: the last number in the file's
    name (0 without one) times 2^32, plus the record's index."""
    r = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))

    def read(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                file = re.sub(r"^file:/*", "/", file)
                yield from _batches(_records(file, capture_id, _first_no(file, capture_id)))
    return r.load(path).select("path").mapInArrow(read, RAW_PACKETS)


def _file_number(file: str) -> int:
    """The number of a rotated file: that of its chunk in our own files, else the last in its name."""
    name = file.rsplit("/", 1)[-1]
    own = re.search(r"-chunk-(\d{10})-[0-9a-f]{12}\.pcap$", name)
    digits = own.group(1) if own else (re.findall(r"\d+", name) or ["0"])[-1]
    return int(digits) % (1 << 31)


def _first_no(file: str, capture_id: str | None) -> int:
    """The number of a file's first record: 0, or where its file stands in the named capture."""
    return _file_number(file) << 32 if capture_id else 0


def read_capture_headers(spark: SparkSession, path: str):
    """One ``captures`` row per file under ``path`` (A2)."""
    register(spark)
    return spark.read.format("pcap").option("mode", "headers").load(path)


# Packet numbers per output chunk file of the capture sink.
CHUNK_PACKETS = 1 << 18


def chunk_of(packet_no, chunk_packets: int = CHUNK_PACKETS) -> "Column":
    from pyspark.sql import functions as F
    return F.floor(packet_no / chunk_packets).cast("bigint")


def write_captures(frames, path: str, partitioned: bool = False, chunk_packets: int = CHUNK_PACKETS,
                   mode: str = "overwrite") -> None:
    """Write ``(capture_id, packet_no, ts_sec, ts_usec, data)`` rows as capture files (A4).

    Rows are grouped into chunks of ``chunk_packets`` packet numbers, hash
    partitioned on ``(capture_id, chunk)`` and sorted; each (capture, chunk)
    becomes one file, so the files of a capture sort in capture order and a
    capture holding most of the data is spread over many tasks, as many as the
    session's shuffle settings give. ``partitioned=True``: ``frames`` already
    carries ``chunk`` and that partitioning (see :func:`write_forwarded`).
    """
    from pyspark.sql import functions as F
    register(frames.sparkSession)
    if not partitioned:
        frames = (frames.withColumn("chunk", chunk_of(F.col("packet_no"), chunk_packets))
                  .repartition("capture_id", "chunk"))
    (frames.select("capture_id", "chunk", "packet_no", "ts_sec", "ts_usec", "data")
     .sortWithinPartitions("capture_id", "chunk", "packet_no")
     .write.format("pcap").mode(mode).save(path))


def write_capture_stream(frames, path: str, checkpoint: str, **options):
    """Start writing a stream of ``(capture_id, packet_no, ts_sec, ts_usec, data)`` rows as
    capture files (A4), each packet once over restarts; returns the query."""
    register(frames.sparkSession)
    return (frames.select("capture_id", "packet_no", "ts_sec", "ts_usec", "data").writeStream.format("pcap")
            .option("path", path).option("checkpointLocation", checkpoint).options(**options).outputMode("append").start())


def order_by_number(spark: SparkSession, path: str) -> None:
    """Stamp the files under ``path`` with times in the order of their numbers, a second
    apart, so that a file stream takes parts of a capture that many tasks wrote at once
    in capture order."""
    from netsift.session import _fs
    for n, file in enumerate(sorted(list_captures(path), key=_file_number)):
        filesystem, p = _fs(spark, file)
        filesystem.setTimes(p, 1_000_000_000_000 + 1000 * n, -1)


def write_forwarded(raw, verdicts, path: str, chunk_packets: int = CHUNK_PACKETS) -> None:
    """Forwarded capture (A4) with one shuffle of frame bytes.

    Frames and FORWARD verdict keys are both hash partitioned on
    ``(capture_id, chunk)``; the semi-join on ``(capture_id, chunk,
    packet_no)`` is then satisfied by that partitioning, and the writer
    consumes it directly.
    """
    from pyspark.sql import functions as F
    keys = (verdicts.where(F.col("action") == "FORWARD").select("capture_id", "packet_no")
            .withColumn("chunk", chunk_of(F.col("packet_no"), chunk_packets)).repartition("capture_id", "chunk"))
    frames = raw.withColumn("chunk", chunk_of(F.col("packet_no"), chunk_packets)).repartition("capture_id", "chunk")
    fwd = frames.join(keys, ["capture_id", "chunk", "packet_no"], "left_semi")
    write_captures(fwd, path, partitioned=True)
