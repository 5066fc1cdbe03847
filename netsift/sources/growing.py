"""Capture files that are still being written, as a stream.

What a micro-batch takes is settled by the files' sizes when it is planned: the
stream's offset is the size of every file, and it is in the checkpoint's log. A batch
takes the records that end after a file's size in the batch before and by its size
now; a record that isn't whole yet waits for a later batch. So a repeated batch gives
the same rows, whatever was appended since, and a restart goes on at the checkpoint.

The driver sees names and sizes only. Where the last whole record of a file ended is
noted by the task that read it, in a shared folder, under the file and the size: the
next batch's task reads on from there. A note follows from the bytes alone, so a
repeated task writes the same one, and where one is missing the task walks the chain
of record headers from the file's start, which gives the same place.

The chain of records makes one file's growth the work of one task; files are spread.
It is streamed in Arrow batches of bounded size, a first batch over a long file too;
files that are complete are better read with ``read_captures(split_size=...)``.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from netsift.schema import PCAP_GLOBAL_HEADER_LEN, PCAP_MAX_RECORD_LEN, PCAP_RECORD_HEADER_LEN, RAW_PACKETS
from netsift.session import shared_path
from netsift.sources.pcap import _batches, _first_no, _fs_path, parse_header, sized_captures

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class GrownFile(InputPartition):
    def __init__(self, file: str, before: int, size: int):
        super().__init__(file)
        self.file, self.before, self.size = file, before, size


class Growth:
    """The whole records of a file from byte ``at`` on, as far as ``size``. Iterated to
    its end, it has the place and number of the next record, and whether a bad record
    or an unknown magic ended the file."""

    def __init__(self, file: str, size: int, at: int = 0, records: int = 0, ended: bool = False):
        self.file, self.size, self.at, self.records, self.ended = file, size, at, records, ended

    def read(self, with_data: bool = True):
        """(number, fields..., data) of the records; ``with_data=False`` skips over the data."""
        if self.ended or self.size < PCAP_GLOBAL_HEADER_LEN:
            return
        filesystem, p = _fs_path(self.file)
        with filesystem.open_input_file(p) as f:
            header = parse_header(f.read(PCAP_GLOBAL_HEADER_LEN))
            if header is None:
                self.ended = True
                return
            record, limit = struct.Struct(header.order + "IIII"), min(header.snaplen, PCAP_MAX_RECORD_LEN)
            self.at = max(self.at, PCAP_GLOBAL_HEADER_LEN)
            f.seek(self.at)
            while self.at + PCAP_RECORD_HEADER_LEN <= self.size:
                fields = record.unpack(f.read(PCAP_RECORD_HEADER_LEN))
                if fields[2] > limit:
                    self.ended = True
                    return
                after = self.at + PCAP_RECORD_HEADER_LEN + fields[2]
                if after > self.size:
                    return
                if with_data:
                    data = f.read(fields[2])
                else:
                    f.seek(after)
                    data = b""
                number, self.at, self.records = self.records, after, self.records + 1
                yield number, *fields, data


class Notes:
    """How far files were read, by file and size."""

    def __init__(self, path: str):
        self.path = path

    @staticmethod
    def _of(file: str) -> str:
        return hashlib.sha256(file.encode()).hexdigest()[:32]

    def growth(self, file: str, before: int, size: int) -> Growth:
        """What is left to read of a file whose first ``before`` bytes were looked at."""
        filesystem, base = _fs_path(self.path)
        try:
            with filesystem.open_input_stream(f"{base}/{self._of(file)}-{before}") as f:
                at, records, ended = map(int, f.read().split())
        except FileNotFoundError:
            first = Growth(file, before)
            for _ in first.read(with_data=False):
                pass
            at, records, ended = first.at, first.records, first.ended
        return Growth(file, size, at, records, bool(ended))

    def put(self, growth: Growth) -> None:
        filesystem, base = _fs_path(self.path)
        filesystem.create_dir(base, recursive=True)
        name = f"{base}/{self._of(growth.file)}-{growth.size}"
        temporary = f"{base}/_{uuid.uuid4().hex}"
        with filesystem.open_output_stream(temporary) as f:
            f.write(f"{growth.at} {growth.records} {int(growth.ended)}".encode())
        filesystem.move(temporary, name)

    def keep(self, sizes: dict) -> None:
        """Notes of these files at other sizes go: the next batch begins at these."""
        from pyarrow import fs as pafs
        filesystem, base = _fs_path(self.path)
        wanted = {self._of(f): str(size) for f, size in sizes.items()}
        for f in filesystem.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            of, _, size = f.base_name.partition("-")
            if wanted.get(of, size) != size:
                filesystem.delete_file(f.path)


class GrowthReader(DataSourceStreamReader):
    """A partition for each file that has grown since the batch before."""

    def __init__(self, options: dict):
        self.path, self.capture_id, self.notes = options["path"], options.get("captureId"), Notes(options["notes"])

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(sized_captures(self.path))

    def partitions(self, start: dict, end: dict):
        return [GrownFile(f, start.get(f, 0), size) for f, size in sorted(end.items()) if size > start.get(f, 0)]

    def read(self, partition: GrownFile):
        growth = self.notes.growth(partition.file, partition.before, partition.size)
        first = _first_no(partition.file, self.capture_id)
        yield from _batches((self.capture_id or partition.file, first + number, *rest) for number, *rest in growth.read())
        self.notes.put(growth)

    def commit(self, end: dict) -> None:
        self.notes.keep(end)


class GrowingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap_growing"

    def schema(self):
        return RAW_PACKETS

    def streamReader(self, schema):
        return GrowthReader(self.options)


def follow_captures(spark: SparkSession, path: str, capture_id: str | None = None, notes: str | None = None) -> DataFrame:
    """Streaming ``raw_packets`` of capture files under ``path`` that are being written:
    each record once it is whole. New files are taken up as they come.

    Numbers and ``capture_id`` are as in ``stream_captures``; a bad record ends its file,
    and so does an unknown magic, as in a batch read. Files only grow: what is put in the
    place of bytes that were read is not seen, and a file may go once it is read.
    ``notes``: a shared folder for how far files were read, one under
    ``spark.checkpoint.dir`` if not given."""
    spark.dataSource.register(GrowingSource)
    notes = notes or shared_path(spark, "netsift", "growing", hashlib.sha256(path.encode()).hexdigest()[:16])
    stream = spark.readStream.format("pcap_growing").option("path", path).option("notes", notes)
    return (stream.option("captureId", capture_id) if capture_id else stream).load()
