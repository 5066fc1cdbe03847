"""Captures are read by pieces and written from Arrow batches, not record by record."""

import io
import struct

import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, DataSourceStreamArrowWriter

from frames import pcap_file
from netsift.sources.pcap import PIECE_BYTES, PIECE_ROWS, PcapStreamWriter, PcapWriter, _runs, iter_records, parse_header


class Counted(io.BytesIO):
    reads = 0

    def read(self, *size):
        self.reads += 1
        return super().read(*size)


def records(body, **kind):
    stream = Counted(pcap_file([], **kind) + body)
    return list(iter_records(stream, parse_header(stream.read(24)))), stream.reads


def test_files_are_read_by_pieces():
    for little in (True, False):
        rows = [(n, bytes([n % 251]) * (n % 1500)) for n in range(3000)] + [(9, b"x" * 65535), (10, b""), (11, b"y" * 65535)]
        body = pcap_file(rows, little=little)[24:]
        got, reads = records(body, little=little)
        assert [(s, d) for s, _, _, _, d in got] == rows and {u for _, u, *_ in got} == {7} and all(i == o == len(d) for _, _, i, o, d in got)
        assert reads <= len(body) // PIECE_BYTES + 3
        for cut in (1, 16, 65535, 65535 + 16, 65535 + 17):      # short data, no data, a short header, records gone
            assert len(records(body[:-cut], little=little)[0]) == len(rows) - (1 if cut < 65535 + 16 else 1 + (cut > 65535 + 16))
        bad = struct.pack(("<" if little else ">") + "IIII", 1, 1, 65536, 65536)
        assert len(records(body + bad + body, little=little)[0]) == len(rows)


def test_writers_take_arrow_batches():
    assert issubclass(PcapWriter, DataSourceArrowWriter) and issubclass(PcapStreamWriter, DataSourceStreamArrowWriter)
    n = 2 * PIECE_ROWS + 5
    rows = [{"capture_id": "a" if i < PIECE_ROWS + 7 else "b", "chunk": None if i == n - 1 else i // 1500, "packet_no": i, "ts_sec": i, "ts_usec": 7, "data": bytes([i % 251]) * (i % 40)}
            for i in range(n)]
    schema = pa.schema([("capture_id", pa.string()), ("chunk", pa.int64()), ("packet_no", pa.int64()), ("ts_sec", pa.int64()), ("ts_usec", pa.int64()), ("data", pa.binary())])
    batches = [pa.RecordBatch.from_pylist(part, schema=schema) for part in (rows[:2000], [], rows[2000:])]
    got = {}
    for *key, data in _runs(batches, ("capture_id", "chunk")):
        got[tuple(key)] = got.get(tuple(key), b"") + data
    want = {}
    for r in rows:
        want.setdefault((r["capture_id"], r["chunk"]), []).append((r["ts_sec"], r["data"]))
    assert got == {key: pcap_file(part)[24:] for key, part in want.items()}
    assert b"".join(data for _, data in _runs([b.drop_columns(["chunk"]) for b in batches], ("capture_id",))) == pcap_file([(r["ts_sec"], r["data"]) for r in rows])[24:]
