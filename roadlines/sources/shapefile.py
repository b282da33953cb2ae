"""Line shapefiles as a Spark data source: spark.read.format("shp_lines").load(path).

The record index (.shx) gives the byte range of every record, so the file splits into record
ranges that executors decode on their own. Files are opened through Arrow's file systems
(local, hdfs://, s3://), so the path has to be visible to all executors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import (
    ArrayType, DoubleType, StringType, StructField, StructType,
)

# Fixed values of the public shapefile layout.
LINE_SHAPES = (3, 13, 23)
POINT_SHAPES = (1, 11, 21)
FILE_HEADER, INDEX_ENTRY, RECORD_HEADER = 100, 8, 8
# End of fixed values.

RECORDS_PER_TASK = 50_000
RECORDS_PER_BATCH = 4_096
READ_GAP = 1 << 16  # bytes between records that are read along rather than skipped
POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])


def _open(path: str):
    from pyarrow import fs
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path.removeprefix("file:")
    return system.open_input_file(inner)


def _sibling(path: str, suffix: str) -> str:
    return path[:-4] + suffix


@dataclass
class Field:
    name: str
    offset: int
    width: int


def _table_layout(path: str) -> tuple[list[Field], int, int]:
    """Fields, header length and record length of the attribute table."""
    with _open(_sibling(path, ".dbf")) as f:
        head = f.read_at(32, 0)
        header, record = struct.unpack("<HH", head[8:12])
        body = f.read_at(header - 32, 32)
    fields, offset = [], 1
    for at in range(0, len(body) - 31, 32):
        entry = body[at:at + 32]
        if entry[0] == 0x0D:
            break
        name = entry[:11].split(b"\0", 1)[0].decode("ascii", "replace").strip()
        fields.append(Field(name, offset, entry[16]))
        offset += entry[16]
    return fields, header, record


def _encoding(path: str) -> str:
    try:
        with _open(_sibling(path, ".cpg")) as f:
            name = f.read().decode("ascii", "replace").strip()
            return name if "".encode(name) == b"" else "latin-1"
    except (OSError, LookupError):
        return "latin-1"


def _record_count(path: str) -> int:
    with _open(_sibling(path, ".shx")) as f:
        return (f.size() - FILE_HEADER) // INDEX_ENTRY


def crs_of(path: str) -> str | None:
    """RD New when the projection file says so, None when there is no projection file."""
    try:
        with _open(_sibling(path, ".prj")) as f:
            text = f.read().decode("utf-8", "replace")
    except OSError:
        return None
    return "EPSG:28992 (RD New)" if "RD_New" in text or "Amersfoort" in text else "unknown"


def _record_bytes(shp, offsets: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """One read over some records, and where each one's body starts in it.

    Records lie one after the other as a rule; where they do not, each stretch without a gap is
    one read.
    """
    order = np.argsort(offsets, kind="stable")
    first, last = offsets[order], (offsets + RECORD_HEADER + sizes)[order]
    breaks = np.flatnonzero(first[1:] > np.maximum.accumulate(last)[:-1] + READ_GAP) + 1
    chunks, starts, at = [], np.empty(len(offsets), np.int64), 0
    for part in np.split(np.arange(len(order)), breaks):
        if not len(part):
            continue
        lo, hi = int(first[part[0]]), int(last[part].max())
        chunks.append(shp.read_at(hi - lo, lo))
        starts[order[part]] = first[part] - lo + RECORD_HEADER + at
        at += hi - lo
    return b"".join(chunks), starts


def _integers(data: bytes, places: np.ndarray) -> np.ndarray:
    """Little-endian 32-bit integers at byte places."""
    raw = np.frombuffer(data, np.uint8)
    return raw[places[:, None] + np.arange(4)].copy().view("<i4").ravel().astype(np.int64)


def _lines(data: bytes, starts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(line of one-part records, all parts) as Arrow arrays that share one array of points."""
    kinds = _integers(data, starts) if len(starts) else np.zeros(0, np.int64)
    lines, dots = np.isin(kinds, LINE_SHAPES), np.isin(kinds, POINT_SHAPES)
    n_parts, n_points = dots.astype(np.int64), dots.astype(np.int64)
    if lines.any():
        n_parts[lines] = _integers(data, starts[lines] + 36)
        n_points[lines] = _integers(data, starts[lines] + 40)
    at_points = np.where(dots, starts + 4, starts + 44 + 4 * n_parts)
    points = np.frombuffer(b"".join(
        data[s:s + 16 * n] for s, n in zip(at_points.tolist(), n_points.tolist(), strict=True)), "<f8").reshape(-1, 2)
    firsts = np.frombuffer(b"".join(
        (b"\0\0\0\0" if dot else data[s + 44:s + 44 + 4 * n]) if n else b""
        for s, n, dot in zip(starts.tolist(), n_parts.tolist(), dots.tolist(), strict=True)), "<i4").astype(np.int64)
    of_record = np.concatenate([[0], np.cumsum(n_points)])
    of_parts = np.concatenate([[0], np.cumsum(n_parts)])
    part_offsets = np.append(firsts + np.repeat(of_record[:-1], n_parts), of_record[-1])
    spots = pa.StructArray.from_arrays([pa.array(points[:, 0].copy()), pa.array(points[:, 1].copy())], ["x", "y"])
    parts = pa.ListArray.from_arrays(pa.array(part_offsets.astype(np.int32)), spots)
    return (pa.ListArray.from_arrays(pa.array(of_record.astype(np.int32)), spots, mask=pa.array(n_parts != 1)),
            pa.ListArray.from_arrays(pa.array(of_parts.astype(np.int32)), parts, mask=pa.array(n_parts == 0)))


def _texts(rows: bytes, width: int, f: Field, encoding: str) -> pa.Array:
    """One attribute of some records, blanks as NULL."""
    table = np.frombuffer(rows, np.uint8).reshape(-1, width)
    column = np.ascontiguousarray(table[:, f.offset:f.offset + f.width]).view(f"S{f.width}").ravel()
    values = np.char.strip(np.char.decode(column, encoding, "replace"), " \0")
    return pa.array(values, pa.string(), mask=values == "")


class RecordRange(InputPartition):
    def __init__(self, first: int, count: int) -> None:
        self.first = first
        self.count = count


class LineShapeReader(DataSourceReader):
    def __init__(self, path: str, per_task: int, schema: StructType) -> None:
        self.path = path
        self.per_task = per_task
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        total = _record_count(self.path)
        return [RecordRange(first, min(self.per_task, total - first))
                for first in range(0, total, self.per_task)] or [RecordRange(0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        fields, header, width = _table_layout(self.path)
        encoding = _encoding(self.path)
        with _open(self.path) as shp, _open(_sibling(self.path, ".shx")) as shx, \
                _open(_sibling(self.path, ".dbf")) as dbf:
            for first in range(partition.first, partition.first + partition.count,
                               RECORDS_PER_BATCH):
                n = min(RECORDS_PER_BATCH, partition.first + partition.count - first)
                if n < 1:
                    continue
                index = np.frombuffer(
                    shx.read_at(INDEX_ENTRY * n, FILE_HEADER + INDEX_ENTRY * first), ">i4")
                offsets, sizes = index[0::2].astype(np.int64) * 2, index[1::2].astype(np.int64) * 2
                data, starts = _record_bytes(shp, offsets, sizes)
                rows = dbf.read_at(width * n, header + width * first)
                columns = [_texts(rows, width, f, encoding) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, *_lines(data, starts)], names=self.schema.fieldNames())


class LineShapes(DataSource):
    """Attributes as text, `geom` (the line of a one-part record) and `geom_parts` (all parts)."""

    @classmethod
    def name(cls) -> str:
        return "shp_lines"

    def schema(self) -> StructType:
        fields, _, _ = _table_layout(self.options["path"])
        line = ArrayType(POINT)
        return StructType(
            [StructField(f.name, StringType()) for f in fields]
            + [StructField("geom", line), StructField("geom_parts", ArrayType(line))])

    def reader(self, schema: StructType) -> DataSourceReader:
        per_task = int(self.options.get("recordsPerTask", RECORDS_PER_TASK))
        return LineShapeReader(self.options["path"], per_task, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineShapes)
