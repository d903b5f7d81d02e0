"""ESRI shapefiles (.shp with .dbf) as a Python data source and a sink.

Layouts follow the public ESRI shapefile and dBASE III descriptions. Reading gives (record, geom, f0,
f1, ...) with every attribute as text, by position; the records of a layer are one partition each
for CHUNK of them. Tasks make the bytes of a layer, and the driver writes them one piece after another.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POINT, LINE, POLYGON = 1, 3, 5
#: Attribute columns that a layer has at least; those that a file lacks are null.
FIELDS = 32
CHUNK = 50_000
#: Bytes of a text attribute; the format holds no more.
MOST_TEXT = 254
#: 16-bit words of a file, as signed ints of 32 bits count them.
MOST_WORDS = 2**31 - 1


def _stem(path: str) -> str:
    path = path.removeprefix("file://")
    return path[:-4] if path.lower().endswith((".shp", ".dbf")) else path


class DbfFile:
    def __init__(self, path: str):
        self.file = open(path, "rb")
        head = self.file.read(32)
        self.records, self.header, self.size = struct.unpack("<IHH", head[4:12])
        self.fields: list[tuple[str, int]] = []
        for _ in range((self.header - 33) // 32):
            raw = self.file.read(32)
            if raw[:1] == b"\r":
                break
            self.fields.append((raw[:11].split(b"\0")[0].decode("latin-1"), raw[16]))

    def row(self, i: int) -> list[str] | None:
        """The values of a record; None if it is marked as deleted."""
        self.file.seek(self.header + i * self.size)
        mark, raw, out, at = self.file.read(1), self.file.read(self.size - 1), [], 0
        if mark == b"*":
            return None
        for _, n in self.fields:
            out.append(raw[at : at + n].decode("utf-8", "replace").strip())
            at += n
        return out

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def _shapes(path: str, first: int, last: int) -> Iterator[list[tuple[float, float]]]:
    """Points of the records [first, last), parts of a record one after another."""
    with open(path + ".shx", "rb") as index, open(path + ".shp", "rb") as shapes:
        for i in range(first, last):
            index.seek(100 + 8 * i)
            at, size = struct.unpack(">II", index.read(8))
            shapes.seek(2 * at + 8)
            body = shapes.read(2 * size)
            (kind,) = struct.unpack("<i", body[:4])
            if kind == POINT:
                yield [struct.unpack("<dd", body[4:20])]
            elif kind in (LINE, POLYGON):
                parts, points = struct.unpack("<ii", body[36:44])
                flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
                yield list(zip(flat[::2], flat[1::2]))
            else:
                yield []


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = _stem(path)

    def partitions(self):
        for end in (".shp", ".shx", ".dbf"):
            if not os.path.exists(self.path + end):
                raise FileNotFoundError(self.path + end)
        with DbfFile(self.path + ".dbf") as table:
            n = table.records
        return [Rows(i, min(i + CHUNK, n)) for i in range(0, n, CHUNK)] or [Rows(0, 0)]

    def read(self, partition):
        with DbfFile(self.path + ".dbf") as table:
            for i, shape in zip(range(partition.first, partition.last), _shapes(self.path, partition.first, partition.last)):
                values = table.row(i)
                if values is not None:
                    yield (i, shape, *values, *[None] * (FIELDS - len(values)))


class ShapefileSource(DataSource):
    """spark.read.format("shapefile").load(path without or with .shp)"""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        with DbfFile(_stem(self.options["path"]) + ".dbf") as table:
            n = max(FIELDS, len(table.fields))
        return "record long, geom array<struct<x:double,y:double>>, " + ", ".join(f"f{i} string" for i in range(n))

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options["path"])


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile").load(path)


def write_shapefile(rows: DataFrame, path: str, geom: str = "geom", kind: int = LINE) -> int:
    """Writes rows as a layer; columns other than the geometry become attributes, in order. Returns the count.

    Tasks make the bytes of their records; the driver writes one piece after another and holds no more than a
    partition's. Rows keep their order. They are made twice, first for their number, widths and box.
    """
    names = [c for c in rows.columns if c != geom]
    kinds = [dict(rows.dtypes)[c] for c in names]
    given = rows.select(*[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(f"`{c}`") for c, k in zip(names, kinds)], geom)
    layout = _measured(given, len(names), kinds, kind)
    short = [c for c, n in zip(names, layout.widths) if n > MOST_TEXT]
    if short:
        raise ValueError(f"{short[0]} has over {MOST_TEXT} bytes: write Parquet")
    size = 1 + sum(layout.widths)
    if 50 + layout.words > MOST_WORDS or 33 + 32 * len(names) + size * layout.records > 2 * MOST_WORDS:
        raise ValueError("more than the format's files hold: write Parquet")
    path = _stem(path)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    head = lambda words: struct.pack(">IIIIIII", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<ii", 1000, kind) + struct.pack("<8d", *layout.box, 0, 0, 0, 0)
    widths, number, offset = layout.widths, 0, 50
    with open(path + ".shp", "wb") as shapes, open(path + ".shx", "wb") as index, open(path + ".dbf", "wb") as table:
        shapes.write(head(50 + layout.words))
        index.write(head(50 + 4 * layout.records))
        table.write(struct.pack("<BBBBIHH20x", 3, 124, 1, 1, layout.records, 33 + 32 * len(names), size))
        for c, told, n in zip(names, kinds, widths):
            whole, real = _number(told)
            table.write(c.upper()[:10].encode().ljust(11, b"\0") + (b"N" if whole or real else b"C") + b"\0" * 4 + bytes([n, 9 if real else 0]) + b"\0" * 14)
        table.write(b"\r")
        pieces = given.mapInArrow(lambda batches: _pieces(batches, kinds, widths, kind), "sizes binary, shapes binary, attributes binary")
        for piece in pieces.toLocalIterator():
            words = np.frombuffer(piece["sizes"], "<i8")
            at = offset + np.cumsum(words + 4) - (words + 4)
            heads = np.column_stack([at, words]).astype(">u4")
            index.write(heads.tobytes())
            heads[:, 0] = number + 1 + np.arange(len(words))
            body = np.frombuffer(piece["shapes"], np.uint8).copy()
            first = (2 * (at - offset))[:, None] + np.arange(8)
            body[first] = heads.view(np.uint8)  # the number and size that precede each record
            shapes.write(body.tobytes())
            table.write(piece["attributes"])
            number, offset = number + len(words), offset + int((words + 4).sum())
        table.write(b"\x1a")
    if number != layout.records:
        raise ValueError("the rows of the layer changed while they were written")
    return number


class _Layout(NamedTuple):
    records: int
    words: int  # 16-bit words of all records
    box: list[float]
    widths: list[int]


def _number(kind: str) -> tuple[bool, bool]:
    return kind in ("int", "bigint", "smallint", "tinyint"), kind in ("double", "float") or kind.startswith("decimal")


def _texts(values: list, kind: str) -> list[bytes]:
    whole, real = _number(kind)
    return [("" if v is None else str(v) if whole else f"{v:.9f}" if real else str(v)).encode() for v in values]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points of each record, x, y)"""
    if column.null_count:
        raise ValueError("a record without a geometry")
    points = column.flatten()
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)


def _contents(batch: pa.RecordBatch, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, first point, 16-bit words of each record, x, y) of a batch whose last column is the geometry."""
    n, x, y = _flat(batch.column(batch.num_columns - 1))
    if (n == 0).any():
        raise ValueError("a record without a point")
    return n, np.cumsum(n) - n, np.full(len(n), 10) if kind == POINT else (48 + 16 * n) // 2, x, y


def _measured(rows: DataFrame, attributes: int, kinds: list[str], kind: int) -> _Layout:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n, _, words, x, y = _contents(batch, kind)
                widths = [max(map(len, _texts(batch.column(i).to_pylist(), k))) for i, k in zip(range(attributes), kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (batch.num_rows, int((words + 4).sum()), x.min(), y.min(), x.max(), y.max(), widths)], schema=summary)

    summary = pa.schema([("records", pa.int64()), ("words", pa.int64()), *[(c, pa.float64()) for c in ("xmin", "ymin", "xmax", "ymax")], ("widths", pa.list_(pa.int32()))])
    parts = rows.mapInArrow(run, "records long, words long, xmin double, ymin double, xmax double, ymax double, widths array<int>")
    sums = parts.agg(F.sum("records"), F.sum("words"), F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax"), *[F.max(F.get("widths", F.lit(i))) for i in range(attributes)]).first()
    return _Layout(sums[0] or 0, sums[1] or 0, list(sums[2:6]) if sums[0] else [0.0] * 4, [max(10, n or 0) for n in sums[6:]])


def _pieces(batches, kinds: list[str], widths: list[int], kind: int):
    """Bytes of the records of each batch, numbers and sizes before them left blank."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n, first, words, x, y = _contents(batch, kind)
        at = 2 * (np.cumsum(words + 4) - (words + 4))
        body = np.zeros(int(2 * (words + 4).sum()), np.uint8)

        def put(where: np.ndarray, values: np.ndarray) -> None:
            raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
            body[where[:, None] + np.arange(raw.shape[1])] = raw  # noqa: B023

        put(at + 8, np.full(len(n), kind, "<i4"))
        if kind == POINT:
            put(at + 12, np.column_stack([x[first], y[first]]).astype("<f8"))
        else:
            boxes = [f.reduceat(v, first) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))]
            put(at + 12, np.column_stack(boxes).astype("<f8"))
            put(at + 44, np.column_stack([np.ones(len(n)), n, np.zeros(len(n))]).astype("<i4"))
            nth = np.arange(len(x)) - np.repeat(first, n)
            put(np.repeat(at + 56, n) + 16 * nth, np.column_stack([x, y]).astype("<f8"))
        columns = [_texts(batch.column(i).to_pylist(), k) for i, k in enumerate(kinds)]
        columns = [[t.rjust(w) if any(_number(k)) else t.ljust(w) for t in c] for c, k, w in zip(columns, kinds, widths)]
        table = b"".join(b" " + b"".join(r) for r in zip(*columns)) if columns else b" " * len(n)
        if len(table) != len(n) * (1 + sum(widths)):
            raise ValueError("the rows of the layer changed while they were written")
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (words.astype("<i8").tobytes(), body.tobytes(), table)], ["sizes", "shapes", "attributes"])


def hot_ranking(layer: DataFrame, top: int) -> DataFrame:
    """(rank, cross_id) of the first `top` records of a rank layer (RANK, INDEX, ...)."""
    return layer.where(F.col("record") < top).select(F.col("record").cast("int").alias("rank"), F.col("f1").cast("int").alias("cross_id"))
