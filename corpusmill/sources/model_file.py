"""Vocabularies as .model files of the sentencepiece format: read into rows (id, piece, score, type), and written back.

A file is a vocabulary and its settings. Reading parses the files on executors, one row a file; writing replaces the pieces and keeps the
settings of a given file, or of a byte-pair model without normalisation. A vocabulary is bounded by its size, so one file is put together by
the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import _fs

#: Fixed values of the format: kinds of pieces, fields of a model and of its settings.
KINDS = {"normal": 1, "unknown": 2, "control": 3, "user_defined": 4, "unused": 5, "byte": 6}
PIECE, TRAINER, NORMALIZER = 1, 2, 3
SCHEMA = "path string, id int, piece string, score float, type int"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field, wire type, value) of a message; what has a length, or a fixed size, is bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
            yield key >> 3, wire, value
            continue
        if wire == 2:
            size, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
        else:
            raise ValueError(f"a model holds no fields of wire type {wire}")
        if at + size > len(data):
            raise ValueError("a model ends within a field")
        yield key >> 3, wire, data[at : at + size]
        at += size


def _number(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _field(field: int, wire: int, value: bytes | int) -> bytes:
    body = _number(value) if wire == 0 else _number(len(value)) + value if wire == 2 else value
    return _number(field << 3 | wire) + body


def pieces(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) in the order of ids."""
    out = []
    for field, _, body in fields(data):
        if field == PIECE:
            own = {f: v for f, _, v in fields(body)}
            out.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, KINDS["normal"])))
    return out


def settings(data: bytes) -> bytes:
    """All of a model but its pieces."""
    return b"".join(_field(*f) for f in fields(data) if f[0] != PIECE)


def plain_settings(rows: list[tuple[str, float, int]]) -> bytes:
    """Those of a byte-pair model without normalisation, whose special pieces are where they are."""
    at = {p: i for i, (p, _, _) in enumerate(rows)}
    unknown = next((i for i, (_, _, t) in enumerate(rows) if t == KINDS["unknown"]), -1)
    places = [(40, unknown), (41, at.get("<s>", -1)), (42, at.get("</s>", -1)), (43, at.get("<pad>", -1))]
    trainer = _field(3, 0, 2) + _field(4, 0, len(rows)) + b"".join(_field(f, 0, i) for f, i in places)
    return _field(TRAINER, 2, trainer) + _field(NORMALIZER, 2, _field(1, 2, b"identity") + _field(3, 0, 1) + _field(4, 0, 1) + _field(5, 0, 1))


def model(rows: list[tuple[str, float, int]], like: bytes | None = None) -> bytes:
    """A model of pieces, in the order of ids, with the settings of another; the number of pieces among them is set anew."""
    body = b"".join(_field(PIECE, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, t)) for p, s, t in rows)
    if like is None:
        return body + plain_settings(rows)
    rest = []
    for field, wire, value in fields(settings(like)):
        if field == TRAINER:
            value = b"".join(_field(*f) for f in fields(value) if f[0] != 4) + _field(4, 0, len(rows))
        rest.append(_field(field, wire, value))
    return body + b"".join(rest)


def read_models(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, id, piece, score, type) of every piece of the files; a file that can't be read is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = pieces(data)
                columns = [[path] * len(rows), range(len(rows)), *(zip(*rows) if rows else ([], [], []))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.float32(), pa.int32()))], ["path", "id", "piece", "score", "type"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, SCHEMA)


def write_model(vocabulary: DataFrame, path: str, like: str | None = None) -> None:
    """Puts a vocabulary (id, piece, score, type) into a file, with the settings of the file `like`. Ids are 0 and on without gaps, and
    pieces don't repeat, as the format asks for."""
    spark = vocabulary.sparkSession
    rows = [(r.piece, r.score, r.type, r.id) for r in vocabulary.select(F.col("id").cast("int").alias("id"), "piece", F.col("score").cast("float").alias("score"), F.col("type").cast("int").alias("type")).orderBy("id").collect()]
    if [r[3] for r in rows] != list(range(len(rows))) or len({r[0] for r in rows}) < len(rows):
        raise ValueError("ids must be 0 and on without gaps, and pieces must not repeat")
    base = None if like is None else bytes(spark.read.format("binaryFile").load(like).first().content)
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(model([r[:3] for r in rows], base)))
    finally:
        out.close()


def kind(piece: Column) -> Column:
    """The type of a piece of a designed vocabulary: unknown, control, or normal."""
    return F.when(piece == "<unk>", KINDS["unknown"]).when(piece.isin("<s>", "</s>", "<pad>"), KINDS["control"]).otherwise(KINDS["normal"])
