"""Byte forms of write records, tagged messages and evolving records.

Encoders, and the decoder of records with a fixed layout, are Column expressions. Records and messages of any number of parts are decoded from
Arrow batches in one pass over their bytes. Nothing malformed is an exception: its row carries the error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codec import number, take

# Fixed values of the formats.
PLAIN = 1  # a write record whose operations all carry their value
SHARED = 2  # a write record where an operation may take the value of the one before
SHARES = 0x80  # flag on the kind of such an operation
KINDS = (0, 1, 2)  # delete, put, range delete
MAGIC = b"PEDR"  # begins a tagged message

_OP = [("pos", T.IntegerType()), ("kind", T.IntegerType()), ("seq", T.LongType()), ("key", T.BinaryType()), ("value", T.BinaryType()), ("error", T.StringType())]
_MESSAGE = [("version", T.IntegerType()), ("known", T.MapType(T.IntegerType(), T.BinaryType())), ("unknown", T.MapType(T.IntegerType(), T.BinaryType())), ("error", T.StringType())]
FLUSH = 8 << 20  # bytes of decoded parts that a task holds before it hands them on


def _little(n: Column, size: int) -> Column:
    """Hex digits of a number in `size` bytes, little endian."""
    h = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(size)])


def _framed(part: Column) -> Column:
    return F.concat(_little(F.length(part), 4), F.hex(part))


def write_record(ops: Column, share: bool = True) -> Column:
    """array of struct(kind, seq, key, value), in order -> binary. A null value is empty.

    With `share`, an operation whose value is that of the one before, and not empty, leaves it out; a record without such operations has the plain form.
    """
    value = lambda o: F.coalesce(o["value"], F.lit(b""))
    same = lambda o, i: (i > 0) & (F.length(value(o)) > 0) & F.coalesce(value(o) == value(F.get(ops, i - 1)), F.lit(False)) if share else F.lit(False)

    def one(o: Column, i: Column) -> Column:
        head = lambda flag: F.concat(_little(o["kind"] + flag, 1), _little(o["seq"], 8), _framed(o["key"]))
        return F.when(same(o, i), head(SHARES)).otherwise(F.concat(head(0), _framed(value(o))))

    shared = F.exists(F.transform(ops, same), lambda x: x)
    version = F.when(shared, F.lit(f"{SHARED:02X}")).otherwise(f"{PLAIN:02X}")
    return F.unhex(F.concat(version, _little(F.size(ops), 4), F.array_join(F.transform(ops, one), "")))


class _Bytes:
    """A place in bytes; reading past the end is an error."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise ValueError(f"cut off at byte {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(size), "little", signed=signed)

    def part(self) -> bytes:
        return self.take(self.number(4))

    def end(self) -> None:
        if self.at < len(self.data):
            raise ValueError(f"{len(self.data) - self.at} bytes behind the end")


def _ops(data: bytes) -> list[tuple]:
    r, out = _Bytes(data), []
    version = r.number(1)
    if version not in (PLAIN, SHARED):
        raise ValueError(f"unknown version {version}")
    count = r.number(4)
    if count * (13 if version == SHARED else 17) > len(data) - r.at:
        raise ValueError(f"{count} operations do not fit")
    for pos in range(count):
        tag = r.number(1)
        shares = version == SHARED and bool(tag & SHARES)
        kind = tag & ~SHARES
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        seq, key = r.number(8, signed=True), r.part()
        if shares and not out:
            raise ValueError("no value to share")
        out.append((pos, kind, seq, key, out[-1][4] if shares else r.part(), None))
    r.end()
    return out


def _message(most_known: int, data: bytes) -> list[tuple]:
    r, fields = _Bytes(data), {}
    if r.take(4) != MAGIC:
        raise ValueError("not a message")
    version = r.number(2)
    if not version:
        raise ValueError("version 0")
    for _ in range(r.number(2)):
        tag = r.number(2)
        if tag in fields:
            raise ValueError(f"field {tag} twice")
        fields[tag] = r.part()
    r.end()
    return [(version, {k: v for k, v in fields.items() if k <= most_known}, {k: v for k, v in fields.items() if k > most_known}, None)]


def _decoded(df: DataFrame, column: str, by: list[str], parse, fields: list[tuple]) -> DataFrame:
    if clash := sorted({n for n, _ in fields} & set(by)):
        raise ValueError(f"columns {clash} have names of the result")
    schema = T.StructType([df.schema[c] for c in by] + [T.StructField(n, t) for n, t in fields])
    types = pa.schema([(n, _arrow(t)) for n, t in fields])
    width = len(fields)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows, places, held = [], [], 0

            def flush(batch=batch) -> pa.RecordBatch:
                kept = batch.select(by).take(pa.array(places, pa.int64()))
                cells = [pa.array([list(r[i].items()) if isinstance(r[i], dict) else r[i] for r in rows], t) for i, t in enumerate(types.types)]
                return pa.RecordBatch.from_arrays([*kept.columns, *cells], names=[*by, *types.names])

            for place, data in enumerate(batch.column(column)):
                raw = data.as_py()
                try:
                    got = [(None,) * (width - 1) + ("null",)] if raw is None else parse(raw)
                except ValueError as e:
                    got = [(None,) * (width - 1) + (str(e),)]
                for row in got:
                    rows.append(row)
                    places.append(place)
                    held += 64 + sum(len(x) for x in row if isinstance(x, bytes))
                    if held > FLUSH:
                        yield flush()
                        rows, places, held = [], [], 0
            if rows:
                yield flush()

    return df.select(*by, column).mapInArrow(batches, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.MapType):
        return pa.map_(pa.int32(), pa.binary())
    return {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.BinaryType: pa.binary(), T.StringType: pa.string()}[type(t)]


def write_record_ops(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Records in a binary column -> (by..., pos, kind, seq, key, value, error): a row an operation.

    All of a record or nothing: one that is null, cut off, longer than its operations, or of an unknown version or kind gives a single row with
    the error. A record without operations gives no row.
    """
    return _decoded(df, column, by, _ops, _OP)


def message(version: Column, known: Column, unknown: Column) -> Column:
    """Maps of field number to bytes as a message, known fields first and each in order; null if the version is 0 or a field is in both maps."""
    entries = lambda m: F.array_join(F.transform(F.sort_array(F.map_keys(m)), lambda k: F.concat(_little(k, 2), _framed(F.element_at(m, k)))), "")
    whole = F.concat(F.hex(F.lit(MAGIC)), _little(version, 2), _little(F.size(known) + F.size(unknown), 2), entries(known), entries(unknown))
    return F.when((version > 0) & ~F.arrays_overlap(F.map_keys(known), F.map_keys(unknown)) & (F.size(known) + F.size(unknown) <= 0xFFFF), F.unhex(whole))


def message_fields(df: DataFrame, column: str, by: list[str], most_known: int) -> DataFrame:
    """Messages in a binary column -> (by..., version, known, unknown, error): fields above `most_known` are unknown and kept as they are."""
    return _decoded(df, column, by, partial(_message, most_known), _MESSAGE)


def evolving(record: Column, version: int) -> Column:
    """struct(id, key, value[, ttl_seconds]) in the first form (id in 4 bytes) or the second (id in 8, time to live, 0 for none)."""
    head = _little(record["id"], 4) if version == 1 else F.concat(_little(record["id"], 8), _little(F.coalesce(record["ttl_seconds"], F.lit(0)), 8))
    return F.unhex(F.concat(_little(F.lit(version), 2), head, _little(F.length(record["key"]), 4), _little(F.length(record["value"]), 4), F.hex(record["key"]), F.hex(record["value"])))


def evolved(data: Column) -> Column:
    """Either form as struct(id, key, value, ttl_seconds); null if it is neither, or cut off."""
    old = number(data, 1, 2, True) == 1
    pick = lambda a, b: F.when(old, a).otherwise(b)
    key_size, value_size = (pick(number(data, a, 4, True), number(data, b, 4, True)) for a, b in ((7, 19), (11, 23)))
    start = pick(F.lit(15), F.lit(27))
    key, value = take(data, start, key_size.cast("int")), take(data, (start + key_size).cast("int"), value_size.cast("int"))
    out = F.struct(
        pick(number(data, 3, 4, True), number(data, 3, 8, True).cast("long")).alias("id"), key.alias("key"), value.alias("value"),
        pick(F.lit(None), F.nullif(number(data, 11, 8, True).cast("long"), F.lit(0))).alias("ttl_seconds"),
    )
    return F.when(number(data, 1, 2, True).isin(1, 2) & key.isNotNull() & value.isNotNull(), out)
