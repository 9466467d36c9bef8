"""Routing metadata as bytes and back, in bulk.

Fixed format, big-endian: version 1 as one byte; edge id with a two-byte length; device id with
a two-byte length; counter as eight bytes; schema version with a two-byte length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FIELD_BYTES = 65_535
MAX_COUNTER = 2**64 - 1
COUNTER_TYPE = "decimal(20,0)"


def _field(name: str, value: Column) -> Column:
    data = F.encode(value, "UTF-8")
    size = F.octet_length(data)
    too_long = F.raise_error(F.lit(f"{name} exceeds {MAX_FIELD_BYTES} bytes"))
    length = F.when(size <= MAX_FIELD_BYTES, F.lpad(F.hex(size), 4, "0")).otherwise(
        too_long.cast("string")
    )
    return F.concat(F.unhex(length), data)


def encode_metadata(edge: Column, device: Column, counter: Column, schema: Column) -> Column:
    """The metadata bytes; an oversized field or a counter outside u64 fails the job."""
    wide = counter.cast("decimal(38,0)")
    digits = F.when(
        (wide >= 0) & (wide <= F.lit(str(MAX_COUNTER)).cast("decimal(38,0)")),
        F.lpad(F.conv(wide.cast("string"), 10, 16), 16, "0"),
    ).otherwise(F.raise_error(F.lit("counter is outside [0, 2**64)")).cast("string"))
    return F.concat(
        F.unhex(F.lit("01")),
        _field("edge_id", edge),
        _field("device_id", device),
        F.unhex(digits),
        _field("schema_version", schema),
    )


def _slice(data: Column, start: Column, size: Column | int) -> Column:
    """``size`` bytes from the 0-based ``start``, null when the data ends before."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(
        F.octet_length(data) >= start + size, F.substring(data, start + F.lit(1), size)
    )


def _unsigned(data: Column, kind: str) -> Column:
    return F.conv(F.hex(data), 16, 10).cast(kind)


def _let(value: Column, body) -> Column:
    """``body`` of ``value`` bound to a name, so that later rewrites copy the name only."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decode_metadata(data: Column) -> Column:
    """A struct (edge_id, device_id, counter, schema_version), null for malformed bytes.

    Strict: an unknown version, a truncated field, text that is not UTF-8 or trailing bytes all
    make the value malformed. It never fails the job. Each offset rests on the length before it,
    and every length is bound once: written out in full, a filter on the result would repeat the
    inner expressions many times over.
    """

    def fields(raw: Column, edge_size: Column, device_size: Column, schema_size: Column) -> Column:
        edge = F.substring(raw, F.lit(4), edge_size).cast("string")
        device = F.substring(raw, edge_size + 6, device_size).cast("string")
        counter = F.substring(raw, edge_size + device_size + 6, F.lit(8))
        schema = F.substring(raw, edge_size + device_size + 16, schema_size).cast("string")
        # The total length rules out every truncation and every trailing byte at once.
        whole = (
            (F.octet_length(raw) == edge_size + device_size + schema_size + 15)
            & (F.substring(raw, F.lit(1), F.lit(1)) == F.unhex(F.lit("01")))
            & F.is_valid_utf8(edge)
            & F.is_valid_utf8(device)
            & F.is_valid_utf8(schema)
        )
        return F.when(
            whole,
            F.struct(
                edge.alias("edge_id"),
                device.alias("device_id"),
                _unsigned(counter, COUNTER_TYPE).alias("counter"),
                schema.alias("schema_version"),
            ),
        )

    def size_at(raw: Column, start: Column) -> Column:
        return _unsigned(_slice(raw, start, 2), "int")

    return _let(
        data,
        lambda raw: _let(
            size_at(raw, F.lit(1)),
            lambda edge: _let(
                size_at(raw, edge + 3),
                lambda device: _let(
                    size_at(raw, edge + device + 13),
                    lambda schema: fields(raw, edge, device, schema),
                ),
            ),
        ),
    )
