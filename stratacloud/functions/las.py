"""Point record fields: flags, return bytes, formats, record lengths, extra-byte types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the extra-byte data types by code.
DATA_TYPES = {0: "undocumented", 1: "u8", 2: "i8", 3: "u16", 4: "i16", 5: "u32", 6: "i32", 7: "u64", 8: "i64", 9: "f32", 10: "f64"}
#: Bytes of a point record before extra bytes, by format.
BASE_LENGTH = {6: 30, 7: 36, 8: 38}


def extended_flags(byte14: Column, byte15: Column, extended: Column) -> Column:
    """Flag byte of the extended formats; legacy records keep direction and edge bits, classification flags move down."""
    legacy = F.shiftright(byte15, 5).bitwiseOR(byte14.bitwiseAND(0xC0))
    return F.when(extended, byte15).otherwise(legacy)


def pack_returns(number: Column, count: Column) -> Column:
    return number.bitwiseAND(15).bitwiseOR(F.shiftleft(count.bitwiseAND(15), 4))


def output_format(point_format: Column) -> Column:
    """Extended format that holds an input format's fields: colour needs 7, colour with infrared or waves 8."""
    return F.when(point_format.isin(2, 3, 5, 7), 7).when(point_format.isin(8, 10), 8).otherwise(6)


def has_gps_time(point_format: Column) -> Column:
    return ~point_format.isin(0, 2)


def record_length(point_format: Column, extra: Column) -> Column:
    out = F.lit(36)
    for k, n in BASE_LENGTH.items():
        out = F.when(point_format == k, n).otherwise(out)
    return out + extra


def data_type_name(code: Column) -> Column:
    out = F.lit("unknown")
    for k, name in DATA_TYPES.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def field_names(names: Column) -> Column:
    """Comma list of field names, unnamed ones marked."""
    return F.array_join(F.transform(names, lambda n: F.when((n == "") | n.isNull(), "<unnamed>").otherwise(n)), ", ")
