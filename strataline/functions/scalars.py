"""Scalar column functions: serialization, coercion, canonical values, byte areas. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of logical fields.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
NULL_WORDS = ("", "?", "null", "none")
PREVIEW = 160


def strip_trailing(text: Column) -> Column:
    """Text without trailing white space of any script."""
    return F.regexp_replace(text, r"(?U)\s+$", "")


def decimal_text(value: Column) -> Column:
    """A decimal in plain notation at its own scale."""
    return value.cast("string")


def iso_date(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def iso_datetime(value: Column) -> Column:
    """ISO text; the fraction is left out when zero and has six digits otherwise."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def base64_text(value: Column) -> Column:
    """Base64 on one line."""
    return F.translate(F.base64(value), "\r\n", "")


def strict_base64(text: Column) -> Column:
    """Bytes of base64 text, null where it isn't base64."""
    return F.call_function("try_to_binary", text, F.lit("base64"))


def finite(value: Column, name: str) -> Column:
    """value, raising on NaN and infinities, which JSON can't hold."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"field {name} isn't finite")).cast("double")).otherwise(value)


def logical(text: Column, name: str = "value") -> Column:
    """Boolean of a logical field's spelling; null for blanks; raises on anything else."""
    word = F.lower(F.trim(text))
    return (
        F.when(text.isNull() | word.isin(*NULL_WORDS), F.lit(None).cast("boolean"))
        .when(word.isin(*TRUE_WORDS), F.lit(True))
        .when(word.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit(f"field {name} isn't logical: "), text)).cast("boolean"))
    )


def canonical_number(value: Column, decimals: int) -> Column:
    """Plain text at a fixed scale, half to even."""
    return F.bround(value, decimals).cast(f"decimal(38,{decimals})").cast("string")


def currency(value: Column) -> Column:
    """Four-decimal currency text."""
    return canonical_number(value.cast("decimal(28,8)"), 4)


def ieee_little_endian(value: Column) -> Column:
    """Hex of a double's eight bytes, least significant first."""
    bits = F.lpad(F.lower(F.hex(F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("long"))), 16, "0")
    return F.concat(*(F.substring(bits, 15 - 2 * k, 2) for k in range(8)))


def canonical_datetime(value: Column) -> Column:
    """ISO text with milliseconds, truncated."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def bit_is_set(bitmap: Column, bit: int) -> Column:
    """Whether a bit of a bitmap (an integer, or bytes with bit 0 lowest in the first) is set; missing bytes are clear."""
    return F.getbit(bitmap, F.lit(bit)) == 1


def bytes_bit_is_set(bitmap: Column, bit: int) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, bit // 8 + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.lit(bit % 8)) == 1, F.lit(False))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def preview(text: Column, width: int = PREVIEW) -> Column:
    """The text, or its start and three dots."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))).otherwise(text)


def csv_cell(value: Column, kind: str) -> Column:
    """A cell's text: true/false, compact JSON for nested values, nothing for null."""
    if kind == "boolean":
        text = F.when(value, "true").otherwise("false")
        return F.when(value.isNull(), "").otherwise(text)
    if kind in ("struct", "array", "map"):
        return F.coalesce(F.to_json(value), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def value_payload(value: Column, kind: str) -> Column:
    """Bytes that stand for a value in ordered hashes: a marker, the length as eight bytes, the value.

    kind is the value's column type: boolean, long, double (already JSON text), string or json.
    """
    marker = {"boolean": "L", "long": "I", "double": "F", "string": "S", "json": "J"}[kind]
    text = F.when(value.cast("boolean"), "true").otherwise("false") if kind == "boolean" else value.cast("string")
    body = F.encode(text, "UTF-8")
    framed = F.concat(F.encode(F.lit(marker), "UTF-8"), F.unhex(F.lpad(F.hex(F.octet_length(body).cast("long")), 16, "0")), body)
    return F.when(value.isNull(), F.concat(F.encode(F.lit("N"), "UTF-8"), F.unhex(F.lit("0" * 16)))).otherwise(framed)


#: First byte, last byte and name of the parts of a table file's header.
HEADER_AREAS = (
    (0, 0, "header.version"),
    (1, 3, "header.last_update"),
    (4, 7, "header.record_count"),
    (8, 11, "header.layout_lengths"),
    (14, 14, "header.incomplete_transaction"),
    (15, 15, "header.encryption"),
    (28, 28, "header.structural_index_flag"),
    (29, 29, "header.language_driver"),
)
#: The same of a memo file's header.
MEMO_AREAS = (
    (0, 3, "fpt_header.next_free_block"),
    (4, 5, "fpt_header.reserved"),
    (6, 7, "fpt_header.block_size"),
    (8, 511, "fpt_header.reserved"),
)


def _in_areas(offset: Column, areas) -> Column:
    return F.coalesce(*(F.when(offset.between(lo, hi), F.lit(name)) for lo, hi, name in areas))


def byte_area(offset: Column, header_length: int, record_length: int) -> Column:
    """The part of a table file that a byte belongs to."""
    place = offset - header_length
    numbers = ((F.floor(place / record_length) + 1).cast("string"), F.pmod(place, F.lit(record_length)).cast("string"))
    record = F.format_string("record_data[record=%s,offset=%s]", *numbers)
    rest = F.when(place >= 0, record).when(offset >= 32, "field_descriptors_or_header_padding").otherwise("record_data_or_file_tail")
    return F.coalesce(_in_areas(offset, HEADER_AREAS), rest)


def memo_area(offset: Column) -> Column:
    """The part of a memo file that a byte belongs to."""
    return F.coalesce(_in_areas(offset, MEMO_AREAS), F.lit("fpt_memo_block_data_or_padding"))


def variant_kind(type_name: Column) -> Column:
    """Kind of a JSON value from its variant type: null, bool, int, float, str, object or array."""
    return (
        F.when(type_name.isNull() | (type_name == "VOID"), "null")
        .when(type_name == "BOOLEAN", "bool")
        .when((type_name == "BIGINT") | type_name.rlike(r"^DECIMAL\([0-9]+,0\)$"), "int")
        .when(type_name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .when(type_name == "STRING", "str")
        .when(type_name.startswith("OBJECT"), "object")
        .when(type_name.startswith("ARRAY"), "array")
        .otherwise("other")
    )
