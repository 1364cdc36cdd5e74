"""Scalar expressions shared by the operators; all are built-in functions, so they stay inside generated code."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

PIPE = "|"


def header(headers: Column, key: str) -> Column:
    """Text of the first record header of that key, else null."""
    return F.try_element_at(F.filter(headers, lambda h: h["key"] == key), F.lit(1))["value"].cast("string")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def position(partition: Column, offset: Column) -> Column:
    """Sortable text of a partition and an offset."""
    return F.format_string("%05d:%020d", partition, offset)


def ratio(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(ratio(part, whole) * 100, digits)


def sha256_text(*parts: Column) -> Column:
    """Hex digest of the parts joined by a pipe; a null part counts as empty text."""
    return F.sha2(F.concat_ws(PIPE, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Hex HMAC of a text, by its definition over two digests."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def pseudonym(value: Column, key: bytes) -> Column:
    """HMAC of the trimmed, lower-cased value."""
    return hmac_sha256(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), key)


# Fixed value: RFC 3339 with up to nine digits of a second.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"


def parse_rfc3339(text: Column) -> Column:
    """Timestamp, cut to microseconds; null where the text is no RFC 3339 date-time."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def lsn_text(lsn: Column) -> Column:
    """``HI/LO`` in hexadecimal; null for a negative number."""
    return F.when(lsn >= 0, F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF)))))


def lsn_number(text: Column) -> Column:
    """Inverse of ``lsn_text``; null for other texts."""
    part = lambda i: F.conv(F.regexp_extract(text, r"^([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})$", i), 16, 10).cast("long")
    return F.when(text.rlike(r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), F.shiftleft(part(1), 32) + part(2))


def text_or_base64(data: Column) -> Column:
    """The bytes as text, or marked base64 where they are no UTF-8."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text).when(data.isNotNull(), F.concat(F.lit("base64:"), F.regexp_replace(F.base64(data), "[\r\n]", "")))


def bytes_of(text: Column) -> Column:
    """Inverse of ``text_or_base64``."""
    return F.when(text.startswith("base64:"), F.unbase64(F.substr(text, F.lit(8)))).otherwise(F.encode(text, "UTF-8"))


# ---- variants -------------------------------------------------------------------------------------------------------

_END = uuid.uuid4().hex  # not known to any text, so none can feign the end


def whole_json(text: Column) -> Column:
    """The text as a variant, null unless the whole of it is one JSON value (of at most 999 levels).  The parser stops after the
    first value and passes over what follows, so the text is read as the first of two elements: anything after its value keeps
    the second one from its place."""
    both = F.filter(F.array(ended_json(text)), is_whole)
    return F.try_variant_get(F.get(both, F.lit(0)), "$[0]", "variant")


def ended_json(text: Column) -> Column:
    """The text as the first of two elements of a variant, see ``whole_json``: for columns that are read more than once."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))


def is_whole(ended: Column) -> Column:
    return F.coalesce(F.try_variant_get(ended, "$[1]", "string") == _END, F.lit(False))


def members(v: Column) -> Column:
    """The members of a variant object as a map of their kinds and texts; null for anything else.  One walk over the object, where
    ``part`` walks over it for each name.  A map of variants would hold the names of the whole document once for each member."""
    return F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, m: F.struct(kind(m).alias("kind"), text_of(m).alias("text")))


def member(of: Column, name: str) -> Column:
    """``kind`` and ``text`` of a member; null where absent."""
    return F.try_element_at(of, F.lit(name))


def only_texts(of: Column) -> Column:
    """Whether all members are JSON strings."""
    return F.forall(F.map_values(of), lambda m: m["kind"] == "STRING")


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def part(v: Column, name: str) -> Column:
    """A member of a variant object: null where absent, the variant null where JSON has null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    """``OBJECT...``, ``ARRAY...``, ``STRING``, ``BIGINT``, ``DOUBLE``, ``DECIMAL...``, ``BOOLEAN``, ``VOID``; null where absent."""
    return F.schema_of_variant(v)


def is_null(v: Column) -> Column:
    """Absent, or JSON null."""
    return v.isNull() | (kind(v) == "VOID")


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<_:boolean>").isNotNull()  # the kind would spell out the whole schema


def is_int(v: Column) -> Column:
    return F.coalesce(kind(v) == "BIGINT", F.lit(False))


def all_of(*conditions: Column) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions, F.lit(False))
