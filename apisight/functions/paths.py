"""Column functions on request paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apisight.ruleset import HEX_ID_LENGTHS, ID_PLACEHOLDER, SUSPICIOUS_PATH_SEGMENTS

#: Fixed value: code points that a canonical segment holds only as %XX: / % { } and controls, invisible and bidirectional marks, exotic spaces.
FORBIDDEN_RANGES = (
    (0x00, 0x1F), (0x25, 0x25), (0x2F, 0x2F), (0x7B, 0x7B), (0x7D, 0x7D), (0x7F, 0xA0), (0xAD, 0xAD), (0x061C, 0x061C), (0x1680, 0x1680),
    (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2064), (0x2066, 0x2069), (0x3000, 0x3000), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB),
)
FORBIDDEN = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in FORBIDDEN_RANGES)
ID_LIKE = r"^(?:[0-9]+|[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}|" + "|".join(f"[0-9A-Fa-f]{{{n}}}" for n in HEX_ID_LENGTHS) + r")\z"

#: Stands for a variable segment in a shape key; no canonical segment and no declared text holds it.
VARIABLE = "\u0000"


def decode_once(segment: Column) -> Column:
    """%XX undone once; the segment as it is where that gives no UTF-8."""
    tokens = F.regexp_extract_all(segment, F.lit("%[0-9A-Fa-f]{2}|[^%]+|%"), 0)
    as_hex = F.transform(tokens, lambda t: F.when(t.rlike("^%.."), F.substring(t, 2, 2)).otherwise(F.hex(F.encode(t, "UTF-8"))))
    raw = F.unhex(F.array_join(as_hex, ""))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(segment)


def reencode(segment: Column) -> Column:
    tokens = F.regexp_extract_all(segment, F.lit(f"[{FORBIDDEN}]|[^{FORBIDDEN}]+"), 0)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(f"^[{FORBIDDEN}]"), F.regexp_replace(F.hex(F.encode(t, "UTF-8")), "(..)", "%$1")).otherwise(t)), "")


def canonical_segments(path: Column) -> Column:
    """Segments of a raw path, each decoded once and encoded again; a trailing slash leaves an empty last segment, `/` and the empty path none."""
    bare = F.regexp_replace(path, "^/", "")
    plain = lambda s: F.when(s.rlike(f"[{FORBIDDEN}]"), reencode(decode_once(s))).otherwise(s)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(bare, "/"), plain))


def join_segments(segments: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def is_id_like(segment: Column) -> Column:
    return segment.rlike(ID_LIKE)


def endpoint_id(pattern: Column) -> Column:
    return F.substring(F.sha2(pattern, 256), 1, 16)


def parent_prefix(pattern: Column) -> Column:
    parent = F.regexp_replace(pattern, r"/[^/]*\z", "")
    return F.when((parent == "") | ~F.contains(pattern, F.lit("/")), F.lit("/")).otherwise(parent)


def suspicious_segment(pattern: Column) -> Column:
    """The first of the catalogue that is a segment of the pattern, else null."""
    segments = F.split(pattern, "/")
    return F.coalesce(*[F.when(F.array_contains(segments, s), F.lit(s)) for s in SUSPICIOUS_PATH_SEGMENTS])


def observed_segments(pattern: Column) -> Column:
    """Segments with null for a variable one."""
    return _typed(pattern, lambda s: s == ID_PLACEHOLDER)


def declared_segments(pattern: Column) -> Column:
    return _typed(pattern, lambda s: F.startswith(s, F.lit("{")) & F.endswith(s, F.lit("}")) & (F.length(s) > 2))


def _typed(pattern: Column, variable) -> Column:
    bare = F.regexp_replace(pattern, "^/", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(bare, "/"), lambda s: F.when(~variable(s), s)))


def shape_key(segments: Column) -> Column:
    """Equal for typed segments that match exactly."""
    return F.concat(F.size(segments).cast("string"), F.lit("/"), F.array_join(F.transform(segments, lambda s: F.coalesce(s, F.lit(VARIABLE))), "/"))
