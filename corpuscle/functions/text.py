"""Decoding and text scalars: native column expressions, and Python where bytes are decoded."""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encodings tried in turn, and how many bytes detection looks at.
LADDER = ["utf-8", "utf-16", "latin-1", "cp1252", "ascii", "iso-8859-1"]
DETECTION_SAMPLE = 10_000


def detect_encoding(data: bytes) -> str:
    """The encoding of the first bytes: a byte-order mark, else strict UTF-8, else the default utf-8.

    Deterministic stand-in for a statistical detector: it claims only what is certain.
    """
    head = data[:DETECTION_SAMPLE]
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if head.startswith(mark):
            return name
    return "utf-8"


def decode_bytes(data: bytes, encoding: str | None = None) -> tuple[str, str]:
    """(text, encoding used): the given or detected encoding, then the ladder; line ends become ``\\n``.

    BOM-less bytes are not taken for UTF-16. latin-1 accepts any bytes, so the ladder never fails.
    """
    first = encoding or detect_encoding(data)
    for name in dict.fromkeys([first, *LADDER]):
        if name == "utf-16" and name != first and not data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
            continue
        try:
            return data.decode(name).replace("\r\n", "\n").replace("\r", "\n"), name
        except (UnicodeDecodeError, LookupError):
            continue
    raise AssertionError("unreachable")


def line_count_of(text: str | None) -> int | None:
    """Lines of a text; an unended last line counts, an empty text has none."""
    return None if text is None else text.count("\n") + (1 if text and not text.endswith("\n") else 0)


def line_count(text: Column) -> Column:
    """T3 as a column; null for null."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("bigint")


def normalise_newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def preview(text: Column, lines: int = 10) -> Column:
    """The first lines."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")


def size_label(size: Column) -> Column:
    """One decimal in B, KB, MB, GB or TB; ties round to even. Null for null."""
    out = F.format_string("%.1f TB", F.bround(size / F.lit(1024.0**4), 1))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        scaled = size / F.lit(1024.0**power)
        out = F.when(scaled < 1024, F.format_string(f"%.1f {unit}", F.bround(scaled, 1))).otherwise(out)
    return F.when(size.isNotNull(), out)


def file_label(name: Column, extension: Column, size: Column) -> Column:
    """Name (extension, size)."""
    return F.concat(name, F.lit(" ("), extension, F.lit(", "), size_label(size), F.lit(")"))


def source_label(name: Column, lines: Column, encoding: Column, size: Column, loaded: Column) -> Column:
    """T7, the other form: name (lines, encoding, state) once lines are known and not 0, else name (size, state)."""
    state = F.when(loaded, "loaded").otherwise("lazy")
    return F.when(F.coalesce(lines, F.lit(0)) != 0, F.format_string("%s (%d lines, %s, %s)", name, lines, encoding, state)).otherwise(F.format_string("%s (%s, %s)", name, size_label(size), state))


def strip_quotes(text: Column) -> Column:
    """Quotes off both ends."""
    return F.regexp_replace(text, "^['\"]+|['\"]+$", "")


def return_type(text: Column) -> Column:
    """A leading colon and the space about it off."""
    return F.trim(F.regexp_replace(text, "^:", ""))


def base_url(url: Column) -> Column:
    """Slashes off the end."""
    return F.rtrim(url, F.lit("/"))


def chunk_id(repo: Column, path: Column, name: Column, kind: Column, parent: Column, start: Column, segment: Column | None = None) -> Column:
    """Twelve hex digits that name a chunk. Empty and null parents and null segments leave no trace."""
    parts = [repo, path, name, kind, F.nullif(parent, F.lit("")), start.cast("string")]
    if segment is not None:
        parts.append(F.when(segment.isNotNull(), F.concat(F.lit("seg"), segment.cast("string"))))
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12)


def snippet(content: Column, n: int = 400) -> Column:
    """Trimmed of all white space, first n characters."""
    return F.substring(F.regexp_replace(content, r"^\s+|\s+$", ""), 1, n)


def reference_label(path: Column, line: Column) -> Column:
    """Path:line."""
    return F.concat_ws(":", path, line.cast("string"))


def distance_label(distance: Column) -> Column:
    """One decimal."""
    return F.format_string("%.1f", F.bround(distance, 1))


def relative_time(seconds: Column) -> Column:
    """Just now, minutes or hours ago, rounded down."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 60, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))


def zero_pad(n: Column, width: int = 3) -> Column:
    """Zeros in front up to the width; longer numbers stay whole."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def plural(n: Column, one: str = "entry", many: str = "entries") -> Column:
    """The heading's word for a count."""
    return F.when(n == 1, one).otherwise(many)


def token_count(text: Column) -> Column:
    """K2, the default offline counter: words and single signs."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+|[^\sA-Za-z0-9_])"), F.lit(1)))


def nonblank(text: Column) -> Column:
    """whether a typed text is more than white space."""
    return F.length(F.regexp_replace(text, r"\s+", "")) > 0
