"""Problem 2: splitting oversized items at natural boundaries.

Items are processed in ranges: workers find line starts and how natural a cut before each is within a
range (with a halo on both sides), the boundary tables of an item's ranges are stitched, lengths and
line numbers follow from prefix sums, and pieces are cut and emitted by offset from the range in which
they start. All oversized contents take these steps. Files too large for a row are read by byte ranges,
first to count their characters, then to find boundaries and last to emit, so no worker holds one whole.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from corpuscle.functions.arrow import map_columns
from corpuscle.session import ship_package, spread

LIMIT, OVERLAP_LINES = 2000, 3
#: Characters of a content in a range, and bytes of a file.
RANGE_CHARS, RANGE_BYTES = 8192, 1 << 20
_DEFINITION = re.compile(r"[ \t]*(?:@|def |class |async |function\b|export |public |private |protected |static |const \w+ = (?:async )?\(|interface |enum |type |func |/\*\*|#{1,6} )")
_LATER = re.compile(r"[ \t]*(?:else\b|elif\b|except\b|finally\b|catch\b|case\b|default\b|[)\]}])")
_SOFT = re.compile(r"[\s,;(){}\[\]]")


def boundaries(text: str, lo: int, hi: int, base: int, limit: int) -> tuple[list[int], list[int], list[int]]:
    """(offsets of line starts, their scores, offsets of breaks inside long lines) of the range [lo, hi) of ``text``.

    ``text`` is the range with its halo and begins at offset ``base`` of the content; the offsets are
    the content's. A score says how natural a cut before the line is; of a longer line its first 200
    characters, of the line before it the last 200 tell.
    """
    starts, scores, soft = [], [], []
    at = lo if base == 0 and lo == 0 else text.find("\n", max(lo - 1, 0)) + 1
    if at == 0 and not (base == 0 and lo == 0):
        at = len(text)
    previous = text.rfind("\n", 0, max(at - 1, 0)) + 1
    while at < hi or at == 0 == hi:
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at : min(end, at + 200)]
        before = text[max(previous, at - 201) : max(at - 1, 0)].strip()
        indent = len(line) - len(line.lstrip())
        score = 60 - 4 * min(indent, 12)
        if not before:
            score += 30
        elif before[-1] in "}])" or before.startswith(("return", "break", "pass", "continue", "raise", "throw")):
            score += 12
        elif before[-1] in "({[,\\=:" or before.endswith(("&&", "||", "+")):
            score -= 30
        if _DEFINITION.match(line):
            score += 25
        if _LATER.match(line) or not line.strip():
            score -= 40
        if before.startswith("@"):
            score -= 30
        starts.append(base + at)
        scores.append(score)
        previous, at = at, end + 1
        if at <= 0:
            break
    step, clear = max(limit // 10, 1), limit // 4
    for w in range(-(-(base + lo) // step) * step, base + hi, step):
        a = w - base
        if text.find("\n", max(a - clear, 0), a + step + clear) < 0:
            found = [m.end() for m in _SOFT.finditer(text, a, a + step)]
            if found:
                soft.append(base + found[-1])
    return starts, scores, soft


def cut(length: int, starts: Sequence[int], scores: Sequence[int], soft: Sequence[int], limit: int = LIMIT, overlap: int = OVERLAP_LINES) -> list[tuple[int, int, int, int]]:
    """(start, end, first line, last line) of each piece, by stitched boundary tables; lines count from 0.

    Every piece has at most ``limit`` characters. New content starts where the last piece ended; up to
    ``overlap`` lines before it are repeated if the next whole line (or half a piece) still fits behind.
    """
    out = []
    done = 0
    piece_from = 0
    while done < length:
        begin = done
        if done:
            k = bisect_left(starts, done)
            if k < len(starts) and starts[k] == done:
                following = (starts[k + 1] if k + 1 < len(starts) else length) - done
                for back in range(min(overlap, k), 0, -1):
                    if starts[k - back] >= piece_from and done - starts[k - back] + min(following, limit // 2) <= limit:
                        begin = starts[k - back]
                        break
        far = begin + limit
        if far >= length:
            end = length
        else:
            lo, hi = bisect_right(starts, max(done, begin + limit // 3)), bisect_right(starts, far)
            if lo >= hi:
                lo = bisect_right(starts, done)
            if lo < hi:
                best = max(range(lo, hi), key=lambda i: (scores[i] + 20 * (starts[i] - begin) // limit, starts[i]))
                end = starts[best]
            else:
                j = bisect_right(soft, far) - 1
                end = soft[j] if j >= 0 and soft[j] > done + limit // 4 else far
        first = bisect_right(starts, begin) - 1
        last = bisect_right(starts, end - 1) - 1
        out.append((begin, end, max(first, 0), max(last, 0)))
        piece_from, done = begin, end
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP_LINES) -> list[tuple[int, int, int, int]]:
    """The pieces of one content of a single range."""
    return cut(len(text), *boundaries(text, 0, len(text), 0, limit), limit, overlap)


_KEY = "repo_path string, path string, type string, name string, start_line int"
_PIECES = _KEY + ", piece int, pieces int, piece_start int, piece_end int, content string"
_TABLES = "item string, length bigint, range int, starts array<bigint>, scores array<int>, soft array<bigint>"
_TEXTS = _KEY + ", item string, range int, base bigint, text string"
_CUTS = "item string, range int, piece int, pieces int, s bigint, e bigint, a int, b int"
_KEYS = [c.split()[0] for c in _KEY.split(", ")]


def _rows(schema: str, rows: list[tuple]) -> dict[str, list]:
    names = [c.split()[0] for c in schema.split(", ")]
    return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


def _ranges(key: tuple, text: str, size: int, halo: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(item, range, offset and end of the range's text with its halo, its own start) of one content."""
    item = xxhash.xxh3_128_hexdigest(repr(key).encode() + b"\0" + text.encode("utf-8", "replace"))
    for n, own in enumerate(range(0, len(text), size)):
        yield item, n, max(own - halo, 0), min(own + size + halo, len(text)), own


def _halo(limit: int) -> int:
    return max(limit, 512)


def _content_tables(big: DataFrame, limit: int, size: int) -> DataFrame:
    """Boundary tables of every range; equal elements give one."""

    def run(*columns: list) -> dict[str, list]:
        out = []
        for *key, text in zip(*columns):
            for item, n, lo, hi, own in _ranges(tuple(key), text, size, _halo(limit)):
                out.append((item, len(text), n, *boundaries(text[lo:hi], own - lo, min(own + size, len(text)) - lo, lo, limit)))
        return _rows(_TABLES, out)

    return map_columns(spread(big), [*_KEYS, "content"], run, _TABLES).dropDuplicates(["item", "range"])


def _content_texts(big: DataFrame, limit: int, size: int) -> DataFrame:
    """The text of every range with the halo behind it, in which the pieces that start in the range end."""

    def run(*columns: list) -> dict[str, list]:
        out = []
        for *key, text in zip(*columns):
            out += [(*key, item, n, own, text[own:hi]) for item, n, _, hi, own in _ranges(tuple(key), text, size, _halo(limit))]
        return _rows(_TEXTS, out)

    return map_columns(spread(big), [*_KEYS, "content"], run, _TEXTS)


def _stitch(tables: DataFrame, limit: int, overlap: int, range_of: DataFrame | None, size: int) -> DataFrame:
    """(item, range, piece, pieces, offsets, lines) by an item's boundary tables, whose texts stay where they are.

    A table has three numbers a line. ``range_of`` names the ranges of files by their first character;
    contents have ranges of ``size`` characters.
    """
    ship_package(tables.sparkSession)
    kind = _parse_datatype_string(_CUTS)

    def stitch(table: pa.Table) -> pa.Table:
        numbers = table.column("range").to_pylist()
        order = sorted(range(len(numbers)), key=numbers.__getitem__)  # tables are not copied to be sorted
        item, length = table.column("item")[0].as_py(), table.column("length")[0].as_py()
        flat = []
        for c, width in (("starts", "q"), ("scores", "h"), ("soft", "q")):
            values, column = array(width), table.column(c)
            for i in order:
                values.extend(column[i].as_py() or ())
            flat.append(values)
        bases = sorted(table.column("base").to_pylist()) if "base" in table.column_names else None
        got = cut(length, *flat, limit, overlap)
        rows = [(item, s // size if bases is None else bisect_right(bases, s) - 1, i, len(got), s, e, a, b) for i, (s, e, a, b) in enumerate(got)]
        return pa.Table.from_pydict(_rows(_CUTS, rows), schema=to_arrow_schema(kind))

    given = tables if range_of is None else tables.join(range_of.select("item", "range", "base"), ["item", "range"])
    return given.groupBy("item").applyInArrow(stitch, kind)


def _emit(texts: DataFrame, cuts: DataFrame) -> DataFrame:
    return (
        texts.join(cuts, ["item", "range"])
        .withColumn("content", F.substring("text", (F.col("s") - F.col("base") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int")))
        .select(*_KEYS, "piece", "pieces", (F.col("start_line") + F.col("a")).cast("int").alias("piece_start"), (F.col("start_line") + F.col("b")).cast("int").alias("piece_end"), "content")
    )


def _oversized(elements: DataFrame, limit: int) -> DataFrame:
    return elements.select(*_KEYS, "content").filter(F.length("content") > limit)


def split_oversized(elements: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP_LINES, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Pieces of every element longer than ``limit`` characters (code points), of any type.

    Columns: the element's key, piece (from 0), pieces, piece_start and piece_end (line numbers; null
    where start_line is), content. Together the pieces cover the content in order. Null contents and
    those within the limit give none; a repeated element gives its pieces again for each row. The size
    of a range does not change the pieces. Contents are shuffled once, range by range.
    """
    big = _oversized(elements, limit)
    cuts = _stitch(_content_tables(big, limit, range_chars), limit, overlap, None, range_chars)
    return _emit(_content_texts(big, limit, range_chars), cuts)


def read_range(path: str, lo: int, hi: int, halo: int) -> tuple[str, str, str]:
    """(halo before, text, halo behind) of the characters of a UTF-8 file whose first byte lies in [lo, hi)."""
    size = os.path.getsize(path)
    a, b = max(lo - 4 * halo - 3, 0), min(hi + 4 * halo + 3, size)
    with open(path, "rb") as f:
        f.seek(a)
        data = f.read(b - a)

    def aligned(at: int) -> int:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return at

    first, start, end = aligned(0 if not a else 1), aligned(lo - a), aligned(min(hi, size) - a)
    last = len(data)
    while b < size and last and data[last - 1] & 0xC0 == 0x80:
        last -= 1
    last -= b < size
    before, own, behind = (data[i:j].decode("utf-8", "replace") for i, j in ((first, start), (start, end), (end, max(last, end))))
    return before[-halo:], own, behind[:halo]


_FILE_RANGES = _KEY + ", file string, item string, range int, lo bigint, hi bigint"


def split_files(files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP_LINES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of UTF-8 files (repo_path, path, file: where it lies for all workers) of more than ``limit`` characters.

    A file is read by byte ranges and never whole: once for the lengths of its ranges, once for their
    boundaries and once to emit. Columns as of :func:`split_oversized`, with type ``file`` and the path
    as name. Null or unreadable files give none. What is no UTF-8 is replaced.
    """
    halo = _halo(limit)

    def listed(repos: list, paths: list, places: list) -> dict[str, list]:
        out = []
        for repo, path, file in zip(repos, paths, places):
            if file is None or not os.path.isfile(file):
                continue
            size, item = os.path.getsize(file), xxhash.xxh3_128_hexdigest(repr((repo, path, file)).encode())
            out += [(repo, path, "file", path, 1, file, item, n, lo, min(lo + range_bytes, size)) for n, lo in enumerate(range(0, size, range_bytes))]
        return _rows(_FILE_RANGES, out)

    def measured(places: list, items: list, numbers: list, los: list, his: list) -> dict[str, list]:
        return {"item": items, "range": numbers, "chars": [len(read_range(f, lo, hi, 0)[1]) for f, lo, hi in zip(places, los, his)]}

    wanted = map_columns(files.select("repo_path", "path", "file").distinct(), ["repo_path", "path", "file"], listed, _FILE_RANGES)
    cores = files.sparkSession.sparkContext.defaultParallelism
    ranges = wanted.repartition(2 * cores, "item", "range")
    chars = map_columns(ranges, ["file", "item", "range", "lo", "hi"], measured, "item string, range int, chars bigint")
    item = Window.partitionBy("item")
    placed = chars.withColumn("base", F.sum("chars").over(item.orderBy("range")) - F.col("chars")).withColumn("length", F.sum("chars").over(item)).filter(F.col("length") > limit)
    known = ranges.join(placed.select("item", "range", "base", "length"), ["item", "range"])

    def detect(places: list, items: list, numbers: list, los: list, his: list, bases: list, lengths: list) -> dict[str, list]:
        out = []
        for file, key, n, lo, hi, base, length in zip(places, items, numbers, los, his, bases, lengths):
            before, own, behind = read_range(file, lo, hi, halo)
            out.append((key, length, n, *boundaries(before + own + behind, len(before), len(before) + len(own), base - len(before), limit)))
        return _rows(_TABLES, out)

    def emit(*columns: list) -> dict[str, list]:
        out = []
        for *key, file, lo, hi, base, cuts in zip(*columns):
            _, own, behind = read_range(file, lo, hi, halo)
            text = own + behind
            out += [(*key, c["piece"], c["pieces"], 1 + c["a"], 1 + c["b"], text[c["s"] - base : c["e"] - base]) for c in cuts]
        return _rows(_PIECES, out)

    tables = map_columns(known, ["file", "item", "range", "lo", "hi", "base", "length"], detect, _TABLES)
    cuts = _stitch(tables, limit, overlap, placed, 0)
    # the pieces of a range go to where it is read again; a range of a megabyte has some hundreds
    pieces = cuts.groupBy("item", "range").agg(F.collect_list(F.struct("piece", "pieces", "s", "e", "a", "b")).alias("cuts"))
    return map_columns(known.join(pieces, ["item", "range"]), [*_KEYS, "file", "lo", "hi", "base", "cuts"], emit, _PIECES)


def piece_chunks(pieces: DataFrame) -> DataFrame:
    """Pieces as new chunks: a stable chunk_id from the element's key and the piece's number, and the display name."""
    key = F.concat_ws(":", "repo_path", "path", "name", "type", F.col("start_line").cast("string"), F.concat(F.lit("seg"), F.col("piece").cast("string")))
    return pieces.select(
        F.substring(F.md5(key), 1, 12).alias("chunk_id"), "repo_path", F.col("path").alias("file_path"), F.col("type").alias("element_type"),
        F.concat("name", F.format_string(" (part %d/%d)", F.col("piece") + 1, F.col("pieces"))).alias("name"), F.col("piece_start").alias("start_line"), F.col("piece_end").alias("end_line"), "content",
    )


def oversized(elements: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(repo_path, path, name, start_line) of the elements that the splitter cuts, by their stitched ranges; no content is shuffled."""
    big = _oversized(elements, limit)
    cuts = _stitch(_content_tables(big, limit, RANGE_CHARS), limit, OVERLAP_LINES, None, RANGE_CHARS)
    names = _KEY + ", item string, range int"

    def first(*columns: list) -> dict[str, list]:
        return _rows(names, [(*key, next(_ranges(tuple(key), text, RANGE_CHARS, 0))[0], 0) for *key, text in zip(*columns)])

    keys = map_columns(spread(big), [*_KEYS, "content"], first, names).distinct()
    return keys.join(cuts.filter("pieces > 1 and piece = 0").select("item"), "item").select("repo_path", "path", "name", "start_line").distinct()
