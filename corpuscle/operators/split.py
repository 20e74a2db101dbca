"""Splitting functions and methods under a token budget (K1-K8)."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame

from corpuscle.functions.arrow import map_columns
from corpuscle.operators.parse import ELEMENTS

MAX_TOKENS, OVERLAP_LINES = 512, 3
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
SEGMENTS = ELEMENTS + ", segment int, segments int, segment_start int, segment_end int"


class TokenCounter(Protocol):
    """Anything that counts the tokens of a text; it is shipped to the workers."""

    def __call__(self, text: str) -> int: ...


def count_tokens(text: str) -> int:
    """The default counter: words and single signs. Counts are a proxy for any model's own."""
    return len(_TOKEN.findall(text))


def hf_counter(path: str) -> Callable[[str], int]:
    """A counter over a tokenizer file, special tokens included; needs the tokenizers library."""
    loaded: dict = {}

    def count(text: str) -> int:
        if "t" not in loaded:
            from tokenizers import Tokenizer

            loaded["t"] = Tokenizer.from_file(path)
        return len(loaded["t"].encode(text).ids)

    return count


def signature_lines(lines: list[str]) -> int:
    """Lines up to and with the one that ends the signature: the first ending in a colon from the first ``def`` on."""
    first = next((i for i, x in enumerate(lines) if x.lstrip().startswith("def ")), 0)
    return next((i + 1 for i in range(first, len(lines)) if lines[i].rstrip().endswith(":")), first + 1)


def segments(costs: list[int], budget: int, overlap: int, head: int = 0, empty_first: bool = True) -> list[tuple[int, int]]:
    """(start, end) of greedy segments of lines with the given token counts.

    The budget is soft, as overlap and the line behind it are not weighed again. With ``empty_first`` a
    first line over the budget yields an empty segment before it.
    """
    out, start, used = [], 0, head
    for i, cost in enumerate(costs):
        if used + cost > budget and (empty_first or i > start):
            out.append((start, i))
            start = max(start, i - overlap)
            used = head + sum(costs[start:i])
        used += cost
    if start < len(costs):
        out.append((start, len(costs)))
    return out


def split_content(content: str, kind: str, start_line: int, end_line: int, counter: TokenCounter = count_tokens, budget: int = MAX_TOKENS, overlap: int = OVERLAP_LINES, line_mode: str = "exact") -> list[tuple[str, int, int]]:
    """(content, first line, last line) of each segment of an element.

    Classes and imports, and whatever fits the budget, stay whole. Every segment of a split function
    begins with its signature; if the signature alone reaches the budget, plain lines are cut instead.
    ``line_mode='exact'`` counts the signature's lines, ``'compat'`` does not.
    """
    if kind not in ("function", "method") or counter(content) <= budget:
        return [(content, start_line, end_line)]
    lines = content.splitlines()
    head = signature_lines(lines)
    signature = "\n".join(lines[:head])
    cost = counter(signature)
    if cost >= budget:
        cuts = segments([counter(x) for x in lines], budget, overlap, 0, False)
        return [("\n".join(lines[a:b]), start_line + a, start_line + b - 1) for a, b in cuts] or [(content, start_line, end_line)]
    body = lines[head:]
    shift = start_line + (head if line_mode == "exact" else 0)
    return [(signature + "\n" + "\n".join(body[a:b]), shift + a, shift + b - 1) for a, b in segments([counter(x) for x in body], budget, overlap, cost)]


def split_elements(elements: DataFrame, counter: TokenCounter = count_tokens, budget: int = MAX_TOKENS, overlap: int = OVERLAP_LINES, line_mode: str = "exact") -> DataFrame:
    """Elements with one row for each segment; ``segment`` and ``segments`` are null where nothing was split.

    ``start_line`` stays the element's own (it names the chunk); the segment's lines are
    ``segment_start`` and ``segment_end``. Null contents pass through whole.
    """
    names = [c.strip().split(" ")[0] for c in SEGMENTS.split(", ")]
    given = names[:14]

    def run(*columns: list) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in names}
        for row in zip(*columns):
            e = dict(zip(given, row))
            if e["content"] is None or e["start_line"] is None:
                got = [(e["content"], e["start_line"], e["end_line"])]
            else:
                got = split_content(e["content"], e["type"], e["start_line"], e["end_line"] or e["start_line"], counter, budget, overlap, line_mode)
            for i, (text, a, b) in enumerate(got):
                values = e | {"content": text, "segment": i if len(got) > 1 else None, "segments": len(got) if len(got) > 1 else None, "segment_start": a, "segment_end": b}
                for n in names:
                    out[n].append(values[n])
        return out

    return map_columns(elements, given, run, SEGMENTS)
