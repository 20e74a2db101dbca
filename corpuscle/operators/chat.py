"""Retrieval-augmented prompts."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two prompt templates and the line between context blocks.
NO_CONTEXT = "You are a helpful assistant answering questions about a codebase. No relevant code context was found for this question - say so plainly instead of guessing.\n\nQuestion: {question}\nAnswer:"
WITH_CONTEXT = "You are a helpful assistant answering questions about a codebase. Use only the code context below to answer. If the context doesn't contain the answer, say so instead of guessing.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:"
SEPARATOR = "\n\n---\n\n"

Generator = Callable[[str], str]


def context_block(path: Column, kind: Column, name: Column, content: Column) -> Column:
    """One hit as context: a line that locates it, and its content."""
    return F.concat(F.lit("# "), path, F.lit(" ("), kind, F.lit(" "), name, F.lit(")\n"), content)


def fold_context(hits: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """The hits of each group in order of rank, joined; hits with a null part are left out."""
    block = context_block(F.col("file_path"), F.col("element_type"), F.col("name"), F.col("content"))
    pairs = F.array_sort(F.collect_list(F.when(block.isNotNull(), F.struct(F.col(rank).alias("r"), block.alias("b")))))
    return hits.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda x: x["b"]), SEPARATOR).alias("context"))


def prompt(question: Column, context: Column) -> Column:
    """The prompt; a null or empty context takes the template without one."""

    def fill(template: str) -> Column:
        pieces: list[Column] = []
        rest = template
        while rest:
            at = min((rest.find(s) for s in ("{context}", "{question}") if s in rest), default=-1)
            if at < 0:
                pieces.append(F.lit(rest))
                break
            pieces.append(F.lit(rest[:at]))
            slot = "{context}" if rest.startswith("{context}", at) else "{question}"
            pieces.append(context if slot == "{context}" else question)
            rest = rest[at + len(slot) :]
        return F.concat(*pieces)

    return F.when(F.length(F.coalesce(context, F.lit(""))) > 0, fill(WITH_CONTEXT)).otherwise(fill(NO_CONTEXT))


def build_prompt(question: str, hits: list[dict]) -> str:
    """G8 on the driver, for one question and its few hits in order."""
    if not hits:
        return NO_CONTEXT.replace("{question}", question)
    blocks = [f"# {h['file_path']} ({h['element_type']} {h['name']})\n{h['content']}" for h in hits]
    head, tail = WITH_CONTEXT.split("{context}")
    return head + SEPARATOR.join(blocks) + tail.replace("{question}", question)


class HttpGenerator:
    """A text generation server; an error is returned as the answer's text."""

    def __init__(self, model: str, url: str = "http://localhost:11434", timeout: float = 120):
        self.model, self.url, self.timeout = model, url.rstrip("/"), timeout

    def __call__(self, text: str) -> str:
        body = json.dumps({"model": self.model, "prompt": text, "stream": False}).encode()
        request = urllib.request.Request(f"{self.url}/api/generate", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:  # noqa: S310
                return str(json.load(r).get("response", "")).strip()
        except (OSError, ValueError) as e:
            return f"Error generating answer: {e}"
