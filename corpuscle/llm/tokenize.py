"""Problem 8: corpus encoding by a tokenization automaton compiled from a byte-pair vocabulary.

Successive merge gadgets turn the automaton that accepts any byte string into the one whose only path
for a word is the word's tokenization. A gadget for the rule ``u v -> w`` removes the arc ``v`` after
``u`` and adds an arc ``w`` that ends where ``v`` ended *at that time*. A state is thus known by the
last arc, and whether the arc ``y`` leaves the state after ``x`` follows from the gadgets in the order
in which they were applied. Arcs are unrolled from the gadgets when a word first needs them and kept
in a table; encoding then walks a word from left to right, one table look-up per candidate arc, and
decoding emits the arcs' byte labels.
"""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.arrow import map_columns
from corpuscle.session import spread

#: Where the public vocabularies lie; a parameter everywhere, never copied.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pre-splitting pattern that belongs to the vocabulary.
PRE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = 1 << 30
_WORDS = 500_000


def _byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in vocabulary files -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + j): b for j, b in enumerate(rest)}


class TokenAutomaton:
    """Deterministic tokenization automaton of a byte-level BPE vocabulary."""

    def __init__(self, model: dict):
        symbols = _byte_symbols()
        label = lambda s: bytes(symbols[c] for c in s)
        self.ids = {label(t): i for t, i in model["vocab"].items() if all(c in symbols for c in t)}
        self.labels = {i: b for b, i in self.ids.items()}
        self.rule: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            u, v = (label(s) for s in (merge.split(" ") if isinstance(merge, str) else merge))
            x, y = self.ids[u], self.ids[v]
            self.rule[x, y] = rank
            self.made[self.ids[u + v]] = (rank, x, y)
        self.longest = max(map(len, self.ids))
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(PRE_SPLIT).findall

    def _follows(self, x: int, y: int, now: int = _NEVER) -> bool:
        """Whether the arc ``y`` leaves the state after ``x`` once the gadgets before ``now`` are in place."""
        rule, made = self.rule, self.made
        while True:
            if rule.get((x, y), _NEVER) < now:
                return False
            rx, ry = made.get(x), made.get(y)
            if rx is None and ry is None:
                return True
            if ry is None or rx is not None and rx[0] > ry[0]:
                now, x = rx[0], rx[2]
            elif x == y:
                now, x, y = rx[0], rx[2], ry[1]
            elif ry[1] == ry[2] == x:  # equal neighbours merge from the left
                return False
            else:
                now, y = ry[0], ry[1]

    def word(self, word: bytes) -> list[int]:
        """The tokenization of one pre-split word."""
        ids, arcs, n = self.ids, self.arcs, len(word)
        if word in ids and n == 1:
            return [ids[word]]
        last, origin = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                y = ids.get(word[start:end])
                if y is None:
                    continue
                if start == 0:
                    if end > 1 and not self._reached(y):
                        continue
                else:
                    arc = (last[start], y)
                    ok = arcs.get(arc)
                    if ok is None:
                        ok = arcs[arc] = self._reached(y) and self._follows(*arc)
                    if not ok:
                        continue
                last[end], origin[end] = y, start
                break
        out = []
        while n:
            out.append(last[n])
            n = origin[n]
        return out[::-1]

    def _reached(self, y: int) -> bool:
        """Whether some gadget could add the arc ``y``: its two halves followed each other at that time."""
        key = (-1, y)
        ok = self.arcs.get(key)
        if ok is None:
            m = self.made.get(y)
            ok = self.arcs[key] = m is None or self._reached(m[1]) and self._reached(m[2]) and self._follows(m[1], m[2], m[0])
        return ok

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none. Names of special tokens are ordinary text."""
        out: list[int] = []
        if not text:
            return out
        words = self.words
        if len(words) > _WORDS:
            words.clear()
        for w in self.split(text):
            got = words.get(w)
            if got is None:
                got = self.word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    words[w] = got
            out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a token sequence: the labels of its arcs."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


@cache
def automaton(path: str) -> TokenAutomaton:
    """The automaton of a vocabulary file, compiled once in a process."""
    return TokenAutomaton(json.loads(Path(path).read_text("utf-8"))["model"])


_BY_PATH: dict[str, TokenAutomaton] = {}


def encode_corpus(documents: DataFrame, path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json") -> DataFrame:
    """(doc_id, ids) of every row of ``documents``; a repeated doc_id with the same text counts once.

    Null and empty texts get the empty list; a null doc_id is kept. Texts of any length are encoded
    whole. The vocabulary file (fixed size) is read on the driver and broadcast. Only doc_id and text
    are read. Texts are shuffled only if a count of the ids, which reads no text, finds a repeated one.
    """
    rows = documents.select("doc_id", "text")
    n, known = documents.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n != known:
        rows = rows.distinct()
    vocabulary = documents.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(doc_ids: list, texts: list) -> dict[str, list]:
        if path not in _BY_PATH:
            _BY_PATH[path] = TokenAutomaton(json.loads(vocabulary.value)["model"])
        encode = _BY_PATH[path].encode
        return {"doc_id": doc_ids, "ids": [encode(t) for t in texts]}

    return map_columns(spread(rows), ["doc_id", "text"], run, "doc_id bigint, ids array<int>")


def token_totals(encoded: DataFrame) -> DataFrame:
    """Documents and tokens of an encoded corpus, and how many documents have none."""
    return encoded.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("ids")).cast("bigint"), F.lit(0)).alias("tokens"), F.count_if(F.size("ids") == 0).alias("without_tokens"))
