"""Embedding texts (E1-E3): a deterministic offline embedder, an HTTP one, and the column operator."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from functools import lru_cache
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.arrow import map_columns

_TOKEN = re.compile(r"[A-Za-z]+|\d+|[^\sA-Za-z\d]")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Embedder(Protocol):
    """Turns texts into vectors of one width; ``None`` marks a text that failed. Shipped to the workers."""

    embedder_id: str
    width: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


@lru_cache(maxsize=200_000)
def _slots(token: str, width: int) -> tuple[tuple[int, float], ...]:
    """(dimension, sign) of a token and of each of its parts; only ASCII letters lose their case."""
    parts = {token.lower() if token.isascii() else token, *(p.lower() for p in _PART.findall(token))}
    low = [int.from_bytes(hashlib.md5(p.encode()).digest()[:8], "little") for p in parts]  # noqa: S324
    return tuple((h % width, 1.0 if h // width % 2 else -1.0) for h in low)


class HashingEmbedder:
    """Signed feature hashing of words and word parts, of unit length. A text without tokens fails.

    A part counts in the dimension that the low half of its MD5 leaves modulo the width, with the sign
    of the next bit, so that SQL can do the same.
    """

    def __init__(self, width: int = 64):
        self.width, self.embedder_id = width, f"hashing-{width}"

    def _one(self, text: str) -> list[float] | None:
        v = np.zeros(self.width)
        for t in _TOKEN.findall(text or ""):
            for i, sign in _slots(t, self.width):
                v[i] += sign
        n = float(np.linalg.norm(v))
        return [float(x) for x in (v / n).astype(np.float32)] if n else None

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """One vector a text."""
        return [self._one(t) for t in texts]


class HttpEmbedder:
    """An embedding server that takes one text a request; a failed request yields None and the rest go on."""

    def __init__(self, model: str, url: str = "http://localhost:11434", width: int = 768, timeout: float = 30):
        self.model, self.url, self.width, self.timeout = model, url.rstrip("/"), width, timeout
        self.embedder_id = f"{model}-{width}"

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """One vector a text."""
        out: list[list[float] | None] = []
        for t in texts:
            body = json.dumps({"model": self.model, "prompt": t}).encode()
            request = urllib.request.Request(f"{self.url}/api/embeddings", body, {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:  # noqa: S310
                    v = json.load(r).get("embedding")
                out.append([float(x) for x in v] if v and len(v) == self.width else None)
            except (OSError, ValueError):
                out.append(None)
        return out


def embed_column(rows: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 32) -> DataFrame:
    """(key, vector, embedder_id) of each row; ``vector`` is null where the text is null or failed.

    Texts are sent in batches; rows keep their key's type.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(keys: list, texts: list) -> dict[str, list]:
        vectors: list[list[float] | None] = [None] * len(texts)
        live = [i for i, t in enumerate(texts) if t is not None]
        for a in range(0, len(live), batch):
            part = live[a : a + batch]
            for i, v in zip(part, embedder.embed([texts[i] for i in part])):
                vectors[i] = v
        return {key: keys, "vector": vectors, "embedder_id": [embedder.embedder_id] * len(keys)}

    return map_columns(rows, [key, text], run, f"{key} {kind}, vector array<float>, embedder_id string")


def embed_query(text: str, embedder: Embedder) -> list[float]:
    """The vector of one text; raises where it fails."""
    v = embedder.embed([text])[0]
    if v is None:
        raise RuntimeError("the query could not be embedded")
    return v


def embedded(vectors: DataFrame) -> DataFrame:
    """rows whose text could be embedded."""
    return vectors.filter(F.col("vector").isNotNull())
