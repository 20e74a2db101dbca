"""Problem 9: evaluation items repeated in corpus documents.

A BM25 inverted index of the items answers every passage of every document by block-max WAND. Its
terms are pairs of adjacent words, of which a passage without a leak holds few. An item's weights are
divided by the least score that a true case of it can have, so one threshold (1) holds for all items
and loses none; candidates are then verified word by word.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpuscle.functions.arrow import map_columns
from corpuscle.session import spread

#: A leak is this many consecutive words of an item, or the whole item with one word in REPLACED_IN replaced.
RUN_WORDS, REPLACED_IN = 13, 8
K1, B = 1.2, 0.75
BLOCK = 16
#: Characters of items in one index; a larger suite is searched in parts.
SUITE_CHARS = 64 << 20
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without regard to case."""
    return _WORD.findall(text.lower()) if text else []


def pairs(w: list[str]) -> list[str]:
    """The terms of a text: its pairs of adjacent words, or its only word."""
    return [f"{a} {b}" for a, b in zip(w, w[1:])] or w


class ItemIndex:
    """Block-max inverted index of the items with a per-item threshold of 1."""

    def __init__(self, items: list[tuple[int, str | None, str | None]]):
        kept = [(i, words(t), words(a)) for i, t, a in sorted(items, key=lambda x: x[0]) if words(t)]
        self.ids = [i for i, _, _ in kept]
        self.texts = [w for _, w, _ in kept]
        self.answers = [a for _, _, a in kept]
        df = Counter(t for w in self.texts for t in set(pairs(w)))
        n, mean = len(kept), sum(map(len, self.texts)) / max(len(kept), 1)
        self.single = {w[0] for w in self.texts if len(w) == 1}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.longest = max(map(len, self.texts), default=1)
        for d, w in enumerate(self.texts):
            tf = Counter(pairs(w))
            weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            least = self._least(w, weight)
            for t, x in weight.items():
                postings[t].append((d, x / least))
        self.docs = {t: [d for d, _ in p] for t, p in postings.items()}
        self.scores = {t: [x for _, x in p] for t, p in postings.items()}
        self.top = {t: max(s) for t, s in self.scores.items()}
        self.blocks = {t: [(self.docs[t][min(b + BLOCK, len(s)) - 1], max(s[b : b + BLOCK])) for b in range(0, len(s), BLOCK)] for t, s in self.scores.items()}
        self.runs: dict[int, set[tuple[str, ...]]] = {}

    @staticmethod
    def _least(w: list[str], weight: dict[str, float]) -> float:
        """The least sum of weights of distinct terms that a passage with a true case must hold.

        A replaced word takes the two pairs that it is part of; a pair that the item has c times is lost
        by c such steps, so the sum of the heaviest steps is never less than what replacing can lose.
        """
        terms = pairs(w)
        runs = [sum(weight[t] for t in set(terms[i : i + RUN_WORDS - 1])) for i in range(len(w) - RUN_WORDS + 1)]
        counts = Counter(terms)
        share = [weight[t] / counts[t] for t in terms]
        steps = sorted((sum(share[max(i - 1, 0) : i + 1]) for i in range(len(w))), reverse=True)
        whole = sum(weight.values()) - sum(steps[: len(w) // REPLACED_IN])
        return max(min([*runs, whole]), 1e-9)

    def search(self, terms: list[str], threshold: float = 1.0 - 1e-9) -> list[int]:
        """All items whose score on the given distinct terms reaches the threshold (block-max WAND)."""
        top, docs, blocks = self.top, self.docs, self.blocks
        lists = [t for t in terms if t in top]
        if sum(top[t] for t in lists) < threshold:
            return []
        heads = [[docs[t][0], 0, t] for t in lists]
        out = []
        while heads:
            heads.sort()
            bound, pivot = 0.0, -1
            for j, h in enumerate(heads):
                bound += top[h[2]]
                if bound >= threshold:
                    pivot = j
                    break
            if pivot < 0:
                break
            doc = heads[pivot][0]
            while pivot + 1 < len(heads) and heads[pivot + 1][0] == doc:
                pivot += 1
            bound, ends = 0.0, []
            for _, at, t in heads[: pivot + 1]:
                b = blocks[t]
                k, n = at // BLOCK, len(b)
                while k < n and b[k][0] < doc:
                    k += 1
                if k < n:
                    end, most = b[k]
                    bound += most
                    ends.append(end)
            if bound >= threshold:
                if heads[0][0] == doc:
                    score = 0.0
                    for h in heads[: pivot + 1]:
                        score += self.scores[h[2]][h[1]]
                    if score >= threshold:
                        out.append(doc)
                    target = doc + 1
                else:
                    target = doc
            else:  # no item before the nearest block end can reach the threshold
                target = min([*ends, *([heads[pivot + 1][0] - 1] if pivot + 1 < len(heads) else [])], default=doc) + 1
                target = max(target, doc + 1)
            moved = []
            for h in heads[: pivot + 1]:
                if h[0] < target:
                    p = docs[h[2]]
                    h[1] = bisect_left(p, target, h[1])
                    if h[1] >= len(p):
                        continue
                    h[0] = p[h[1]]
                moved.append(h)
            heads = moved + heads[pivot + 1 :]
        return out

    def verify(self, item: int, w: list[str]) -> tuple[int, bool] | None:
        """(longest run found in words, whole item found) if the passage truly leaks the item."""
        text = self.texts[item]
        n, runs = len(text), self.runs.get(item)
        if runs is None:
            if len(self.runs) > 500:
                self.runs.clear()
            runs = self.runs[item] = {tuple(text[i : i + RUN_WORDS]) for i in range(n - RUN_WORDS + 1)}
        found = 0
        if runs:
            at = 0
            while at <= len(w) - RUN_WORDS:
                if tuple(w[at : at + RUN_WORDS]) in runs:
                    end = at + RUN_WORDS
                    while end < len(w) and tuple(w[end - RUN_WORDS + 1 : end + 1]) in runs:
                        end += 1
                    found = max(found, end - at)
                    at = end - RUN_WORDS + 1
                at += 1
        whole, budget = False, n // REPLACED_IN
        positions = defaultdict(list)
        for i, t in enumerate(text):
            positions[t].append(i)
        shifts = Counter(j - i for j, t in enumerate(w) for i in positions.get(t, ()))
        for shift, same in shifts.items():
            if same >= n - budget and shift >= 0 and shift + n <= len(w):
                whole = True
        return (found, whole) if found or whole else None

    def leaks(self, text: str | None) -> list[tuple[int, int, bool, float]]:
        """(item_id, longest run, whole item, share of the answer's words in the passage) for one text."""
        w = words(text)
        docs = self.docs
        hits = [i for i, t in enumerate(pairs(w)) if t in docs] if len(w) > 1 else []
        if self.single:
            hits = sorted({*hits, *(i for i, t in enumerate(w) if t in self.single)})
        size, at = 2 * self.longest, 0
        best: dict[int, tuple[int, bool, float]] = {}
        for start in range(0, max(len(w) - self.longest, 1), self.longest):
            while at < len(hits) and hits[at] < start:
                at += 1
            if at == len(hits):
                break
            if hits[at] >= start + size:
                continue
            passage = w[start : start + size]
            terms = pairs(passage) if len(passage) > 1 else []
            for d in self.search(list(dict.fromkeys([*terms, *(t for t in passage if t in self.single)]))):
                got = self.verify(d, passage)
                if got:
                    answer = self.answers[d]
                    near = set(passage)
                    share = sum(t in near for t in answer) / len(answer) if answer else 0.0
                    old = best.get(d, (0, False, 0.0))
                    best[d] = (max(old[0], got[0]), old[1] or got[1], max(old[2], share))
        return [(self.ids[d], *x) for d, x in sorted(best.items())]


_INDEXES: dict[int, ItemIndex] = {}


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, run_words, whole_item, answer_share): every item that a document leaks.

    The items (a held-out suite, small at every corpus size) are collected and broadcast by parts of at
    most SUITE_CHARS characters, whatever their number; each part is an index of its own and reads the
    documents once. Documents are cut into passages of twice the longest item that overlap by one item,
    so any case lies within one passage. Null texts and items without words match nothing; a null
    doc_id is kept; repeated rows count once. Documents are not shuffled.
    """
    suite = items.select("item_id", "text", "answer").filter("item_id is not null and length(text) > 0").distinct()
    chars = suite.agg(F.sum(F.length("text") + F.coalesce(F.length("answer"), F.lit(0)))).first()[0] or 0
    parts = math.ceil(max(chars, 1) / SUITE_CHARS)
    found = None
    for part in range(parts):
        got = _leaked(documents, suite.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else suite)
        found = got if found is None else found.unionByName(got)
    return found.distinct()


def _leaked(documents: DataFrame, suite: DataFrame) -> DataFrame:
    rows: list[Row] = suite.collect()
    sent = documents.sparkSession.sparkContext.broadcast([(r[0], r[1], r[2]) for r in rows])

    def run(doc_ids: list, texts: list) -> dict[str, list]:
        index = _INDEXES.get(id(sent))
        if index is None:
            _INDEXES.clear()
            index = _INDEXES[id(sent)] = ItemIndex(sent.value)
        out: dict[str, list] = {n: [] for n in ("doc_id", "item_id", "run_words", "whole_item", "answer_share")}
        for doc, text in zip(doc_ids, texts):
            for item, found, whole, share in index.leaks(text):
                for n, x in (("doc_id", doc), ("item_id", item), ("run_words", found), ("whole_item", whole), ("answer_share", share)):
                    out[n].append(x)
        return out

    wanted = documents.select("doc_id", "text").filter(F.length("text") > 0)
    return map_columns(spread(wanted), ["doc_id", "text"], run, "doc_id bigint, item_id bigint, run_words int, whole_item boolean, answer_share double")


def leaked_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents that leak it, whole copies, and documents that also hold its whole answer."""
    got = leaked_items(documents, items).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.count_if("whole_item").alias("whole_copies"), F.count_if(F.col("answer_share") >= 1).alias("with_answer"))
    return items.select("item_id", "suite", "split").dropDuplicates(["item_id"]).join(got, "item_id", "left").fillna(0, ["documents", "whole_copies", "with_answer"])
