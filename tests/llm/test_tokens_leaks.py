import base64
import os
import random

import pytest

from corpuscle.llm import leakage as K
from corpuscle.llm import tokenize as T

FILE = f"{T.TOKENIZER_DIR}/byte_bpe_50k.json"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{T.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=T.PRE_SPLIT, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
def test_automaton_equals_merging(reference):
    a = T.automaton(FILE)
    rnd = random.Random(3)
    texts = ["", " ", "\r\n\r\n", "<|endoftext|>", "naïve café é 👩‍💻🚀", "a" * 3000, "aaaa" * 7 + " " * 200 + "==" * 99, "0xDEADBEEF 3.14159 don't I'LL", "ﬁ​﻿漢字かな"]
    texts += ["".join(rnd.choice("aaab  \n\t.-_=e' éß漢🚀ABtheing019") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        ids = a.encode(t)
        assert ids == reference.encode_ordinary(t), t
        assert a.decode(ids) == t


@needs_vocabulary
def test_small_vocabulary_against_plain_merging():
    merges = ["a a", "aa a", "b a", "aa aa", "a b", "ab a"]
    vocab = {c: i for i, c in enumerate("ab")} | {m.replace(" ", ""): 2 + i for i, m in enumerate(merges)}
    auto = T.TokenAutomaton({"vocab": vocab, "merges": merges})
    rank = {tuple(m.split(" ")): i for i, m in enumerate(merges)}

    def plain(word):
        parts = list(word)
        while len(parts) > 1:
            best = min(((rank.get(p, 99), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(99, 0))
            if best[0] == 99:
                break
            pair, out, i = tuple(parts[best[1] : best[1] + 2]), [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == pair:
                    out.append("".join(pair))
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [vocab[p] for p in parts]

    for n in range(1, 12):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert auto.word(word.encode()) == plain(word), word


@needs_vocabulary
def test_corpus(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (None, "x", 5), (1, "hello world", 5), (4, "a b " * 50_000, 5)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in T.encode_corpus(df).collect()}
    assert got[1] == [31373, 995] and got[2] == [] and got[3] == [] and len(got[4]) >= 100_000 and len(got) == 5
    assert T.encode_corpus(df.limit(0)).count() == 0
    totals = T.token_totals(T.encode_corpus(df)).first()
    assert totals.documents == 5 and totals.without_tokens == 2


rnd = random.Random(9)
VOCABULARY = ["the", "a", "of", "count", *(f"w{i}" for i in range(60))]
ITEMS = [(i, " ".join(rnd.choice(VOCABULARY) for _ in range(rnd.randint(9, 45))), "it is 42") for i in range(40)]


def truth(items, text):
    w = K.words(text)
    out = set()
    for i, t, _ in items:
        x = K.words(t)
        n = len(x)
        runs = {tuple(x[j : j + 13]) for j in range(n - 12)}
        if any(tuple(w[j : j + 13]) in runs for j in range(len(w) - 12)):
            out.add(i)
        if n and any(sum(a != b for a, b in zip(x, w[j : j + n])) <= n // 8 for j in range(len(w) - n + 1)):
            out.add(i)
    return out


def test_leaks_equal_brute_force():
    index = K.ItemIndex(ITEMS)
    for trial in range(400):
        words = [rnd.choice(VOCABULARY) for _ in range(rnd.randint(0, 260))]
        for _ in range(rnd.randint(0, 3)):
            x = K.words(rnd.choice(ITEMS)[1])
            kind = rnd.randint(0, 3)
            if kind == 0:
                part = x[: rnd.choice((11, 12, 13, 14))]
            elif kind == 1:
                part = [y if rnd.random() > 0.11 else "zz" for y in x]
            else:
                a = rnd.randint(0, max(len(x) - 13, 0))
                part = x[a : a + 13]
            at = rnd.randint(0, len(words))
            words[at:at] = part
        text = "\n> ".join([" ".join(words[:50]).upper(), ", ".join(words[50:])])
        assert {i for i, *_ in index.leaks(text)} == truth(ITEMS, text), trial


def test_wand_equals_full_scoring():
    index = K.ItemIndex(ITEMS)
    for _ in range(300):
        terms = list(dict.fromkeys(rnd.choice(VOCABULARY) for _ in range(rnd.randint(1, 40))))
        score = {}
        for t in terms:
            for d, s in zip(index.docs.get(t, ()), index.scores.get(t, ())):
                score[d] = score.get(d, 0.0) + s
        for limit in (0.3, 0.7, 1.0):
            assert sorted(index.search(terms, limit)) == sorted(d for d, s in score.items() if s >= limit)


def test_leak_table(spark):
    items = spark.createDataFrame([(1, "s", "t", ITEMS[0][1], "42", 0), (2, "s", "t", None, None, 0), (3, "s", "t", "", "x", 0), (1, "s", "t", ITEMS[0][1], "42", 0)], "item_id bigint, suite string, split string, text string, answer string, doc_id int")
    docs = spark.createDataFrame([(1, "intro\n* " + ITEMS[0][1].title() + " 42", 0), (2, None, 0), (3, "", 0), (4, "nothing", 0), (1, "intro\n* " + ITEMS[0][1].title() + " 42", 0), (5, "filler word " * 40_000 + ITEMS[0][1], 0)], "doc_id bigint, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in K.leaked_items(docs, items).collect()}
    assert got == {(1, 1), (5, 1)}
    report = {r.item_id: (r.documents, r.whole_copies, r.with_answer) for r in K.leaked_report(docs, items).collect()}
    assert report == {1: (2, 2, 1), 2: (0, 0, 0), 3: (0, 0, 0)}
    assert K.leaked_items(docs.limit(0), items).count() == 0 and K.leaked_items(docs, items.limit(0)).count() == 0
