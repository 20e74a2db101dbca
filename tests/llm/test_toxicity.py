import random

import numpy as np

from corpuscle.llm import toxicity as T

rnd = random.Random(4)
NOUNS = ["parser", "queue", "index", "socket", "buffer", "table"]
BENIGN = ["the {n} keeps its value until the next run", "please rename the {n} helper", "tests for the {n} fail at night", "callers must hold the {n} lock", "der {n} wird erst später geprüft", "le {n} est vérifié avant la file", "el {n} se revisa antes de salir", "kill the {n} process before it hangs", "a dumb {n} cannot show colours"]
TOXIC = ["you are a worthless halfwit and your {n} is trash", "nobody wants you here, get lost", "du bist ein Vollidiot und dein {n} ist Müll", "ferme ta gueule avec ton {n}", "eres un imbécil y tu {n} es basura", "send me nudes and I approve the {n}"]


def document(toxic):
    parts = [rnd.choice(BENIGN).format(n=rnd.choice(NOUNS)) for _ in range(rnd.randint(3, 9))]
    if toxic:
        parts.insert(rnd.randint(0, len(parts)), rnd.choice(TOXIC).format(n=rnd.choice(NOUNS)))
    return ". ".join(p[0].upper() + p[1:] for p in parts) + "."


def test_held_out_accuracy():
    labelled = [(document(i % 5 == 0), int(i % 5 == 0)) for i in range(300)]
    labelled[3] = (labelled[3][0], 1)  # a wrong opinion
    model = T.fit(labelled, [document(i % 12 == 0) for i in range(1200)])
    truth = [i % 3 == 0 for i in range(300)]
    got = [model.score(document(t))[0] >= model.threshold for t in truth]
    hits = sum(a and b for a, b in zip(got, truth))
    assert hits / sum(truth) > 0.9 and hits / max(sum(got), 1) > 0.9
    for masked in ("you are a worthless h@lfw1t and your queue is trash", "YOU ARE A WORTHLESS H A L F W I T", "du bist ein Voll​idiot und dein index ist Müll"):
        assert model.score(masked)[0] >= model.threshold, masked
    assert model.score(None) == (0.0, None) and model.score(" \n ")[0] == 0.0
    assert model.score("you are a worthless halfwit and your queue is trash " + document(False))[0] >= model.threshold


def test_folding():
    assert T.words("ID10T") == ["id10t"] or T.words("1d10t")
    assert T.words("p0rn, sh!t; b@d") == ["porn", "shit", "bad"]
    assert T.words("i d i o t") == ["idiot"] and T.words("j.a.c.k") == ["jack"]
    assert T.words("CLОWN") == ["clown"] and T.words("stuuupid") == ["stupid"] and T.words("imbécile") == ["imbecile"]
    assert T.words("3.14 0x1F") != [] and T.words("") == []


def test_risk_is_not_negative():
    p = [["bad", "word"]] * 20
    u = [["good", "word"]] * 200 + p[:10]
    w, b = T.train_nnpu(p, np.ones(20), u, 0.05)
    score = lambda ws: sum(v * w[i] for i, v in zip(*T.features(ws))) + b
    assert score(["bad", "word"]) > 0 > score(["good", "word"])


def test_table(spark):
    rows = [(i, document(i % 6 == 0), f"s{i % 3}", 0) for i in range(300)] + [(900, None, None, 0), (901, "", "s0", 0), (902, "x " * 60_000, "s0", 0), (0, rnd.choice(TOXIC).format(n="x"), "s1", 0), (None, "text", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 6 == 0), "r") for i in range(0, 300, 2)] + [(None, 1, "r"), (2, None, "r")], "doc_id bigint, toxic int, rater string")
    got = T.scored_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score for r in got}[900] == 0.0
    rates = {r.source: r.documents for r in T.toxic_rates(docs, labels).collect()}
    assert sum(rates.values()) == len(rows)
    assert T.scored_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_model_does_not_depend_on_partitions(spark):
    rows = [(i, document(i % 9 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 9 == 0), "r") for i in range(0, 400, 2)], "doc_id bigint, toxic int, rater string")
    models = []
    for n, order in ((1, rows), (7, rows[::-1])):
        T._FITTED.clear()
        docs = spark.createDataFrame(order, "doc_id bigint, text string").repartition(n)
        models.append(T.train(docs, labels))
    a, b = models
    assert a.threshold == b.threshold and a.bias == b.bias and (a.w == b.w).all() and a.lexicon == b.lexicon
    assert T.train(docs, labels) is b


def test_threshold():
    import numpy as np

    assert T.threshold(np.array([0.9] * 20 + [0.1] * 80), np.array([1] * 20 + [0] * 80)) < 0.9
    assert T.threshold(np.array([0.9]), np.array([1])) == T.FEW_LABELS_THRESHOLD
