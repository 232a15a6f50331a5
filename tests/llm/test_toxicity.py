import math
import re

import numpy as np
from pyspark.sql import functions as F
from strandline.llm.langid import in_training
from strandline.llm.textkit import word_hashes
from strandline.llm import toxicity
from strandline.llm.toxicity import fit, score

DATA = "/root/testdata/sf0.1/"


def auc(pairs):
    pos, neg = np.array([s for s, y in pairs if y]), np.array([s for s, y in pairs if not y])
    return float((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(DATA + "documents.parquet"), spark.read.parquet(DATA + "labels.parquet")
    held = ~in_training(F.col("doc_id"))
    model = fit(docs.where(~held), labels.where(~held))
    got = score(docs.where(held).select("doc_id", "text"), model).join(labels, "doc_id").select("score", "toxic", "offending").collect()
    assert auc([(r.score, r.toxic) for r in got]) > 0.95
    said = [r.score >= 0.3 for r in got]
    hit = sum(s and r.toxic for s, r in zip(said, got, strict=True))
    assert hit / sum(r.toxic for r in got) > 0.8 and hit / sum(said) > 0.9
    assert all(r.offending for r in got if r.score > 0.9)


def test_scores_equal_the_formula_word_by_word(spark):
    """The noisy-or once more with regular expressions and dictionaries, from the weights of the model."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = fit(docs, labels)
    weight = dict(zip(model.tokens.tolist(), model.weights.tolist(), strict=True))

    def hashed(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])

    for r in score(docs.select("doc_id", "text").where("doc_id % 10 = 0"), model).collect():
        none = 1.0
        for part in re.split(r"[.!?\n|]", r.text or ""):
            known = {h for h in map(hashed, re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", part)) if h in weight}
            if known:
                none *= 1 - 1 / (1 + math.exp(-model.bias - sum(weight[h] for h in known)))
        assert abs(r.score - (1 - none)) < 1e-9


def test_few_and_balanced_labels_give_a_model(spark):
    """No size of the label set switches the classifier off."""
    for n, step in ((12, 2), (24, 3), (40, 8)):
        rows = [(i, f"plain day {i}. awful fool" if i % step == 0 else f"plain day {i}. good friend", int(i % step == 0)) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        new = spark.createDataFrame([(1, "what a fool", 0), (2, "my friend", 0)], df.schema)
        a, b = (r.score for r in score(new, fit(df, df)).orderBy("doc_id").collect())
        assert a > 0.3 > b


def test_sentences_are_located(spark):
    rows = [(i, f"a calm day w{i}. you are an idiot. more text" if i % 6 == 0 else f"a calm day w{i}. more text", int(i % 6 == 0), "x") for i in range(180)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    model = fit(df, df)
    odd = [(1, "fine. YOU are an Idiot! fine", 0, "x"), (2, None, 1, "x"), (3, " .\n", 0, "x"), (4, "a calm day. " * 20000, 0, "x"), (1, "fine. YOU are an Idiot! fine", 0, "x")]
    got = score(spark.createDataFrame(odd, df.schema), model, names=("s", "found")).collect()
    assert [f.sentence for f in got[0].found] == ["YOU are an Idiot"] and got[0].s > 0.3 and got[0] == got[4]
    assert got[1].s == got[2].s == 0 and got[1].found == [] and got[3].s < 0.3
    assert score(df.limit(0), fit(df.limit(0), df), names=("s", "found")).count() == 0
    assert score(df, fit(df, df.limit(0)), names=("s", "found")).where("s >= 0.3").count() == 0


def test_sentences_are_located_where_half_is_toxic(spark):
    rows = [(i, f"a calm day w{i}. you are an idiot. more text" if i % 2 else f"a calm day w{i}. more text", i % 2, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    model = fit(df, df)
    odd = [(1, "fine. YOU are an Idiot! fine", 0, "x"), (2, None, 1, "x"), (4, "a calm day. " * 20000, 0, "x")]
    got = score(spark.createDataFrame(odd, df.schema), model, names=("s", "found")).collect()
    assert [f.sentence for f in got[0].found] == ["YOU are an Idiot"] and got[0].s > 0.3
    assert got[1].s == 0 and got[2].s < 0.3


def test_the_same_rows_give_the_same_sample(spark):
    """A bounded sample doesn't depend on the order of rows, on repeated ones or on how they are cut."""
    rows = [(i, f"word{i % 7} " + ("idiot fool" if i % 3 == 0 else "kind friend") + f" and more{i % 11}.") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    models = []
    for given in (rows, rows[::-1] + rows[:30]):
        m = fit(spark.createDataFrame(given, "doc_id long, text string").repartition(5), labels, sample=40)
        models.append((m.tokens.tolist(), m.weights.tolist(), m.bias))
    assert models[0] == models[1] and models[0][0]


def test_weights_are_those_of_a_plain_optimiser():
    """Small steps of plain gradient descent on the penalised noisy-or likelihood, one document after the other, end where training does."""
    rng = np.random.default_rng(3)
    docs = []
    for i in range(60):
        y, bag = i % 2, [rng.integers(10, 15, 3) for _ in range(3)]
        if y and i % 10 != 1:
            bag[1] = np.append(bag[1], 1 + i % 3)
        docs.append((y, np.concatenate(bag).astype(np.uint64), np.repeat(np.arange(3), [len(b) for b in bag])))
    held = toxicity.Sample(docs)
    every, tokens = np.ones(60, bool), np.isin(held.tokens, [1, 2, 3])
    names = held.tokens[tokens].tolist()
    theta = np.zeros(len(names) + 1)
    theta[-1] = -2.0

    def loss(t):
        total = 0.5 * 0.3 * float((t[:-1] ** 2).sum())
        for y, h, s in docs:
            z = [t[-1] + sum(t[names.index(x)] for x in set(h[s == k].tolist()) if x in names) for k in range(3) if any(x in names for x in h[s == k].tolist())]
            q = sum(math.log1p(math.exp(v)) for v in z)
            total += q if not y else -math.log(max(1e-9, 1 - math.exp(-q)))
        return total

    for _ in range(400):
        grad = np.array([(loss(theta + d) - loss(theta - d)) / 2e-5 for d in np.eye(len(theta)) * 1e-5])
        theta -= 0.05 * np.clip(grad, -2, 2)
    found = held.weights(every, tokens)
    assert loss(found) <= loss(theta) * 1.02 + 0.01
