import random

import numpy as np
from pyspark.sql import functions as F

from packetloom.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train, held = (labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0), labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0))
    chain = toxicity.train(docs, train)
    said = {r.doc_id: r.toxic for r in toxicity.score(docs, chain).collect()}
    truth = {r.doc_id: r.toxic == 1 for r in held.collect()}
    right = [said[d] == t for d, t in truth.items()]
    assert sum(right) / len(right) > 0.98
    assert sum(said[d] and not t for d, t in truth.items()) <= 2


def planted(spark, n=600):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = draw.choices(words, k=40)
        rude, grim = draw.random() < 0.3, draw.random() < 0.3
        if rude:
            text.insert(draw.randrange(40), "zzvil" + draw.choice(["a", "en", "os"]))
        if grim and rude:
            text.insert(draw.randrange(40), "yygrim")
        rows.append((i, " ".join(text)))
        labels.append((i, int(rude), int(rude and grim)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rude int, grim int")


def test_chain_feeds_earlier_categories(spark):
    docs, labels = planted(spark)
    chain = toxicity.train(docs, labels, order=("rude", "grim"))
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.out_of_fold.shape[1] == 2
    got = toxicity.score(docs, chain).join(labels.withColumnRenamed("grim", "is_grim"), "doc_id").collect()
    assert np.mean([(r.p_rude > 0.5) == (r.rude == 1) for r in got]) > 0.98
    assert np.mean([r.grim == (r.is_grim == 1) for r in got]) > 0.98
    fresh = spark.createDataFrame([(1, " ".join(["abcdef"] * 38) + " zzvilunheard yygrim"), (2, " ".join(["something else"] * 20))], "doc_id long, text string")
    assert {r.doc_id: r.grim for r in toxicity.score(fresh, chain).collect()} == {1: True, 2: False}


def test_no_labels_one_class_and_odd_rows(spark, odd, none, docs):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (9, None, 1), (77, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        chain = toxicity.train(odd, l)
        assert toxicity.score(odd, chain).count() == odd.count()
        kept = toxicity.reject(odd, chain)
        assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.score(none, chain).count() == 0 and toxicity.reject(none, chain).count() == 0


def test_sample_is_bounded(spark):
    docs, labels = planted(spark)
    assert toxicity.sampled(docs, labels, ("rude", "grim"), 50).count() == 50


def plain_choice(rows, y, most):
    """The best features by the chi-squared statistic of their two-by-two tables."""
    n, k, out = len(rows), sum(y), {}
    for word in set().union(*rows):
        both = sum(t for r, t in zip(rows, y) if word in r)
        here = sum(word in r for r in rows)
        table = [(both, here - both), (k - both, n - k - here + both)]
        want = [(here * k / n, here * (n - k) / n), ((n - here) * k / n, (n - here) * (n - k) / n)]
        if here >= toxicity.LEAST_DOCS and here < n:
            out[word] = sum((o - e) ** 2 / e for os, es in zip(table, want) for o, e in zip(os, es))
    best = sorted((w for w in out if out[w] >= toxicity.LEAST_CHI2 - 1e-9), key=lambda w: (-round(out[w], 6), w))
    return best[:most]


def plain_fit(x, y, penalty=1.0):
    """Penalised logistic regression by Newton steps, over columns of one size."""
    size = np.sqrt((x * x).mean(0)) + 1e-3
    x, w, ridge = x / size, np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 1e-9
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
    return w / size


def test_chain_by_plain_python(spark):
    """Features, folds, out-of-fold probabilities and final models by a second, plain implementation."""
    docs, labels = planted(spark, 400)
    order = ("rude", "grim")
    chain = toxicity.train(docs, labels, order=order)
    truth = {r.doc_id: (r.rude, r.grim) for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    made = {d: toxicity.features(texts[d]) for d in ids}
    fold = np.array([toxicity.crc32(texts[d].encode()) % toxicity.FOLDS for d in ids])
    words, dense = [made[d][0] for d in ids], np.array([made[d][1] for d in ids])
    ys = np.array([truth[d] for d in ids], float)

    def design(of):
        own = [w for w, use in zip(words, of) if use]
        chosen = sorted(set().union(*(plain_choice(own, ys[of, c].tolist(), toxicity.FEATURES) for c in (0, 1))))
        centre, scale = dense[of].mean(0), np.maximum(dense[of].std(0), 1e-6)
        hot = np.array([[w in r for w in chosen] for r in words], float).reshape(len(ids), -1)
        return chosen, np.hstack([np.ones((len(ids), 1)), hot, np.clip((dense - centre) / scale, -5, 5)])

    every = np.ones(len(ids), bool)
    chosen, x = design(every)
    assert set(chosen) == set(chain.vocabulary)
    folds = [design(fold != k)[1] for k in range(toxicity.FOLDS)]
    earlier, final = np.zeros((len(ids), 0)), np.zeros((len(ids), 0))
    for c in (0, 1):
        p = np.zeros((len(ids), 1))
        for k, each in enumerate(folds):
            own, out = np.hstack([each, earlier]), fold == k
            p[out, 0] = 1 / (1 + np.exp(-own[out] @ plain_fit(own[~out], ys[~out, c])))
        w = plain_fit(np.hstack([x, earlier]), ys[:, c])
        final = np.hstack([final, 1 / (1 + np.exp(-np.hstack([x, final]) @ w))[:, None]])
        earlier = np.hstack([earlier, p])
    got = {r.doc_id: (r.p_rude, r.p_grim) for r in toxicity.score(docs, chain).collect()}
    assert np.abs(np.array([got[d] for d in ids]) - final).max() < 0.05
    by_fold = np.array(sorted(chain.out_of_fold[:, 1]))
    assert np.abs(by_fold - np.sort(earlier[:, 1])).max() < 0.05


def test_rows_that_repeat_a_doc_id_are_one_training_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.sampled(docs, labels, ("quality", "toxic"), 2).count() == 2
    assert toxicity.sampled(docs, labels, ("quality", "toxic"), 10).count() == 3
