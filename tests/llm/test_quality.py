import random

import numpy as np

from folium.llm import quality as Q


def corpus(n=1500, seed=1):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 9))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(3, 300))]
        bad = i % 5 == 0
        if bad:
            kind = i // 5 % 3
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "$$$" for w in words] if kind == 1 else [w for w in words for _ in range(8)]
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy(spark, frame):
    rows, labels = corpus()
    truth = {i: 0 if i % 5 == 0 else 1 for i, _ in rows}
    docs = frame([*rows, (9001, None), (9002, ""), rows[4]])
    marks = spark.createDataFrame([*labels, (5, None, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = [r for r in Q.score_documents(docs, Q.train(docs, marks)).collect()]
    assert len(got) == len(rows) + 3
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_gradients():
    rnd = np.random.default_rng(0)
    model = Q.Attention(3)
    x, starts = rnd.standard_normal((9, Q.WIDTH)), np.array([0, 2, 3, 9])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    y, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        p = model.forward(x, starts)["y"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = model.gradients(model.forward(x, starts), y, weight)
    for k in g:
        flat = model.p[k].reshape(-1)
        for i in rnd.integers(0, flat.size, 4):
            was, e = flat[i], 1e-5
            flat[i] = was + e
            up = loss()
            flat[i] = was - e
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * e) - g[k].reshape(-1)[i]) < 1e-5


def test_without_labels_or_rows(spark, frame):
    rows, _ = corpus(10)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(rows)
    assert {r.score for r in Q.score_documents(docs, Q.train(docs, none)).collect()} == {1.0}
    assert Q.keep_good(docs, None).count() == 10
    assert Q.score_documents(docs.where("false"), Q.Attention()).count() == 0


def test_filter_keeps_columns(spark, frame):
    rows, labels = corpus()
    docs = frame([*rows, (9001, None)])
    model = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = Q.keep_good(docs, model)
    assert kept.schema == docs.schema
    scores = {r.doc_id: r.predicted for r in Q.score_documents(docs, model).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if p == 1}
