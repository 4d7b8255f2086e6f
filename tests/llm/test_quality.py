import zlib

import numpy as np

from carrel.llm import quality as q
from tests.conftest import SMALL


def test_held_out_accuracy(spark):
    folder = SMALL.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = q.train(docs, labels)
    assert 0.75 < model.prior < 0.95
    rows = q.scored(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and np.mean([r.predicted == r.quality for r in held]) > 0.93


def test_labels_0_and_held_out_labels_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    kept = labels.where("quality = 1 AND crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1")
    assert (q.train(docs, labels).weight == q.train(docs, kept).weight).all()


def test_prior_of_separable_samples():
    r = np.random.default_rng(3)
    p = np.concatenate((r.normal(2, 1, (600, 3)), np.ones((600, 1))), 1)
    n = np.concatenate((r.normal(-2, 1, (300, 3)), np.ones((300, 1))), 1)
    assert abs(q.estimate_prior(p[:300], np.concatenate((p[300:], n))) - 0.5) < 0.1


def test_oddities(spark, docs, empty):
    model = q.train(docs, spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int"))
    rows = q.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert q.scored(empty, model).count() == 0
    none = q.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in q.scored(docs, none).collect()} == {0.5}
    assert q.keep_good(docs, none).columns == docs.columns
    assert (q.features(None) == 0).all() and (q.features("") == 0).all()


def test_bounds_hold_for_repeated_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "fit", lambda p, u: seen.append((len(p), len(u))))
    rows = [(i % 7, f"text {i} of a row whose id is that of many others") for i in range(3000)] + [(100 + i, f"text {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in list(range(7)) * 20 + list(range(100, 400))], "doc_id long, quality int")
    q.train(docs, labels, 50, 120)
    assert seen == [(50, 120)]
    q.train(docs, labels)
    ids = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert seen[1] == (len({i for i in ids if i < 400}), len(ids))


def test_fit_minimises_the_risk_as_stated():
    """The non-negative unbiased risk, worked out row by row: the fitted weights are where it is least."""
    r = np.random.default_rng(4)
    p, u = np.zeros((300, q.N)), np.zeros((500, q.N))
    p[:, :3] = r.normal(1, 1, (300, 3))
    u[:, :3] = np.concatenate((r.normal(1, 1, (300, 3)), r.normal(-1, 1, (200, 3))))
    model = q.fit(p, u, prior=0.6)

    def risk(weight, bias):
        z = lambda x: [float(q._expand((row - model.mean) / model.scale) @ weight + bias) for row in x]
        loss = lambda v: float(np.logaddexp(0, -v))
        zp, zu = z(p), z(u)
        negative = sum(loss(-v) for v in zu) / len(zu) - 0.6 * sum(loss(-v) for v in zp) / len(zp)
        return 0.6 * sum(loss(v) for v in zp) / len(zp) + max(0.0, negative) + 5e-4 * (float(weight @ weight) + bias * bias)

    least = risk(model.weight, model.bias)
    assert least < risk(np.zeros_like(model.weight), 0.0) - 0.1
    for k in (0, 1, 2, q.N, q.N + 1):
        for step in (-0.3, 0.3):
            w = model.weight.copy()
            w[k] += step
            assert risk(w, model.bias) > least - 1e-3
    assert risk(model.weight, model.bias + 0.3) > least - 1e-3 and risk(model.weight, model.bias - 0.3) > least - 1e-3


def test_training_takes_little_of_the_driver():
    import tracemalloc

    x = np.random.default_rng(3).gamma(2, 1, (20_000, q.N)).astype(np.float32)
    tracemalloc.start()
    q.fit(x[:8_000], x[8_000:], steps=1, prior=0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The rows as doubles and what their deviation takes; not one more copy for each step of the features.
    assert peak <= 2.3 * 2 * x.nbytes
