import pytest

from carrel.llm import mixing as mx


def fill(sizes, weights):
    """Targets by sharing the excess again and again."""
    total, out, left = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while left:
        level = (total - sum(out[i] for i in range(len(sizes)) if i not in left)) / sum(weights[i] for i in left)
        full = {i for i in left if level * weights[i] > 3 * sizes[i]}
        if not full:
            for i in left:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = 3 * sizes[i]
        left -= full
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 100], [1, 2, 300], [1, 1, 1, 500], [7], [0, 5, 5], [1, 1000, 1, 1, 1, 1]])
def test_targets(spark, sizes):
    rows = [(chr(97 + i) if i < len(sizes) - 1 or len(sizes) == 1 else None, s) for i, s in enumerate(sizes)]
    got = {r.source: r.target for r in mx.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [got[k] for k, _ in rows] == pytest.approx(want, abs=1e-5)


def test_taken(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "abcdef"[i % 6 if i % 3 else 0]) for i in range(400)]
    out = mx.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in out:
        assert r.taken <= 3 * r.size
        by.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), rs in by.items():
        assert sum(r.taken for r in rs) == int(target) or len(rs) > 400 / 6
        assert sum(r.size for r in rs) % size == 0
    at = [r.position for r in out if r.position is not None]
    assert at == sorted(at) and all(0 <= p <= 1 for p in at)


def test_schedule_is_inverted(spark):
    """Positions follow G(t) = (1 + a) t - a t^2: words taken up to t are G(t) of the target."""
    rows = [(i, "w", s) for i, s in enumerate(["a"] * 900 + ["c"] * 300)]
    d = mx.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for size, a in ((900, 0.5), (300, 0.0)):
        parts = [p for r in d.where(f"source_size = {size}").collect() for p in r.parts]
        n, early = len(parts), sum(p.position < 0.5 for p in parts)
        a = a if size == 900 else 0.0
        assert abs(early / n - ((1 + a) * 0.5 - a * 0.25)) < 0.02


def test_mixed_documents(spark):
    rows = [(1, "one  two\nthree four", "a", 5), (2, "x y z", "b", 6), (3, None, "b", None), (4, "", "a", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    taken = {r.doc_id: r.taken for r in mx.mix(d).collect()}
    out = mx.mixed_documents(d)
    assert out.columns == d.columns
    words = {}
    for r in out.collect():
        assert rows[r.doc_id - 1][1].startswith(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {k: v for k, v in taken.items() if v}


def test_oddities(spark, docs, empty):
    out = mx.mix(docs)
    assert out.count() == docs.count() and mx.mix(empty).count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, mx.mix(docs.repartition(5)).collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_without_id_and_ties(spark):
    """Rows without id are dealt by their texts; rows of one id and size have an order, so reruns take the same texts."""
    rows = [(None, f"text {i} of a row without id", "a") for i in range(60)] + [(7, f"{w} same size", "b") for w in ("one", "two", "three", "four")] + [(8, "x " * 40, "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = (sorted(map(str, mx.mixed_documents(x).collect())) for x in (d, d.repartition(7)))
    assert once == again
    assert mx.mix(d).where("doc_id IS NULL").count() == 60


def test_buckets_follow_the_rows():
    assert [mx._digits(n) for n in (0, 1 << 18, 1 << 30, 1 << 36, 10**11)] == [3, 3, 3, 5, 5]


def test_texts_are_shuffled_twice(spark):
    """Once to the windows, once to the training order: the join with the buckets leaves them where they are. Null sources meet as others do."""

    def nodes(node):
        children = node.children()
        return [node, *(x for i in range(children.size()) for x in nodes(children.apply(i)))]

    d = spark.createDataFrame([(1, "a b c", None), (2, "d e", None), (3, "f", "n"), (4, "g h", "")], "doc_id long, text string, source string")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = mx.mixed_documents(d)
        plan = nodes(out._jdf.queryExecution().executedPlan())
        assert sum(n.nodeName() == "Exchange" and "text" in n.output().mkString(",") for n in plan) == 2
        sizes = {r.doc_id: r.source_size for r in mx.mix(d).collect()}
        assert sizes == {1: 5, 2: 5, 3: 1, 4: 2}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
