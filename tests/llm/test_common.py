from carrel.llm import common


def test_stored_tables_are_cleaned(spark):
    common.clean(spark)
    df = common.stored(spark.range(5).withColumnRenamed("id", "a"), "t")
    assert df.count() == 5 and common.clean(spark) == 1 and common.clean(spark) == 0


def test_word_count(spark):
    rows = [(1, "a b\u00a0c\x0bd"), (2, None), (3, " \n")]
    d = spark.createDataFrame(rows, "k long, text string")
    assert [r.n for r in d.select("k", common.word_count(d["text"]).alias("n")).orderBy("k").collect()] == [3, 0, 0]


def test_scopes(spark):
    common.clean(spark)
    with common.scope(spark):
        inner = common.stored(spark.range(3), "inner")
        kept = common.stored(inner, "kept", keep=True)
        assert inner.count() == 3
    assert kept.count() == 3 and common.clean(spark) == 1


def test_spread_join_on_either_side_of_its_bounds(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 3, i) for i in range(12)] + [(9, 99)], "k long, v long")
    table = spark.createDataFrame([(0, "a", 4), (1, "b", 4), (2, "c", 1)], "k long, x string, rows long")
    want = {how: sorted(map(tuple, rows.join(table.drop("rows"), ["k"], how).collect()), key=str) for how in ("inner", "left")}
    for broadcast, hot in ((10, 10), (0, 10), (0, 2)):
        monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        for how in want:
            got = common.spread_join(rows, table, ["k"], how).select("k", "v", "x")
            assert sorted(map(tuple, got.collect()), key=str) == want[how]
