import os

from sheafline.plans.storage import drop_stored, once, shared_dir, stored


def test_stored_tables_are_read_back_and_dropped(spark):
    a, b = stored(spark.range(5)), stored(spark.range(3))
    assert a.count() == 5
    folder = shared_dir(spark).removeprefix("file://") + "/tables"
    before = set(os.listdir(folder))
    drop_stored(a)
    assert before - set(os.listdir(folder)) == {a.stored_at.rsplit("/", 1)[1]}
    assert b.count() == 3


def test_rows_of_equal_keys_stand_once_and_only_keys_are_shuffled(spark):
    rows = [(i % 7, i % 7 < 3, [i] * 50) for i in range(30)]
    kept = once(spark.createDataFrame(rows, "a long, b boolean, wide array<long>"), "a", "b")
    assert sorted((r.a, r.b, len(r.wide)) for r in kept.collect()) == sorted({(a, b, 50) for a, b, _ in rows})
    assert kept.select("row").distinct().count() == 7
    single = once(spark.createDataFrame(rows[:7], "a long, b boolean, wide array<long>"), "a", "b")
    assert single.count() == 7 and "Exchange" not in single._jdf.queryExecution().toString()
