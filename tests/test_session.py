import os

from pyspark.sql import functions as F

from logweave.operators.hot_keys import hot_keys, look_up
from logweave.session import checkpointed, inner_tables, kept


def _folder(df):
    return os.path.dirname(df.inputFiles()[0]).removeprefix("file://")


def test_inner_tables_keep_what_they_are_told(spark):
    with inner_tables(spark):
        first = checkpointed(spark.range(10))
        with inner_tables(spark):
            second = checkpointed(first.filter("id > 3"))
            third = kept(second.filter("id > 5"))
            gone = _folder(second)
        assert not os.path.exists(gone) and third.count() == 4
        inner, last = _folder(third), kept(third.filter("id > 7"))
        before = _folder(first)
    assert not os.path.exists(before) and not os.path.exists(inner)
    assert sorted(r.id for r in last.collect()) == [8, 9]


def test_inner_tables_stay_after_an_error(spark):
    try:
        with inner_tables(spark):
            table = checkpointed(spark.range(3))
            raise ValueError
    except ValueError:
        assert table.count() == 3


def test_shuffles_of_a_written_table_are_no_setting_of_the_session(spark):
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(conf)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert checkpointed(counted).count() == counted.count() == 7
    assert spark.conf.get(conf) == before


def test_look_up_deals_hot_keys_and_loses_no_row(spark):
    rows = checkpointed(spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50).alias("k")))
    table = spark.range(-1, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(rows, ["k"], least=100)
    assert [(r.k, r["_copies"]) for r in hot.collect()] == [(-1, 14)]
    for how in ("inner", "left"):
        got = look_up(rows, table, ["k"], F.col("id"), hot, how)
        want = rows.join(table, "k", how)
        assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, want.select("id", "k", "v").collect()))
    assert hot_keys(rows, ["k"], least=4000) is None and hot_keys(rows.limit(0), ["k"]) is None
