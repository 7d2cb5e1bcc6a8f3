"""Filters over keys, tables that are deleted in time, folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.llm import common


def test_filters_hold_every_key(spark):
    keys = [0, 1, -1, 7, 8, 32_767, 32_768, common.FILTER_BITS - 1, -(1 << 62) + 5]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    probes = spark.createDataFrame([(k + d,) for k in keys for d in (0, 2, 100)], "p long")
    got = {r.p: r.may for r in common.may_hold(probes, common.key_bitmaps(frame, "k"), "p", "may").collect()}
    held = {k % common.FILTER_BITS for k in keys}
    assert got == {p: p % common.FILTER_BITS in held for p in got} and set(got.values()) == {True, False}
    bits = common.key_filter(frame, "k")
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == sorted(held)
    assert not any(r.may for r in common.may_hold(probes, common.key_bitmaps(frame.limit(0), "k"), "p", "may").collect())


def test_tables_go_with_their_block(spark):
    def there(df):
        return os.path.exists(df._veldra_path.removeprefix("file:"))

    with common.tables():
        inner = common.materialize(spark.range(3), "inner")
        outer = common.kept(spark.range(4), "outer")
        assert there(inner) and there(outer)
    assert not there(inner) and there(outer) and outer.count() == 4
    common.clear(spark)
    assert not there(outer)


def test_batches_are_small_unless_asked_otherwise(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "77")
    common.small_batches(spark)
    assert spark.conf.get(key) == "77"
    spark.conf.set(key, "10000")
    common.small_batches(spark)
    assert spark.conf.get(key) == str(common.BATCH_ROWS)
    spark.conf.set(key, before)


@pytest.mark.parametrize(
    "master, conf, want",
    [
        ("local[4]", {}, "file:/w"), ("yarn", {}, None), ("local-cluster[3,2,1000]", {}, None), ("yarn", {"spark.sql.warehouse.dir": "hdfs:///w/"}, "hdfs:///w"),
        ("yarn", {"spark.checkpoint.dir": "s3://b/c/"}, "s3://b/c"), ("local[*]", {"spark.checkpoint.dir": "/c"}, "/c"),
    ],
)
def test_no_local_folder_on_a_cluster(master, conf, want):
    class Session:
        class sparkContext:  # noqa: N801
            pass

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return ({"spark.sql.warehouse.dir": "file:/w"} | conf_of_case).get(key, default)

    conf_of_case = conf
    Session.sparkContext.master = master
    if want:
        assert common.shared_dir(Session) == want
    else:
        with pytest.raises(ValueError):
            common.shared_dir(Session)


def test_small_tables_are_few_files(spark):
    made = common.materialize(spark.range(1000).repartition(40, "id").groupBy((F.col("id") % 50).alias("k")).count(), "small")
    assert made.rdd.getNumPartitions() <= 4 and made.count() == 50
