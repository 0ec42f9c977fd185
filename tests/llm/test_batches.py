"""Arrow batches are bounded by bytes, and a bound that the session sets stays."""

import pyarrow as pa

from tracewell.llm import common


def test_batches_are_bounded(spark):
    before = spark.conf.getAll.get(common._BATCH_SETTING)
    spark.conf.unset(common._BATCH_SETTING)
    try:
        d = spark.range(90).selectExpr("repeat('x', 100000) AS text").coalesce(1)
        types = {"rows": pa.int64()}
        sizes = [r.rows for r in common.map_batches(d, ["text"], lambda b: iter([common.batch_of({"rows": [b.num_rows]}, types)]), "rows long").collect()]
        assert sum(sizes) == 90 and max(sizes) <= common.BATCH_BYTES // 100_000 + 1
        spark.conf.set(common._BATCH_SETTING, "12345")
        common.bounded_batches(spark)
        assert spark.conf.get(common._BATCH_SETTING) == "12345"
    finally:
        spark.conf.unset(common._BATCH_SETTING)
        if before is not None:
            spark.conf.set(common._BATCH_SETTING, before)
