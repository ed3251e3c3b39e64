"""Tables that cut a plan leave no shuffle files behind."""

import os

from pyspark.sql import functions as F

from targetloom import session


def test_shuffles_behind_a_written_table_are_dropped(spark):
    def shuffled():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        folders = [d.getPath() for d in manager.localDirs()]
        return {f for top in folders for _, _, files in os.walk(top) for f in files if f.startswith("shuffle_") and f.endswith(".data")}

    before = shuffled()
    rows = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    cut = session.cut_lineage(rows)
    assert shuffled() <= before
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, rows.collect()))
    assert spark.conf.get(session._CLEANUP, None) in (None, "false")
