"""What stored tables leave on disk."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from loomgraph.storage import SHUFFLE_CLEANUP, stored


def shuffled(spark):
    folder = Path(spark.sparkContext.getConf().get("spark.local.dir"))
    return {p for p in folder.rglob("shuffle_*.data")}


def test_shuffle_files_go_with_the_write(spark):
    before = shuffled(spark)
    setting = spark.conf.get(SHUFFLE_CLEANUP, None)
    rows = spark.range(100_000).withColumn("k", F.xxhash64("id"))
    counts = rows.groupBy("k").agg(F.max("id").alias("most"))
    out = stored(rows.repartition(7, "k").join(counts, "k"), "shuffled")
    end = time.time() + 20
    while shuffled(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert out.where("id = most").count() == 100_000


def test_cached_frames_stay_readable(spark):
    """What the caller has cached, and what is made from it afterwards."""
    cached = spark.range(20_000).withColumn("k", F.col("id") % 97).groupBy("k").agg(F.sum("id").alias("total")).cache()
    assert stored(cached.where("k < 50"), "cached").count() == 50
    assert cached.count() == 97 and stored(cached.join(cached.where("k > 90").select("k"), "k"), "cached").count() == 6
    cached.unpersist()
    assert cached.agg(F.sum("total")).first()[0] == 20_000 * 19_999 // 2
