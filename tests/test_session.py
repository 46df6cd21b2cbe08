"""Tables written to the scratch folder."""

import time

from pyspark.sql import functions as F

from passagemill.session import persist_table


def test_written_tables_leave_no_shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    names = lambda: {file.getName() for file in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles())}
    before = names()
    table = persist_table(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "released")
    for _ in range(50):
        left = [name for name in names() - before if name.startswith("shuffle_")]
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 10
