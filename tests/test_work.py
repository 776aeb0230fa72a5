from pyspark.sql import functions as F


def test_a_written_table_leaves_no_shuffle_files(spark, work):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}

    before = held()
    counts = work.table(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    assert not held() - before and counts.count() == 10
