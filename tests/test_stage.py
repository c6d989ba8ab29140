"""Stage tables: written under the session's checkpoint folder, built once, reused by a new store
of the same application."""

from tillroll.sources.stage import StageStore, checkpoint_root


def test_stage_built_once_and_reused(spark):
    root = checkpoint_root(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert configured and root == configured.rstrip("/")
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).withColumnRenamed("id", "x")

    store = StageStore(spark, "test-stage-key")
    assert store.root.startswith(root)
    first = store.stage("numbers", build)
    again = store.stage("numbers", build)
    assert first.count() == 10 and again.count() == 10 and len(calls) == 1
    # a new store with the same key in the same application finds the written stage (its _SUCCESS)
    assert StageStore(spark, "test-stage-key").stage("numbers", build).count() == 10 and len(calls) == 1
    # a different key gets its own folder
    assert StageStore(spark, "other-key").stage("numbers", build).count() == 10 and len(calls) == 2


def test_scratch_scope(spark):
    from tillroll.operators.ranking import global_row_number
    from tillroll.sources.stage import _exists, scratch_path, scratch_scope, write_stage
    out = scratch_path(spark, "result")
    with scratch_scope(spark):
        inner = scratch_path(spark, "inner")
        write_stage(spark.range(3), inner)
        with scratch_scope(spark):
            numbered, n = global_row_number(spark.range(50), ["id"])
            write_stage(numbered, out)
        assert _exists(spark, inner)
    assert n == 50 and spark.read.parquet(out).count() == 50 and not _exists(spark, inner)


def test_a_write_leaves_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F
    from tillroll.sources.stage import scratch_path, write_stage
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {blocks.apply(i).name() for i in range(blocks.size()) if blocks.apply(i).isShuffle()}

    def left(write):
        before = shuffles()
        write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count"))
        until = time.time() + 20
        while shuffles() - before and time.time() < until:
            time.sleep(0.2)
        return shuffles() - before

    own = spark.conf.get(setting)
    assert not left(lambda df: write_stage(df, scratch_path(spark, "shuffled")))
    assert not left(lambda df: StageStore(spark, "test-shuffles").stage("shuffled", lambda: df))
    assert spark.conf.get(setting) == own
    spark.conf.set(setting, "true")
    write_stage(spark.range(3), scratch_path(spark, "small"))
    assert spark.conf.get(setting) == "true"
    spark.conf.set(setting, own)
