from concurrent.futures import ThreadPoolExecutor

from compare import rows

from skein.llm import common, queries

SF = "/root/testdata/sf0.001"


def test_queries_in_threads_of_one_session(spark):
    names = ["op1_mix", "op5_context_mixing", "op7_bag_minhash", "op11_overlap_join"]
    run = lambda name: rows(queries.queries()[name](spark, SF).toPandas())
    alone = list(map(run, names))
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(run, names)) == alone


def test_scopes_of_threads_keep_apart(spark):
    def use(k):
        with common.scope(spark) as keep:
            kept = keep(common.written(spark.range(k + 1), "kept"))
            gone = common.written(spark.range(5), "gone")
            with common.scope(spark) as inner:
                passed = inner(common.written(spark.range(7), "passed"))
            assert gone.count() == 5 and passed.count() == 7
        return kept, gone, passed

    with ThreadPoolExecutor(4) as pool:
        for k, (kept, gone, passed) in enumerate(pool.map(use, range(4))):
            assert kept.count() == k + 1
            for df in (gone, passed):  # what an inner scope kept goes with the outer one
                at = spark._jvm.org.apache.hadoop.fs.Path(df._written)
                assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
