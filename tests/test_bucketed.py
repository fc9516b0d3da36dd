from pyspark.sql import functions as F

from pagesift.operators import dedupe
from pagesift.sinks import store


def test_bucketed_history_avoids_history_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        name = "hist_bucketed_test"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        h = spark.range(0, 5000).select(
            F.sha2(F.col("id").cast("string"), 256).substr(1, 16).alias("fingerprint"),
            F.col("id").alias("seq"))
        store.create_bucketed_table(h, name, buckets=8)
        b = spark.range(0, 2000).select(
            F.sha2((F.col("id") * 3).cast("string"), 256).substr(1, 16).alias("fingerprint"),
            (F.col("id") + 10000).alias("seq"))
        plan = dedupe.anti_history(b, spark.table(name))._jdf.queryExecution().executedPlan().toString()
        hist_side = plan.split("Bucketed: true")[0].rsplit("\n", 2)[-1]
        assert "Bucketed: true" in plan
        assert "Exchange" not in hist_side
        n = store.insert_if_absent_table(b, name, order=["seq"])
        assert n == b.join(h, "fingerprint", "left_anti").count()
        assert store.insert_if_absent_table(b, name, order=["seq"]) == 0
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
