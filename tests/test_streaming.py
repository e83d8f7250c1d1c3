"""The stream's windows add up to the batch's."""

from pyspark.sql import functions as F

from ledgerspark.sources.tables import event_transactions
from ledgerspark.streaming.live import windowed_totals

DATA = "/root/testdata/sf0.001"


def test_windowed_totals(spark, tmp_path):
    tx = event_transactions(spark, DATA).withColumn("ts", F.col("ts").cast("timestamp"))
    tx.write.parquet(str(tmp_path / "in"))
    stream = windowed_totals(spark.readStream.schema(tx.schema).parquet(str(tmp_path / "in")), "1 day", "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("totals").agg(F.sum("total")).first()[0]
    want = tx.agg(F.sum(F.abs("price"))).first()[0]
    assert abs(got - want) < 0.01
