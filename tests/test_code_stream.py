"""Single-use codes as a stream's state give what the same rule gives over the whole table."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from labelforge.operators import products
from labelforge.streaming import events as feed


def test_stream_of_codes_equals_the_table(spark, tmp_path):
    rng, at, rows = random.Random(6), datetime(2024, 1, 1), []
    for i in range(400):
        at += timedelta(minutes=rng.randint(0, 9))
        rows.append((i, rng.choice([1, 2, 3, 4, None]), at, rng.choice(["issue", "right", "wrong", "wrong", "wrong", None])))
    schema = "event_id long, user_id long, ts timestamp, kind string"
    for n in range(4):  # four files, read one a micro-batch, in order of time
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    kind = F.col("kind")
    out = feed.code_attempts(stream, "user_id", "event_id", "ts", kind == "issue", kind == "right", timedelta(minutes=30), 3)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else it waits for the last timeout
    try:
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(100)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {(r.event_id, r.owner, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = products.code_attempts(spark.createDataFrame(rows, schema).where("user_id is not null"), "user_id", ["ts", "event_id"], "ts", kind == "issue", kind == "right", "30 minutes", 3)
    want = {(r.event_id, r.user_id, r.status) for r in whole.collect()}
    assert got == want and {s for _, _, s in got} == {"ACCEPTED", "WRONG", "EXPIRED"}
