"""Streams over files, driven to their end."""

from pyspark.sql import functions as F

from tidemark.sources import tables
from tidemark.streaming import memory

SF = "/root/testdata/sf0.001"


def stream(spark, name):
    batch = spark.read.parquet(f"{SF}/{name}.parquet")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", f"{name}.parquet").parquet(SF)


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def events(spark):
    return stream(spark, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


def test_access_counts(spark):
    got = drained(memory.access_counts(events(spark).select(F.col("user_id").alias("mu_id"), "ts")), "accesses", "complete")
    assert got.agg(F.sum("n")).first()[0] == 1000


def test_rate(spark):
    assert drained(memory.rate(events(spark)), "rates", "complete").agg(F.sum("n")).first()[0] == 6000


def test_bucket(spark):
    got = drained(memory.bucket_limiter(events(spark), 1 / 3600, 3), "bucket")
    assert got.count() == 1000 and 0 < got.where("accepted").count() <= 1000


def test_ingest(spark, tmp_path):
    seen = []
    turns = tables.turns(stream(spark, "conversations"))
    q = memory.ingest(turns, lambda units, edges, n: seen.append((n, units.count())), str(tmp_path / "c"))
    q.awaitTermination(170)
    assert sum(n for _, n in seen) > 0


def test_first_seen(spark):
    turns = tables.turns(stream(spark, "conversations")).withColumn("ts", F.current_timestamp())
    assert 0 < drained(memory.first_seen(turns, F.col("text")), "firsts").count() <= 87


def test_ingest_meets_the_batches_before(spark, tmp_path):
    """A claim that an earlier micro-batch kept is known in a later one, and a newer one replaces it."""
    schema = "conversation_id string, session_id string, turn_index int, dia_id string, speaker string, text string, timestamp string"
    said = [["Ann works at Globex in Paris", "Ann moved to Berlin"], ["Ann works at Globex in Paris", "Ann moved to Oslo"]]
    held, edges = {}, []
    for n, texts in enumerate(said):
        spark.createDataFrame([("c", "S0", 10 * n + i, f"D{10 * n + i}", "Ann", t, "") for i, t in enumerate(texts)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def write(units, links, number):
            held[number] = units.select("conversation_id", "mu_id", "seq", "claim", "confidence").collect()
            edges.extend(r.edge_type for r in links.collect())

        def known(number):
            rows = [r for b in held.values() for r in b]
            return spark.createDataFrame(rows, "conversation_id string, mu_id string, seq int, claim string, confidence double") if rows else None

        stream_of = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        memory.ingest(stream_of, write, str(tmp_path / "cp"), known).awaitTermination(170)
    assert [sorted(r.claim for r in b) for b in held.values()] == [["Ann moved to Berlin", "Ann works at Globex in Paris"], ["Ann moved to Oslo"]]
    assert "superseded_by" in edges
