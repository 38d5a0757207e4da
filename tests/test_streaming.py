from pyspark.sql import functions as F

from spectrafold.streaming import blocks as B
from spectrafold.streaming import counts as C

from .fixtures import counted


def test_counts_grow_as_files_arrive(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fa").write_text(">r\nACGTAC\nGT\n")
    query = C.start(C.growing_counts(C.arriving(spark, str(folder)), 3), "growing", str(tmp_path / "state"))
    try:
        query.processAllAvailable()
        (folder / "b.fa").write_text(">r1\nACG\n>r2\nNACGT\n")
        query.processAllAvailable()
        rows = {(r["sample"], r["feature"]): r["c"] for r in spark.sql("select * from growing").collect()}
    finally:
        query.stop()
    assert rows == {("a", w): c for w, c in counted(["ACGTACGT"], 3).items()} | {("b", w): c for w, c in counted(["ACG", "NACGT"], 3).items()}


def test_a_record_cut_over_batches(spark, tmp_path):
    """Blocks in any order and batch, some twice; windows over their borders count once."""
    sequences = {("a", 1): "ACGTTGCATGACCTGAACGTTAGC", ("a", 2): "TTACGGA", ("b", 1): "GATTACA"}
    rows = [(s, r, i // 5, q[i : i + 5]) for (s, r), q in sequences.items() for i in range(0, len(q), 5)]
    rows.insert(2, ("a", 2, 5, "CCCC"))  # its turn never comes, as blocks 2 to 4 are missing
    columns = "sample string, record long, block_no long, letters string"
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [rows[3:] + rows[3:5], rows[:1] + rows[4:6], rows[1:3]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, columns).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(columns).parquet(folder)
        B.count_blocks(stream, 4, out, state).awaitTermination()
        if n == 0:
            assert (("a", "ACGT") in {(r["sample"], r["feature"]) for r in B.counts_so_far(spark, out).collect()}) is False
    got = {(r["sample"], r["feature"]): r["c"] for r in B.counts_so_far(spark, out).collect()}
    assert got == {(s, w): c for s in "ab" for w, c in counted([q for (n, _), q in sequences.items() if n == s], 4).items()}


def test_blocks_that_come_again_are_told(spark, tmp_path):
    columns = "sample string, record long, block_no long, letters string"
    folder = str(tmp_path / "in")
    for rows in ([("a", 1, 0, "ACG"), ("a", 1, 1, "TT")], [("a", 1, 0, "ACG"), ("a", 1, 2, None), ("a", 1, 3, "G")]):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(folder)
        stream = B.joined_blocks(spark.readStream.schema(columns).parquet(folder), 3)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted((r["block_no"], r["piece"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "", "late"), (0, "ACG", "joined"), (1, "CGTT", "joined"), (2, "TT", "joined"), (3, "TTG", "joined")]


def test_events_beyond_the_watermark_are_left_out(spark, tmp_path):
    at = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    folder = str(tmp_path / "in")
    batches = [[(at(1), "u", "x"), (at(12), "u", "x")], [(at(2), "u", "x"), (at(11, 30), "u", "x"), (at(13), "v", "y")], [(at(23, 59), "u", "x")]]
    for batch in batches:
        spark.createDataFrame(batch, "t string, s string, f string").select(F.to_timestamp("t").alias("ts"), "s", "f").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("ts timestamp, s string, f string").parquet(folder)
        counts = C.windowed_counts(stream, "ts", "6 hours", "1 hour", F.col("s"), F.col("f"))
        counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(r["window"]["start"].hour, r["sample"], r["feature"], r["c"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The event of 2 o'clock came when its window had been closed; that of half past eleven came in time.
    assert got == {(0, "u", "x", 1), (6, "u", "x", 1), (12, "u", "x", 1), (12, "v", "y", 1)}


def test_records_share_states(spark):
    rows = spark.range(8).select(F.lit("s").alias("sample"), "id", F.lit(0).alias("block_no"), F.lit("ACGT").alias("letters")).withColumnRenamed("id", "record")
    assert "bucket" in B.joined_blocks(rows, 3)._jdf.queryExecution().analyzed().toString()
