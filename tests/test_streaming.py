from pointloom.sinks.committed import CommittedTable
from pointloom.streaming.ingest import upsert_stream


def test_files_arrive_in_turn(spark, tmp_path):
    schema = "tomogram_name string, alignment_dir string, v int"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows in ([("a", "1", 1), ("b", "1", 2)], [("a", "1", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        upsert_stream(spark, src, schema, out, ck, buckets=4).awaitTermination(60)
    table = CommittedTable(spark, out)
    assert sorted(map(tuple, table.read().collect())) == [("a", "1", 3), ("b", "1", 2)]
    assert table.manifest()["batches"] == {"stream": 1} and table.buckets == 4
