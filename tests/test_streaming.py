from glyphward.streaming import state


def test_restore_once(spark, tmp_path):
    rows = [("m1", "put", "a", 0), ("m1", "get", None, 10), ("m1", "get", None, 20), ("m2", "put", "b", 0), ("m2", "get", None, 400)]
    kind = "mapping_id string, op string, payload string, at long"
    spark.createDataFrame(rows, kind).write.json(str(tmp_path / "in"))
    out = state.restore_once(spark.readStream.schema(kind).json(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("restored").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.mapping_id, r.payload, r.found) for r in spark.table("restored").collect() if r.found) + [r.found for r in spark.table("restored").collect()]
    assert got[0] == ("m1", "a", True) and got[1:].count(False) == 2
