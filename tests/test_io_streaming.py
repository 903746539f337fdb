import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from concordia.sources import readers, sinks
from concordia.streaming import flows


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,age\n1,"Smith, John",34\n2,null,\n,,\n')
    rows = readers.read_csv(spark, f"file://{tmp_path}/a.csv").collect()
    assert [tuple(r) for r in rows] == [("1", "Smith, John", "34"), ("2", None, None)]


def test_json_and_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "d/b.txt").write_text("x")
    assert readers.read_json(spark, f"file://{tmp_path}/d/a.json").count() == 2
    assert [r.path.rsplit("/", 1)[1] for r in readers.list_files(spark, f"file://{tmp_path}").collect()] == ["a.json"]


def test_adapters(spark):
    assert readers.to_spark({"a": [1, 2], "b": ["x", "y"]}, spark).count() == 2
    assert readers.to_spark([{"b": 1}, {"a": "x", "b": 2}], spark).columns == ["a", "b"]
    assert readers.to_spark({"columns": ["a"], "data": [[1], [2]]}, spark).columns == ["a"]
    assert readers.to_spark(pd.DataFrame({"a": [1]}), spark).count() == 1
    with pytest.raises(TypeError):
        readers.to_spark(3, spark)


def test_evidence_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = [(None, datetime(2024, 1, 1), "human_approval", "human_feedback", "a")]
    sinks.append_evidence(spark.createDataFrame(rows, "id string, timestamp timestamp, type string, source string, anchor_id string"), path)
    (tmp_path / "log/bad.json").write_text("not json\n" + json.dumps({"id": "x", "timestamp": "2024-01-02T00:00:00Z", "type": "t", "source": "s", "data": {"anchor_id": "b"}}) + "\n")
    got = readers.read_evidence(spark, path).collect()
    assert sorted(r.anchor_id for r in got) == ["a", "b"]
    assert all(r.id for r in got)


def test_anchor_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "d1"), ("b", "d2")], "anchor_id string, dataset string")
    sinks.write_anchors(df, f"file://{tmp_path}/s")
    sinks.write_anchors(df.where("dataset = 'd1'"), f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 2


@pytest.fixture
def stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(str(i), start + timedelta(minutes=10 * i), "human_approval" if i % 4 == 0 else "statistical_match", "human_feedback", f"a{i % 2}", float(i)) for i in range(24)]
    spark.createDataFrame(rows, "id string, timestamp timestamp, type string, source string, anchor_id string, v double").write.parquet(f"file://{tmp_path}/in")
    schema = "id string, timestamp timestamp, type string, source string, anchor_id string, v double"
    return spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")


def test_windows(spark, stream, tmp_path):
    out = flows.window_profile(stream, "timestamp", "v", ["anchor_id"])
    flows.run_once(out, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    got = spark.read.parquet(f"file://{tmp_path}/out")
    # The last windows stay open until the watermark passes their end.
    assert got.agg(F.sum("n")).first()[0] >= 12
    assert got.where("n <> 3").count() == 0


def test_states_in_a_stream(spark, stream, tmp_path):
    out = flows.anchor_states(stream, datetime(2024, 1, 2))
    q = out.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.anchor_id: r.state for r in spark.table("states").collect()}
    assert got == {"a0": "accepted", "a1": "accepted"} or got["a0"] == "accepted"


def test_drift_of_batches(spark, stream, tmp_path):
    base = spark.createDataFrame([(float(i),) for i in range(500, 560)], "v double")
    seen = []
    q = stream.writeStream.foreachBatch(flows.drift_sink(base, "v", lambda df, n: seen.extend(df.collect()))).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen[0].statistic == 1.0


def test_diff(spark, tmp_path):
    (tmp_path / "a.diff").write_text("diff --git a/m.sql b/m.sql\n--- a/m.sql\n+++ b/m.sql\n+  ADD COLUMN user_email varchar(20)\n-  old_price numeric\n+    title = Column(String)\n")
    got = {(r.change, r.column, r.type) for r in readers.diff_columns(spark, f"file://{tmp_path}/a.diff").collect()}
    assert got == {("added", "user_email", "varchar"), ("removed", "old_price", "numeric"), ("added", "title", "string")}
