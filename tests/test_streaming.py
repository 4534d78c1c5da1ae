from grafloom.operators.graph import merge_nodes
from grafloom.streaming.graph_merge import as_states, merge_stream, merged_states, nodes_of

SCHEMA = "graph_id bigint, label string, name string, properties map<string,string>, ord bigint"


def test_stream_gives_what_one_batch_gives(spark, tmp_path):
    rows = [(1, "Tool", "A", {"x": "1", "y": "2"}, 1), (1, "Tool", "a ", {"x": "3"}, 2), (2, "Tool", "B", {}, 1), (1, "Tool", "b", {"x": None, "z": "5"}, 4), (1, "Tool", "A", {"y": "9"}, 3)]
    source = tmp_path / "in"
    for i in range(0, len(rows), 2):
        spark.createDataFrame(rows[i : i + 2], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = merge_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)
    query.awaitTermination(120)
    shape = as_states(spark.createDataFrame(rows, SCHEMA)).schema
    streamed = nodes_of(merged_states(spark, str(tmp_path / "out"), shape))
    whole = merge_nodes(spark.createDataFrame(rows, SCHEMA))
    key = lambda df: sorted((r["graph_id"], r["node_id"], r["name"], r["ord"], sorted((r["properties"] or {}).items())) for r in df.collect())
    assert key(streamed) == key(whole)
    # of a bucket there are its last version and at most the one before it
    versions = {}
    for p in (tmp_path / "out").glob("batch=*/bucket=*"):
        versions.setdefault(p.name, []).append(p)
    assert len(versions) > 1 and max(map(len, versions.values())) <= 2
    assert merged_states(spark, str(tmp_path / "none"), shape).count() == 0
