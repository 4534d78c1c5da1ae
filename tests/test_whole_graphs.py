"""Graph properties and JSON dumps of whole records."""

import json

from pyspark.sql import functions as F
from twins import DATA

from grafloom.plans.catalogue import QUERIES
from grafloom.schema import struct_type


def test_provenance_is_a_property(spark, tmp_path):
    record = {"actions": [{"name": "weld", "sequence_index": 1, "provenance": {"video_id": "v", "confidence": 0.95}}, {"name": "cool"}]}
    df = spark.createDataFrame([(1, json.dumps(record))], "extraction_id bigint, j string").select("extraction_id", F.from_json("j", struct_type("EgocentricVideoExtraction")).alias("r")).select("extraction_id", "r.*")
    df.write.parquet(f"{tmp_path}/video_extractions.parquet")
    got = {(r["node_id"], r["key"]): r["value"] for r in QUERIES["graph_properties_all"](spark, str(tmp_path)).collect()}
    assert got["Action:weld", "provenance"] == '{"video_id":"v","confidence":0.95}'
    assert ("Action:cool", "provenance") not in got


def test_nested_records_come_back(spark):
    t = spark.read.parquet(f"{DATA}/video_extractions.parquet")
    back = QUERIES["json_dump_extractions"](spark, str(DATA))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, t.collect()))
