import pytest
from pyspark.sql import functions as F

from grafloom import session


def test_written_tables_and_their_removal(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    df = session.materialize(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 5 and df.columns == ["id", "x"]
    (tmp_path / "grafloom-other").mkdir()
    assert len(list(tmp_path.iterdir())) == 2
    session.clear_scratch(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["grafloom-other"]
    assert session.materialize(spark.range(0)).count() == 0


def test_scratch_is_removed_with_its_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    with session.scratch(spark) as outer:
        assert session.materialize(spark.range(3)).count() == 3
        with session.scratch(spark):
            session.materialize(spark.range(3))
            assert len(list(tmp_path.iterdir())) == 2
        assert [f"file://{p}" for p in tmp_path.iterdir()] == [outer]
    assert list(tmp_path.iterdir()) == []


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(session, "is_local", lambda _: False)
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        with pytest.raises(RuntimeError):
            session.shared_dir(spark)


def test_files_of_the_shared_folder(spark, tmp_path):
    (tmp_path / "x").write_text("y")
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert session.qualified(spark, path).startswith("file:/")
        system, folder = session.shared_files(session.qualified(spark, path))
        assert system.open_input_stream(f"{folder}/x").read() == b"y"


def test_own_folder_is_kept_for_the_session(spark):
    assert session.shared_dir(spark) == session.shared_dir(spark) != ""


def test_groups_stay_whole_above_a_join(spark):
    keys = spark.range(50).select((F.col("id") % 10).alias("k"), "id")
    small = spark.range(10).withColumnRenamed("id", "k")

    def groups(batches):
        import pandas as pd

        seen = [k for pdf in batches for k in pdf["k"]]
        yield pd.DataFrame({"k": [a for a, b in zip(seen, [None, *seen]) if a != b]})

    passed = session.whole_groups(keys.join(small, "k"), ["k"], "k", "id").mapInPandas(groups, "k bigint")
    assert sorted(r["k"] for r in passed.collect()) == list(range(10))
