import pytest
from pyspark.sql import functions as F

from tidegauge.catalog import REGISTRY
from tidegauge.catalog.streams import stream
from tidegauge.streaming import logs


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_streams_whole_as_one_file_or_as_a_folder_of_files(spark, tmp_path, files):
    rows = spark.range(90).withColumn("k", F.col("id") % 7).repartition(files)
    rows.write.parquet(str(tmp_path / "made"))
    if files == 1:
        part = next((tmp_path / "made").glob("*.parquet"))
        part.rename(tmp_path / "t.parquet")
    else:
        (tmp_path / "made").rename(tmp_path / "t.parquet")
    spark.range(5).write.parquet(str(tmp_path / "other.parquet"))
    logs.run_available(stream(spark, str(tmp_path), "t"), logs.per_batch_table(str(tmp_path / "out")))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in found.select("id", "k").collect()) == [(k, k % 7) for k in range(90)]


def test_messages_of_a_folder_of_files_are_guarded(spark, tmp_path):
    rows = [(k, 0, "system" if k % 2 else "user", f"mail {k} a{k}@b.com") for k in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4).write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    found = REGISTRY["stream_guardrail"].run(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.verdict == "OK") for r in found) == [(k, k % 2 == 0) for k in range(12)]
