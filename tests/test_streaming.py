"""The discovery stream over single files and over folders of part files."""

from lexforge.streaming import discovery


def test_stream_reads_files_and_folders(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a mail a"), (2, "none")], "doc_id long, text string")
    docs.repartition(2).write.parquet(f"{tmp_path}/docs.parquet")
    docs.repartition(2).write.parquet(f"{tmp_path}/2024/docs.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/other")
    (part,) = (tmp_path / "other").glob("part-*.parquet")
    part.rename(tmp_path / "single.parquet")

    def found(glob, state=None):
        return sorted(tuple(r) for r in discovery.scan_stream(spark, str(tmp_path), glob, docs.schema, {"mail": "mail"}, state).collect())

    assert found("docs.parquet") == found("single.parquet") == [(1, 1), (2, 0)]
    assert found("*.parquet") == [(1, 1), (1, 1), (2, 0), (2, 0)]
    assert found("none.parquet") == []


def test_stream_keeps_state_over_new_part_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail")], "doc_id long, text string")
    for n in (1, 2):
        docs.write.mode("append").parquet(f"{tmp_path}/docs.parquet")
        assert discovery.scan_stream(spark, str(tmp_path), "docs.parquet", docs.schema, {"mail": "mail"}, f"{tmp_path}/state").count() == n
