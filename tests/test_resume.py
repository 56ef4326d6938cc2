"""A second run takes up only the files that are new."""

from repeatloom.streaming.resume import screen_new_files


def test_each_file_is_screened_once(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "id int, seq string"

    def add(i):
        spark.createDataFrame([(i, "TTAGGG" * 10), (-i, "ACGTTGCA" * 9)], schema).coalesce(1).write.mode("append").parquet(source)

    add(1)
    for expected in ([1], [1, 2]):
        screen_new_files(spark, source, schema, out, progress).awaitTermination(120)
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == expected
        add(2) if expected == [1] else None
