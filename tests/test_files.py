"""The raw archive as a data source, and versions that are swapped in whole."""

import json
import os
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from tidelog.sources import files


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    files.register(spark)
    rows = [(datetime(2026, 1, 1 + n % 5, 10, tzinfo=UTC), f"run{n % 2}", ".json", f'{{"n":{n}}}'.encode()) for n in range(40)] + [(datetime(2025, 12, 31, tzinfo=UTC), "run0", "", b"")]
    spark.createDataFrame([*rows, rows[3]], "captured_at timestamp, run string, suffix string, body binary").repartition(3).write.format("tidelog_archive").mode("append").save(root)
    return root


def test_archive_round_trip(spark, archive):
    got = spark.read.format("tidelog_archive").load(archive).collect()
    assert len(got) == 41 and all(r.intact for r in got)
    assert {bytes(r.body) for r in got} == {f'{{"n":{n}}}'.encode() for n in range(40)} | {b""}
    assert {(r.date, r.run) for r in got if bytes(r.body) == b'{"n":7}'} == {(date(2026, 1, 3), "run1")}


def test_a_date_filter_lists_that_date_only(spark, archive):
    reader = files.ArchiveReader({"path": archive})
    rest = list(reader.pushFilters([files.EqualTo(("date",), date(2026, 1, 2)), files.EqualTo(("run",), "run1")]))
    assert reader.days() == ["2026/01/02"] and len(rest) == 1
    ranged = files.ArchiveReader({"path": archive})
    assert not list(ranged.pushFilters([files.GreaterThanOrEqual(("date",), date(2025, 12, 31)), files.LessThan(("date",), date(2026, 1, 2))]))
    assert ranged.days() == ["2025/12/31", "2026/01/01"]
    both = spark.read.format("tidelog_archive").load(archive).where((F.col("date") == date(2026, 1, 2)) & (F.col("run") == "run1"))
    assert sorted(json.loads(bytes(r.body))["n"] for r in both.collect()) == [1, 11, 21, 31]
    # a folder of another day that cannot be read is not touched
    other = f"{archive}/2026/01/05"
    os.chmod(other, 0)
    try:
        assert both.count() == 4
    finally:
        os.chmod(other, 0o755)


def test_damage_is_told(spark, archive, tmp_path):
    import pyarrow as pa

    os.makedirs(tmp_path / "2026/01/01/r")
    (tmp_path / "2026/01/01/r" / f"{'0' * 64}.json.zst").write_bytes(pa.compress(b"other", codec="zstd", asbytes=True))
    assert [r.intact for r in spark.read.format("tidelog_archive").load(str(tmp_path)).collect()] == [False]
    assert spark.read.format("tidelog_archive").load(str(tmp_path / "none")).count() == 0


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    files.register(spark)
    path = str(tmp_path / "out")
    read = lambda: sorted(r.value for r in spark.read.format("tidelog_versions").load(path).collect())
    assert read() == []
    spark.range(6).selectExpr("id", "concat('é', id) AS a").repartition(3).write.format("tidelog_versions").mode("overwrite").save(path)
    first = read()
    assert first == [f'{{"a":"é{n}","id":{n}}}' for n in range(6)]
    before = files.current(path)
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise("x").alias("a"), "id")
    with pytest.raises(Exception, match="no"):
        broken.write.format("tidelog_versions").mode("overwrite").save(path)
    assert files.current(path) == before and read() == first
    assert [d for d in os.listdir(path) if d.startswith("version=")] == [f"version={before['version']}"]
    spark.range(2).write.format("tidelog_versions").mode("overwrite").save(path)
    assert read() == ['{"id":0}', '{"id":1}'] and files.current(path)["rows"] == 2
    spark.range(0).write.format("tidelog_versions").mode("overwrite").save(path)
    assert read() == []
