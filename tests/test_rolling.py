import os

import pytest

from threadlens.session import ship_package
from threadlens.sources import rolling as RO


def sizes(path):
    return {n: os.path.getsize(f"{path}/{n}") for n in os.listdir(path)}


def test_parts_are_closed_by_bytes(spark, tmp_path):
    ship_package(spark)
    rows = [(i, "é" * (i % 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "post_id long, text string").repartition(3)
    path = str(tmp_path / "out")
    RO.write_rolling(df, path, max_bytes=5000)
    longest = max(len(RO.json_line(r)) for r in df.collect())
    made = sizes(path)
    assert len(made) > 10 and all(s < 5000 + longest for s in made.values())
    assert sum(s >= 5000 for s in made.values()) >= len(made) - 3        # only a task's last part is smaller
    got = spark.read.schema("post_id long, text string").json(path).collect()
    assert sorted((r.post_id, r.text) for r in got) == rows
    RO.write_rolling(df, path, max_bytes=10 ** 9)
    assert len(sizes(path)) == len(made) + 3


def test_serializer_of_the_caller_and_empty_frames(spark, tmp_path):
    ship_package(spark)
    df = spark.range(10).coalesce(1)
    RO.write_rolling(df, str(tmp_path / "a"), serializer=lambda r: b"%d;" % r.id, suffix=".txt")
    (name,) = os.listdir(tmp_path / "a")
    assert name.endswith(".txt") and (tmp_path / "a" / name).read_bytes() == b"0;1;2;3;4;5;6;7;8;9;"
    RO.write_rolling(df.limit(0), str(tmp_path / "b"))
    assert not [n for n in (os.listdir(tmp_path / "b") if (tmp_path / "b").exists() else [])]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    ship_package(spark)

    def fails(row):
        if row.id == 700:
            raise ValueError("lost")
        return b"x" * 100

    with pytest.raises(Exception, match="lost"):
        RO.write_rolling(spark.range(0, 1000, 1, 4), str(tmp_path / "c"), serializer=fails, max_bytes=1000)
    assert not [n for n in sizes(tmp_path / "c") if not n.startswith("_")]
