"""Named files: what a job leaves, and what one that fails doesn't."""

import pytest
from pyspark.sql import functions as F

from strandmark.sources import files


def rows(spark, names):
    return spark.createDataFrame([(n, f"text of {n} ü") for n in names], "name string, t string").repartition(3)


def left(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file()) if path.exists() else []


def test_round_trip(spark, tmp_path):
    out = tmp_path / "o"
    files.write_files(rows(spark, ["a b.txt", "ü.html"]), F.col("name"), F.col("t"), str(out))
    files.write_files(rows(spark, ["c.txt"]), F.col("name"), F.lit(None), str(out))
    assert left(out) == ["a b.txt", "c.txt", "ü.html"] and (out / "c.txt").read_bytes() == b"" and [p for p in out.iterdir() if p.is_dir()] == []
    got = {r["name"]: r["content"].decode() for r in files.read_files(spark, str(out), "*.html").collect()}
    assert len(got) == 1 and list(got.values()) == ["text of ü.html ü"]
    files.write_files(rows(spark, ["c.txt", "d.txt"]), F.col("name"), F.col("t"), f"file://{out}", "overwrite")
    assert left(out) == ["c.txt", "d.txt"]
    files.write_files(rows(spark, []), F.col("name"), F.col("t"), str(out))
    assert left(out) == ["c.txt", "d.txt"]


@pytest.mark.parametrize(("names", "match"), [(["x.txt", "x.txt"], "taken"), (["y.txt", "there.txt"], "taken"), (["z.txt", "../z.txt"], "not a file"), (["z.txt", None], "not a file"), ([".z"], "not a file")])
def test_a_job_that_fails_leaves_nothing(spark, tmp_path, names, match):
    out = tmp_path / "o"
    files.write_files(rows(spark, ["there.txt"]), F.col("name"), F.col("t"), str(out))
    with pytest.raises(Exception, match=match):
        files.write_files(rows(spark, names), F.col("name"), F.col("t"), str(out))
    assert left(out) == ["there.txt"] and [p.name for p in out.iterdir()] == ["there.txt"]


def test_a_task_that_fails_midway_leaves_nothing(spark, tmp_path):
    out = tmp_path / "o"
    broken = F.when(F.col("id") == 57, F.raise_error(F.lit("lost"))).otherwise(F.lit("x"))
    with pytest.raises(Exception, match="lost"):
        files.write_files(spark.range(0, 60, 1, 2), F.concat(F.lit("f"), F.col("id").cast("string")), broken, str(out))
    assert left(out) == []


def test_names(spark):
    df = spark.createDataFrame([(1, "A/B"), (2, "A:B"), (3, "C"), (4, 'x"<>|?*\\')], "id int, firm string")
    got = [r["name"] for r in files.file_names(df, F.col("firm"), ".txt", ["id"]).orderBy("id").collect()]
    assert got == ["A_B.txt", "A_B_2.txt", "C.txt", "x_______.txt"]


def test_names_of_a_stem_over_many_parts(spark, tmp_path):
    df = spark.range(0, 3000, 1, 4).select("id", F.when(F.col("id") % 10 > 0, "A/B").when(F.col("id") % 20 > 0, F.lit(None)).otherwise(F.concat(F.lit("c"), "id")).alias("firm"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = files.file_names(df, F.col("firm"), ".txt", ["id"], path=str(tmp_path / "n"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = files.file_names(df, F.col("firm"), ".txt", ["id"])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(list((tmp_path / "n").glob("part-*"))) > 2


def test_dealt_files(spark, tmp_path):
    out = tmp_path / "o"
    files.write_files(rows(spark, [f"{i}.txt" for i in range(100)]), F.col("name"), F.col("t"), str(out), folders=8)
    files.write_files(rows(spark, [f"{i}.pdf" for i in range(50)]), F.col("name"), F.col("t"), f"file://{out}", folders=8)
    assert {p.count("/") for p in left(out)} == {2} and len(list(out.iterdir())) == 8
    found = files.read_files(spark, str(out))
    assert found.rdd.getNumPartitions() == 8
    got = {r["name"]: (r["content"].decode(), r["length"]) for r in found.collect()}
    assert len(got) == 150 and all(v == (f"text of {k} ü", len(f"text of {k} ü".encode())) for k, v in got.items())
    assert sorted(r["name"] for r in files.read_files(spark, str(out), "*.pdf", len("text of 1.pdf ü".encode())).collect()) == [f"{i}.pdf" for i in range(10)]
    files.write_files(rows(spark, ["a.txt"]), F.col("name"), F.col("t"), str(out), "overwrite", folders=3)
    assert [r["name"] for r in files.read_files(spark, str(out)).collect()] == ["a.txt"] and len(left(out)) == 1


@pytest.mark.parametrize(("names", "folders", "match"), [(["x.txt", "x.txt"], 4, "taken"), (["y.txt", "there.txt"], 4, "taken"), (["z.txt", None], 4, "not a file"), (["z.txt"], 5, "another number"), (["z.txt"], None, "another number")])
def test_a_dealt_job_that_fails_leaves_nothing(spark, tmp_path, names, folders, match):
    out = tmp_path / "o"
    files.write_files(rows(spark, ["there.txt"]), F.col("name"), F.col("t"), str(out), folders=4)
    before = left(out)
    with pytest.raises(Exception, match=match):
        files.write_files(rows(spark, names), F.col("name"), F.col("t"), str(out), folders=folders)
    assert left(out) == before and len(list(out.iterdir())) == 1


def test_many_files_of_a_folder_are_few_tasks(spark, tmp_path):
    for i in range(1500):
        (tmp_path / f"{i}.pdf").write_bytes(b"%d" % i)
    (tmp_path / ".hidden.pdf").write_bytes(b"x")
    found = files.read_files(spark, str(tmp_path), "*.pdf")
    assert found.rdd.getNumPartitions() == 2 and sorted(int(r["content"]) for r in found.collect()) == list(range(1500))
    assert files.read_files(spark, str(tmp_path), "*.txt").collect() == []
