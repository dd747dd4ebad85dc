import csv
import io
import zipfile

from pyspark.sql import functions as F

from panelspark.sources import archives as Z


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(name, content)


def table(rows, sep=","):
    out = io.StringIO()
    csv.writer(out, delimiter=sep).writerows(rows)
    return out.getvalue()


def test_directory_reads_no_member(spark, tmp_path):
    archive(tmp_path / "a.zip", [("ST_2301.csv", "x" * 1000), ("folder/", ""), ("readme.txt", "b")])
    archive(tmp_path / "b.zip", [])
    (tmp_path / "c.zip").write_bytes(b"no archive")
    got = Z.zip_directory(spark, str(tmp_path / "*.zip"), r"\.csv$").collect()
    assert sorted((r["archive"][-5:], r["place"], r["member"], r["bytes"], r["error"] is None) for r in got) == [("a.zip", 0, "ST_2301.csv", 1000, True), ("c.zip", None, None, None, False)]
    assert {r["archive"][-5:]: (r["members"], r["bytes"]) for r in Z.directory_summary(Z.zip_directory(spark, str(tmp_path / "*.zip"))).collect()} == {"a.zip": (2, 1001), "c.zip": (0, None)}
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[45:50] = b"\xff" * 5  # within the first member's bytes
    (tmp_path / "a.zip").write_bytes(data)
    assert Z.zip_directory(spark, str(tmp_path / "a.zip"), "csv").count() == 1


def test_a_task_for_each_member(spark, tmp_path):
    archive(tmp_path / "a.zip", [(f"m{i}.csv", f"k,v\n{i},1\n") for i in range(12)])
    rows = Z.zip_csv(spark, str(tmp_path / "a.zip"), "csv", ["k"])
    assert rows.rdd.getNumPartitions() == 12
    assert {r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()} == {1}


def test_only_the_member_s_own_bytes_are_read(spark, tmp_path):
    """Each read of an archive is noted by an opener of one's own: none is near the archive's size."""
    import random

    noise = random.Random(1).randbytes
    archive(tmp_path / "a.zip", [(f"m{i}", noise(300_000).hex()) for i in range(4)])
    log = str(tmp_path / "log")

    def opener(path):
        class Noted(io.FileIO):
            def readinto(self, buffer):
                n = super().readinto(buffer)
                with open(log, "a") as f:
                    f.write(f"{n}\n")
                return n

            def read(self, size=-1):
                data = super().read(size)
                with open(log, "a") as f:
                    f.write(f"{len(data)}\n")
                return data

        return Noted(path.removeprefix("file:"))

    assert Z.zip_lines(spark, str(tmp_path / "a.zip"), "m2$", opener=opener).agg(F.sum(F.length("line"))).first()[0] == 600_000
    with open(log) as f:
        assert sum(int(x) for x in f) < 0.5 * (tmp_path / "a.zip").stat().st_size


def test_csv_members_of_several_layouts(spark, tmp_path):
    first = [["ID", "city", "extra"], ["1", "São; Paulo", "x"], ["2", 'a "b"\nc', ""], ["3", "", "y"]]
    second = [["city", "id"], ["Rio", "4"]]
    archive(tmp_path / "a.zip", [("1.csv", "﻿" + table(first)), ("2.csv", table(second)), ("3.csv", ""), ("4.csv", "id,city\n"), ("5.csv", "other\n7\n"), ("6.csv", "id,city\n8,a\n9\n10,b,c\n11,d\n")])
    got = Z.zip_csv(spark, str(tmp_path / "a.zip"), r"\.csv$", ["id", "City"]).collect()
    assert sorted((r["member"], r["id"] or "", r["City"] or "") for r in got if r["error"] is None) == [
        ("1.csv", "1", "São; Paulo"), ("1.csv", "2", 'a "b"\nc'), ("1.csv", "3", ""), ("2.csv", "4", "Rio"), ("5.csv", "", ""), ("6.csv", "11", "d"), ("6.csv", "8", "a")]
    assert [(r["member"], r["id"]) for r in got if r["error"]] == [("6.csv", None)] and "2 records" in next(r["error"] for r in got if r["error"])
    assert got[0].asDict().keys() == {"archive", "member", "id", "City", "error"}


def test_encodings_and_broken_members(spark, tmp_path):
    archive(tmp_path / "l.zip", [("a.csv", "k;v\né;“\n".encode("cp1252"))])
    assert [(r["k"], r["v"]) for r in Z.zip_csv(spark, str(tmp_path / "l.zip"), "csv", ["k", "v"], ";", "cp1252").collect()] == [("é", "“")]
    wrong = Z.zip_lines(spark, str(tmp_path / "l.zip"), "csv").collect()
    assert [r["line"] for r in wrong if r["error"] is None] in ([], ["k;v"]) and sum(r["error"] is not None for r in wrong) == 1
    assert [r["error"] is not None for r in Z.zip_csv(spark, str(tmp_path / "l.zip"), "csv", ["k"], ";").collect() if r["k"] is None] == [True]
    archive(tmp_path / "b.zip", [("a.csv", "k\n1\n"), ("b.csv", "k\n" + "".join(f"{i}\n" for i in range(5000)))])
    data = bytearray((tmp_path / "b.zip").read_bytes())
    at = data.index(b"b.csv") + 2000
    data[at : at + 40] = b"\xff" * 40
    (tmp_path / "b.zip").write_bytes(data)
    (tmp_path / "c.zip").write_bytes(b"no archive")
    got = Z.zip_csv(spark, str(tmp_path / "[bc].zip"), "csv", ["k"]).collect()
    assert [r["k"] for r in got if r["member"] == "a.csv"] == ["1"]
    assert sum(r["error"] is not None for r in got if r["member"] == "b.csv") == 1 and sum(r["error"] is not None and r["member"] is None for r in got) == 1


def test_lines_beyond_a_block_and_names_that_repeat(spark, tmp_path, monkeypatch):
    import warnings

    monkeypatch.setattr(Z, "BLOCK_BYTES", 1 << 16)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        archive(tmp_path / "a.zip", [("x", "\n".join(str(i) for i in range(50_000))), ("x", "again")])
    got = Z.zip_lines(spark, str(tmp_path / "a.zip")).cache()
    assert got.count() == 50_001 and got.filter("line = 'again' AND line_no = 0").count() == 1
    assert got.filter("line <> 'again' AND line <> cast(line_no AS string)").count() == 0
    got.unpersist()
