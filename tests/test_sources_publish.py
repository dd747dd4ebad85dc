import json
import zipfile

import pytest
from pyspark.sql import functions as F

from panelspark.plans import publish as K
from panelspark.sources import readers as R
from panelspark.streaming import ingest


def test_csv_readers(spark, tmp_path):
    wide = tmp_path / "wide.csv"
    wide.write_text("id,EXTRA,value\n0042,x,1.5\n7,y,bad\n")
    got = [tuple(r) for r in R.wide_csv(spark, str(wide), ["ID", "value", "absent"], numbers=["value"]).collect()]
    assert got == [("0042", 1.5), ("7", None)]
    latin = tmp_path / "latin.csv"
    latin.write_bytes("município;uf;total\nSão;SP;1.234,5\n".encode("latin-1"))
    df = R.sniff_csv(spark, str(latin))
    late = tmp_path / "late.csv"  # the header is ASCII; only the last row tells
    late.write_bytes("city;uf;total\nRio;RJ;1\nSão;SP;2\n".encode("latin-1"))
    assert [r["city"] for r in R.sniff_csv(spark, str(late)).collect()] == ["Rio", "São"]
    late.write_bytes("city,uf,total\nSão,SP,2\n".encode())
    assert [r["city"] for r in R.sniff_csv(spark, str(late)).collect()] == ["São"]
    assert df.select(R.dotted_number(F.col("total")).alias("t")).first()["t"] == 1234.5 and "município" in df.columns


def test_json_readers(spark, tmp_path):
    table = tmp_path / "table.json"
    table.write_text(json.dumps([{"V": "Valor", "D1C": "Código"}, {"V": "12", "D1C": "35"}, {"V": "...", "D1C": "36"}]))
    df = R.header_row_json(spark, str(table), {"value": "V", "code": "D1C"}, F.col("V") == "Valor")
    assert sorted(tuple(r) for r in df.collect()) == [("...", "36"), ("12", "35")]
    wrapped = tmp_path / "wrapped.json"
    wrapped.write_text(json.dumps({"results": [{"a": 1, "level": "city", "at": "2010-01-01T00:00:00-02:00"}, {"a": 2, "level": "state", "at": "2010-01-01T00:00:00-02:00"}]}))
    items = R.envelope_json(spark, str(wrapped), "a int, level string, at string")
    assert [r["a"] for r in R.series_values(items, "level", "city", "at", 2010).collect()] == [1]


def test_zip_members_and_file_period(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("ST_2301.csv", "a")
        z.writestr("readme.txt", "b")
    assert [r["member"] for r in R.zip_members(spark, str(tmp_path / "x.zip"), r"ST_\d{4}\.csv$").collect()] == ["ST_2301.csv"]
    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "SP_202303"))
    got = R.with_file_period(spark.read.parquet(str(tmp_path / "SP_202303"))).first()
    assert (got["year"], got["month"]) == (2023, 3)


def test_encodings_that_accept_every_byte_are_not_taken_for_others(spark, tmp_path):
    """Curly quotes of windows-1252 are control characters in ISO-8859-1; a file of plain Latin-1 stays one."""
    for name, text, encoding in (("w", "a;b;c\n\u201cx\u201d;\u2013;1\n", "cp1252"), ("l", "a;b;c\né;ü;1\n", "latin-1"), ("u", "a;b;c\né;\u201cü\u201d;1\n", "utf-8")):
        (tmp_path / name).write_bytes(text.encode(encoding))
        assert list(R.sniff_csv(spark, str(tmp_path / name)).first()) == text.split("\n")[1].split(";")
    (tmp_path / "bad").write_bytes(b"a;b;c\n\x81\x8d;\xff;1\n")
    with pytest.raises(ValueError, match="no encoding"):
        R.sniff_csv(spark, str(tmp_path / "bad"))


def test_broken_members_are_reported(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.csv", "é".encode("latin-1"))
        z.writestr("b.csv", "é".encode())
    (tmp_path / "y.zip").write_bytes(b"no archive")
    got = {(r["archive"][-5:], r["member"]): (r["text"], r["error"]) for r in R.zip_members(spark, str(tmp_path / "*.zip"), r"csv$").collect()}
    assert got["x.zip", "b.csv"] == ("é", None) and got["x.zip", "a.csv"][0] is None and "decode" in got["x.zip", "a.csv"][1] and got["y.zip", None][1]
    assert {r["text"] for r in R.zip_members(spark, str(tmp_path / "x.zip"), r"a\.csv$", "latin-1").collect()} == {"é"}


def test_census_of_tables(spark):
    spark.range(3).createOrReplaceTempView("census_a")
    spark.range(0).createOrReplaceTempView("census_b")
    got = {r["table"]: r["n"] for r in R.table_census(spark, ["census_a", "census_b"]).collect()}
    assert (got["census_a"], got["census_b"]) == (3, 0)
    with pytest.raises(ValueError, match="census_c"):
        R.table_census(spark, ["census_a", "census_c"])


def test_empty_source_keeps_its_schema(spark):
    assert R.empty(spark, "a string, b long").dtypes == [("a", "string"), ("b", "bigint")]


def test_partition_writes_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string")
    K.write_partitioned(df, path, ["k"])
    K.write_partitioned(df.filter("k = 'a'").withColumn("v", F.lit(9)), path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()) == [("a", 9), ("b", 2)]
    wanted = spark.createDataFrame([("a",), ("c",)], "k string")
    assert [r["k"] for r in K.missing_partitions(spark, wanted, path, ["k"]).collect()] == ["c"]
    K.compact(spark.read.parquet(path), str(tmp_path / "u"), ["k"])
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2


def test_tree_manifest_round_trip(spark, tmp_path):
    root = tmp_path / "tree"
    K.export_tree({"scores": spark.range(5), "raw_events": spark.range(3)}, str(root), [("raw", "raw"), ("scores", "results")])
    with pytest.raises(ValueError, match="unsafe"):
        K.export_tree({"a; drop": spark.range(1)}, str(root), [])
    manifest = K.write_manifest(spark, str(root))
    assert manifest["total_rows"] == 8 and K.verify_manifest(spark, str(root), manifest) == []
    assert json.loads((root / "manifest.json").read_text()) == manifest and manifest["files"][0]["schema"] == {"id": "bigint"}
    assert K.register_views(spark, str(root), manifest, ["scores"]) == ["scores"] and spark.table("scores").count() == 5
    manifest["files"][0]["sha256"] = "0"
    manifest["files"].append({"path": "../x.parquet", "sha256": "", "rows": 0})
    (root / "extra.parquet").write_bytes(next(root.rglob("*.parquet")).read_bytes())
    wrong = K.verify_manifest(spark, str(root), manifest)
    assert any(w.startswith("digest") for w in wrong) and any(w.startswith("unsafe") for w in wrong) and any(w.startswith("unlisted") for w in wrong)


def test_parquet_trees_tables_and_fallbacks(spark, tmp_path):
    a = spark.createDataFrame([(1, 2020), (2, 2021)], "v int, year int")
    a.write.parquet(str(tmp_path / "t/a"))
    a.withColumn("extra", F.lit("x")).write.parquet(str(tmp_path / "t/b"))
    both = R.parquet_tree(spark, [str(tmp_path / "t/a"), str(tmp_path / "t/b")])
    assert both.count() == 4 and "extra" in both.columns
    assert sorted(r["v"] for r in R.parquet_tree(spark, str(tmp_path / "t/a"), years=(2021, 2022)).collect()) == [2]
    a.createOrReplaceTempView("readings")
    assert R.table_filter(spark, "readings", "v > 1").count() == 1 and R.table_filter(spark, "readings").count() == 2
    loaders = [("cache", lambda s: s.read.parquet(str(tmp_path / "absent"))), ("files", lambda s: s.read.parquet(str(tmp_path / "t/a")))]
    assert {r["_source"] for r in R.first_that_loads(spark, loaders).collect()} == {"files"}
    with pytest.raises(ValueError, match="cache"):
        R.first_that_loads(spark, loaders[:1])
    assert [r["estimated"] for r in R.with_estimated_flag(a, "year", 2021).orderBy("v").collect()] == [False, True]
    for k, page in enumerate(([{"id": 1, "kind": "h"}, {"id": 1, "kind": "g"}], [{"id": 2, "kind": "x"}])):
        (tmp_path / f"page{k}.json").write_text(json.dumps({"items": page}))
    found = R.facility_list(spark, str(tmp_path / "page*.json"), "id int, kind string", "id", F.col("kind") != "x")
    assert [tuple(r) for r in found.collect()] == [(1, "g")]
    places = spark.createDataFrame([(1, 5.0), (1, 4.0)], "v int, lat double")
    assert sorted((r["v"], r["lat"]) for r in R.entity_master(a.select("v"), places, "v").collect()) == [(1, 4.0), (2, None)]
    K.upsert_tree(spark, spark.createDataFrame([(2, 1999)], "v int, year int"), str(tmp_path / "t/a"), str(tmp_path / "t/c"), ["v"])
    assert sorted(r["year"] for r in spark.read.parquet(str(tmp_path / "t/c")).collect()) == [1999, 2020]


def test_streaming_counts_each_event_once(spark, tmp_path):
    landing = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:20:00", "a", 2.0)]
    df = spark.createDataFrame(rows, "id long, ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(landing)
    stream = ingest.once_each(ingest.read_landing(spark, landing, df.schema), ["id"], "ts")
    query = ingest.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    counts = ingest.windowed_counts(spark.read.parquet(str(tmp_path / "out")), "ts", ["kind"]).collect()
    assert [(r["n"], r["total"]) for r in counts] == [(2, 3.0)]
