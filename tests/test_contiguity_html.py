"""Contiguity against all pairs, tables of pages against grids that they were written from, and files in order."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelspark.operators import contiguity
from panelspark.operators import stats as S
from panelspark.plans import publish
from panelspark.sources import html_tables


@pytest.mark.parametrize("block", [256, 3])
def test_areas_that_share_corners(spark, block):
    """A star of areas around one place, two squares with a side in common, an island, repeated and null vertices."""
    star = [(i, 0.0, 0.0) for i in range(20)] + [(i, 10.0 + i, 3.0) for i in range(20)]
    squares = [(100, x, y) for x in (50, 51) for y in (50, 51)] + [(101, x + 1e-9, y) for x in (51, 52) for y in (50, 51)]
    rows = star + squares + squares[:3] + [(200, 90.0, 90.0), (200, 91.0, 90.0), (None, 0.0, 0.0), (300, None, 1.0), (300, 5.5, 5.5)]
    df = spark.createDataFrame([(None if a is None else a, None if x is None else float(x), float(y), "w") for a, x, y in rows], "area long, x double, y double, src string")
    edges = contiguity.queen(df, block_areas=block)
    got = sorted((r["src"], r["dst"]) for r in edges.collect())
    assert got == sorted([(a, b) for a in range(20) for b in range(20) if a != b] + [(100, 101), (101, 100)])
    assert [tuple(r) for r in contiguity.queen(df, least=2, block_areas=block).orderBy("src").collect()] == [(100, 101, 1.0), (101, 100, 1.0)]
    assert sorted(r["area"] for r in contiguity.islands(df, edges).collect()) == [200, 300]
    assert contiguity.queen(df.limit(0)).count() == 0
    values = df.select(F.col("area").alias("id"), (F.col("area") % 7).cast("double").alias("value")).distinct()
    assert S.morans_i(values, edges).first()["n"] == 24


def written(rnd, depth=0):
    """HTML of a random table and its grid: rows of (text, header)."""
    height, width = rnd.randint(1, 5), rnd.randint(1, 5)
    grid, lines, count = {}, [], 0
    for i in range(height):
        line = rnd.choice(["<tr>", "<TR class='x'>", "<tr\n>"])
        j = 0
        while j < width:
            if (i, j) in grid:
                j += 1
                continue
            rows, columns = rnd.randint(1, 3), 1
            while columns < 3 and j + columns < width and (i, j + columns) not in grid and rnd.random() < 0.3:
                columns += 1
            if rnd.random() < 0.6:
                rows = 1
            if rnd.random() < 0.1:
                rows = 0
            header, text = rnd.random() < 0.3, f"{depth}.{count} & é"
            count += 1
            tag = "th" if header else "td"
            spans = (f" rowspan='{rows}'" if rows != 1 else "") + (f' colspan="{columns}"' if columns > 1 else "")
            line += f"<{tag}{spans}> {text.replace('&', '&amp;').replace(' ', rnd.choice([' ', '  ', chr(10)]))} " + (f"</{tag}>" if rnd.random() < 0.7 else "")
            for a in range(i, height if rows == 0 else min(height, i + rows)):
                for b in range(j, j + columns):
                    grid[a, b] = (text, header)
            j += columns
        lines.append(line + ("</tr>" if rnd.random() < 0.7 else ""))
    return f"<table><tbody>{''.join(lines)}</tbody></table>", grid


def test_spans_fill_the_grid_that_was_written():
    rnd = random.Random(1)
    for _ in range(300):
        html, grid = written(rnd)
        got = {(r, c): (text, header) for t, parent, r, c, text, header in html_tables.cells(f"<p>x{html}<script>'<td>'</script>") if t == 0 and parent is None}
        assert got == grid, html


def test_nested_tables_and_odd_pages(spark):
    nested = "<table><tr><td>a<table><tr><td>in<td colspan=x>ner</table>b<style>no</style><td rowspan=0>c<tr><td>d</table><table></table><table><td>no row"
    pages = spark.createDataFrame([(1, nested, 5), (1, nested, 5), (2, None, 5), (3, "", 5), (4, "<p>no</p>", 5), (None, "<TABLE><tr><td>x" + "y" * 100_000, 5)], "id long, html string, row int")
    got = [tuple(r) for r in html_tables.scan(pages, "id").collect()]
    one = [(0, None, 0, 0, "ab"), (0, None, 0, 1, "c"), (0, None, 1, 0, "d"), (0, None, 1, 1, "c"), (1, 0, 0, 0, "in"), (1, 0, 0, 1, "ner"), (3, None, 0, 0, "no row")]
    assert sorted(r[1:6] for r in got if r[0] == 1) == sorted(one * 2) and not any(r[6] for r in got)
    assert [len(r[5]) for r in got if r[0] is None] == [100_001] and len(got) == 15
    assert html_tables.scan(pages.limit(0), "id").count() == 0
    wide = list(html_tables.cells("<table><tr><td colspan=5000>a<tr><td rowspan=99999>b"))
    assert len(wide) == 1_001


def test_files_in_order(spark, tmp_path):
    path = str(tmp_path / "ordered")
    rows = spark.range(20_000).select((F.xxhash64("id") % 700).alias("k"), F.col("id").alias("v")).union(spark.createDataFrame([(None, 1), (None, 2)], "k long, v long"))
    publish.write_ordered(rows, path, ["k", "v"], file_rows=3_000)
    files = sorted((tmp_path / "ordered").glob("*.parquet"))
    ends = []
    for f in files:
        part = pq.read_table(f).to_pandas()
        assert part["k"].fillna(-(10**9)).is_monotonic_increasing
        stats = pq.ParquetFile(f).metadata.row_group(0).column(0).statistics
        ends.append((stats.min, stats.max))
    assert len(files) == 7 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert spark.read.parquet(path).count() == 20_002
    publish.write_ordered(rows, path, ["k"], file_rows=3_000)
    found = publish.file_ranges(spark, path, ["k"]).orderBy("file").collect()
    assert all(a["high_k"] < b["low_k"] for a, b in zip(found, found[1:], strict=False)) and sum(r["n"] for r in found) == 20_002
    publish.write_ordered(rows.limit(0), path, ["k"])
    assert spark.read.parquet(path).count() == 0
