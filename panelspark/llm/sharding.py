"""Sharding by weighted rendezvous hashing of stable record keys.

Each shard draws a number from the record's key and the shard's id; the highest score, -weight / ln(draw), wins. A
record's shard depends on its key and the shards alone, and a new shard only takes the records that it wins.

Defined cases: a null key draws as the empty key; equal keys share a shard; a null text has no bytes; rows that repeat get
a slot each; an empty table gives an empty result. Slots follow doc_id, size and checksum at every size of the table; they are
counted in small ranges of that order, so that no task sorts a whole shard, even when one key holds a third of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut, unused

#: Rows of a range on average, within which slots are counted.
BUCKET_ROWS = 20_000


def draw(key: Column, shard: str) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of an MD5 digest of key and shard."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rendezvous(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The number of the shard that wins the key; shards are (number, weight). Ties go to the larger number."""
    scores = [F.struct((F.lit(-float(weight)) / F.ln(draw(key, str(number)))).alias("score"), F.lit(number).alias("shard")) for number, weight in shards]
    return F.greatest(*scores)["shard"] if len(scores) > 1 else scores[0]["shard"]


def assign(records: DataFrame, key: str, shards: Sequence[tuple[int, float]], grown: tuple[int, float] | None = None) -> DataFrame:
    """records with shard, and grown_shard: the shard once `grown` is added (null without it)."""
    shard = rendezvous(F.col(key), shards)
    after = F.lit(None).cast("int")
    if grown is not None:
        after = rendezvous(F.col(key), [*shards, grown])
    return records.select("*", shard.cast("int").alias("shard"), after.cast("int").alias("grown_shard"))


def number_slots(records: DataFrame, order: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """records (with a column shard) with slot: 0, 1, ... without gaps in each shard, by `order`, then the other columns; nulls last.

    Rows that repeat entirely are one row with a count until slots are known. The others are dealt to ranges of the order,
    which are written, counted and numbered each by itself.
    """
    columns, names = records.columns, []
    for name in ("_times", "_range", "_total", "_before", "_first", "_chunk"):
        names.append(unused(columns, name))
    times, part, total, before, first, chunk = names
    by = [F.col(c).asc_nulls_last() for c in ["shard", *order, *(c for c in columns if c not in ("shard", *order))]]
    rows = cut(records.groupBy(*columns).agg(F.count("*").alias(times)), "distinct")
    ranges = max(1, -(-rows.count() // bucket_rows))
    rows = cut(rows.repartitionByRange(ranges, *by).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("shard", part).agg(F.sum(times).alias(total))
    sizes = sizes.select("shard", part, (F.sum(total).over(W.partitionBy("shard").orderBy(part)) - F.col(total)).alias(before))
    within = F.sum(times).over(W.partitionBy("shard", part).orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(times)
    rows = rows.withColumn(first, within).join(sizes, ["shard", part]).select(*columns, times, (F.col(first) + F.col(before)).alias(first))
    # A row that repeats very often is dealt out in chunks before it is written out.
    rows = rows.select(*columns, times, first, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(bucket_rows).cast("long"))).alias(chunk)).repartition("shard", first, chunk)
    slots = F.sequence(F.col(first) + F.col(chunk), F.col(first) + F.least(F.col(chunk) + bucket_rows, F.col(times)) - 1)
    return rows.select(*columns, F.explode(slots).alias("slot"))


def shard_documents(docs: DataFrame, shards: Sequence[tuple[int, float]], grown: tuple[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard and slot of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return number_slots(cut(assign(rows, "doc_id", shards, grown), "sharding"), ["doc_id", "size", "text_crc32"])


def oracle_sql(shards: int) -> str:
    """The assignment to so many shards of weight 1, and one more, in DuckDB SQL; crc32 is folded byte by byte over a table made by its rule."""
    draw = "((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(s AS VARCHAR)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    return f"""
WITH RECURSIVE t(b, x, k) AS (SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256) UNION ALL SELECT b, {step}, k + 1 FROM t WHERE k < 8),
c AS (SELECT list(x ORDER BY b) AS tab FROM t WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, length(h) // 2 + 1 AS size, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda i: CAST(CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) AS BIGINT))) AS bytes FROM d),
f AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, y: xor(tab[xor(a, y) % 256 + 1], a // 256)), 4294967295) AS text_crc32 FROM e, c),
w AS (SELECT doc_id, arg_max(s, (-1.0 / ln({draw}), s)) FILTER (WHERE s < {shards}) AS shard, arg_max(s, (-1.0 / ln({draw}), s)) AS grown_shard FROM (SELECT DISTINCT doc_id FROM documents), range({shards + 1}) r(s) GROUP BY doc_id)
SELECT f.doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY f.doc_id, size, text_crc32) - 1 AS slot
FROM f JOIN w ON f.doc_id IS NOT DISTINCT FROM w.doc_id
"""
