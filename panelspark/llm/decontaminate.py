"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark items' windows of words. A pattern group's search keeps the last block of words of the
place in question: a shift table says how far to skip when the block can't end there, blocks that can end a pattern's
first part lead to a bucket of test strings, and their first words and then all their words are compared directly.

A benchmark beyond BLOCK_BYTES is searched with tables of bounded size instead, in one scan of the documents: its shift tables are
filled at the hashes of blocks, what they don't skip is looked up in a table of bits of the test strings' hashes, and the places that
are left, with their words, are joined with the test strings and compared directly.

Words are runs of 0-9, a-z and non-ASCII bytes after lower-casing A-Z. An item of fewer words than the window, but not
none, is one window. Defined cases: a null text has no words; a null item_id marks words, but is not listed; rows that
share an item_id are one item; an empty benchmark marks nothing; rows of documents that repeat each have their result; texts are
read whole, however long; other columns are not looked at.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words as hashing
from .joins import join_evenly, key_counts
from .storage import cut, small_batches, unused
from .words import frugal

WINDOW = 13
#: Bytes of benchmark text that a matcher holds; a larger benchmark is searched with tables of hashes.
BLOCK_BYTES = 1_000_000
#: Entries of such a shift table, a byte each, and longs of the table of bits.
SLOTS = 1 << 20
LONGS = 1 << 20
#: Places in texts that a task holds before it hands them on.
HELD_PLACES = 20_000

_word = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _word.findall(text.encode().lower()) if text else []


class _Group:
    """Patterns of similar length with the tables to search them; `length` is that of the shortest."""

    def __init__(self, patterns: dict[tuple, set]):
        self.length = min(map(len, patterns))
        self.block = min(2, self.length)
        self.longest_shift = self.length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                block = self.key(pattern, end)
                self.shift[block] = min(self.shift.get(block, self.longest_shift), self.length - end)
            self.bucket.setdefault(self.key(pattern, self.length), []).append((pattern[0], list(pattern), items))

    def key(self, words: list | tuple, end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set]]:
        """First word, word after the last, and items of each occurrence, by first word."""
        shift, bucket, length, skip = self.shift, self.bucket, self.length, self.longest_shift
        at, n, single = length - 1, len(words), self.block == 1
        while at < n:
            block = words[at] if single else (words[at - 1], words[at])
            step = shift.get(block, skip)
            if step:
                at += step
                continue
            first = at - length + 1
            for head, pattern, items in bucket[block]:
                if words[first] == head and words[first : first + len(pattern)] == pattern:
                    yield first, first + len(pattern), items
            at += 1


class Matcher:
    """All windows of a block of benchmark items."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        groups: dict[int, dict[tuple, set]] = {}
        for item_id, text in items:
            found = words_of(text)
            for k in range(max(1, len(found) - window + 1) if found else 0):
                pattern = tuple(found[k : k + window])
                # Lengths 1, 2-3, 4-7, ... go together; whole windows have tables of their own and so long shifts.
                group = -1 if len(pattern) == window else len(pattern).bit_length()
                groups.setdefault(group, {}).setdefault(pattern, set()).add(item_id)
        self.groups = [_Group(x) for x in groups.values()]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Word spans that lie in occurrences, apart from each other and in order, and the items found, sorted."""
        spans, items = [], set()
        for group in self.groups:
            for first, last, own in group.search(words):
                spans.append((first, last))
                items |= own
        return merged(spans), sorted(x for x in items if x is not None)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Distinct items (item_id, text), and the bytes of their texts."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    return items, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _held(items: DataFrame, window: int) -> Broadcast:
    """A number for the matcher, the window and the items, which have been found to be small."""
    found = tuple(tuple(r) for r in items.select("item_id", "text").collect())
    return items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, window, found))


_last: list = [None, None]


def _matcher(block) -> Matcher:
    """A Python worker keeps the last matcher from task to task."""
    key, window, items = block.value
    if _last[0] != key:
        _last[:] = None, None
        _last[:] = key, Matcher(items, window)
    return _last[1]


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_FOUND = "n_words long, spans array<struct<first: long, last: long>>, item_ids array<string>"


def _searched(docs: DataFrame, key: str, block) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block)
        for batch in batches:
            sizes, spans, items = [], [], []
            for text in batch["text"]:
                found = words_of(text.as_py())
                where, which = matcher.search(found)
                sizes.append(len(found))
                spans.append([{"first": a, "last": b} for a, b in where])
                items.append(which)
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=[key, "n_words", "spans", "item_ids"])

    return docs.select(key, "text").mapInArrow(frugal(run), f"`{key}` long, {_FOUND}")


_U = np.uint64
#: Bytes of words; all others part them.
_WORDS = hashing.table([range(0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)])
#: Kinds of rows of the tables, beside the groups of test strings: bits of hashes, and lengths that there are.
_BITS, _LENGTHS = 0, -2


def _located(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: folded bytes in which its words lie, and the words' starts in them, lengths and hashes."""
    for _, _, data, starts, lengths, hashes, before in hashing.chunks(texts, _WORDS):
        folded = _WORDS[data].tobytes()
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            yield folded, starts[a:b], lengths[a:b], hashes[a:b]


def _joined(folded: bytes, starts: np.ndarray, lengths: np.ndarray, at: int, n: int) -> str:
    return b" ".join(folded[a : a + k] for a, k in zip(starts[at : at + n].tolist(), lengths[at : at + n].tolist(), strict=True)).decode()


def _group_of(length: int, window: int) -> tuple[int, int]:
    """The group of test strings of this length, as Matcher has them, and the words of its strings that are looked at."""
    return (-1, window) if length == window else (length.bit_length(), 1 << (length.bit_length() - 1))


def _slots(hashes: np.ndarray, size: int, slots: int) -> np.ndarray:
    """The entries, out of so many slots, of the blocks that end at each word from number min(2, size) - 1 on."""
    return ((hashes if size == 1 else hashing.pairs(hashes)) & _U(slots - 1)).astype(np.int64)


def _string_hashes(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the `length` words from each place on."""
    out = hashes[at] + _U(length)
    for k in range(1, length):
        out = hashing.mix(out * _U(0x9E3779B97F4A7C15) + hashes[at + k])
    return out


def _bit(strings: np.ndarray, longs: int) -> tuple[np.ndarray, np.ndarray]:
    """The long, out of so many, and the bit of each hash in the table of bits."""
    return ((strings >> _U(6)) & _U(longs - 1)).astype(np.int64), _U(1) << (strings & _U(63))


def _windows(hashes: np.ndarray, window: int) -> tuple[int, np.ndarray]:
    """The length of an item's test strings, and where they begin."""
    length = min(window, len(hashes))
    return length, np.arange(len(hashes) - length + 1 if length else 0)


class _Tables:
    """Shift tables by group with the words looked at and the lengths, and the table of bits."""

    def __init__(self, window: int, found: pa.Table, slots: int, longs: int):
        kinds, at = found["kind"].to_numpy(), found["slot"].to_numpy()
        self.groups: dict[int, tuple[int, list[int], np.ndarray]] = {}
        for length in sorted(at[kinds == _LENGTHS].tolist()):
            group, size = _group_of(length, window)
            if group not in self.groups:
                own, table = kinds == group, np.full(slots, min(255, size - min(2, size) + 1), np.uint8)
                table[at[own]] = found["low"].to_numpy()[own]
                self.groups[group] = size, [], table
            self.groups[group][1].append(length)
        self.bits = _bit_table(at[kinds == _BITS], found["bits"].to_numpy()[kinds == _BITS], longs)

    def places(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Lengths with the places in a text where strings of the length may stand, and the hashes of the words there."""
        for size, lengths, table in self.groups.values():
            if len(hashes) < size:
                continue
            first = min(2, size) - 1
            steps = table[_slots(hashes, size, len(table))].tobytes()
            at, n, found = size - 1 - first, len(steps), []
            while at < n:
                step = steps[at]
                if not step:
                    found.append(at)
                at += step or 1
            starts = np.array(found, np.int64) - (size - 1 - first)
            for length in lengths:
                own = starts[starts + length <= len(hashes)]
                strings = _string_hashes(hashes, own, length)
                good = _among(self.bits, strings)
                yield length, own[good], strings[good]


def _bit_table(at: np.ndarray, bits: np.ndarray, longs: int) -> np.ndarray:
    out = np.zeros(longs, _U)
    out[at] = bits.view(_U)
    return out


def _among(bits: np.ndarray, strings: np.ndarray) -> np.ndarray:
    long, bit = _bit(strings, len(bits))
    return bits[long] & bit != 0


def _tables(items: DataFrame, window: int, slots: int, longs: int) -> Broadcast:
    """The tables of all items. Spark aggregates their entries, so that no more than the tables reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, places, values = [], [], []

            def add(kind: int, place: np.ndarray, value: np.ndarray) -> None:
                kinds.append(np.full(len(place), kind, np.int32)), places.append(place), values.append(value)

            for _, _, _, hashes in _located(batch["text"]):
                length, starts = _windows(hashes, window)
                if not length:
                    continue
                group, size = _group_of(length, window)
                blocks = _slots(hashes if group < 0 else hashes[:size], size, slots)
                add(group, blocks, np.clip(size - min(2, size) - np.arange(len(blocks)), 0, 255))
                long, bit = _bit(_string_hashes(hashes, starts, length), longs)
                add(_BITS, long, bit.view(np.int64))
                add(_LENGTHS, np.array([length]), np.array([0]))
            if kinds:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, places, values)], names=["kind", "slot", "value"])

    entries = items.select("text").mapInArrow(frugal(run), "kind int, slot long, value long").groupBy("kind", "slot")
    found = entries.agg(F.min("value").alias("low"), F.bit_or("value").alias("bits")).toArrow()
    return items.sparkSession.sparkContext.broadcast(_Tables(window, found, slots, longs))


_PLACES = "_row long, key long, n_words long, first long, length int, hash long, words string"


def _places(docs: DataFrame, key: str, tables: Broadcast) -> DataFrame:
    """A row with key and n_words for each row of docs, and one with first, length, hash and words for each place that may be hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        names = ["_row", "key", "n_words", "first", "length", "hash", "words"]
        out: list[tuple] = []

        def handed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for row, own, (folded, starts, lengths, hashes) in zip(batch["_row"].to_pylist(), batch["key"].to_pylist(), _located(batch["text"]), strict=True):
                out.append((row, own, len(hashes), None, None, None, None))
                for length, at, strings in tables.value.places(hashes):
                    for first, string in zip(at.tolist(), strings.view(np.int64).tolist(), strict=True):
                        out.append((row, None, None, first, length, string, _joined(folded, starts, lengths, first, length)))
                        if len(out) >= HELD_PLACES:
                            yield handed()
            yield handed()

    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("key"), "text").mapInArrow(frugal(run), _PLACES)


def _strings(items: DataFrame, window: int, counts: DataFrame, longs: int) -> DataFrame:
    """length, hash, words and items (sorted) of the test strings whose bits are among those of the places' hashes."""
    bits = counts.groupBy(F.shiftrightunsigned("hash", 6).bitwiseAND(F.lit(longs - 1)).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("bits")).toArrow()
    seen = items.sparkSession.sparkContext.broadcast(_bit_table(bits["slot"].to_numpy(), bits["bits"].to_numpy(), longs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item_id, (folded, starts, lengths, hashes) in zip(batch["item_id"].to_pylist(), _located(batch["text"]), strict=True):
                length, at = _windows(hashes, window)
                if not length:
                    continue
                strings = _string_hashes(hashes, at, length)
                good = _among(seen.value, strings)
                for first, string in zip(at[good].tolist(), strings[good].view(np.int64).tolist(), strict=True):
                    out.append((length, string, _joined(folded, starts, lengths, first, length), item_id))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["length", "hash", "words", "item_id"])

    found = items.mapInArrow(frugal(run), "length int, hash long, words string, item_id string")
    return found.groupBy("length", "hash", "words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _searched_by_join(docs: DataFrame, items: DataFrame, window: int, key: str, slots: int = SLOTS, longs: int = LONGS) -> DataFrame:
    """What _searched gives, for a benchmark of any size."""
    found = cut(_places(docs, key, _tables(items, window, slots, longs)), "places")
    places = found.filter("length IS NOT NULL").select("_row", "first", "length", "hash", "words")
    counts = key_counts(places, ["length", "hash"])
    strings = cut(_strings(items, window, counts, longs).withColumn("set", F.md5(F.to_json("items"))), "strings")
    own = strings.select("length", "hash", F.col("words").alias("string"), "set")
    hits = cut(join_evenly(places, own, ["length", "hash"], counts).filter("words = string").select("_row", "first", (F.col("first") + F.col("length")).alias("last"), "set"), "hits")
    # Spans that overlap or touch are one: each begins where a hit begins behind all that came before it.
    before = W.partitionBy("_row").orderBy("first", "last")
    reach = F.max("last").over(before.rowsBetween(W.unboundedPreceding, -1))
    runs = hits.select("_row", "first", "last", (reach.isNull() | (F.col("first") > reach)).cast("long").alias("new")).withColumn("run", F.sum("new").over(before.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("_row", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    sets = strings.select("set", "items").distinct()
    listed = join_evenly(hits.select("_row", "set").distinct(), sets, ["set"]).groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    heads = found.filter("length IS NULL").select("_row", F.col("key").alias(key), "n_words")
    none = F.expr("CAST(array() AS array<struct<first: bigint, last: bigint>>)")
    return heads.join(spans, "_row", "left").join(listed, "_row", "left").select(key, "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("item_ids", F.expr("CAST(array() AS array<string>)")).alias("item_ids"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, key: str = "doc_id") -> DataFrame:
    """Of every row of docs: the key, n_words, spans of words that lie in windows, and the item_ids of those windows.

    Tasks hold a benchmark of up to block_bytes; beyond, they hold tables of bounded size, and places and test strings are joined.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias(key), "text")
    items, size = _items(benchmark)
    if size > block_bytes:
        return _searched_by_join(docs, items, window, key)
    return _searched(docs, key, _held(items, window))


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def is_contaminated(share: int = 20) -> F.Column:
    """At least one word in `share` is hit."""
    return (n_hit() > 0) & (F.lit(share) * n_hit() >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated."""
    small_batches(docs.sparkSession)
    items, size = _items(benchmark)
    if size > block_bytes:
        row = unused(docs.columns, "_kept_row")
        rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
        bad = contamination(rows, benchmark, window, block_bytes, row).filter(is_contaminated(share)).select(row)
        return rows.join(bad, row, "left_anti").select(*docs.columns)
    block = _held(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block)
        for batch in batches:
            keep = []
            for text in batch["text"]:
                found = words_of(text.as_py())
                hit = sum(b - a for a, b in matcher.search(found)[0])
                keep.append(not (hit and share * hit >= len(found)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM p),
v AS (
  SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, s WHERE len(w) >= size)),
m AS (SELECT doc_id, k, size, item_id FROM v JOIN p USING (size, words)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
