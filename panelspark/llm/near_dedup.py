"""Near-duplicate documents by HyperMinHash sketches, banded, estimated, then confirmed on full shingle sets.

A document's set holds its distinct runs of `width` words. Every distinct set gets REGISTERS registers. A bucket's
register keeps the smallest hash of the set's shingles that fall into the bucket, compressed to the count of its leading
zeros (6 bits) and the MANTISSA bits behind them. A bucket that stays empty takes its value from the next of a few
further hash rounds and at last from a hash of its own; the value that wins in the union of two sets wins in both sets
that have it, so that registers of any two sets, however small, agree with the probability of their Jaccard similarity.

Equal sets are one class, and only a class's smallest doc_id goes on. Bands of four registers name candidate pairs: each
member of a bucket with the bucket's hub, so a bucket of n members gives n - 1 pairs. Pairs whose estimated
similarity (corrected for registers that agree by chance) is five standard errors below the threshold go; the rest are
confirmed on the full sets. Where a bucket's members then still lie in different components, the pairs between its
components follow; in crowded buckets full sets are compared block by block instead, which gives links only, however many
pairs there are. A pair at the threshold shares no band with a chance under one in ten million.

Defined cases: a null text, or one without words, has the empty set and no link; with fewer words than `width`, the whole
sequence is the one shingle; rows with a null doc_id take no part and get a null component; rows that share a doc_id are
one document, which has the links of each of its rows. Shingles are compared by 64-bit hashes. Columns other than doc_id
and text are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, words
from .storage import checkpoint, cut, small_batches, unused

_U = np.uint64
REGISTERS = 128
#: Registers of a band; with 16 bits each, a band fills a long.
BAND = 4
MANTISSA = 10
#: Rounds in which buckets share one hash, before each empty bucket hashes the whole set by itself.
ROUNDS = 4
#: Standard errors that an estimate may lie below the threshold.
SLACK = 5.0

#: Members up to which all pairs of a bucket's components are looked at.
CROWD = 24
#: Sets of a block in crowds, and elements of a part of their product: 4 bytes for each set and element.
BLOCK = 768
ELEMENTS = 2_048
#: Ids that are sent to all tasks at most, 8 bytes each.
BROADCAST_IDS = 200_000

#: Numbers of blocks of a rung of sizes.
_RUNG = 1 << 32
_round_keys = words.mix(np.arange(1, ROUNDS + REGISTERS + 1, dtype=_U) * _U(0xA24BAED4963EE407))
_bucket_bits = REGISTERS.bit_length() - 1
_bucket_edges = np.arange(REGISTERS, dtype=_U) << _U(64 - _bucket_bits)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingles of a document's word hashes."""
    if not len(hashes):
        return hashes
    rest = hashes if len(hashes) >= width else None
    out = hashes[: max(1, len(hashes) - width + 1)].copy()
    for k in range(1, min(width, len(hashes))):
        nxt = hashes[k : k + len(out)]
        out = words.mix(out * _U(0x9E3779B97F4A7C15) + nxt)
    if rest is None:  # a whole short sequence never equals a shingle of full width
        out = words.mix(out ^ _U(0x5851F42D4C957F2D) * _U(len(hashes)))
    return np.unique(out)


def registers(found: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a sorted set that isn't empty."""
    least = np.zeros(REGISTERS, _U)
    empty = np.ones(REGISTERS, bool)
    for k in range(ROUNDS):
        now = found if k == 0 else np.sort(words.mix(found ^ _round_keys[k]))
        at = np.searchsorted(now, _bucket_edges)
        ends = np.append(at[1:], len(now))
        fill = empty & (at < ends)
        least[fill] = now[at[fill]] << _U(_bucket_bits)
        empty &= ~fill
        if not empty.any():
            break
    for j in np.flatnonzero(empty):
        least[j] = words.mix(found ^ _round_keys[ROUNDS + j]).min()
    # Leading zeros from the float's exponent, on the upper bits only so that rounding can't carry.
    top = least >> _U(11)
    zeros = 53 - np.frexp(top.astype(np.float64))[1]
    zeros = np.minimum(zeros, 53).astype(_U)
    mantissa = (least << np.minimum(zeros + _U(1), _U(63))) >> _U(64 - MANTISSA)
    return ((zeros << _U(MANTISSA)) | mantissa).astype(np.uint16)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, _, _, _, hashes, before in words.chunks(texts):
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            yield shingle_set(hashes[a:b], width)


def sketch(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, signature (of the set, 16 bytes) and registers (four to a long) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, signatures, kept = [], [], []
            for found in shingle_sets(batch["text"], width):
                sizes.append(len(found))
                signatures.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                kept.append(registers(found).view(np.int64) if len(found) else np.zeros(0, np.int64))
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            offsets = np.cumsum([0, *(len(x) for x in kept)])
            arrays = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "signature", "registers"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(words.frugal(run), "doc_id long, n_shingles long, signature binary, registers array<long>")


def chance_agreement(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """How often registers of two disjoint sets of these sizes agree."""
    k = np.arange(54)

    def exactly(n: np.ndarray) -> np.ndarray:
        load = np.maximum(n / REGISTERS, 1.0)[:, None]
        return (1 - 2.0 ** -(k + 1)) ** load - (1 - 2.0**-k) ** load

    return (exactly(n_a) * exactly(n_b)).sum(axis=1) * 2.0**-MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers, less the registers that agree by chance."""
    by_chance = chance_agreement(n_a, n_b)
    return np.clip(((a == b).mean(axis=1) - by_chance) / (1 - by_chance), 0, 1)


def _promising(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimate isn't clearly below the threshold."""
    floor = threshold - SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (batch[c].flatten().to_numpy().reshape(batch.num_rows, -1).view(np.uint16) for c in ("r_a", "r_b"))
                keep = estimate(left, right, batch["n_a"].to_numpy().astype(float), batch["n_b"].to_numpy().astype(float)) >= floor
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep))

    of = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(words.frugal(run), "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full sets have at least percent / 100 of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, None
        for batch in batches:
            keep = []
            right = batch["text_b"]
            # Rows of a hub come one after the other: its set is made once.
            for k, found in enumerate(shingle_sets(batch["text_a"], width)):
                if right[k] != last_text:
                    last_text = right[k]
                    last = next(shingle_sets(right.slice(k, 1), width))
                common = len(np.intersect1d(found, last, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(found) + len(last) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = _texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    of = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(words.frugal(run), "a long, b long")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the documents with these distinct ids. Few ids are sent to all tasks, so that only their texts are shuffled."""
    ids = checkpoint(ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common, by products of 0/1 matrices over a part of the elements at a time."""
    sizes = [len(x) for x in left], [len(x) for x in right]
    elements, columns = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = sum(sizes[0])
    rows = np.repeat(np.arange(len(left)), sizes[0]), np.repeat(np.arange(len(right)), sizes[1])
    columns = columns[:split], columns[split:]
    # Only what both sides have can be in common.
    shared = np.zeros(len(elements), bool)
    shared[np.intersect1d(columns[0], columns[1])] = True
    place = np.cumsum(shared) - 1
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(shared.sum()), ELEMENTS):
        parts = []
        for r, c, n in zip(rows, columns, (len(left), len(right)), strict=True):
            own = shared[c] & (place[c] >= start) & (place[c] < start + ELEMENTS)
            part = np.zeros((n, ELEMENTS), np.float32)
            part[r[own], place[c[own]] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _crowd_links(crowd: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the components of crowds: their full sets are compared block by block.

    crowd: bucket, id, n and label of the members of crowded buckets. Crowds that share members are one group, which is dealt
    to blocks of about BLOCK members. Larger groups are dealt by rungs of their sets' sizes first, so wide that sets more
    than a rung apart can't reach the threshold: a block meets those of its rung and the next ones only. Each two blocks meet
    in a task of their own, which returns only as many links as it takes to join the components that it finds linked.
    """
    first = crowd.groupBy("bucket").agg(F.min("id").alias("v"))
    groups = graph.components(crowd.join(first, "bucket").select(F.col("id").alias("u"), "v")).toDF("id", "crowd")
    members = checkpoint(crowd.select("id", "label", "n").distinct().join(groups, "id"))
    totals = members.groupBy("crowd").agg(F.count("*").alias("total"))
    height = 1.001 * max(math.log(100 / percent), 0.01)  # a little more than the ratio, so that rounding can't part a pair
    rung = F.when(F.col("total") > BLOCK, F.floor(F.log("n") / height)).otherwise(0).cast("long")
    members = members.join(totals, "crowd").select("crowd", "id", "label", rung.alias("rung"))
    sizes = members.groupBy("crowd", "rung").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    members = members.join(sizes, ["crowd", "rung"]).select("crowd", "id", "label", "rung", (F.col("rung") * _RUNG + F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("own"))
    beside = F.explode(F.array(*(F.col("rung") + k for k in (-1, 0, 1)))).alias("beside")
    meets = members.select("crowd", "id", "label", "own", beside).join(sizes.withColumnRenamed("rung", "beside"), ["crowd", "beside"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(batch["text"], width)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, pa.binary())], names=["id", "elements"])

    held = _texts_of(docs, members.select("id")).mapInArrow(sets, "id long, elements binary")
    cells = meets.join(held, "id").withColumn("other", F.explode(F.sequence(F.col("beside") * _RUNG, F.col("beside") * _RUNG + F.col("blocks") - 1)))
    cells = cells.select("crowd", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "label", "elements")

    def compare(cell: pa.Table) -> pa.Table:
        i, j = cell["i"][0].as_py(), cell["j"][0].as_py()
        own, ids, labels = cell["own"].to_numpy(), cell["id"].to_numpy(), cell["label"].to_numpy()
        found = [np.frombuffer(x.as_buffer(), _U) for x in cell["elements"]]
        at = [np.flatnonzero(own == k) for k in (i, j)]
        links: list[tuple[int, int]] = []
        if len(at[0]) and len(at[1]):
            common = _common([found[k] for k in at[0]], [found[k] for k in at[1]])
            n = np.array([len(x) for x in found], np.float32)
            linked = 100 * common >= percent * (n[at[0]][:, None] + n[at[1]][None, :] - common)
            linked &= (labels[at[0]][:, None] != labels[at[1]][None, :]) & (common > 0)
            root = {x: x for x in np.unique(labels).tolist()}

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in np.argwhere(linked).tolist():
                p, q = top(int(labels[at[0][x]])), top(int(labels[at[1][y]]))
                if p != q:
                    root[p] = q
                    links.append((int(ids[at[0][x]]), int(ids[at[1][y]])))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*links, strict=True) if links else [[]] * 2)], names=["a", "b"])

    return cells.groupBy("crowd", "i", "j").applyInArrow(compare, "a long, b long")


def _sizes_fit(x: Column, y: Column, percent: int) -> Column:
    """Two sets of too different sizes can't reach the threshold."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _buckets(classes: DataFrame) -> DataFrame:
    """bucket, id and n: each class once for each band."""
    return classes.select("id", "n", F.posexplode("registers").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "id", "n")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose bucket has others, with the bucket's size."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    return rows.join(sizes, "bucket")


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows in buckets of more than one component, with label, and members: how many rows the bucket has."""
    rows = rows.join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("label", "id").alias("label"))
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members")).filter("low < high")
    return checkpoint(rows.join(mixed.select("bucket", "members"), "bucket"))


def _with_hub(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a > b) of each row with its bucket's hub.

    The hub is the member that meets the most others over all buckets: the text that the others were copied from, if there
    is one, and so the likeliest to be linked with each.
    """
    meets = rows.groupBy("id").agg(F.sum("size").alias("meets"))
    hubs = rows.join(meets, "id").groupBy("bucket").agg(F.max(F.struct("meets", "id", "n")).alias("hub")).select("bucket", F.col("hub.id").alias("id_b"), F.col("hub.n").alias("n_b"))
    pairs = rows.join(hubs, "bucket").filter("id <> id_b").filter(_sizes_fit(F.col("n"), F.col("n_b"), percent))
    return pairs.select(F.greatest("id", "id_b").alias("a"), F.least("id", "id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept of every row of docs."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sketches = cut(sketch(docs, width), "sketches")
    linked = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(linked.groupBy("signature").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "classes")

    shared = cut(_shared(_buckets(classes)), "buckets")  # what shares no bucket is linked with nothing
    tried = checkpoint(_promising(_with_hub(shared, percent), classes, percent / 100))
    links = checkpoint(confirm(tried, docs, width, percent))
    # What is left are pairs of different components that meet in a bucket: all pairs of a small bucket; in crowded ones,
    # where these would be too many rows, sets are compared block by block.
    joined = graph.components(links.toDF("u", "v"))
    left = _mixed(shared, joined)
    few = left.filter(F.col("members") <= CROWD).select("bucket", "id", "n", "label")
    other = few.toDF("bucket", "id_b", "n_b", "label_b")
    rest = few.join(other, "bucket").filter("label > label_b").filter(_sizes_fit(F.col("n"), F.col("n_b"), percent))
    rest = rest.select(F.greatest("id", "id_b").alias("a"), F.least("id", "id_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = confirm(checkpoint(_promising(rest, classes, percent / 100)), docs, width, percent)
    crowd = left.filter(F.col("members") > CROWD).select("bucket", "id", "n", "label")
    more = checkpoint(more.union(_crowd_links(crowd, docs, width, percent)))

    # Classes stand for their documents; documents that have rows in several classes link these.
    rows = cut(linked.join(classes.select("signature", "id"), "signature").select("doc_id", "id"), "rows")
    own = rows.groupBy("doc_id").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    across = rows.join(own.filter("least < most"), "doc_id").select("id", "least").filter("id <> least")
    found = graph.components(more.union(across).toDF("u", "v"), joined)
    of_document = own.select("doc_id", F.col("least").alias("id")).join(found, "id", "left").select("doc_id", F.coalesce("label", "id").alias("label"))
    component = F.coalesce("label", "doc_id")
    return sketches.join(of_document, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which near_duplicates says kept."""
    name = unused(docs.columns, "_gone")
    gone = near_duplicates(docs, width, percent).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


#: Brute force over all pairs that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
