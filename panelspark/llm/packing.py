"""Packing of tokenised documents into sequences: first-fit decreasing over a tournament tree, in randomised groups.

token_pieces turns every document into pieces of at most `capacity` ids: whole sequences from the front, then the rest.
pack counts equal pieces, deals the distinct ones to groups by a hash of their content, and the copies of a repeated one to
consecutive groups, and packs each group by itself. So the work is spread evenly however the documents are keyed or
repeated, no task holds more than one group, and a lost task packs the same again.

Defined cases: a null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed each; pieces of
the same length go by doc_id and start; texts of any length are read whole; an empty table gives an empty result; other
columns of the input are not used, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .storage import small_batches, unused

CAPACITY = 4096
END_ID = 2
#: Documents of a group on average; the expected waste is less than one sequence a group.
GROUP_DOCUMENTS = 4096
#: Words of which a Python worker keeps the ids, about 40 bytes each; beyond, it keeps the half that it used most.
CACHE_WORDS = 1 << 18

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space, lower-cases, and never joins across white space.

    Each distinct word is encoded once and kept. A word's trailing ASCII punctuation is a word of its own where the
    character before it is surely a letter or digit, as the pre-tokenizer cuts there as well.
    """

    most = CACHE_WORDS

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.firsts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.used, self.pool = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def keep(self, at: np.ndarray) -> None:
        """Forgets all words but those at these places (in order)."""
        counts = self.counts[at]
        begins = np.cumsum(counts) - counts
        self.pool = self.pool[np.repeat(self.firsts[at] - begins, counts) + np.arange(int(counts.sum()))]
        self.keys, self.counts, self.used, self.firsts = self.keys[at], counts, self.used[at] // 2, begins.astype(np.int32)

    def encode(self, given: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space, one after the other, and the number of each word's ids."""
        found = self.tokenizer.encode("\n".join(given), add_special_tokens=False)
        starts = np.cumsum([0, *(len(w) + 1 for w in given)])
        at = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
        return np.array(found.ids, np.uint32), np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(given))[: len(given)]

    def learn(self, missing: np.ndarray, given: list[str]) -> None:
        ids, counts = self.encode(given)
        firsts = (len(self.pool) + np.cumsum(counts) - counts).astype(np.int32)
        at = np.searchsorted(self.keys, missing)
        self.keys, self.firsts = np.insert(self.keys, at, missing), np.insert(self.firsts, at, firsts)
        self.counts, self.used = np.insert(self.counts, at, counts.astype(np.int32)), np.insert(self.used, at, 0)
        self.pool = np.concatenate([self.pool, ids])

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and hashes of the words of a few texts."""
        mapped = words.SPACED[data]
        starts, lengths = words.bounds(mapped, offsets)
        if len(starts):
            ends = starts + lengths
            rows = np.where(_PUNCTUATION[data], -1, np.arange(len(data)))
            # the gaps after each word count as more of it; they hold white space only, which must not win
            rows[mapped == 0] = -1
            core = np.maximum.reduceat(rows, starts)
            before = np.maximum(core - 1, 0)
            letter = _ALNUM[mapped[core]] | ((data[before] == 0xC3) & (data[core] >= 0x80) & (data[core] != 0x97) & (data[core] != 0xB7))
            tail = (core >= 0) & (core + 1 < ends) & letter
            starts = np.sort(np.concatenate([starts, core[tail] + 1]))
            ends = np.sort(np.concatenate([ends, core[tail] + 1]))
            lengths = ends - starts
        return starts, lengths, words.hashes(mapped, lengths)

    def is_special(self, raw: bytes) -> bool:
        """Whether bytes may hold a special token, whose case matters."""
        return b"<|" in raw

    def spelled(self, word: bytes) -> str:
        """A word as encode takes it."""
        return word.lower().decode()

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for _, _, data, offsets in words.pieces(column):
            yield from self.ids_of(data, offsets)

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text; text i is data[offsets[i]:offsets[i + 1]]."""
        raw = data.tobytes()
        if self.is_special(raw):
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                yield np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32)
            return
        starts, lengths, keys = self.cut(data, offsets)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.keys) + len(new) > self.most or len(self.pool) > 16 * self.most:  # this text's own words stay, whatever their number
                often = np.argsort(-self.used, kind="stable")[: self.most // 2]
                often = often[np.cumsum(self.counts[often].astype(np.int64)) <= 8 * self.most]
                self.keep(np.union1d(often, at[known]))
            self.learn(distinct[new], [self.spelled(raw[a : a + n]) for a, n in zip(starts[first[new]].tolist(), lengths[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        self.used[at] += np.bincount(inverse, minlength=len(distinct))
        counts = self.counts[at].astype(np.int64)[inverse]
        begins = np.cumsum(counts) - counts
        ids = self.pool[np.repeat(self.firsts[at][inverse] - begins, counts) + np.arange(int(counts.sum()))]
        edge = np.append(begins, len(ids))[np.searchsorted(starts, offsets)]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield ids[a:b]


_tokenizers: dict[str, WordTokenizer] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece of each document, and its ids if wanted.

    tokenizer_path: a tokenizers file that is on every executor.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        tokenizer = _tokenizers[tokenizer_path]
        for batch in batches:
            out: list[tuple] = []
            pieces: list[np.ndarray] = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), tokenizer.texts(batch["text"]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                    if keep_ids:
                        pieces.append(piece.astype(np.int32))
            columns = [pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns.append(pa.array(pieces, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(words.frugal(cut), schema)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length: in descending order, each goes to the first bin that has room for it.

    A tournament tree over the bins' free room holds in each node the larger of its two children, so that the first bin
    with enough room is found from the root in as many steps as the tree is high.
    """
    n = len(lengths)
    size = 1
    while size < n:
        size *= 2
    room = [capacity] * (2 * size)
    bins, offsets = [0] * n, [0] * n
    for k in sorted(range(n), key=lambda i: -lengths[i]):
        need, node = lengths[k], 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        bins[k], offsets[k] = node - size, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            larger = max(room[2 * node], room[2 * node + 1])
            if room[node] == larger:
                break
            room[node] = larger
    return bins, offsets


def pack(pieces: DataFrame, n_documents: int, capacity: int = CAPACITY, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ids_crc32 and others, as token_pieces gives them).

    n_documents sets the number of groups. A sequence's id is its group's number times 2**32 plus its place there.
    """
    groups = max(1, -(-n_documents // group_documents))
    names, own = pieces.columns, unused(pieces.columns, "_group")
    copies = unused([*names, own], "_copies")
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"

    def one(group: pa.Table) -> pa.Table:
        group = group.take(np.repeat(np.arange(group.num_rows), group[copies].to_numpy()))
        group = group.take(pc.sort_indices(group, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]))
        bins, offsets = first_fit_decreasing(group["length"].to_pylist(), capacity)
        first = group[own][0].as_py() << 32
        out = group.select(names).append_column("sequence_id", pa.array([first + b for b in bins], pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    times, place = F.col(copies), F.col(own)
    counted = pieces.groupBy(*names).agg(F.count(F.lit(1)).alias(copies))
    counted = counted.withColumn(own, F.explode(F.sequence(F.lit(0).cast("long"), F.least(times, F.lit(groups)) - 1)))
    dealt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)) + place
    shares = F.floor(times / groups) + F.when(place < times % groups, 1).otherwise(0)
    return counted.select(*names, F.pmod(dealt, F.lit(groups)).alias(own), shares.cast("long").alias(copies)).groupBy(own).applyInArrow(one, schema)
