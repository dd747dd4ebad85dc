"""Language-model scoring by a Brown class-based bigram model: P(word | before) = P(class | class before) P(word | class).

Statistics cover every training text. Words are 64-bit hashes (see words). Every word that training texts hold twice or more
has a class of its own, in a table of words that grows with the corpus. It is found in two steps, frequent words first:

1. Exchange clustering of units: each of the UNITS most frequent words is a unit, and all other words share one by the
form of their ending. In each round every unit is weighed in every class, against counts that leave it out, by the
likelihood of the classes before and after it, and goes to the best. One pass over the texts counts the pairs of units, at
most UNITS squared however large the corpus is; rounds read these counts only, and move a part of the units at a time. A round after which the likelihood is lower is undone, and smaller parts move from
then on. Rounds end when the last ones gained too little (GAIN).
2. Every other repeated word is taken out of its form's class and goes to its best one in the same way, by its own counts
per side and neighbouring class, which tasks add up by ranges of word hashes. This is done once; a neighbour that isn't
a unit counts there with its form's class.

Transitions and emissions are then counted anew, with each word's final class. Words seen once and unknown words have the
class of their form, so that any word has a class without a lookup.

Emission: known words share a class's mass by their counts plus ADDED; the rest, the share of words seen once in the class
(Good-Turing), is that of unknown words. Transitions are smoothed towards the classes' own shares.

Counts and classes of the HEAD most frequent words are sent to all tasks (a bounded table); other words of a text are
looked up by a join on the word, once for each text.

Defined cases: a null or empty text is the end token alone; rows with a null doc_id are scored, and whether they
train is for the caller's condition to say; repeated rows count each, in training and in scores; texts are read whole,
however long; of words of equal counts, those with the smallest hashes are the more frequent; a corpus without training
rows gives every word the smoothed chance of an unknown one; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .storage import cut, small_batches

#: The most frequent words that are clustered first, as units of their own, and units of word forms.
UNITS = 1 << 14
FORMS = 512
CLASSES = 64
#: Rounds end once a round gains less than this logarithm of likelihood a token, on average over the last ones; and at ROUNDS.
GAIN = 1e-3
ROUNDS = 30
#: Parts of units that move at a time, at first and at most.
PARTS, MOST_PARTS = 2, 16
#: Words whose counts and classes every task holds.
HEAD = 1 << 18
#: Ranges of counts in which words are counted at once.
RANGES = 512
ADDED = 0.1
#: Weight of the classes' own shares in transitions, in tokens.
BACKOFF = 2.0

_U = np.uint64
_END = 0  # the unit of text ends; words' units follow
#: Words of a range of hashes, on average, whose classes one task finds at once.
_RANGE_WORDS = 8_192


def forms(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number under FORMS for each word, by its last two bytes and whether it has any beyond ASCII."""
    lower = words.SPACED[data].astype(np.uint32)
    last = starts + lengths - 1
    wide = np.add.reduceat((data >= 128).astype(np.int32), starts) > 0 if len(starts) else np.zeros(0, bool)
    before = np.where(lengths > 1, lower[np.maximum(last - 1, 0)], 0) if len(starts) else np.zeros(0, np.uint32)
    return (((lower[last] * np.uint32(256) + before) * np.uint32(2) + wide) * np.uint32(0x9E3779B1)) >> np.uint32(32 - (FORMS.bit_length() - 1))


def _counted(texts: DataFrame) -> DataFrame:
    """word (hash), form and n of every word of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(keys: np.ndarray, form: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.argsort(keys)
            keys, form, n = keys[order], form[order], n[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            return keys[first], form[first], np.add.reduceat(n, first) if len(first) else n

        def rows(kept: list) -> pa.RecordBatch:
            keys, form, n = (np.concatenate(c) for c in zip(*kept, strict=True))
            keys, form, n = counted(keys, form, n)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(form.astype(np.int32)), pa.array(n)], names=["word", "form", "n"])

        kept, size = [], 0
        for batch in batches:
            for _, _, data, starts, lengths, hashes, _ in words.chunks(batch["text"]):
                if len(hashes):
                    kept.append(counted(hashes, forms(data, starts, lengths), np.ones(len(hashes), np.int64)))
                    size += len(kept[-1][0])
                if size > 2_000_000:  # bounds memory; the shuffle adds up the rest
                    yield rows(kept)
                    kept, size = [], 0
        if kept:
            yield rows(kept)

    return texts.select("text").mapInArrow(run, "word long, form int, n long").groupBy("word").agg(F.min("form").alias("form"), F.sum("n").alias("n"))


def _cutoff(counts: DataFrame, most: int) -> tuple[int, int]:
    """The least count of which, with all larger ones, at most `most` words are; and how many words those are.

    Found by counting words in ranges of counts, at most RANGES at a time, within the range in which the cut lies.
    """
    low, high, above = 2, 1 << 62, 0  # words of counts from `high` on fit
    while True:
        edges = sorted({min(high, max(low, x)) for x in ([low << k for k in range(63)] if high == 1 << 62 else np.linspace(low, high, min(RANGES, high - low) + 1).astype(np.int64).tolist())} | {high})
        part = F.array_size(F.filter(F.lit(edges), lambda e: e <= F.col("n")))
        found = {r["part"]: r["size"] for r in counts.filter((F.col("n") >= low) & (F.col("n") < high)).groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect()}  # a row a range
        for k in range(len(edges) - 1, 0, -1):
            if above + found.get(k, 0) > most:
                low, high = edges[k - 1], edges[k]
                break
            above += found.get(k, 0)
        else:
            return low, above
        if high - low == 1:
            return high, above


def _most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, sorted, counts and forms of the `most` most frequent words; of the last count that fits in part, the smallest hashes."""
    least, total = _cutoff(counts, most)
    counts = counts.select("word", "n", "form").filter("n > 1")
    chosen = counts.filter(F.col("n") >= least)
    if total < most:
        chosen = chosen.union(counts.filter(F.col("n") == least - 1).orderBy("word").limit(most - total))
    found = chosen.toArrow()
    keys = found["word"].to_numpy().view(_U)
    order = np.argsort(keys)
    return keys[order], found["n"].to_numpy()[order], found["form"].to_numpy()[order]


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted among sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _encoded(docs: DataFrame, head) -> DataFrame:
    """Of each row: doc_id, trains, units (four bytes each: words of the head, then forms), n_tokens, and of its words in the
    head the number and the sum of log10(count + ADDED); of the others the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = head.value
        logs = np.log10(n + ADDED)
        for batch in batches:
            out: list[tuple] = []
            for _, _, data, starts, lengths, hashes, before in words.chunks(batch["text"]):
                at, known = _lookup(keys, hashes)
                form = forms(data, starts, lengths).astype(np.int64) + 1 + len(keys)
                units = np.where(known, at + 1, form).astype("<u4")
                weight = np.concatenate([[0.0], np.cumsum(np.where(known, logs[at], 0.0) if len(keys) else np.zeros(len(at)))])
                total = np.concatenate([[0], np.cumsum(known)])
                for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
                    out.append((units[a:b].tobytes(), b - a + 1, int(total[b] - total[a]), weight[b] - weight[a], hashes[a:b][~known[a:b]].tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
            arrays = [batch["doc_id"], batch["trains"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=_ENCODED)

    return docs.mapInArrow(run, "doc_id long, trains boolean, units binary, n_tokens long, n_head long, log_head double, rare binary")


_ENCODED = ["doc_id", "trains", "units", "n_tokens", "n_head", "log_head", "rare"]


def _joined(column: pa.Array) -> np.ndarray:
    """Units of texts one after the other, with the end's unit before the first and after each."""
    out = [np.zeros(1, np.uint32)]
    for x in column:
        out += [np.frombuffer(x.as_buffer(), "<u4"), out[0]]
    return np.concatenate(out)


#: Units of a block, whose neighbours are one row.
_BLOCK = 64
#: Texts whose units are counted at once.
_TEXTS = 2048


def _neighbours(units: DataFrame, coarse: np.ndarray, n_units: int) -> DataFrame:
    """block, and of each side of its units the cells (place in the block * n_units + neighbouring unit) and their counts.

    One pass over the texts; what is written has a row for each block and a cell for each pair of units that occurs, at most
    _BLOCK * n_units a row and side, however long the texts are.
    """
    shared = units.sparkSession.sparkContext.broadcast(coarse)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(kept: list[np.ndarray]) -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

        unit_of, kept, size = shared.value.astype(np.int64), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                u = unit_of[_joined(batch["units"][at : at + _TEXTS])]
                kept.append(u[:-1] * n_units + u[1:])
                size += len(kept[-1])
                if size > 2_000_000:  # bounds memory; the shuffle adds up the rest
                    yield counted(kept)
                    kept, size = [], 0
        if kept:
            yield counted(kept)

    def pack(group: pa.Table) -> pa.Table:
        side, cell, n = (group[c].to_numpy() for c in ("side", "cell", "n"))
        columns = [group["block"][:1].cast(pa.int32())]
        for own in (side == 0, side == 1):
            columns += [pa.array([cell[own].astype("<i4").tobytes()], pa.binary()), pa.array([n[own].astype("<i8").tobytes()], pa.binary())]
        return pa.table(columns, names=["block", *_SIDES])

    pairs = units.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    left, right = F.floor(F.col("pair") / n_units).cast("long"), F.col("pair") % n_units
    ends = [F.struct(F.lit(side).alias("side"), unit.alias("unit"), other.alias("other")) for side, unit, other in ((0, right, left), (1, left, right))]
    rows = pairs.select("n", F.inline(F.array(*ends)))
    rows = rows.select(F.floor(F.col("unit") / _BLOCK).cast("int").alias("block"), "side", (F.col("unit") % _BLOCK * n_units + F.col("other")).cast("int").alias("cell"), "n")
    return cut(rows.groupBy("block").applyInArrow(pack, f"block int, {', '.join(f'{c} binary' for c in _SIDES)}"), "neighbours")


_SIDES = ["before", "n_before", "after", "n_after"]


def _cells(row: dict, side: str, n_units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of units in their block, neighbouring units and counts of one side of a row of neighbours."""
    cell = np.frombuffer(row[side], "<i4")
    return cell // n_units, cell % n_units, np.frombuffer(row[f"n_{side}"], "<i8")


def _between(neighbours: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """Counts of neighbouring classes."""
    shared, n_units = neighbours.sparkSession.sparkContext.broadcast(classes), len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value.astype(np.int64), np.zeros(n_classes * n_classes)
        for batch in batches:
            for row in batch.to_pylist():
                own, other, n = _cells(row, "after", n_units)
                total += np.bincount(of[row["block"] * _BLOCK + own] * n_classes + of[other], weights=n, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen].astype(np.int64))], names=["pair", "n"])

    return _matrix(neighbours.select("block", "after", "n_after").mapInArrow(run, "pair int, n long"), n_classes)


def _moved(neighbours: DataFrame, classes: np.ndarray, transitions: np.ndarray, turn: int, share: int) -> DataFrame:
    """unit and class of the units, one of `share` parts of which is moved to where it is likeliest."""
    n_classes, n_units = len(transitions), len(classes)
    shared = neighbours.sparkSession.sparkContext.broadcast((classes, transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, between = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                sides = []
                for side in ("before", "after"):
                    own, other, n = _cells(row, side, n_units)
                    sides.append(np.bincount(own * n_classes + of[other], weights=n, minlength=_BLOCK * n_classes).reshape(_BLOCK, n_classes))
                before, after = sides
                first = row["block"] * _BLOCK
                new = of[first : first + _BLOCK].copy()
                parts = words.mix(np.arange(first, first + len(new), dtype=_U)) % _U(share)
                for k in np.flatnonzero((parts == turn % share) & before[: len(new)].any(axis=1)).tolist():
                    if first + k != _END:
                        new[k] = best_class(before[k], after[k], int(of[first + k]), between)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(new)), pa.int32()), pa.array(new.astype(np.int32))], names=["unit", "class"])

    return neighbours.mapInArrow(run, "unit int, class int")


def best_class(before: np.ndarray, after: np.ndarray, now: int, between: np.ndarray) -> int:
    """The class in which a unit's neighbours are likeliest.

    before, after: how often each class stands before and after the unit; between: counts of class pairs. The change of
    sum N(c, d) log N(c, d) - sum N(c) log N(c) (for left and right) when the unit, first taken out of its class, joins each.
    """
    rest = between.copy()
    rest[:, now] -= before
    rest[now, :] -= after
    rest = np.maximum(rest, 0.0)
    # The neighbours' own places stay taken wherever the unit goes.
    left, right = rest.sum(axis=1) + before, rest.sum(axis=0) + after
    seen_b, seen_a = np.flatnonzero(before), np.flatnonzero(after)

    def xlogx(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    into = rest[seen_b]
    gain = (xlogx(into + before[seen_b, None]) - xlogx(into)).sum(axis=0)
    out = rest[:, seen_a]
    gain += (xlogx(out + after[seen_a]) - xlogx(out)).sum(axis=1)
    # A class beside itself takes both in one cell.
    own = rest.diagonal()
    gain += xlogx(own + before + after) - xlogx(own + before) - xlogx(own + after) + xlogx(own)
    gain -= xlogx(right + before.sum()) - xlogx(right) + xlogx(left + after.sum()) - xlogx(left)
    gain[_END] = -np.inf  # text ends stay a class of their own
    return int(gain.argmax()) if gain.max() > gain[now] + 1e-9 else now


def best_classes(before: np.ndarray, after: np.ndarray, now: np.ndarray, between: np.ndarray, rows: int = 256) -> np.ndarray:
    """best_class of many words at once: before and after have a row for each.

    Classes without words take none here, as all words that are weighed at once would go to the same.
    """
    out, empty = now.copy(), between.sum(axis=0) == 0

    def xlogx(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    def joined(side: np.ndarray, other: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        k, c = np.nonzero(side)
        n = side[k, c]
        base = counts[c]
        base[np.arange(len(k)), own[k]] -= n
        inside = np.flatnonzero(c == own[k])
        base[inside] -= other[k[inside]]
        base = np.maximum(base, 0.0)
        return np.add.reduceat(xlogx(base + n[:, None]) - xlogx(base), np.searchsorted(k, np.arange(len(side))))

    for at in range(0, len(now), rows):
        b, a, own = before[at : at + rows].astype(float), after[at : at + rows].astype(float), now[at : at + rows].astype(np.int64)
        line, nb, na = np.arange(len(own)), b.sum(axis=1), a.sum(axis=1)
        gain = joined(b, a, own, between) + joined(a, b, own, between.T)
        diagonal = np.repeat(between.diagonal()[None], len(own), axis=0)
        diagonal[line, own] -= b[line, own] + a[line, own]
        diagonal = np.maximum(diagonal, 0.0)
        gain += xlogx(diagonal + b + a) - xlogx(diagonal + b) - xlogx(diagonal + a) + xlogx(diagonal)
        left, right = np.repeat(between.sum(axis=1)[None], len(own), axis=0), np.repeat(between.sum(axis=0)[None], len(own), axis=0)
        left[line, own] -= na
        right[line, own] -= nb
        left, right = np.maximum(left, 0.0), np.maximum(right, 0.0)
        gain -= xlogx(right + nb[:, None]) - xlogx(right) + xlogx(left + na[:, None]) - xlogx(left)
        gain[:, _END] = -np.inf
        gain[:, empty] = -np.inf
        best = gain.argmax(axis=1)
        out[at : at + rows] = np.where(gain[line, best] > gain[line, own] + 1e-9, best, own)
    return out


def _placed(training: DataFrame, keys: np.ndarray, own: np.ndarray, classes: np.ndarray, between: np.ndarray, n_types: int) -> DataFrame:
    """word, class and in_head of every repeated word that isn't a unit.

    training: units and rare; keys: the words of the head; own: which units of texts are units of the clustering;
    classes: of the units of texts; between: counts of class pairs.
    """
    n_classes = len(between)
    bits = max(4, int(np.ceil(np.log2(max(n_types, 1) / _RANGE_WORDS))))
    shared = training.sparkSession.sparkContext.broadcast((keys, own, classes.astype(np.uint8), between))
    names = ["range", "words", "in_head", "now", "sizes", "cells", "counts"]

    def counted(kept: list[tuple]) -> pa.RecordBatch:
        word, unit, pair = (np.concatenate(c) for c in zip(*kept, strict=True))
        head, _, of, _ = shared.value
        found, first, same = np.unique(word, return_index=True, return_inverse=True)
        cells, n = np.unique(np.concatenate([same * (2 * n_classes) + pair[:, 0], same * (2 * n_classes) + n_classes + pair[:, 1]]), return_counts=True)
        at = cells // (2 * n_classes)
        sizes = np.bincount(at, minlength=len(found))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ranges = (found >> _U(64 - bits)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.diff(ranges, prepend=-1)), len(found))
        out = []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            unit_of = unit[first[x:y]]
            cell = slice(ends[x], ends[y])
            out.append((int(ranges[x]), found[x:y].tobytes(), (unit_of <= len(head)).tobytes(), of[unit_of].tobytes(), sizes[x:y].astype("<u2").tobytes(), (cells[cell] % (2 * n_classes)).astype("<u2").tobytes(), n[cell].astype("<u4").tobytes()))
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, unit, of, _ = shared.value
        kept, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                u = _joined(batch["units"][at : at + _TEXTS])
                place = np.flatnonzero(~unit[u])
                if not len(place):
                    continue
                mine = u[place]
                word = np.empty(len(place), _U)
                late = mine > len(head)
                word[~late] = head[mine[~late].astype(np.int64) - 1]
                word[late] = np.frombuffer(b"".join(x.as_py() for x in batch["rare"][at : at + _TEXTS]), _U)
                kept.append((word, mine, np.stack([of[u[place - 1]], of[u[place + 1]]], axis=1)))
                size += len(place)
                if size > 2_000_000:  # bounds memory; the shuffle adds up the rest
                    yield counted(kept)
                    kept, size = [], 0
        if kept:
            yield counted(kept)

    def place(group: pa.Table) -> pa.Table:
        pairs = shared.value[3]
        word, in_head, now, sizes, cells, n = (np.frombuffer(b"".join(group[c].to_pylist()), t) for c, t in zip(names[1:], (_U, bool, np.uint8, "<u2", "<u2", "<u4"), strict=True))
        found, first, same = np.unique(word, return_index=True, return_inverse=True)
        total = np.bincount(np.repeat(same, sizes) * (2 * n_classes) + cells, weights=n, minlength=len(found) * 2 * n_classes).reshape(-1, 2, n_classes)
        again = np.flatnonzero(total[:, 0].sum(axis=1) > 1)
        new = best_classes(total[again, 0], total[again, 1], now[first[again]].astype(np.int32), pairs)
        return pa.table({"word": pa.array(found[again].view(np.int64)), "class": pa.array(new, pa.int32()), "in_head": pa.array(in_head[first[again]])})

    parts = training.select("units", "rare").mapInArrow(run, "range int, words binary, in_head binary, now binary, sizes binary, cells binary, counts binary")
    return parts.groupBy("range").applyInArrow(place, "word long, class int, in_head boolean")


def likelihood(between: np.ndarray) -> float:
    """What of the log likelihood of a text depends on its words' classes, from counts of class pairs."""

    def xlogx(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1.0))).sum())

    return xlogx(between) - xlogx(between.sum(axis=0)) - xlogx(between.sum(axis=1))


def cluster(units: DataFrame, coarse: np.ndarray, n_units: int, n_classes: int = CLASSES, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit by exchange clustering over a table of units (four bytes each, a binary per text), which coarse maps to
    units of the clustering; and the counts of class pairs then. Rounds never lower the likelihood."""
    classes = (1 + words.mix(np.arange(n_units, dtype=_U)) % _U(n_classes - 1)).astype(np.int32)
    classes[_END] = _END
    neighbours = _neighbours(units, coarse, n_units)
    between = _between(neighbours, classes, n_classes)
    now, share, gains = likelihood(between), PARTS, []
    for turn in range(rounds):
        moved = _moved(neighbours, classes, between, turn, share).toArrow()
        new = classes.copy()
        new[moved["unit"].to_numpy()] = moved["class"].to_numpy()
        counts = _between(neighbours, new, n_classes)
        then = likelihood(counts)
        if then < now:
            if share == MOST_PARTS:
                break
            share, gains = 2 * share, []
            continue
        gains.append(then - now)
        classes, between, now = new, counts, then
        if len(gains) >= share and sum(gains[-share:]) <= gain * share * between.sum():
            break
    return classes, between


def _classed(encoded: DataFrame, lexicon: DataFrame, classes: np.ndarray) -> DataFrame:
    """Of each row of encoded: classes (a byte a word), those of its unknown words, n_tokens, n_known and the sum of log10(count + ADDED)."""
    shared = encoded.sparkSession.sparkContext.broadcast(classes.astype(np.uint8))

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch["rare"]).to_numpy(zero_copy_only=False) // 8
            hashes = np.frombuffer(b"".join(x.as_py() for x in batch["rare"]), np.int64)
            rows = np.repeat(batch["row"].to_numpy(), sizes)
            order = np.lexsort((hashes, rows))
            hashes, rows = hashes[order], rows[order]
            once = np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(rows[once]), pa.array(hashes[once])], names=["row", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        first_form = len(of) - FORMS
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch["found"]), 0).to_numpy(zero_copy_only=False))
            found = batch["found"].flatten()
            word, n, own = (found.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            out, a = [], 0
            for units, rare, b in zip(batch["units"], batch["rare"], ends.tolist(), strict=True):
                u = np.frombuffer(units.as_buffer(), "<u4")
                c = of[u]
                late = np.flatnonzero(u >= first_form)
                order = np.argsort(word[a:b])
                at, known = _lookup(word[a:b][order], np.frombuffer(rare.as_buffer(), np.int64))
                at = order[at[known]]
                c[late[known]] = own[a:b][at]
                out.append((c.tobytes(), c[late[~known]].tobytes(), int(known.sum()), float(np.log10(n[a:b][at] + ADDED).sum() + (~known).sum() * np.log10(ADDED))))
                a = b
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.float64()), strict=True)]
            arrays[2:] = [pc.add(batch["n_head"], arrays[2]), pc.add(batch["log_head"], arrays[3])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["trains"], batch["n_tokens"], *arrays], names=["doc_id", "trains", "n_tokens", "classes", "unknown", "n_known", "log_n"])

    rare = encoded.filter(F.length("rare") > 0).select("row", "rare").mapInArrow(rare_words, "row long, word long")
    rare = rare.join(lexicon, "word").groupBy("row").agg(F.collect_list(F.struct("word", "n", "class")).alias("found"))
    return encoded.join(rare, "row", "left").mapInArrow(run, "doc_id long, trains boolean, n_tokens long, classes binary, unknown binary, n_known long, log_n double")


def _class_pairs(classed: DataFrame, n_classes: int) -> np.ndarray:
    """Counts of neighbouring classes in texts of classes, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, end = np.zeros(n_classes * n_classes, np.int64), bytes([_END])
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                c = np.frombuffer(end + b"".join(x.as_py() + end for x in batch["classes"][at : at + _TEXTS]), np.uint8).astype(np.int64)
                total += np.bincount(c[:-1] * n_classes + c[1:], minlength=n_classes * n_classes)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["pair", "n"])

    return _matrix(classed.select("classes").mapInArrow(run, "pair int, n long"), n_classes)


def _matrix(pairs: DataFrame, n_classes: int) -> np.ndarray:
    out = np.zeros(n_classes * n_classes)
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(n_classes, n_classes)


def score(docs: DataFrame, trains: Column, added: float = ADDED) -> DataFrame:
    """Of every row of docs (doc_id, text): trains, n_tokens, n_known, train_tokens, base_score, score and perplexity (by score, of a token).

    Both scores are log10 probabilities of the whole text, its end included: base_score by smoothed word counts, score by
    the class model. trains is a condition that says which rows the model learns from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(trains, F.lit(False)).alias("trains"), F.coalesce("text", F.lit("")).alias("text"))
    counts = cut(_counted(docs.filter("trains")), "counts")
    n_texts = docs.filter("trains").count()
    n_words, n_types = counts.agg(F.sum("n"), F.count("*")).first()
    total, types = (n_words or 0) + n_texts, (n_types or 0) + (n_texts > 0)
    keys, n, head_forms = _most_frequent(counts, HEAD)
    unit_keys, _, _ = _most_frequent(counts, UNITS)
    encoded = cut(_encoded(docs, spark.sparkContext.broadcast((keys, n))).withColumn("row", F.monotonically_increasing_id()), "encoded")
    training = encoded.filter("trains")
    # Units of texts are words of the head and forms; those of the clustering are the most frequent words and forms.
    at, own = _lookup(unit_keys, keys)
    coarse = np.concatenate([[_END], np.where(own, at + 1, 1 + len(unit_keys) + head_forms), 1 + len(unit_keys) + np.arange(FORMS)]).astype(np.int32)
    of_unit, pairs = cluster(training.select("units"), coarse, 1 + len(unit_keys) + FORMS)
    classes = of_unit[coarse]
    placed = _placed(training, keys, np.concatenate([[True], own, np.zeros(FORMS, bool)]), classes, pairs, n_types or 0)
    placed = cut(placed, "placed")
    found = placed.filter("in_head").select("word", "class").toArrow()
    classes[1 + np.searchsorted(keys, found["word"].to_numpy().view(_U))] = found["class"].to_numpy()

    # The class of every word, then the model: transitions, and for each class the logarithms that turn a count into an emission.
    units_of = pa.table({"word": pa.array(unit_keys.view(np.int64)), "class": pa.array(of_unit[1 : 1 + len(unit_keys)].astype(np.int32))})
    own_class = placed.select("word", "class").union(spark.createDataFrame(units_of))
    of_form = spark.createDataFrame([(f, int(of_unit[1 + len(unit_keys) + f])) for f in range(FORMS)], "form int, form_class int")
    lexicon = counts.join(own_class, "word", "left").join(F.broadcast(of_form), "form").select("word", "n", F.coalesce("class", "form_class").alias("class"))
    lexicon = cut(lexicon, "lexicon")
    classed = cut(_classed(encoded, lexicon, classes), "classed")
    between = _class_pairs(classed.filter("trains"), CLASSES)
    tokens = between.sum(axis=0)
    once, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in lexicon.groupBy("class").agg(F.count_if(F.col("n") == 1).alias("once"), F.count("*").alias("kinds")).collect():
        once[r["class"]], kinds[r["class"]] = r["once"], r["kinds"]
    share = (tokens + added) / (tokens + added).sum()
    log_transition = np.log10((between + BACKOFF * share) / (between.sum(axis=1, keepdims=True) + BACKOFF))
    unknown = np.clip((once + added) / (tokens + 2 * added), 1e-9, 0.9)
    log_known = np.log10(1 - unknown) - np.log10(np.maximum(tokens + added * kinds, added))
    log_unknown = np.log10(unknown)
    log_known[_END] = log_unknown[_END] = 0.0  # the end is all of its class
    model = spark.sparkContext.broadcast((log_transition, log_known, log_unknown))
    log_end = float(np.log10(n_texts + added))
    log_all = float(np.log10(total + added * (types + 1)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, known, unknown = model.value
        flat = step.reshape(-1)
        for batch in batches:
            parts = []
            for own, late in zip(batch["classes"], batch["unknown"], strict=True):
                c = np.concatenate([[_END], np.frombuffer(own.as_buffer(), np.uint8), [_END]]).astype(np.int64)
                late = np.frombuffer(late.as_buffer(), np.uint8)
                parts.append(float(flat[c[:-1] * len(step) + c[1:]].sum() + known[c[1:]].sum() + (unknown - known - np.log10(added))[late].sum()))
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("doc_id", "trains", "n_tokens", "n_known", "log_n")] + [pa.array(parts, pa.float64())], names=["doc_id", "trains", "n_tokens", "n_known", "log_n", "part"])

    return classed.mapInArrow(scored, "doc_id long, trains boolean, n_tokens long, n_known long, log_n double, part double").select(
        "doc_id",
        "trains",
        "n_tokens",
        (F.col("n_known") + F.lit(int(n_texts > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log_n") + F.lit(log_end) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("log_n") + F.col("part")).alias("score"),
        F.pow(F.lit(10.0), -(F.col("log_n") + F.col("part")) / F.col("n_tokens")).alias("perplexity"),
    )
