"""Toxicity by a weighted lexicon that Aho-Corasick finds in folded text.

Folding lower-cases, maps look-alike letters and digits that stand for letters to plain letters, drops invisible
characters, and makes punctuation a space. Lexicon entries are whole words or beginnings of words with log-odds weights,
learnt from labelled documents: those that occur in toxic texts far more often than by chance, where copies of one text
count once. Exception phrases are pairs of neighbouring words in which an entry's
word isn't toxic; a match inside one doesn't count. The score of a text is a logistic curve over the summed weights and
the sum per word.

Defined cases: a null or empty text has no match; without toxic examples the lexicon is empty, and every text gets the
score of the curve's intercept; without any labelled text that is 0.01, as nothing speaks against a text; other columns
are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, near_dedup, words
from .storage import small_batches

#: Labelled documents that the lexicon is learnt from, at most.
SAMPLE_ROWS = 12_000
#: Lengths of beginnings of words that may be entries.
STEMS = (4, 5, 6, 7, 8, 9, 10)
#: An entry occurs in so many toxic texts at least, and its share among toxic texts is so many times that among others.
LEAST_TEXTS = 4
LEAST_RATIO = 8.0
#: And it occurs in more toxic texts than by chance, by so many standard deviations.
LEAST_DEVIATIONS = 6.0

# Characters that look like Latin letters, and digits and signs that stand for them.
LOOKALIKES = "аaвbеeёeкkмmнhоoрpсcтtуyхxіiїiјjѕsԁdɡgһhӏlαaβbεeιiκkνvοoρpτtυuχxıiøo0o1i3e4a5s7t8b@a$s"
INVISIBLE = "­​‌‍⁠﻿"


def _fold_table() -> dict[int, int | str | None]:
    out: dict[int, int | str | None] = {c: c for c in range(0x250)}  # a character that is missing costs more
    for c in range(0x80):
        if not chr(c).isalnum():
            out[c] = " "
    for c in "«»¿¡…–—‘’“”·×÷ ":
        out[ord(c)] = " "
    for c in range(26):
        out[0xFF41 + c] = chr(97 + c)
    for c in INVISIBLE:
        out[ord(c)] = None
    for a, b in zip(LOOKALIKES[::2], LOOKALIKES[1::2], strict=True):
        out[ord(a)] = b
    return out


_table = _fold_table()


def fold(text: str | None) -> str:
    """Folded text with a space before and after it."""
    return f" {text.lower().translate(_table)} " if text else "  "


def entries_of(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:k]}" for k in STEMS if len(word) >= k)]


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str]
    curve: np.ndarray

    def automaton(self) -> ahocorasick.Automaton | None:
        out = ahocorasick.Automaton()
        for x in self.exceptions:
            out.add_word(f" {x} ", (len(x) + 2, None))
        for x, w in self.weights.items():
            out.add_word(x, (len(x), w))
        if not len(out):
            return None
        out.make_automaton()
        return out

    def scorer(self):
        automaton, curve = self.automaton(), self.curve

        def score(texts: pa.Array) -> np.ndarray:
            rows = [measure(fold(t.as_py()), automaton) for t in texts]
            return labelled.logistic(features(rows), curve)

        return score


def measure(folded: str, automaton: ahocorasick.Automaton | None) -> tuple[float, int]:
    """Summed weights of the matches outside exceptions, and the number of words."""
    hits, free = [], []
    for end, (length, weight) in automaton.iter(folded) if automaton is not None else ():
        (free if weight is None else hits).append((end - length + 1, end, weight or 0.0))
    # A word counts once, by its heaviest entry. Both in order of their starts: a match lies inside an exception if one of
    # those that begin no later ends no earlier.
    best: dict[int, float] = {}
    free.sort()
    k, reach = 0, -1
    for a, b, w in sorted(hits):
        while k < len(free) and free[k][0] <= a:
            reach = max(reach, free[k][1])
            k += 1
        if b > reach:
            best[a] = max(best.get(a, 0.0), w)
    return sum(best.values()), len(folded.split())


def features(rows: list[tuple[float, int]]) -> np.ndarray:
    """The logarithms of the summed weights and of the sum per hundred words."""
    x = np.array(rows, float).reshape(-1, 2)
    return np.log1p(np.column_stack([x[:, 0], 100 * x[:, 0] / np.maximum(x[:, 1], 1)]))


def _count(sampled: DataFrame, of) -> DataFrame:
    """key, toxic and clean: in how many toxic and other texts each key of of(folded text) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter] = [Counter(), Counter()]

        def flush() -> pa.RecordBatch:
            keys = sorted({*found[0], *found[1]})
            out = pa.RecordBatch.from_pydict({"key": keys, "toxic": [found[1][k] for k in keys], "clean": [found[0][k] for k in keys]}, pa.schema([("key", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))
            found[0].clear(), found[1].clear()
            return out

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"].to_pylist(), strict=True):
                found[label > 0].update(of(fold(text.as_py())))
                if len(found[0]) + len(found[1]) > 300_000:
                    yield flush()
        yield flush()

    return sampled.select("text", "label").mapInArrow(run, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learns the lexicon, exceptions and curve from at most `rows` labelled documents."""
    small_batches(docs.sparkSession)
    sampled = labelled.sample(docs, labels, label, rows).cache()
    sizes = {r["label"] > 0: r["count"] for r in sampled.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    counted = _count(sampled, lambda folded: {e for w in set(folded.split()) for e in entries_of(w)})
    expected = (F.col("toxic") + F.col("clean")) * (n_toxic / max(1, n_toxic + n_clean))
    surely = F.col("toxic") >= expected + LEAST_DEVIATIONS * F.sqrt(expected)
    pool = counted.filter((F.col("toxic") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO) & surely)
    pool = pool.select("key", "clean").collect()  # of a bounded sample
    weights = choose(sampled.filter("label > 0"), {r["key"]: r["clean"] for r in pool}, n_clean)
    exceptions: list[str] = []
    if weights:
        plain = Lexicon(weights, [], np.zeros(3))

        def phrases(folded: str) -> set[str]:
            words, starts = folded.split(), tuple(weights)
            marked = [any(f" {w} ".startswith(s) for s in starts) for w in words] if any(s in folded for s in starts) else []
            return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], marked, marked[1:], strict=False) if x or y}

        rare = _count(sampled, phrases).filter((F.col("clean") >= LEAST_TEXTS) & (F.col("toxic") * n_clean * 2 <= F.col("clean") * n_toxic))
        exceptions = sorted(r["key"] for r in rare.select("key").collect())
    plain = Lexicon(weights, exceptions, np.zeros(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = plain.automaton()
        for batch in batches:
            x = [measure(fold(t.as_py()), automaton) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array([float(a) for a, _ in x], pa.float64()), pa.array([n for _, n in x], pa.int64()), batch["label"]], names=["weight", "words", "label"])

    got = sampled.select("text", "label").mapInArrow(run, "weight double, words long, label int").collect()
    sampled.unpersist()
    if not got:
        return Lexicon({}, [], np.array([0.0, 0.0, -4.6]))
    y = np.array([float(r["label"] > 0) for r in got])
    return Lexicon(weights, exceptions, labelled.fit_logistic(features([(r["weight"], r["words"]) for r in got]), y))


def families(registers: np.ndarray) -> np.ndarray:
    """A number for each sketch, the same for those that agree in half of their registers with the first of their family."""
    family = np.full(len(registers), -1)
    for i in range(len(registers)):
        if family[i] < 0:
            family[(family < 0) & ((registers == registers[i]).mean(axis=1) >= 0.5)] = i
    return family


def choose(toxic: DataFrame, pool: dict[str, int], n_clean: int) -> dict[str, float]:
    """Weights of the entries of the pool (with their clean texts) that occur in enough families of toxic texts.

    Copies of one text are a family, whose words aren't toxic for being copied. Only sketches of the sample's toxic texts and
    which entries they hold reach the driver.
    """
    keys = list(pool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(keys)}
        for batch in batches:
            found, kept = [], []
            for text, own in zip(batch["text"], near_dedup.shingle_sets(batch["text"], 2), strict=True):
                found.append(sorted({place[e] for w in set(fold(text.as_py()).split()) for e in entries_of(w) if e in place}))
                kept.append(near_dedup.registers(own).tobytes() if len(own) else bytes(2 * near_dedup.REGISTERS))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(kept, pa.binary())], names=["found", "registers"])

    rows = toxic.select("text").mapInArrow(run, "found array<int>, registers binary").collect() if keys else []
    if not rows:
        return {}
    family = families(np.stack([np.frombuffer(r["registers"], np.uint16) for r in rows]))
    where: dict[int, set[int]] = defaultdict(set)
    for number, r in zip(family.tolist(), rows, strict=True):
        for k in r["found"]:
            where[k].add(number)
    n_families = len(np.unique(family))
    out: dict[str, float] = {}
    for k in sorted(where, key=lambda k: (len(keys[k]), keys[k])):
        toxic_rate, clean_rate = (len(where[k]) + 0.5) / (n_families + 1), (pool[keys[k]] + 0.5) / (n_clean + 1)
        weight = float(np.log(toxic_rate / clean_rate))
        enough = len(where[k]) >= LEAST_TEXTS and toxic_rate >= LEAST_RATIO * clean_rate
        if enough and not any(keys[k].startswith(x) and w >= weight for x, w in ((keys[k][:n], out.get(keys[k][:n], 0.0)) for n in range(2, len(keys[k])))):
            out[keys[k]] = weight
    return out


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1, higher: more toxic) of every row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = lexicon.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score(batch["text"]), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(words.frugal(run), "doc_id long, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = lexicon.scorer()
        for batch in batches:
            yield batch.filter(pa.array(score(batch["text"]) < threshold))

    return docs.mapInArrow(words.frugal(run), docs.schema)
