"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, and streaming decoding.

Compiling. A sequence of tokens is the merges' result for its bytes if and only if every two neighbours are: merging the
bytes of the two gives the two again. So merges compile to a non-deterministic transducer whose states are (token before,
place in the tokens' trie), and which moves on to a new token where its neighbour agrees with it.

Determinising. A state of the deterministic transducer is the set of those that the bytes so far may be in, each with the
tokens that it has still to emit; tokens common to all are emitted at once, so that lookahead is bounded by the longest
token. States and transitions are made when they are first met and kept, up to a bound; beyond it all are forgotten.

Text is cut by PATTERN first, on arrays of characters' classes; a worker keeps the ids of pieces that it has met.

Decoding goes through an incremental UTF-8 state machine: ids may be cut anywhere, characters come out as soon as they are
complete, and bytes that are no UTF-8 become U+FFFD, as Python's incremental decoder has it.

Defined cases: a null or empty text has no ids; a null doc_id stays null; repeated rows are encoded each; texts of any
length are read whole, by parts that end before white space; special tokens' strings are ordinary text; an empty table gives
an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .packing import WordTokenizer
from .storage import small_batches

#: Transitions, and judged pairs of tokens, that a transducer keeps.
TRANSITIONS = 1 << 19
PAIRS = 1 << 19
#: Pieces of which a worker keeps the ids, about 40 bytes each.
CACHE_PIECES = 1 << 20
#: Ids that are decoded at once.
DECODED_IDS = 1 << 16

# Fixed values of the pattern: classes that it names, and endings that stand by themselves after an apostrophe.
LETTER, NUMBER, SPACE, OTHER = r"\p{L}", r"\p{N}", r"\s", 0
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class Transducer:
    """Ids of single pieces of text, byte by byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.trie: dict[int, int] = {}  # node * 256 + byte to node; 0 is the root
        self.ends, self.inner = [-1], bytearray(1)  # token that ends in a node, whether it goes on
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge of a token
        for token, rank in ranks.items():
            if len(token) > 1:
                halves = self.merged(token, 2)
                if len(halves) > 2:
                    continue  # merges never make it; it stands for a whole piece only
                self.halves[rank] = (halves[0], halves[1])
            node = 0
            for byte in token:
                child = self.trie.get(node << 8 | byte)
                if child is None:
                    child = self.trie[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(0)
                    self.inner[node] = 1
                node = child
            self.ends[node] = rank
        if any(max(x) > rank for rank, x in self.halves.items()):
            raise ValueError("ranks are not those of merges: a token comes before its halves")
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Keeps the state before the first byte only."""
        start = (-1, (((), 0),))
        self.states, self.numbers = [start], {start: 0}
        self.final: list[tuple[int, ...]] = [()]
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, text: bytes, parts_left: int = 1) -> list[int]:
        """The merges' result by definition: the pair of least rank first, of equal ones the leftmost; ends when so few parts are left."""
        parts = [text[k : k + 1] for k in range(len(text))]
        rank = self.ranks.get
        scores = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        while len(parts) > parts_left and (least := min(scores)) < 1 << 60:
            k = scores.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k < len(scores):
                scores[k] = rank(parts[k] + parts[k + 1], 1 << 60)
            if k:
                scores[k - 1] = rank(parts[k - 1] + parts[k], 1 << 60)
        return [self.ranks[p] for p in parts]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the token's right (1) or left (0) end while it is merged: parts, each with the rank of the merge that ends it."""
        found = self.edges[side].get(token)
        if found is None:
            found, until = [(self.token[token], 1 << 60)], token
            part = token
            while part in self.halves:
                part, until = self.halves[part][side], part
                found.append((self.token[part], until))
            found = self.edges[side][token] = found[::-1]
        return found

    def agree(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens as they are, side by side: no merge across comes before those within."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b, found = self.edge(left, 1), self.edge(right, 0), True
            i = j = 0
            while True:
                (x, x_until), (y, y_until) = a[i], b[j]
                across = self.ranks.get(x + y)
                # Of equal ranks the leftmost goes first: that within the left token, then that across.
                if across is not None and across < x_until and across <= y_until:
                    found = False
                    break
                if x_until == y_until == 1 << 60:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self.pairs[key] = found
        return found

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after a byte, and the tokens that it emits; a new transition, which is kept."""
        last, ways = self.states[state]
        after, done, child_of, ends, inner = [], None, self.trie.get, self.ends, self.inner
        for held, node in ways:
            child = child_of(node << 8 | byte)
            if child is None:
                continue
            token = ends[child]
            if token >= 0 and done is None:
                before = held[-1] if held else last
                if before < 0 or self.agree(before, token):
                    done = (*held, token)
            if inner[child]:
                after.append((held, child))
        if done is None:
            raise ValueError("ranks lack a token for a byte")
        after.append((done, 0))
        emitted, first = (), after[0][0]
        if first:  # the way that began first holds the fewest tokens; mostly none
            common = len(first)
            for held, _ in after:
                while common and held[:common] != first[:common]:
                    common -= 1
            if common:
                emitted = first[:common]
                after = [(held[common:], node) for held, node in after]
                last = emitted[-1]
            if all(held for held, _ in after):
                last = -1  # no way looks at it any more
        new = (last, tuple(after))
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
            self.final.append(after[-1][0])
        found = self.steps[state << 8 | byte] = (number, emitted)
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece of text that the pattern cuts no further."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.steps) > TRANSITIONS:
            self.forget()
        out: list[int] = []
        state, known = 0, self.steps
        for byte in piece:
            found = known.get(state << 8 | byte)
            if found is None:
                if len(known) > 2 * TRANSITIONS:  # within one very long piece: go on from the same ways
                    now = self.states[state]
                    self.forget()
                    known = self.steps
                    state = self.numbers.setdefault(now, len(self.states))
                    if state == len(self.states):
                        self.states.append(now)
                        self.final.append(now[1][-1][0])
                found = self.step(state, byte)
            state, emitted = found
            if emitted:
                out += emitted
        out += self.final[state]
        return out


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: 1 letter, 2 number, 3 white space, 0 other."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for number, kind in enumerate((LETTER, NUMBER, SPACE), 1):
        for found in regex.finditer(f"{kind}+", every):
            out[found.start() : found.end()] = number
    return out


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and code points of the characters of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if len(at) == len(data):
        return at, data.astype(np.int32)
    code = data[at].astype(np.int32)
    padded = np.append(data, np.zeros(3, np.uint8))
    for least, bits, n in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        own = np.flatnonzero((code >= least) & (code < (0xE0, 0xF0, 0x100)[n - 1]) & (data[at] >= least))
        value = code[own] & bits
        for k in range(1, n + 1):
            value = value << 6 | (padded[at[own] + k] & 0x3F)
        code[own] = value + 0x1000000  # set apart from lead bytes until all are done
    return at, np.where(code >= 0x1000000, code - 0x1000000, code)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in data at which the pattern's pieces of texts begin; text i is data[offsets[i]:offsets[i + 1]].

    Pieces are runs of letters, of numbers or of other characters, each with a space before it if there is one; white space
    else, but for its last character before a run, which stands by itself or is that run's space; and an apostrophe
    with an ending, where no space stands before it.
    """
    at, code = _characters(data)
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[code]
    opens = np.zeros(n + 1, bool)  # the first characters of texts
    opens[np.searchsorted(at, offsets)] = True
    opens[n] = True
    turns = opens[:n].copy()
    turns[1:] |= kind[1:] != kind[:-1]
    starts = turns.copy()
    ends_run = np.append(turns[1:], True)
    before_run = (kind == 3) & ends_run & ~opens[1:]  # the last white space before a run
    starts |= before_run
    joined = np.flatnonzero(before_run & (code == 0x20)) + 1
    starts[joined] = False
    marks = np.flatnonzero((code == 0x27) & starts & ends_run & ~opens[1:])
    marks = marks[kind[marks + 1] == 1]
    letters = np.append(code, np.zeros(3, np.int32))
    after = np.append(opens, np.ones(3, bool))
    left = np.ones(len(marks), bool)
    for ending in ENDINGS:
        fits = left.copy()
        for k, letter in enumerate(ending, 1):
            fits &= (letters[marks + k] == ord(letter)) & ~after[marks + k]
        left &= ~fits
        own = marks[fits]
        starts[own + 1] = False
        rest = own + 1 + len(ending)
        starts[rest[rest < n]] = True
    # What follows an ending begins a piece, but for a run whose space came before it: none does.
    return at[starts]


class Encoder(WordTokenizer):
    """Ids of whole texts: pieces by the pattern, each distinct one through the transducer once, while it is remembered."""

    most = CACHE_PIECES

    def __init__(self, path: str):
        self.transducer = Transducer(read_ranks(path))
        self.clear()

    def encode(self, given: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.transducer.encode(piece) for piece in given]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts

    def is_special(self, raw: bytes) -> bool:
        return False

    def spelled(self, piece: bytes) -> bytes:
        return piece

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = piece_starts(data, offsets)
        lengths = np.diff(np.append(starts, len(data)))
        return starts, lengths, words.hashes(data.astype(np.uint16) + np.uint16(1), lengths)

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for row, stop, data, offsets in words.pieces(column):
            if stop > row + 1 or len(data) <= words.CHUNK_BYTES:
                yield from self.ids_of(data, offsets)
            else:
                bounds = np.array(_parts(data))
                parts = (self.ids_of(data[a:b], np.array([0, b - a])) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
                yield np.concatenate([ids for part in parts for ids in part])


def _parts(data: np.ndarray) -> list[int]:
    """Bounds of parts of a long text, each of about CHUNK_BYTES, that begin with a space after an ASCII letter or digit:
    a piece begins there, whatever stands around."""
    solid = words.table([range(0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x100)])
    bounds, at = [0], words.CHUNK_BYTES
    while at < len(data):
        ahead = data[at - 1 : at + words.CHUNK_BYTES]
        found = np.flatnonzero((ahead[1:] == 0x20) & (solid[ahead[:-1]] != 0))
        if len(found):
            bounds.append(at + int(found[0]))
            at = bounds[-1]
        at += words.CHUNK_BYTES
    return [*bounds, len(data)]


def _utf8_machine() -> np.ndarray:
    """The next state for each state and byte: 0 between characters, 1 to 7 within one, 8 not UTF-8.

    States 1, 2 and 3 wait for as many bytes of 80-BF; 4 to 7 come after E0, ED, F0 and F4, which narrow the next byte."""
    out = np.full((9, 256), 8, np.uint8)
    for state, first, last, to in (
        (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE1, 0xEF, 2), (0, 0xE0, 0xE0, 4), (0, 0xED, 0xED, 5), (0, 0xF1, 0xF3, 3), (0, 0xF0, 0xF0, 6), (0, 0xF4, 0xF4, 7),
        (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
    ):
        out[state, first : last + 1] = to
    return out


_UTF8 = _utf8_machine().tolist()


class Utf8Stream:
    """Characters of bytes that come in parts. Only the machine's way through a part's last bytes decides what has to wait."""

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        self.waiting = b""
        for back in range(1, min(4, len(data) + 1)):
            if data[-back] >= 0xC0:  # a lead byte: does its character end here?
                state = 0
                for byte in data[-back:]:
                    state = _UTF8[state][byte]
                if 0 < state < 8:
                    self.waiting = data[-back:]
                    data = data[:-back]
                break
            if data[-back] < 0x80:
                break
        return data.decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.waiting = self.waiting, b""
        return data.decode("utf-8", "replace")


class Decoder:
    """Texts of ids, in parts."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def stream(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        """The text of ids that come in parts; a part need not end with a character. An unknown id is an error."""
        characters = Utf8Stream()
        for part in ids:
            for at in range(0, len(part), DECODED_IDS):
                yield characters.feed(b"".join(map(self.tokens.__getitem__, part[at : at + DECODED_IDS].tolist())))
        yield characters.finish()


_coders: dict[str, tuple[Encoder, Decoder]] = {}


def _coder(path: str) -> tuple[Encoder, Decoder]:
    if path not in _coders:
        encoder = Encoder(path)
        _coders[path] = (encoder, Decoder(encoder.transducer.ranks))
    return _coders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every document. path: a file of ranks that is on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.astype(np.int32) for x in _coder(path)[0].texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(words.frugal(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of doc_id and ids; null ids have no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = (np.array(x or [], np.int64) for x in batch["ids"].to_pylist())
            texts = ["".join(_coder(path)[1].stream([x])) for x in ids]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    small_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(words.frugal(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, encoded and decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder, decoder = _coder(path)
            counts, own, back = [], [], []
            for ids in encoder.texts(batch["text"]):
                counts.append(len(ids))
                own.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                digest = hashlib.sha256()
                for text in decoder.stream([ids]):
                    digest.update(text.encode())
                back.append(digest.hexdigest())
            columns = [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(words.frugal(run), schema)
