"""Conversation structure repair by signature deduplication.

A message's role initial and fault are one character; a conversation's characters, in order, are its signature. Each distinct
signature is solved once, by memoised recursion over its halves: for every state of the role grammar before it and after it,
the cheapest edits. Audits are joined back and replayed over the messages.

The grammar is `(s?(ua)+)?` over role initials. Edits: Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty
user or assistant message) 3; a truncated message that isn't deleted adds 3, a blank or duplicate one must be deleted. Of
cheapest edits, those whose initials (K, R, D, I) are ASCII-least win. Inserts stand before the message that follows them.

A conversation of more than BLOCK messages is cut into blocks of BLOCK. Each block's signature is solved by itself; costs and
ranks of its solutions are combined FAN at a time until one is left, and the choice goes down the same way. So no task holds
more than a block's messages or FAN solutions, however long a conversation is. Only digests(), which hashes a whole
conversation, sends one conversation's messages through one task, as a stream in bounded memory: a hash is made in order.

Defined cases: a null role or text is one space; a null conversation id is a conversation; messages go by turn (nulls first),
then role, then text; rows that repeat count each, all but the first as duplicates; a role whose initial isn't s, u or a (an
empty one too) can't be kept; texts are whole, however long; a conversation of messages to be deleted, or of none, is
empty after repair; an empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sharding, words
from .storage import cut, small_batches

#: Messages of a block, and solutions that are combined at once.
BLOCK = 1_024
FAN = 1_024
#: Characters of solutions that a Python worker remembers.
MEMORY = 1 << 24

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the grammar: nothing yet, after s, after u, after a; an end is possible in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow each state: letter of a kept role, the state that it leads to.
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: Edits at the end that lead from a state to an end, in the letters of details, and their cost.
TAILS = {START: ("", 0), SYSTEM: ("ua", 2 * INSERT), USER: ("a", INSERT), ASSISTANT: ("", 0)}
#: Letters of details: K and D as they are, U and A rerole, u and a insert. As audits' initials:
AUDIT = str.maketrans("UAua", "RRII")
WHITE = " \t\n\v\f\r"
LEGAL = ("su", "ua", "au")

Solution = dict[tuple[int, int], tuple[int, str]]


def _better(a: tuple[int, str] | None, b: tuple[int, str]) -> tuple[int, str]:
    return b if a is None or (b[0], b[1].translate(AUDIT)) < (a[0], a[1].translate(AUDIT)) else a


def _one(code: str) -> Solution:
    """The cheapest edits of one message, inserts before it included, for each pair of states."""
    out: Solution = {}
    for entry in range(4):
        # A state is reached by inserts from another one in one way only; longer ways come back to where they were.
        reached, now = {entry: ""}, entry
        while (follow := STEPS[now].keys() & {"u", "a"}) and STEPS[now][letter := min(follow)] not in reached:
            reached[STEPS[now][letter]] = reached[now] + letter
            now = STEPS[now][letter]
        for state, inserts in reached.items():
            paid = INSERT * len(inserts)
            ways = [(state, DELETE, "D")]
            if code != "x":
                more = TRUNCATED if code.isupper() else 0
                kept = STEPS[state].get(code.lower())
                ways += [(kept, KEEP + more, "K")] if kept is not None else []
                ways += [(to, REROLE + more, letter.upper()) for letter, to in STEPS[state].items() if letter != "s"]
            for to, cost, letter in ways:
                out[entry, to] = _better(out.get((entry, to)), (paid + cost, inserts + letter))
    return out


class Solver:
    """Solutions of signatures, remembered by (part of a) signature."""

    def __init__(self) -> None:
        self.known: dict[str, Solution] = {}
        self.held = 0

    def solve(self, signature: str) -> Solution:
        """For each pair of states before and after the signature, if there is a way, its cheapest cost and details."""
        found = self.known.get(signature)
        if found is None:
            if len(signature) == 1:
                found = _one(signature)
            else:
                half = len(signature) // 2
                left, right, found = self.solve(signature[:half]), self.solve(signature[half:]), {}
                for (a, b), (cost, detail) in left.items():
                    for to in range(4):
                        if (b, to) in right:
                            more, rest = right[b, to]
                            found[a, to] = _better(found.get((a, to)), (cost + more, detail + rest))
            if self.held > MEMORY:
                self.known, self.held = {}, 0
            self.known[signature] = found
            self.held += sum(100 + len(d) for _, d in found.values())
        return found


def ranked(solution: Solution) -> list[dict]:
    """The solution as rows, with each one's rank by audit among those of the same state before.

    No audit of a block is the beginning of another one: all end with the edit of the same last message."""
    out = []
    for entry in range(4):
        own = sorted((detail.translate(AUDIT), to, cost, detail) for (a, to), (cost, detail) in solution.items() if a == entry)
        out += [{"entry": entry, "exit": to, "cost": cost, "rank": k, "detail": detail} for k, (_, to, cost, detail) in enumerate(own)]
    return out


_PATHS = "array<struct<entry: int, exit: int, cost: bigint, rank: int, detail: string>>"
_SHORT = "array<struct<entry: int, exit: int, cost: bigint, rank: int>>"


def _chains(children: list[list[dict]]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each pair of states before the first and after the last child, the cost and the states in between, the last one included."""
    tables = [{(p["entry"], p["exit"]): (p["cost"], p["rank"]) for p in c} for c in children]
    out = {}
    for final in range(4):
        best: list[dict[int, tuple[int, int]]] = [{} for _ in tables]  # by child: entry to (cost from here on, exit)
        ahead = {final: 0}
        for k in reversed(range(len(tables))):
            options: dict[int, list[tuple[int, int, int]]] = {}
            for (a, b), (cost, rank) in tables[k].items():
                if b in ahead:
                    options.setdefault(a, []).append((cost + ahead[b], rank, b))
            best[k] = {a: (min(x)[0], min(x)[2]) for a, x in options.items()}
            ahead = {a: c for a, (c, _) in best[k].items()}
        for entry, cost in ahead.items():
            states, at = [], entry
            for k in range(len(tables)):
                at = best[k][at][1]
                states.append(at)
            out[entry, final] = (cost, states)
    return out


def _combined(children: list[list[dict]]) -> list[dict]:
    tables = [{(p["entry"], p["exit"]): p["rank"] for p in c} for c in children]
    chains, out = _chains(children), []
    for entry in range(4):
        own = []
        for (a, final), (cost, states) in chains.items():
            if a == entry:
                steps = zip(tables, [entry, *states], states, strict=False)
                own.append(([t[x, y] for t, x, y in steps], final, cost))
        out += [{"entry": entry, "exit": final, "cost": cost, "rank": k} for k, (_, final, cost) in enumerate(sorted(own))]
    return out


def _marked(rows: DataFrame) -> DataFrame:
    """rows with fault ('' if none), initial and code, from duplicate and the text."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(bare == "", "blank").when(F.col("duplicate"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("fault", fault).withColumn("initial", F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return rows.select("conv", "conv_id", "place", "turn", "role", "text", "fault", "initial", code.alias("code"))


def mark(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv (the id as text, a space for null), conv_id, place (from 0), turn, role, text, fault, initial and code of every message."""
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    long = cut(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("conv"), "long")
    any_long = not long.isEmpty()
    short = (rows.join(long, "conv", "left_anti") if any_long else rows).repartition("conv")
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    short = short.withColumn("place", F.row_number().over(order).cast("long") - 1)
    placed = _marked(short.withColumn("duplicate", F.row_number().over(W.partitionBy("conv", "role", "text").orderBy("place")) > 1))
    if any_long:
        records = rows.join(long, "conv", "left_semi").select(F.col("conv").alias("shard"), F.col("turn").isNotNull().alias("late"), "turn", "role", "text", "conv_id")
        numbered = cut(sharding.number_slots(records, ["late", "turn", "role", "text"]).withColumn("digest", F.sha2("text", 256)), "numbered")
        first = numbered.groupBy("shard", "role", "digest").agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        numbered = numbered.join(first, ["shard", "role", "digest"], "left").withColumn("duplicate", F.coalesce(F.col("slot") > F.col("first"), F.lit(False)))
        placed = placed.union(_marked(numbered.withColumnsRenamed({"shard": "conv", "slot": "place"})))
    return cut(placed, "placed")


def blocks_of(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, block, signature and initials of each block of marked messages."""
    one = F.array_sort(F.collect_list(F.struct("place", "code", "initial")))
    joined = placed.groupBy("conv", F.floor(F.col("place") / block).alias("block")).agg(one.alias("all"))
    line = lambda c: F.array_join(F.transform("all", lambda x: x[c]), "")
    return joined.select("conv", "block", line("code").alias("signature"), line("initial").alias("initials"))


def solve(signatures: DataFrame) -> DataFrame:
    """signature and paths (entry, exit, cost, rank, detail) of each row of signatures, which should be distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                paths = [ranked(solver.solve(s)) for s in own["signature"].to_pylist()]
                kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("detail", pa.string())]))
                yield pa.RecordBatch.from_arrays([own["signature"], pa.array(paths, kind)], names=["signature", "paths"])

    return signatures.select("signature").mapInArrow(words.frugal(run), f"signature string, paths {_PATHS}")


def _up(nodes: DataFrame, fan: int) -> DataFrame:
    """conv, node and paths of the parents of nodes (conv, node, paths)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        children = group.sort_by("node")["paths"].to_pylist()
        kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int64()), pa.array([_combined(children)], kind)], names=["conv", "node", "paths"])

    parents = nodes.withColumn("parent", F.floor(F.col("node") / fan))
    return parents.groupBy("conv", "parent").applyInArrow(run, f"conv string, node long, paths {_SHORT}")


def _down(nodes: DataFrame, chosen: DataFrame, fan: int) -> DataFrame:
    """conv, node, entry and exit of nodes whose parents' are chosen."""

    def run(key: tuple, group: pa.Table, parent: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        entry, final = parent["entry"][0].as_py(), parent["exit"][0].as_py()
        states = _chains(group["paths"].to_pylist())[entry, final][1]
        return pa.table([group["conv"], group["node"], pa.array([entry, *states[:-1]], pa.int32()), pa.array(states, pa.int32())], names=["conv", "node", "entry", "exit"])

    children = nodes.withColumn("parent", F.floor(F.col("node") / fan)).groupBy("conv", "parent")
    parents = chosen.withColumnRenamed("node", "parent").groupBy("conv", "parent")
    return children.cogroup(parents).applyInArrow(run, "conv string, node long, entry int, exit int")


def _ends(paths: DataFrame) -> DataFrame:
    """paths (of whole conversations) with best: the path from the start that is cheapest with its tail."""
    tails = F.create_map(*(F.lit(x) for state, (_, cost) in TAILS.items() for x in (state, cost)))
    from_start = F.filter("paths", lambda p: p["entry"] == START)
    total = F.transform(from_start, lambda p: F.struct((p["cost"] + F.element_at(tails, p["exit"])).cast("long").alias("cost"), p["rank"].alias("rank"), p["exit"].alias("exit")))
    return paths.withColumn("best", F.array_min(total))


def _details(column: str, exit_: Column) -> Column:
    tails = F.create_map(*(F.lit(x) for state, (letters, _) in TAILS.items() for x in (state, letters)))
    return F.concat(F.col(column), F.element_at(tails, exit_))


def repair(placed: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Edits of marked messages: (conv, block, detail, initials) of each block, and (conv, cost) of each conversation.

    A detail has a letter for each edit in order: K keeps, D deletes, U and A rerole to user and assistant, u and a insert.
    """
    blocks = cut(blocks_of(placed, block), "blocks")
    solved = solve(blocks.select("signature").distinct())
    blocks = cut(blocks.join(solved, "signature").drop("signature"), "solved")
    sizes = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("blocks"))
    most = sizes.agg(F.max("blocks")).first()[0] or 0
    whole = blocks
    if most > 1:
        many = sizes.filter("blocks > 1").select("conv")
        whole = blocks.join(many, "conv", "left_anti")
        short = F.transform("paths", lambda p: F.struct(p["entry"].alias("entry"), p["exit"].alias("exit"), p["cost"].alias("cost"), p["rank"].alias("rank")))
        levels = [blocks.join(many, "conv", "left_semi").select("conv", F.col("block").alias("node"), short.alias("paths"))]
        while most > 1:
            levels.append(cut(_up(levels[-1], fan), "combined"))
            most = -(-most // fan)
        top = _ends(levels[-1]).select("conv", "node", F.lit(START).alias("entry"), F.col("best.exit").alias("exit"), F.col("best.cost").alias("cost"))
        chosen = top
        for level in reversed(levels[:-1]):
            chosen = cut(_down(level, chosen.select("conv", "node", "entry", "exit"), fan), "chosen")
        chosen = chosen.join(sizes.select("conv", F.col("blocks") - 1), "conv").toDF("conv", "block", "entry", "exit", "last")
        both = blocks.join(chosen, ["conv", "block"])
        own = F.filter("paths", lambda p: (p["entry"] == F.col("entry")) & (p["exit"] == F.col("exit")))[0]
        detail = F.when(F.col("block") == F.col("last"), _details("letters", F.col("exit"))).otherwise(F.col("letters"))
        parts = both.withColumn("letters", own["detail"]).select("conv", "block", detail.alias("detail"), "initials")
        costs = top.select("conv", "cost")
    whole = _ends(whole)
    own = F.filter("paths", lambda p: (p["entry"] == START) & (p["exit"] == F.col("best.exit")))[0]
    edits = whole.withColumn("letters", own["detail"]).select("conv", "block", _details("letters", F.col("best.exit")).alias("detail"), "initials")
    cost = whole.select("conv", F.col("best.cost").alias("cost"))
    if len(sizes.filter("blocks > 1").head(1)):
        edits, cost = edits.union(parts), cost.union(costs)
    return cut(edits, "edits"), cut(cost, "costs")


def _stream(placed: DataFrame, edits: DataFrame, by: list[str], block: int) -> DataFrame:
    """Each block's edits, then its messages, in order, blocks with the same `by` in the same partition."""
    number = F.floor(F.col("place") / block).alias("block")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = placed.select("conv", number, "place", "conv_id", "turn", "role", "text", none("detail", "string"))
    heads = edits.select("conv", "block", F.lit(-1).cast("long").alias("place"), none("conv_id", "long"), none("turn", "long"), none("role", "string"), none("text", "string"), "detail")
    return rows.union(heads).repartition(*by).sortWithinPartitions("conv", "block", "place")


_NAMES = {"u": "user", "a": "assistant"}


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """For each batch of a stream: (conv, block, conv_id, turn, edit, role, text) of every message that it has after repair."""
    letters, at = "", 0
    for batch in batches:
        out = []
        columns = (batch[c].to_pylist() for c in ("conv", "block", "place", "conv_id", "turn", "role", "text", "detail"))
        for conv, block, place, conv_id, turn, role, text, detail in zip(*columns, strict=True):
            if place < 0:
                letters, at = detail, 0
                continue
            while letters[at] in "ua":
                out.append((conv, block, conv_id, None, "I", _NAMES[letters[at]], ""))
                at += 1
            edit = letters[at]
            at += 1
            if edit == "K":
                out.append((conv, block, conv_id, turn, "K", role, text))
            elif edit != "D":
                out.append((conv, block, conv_id, turn, "R", _NAMES[edit.lower()], text))
            if not letters[at:].strip("ua"):  # after the last message, the rest
                out += [(conv, block, conv_id, None, "I", _NAMES[c], "") for c in letters[at:]]
                at = len(letters)
        yield out


def repaired(placed: DataFrame, edits: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block, position (from 0, in the block), turn (null if inserted), edit (K, R or I), role and text of all
    messages after repair; by block and position they are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position = None, 0
        for found in _replayed(batches):
            rows = []
            for conv, own, conv_id, turn, edit, role, text in found:
                position = position + 1 if now == (conv, own) else 0
                now = (conv, own)
                rows.append((conv_id, own, position, turn, edit, role, text))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "block", "position", "turn", "edit", "role", "text"])

    small_batches(placed.sparkSession)
    stream = _stream(placed, edits, ["conv", "block"], block)
    return stream.mapInArrow(words.frugal(run), "conv_id long, block long, position long, turn long, edit string, role string, text string")


def digests(placed: DataFrame, edits: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv and repaired_sha256, of `role:text` of the messages after repair, joined by newlines, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for found in _replayed(batches):
            convs, hashes = [], []
            for conv, _, _, _, _, role, text in found:
                if conv != now:
                    if now is not None:
                        convs.append(now)
                        hashes.append(digest.hexdigest())
                    now, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(hashes, pa.string())], names=["conv", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])

    small_batches(placed.sparkSession)
    return _stream(placed, edits, ["conv"], block).mapInArrow(words.frugal(run), "conv string, repaired_sha256 string")


def _illegal(edits: DataFrame) -> DataFrame:
    """conv and illegal: pairs of adjacent messages whose initials may not follow one another."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("initials")), lambda k: F.col("initials").substr(k, F.lit(2)))
    within = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin(*LEGAL)))
    inside = edits.select("conv", within.cast("long").alias("n"))
    before = edits.select("conv", (F.col("block") + 1).alias("block"), F.right("initials", F.lit(1)).alias("left"))
    edge = edits.filter("block > 0").join(before, ["conv", "block"])
    crossing = edge.select("conv", (~F.concat("left", F.substring("initials", 1, 1)).isin(*LEGAL)).cast("long").alias("n"))
    return inside.union(crossing).groupBy("conv").agg(F.sum("n").alias("illegal"))


def report(placed: DataFrame, edits: DataFrame, costs: DataFrame, conv_ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each distinct conv_id of conv_ids: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    A gap is a turn between the first and the last that no message has; counts beyond a long are the largest long."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    faults = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    spans = placed.groupBy("conv").agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.count_distinct("turn").alias("turns"))
    gaps = F.least(wide("most") - wide("least") + 1 - wide("turns"), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")
    out = placed.groupBy("conv").agg(*faults).join(spans.select("conv", F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps")), "conv")
    audit = F.translate("detail", "UAua", "RRII")
    audits = edits.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", audit.alias("audit")))), lambda x: x["audit"]), "").alias("audit"))
    for more in (_illegal(edits), costs, audits):
        out = out.join(more, "conv")
    out = out.join(digests(placed, edits, block), "conv", "left")
    every = conv_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    counts = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(out, "conv", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def damage(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text; nulls of the latter two as one space) damaged by a checksum of conv_id and turn."""
    label = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(label.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = messages.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _oracle() -> str:
    paid = lambda x, cost, letter: f"(lpad(CAST(CAST(left({x}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{letter}')"
    i2 = f"least(b2, {paid('b0', 3, 'I')}, {paid('b1', 3, 'I')}, {paid('b3', 3, 'I')})"
    more = "(CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END)"
    kept = lambda x, initial: f"CASE WHEN fault IN ('', 'truncated') AND initial = '{initial}' THEN {paid(x, more, 'K')} END"
    moved = lambda x: f"CASE WHEN fault IN ('', 'truncated') THEN {paid(x, f'3 + {more}', 'R')} END"
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS label
  FROM conversations),
bits AS (SELECT CAST(i AS UBIGINT) AS i FROM range(8) t(i)),
crc_table AS (
  SELECT CAST(n AS UBIGINT) AS n, list_reduce(list_concat([CAST(n AS UBIGINT)], [CAST(k AS UBIGINT) FOR k IN range(8)]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS c
  FROM range(256) t(n)),
crc_list AS (SELECT list(c ORDER BY n) AS l FROM crc_table),
labels_crc AS (
  SELECT label, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], [CAST(ascii(x) AS UBIGINT) FOR x IN string_split(label, '')]),
    lambda c, b: xor(l[CAST(xor(c & 255, b) AS BIGINT) + 1], c >> 8)), CAST(4294967295 AS UBIGINT)) AS crc
  FROM (SELECT DISTINCT label FROM named), crc_list),
hurt AS (
  SELECT conv_id, conv, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN crc % 20 = 1 THEN '' WHEN crc % 20 = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM named JOIN labels_crc USING (label), range(2) t(copy)
  WHERE crc % 20 <> 0 AND (copy = 0 OR crc % 20 = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS seen, left(role, 1) AS initial,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM numbered),
marked AS (
  SELECT conv, turn, role, text, i, initial, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS earlier,
    CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv),
walk AS (
  SELECT conv, CAST(0 AS BIGINT) AS i, '000000000' AS b0, CAST(NULL AS VARCHAR) AS b1, CAST(NULL AS VARCHAR) AS b2, CAST(NULL AS VARCHAR) AS b3 FROM counts
  UNION ALL
  SELECT conv, i + 1, {paid('b0', 4, 'D')}, least({paid('b1', 4, 'D')}, {kept('b0', 's')}),
    least({paid('i2', 4, 'D')}, {kept('least(b0, b1, i3)', 'u')}, {moved('least(b0, b1, i3)')}),
    least({paid('i3', 4, 'D')}, {kept('i2', 'a')}, {moved('i2')})
  FROM (
    SELECT w.conv, w.i, b0, b1, {i2} AS i2, least(b3, {paid(i2, 3, 'I')}) AS i3, m.fault, m.initial
    FROM walk w JOIN marked m ON m.conv = w.conv AND m.i = w.i + 1)),
ends AS (
  SELECT conv, least(b0, b3, {paid('b2', 3, 'I')}, {paid(paid('b1', 3, 'I'), 3, 'I')}) AS best FROM walk JOIN counts USING (conv) WHERE i = n),
letters AS (
  SELECT conv, k, substr(best, 9 + k, 1) AS op FROM (SELECT conv, best, unnest(range(1, length(best) - 8)) AS k FROM ends)),
steps AS (
  SELECT conv, k, op, count(*) FILTER (WHERE op <> 'I') OVER (PARTITION BY conv ORDER BY k) AS i,
    count(*) FILTER (WHERE op <> 'D') OVER (PARTITION BY conv ORDER BY k) AS o
  FROM letters),
shown AS (SELECT s.conv, s.k, s.op, s.o, m.role, m.text, m.initial FROM steps s LEFT JOIN marked m ON m.conv = s.conv AND m.i = s.i AND s.op <> 'I' WHERE s.op <> 'D'),
heads AS (SELECT conv, max(CASE WHEN o = 1 AND op = 'K' AND initial = 's' THEN 1 ELSE 0 END) AS system FROM shown GROUP BY conv),
lines AS (
  SELECT conv, k, CASE WHEN op = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END AS line
  FROM shown JOIN heads USING (conv)),
texts AS (SELECT conv, sha256(string_agg(line, chr(10) ORDER BY k)) AS digest FROM lines GROUP BY conv)
SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit,
  coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM named) n LEFT JOIN counts USING (conv) LEFT JOIN ends USING (conv) LEFT JOIN texts USING (conv)
"""


ORACLE_SQL = _oracle()
