"""Conversation repair against a plain search over edits, with odd rows, and with conversations of many blocks."""

import collections
import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelspark.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, place int, conv string, block int, _Code string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows):
    """What the contract asks of one conversation's rows after damage."""
    rows = sorted(((t, r, x) for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall("[^ \t\n\v\f\r]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, last, inserts):
        """Cheapest (cost, audit, messages) for the rows from i on, after a message with initial `last`."""
        options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        fits = lambda x: last + x in ("s", "u", "su", "ua", "au")
        for letter, name in (("u", "user"), ("a", "assistant")):
            if fits(letter) and inserts < 3:
                cost, audit, rest = best(i, letter, inserts + 1)
                options.append((cost + 3, "I" + audit, ((name, ""), *rest)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, rest = best(i + 1, last, 0)
            options.append((cost + 4, "D" + audit, rest))
            if faults[i] in ("", "truncated"):
                extra = 3 * (faults[i] == "truncated")
                ways = [(role[:1], role, 0, "K"), ("u", "user", 3, "R"), ("a", "assistant", 3, "R")]
                for letter, name, price, op in ways:
                    if letter and fits(letter):
                        cost, audit, rest = best(i + 1, letter, 0)
                        options.append((cost + price + extra, op + audit, ((name, text), *rest)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    cost, audit, left = best(0, "", 0)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()), left


def conversations(seed, n, most):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", "  ", "", None, "What?\n", "ok! \t", "é…", "Fine.", "x. y", "long " * 3000 + "."]
    rows = []
    for conv in [*range(n), None, -7]:
        for k in range(rnd.randint(0, most)):
            role = rnd.choice(["user", "assistant"] * 6 + ["system", None, "", "User", "tool"])
            turn = None if rnd.random() < 0.05 else k + 3 * (rnd.random() < 0.1)
            rows.append((conv, turn, role, rnd.choice(texts) if rnd.random() < 0.6 else f"{conv} {k}."))
    rows += [(n, 0, "system", "Hi.")] + [(n + 1, 5, "user", "again.")] * 4 + [(n + 2, -(1 << 63), "user", "a."), (n + 2, (1 << 63) - 1, "assistant", "b.")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "fan", "most"), [(1024, 1024, 9), (3, 2, 30), (1, 3, 12)])
def test_repair_equals_a_plain_search(spark, block, fan, most):
    rows = conversations(block, 40, most)
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)
    hurt = cr.damage(df).withColumn("fault", F.lit("z"))
    placed = cr.mark(hurt, block)
    edits, costs = cr.repair(placed, block, fan)
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.report(placed, edits, costs, df, block).collect()}
    groups = collections.defaultdict(list)
    for r in damaged(rows):
        groups[r[0]].append(r)
    shown = collections.defaultdict(list)
    for r in sorted(cr.repaired(placed, edits, block).collect(), key=lambda r: (r["block"], r["position"])):
        shown[r["conv_id"]].append((r["role"], r["text"]))
        assert (r["edit"] == "I") <= (r["turn"] is None and r["text"] == "")
    assert got.keys() == {r[0] for r in rows}
    for conv in got:
        want, left = expected(groups[conv])
        want = (min(want[0], (1 << 63) - 1), *want[1:])
        assert got[conv] == want, conv
        assert tuple(shown[conv]) == left


def test_each_signature_is_solved_once_and_by_halves(monkeypatch):
    calls = collections.Counter()
    plain = cr._one
    monkeypatch.setattr(cr, "_one", lambda c: calls.update(c) or plain(c))
    solver = cr.Solver()
    first = solver.solve("suaUxo" * 50)
    assert solver.solve("suaUxo" * 50) is first and set(calls) == set("suaUxo") and max(calls.values()) == 1
    # A long run of right messages costs nothing from start to end, and one way only.
    assert solver.solve("ua" * 5000)[cr.START, cr.ASSISTANT] == (0, "KK" * 5000)


def test_solver_forgets_when_it_holds_too_much(monkeypatch):
    monkeypatch.setattr(cr, "MEMORY", 500)
    small, large, rnd = cr.Solver(), None, random.Random(1)
    monkeypatch.undo()
    large = cr.Solver()
    for _ in range(30):
        signature = "".join(rnd.choice("xsuaoSUAO") for _ in range(rnd.randint(1, 40)))
        monkeypatch.setattr(cr, "MEMORY", 500)
        got = small.solve(signature)
        monkeypatch.undo()
        assert got == large.solve(signature)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    placed = cr.mark(empty)
    edits, costs = cr.repair(placed)
    assert cr.report(placed, edits, costs, empty).count() == 0 and cr.repaired(placed, edits).count() == 0
    gone = spark.createDataFrame([(None, None, None, None, 1, "x", 2, "y")], SCHEMA)  # conversation without rows after damage
    got = cr.report(placed, edits, costs, gone).collect()
    assert [tuple(r) for r in got] == [(None, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
