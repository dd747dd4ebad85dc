"""Connected components against a plain search."""

import random

from panelspark.llm import graph


def plain(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


def labels(found):
    rows = found.collect()
    out = {r["id"]: r["label"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_components_and_known_labels(spark):
    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 120)]
    loose = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    first = [(u, v) for u, v in chain + star + loose if u != v]
    more = [(5, 119), (300, 301), (301, 110), (400, 401)]
    frame = lambda edges: spark.createDataFrame(edges, "u long, v long")
    known = graph.components(frame(first + first[:3]))
    assert labels(known) == plain(first)
    assert labels(graph.components(frame(more), known)) == plain(first + more)
    assert labels(graph.components(frame([]), known)) == plain(first)
    assert labels(graph.components(frame([(7, 7)]))) == {}
