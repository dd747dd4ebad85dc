"""The numbered operators against brute force on small tables, with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import brown, decontaminate, joins, labelled, nbsvm, near_dedup, packing, perspectives, queries, sharding, topk, toxicity, url_rules, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, shard int, score double, n_words int"


def documents(spark, texts, first=1):
    """Texts as documents, with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 7, 0.5, 3) for i, t in enumerate(texts, first)], DOCS)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


ODD = [None, "", " \n ", "one", "One", "a b c", "a b c", "é ß " * 40, "x" * 30_000, "word " * 30_000]


def test_word_hashes_equal_words():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aAbé \t\n,") for _ in range(rnd.randint(0, 30))) for _ in range(500)] + [None, "", "x" * 5000]
    seen = {}
    for row, stop, _, starts, lengths, hashes, before in words.chunks(pa.array(texts)):
        for i in range(row, stop):
            own = hashes[before[i - row] : before[i - row + 1]].tolist()
            want = re.findall(rb"[^\x20\x09-\x0d]+", (texts[i] or "").encode().lower())
            assert len(own) == len(want)
            for h, w in zip(own, want, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# --- op1


def test_base_score_by_hand_and_model_beats_it(spark):
    docs = table(spark, "documents").select("doc_id", "text").union(spark.createDataFrame([(None, "the of"), (10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    got = brown.score(docs.withColumn("score", F.lit(1)), ~queries._folded("doc_id", 10, 0)).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    counts, n = collections.Counter(), 0
    split = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    for r in rows:
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10:
            own = split(r["text"])
            counts.update(own)
            counts["END"] += 1
            n += len(own) + 1
    texts = {r["doc_id"]: r["text"] for r in rows}
    below, held = 0, 0
    for g in got:
        own = [*split(texts[g["doc_id"]]), "END"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in own)
        assert g["n_tokens"] == len(own) and g["n_known"] == sum(counts[w] > 0 for w in own) and g["train_tokens"] == n
        assert g["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(g["score"]) and g["score"] < 0
        if not g["trains"] and g["doc_id"] is not None:
            held += 1
            below += g["score"] < g["base_score"]
    assert below < held / 4


def test_class_model_sums_to_one_at_most(spark):
    """Over all known words after a word, and the unknown ones of every form, probabilities are no more than 1."""
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)]
    docs = documents(spark, [" ".join(rnd.choice(vocabulary) for _ in range(20)) for _ in range(60)])
    probes = documents(spark, [f"w0 {w}" for w in vocabulary] + ["w0"], first=1000)
    got = {r["doc_id"]: r["score"] for r in brown.score(docs.union(probes), F.col("doc_id") < 1000).collect()}
    # P(w0 w END) summed over w, plus P(w0 END), is at most P(w0).
    total = sum(10 ** got[1000 + i] for i in range(len(vocabulary) + 1))
    assert 0 < total < 1


def test_language_model_of_nothing(spark):
    assert brown.score(documents(spark, []), F.lit(True)).count() == 0
    got = brown.score(documents(spark, ["a b", None]), F.lit(False)).orderBy("doc_id").collect()
    assert [(g["n_tokens"], g["n_known"], g["train_tokens"]) for g in got] == [(3, 0, 0), (1, 0, 0)] and all(math.isfinite(g["score"]) for g in got)


def test_words_beyond_the_units_have_classes_of_their_own(spark, monkeypatch):
    """Two kinds of words with the same endings alternate; only classes of single words can tell them apart."""
    monkeypatch.setattr(brown, "UNITS", 20)
    monkeypatch.setattr(brown, "HEAD", 60)
    rnd = random.Random(4)
    kinds = [[f"{c}{i}x" for i in range(60)] for c in "ab"]
    texts = [" ".join(rnd.choice(kinds[k % 2][: 10 if rnd.random() < 0.8 else None]) for k in range(40)) for _ in range(300)]
    a, b = (k[20:] for k in kinds)
    docs = documents(spark, texts).union(documents(spark, [f"{x} {y}" for x, y in zip(a + b, b + a, strict=True)], first=10_000))
    got = {r["doc_id"]: r["score"] for r in brown.score(docs, F.col("doc_id") < 5000).collect()}
    assert sum(got[10_000 + i] > got[10_040 + i] + 1 for i in range(40)) >= 36


def test_best_classes_equal_one_by_one():
    rng = np.random.default_rng(5)
    between = rng.integers(50, 500, (6, 6)).astype(float)
    before, after = rng.integers(0, 4, (40, 6)), rng.integers(0, 4, (40, 6))
    before[:, 1] += 1
    after[:, 2] += 1
    now = rng.integers(1, 6, 40).astype(np.int32)
    assert brown.best_classes(before, after, now, between, rows=16).tolist() == [brown.best_class(before[k], after[k], int(now[k]), between) for k in range(40)]


def test_most_frequent_words_fill_the_table(spark, monkeypatch):
    counts = spark.createDataFrame([(i, i % 3, 5 if i == 7 else 2) for i in range(-10, 10)], "word long, form int, n long")
    keys, n, form = brown._most_frequent(counts, 8)
    assert len(keys) == len(form) == 8 and sorted(n.tolist()) == [2] * 7 + [5]
    rnd = random.Random(8)
    sizes = [rnd.choice([1, 2, 3, rnd.randint(1, 100), rnd.randint(10**6, 10**6 + 5000)]) for _ in range(400)]
    counts = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "word long, form int, n long")
    for ranges in (512, 3):
        monkeypatch.setattr(brown, "RANGES", ranges)
        for most in (0, 1, 37, 120, 399, 1000):
            want = sorted((-n, i) for i, n in enumerate(sizes) if n > 1)[:most]
            keys, n, _ = brown._most_frequent(counts, most)
            assert sorted(zip((-n).tolist(), keys.astype(np.int64).tolist(), strict=True)) == want


def test_score_equals_a_plain_class_model(spark, monkeypatch):
    """Classes as the operator found them; counts, smoothing and sums by hand. Repeated, empty and very long texts."""
    rnd = random.Random(9)
    vocabulary = [f"w{i}{c}" for i in range(30) for c in "ab"]
    texts = [" ".join(rnd.choice(vocabulary[: rnd.randint(3, 60)]) for _ in range(rnd.randint(0, 30))) for _ in range(120)]
    texts += [texts[0]] * 5 + ["", None, "w1a w2b " * 20_000, "once1a twice2b", "x" * 50_000] + ["new1a w1a other7b W2B", "unseenzz"]
    seen = {}
    plain_cut, plain_cluster = brown.cut, brown.cluster
    monkeypatch.setattr(brown, "cut", lambda df, name: seen.setdefault(name, plain_cut(df, name)))
    monkeypatch.setattr(brown, "cluster", lambda *a: seen.setdefault("cluster", plain_cluster(*a)))
    docs = documents(spark, texts)
    trains = F.col("doc_id") <= len(texts) - 2
    got = {r["doc_id"]: r for r in brown.score(docs, trains).collect()}
    lexicon = {r["word"]: (r["n"], r["class"]) for r in seen["lexicon"].collect()}
    of_form = seen["cluster"][0][-brown.FORMS :]
    kinds, once, tokens = collections.Counter(), collections.Counter(), collections.Counter()
    for n, c in lexicon.values():
        kinds[c] += 1
        once[c] += n == 1
    classed = {}
    for row, _, data, starts, lengths, hashes, before in words.chunks(pa.array(texts)):
        keys, form = hashes.view(np.int64).tolist(), brown.forms(data, starts, lengths).tolist()
        for k in range(len(before) - 1):
            own = slice(before[k], before[k + 1])
            classed[row + k + 1] = [(w, lexicon[w][1] if w in lexicon else int(of_form[f])) for w, f in zip(keys[own], form[own], strict=True)]
    pairs = collections.Counter()
    for i, line in classed.items():
        if i <= len(texts) - 2:
            path = [0, *(c for _, c in line), 0]
            pairs.update(zip(path, path[1:], strict=False))
    for (_, c), n in pairs.items():
        tokens[c] += n
    total = sum(tokens.values()) + brown.CLASSES * 0.1
    for i, line in classed.items():
        path, want = [0, *(c for _, c in line), 0], 0.0
        for c, d in zip(path, path[1:], strict=False):
            row = sum(n for (x, _), n in pairs.items() if x == c)
            want += math.log10((pairs[c, d] + brown.BACKOFF * (tokens[d] + 0.1) / total) / (row + brown.BACKOFF))
        for w, c in line:
            unknown = min(max((once[c] + 0.1) / (tokens[c] + 0.2), 1e-9), 0.9)
            want += math.log10((1 - unknown) * (lexicon[w][0] + 0.1) / max(tokens[c] + 0.1 * kinds[c], 0.1)) if w in lexicon else math.log10(unknown)
        assert got[i]["score"] == pytest.approx(want, rel=1e-9), i
    assert got[1]["score"] == pytest.approx(got[121]["score"]) and len(got) == len(texts)


def test_exchange_takes_the_likeliest_class_and_never_falls(spark):
    """best_class against the likelihood of every class in turn; clustering against where it began."""
    rnd = random.Random(4)
    n_units, n_classes = 30, 7
    text = [0]
    while len(text) < 4_000:
        u = rnd.randrange(1, n_units) if rnd.random() < 0.9 else 0
        if u != text[-1]:
            text.append(u)
    text = np.array([*text, 0] if text[-1] else text)

    def pairs(classes):
        c, out = classes[text], np.zeros((n_classes, n_classes))
        np.add.at(out, (c[:-1], c[1:]), 1)
        return out

    classes = np.array([0, *(rnd.randrange(1, n_classes) for _ in range(n_units - 1))])
    for u in range(1, n_units):
        before, after = np.zeros(n_classes), np.zeros(n_classes)
        np.add.at(before, classes[text[:-1][text[1:] == u]], 1)
        np.add.at(after, classes[text[1:][text[:-1] == u]], 1)
        by_class = {}
        for c in range(1, n_classes):
            moved = classes.copy()
            moved[u] = c
            by_class[c] = brown.likelihood(pairs(moved))
        got = brown.best_class(before, after, int(classes[u]), pairs(classes))
        assert by_class[got] == pytest.approx(max(by_class.values()), abs=1e-6)
    inner = text[1:-1]
    texts = [t for t in np.split(inner, np.flatnonzero(inner == 0))]
    df = spark.createDataFrame([(bytearray(t[t > 0].astype("<u4").tobytes()),) for t in texts], "units binary")
    start, none = brown.cluster(df, np.arange(n_units, dtype=np.int32), n_units, n_classes, rounds=0)
    end, counts = brown.cluster(df, np.arange(n_units, dtype=np.int32), n_units, n_classes, gain=0.0)
    assert brown.likelihood(counts) > brown.likelihood(none) and counts.sum() == none.sum() and start[0] == end[0] == 0


def test_perplexity_is_that_of_the_score(spark):
    rows = brown.score(documents(spark, ["a b c a b", "a b", None, "d"]), F.lit(True)).collect()
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in rows)


# --- op2


def test_rendezvous_shards(spark):
    docs = documents(spark, [f"text {i % 50}" for i in range(600)]).union(documents(spark, ODD, first=5000)).union(spark.createDataFrame([(None, "n", "en", 0, 0.0, 0)] * 3, DOCS))
    shards = [(k, 1.0) for k in range(16)]
    got = sharding.shard_documents(docs, shards, (16, 1.0)).collect()
    assert len(got) == docs.count()
    slots = collections.defaultdict(list)
    for g in got:
        slots[g["shard"]].append(g["slot"])
        assert g["grown_shard"] in (g["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for g in got:
        raw = (texts[g["doc_id"]] or "").encode()
        assert (g["size"], g["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))

    def wins(key):
        draw = lambda s: (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return max(range(16), key=lambda s: (-1 / math.log(draw(s)), s))

    assert all(g["shard"] == wins("" if g["doc_id"] is None else g["doc_id"]) for g in got)
    assert sharding.shard_documents(documents(spark, []), shards).count() == 0


def test_weights_draw_their_share(spark):
    got = sharding.assign(spark.range(4000), "id", [(0, 1.0), (1, 3.0)]).groupBy("shard").count().collect()
    assert 0.68 < {r["shard"]: r["count"] for r in got}[1] / 4000 < 0.82


def test_slots_follow_the_order_at_every_size(spark):
    """Small ranges number as one window does, with nulls last, rows that repeat often, and columns named like helpers."""
    rows = [(k % 3, k if k % 7 else None, k % 5, "r") for k in range(300)] + [(1, 42, 0, "hot")] * 150
    records = spark.createDataFrame(rows, "shard int, id long, _times int, _Range string")
    for bucket_rows in (20, 10_000):
        got = sharding.number_slots(records, ["id"], bucket_rows).collect()
        for shard in range(3):
            own = sorted((r for r in rows if r[0] == shard), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
            assert [tuple(r[:4]) for r in sorted(got, key=lambda r: r["slot"]) if r["shard"] == shard] == own
            assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(len(own)))


# --- op3


def test_packing_is_an_exact_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = table(spark, "documents").select("doc_id", "text").union(documents(spark, ODD, first=10**6).select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(5, "again")] * 70 + [(5, "long again " * 3000)] * 3 + [(None, "null id"), (None, None), (None, "")], "doc_id long, text string"))
    pieces = packing.token_pieces(docs.withColumn("length", F.lit(1)), path, keep_ids=True)
    got = packing.pack(pieces.withColumn("_Group", F.lit("x")), docs.count(), group_documents=50).collect()
    packed, used = collections.Counter(), collections.defaultdict(list)
    for g in got:
        used[g["sequence_id"]].append((g["offset"], g["length"]))
        assert zlib.crc32(np.array(g["ids"], "<u4").tobytes()) == g["ids_crc32"] and len(g["ids"]) == g["length"]
        packed[g["doc_id"], g["start"], g["doc_tokens"], tuple(g["ids"])] += 1
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    want = collections.Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.update((r["doc_id"], k, len(ids), tuple(ids[k : k + 4096])) for k in range(0, len(ids), 4096))
    assert packed == want
    assert packing.pack(packing.token_pieces(documents(spark, []), path), 0).count() == 0


def test_repeated_pieces_are_spread_over_groups(spark):
    """20,000 equal rows at 4,096 a group go to five groups evenly, and get the same places whatever order they come in."""
    rows = spark.range(20_000).select(*(F.lit(x).cast("long").alias(c) for c, x in (("doc_id", None), ("start", 0), ("length", 1), ("ids_crc32", 7), ("doc_tokens", 1))))
    some = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") + 1).alias("length"), F.col("id").alias("ids_crc32"), (F.col("id") + 1).alias("doc_tokens"))
    got = packing.pack(rows.union(some), 20_300).collect()
    groups = collections.Counter(g["sequence_id"] >> 32 for g in got if g["doc_id"] is None)
    assert len(got) == 20_300 and sorted(groups.values()) == [4_000] * 5
    assert sorted(map(str, got)) == sorted(map(str, packing.pack(some.repartition(7).union(rows.repartition(3)), 20_300).collect()))


def test_first_fit_decreasing_equals_the_plain_loop():
    rnd = random.Random(0)
    for _ in range(30):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 60))]
        room, want = [], {}
        for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((i for i, x in enumerate(room) if x >= lengths[k]), len(room))
            if b == len(room):
                room.append(20)
            want[k] = (b, 20 - room[b])
            room[b] -= lengths[k]
        bins, offsets = packing.first_fit_decreasing(lengths, 20)
        assert [want[k] for k in range(len(lengths))] == list(zip(bins, offsets, strict=True))


def test_word_tokenizer_on_odd_texts():
    rnd = random.Random(4)
    parts = ["ab", "Z", "é", "É.", " ", "\n", ",", "'s", "it's", "…,", "́", "　", "%%%", "12", "<|", "<|endoftext|>", "ﬁ", "\x1c", "Ω!"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(1500)]
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    got = list(own.texts(pa.array(texts)))
    assert all(own.tokenizer.encode(t, add_special_tokens=False).ids == g.tolist() for t, g in zip(texts, got, strict=True))


# --- op4

RULES = [url_rules.Rule("allow", "org", "/"), url_rules.Rule("block", "example.org", "/es/"), url_rules.Rule("block", "example.org", "/en/1"), url_rules.Rule("allow", "com", "/fr/"), url_rules.Rule("block", "com", "/de/")]


def test_url_rules_by_hand(spark):
    urls = ["https://a.example.org/es/1", "http://EXAMPLE.org/en/12?x", "https://b.org/", "https://b.org", "http://x.com/fr/2#f", "x.com/fr/2", None, "", "s://notexample.org/es/1", "http://y.com/de/3", "http://y.net/it/3", "http://q?://z.org/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, RULES).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("b.org", "/", "org/", "allow") and got[3][:3] == ("b.org", "", None)
    assert got[4] == ("x.com", "/fr/2", "com/fr/", "allow") and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None)
    assert got[8][2] == "org/" and got[9] == ("y.com", "/de/3", "com/de/", "block") and got[10][2] is None and got[11][:3] == ("q", "", None)
    assert url_rules.judge(pages.limit(0), RULES).count() == 0 and url_rules.judge(pages.filter("page_id = 10"), RULES).first()["verdict"] == "allow"


def test_mined_rules_generalise(spark):
    rows = [(f"http://h{i}.example.org/{'es' if i % 2 else 'en'}/{2000 + i}",) for i in range(60)] + [("http://new.net/es/7000",), ("http://new.net/en/7000",)]
    pages = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_rules.judge(pages, RULES, min_support=0.05).collect()}
    assert got[60]["rule"] is None and got[60]["verdict"] == "block" and got[61]["verdict"] == "allow"


def test_mined_rules_equal_brute_force(spark):
    """Every token set of labelled URLs, its support and confidence, pruning and the surest rule that holds, by plain loops."""
    rnd = random.Random(9)
    hosts, words_of, ends = ["a.org", "b.org", "c.com", "d.com"], ["x", "y", "z", "news", "12", "345"], ["", ".html", ".php"]
    urls = [f"http://{rnd.choice(hosts)}/{rnd.choice(words_of)}/{rnd.choice(words_of)}{rnd.choice(ends)}" for _ in range(150)]
    urls += [f"http://{rnd.choice(['e.net', 'a.net'])}/{rnd.choice(words_of)}/{rnd.choice(words_of)}" for _ in range(60)] + [None, "", "x" * 5_000, "http://e.net/" + "y/" * 3_000] + urls[:5]
    rules = [url_rules.Rule("block", "org", "/x"), url_rules.Rule("allow", "org", "/"), url_rules.Rule("allow", "com", "/y/"), url_rules.Rule("block", "com", "/z/")]
    df = spark.createDataFrame([(i, u, "r", "t", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, found string, salt int")
    url = F.col("url")
    shown = df.select("page_id", url_rules.explicit(url_rules.host_of(url), url_rules.path_of(url), rules).alias("said"), url_rules.tokens(url, url_rules.host_of(url), url_rules.path_of(url)).alias("tokens")).collect()
    labelled_rows = [(frozenset(r["tokens"]), r["said"]["verdict"]) for r in shown if r["said"]]
    support, confidence = 0.03, 0.8
    counts, joint = collections.Counter(), collections.Counter()
    for own, verdict in labelled_rows:
        for size in range(1, len(own) + 1):
            for some in itertools.combinations(sorted(own), size):
                counts[some] += 1
                joint[some, verdict] += 1
    n = len(labelled_rows)
    mined = {(t, v): (k / counts[t], k / n) for (t, v), k in joint.items() if k >= math.ceil(support * n) and k / counts[t] >= confidence}
    kept = {(t, v): x for (t, v), x in mined.items() if not any((p := tuple(y for y in t if y != left), v) in mined and mined[p, v][0] >= x[0] for left in t)}
    got = url_rules.mine(spark.createDataFrame([(sorted(t), v) for t, v in labelled_rows], "tokens array<string>, verdict string"), support, confidence).collect()
    assert {(tuple(r["rule"]), r["verdict"]): (pytest.approx(r["confidence"]), pytest.approx(r["support"])) for r in got} == kept and len(kept) > 10
    verdicts = {r["page_id"]: r["verdict"] for r in url_rules.judge(df, rules, "allow", support, confidence).collect()}
    for r in shown:
        holding = [(c, s, len(t), v) for (t, v), (c, s) in kept.items() if set(t) <= set(r["tokens"])]
        assert verdicts[r["page_id"]] == (r["said"]["verdict"] if r["said"] else max(holding)[3] if holding else "allow")


# --- op5 and op9


def test_quality_scores(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = nbsvm.learn(docs, labels)
    got = nbsvm.scored(docs.union(docs.limit(1).select(F.lit(-1).cast("long"), F.lit(None).cast("string"), "lang", "source", "n_chars")), model).join(labels, "doc_id", "left").collect()
    assert all(0 <= g["score"] <= 1 for g in got)
    known = [(g["score"] >= 0.7, g["quality"] == 1) for g in got if g["quality"] is not None]
    assert sum(a == b for a, b in known) / len(known) > 0.85
    assert nbsvm.keep_good(docs, model).columns == docs.columns


def test_classifiers_without_labels(spark):
    docs, none = documents(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert nbsvm.keep_good(docs, nbsvm.learn(docs, none)).count() == len(ODD)
    assert toxicity.drop_toxic(docs, toxicity.learn(docs, none)).count() == len(ODD)
    nulls = spark.createDataFrame([(None, 1, 1), (2, None, None), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert nbsvm.scored(docs, nbsvm.learn(docs, nulls)).filter("score > 0.9").count() == len(ODD)
    assert toxicity.scored(docs, toxicity.learn(docs, nulls)).count() == len(ODD)
    assert toxicity.scored(docs.limit(0), toxicity.learn(docs.limit(0), nulls)).count() == 0


def test_log_count_ratio_by_hand():
    rows, y = [np.array([0, 5]), np.array([5, 7]), np.array([7])], np.array([1, 0, 1])
    counts = nbsvm.class_counts(rows, y)
    ratio = nbsvm.log_count_ratio(counts)
    total = [nbsvm.DIMENSIONS * nbsvm.PRIOR + 2, nbsvm.DIMENSIONS * nbsvm.PRIOR + 3]  # places set in class 0, and 1
    for place, (one, none) in {0: (1, 0), 5: (1, 1), 7: (1, 1), 9: (0, 0)}.items():
        assert ratio[place] == pytest.approx(math.log((one + 1) / total[1]) - math.log((none + 1) / total[0]))


@pytest.mark.parametrize(("name", "label", "held"), [("op5_nbsvm", "quality", 0.9), ("op9_lexicon", "toxic", 0.8)])
def test_held_out_documents_are_told_apart(spark, name, label, held):
    """The chance that a held-out document of label 1 scores above one of label 0."""
    sf = "/root/testdata/sf0.01"
    scores = queries.QUERIES[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label), "doc_id")
    got = [(r["score"], r[label]) for r in scores.collect()]
    good, bad = [s for s, y in got if y], [s for s, y in got if not y]
    assert good and bad and np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > held


def test_one_row_of_a_repeated_labelled_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "a"), (3, "a"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", 100).collect()
    assert sorted((r["doc_id"], r["label"]) for r in got) == [(1, 1), (2, 0), (4, 1)]
    assert sorted(got) == sorted(labelled.sample(docs.repartition(3), labels, "quality", 100).collect())


def test_lexicon_matches_equal_a_plain_scan():
    rnd = random.Random(3)
    for _ in range(60):
        word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5)))
        weights = {e: rnd.randint(1, 9) / 2 for _ in range(6) for e in [rnd.choice([f" {word()}", f" {word()} "])]}
        exceptions = [f"{word()} {word()}" for _ in range(4)]
        folded = f" {' '.join(word() for _ in range(60))} "
        spans = [(i, i + len(x) + 1) for x in exceptions for i in range(len(folded)) if folded.startswith(f" {x} ", i)]
        best = {}
        for entry, w in weights.items():
            for i in range(len(folded)):
                if folded.startswith(entry, i) and not any(a <= i and i + len(entry) - 1 <= b for a, b in spans):
                    best[i] = max(best.get(i, 0), w)
        assert toxicity.measure(folded, toxicity.Lexicon(weights, exceptions, np.zeros(3)).automaton()) == (pytest.approx(sum(best.values())), 60)


@pytest.mark.parametrize("rare", [100, 6])
def test_dual_coordinate_descent_meets_its_conditions(rare):
    """At the optimum, w is the dual's sum, and each dual is 0 beyond the margin, at its bound within, and between on it."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for k in range(200):
        rows.append(np.unique(np.append(rng.integers(10, 60, 8), 3 if k < rare else 5)).astype(np.int32))
        y.append(1.0 if k < rare else -1.0)
    y = np.array(y)
    scale = nbsvm.log_count_ratio(nbsvm.class_counts(rows, y))
    w, alpha, limit = nbsvm.solve_dual(rows, scale, y, epochs=3000)
    values = [scale[r] / len(r) ** 0.5 for r in rows]
    total = np.zeros(len(scale) + 1)
    for r, v, a, t in zip(rows, values, alpha, y, strict=True):
        total[r] += a * t * v
        total[-1] += a * t
    assert np.allclose(total, w, atol=1e-9)
    margin = y * np.array([w[:-1][r] @ v + w[-1] for r, v in zip(rows, values, strict=True)])
    assert ((alpha >= 0) & (alpha <= limit)).all() and np.isclose(limit[y > 0].sum(), limit[y < 0].sum())
    assert (margin[alpha == 0] > 1 - 1e-3).all() and (margin[alpha == limit] < 1 + 1e-3).all()
    assert np.abs(margin[(alpha > 0) & (alpha < limit)] - 1).max(initial=0) < 1e-3
    assert (margin > 0).mean() > 0.97 and (alpha > 0).any()


def test_rare_labels_are_in_the_model(spark):
    """3 of 600 labels: no row of either class is left out, whatever its group."""
    docs = documents(spark, [("shine " if i % 200 == 7 else "murk ") + " ".join(f"w{(i * k) % 50}" for k in range(1, 9)) + f" u{i}" for i in range(600)])
    labels = docs.select("doc_id", F.when(F.col("text").startswith("shine"), 1).otherwise(0).alias("quality"))
    dealt = nbsvm.groups_of(labelled.sample(docs, labels, "quality", 8_000), 150).groupBy("part").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).collect()
    assert len(dealt) == 3 and all(r["ones"] == 1 and r["n"] in (199, 200, 201) for r in dealt)
    model = nbsvm.learn(docs, labels, group_rows=150)
    got = {r["doc_id"]: r["score"] for r in nbsvm.scored(docs, model).collect()}
    ones = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    assert min(got[i] for i in ones) > max(s for i, s in got.items() if i not in ones)


def test_lexicon_learns_words_disguises_and_exceptions(spark):
    rnd = random.Random(3)
    plain = [f"lorem{i}" for i in range(200)]
    bad = [" ".join(rnd.sample(plain, 12) + [rnd.choice(["grunk", "grunks", "zorbly"])]) for _ in range(40)]
    good = [" ".join(rnd.sample(plain, 13)) for _ in range(160)] + [" ".join([*rnd.sample(plain, 6), "grunk fish", *rnd.sample(plain, 6)]) for _ in range(6)]
    docs = documents(spark, bad + good)
    labels = spark.createDataFrame([(i + 1, int(i < len(bad))) for i in range(len(bad) + len(good))], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert "grunk fish" in lexicon.exceptions
    probes = ["you GRUNK", "you gru\u200bnk", "zоrbly here", "z0rbly", "grunk fish", "all is well", "", None]
    got = [r["score"] >= 0.3 for r in toxicity.scored(documents(spark, probes), lexicon).orderBy("doc_id").collect()]
    assert got == [True, True, True, True, False, False, False, False]
    assert toxicity.drop_toxic(docs, lexicon).columns == docs.columns


# --- op6


def shingles(text, width=2):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width=2):
    sets = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for size in (4, 5, 6, 11, 30, 60, 120):
        for _ in range(6):
            base = [rnd.choice(vocabulary) for _ in range(size)]
            out.append(" ".join(base))
            for _ in range(5):
                copy = list(base)
                for _ in range(rnd.randint(0, max(1, size // 9))):
                    copy[rnd.randrange(size)] = rnd.choice(vocabulary)
                out.append(" ".join(copy).upper() if rnd.random() < 0.3 else " \n".join(copy))
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    out += [" ".join(passage + [rnd.choice(vocabulary) for _ in range(20)]) for _ in range(70)]  # a crowd just below the threshold
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies() + ODD
    docs = documents(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert got == brute_components(list(enumerate(texts, 1)))
    kept = near_dedup.drop_near_duplicates(docs, 2)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c)


def test_crowds_of_many_sizes_equal_brute_force(spark, monkeypatch):
    """Texts about a shared passage, in several blocks and rungs of sizes: some pairs lie at the threshold, a rung apart."""
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    monkeypatch.setattr(near_dedup, "CROWD", 3)
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(41)]
    texts = [" ".join(passage + [f"{k}x{i}" for i in range(rnd.randint(0, 60))]) for k in range(60)]
    tails = [[f"t{k}w{i}" for i in range(40)] for k in range(20)]
    texts += [" ".join(passage + t[:n]) for t in tails for n in (12, rnd.randint(20, 27), rnd.randint(30, 40))]
    texts += [" ".join(passage[:n]) for n in (33, 41)]  # 32 and 40 shingles: exactly four fifths
    want = brute_components(list(enumerate(texts, 1)))
    docs = documents(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert got == want
    # All of them as one crowd, so that nothing but blocks can find the links.
    crowd = spark.createDataFrame([(1, i, i, n) for i, (n, _) in want.items()], "bucket long, id long, label long, n long")
    label = {i: i for i in want}
    for a, b in near_dedup._crowd_links(crowd, docs, 2, 80).collect():
        a, b = label[a], label[b]
        label = {i: min(a, b) if x in (a, b) else x for i, x in label.items()}
    assert label == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_of_odd_keys(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, "A b  c"), (2, "A b  c"), (3, "x"), (4, "x"), (5, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, 2).collect())
    assert got == [(0, None, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 3, False), (5, 5, True)]
    assert near_dedup.near_duplicates(docs.limit(0), 2).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (5, 40, 300, 3000):
        errors = []
        for _ in range(20):
            pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
            a, b = np.sort(pool[: int(n * 1.2)]), np.sort(pool[int(n * 0.2) : int(n * 1.4)])
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
            errors.append(got - truth)
        assert abs(np.mean(errors)) < 0.06


# --- op7


def test_rotation_by_hand(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "yo"), (2, 0, "system", "x"), (None, 5, None, "n"), (3, None, "cy", "late"), (3, 70, "cy", "far")]
    df = spark.createDataFrame([(*r, 0, "m") for r in rows], "conv_id long, turn long, role string, text string, part int, mask string")
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in perspectives.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", 0), (3, "cy", 0)}
    ann = got[1, "ann", 0]
    assert ann["text"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    assert [ann["text"][s["first"] : s["last"]] for s in ann["mask"]] == ["hi<|im_end|>", "yo<|im_end|>"]
    assert [got[1, "bob", 0]["text"][s["first"] : s["last"]] for s in got[1, "bob", 0]["mask"]] == ["<|im_end|>"]
    assert got[3, "cy", 0]["text"].index("far") < got[3, "cy", 0]["text"].index("late")
    assert perspectives.rotate(df.limit(0)).count() == 0


def rendered(rows):
    """Text and mask of each (conversation, perspective), by plain Python."""
    dialogues, out = collections.defaultdict(list), {}
    for c, turn, role, text in rows:
        dialogues[c].append((turn is None, turn or 0, role or "unknown", text or ""))
    for c, own in dialogues.items():
        own.sort()
        for me in {r for _, _, r, _ in own} - {"system"}:
            text, mask = "", []
            for _, _, role, t in own:
                text += f"<|im_start|>{'assistant' if role == me else role if role == 'system' else f'user name={role}'}\n"
                if role == me:
                    mask.append((len(text), len(text) + len(t) + 10))
                text += f"{t}<|im_end|>\n"
            out[c, me] = text, mask
    return out


@pytest.mark.parametrize(("part", "run"), [(50, 60), (perspectives.PART_MESSAGES, perspectives.RUN_MESSAGES)])
def test_parts_joined_are_the_whole_rendering(spark, part, run):
    """Dialogues of thousands of messages, any turn numbers, repeated and long messages."""
    rnd = random.Random(7)
    turns = [0, 1, 2, 70, None, -5, 10**12]
    rows = [(c, rnd.choice(turns), rnd.choice(["a", "bé", "system", None]), rnd.choice(["same", f"t{i}", None])) for c in (1, None) for i in range(400)]
    rows += [(2, 0, "a", "same")] * 130 + [(3, 0, "a", "one"), (4, 1, "a", "x" * 300_000), (4, 2, "b", "")] + [(5, i % 1700, f"s{i % 3}", f"m{i}") for i in range(5_000)] + [(6, 0, "system", "x")]
    got, want = collections.defaultdict(list), rendered(rows)
    df = spark.createDataFrame([(*r, 1, "m") for r in rows], "conv_id long, turn long, role string, text string, part int, first_char string")
    for r in perspectives.rotate(df, part_messages=part, run_messages=run).collect():
        got[r["conv_id"], r["perspective"]].append((r["part"], r["first_char"], r["n_messages"], r["text"], [tuple(s) for s in r["mask"]]))
    assert set(got) == set(want)
    sizes = collections.Counter(r[0] for r in rows)
    for (c, me), parts in got.items():
        parts.sort()
        assert [(k, n) for k, _, n, _, _ in parts] == [(k, min(part, sizes[c] - part * k)) for k in range(-(-sizes[c] // part))]
        assert [at for _, at, _, _, _ in parts] == [sum(len(p[3]) for p in parts[:k]) for k in range(len(parts))]
        assert "".join(p[3] for p in parts) == want[c, me][0] and [s for p in parts for s in p[4]] == want[c, me][1]


# --- op8


def brute_contamination(text, items, window=13):
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    doc, hit, found = split(text), set(), set()
    for item_id, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            p = w[k : k + window]
            for i in range(len(doc) - len(p) + 1):
                if doc[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item_id)
    return len(doc), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("block_bytes", [2_000_000, 400])
def test_contamination_equals_brute_force(spark, block_bytes):
    rnd = random.Random(6)
    vocabulary = ["a", "b", "cc", "é1", "d9"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 2, 3, 5, 8, 12, 13, 14, 20, 40, 40])] + [(99, None), (98, "..."), (5, "b b b a cc"), (None, "zz yy")]
    items[0] = (0, "solo")
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    texts += ["x y " + items[10][1].upper().replace(" ", ", ") + " z", items[7][1] * 2, "Solo!", "zz YY", *ODD, "word " * 30_000 + items[9][1]]
    docs, benchmark = documents(spark, texts), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_words int")
    got = decontaminate.contamination(docs, benchmark, block_bytes=block_bytes).select("doc_id", "n_words", decontaminate.n_hit().alias("n"), "item_ids").collect()
    assert {g["doc_id"]: (g["n_words"], g["n"], g["item_ids"]) for g in got} == {i: brute_contamination(t, items) for i, t in enumerate(texts, 1)}
    kept = decontaminate.drop_contaminated(docs, benchmark, block_bytes=block_bytes)
    want = {i for i, t in enumerate(texts, 1) if not ((x := brute_contamination(t, items))[1] and 20 * x[1] >= x[0])}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0 and decontaminate.contamination(docs, benchmark.limit(0)).filter("size(spans) > 0").count() == 0


def test_large_benchmarks_and_hot_passages(spark, monkeypatch):
    """Full tables, passages in most documents and items, items without ids, repeated rows: the join gives what the matcher gives."""
    monkeypatch.setattr(joins, "HOT_ROWS", 7)
    rnd = random.Random(8)
    common = " ".join(f"c{i}" for i in range(30))
    prose = lambda n: " ".join(f"w{int(rnd.paretovariate(0.6)) % 200}" for _ in range(n))
    items = [(i, f"{prose(rnd.randint(0, 40))} {common if i % 3 else ''}") for i in range(120)] + [(None, common), (200, "c3 c4"), (201, "c5"), (200, "c3 c4")] + [(300 + i, f"c0 c1 c2 c3 c4 c5 c6 c7 z{i}") for i in range(60)]
    texts = [f"{prose(rnd.randint(0, 50))} {common} {prose(5)}" for _ in range(60)] + [f"{prose(20)} {rnd.choice(items)[1]}" for _ in range(60)] + ["c0 c1 c2 c3 c4 c5 c6 c7 z9"]
    docs, benchmark = documents(spark, texts), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_words int")
    docs = docs.union(docs.limit(3)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    of = lambda size: sorted(map(repr, decontaminate.contamination(docs, benchmark, block_bytes=size).collect()))
    want = of(1_000_000)
    assert len(want) == docs.count() and of(0) == want
    full = decontaminate._searched_by_join(docs, decontaminate._items(benchmark)[0], 13, "doc_id", slots=4, longs=1)  # nothing is skipped
    assert sorted(map(repr, full.collect())) == want


def test_frequent_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), "id").union(spark.createDataFrame([(None, 5)], "k long, id long"))
    table = spark.createDataFrame([(1, "a"), (2500, "b"), (None, "c"), (7, "d")], "k long, v string")
    got = joins.join_evenly(rows, table, ["k"])
    assert sorted(map(tuple, got.select("k", "v").groupBy("k", "v").count().collect())) == [(1, "a", 2000), (2500, "b", 1)]
    dealt = rows.filter("k = 1").select(F.pmod(F.xxhash64("k", "id"), F.lit(20)).alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert dealt < 200 and joins.join_evenly(rows.limit(0), table, ["k"]).count() == 0


# --- op10


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(size=(300, 6)), 1).astype(np.float32)
    vectors[100:160] = vectors[0]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(1000, None), (1050, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (None, [1.0] * 6), (1200, [3.0, 1.0]), (1250, [1.0, -2.0]), (1300, []), (1301, []), (1350, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q, a in good.items():
        if q % 50 == 0:
            scored = sorted((-int(a @ b), i) for i, b in good.items() if i != q and len(a) == len(b))[:5]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    want = {q: x for q, x in want.items() if x}
    for shard_rows, query_rows in ((16_384, 2_048), (60, 3)):
        got = collections.defaultdict(list)
        for r in topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0, shard_rows=shard_rows, query_rows=query_rows).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        assert dict(got) == want
    assert topk.top_k(topk.quantised(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_repeated_rows(spark):
    """A query's own row occurs often beside equal vectors of other ids, and an id has many vectors."""
    rows = [(0, [9, 9])] * 7 + [(i, [9, 9]) for i in range(1, 9)] + [(2, [9, 9])] * 2 + [(50, [i % 8 + 1, i // 8 + 1]) for i in range(40)] + [(50, [3, 4]), (51, [3, 4]), (51, [3, 4])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    want = {}
    for q in (0, 50):
        a = min(v for i, v in rows if i == q)
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in rows if i != q)[:5]
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    for shard_rows in (1_000, 10):
        got = collections.defaultdict(list)
        for r in topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        assert dict(got) == want


def test_top_k_of_huge_components_is_exact(spark):
    """Products beyond 2**52, beyond a long, and near the largest float."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3) * 10.0 ** float(rng.choice([0, 7, 12, 30]))]) for i in range(120)] + [(150, [3e38, 1.0, 0.0]), (151, [-3e38, 3e38, 1.0]), (152, [3e7, 1.0, 2.0]), (153, [3e38, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {i: [math.floor(256 * int(x) if abs(x) >= 2**40 else 256 * x) for x in np.array(v, np.float32).astype(float).tolist()] for i, v in rows}
    for shard_rows in (16_384, 20):
        got = collections.defaultdict(list)
        for r in topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        for q in (0, 50, 100, 150):
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
            assert got[q] == [(k + 1, i, min(max(-s, 1 - 2**63), 2**63 - 1)) for k, (s, i) in enumerate(scored)]


def test_shards_out_of_reach_are_not_met(spark, monkeypatch):
    """Vectors in far clusters: queries meet far fewer shards than there are, with the same result as in one shard."""
    rng = np.random.default_rng(3)
    x = np.concatenate([10 * np.eye(8)[c] + rng.normal(size=(100, 8)) * 0.1 for c in range(8)])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    met, plain = [], topk._search
    monkeypatch.setattr(topk, "_search", lambda v, q, k: (met.append(q.count()), plain(v, q, k))[1])
    one = topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0).collect()
    assert met == [16]
    met.clear()
    many = topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0, shard_rows=50).collect()
    assert sorted(many) == sorted(one) and sum(met) < 16 * 16 / 2


def test_fit_logistic_recovers_weights():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 1))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    assert labelled.fit_logistic(x, y) == pytest.approx([2, -1], abs=0.25)
