"""Hard negatives, prefix trie and benchmark decontamination against brute force on small, awkward tables."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paneltide.llm import decontaminate, hard_negatives, prefix_trie, queries


@pytest.fixture(autouse=True, scope="module")
def _workers(spark):
    queries.importable(spark)


# ---- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, score string, uid long, v string"  # the last three clash with inner names


def _vectors():
    rnd = random.Random(3)
    centre = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(900):
        c = centre[rnd.randrange(4)]
        rows.append((i, [x + rnd.gauss(0, 0.6) for x in c], rnd.randrange(10), "x", 1, "y"))
    same = rows[200][1]
    rows += [(1000 + i, same, i % 3, "x", 1, "y") for i in range(60)]  # ties
    rows += [rows[5]] * 40 + [rows[100]] * 2  # repeated rows, one an anchor
    rows += [(None, rows[9][1], 3, None, None, None), (2000, None, 1, None, None, None), (2001, rows[3][1], None, None, None, None), (2002, [1.0, None] + [0.0] * 4, 1, None, None, None),
             (2100, [float("nan")] * 6, 1, None, None, None), (2200, [float("inf")] + [0.0] * 5, 1, None, None, None), (2300, [0.0] * 6, 4, None, None, None), (2400, [1.0, 2.0], 5, None, None, None),
             (2500, [], 2, None, None, None)]
    return rows


def _mined(rows, every=100):
    live = []
    for vec_id, x, label, *_ in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        live.append((vec_id, label, [math.floor(256 * float(v)) for v in x]))
    import numpy as np
    width = max(len(v) for *_, v in live)
    m = np.array([v + [0] * (width - len(v)) for *_, v in live], np.int64)
    out = Counter()
    for a, (anchor, label, _) in enumerate(live):
        if anchor is None or anchor % every:
            continue
        s = m @ m[a]
        rank = sorted((b for b in range(len(live)) if b != a), key=lambda b: (-s[b], live[b][0] is None, live[b][0] or 0))
        for p in [b for b in rank if live[b][1] == label][:5]:
            found = [b for b in rank if live[b][1] != label and 80 * s[p] <= 100 * s[b] <= 100 * s[p]][:5]
            for k, b in enumerate(found):
                out[(anchor, live[p][0], k + 1, live[b][0], int(s[p]), int(s[b]))] += 1
    return out


def test_hard_negatives(spark):
    rows = _vectors()
    as_float = lambda r: (r[0], None if r[1] is None else [None if v is None else float(__import__("numpy").float32(v)) for v in r[1]], *r[2:])
    want = _mined([as_float(r) for r in rows])
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(table)
    assert Counter(tuple(r) for r in got.collect()) == want and len(want) > 100
    # many slices, blocks and clusters give the same rows
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    live = hard_negatives.integer_vectors(table.select("vec_id", "embedding", moved.alias("label")))
    again = hard_negatives.mine(live, live.where(F.col("vec_id") % 10 == 0), slice_rows=150, block=30)
    assert Counter(tuple(r) for r in again.collect()) == _mined([as_float(r) for r in rows], 10)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0


def test_walks_stop_early():
    """On a tight cluster a walk reads a small part of its list, and finds what a whole scan finds."""
    import numpy as np

    rnd = np.random.default_rng(1)
    x = rnd.integers(-200, 200, (20_000, 8))
    members = (np.array([150, 90, -60, 20, 10, 0, 40, -90]) + rnd.integers(-3, 4, (20, 8))).astype(np.int64)
    label, vec_id = np.arange(20_000) % 5, np.arange(20_000)
    walk = hard_negatives._Walk(x, label, vec_id, vec_id, *hard_negatives._unit(x))
    walk.order(hard_negatives._unit(members.mean(0)[None, :])[0][0], members)
    reads = []
    real = walk.list
    class Seen(np.ndarray):
        def __getitem__(self, k):
            reads.append(k.stop)
            return np.asarray(real)[k]
    walk.list = real.view(Seen)
    of = np.arange(20)
    q, at, score = walk.best(members, of, np.zeros(20, int), np.full(20, -1), True, np.full(20, -10**9), np.full(20, 10**9), 5)
    assert max(reads) < 10_000
    for k in range(20):
        s = np.where(label == 0, x @ members[k], -10**9)
        best = np.lexsort((vec_id, -s))[:5]
        assert at[q == k].tolist() == best.tolist() and score[q == k].tolist() == s[best].tolist()


# ---- prefix trie

TALK = "conv_id long, turn long, role string, text string, depth int, path string"


def _talks():
    rnd = random.Random(8)
    lines = ["hello  there", "how are you", "", "fine\tthanks a lot", "same as ever, same", "ünï cödé words"]
    rows = []
    for c in list(range(0, 130)) + [9999, -5, -40]:
        for t in range(rnd.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice([*lines, None]), 7, "x"))
    rows += [(c, t, "user", "copied line", 7, "x") for c in range(500, 700) for t in range(6)]  # copies
    rows += [(800, t, "user", f"turn {t}", 7, "x") for t in range(300)]  # a long one
    rows += [rows[0], rows[1], (3, None, "user", "no number", 7, "x"), (3, None, None, None, None, None), (None, 0, "user", "no conversation", 7, "x")]
    return rows


def _trie(rows):
    talks = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            key = hashlib.sha256((f"{len(role or '')}:" + (role or "") + (text or "")).encode()).hexdigest()[:32]
            talks.setdefault(c, []).append((turn is not None, turn or 0, key, role or "", text or ""))
    talks = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in talks.items()}
    whole = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        whole[c] = tuple(talks.get(base, [])[:h] + talks[c][h:])
    nodes = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = Counter()
    for seq, members in nodes.items():
        below = [s for s in nodes if s[:len(seq)] == seq]
        leaves = sum(not any(len(x) == len(s) + 1 and x[:len(s)] == s for x in below) for s in below)
        saved = sum((len(nodes[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) for s in below if s)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(whole[c]) == len(seq)))
        out[(min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), sum(len(x) == len(seq) + 1 for x in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("shard_turns", [100_000, 150, 20])
def test_prefix_trie(spark, shard_turns):
    rows = _talks()
    want = _trie(rows)
    table = spark.createDataFrame(rows, TALK).repartition(4)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(table), shard_turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([], TALK))).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "a b", 1, "x")], TALK)  # crc32("1") % 4 is 3: its own turn goes, its base is absent
    assert [tuple(r)[:7] for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(one)).collect()] == [(1, 0, None, 1, 0, 1, 0)]


def test_skeleton_numbers_every_shared_prefix_once():
    rnd = random.Random(4)
    turn = [hashlib.md5(bytes([k])).digest() for k in range(3)]
    paths = sorted({(b"".join(rnd.choice(turn) for _ in range(rnd.randrange(6))), k) for k in range(200)})
    trie = prefix_trie.Skeleton(paths[20::30])
    known = {}
    for path, conv in paths:
        shared = trie.nodes(trie.shard(path, conv), path)
        for d, j in enumerate(shared):
            assert known.setdefault((j, d), path[:16 * d]) == path[:16 * d]
            assert known.setdefault(path[:16 * d], j) == j
        deeper = path[:16 * len(shared)]
        if len(shared) <= len(path) // 16:  # a node that is not in the skeleton lies in one shard
            assert len({trie.shard(p, c) for p, c in paths if p.startswith(deeper)}) == 1


# ---- benchmark decontamination

DOCS = "doc_id long, text string, lang string, hits int, items string, own string"


def _bench():
    rnd = random.Random(6)
    vocabulary = ["alpha", "beta", "7", "gämma", "delta", "eps", "zeta9", "日本"]
    word = lambda: rnd.choice(vocabulary)
    item = lambda n: " ".join(word() for _ in range(n))
    items = [(k, item(rnd.choice([3, 9, 10, 14, 40]))) for k in range(12)] + [(2, item(12)), (None, item(11)), (30, None), (31, "?!"), (32, "Unique-Words,of ONE  item"), (33, "same " * 30), (33, "same " * 30)]
    docs = []
    for k in range(60):
        text = item(rnd.randrange(0, 80))
        if k % 3 == 0:
            passage = (rnd.choice(items)[1] or "").upper().replace(" ", rnd.choice([" ", ", ", "\n--", "_"]))
            text += rnd.choice([" ", "é", ". "]) + passage + rnd.choice(["", "!", " end"])
        docs.append((k, text, "en", 1, "x", "y"))
    docs += [(100, None, None, None, None, None), (101, "", "en", 1, "x", "y"), (None, items[4][1], "en", 1, "x", "y"), (102, "same same " * 200, "en", 1, "x", "y"), docs[3], docs[3],
             (103, "filler words that nobody knows " * 9000 + items[9][1] + " more filler" * 300_000 + " " + items[10][1], "en", 1, "x", "y")]
    return docs, items


def _leaks(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + window]), set()).add(i)
    sizes = {len(x) for x in wins}
    out = Counter()
    for i, t, *_ in docs:
        w, hit, ids = cut(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = wins.get(tuple(w[k:k + n]))
                if found:
                    hit.update(range(k, k + n))
                    ids |= found
        names = sorted(str(x) for x in ids if x is not None)
        out[(i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 700])
def test_decontamination(spark, block_words, monkeypatch):
    docs, items = _bench()
    want = _leaks(docs, items)
    table, bench = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate.contamination, "__defaults__", (10, block_words))
    got = decontaminate.report(table, bench).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    text = {d[0]: d[1] for d in docs}
    for r in got:
        for h in r["hits"]:  # offsets lead back to the original
            words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text[r["doc_id"]][h["start"]:h["end"]])
            assert len(words) == h["last"] - h["first"] + 1
    kept = decontaminate.clean(table, bench)
    assert kept.columns == table.columns and kept.count() == sum(n for k, n in want.items() if not k[5])


def test_decontamination_of_nothing(spark):
    docs, items = _bench()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.report(spark.createDataFrame([], DOCS), bench).count() == 0
    none = decontaminate.report(spark.createDataFrame(docs[:9], DOCS), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == 9 and not any(r["contaminated"] for r in none)


def test_pieces_carry_a_match(monkeypatch):
    """A match that lies across two pieces of a text is found, whatever the piece size."""
    rows = [("a b c d", "1"), ("d e", "2"), ("q", "3")]
    search = decontaminate._Automaton(rows)
    data = b"x y a b c d e z z z a b q c d d e a b c d"
    whole = search.find(data)
    assert whole == (21, [(2, 6), (12, 12), (15, 20)], {"1", "2", "3"})
    for size in range(1, 12):
        monkeypatch.setattr(decontaminate, "PIECE", size)
        assert search.find(data) == whole
