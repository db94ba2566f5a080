import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quern.llm import repeats
from quern.llm import words as W
from quern.llm.suffix_sort import Suffixes


def brute(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(r[k : k + 200] for _, r in raws for k in range(len(r) - 199))
    out = {}
    for i, r in raws:
        gone = bytearray(len(r) + 1)
        for k in range(len(r) - 199):
            if count[r[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        starts = sum(1 for k in range(len(r)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(r), sum(gone[: len(r)]), starts, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    random.seed(4)
    words = ["".join(random.choice("abcdefgé") for _ in range(random.randint(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    base = [text(200) for _ in range(5)]
    rows = []
    for i in range(80):
        kind = random.random()
        if kind < 0.3:
            t = random.choice(base)
        elif kind < 0.7:
            w = random.choice(base).split(" ")
            for _ in range(random.randint(1, 6)):
                w[random.randrange(len(w))] = random.choice(words)
            a = random.randrange(60)
            t = " ".join(w[a : a + random.randint(20, 150)])
        elif kind < 0.85:
            t = random.choice(["", "a" * 500, "ab" * 300, None, "x" * 199, "y" * 200])
        else:
            t = text(random.randint(1, 100)) + random.choice(base)[100 : random.randint(250, 420)] + text(30)
        rows.append((i, t))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_bytes string").repartition(3)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(repeats, "SORTED", 10)
    assert run(spark, rows) == want


def test_small_tables(spark):
    assert run(spark, [(1, None)]) == brute([(1, None)])
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_sort():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    place = rng.permutation(380)[:120]
    for backward in (False, True):
        reach = np.minimum(place if backward else 400 - place, 30)
        first = np.array([0, 1, 1, 50, 120])
        order, shared = Suffixes(data, place, reach, backward).sort(first)
        key = lambda i: bytes(data[place[i] - reach[i] : place[i]][::-1]) if backward else bytes(data[place[i] : place[i] + reach[i]])  # noqa: B023, E731
        for a, b in zip(first, first[1:], strict=False):
            part = order[a:b].tolist()
            assert [key(i) for i in part] == sorted(key(i) for i in range(a, b))
            for x, y, n in zip(part, part[1:], shared[a + 1 : b].tolist(), strict=False):
                p, q = key(x), key(y)
                assert n == next((k for k in range(min(len(p), len(q))) if p[k] != q[k]), min(len(p), len(q)))


def test_forced_hash_collisions(monkeypatch):
    """With a polynomial hash that can't tell letters apart nothing is found that the bytes don't have."""
    monkeypatch.setattr(W, "BYTE", np.full(256, W.BYTE[0]))
    random.seed(6)
    lead = "".join(random.choice("ab") for _ in range(100))
    texts = [lead + x * 200 for x in "abbcab"] + [lead[:-1] + "c" + "a" * 200]
    block = next(W.blocks(pa.array(texts)))
    _, text, gram, around = repeats.anchors(block)
    assert len(set(gram.tolist())) == 1
    kinds = {i: {tuple(x) for x in around[text == i].tolist()} for i in range(7)}
    assert kinds[0] == kinds[4] and kinds[1] == kinds[2] == kinds[5] and not kinds[0] & kinds[1] and not kinds[0] & kinds[6]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds, reach = np.arange(8) * 300, np.full(7, 100)
    most, least = repeats.repeated_windows(data, bounds, reach, np.array([0, 7]))
    want = []
    for t in texts:
        own = [b for b in range(101) if sum(u[100 - b : 300 - b] == t[100 - b : 300 - b] for u in texts) > 1]
        want.append((max(own, default=-1), min(own, default=101)))
    assert [*zip(most.tolist(), least.tolist(), strict=True)] == want


def test_rows_that_repeat_and_names(spark):
    df = spark.createDataFrame([(1, "w" * 300, 5, 6), (1, "w" * 300, 5, 6), (None, "q" * 250, 1, 1)], "doc_id long, text string, rid int, spans int")
    got = sorted((tuple(r) for r in repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed").collect()), key=str)
    assert got == [(1, 300, 300), (1, 300, 300), (None, 250, 250)]
