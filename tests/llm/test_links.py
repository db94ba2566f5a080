import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import edits, line_dedup, linking


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_of_many_pairs(monkeypatch):
    monkeypatch.setattr(edits, "LEAST", 1)
    random.seed(4)
    sizes = [1, 2, 31, 63, 64, 65, 127, 128, 129, 150, 200, 520, 0]
    a = ["".join(random.choice("ab é語") for _ in range(n)) for n in sizes for _ in range(4)]
    b = ["".join(random.choice("ab é語") for _ in range(random.randint(0, len(x) + 9))) for x in a]
    b[8:12] = [x[:10] + "q" + x[12:] for x in a[8:12]]
    want = [-1 if not x or not y or len(x) > 512 else table_distance(x, y) for x, y in zip(a, b)]
    assert edits.distances(a, b).tolist() == want
    monkeypatch.setattr(edits, "TABLE_BYTES", 20_000)
    assert all(d in (-1, w) for d, w in zip(edits.distances(a, b).tolist(), want))
    assert edits.distances([], []).tolist() == []


def test_pairs_alike_together():
    random.seed(5)
    a = ["".join(random.choice("abcd ") for _ in range(random.choice([20, 70, 400]))) for _ in range(600)]
    b = [x[: len(x) // 2] + "".join(random.choice("xyz") for _ in range(random.randint(0, len(x) // 3))) + x[len(x) // 2 :] for x in a]
    assert line_dedup.all_alike(a, b) == [line_dedup.alike(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("part, few", [(1000, 100), (3, 100), (3, 0)])
def test_spread_join(spark, monkeypatch, part, few):
    monkeypatch.setattr(linking, "FEW", few)
    pairs = [(k % 4, 10 + k) for k in range(40)] + [(5, 6)]
    left = spark.createDataFrame(pairs, "a long, b long")
    right = spark.createDataFrame([(k, f"t{k}") for k in range(9)], "a long, x string")
    got = sorted((r.a, r.b, r.x) for r in linking.spread_join(left, right, "a", left, part).collect())
    assert got == sorted((a, b, f"t{a}") for a, b in pairs)


def test_cells_connect_together(monkeypatch):
    """Cells of one batch are compared together, not cell by cell, and connect what is alike in each."""
    random.seed(6)
    rows, want = [], set()
    for cell in range(300):
        base = "".join(random.choice("abcdefgh ") for _ in range(40)).strip() + "z"
        kinds = [base, base[:20] + "q" + base[21:], base[::-1] + "yyyy", base[:9] + "w" + base[10:]]
        ids = [10 * cell + k for k in range(4)]
        rows += [(cell, 0, 0, 0, i, i, len(t), 0, 0, t) for i, t in zip(ids, kinds)]
        want.add((ids[0], ids[1], ids[3]))
    names = ["key", "_low", "_high", "_part", "c", "id", "n", "bits0", "bits1", "norm"]
    table = pa.table({k: [r[i] for r in rows] for i, k in enumerate(names)})
    calls = []
    each = line_dedup.alike_pairs
    monkeypatch.setattr(line_dedup, "alike_pairs", lambda *a: calls.append(1) or each(*a))
    links = line_dedup._linked(table, np.arange(0, len(rows), 4)).to_pylist()
    groups = {}
    for r in links:
        groups.setdefault(r["a"] // 10, set()).update((r["a"], r["b"]))
    assert {tuple(sorted(g)) for g in groups.values()} == want and len(links) == 600 and len(calls) < 10


@pytest.mark.parametrize("least", [1, 30])
def test_distances_within_limits(monkeypatch, least):
    """Banded and cut short, with the same answers as the whole table of distances."""
    monkeypatch.setattr(edits, "FEW", least)
    random.seed(7)
    a = ["".join(random.choice("abcd é語") for _ in range(random.choice([1, 30, 64, 65, 200, 330, 700]))) for _ in range(250)]
    b = []
    for x in a:
        y = list(x)
        for _ in range(random.randint(0, 2 + len(x) // 4)):
            k = random.randrange(len(y) + 1)
            y[k : k + random.randint(0, 2)] = random.choice(["", "q", "zz"])
        b.append("".join(y))
    b[:20] = [x[::-1] + "ab" for x in a[:20]]
    limit = np.array([max(len(x), len(y)) // 5 for x, y in zip(a, b)])
    want = [int(line_dedup.distance(x, y) <= n) for x, y, n in zip(a, b, limit)]
    got = edits.within(a, b, limit).tolist()
    assert 50 < sum(want) < 200 and all(g in (-1, w) for g, w in zip(got, want))
    if least == 1:
        assert sum(g < 0 for g in got) < 30 and any(g >= 0 and len(x) > 512 for g, x in zip(got, a))


def test_buckets_of_lines_that_share_many_keys(spark):
    """Lines alike share most of their keys; they are few rows of buckets, not one for each key."""
    random.seed(9)
    head = ["".join(random.choice("abcdefghi") for _ in range(7)) for _ in range(40)]
    texts = [(k, 0, k, " ".join([*head, f"{chr(97 + k)}tail"])) for k in range(20)]
    rows = line_dedup.line_rows(spark.createDataFrame(texts, "doc long, _file long, _row long, text string"))
    pairs = line_dedup.keyed_lines(rows).collect()
    assert {r.id for r in pairs} == {r.id & -(1 << 24) for r in rows.select("id").collect()}
    assert len(pairs) == len(set(pairs)) <= 3 * 20
