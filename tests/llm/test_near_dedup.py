import random
import re

from quern.llm import near_dedup
from quern.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, similarity):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus():
    random.seed(5)
    words = [f"w{k}" for k in range(500)]
    bases = [[random.choice(words) for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(140):
        w = list(random.choice(bases))
        for _ in range(random.randint(0, 9)):
            w[random.randrange(len(w))] = random.choice(words)
        rows.append((i, " ".join(w) if i % 3 else "  ".join(w).upper()))
    return rows + [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "ONE "), (205, "one two"), (206, "é É"), (207, "x " * 30_000)]


def run(spark, rows, k, similarity):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(df, k, similarity).collect()}


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_empty_tables_and_missing_ids(spark):
    assert run(spark, [(1, "a")], 3, 85) == {1: (1, 1, True)}
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (3, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.groups(df).collect()), key=str)
    assert got == [(0, None, True), (0, None, True), (3, 3, True), (3, 3, True), (7, 3, False)]
    assert near_dedup.groups(df.limit(0)).count() == 0


def test_components(spark):
    random.seed(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(random.sample(edges, len(edges)), "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {299: 299, 300: 299}
