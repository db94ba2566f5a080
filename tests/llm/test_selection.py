import random
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, packing, topk, url_filter
from quern.llm.queries import byte_bpe


def levels(sizes, weights=(5.0, 2.0, 1.0)):
    """Targets by sharing again and again what exceeds twice a source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    full, left = set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else share[s] for s in order}
        full |= set(over)
        left -= sum(2 * sizes[s] for s in over)


def test_mix(spark):
    random.seed(1)
    rows = [(i, random.choice(["a", "b", "ä", None, "c"]), " ".join("x" * random.choice([0, 1, 5, 60, 900]))) for i in range(3000)] + [(None, "a", None), (5, "b", "x"), (5, "b", "x")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, source string, text string, target double")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert target == pytest.approx(levels(sizes))
    assert all(abs(taken[s] - target[s]) <= 2 * 900 for s in sizes)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.filter("text is null")).first().taken == 0


def test_mix_of_rows_that_share_ids(spark):
    """Rows of one id, size and source, and columns of any name: the same rows are taken, however dealt."""
    random.seed(2)
    rows = [(i % 40 if i % 3 else None, random.choice("ab"), f"{random.choice('xyz')} {i % 7}", i % 5, f"h{i % 3}", [i % 2]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, _bucket int, hash string, _row array<int>")
    got = [sorted(map(str, mixing.mix(df.repartition(n)).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    kept = sorted(str((r.doc_id, r.source, r.text, r._bucket, r.hash, r._row)) for r in mixing.mix(df).collect())
    assert kept == sorted(map(str, rows))
    same = spark.createDataFrame([(None, "a", "x y")] * 5000 + [(1, "b", "z")] * 3, "doc_id long, source string, text string")
    taken = mixing.mix(same).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 4 for r in taken)


def odd_texts():
    random.seed(2)
    parts = ["word", " ", "  ", "\n", "\n\n", " \n", "é", "can't", "12", ".", "\t", " ", "<|endoftext|>", "日本", "‍", "x" * 90, "'s", "\r\n"]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(300)] + ["", "a " * 9000, "\x1c a", None]


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(byte_bpe()), packing.Encoder(byte_bpe())
    for t in odd_texts():
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(want)}I", encode(t))) == want, repr(t)


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe())
    rows = [*enumerate(odd_texts() * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = packing.pack(df, byte_bpe()).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for places, total in [(pieces[i], len(x)) for i, x in ids.items()] + [(x, None) for x in sequences.values()]:
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 2048
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in (sum(x for _, x in s) for s in sequences.values()))
    assert padded < 0.01 * sum(map(len, ids.values()))
    assert packing.pack(df.limit(0), byte_bpe()).count() == 0


def test_topk(spark):
    random.seed(4)
    rows = [(i, [random.choice([-3, 0, 1, 7, 100, -250]) for _ in range(8)]) for i in range(700)] + [(900, None), (None, [1] * 8), (50, [9] * 8), (950, [1, 2, 3])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    asked = df.filter("vec_id % 70 = 0 and vec_id <> 50")
    got = defaultdict(list)
    for r in topk.search(df, asked, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    usable = [(i, v) for i, v in rows if i is not None and v]
    for i, v in usable:
        if i % 70 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in usable if j != i and len(w) == len(v))[:5]
            assert got[i] == [(j, -s) for s, j in best]
    assert topk.search(df.limit(0), asked).count() == 0
    few = topk.search(df.filter("vec_id < 3"), df.filter("vec_id = 0"), 5)
    assert few.count() == 2


def test_topk_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    random.seed(5)
    rows = [(i, [random.randint(-90, 90) for _ in range(6)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.search(df, df.filter("vec_id % 4 = 0"), 5).collect())
    want = []
    for i, v in rows[::4]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_usable_and_quantised(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan")]), (3, [float("inf"), 1.0]), (4, None), (5, [None, 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "k int, e array<float>")
    got = {r.k: r.v for r in df.filter(topk.usable(F.col("e"))).select("k", topk.quantised(F.col("e")).alias("v")).collect()}
    assert got == {1: [128, -1], 6: []}


def test_urls(spark):
    urls = ["http://WWW.Bad.com/x/?utm_a=1#f", "https://bad.com/x", "http://bad.com/x?b=2", "http://example.net/en/a", "http://a.example.net/de/a", "http://example.net", "x.org/fr/", "http://a.org/fr/q", "http://notexample.com/de/", "http://example.com/de/1", None, "", "http://", "http://a.net\n/x", "http://É.net/"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://bad.com/x",), (None,), ("nothing",), ("http://bad.com/x/",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.verdicts(df, listed).collect()}
    assert got[0] == ("www.bad.com", "/x/", None, "block") and got[1][3] == "block" and got[2][3] == "allow"
    assert got[3] == ("example.net", "/en/a", "example.net/en/", "allow") and got[4][2:] == ("net/", "block")
    assert got[5] == ("example.net", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("org/fr/", "allow") and got[8][2] is None and got[9][2:] == ("example.com/de/", "block")
    assert got[10] == got[11] == ("", "", None, "allow") and got[12] == ("", "", None, "allow")
    assert got[13] == ("a.net\n", "/x", None, "allow") and got[14] == ("É.net", "/", "net/", "block")
    assert url_filter.verdicts(df.limit(0), listed).count() == 0
    odd = df.selectExpr("page_id", "url", "1 as _block", "'k' as key", "true as _possible", "2 as row", "'x' as rule")
    assert [(r._block, r.key, r._possible, r.row) for r in url_filter.verdicts(odd, listed).collect()] == [(1, "k", True, 2)] * len(urls)
    assert {r.verdict for r in url_filter.verdicts(df, listed.limit(0)).filter("rule is null").collect()} == {"allow"}
