import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import language, line_dedup, quality, secret_scan
from quern.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines, dup, worded = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            worded += 1
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), worded


def texts():
    random.seed(9)
    parts = ["a", "bb", "é", "ü|", "#", "\n", "\n\n", " ", "\t", "x y z u v ", "\x0b", " "]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 80))) for _ in range(400)] + ["", None, "a " * 40_000, "\n" * 9]


def test_features_against_brute_force(spark):
    rows = [*enumerate(texts())]
    df = spark.createDataFrame([(i, t, None, "x") for i, t in rows], "doc_id long, text string, lang string, n_words string")
    got = {r.doc_id: tuple(r)[2:] for r in quality.features(df).collect()}
    assert got == {i: features(t) for i, t in rows}


def test_blocks_are_whole_texts():
    got = [(b.first, b.n) for b in W.blocks(pa.array(["abc"] * 5 + [None, "x" * 50]), 6)]
    assert [n for _, n in got] == [2, 2, 2, 1] or sum(n for _, n in got) == 7
    assert [*W.blocks(pa.array([], pa.string()))] == []


def test_exact_bounds():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert quality.upper_bound(5, 5, 0.05) == 1.0
    p = quality.upper_bound(3, 50, 0.01)
    rng = np.random.default_rng(1)
    assert abs((rng.binomial(50, p, 200_000) <= 3).mean() - 0.01) < 0.002


def test_cutoffs_keep_the_good(spark):
    good = [(i, "some plain words of a text that is long enough to count here", "en") for i in range(3000)]
    bad = [(5000 + i, "#### $$$$ %%%% |||| #### one $$$$ two %%%% three four five", "en") for i in range(50)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad] + [(None, 1), (99_999, 1)], "doc_id long, quality int")
    rows = quality.judge(df, labels).collect()
    assert all(r.kept for r in rows if r.doc_id < 5000) and not any(r.kept for r in rows if r.doc_id >= 5000)
    assert all(r.kept for r in quality.judge(df, labels.limit(0)).collect())
    assert quality.judge(df.limit(0), labels).count() == 0


def test_levels_against_brute_force(spark):
    """Levels by the definition, with binomial tails summed as fractions."""
    from fractions import Fraction
    from math import comb

    random.seed(7)
    rows, labels = [], []
    for i in range(1500):
        lang = ("en", "de", None, "fr")[i % 4]
        text = " ".join(random.choice(["plain", "words", "of", "text", "so", "on"]) + str(k) for k in range(30)) + " #" * random.choice([0, 0, 0, 0, 1, 2, 9] if lang == "en" else [0] * 30 + [40])
        rows.append((i, text, lang))
        labels += [(i, int(i % 5 > 0))] + [(i, 0)] * (i % 50 == 1)
    rows += [(5000, "x " * 40, "it"), (5000, "x " * 40, "it"), (None, "y " * 40, "it")]
    made = quality.features(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = quality.cutoffs(made, spark.createDataFrame(labels, "doc_id long, quality int"))
    good = {i for i, q in labels if q} - {i for i, q in labels if not q}
    want = {}
    strata = {}
    for i, t, lang in rows:
        n, chars, symbols, dups, repeats, lines = features(t)
        if i in good and n >= 10 and 100 * repeats <= 20 * n:
            values = {"symbols_per_word": symbols * 1000 // n, "dup_line_share": dups * 1000 // lines, "repeat_share": repeats * 1000 // n, "word_length": chars * 1000 // n}
            strata.setdefault(lang, []).append(values)
    for lang, docs in strata.items():
        for level in range(quality.LEVELS):
            x = sum(any(v > quality.cutoff(rule, level) for rule, v in d.items()) for d in docs)
            p = Fraction(2, 100)
            tail = sum(comb(len(docs), k) * p**k * (1 - p) ** (len(docs) - k) for k in range(x + 1))
            if x * 50 > len(docs) or tail > Fraction(5, 100) / len(strata):
                break
            want[lang] = level
    assert got == want and len(want) >= 2
    assert quality.MIN_LABELS <= min(map(len, strata.values()))


def test_marks_belong_to_words():
    assert language.words("हिन्दी में ไทยที่ naïve nai\u0308ve 12x") == ["हिन्दी", "में", "ไทยที่", "naïve", "nai\u0308ve", "x"]


def test_language_of_repeated_rows_and_names(spark):
    rows = [(k, text, lang, "s", 1.0) for k in range(40) for text, lang in (("the house and the tree", "en"), ("das haus und der baum", "de"))]
    df = spark.createDataFrame(rows + rows, "doc_id long, text string, lang string, lang_pred string, n double")
    model = language.fit(df, max_words=3, max_grams=50)
    got = language.identify(df, model).collect()
    assert len(got) == len(rows) * 2 and all(r.lang_pred == r.lang for r in got)
    few = language.fit(df, max_rows=20)
    assert few.languages == ["de", "en"]


RULES = {r.kind: re.compile(r.pattern, re.A | (re.I if r.fold else 0)) for r in secret_scan.RULES}


def spans(text):
    out = []
    for k, rule in enumerate(secret_scan.RULES):
        pattern = re.compile("[0-9a-f]+") if rule.kind == "hex" else RULES[rule.kind]
        for m in pattern.finditer(text or ""):
            length = m.end() - m.start()
            if rule.tail:
                length = len(re.search("[A-Za-z0-9+/_.=-]+$", re.sub(r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?", "", m[0], count=1))[0])
            if length >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_scan_against_regular_expressions(spark):
    random.seed(3)
    parts = ["password", "passwd", "secret", "token", "api_key", "apikey", "ApiKey", '"', "'", " ", ":", "=", "==", "abc", "a.b", "AKIA", "0123456789ABCDEF", "deadbeef", "0123456789abcdef", "é", ",", "\n", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "A" * 20, "Secretoken", "ſ", "K"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 50)))) for i in range(2000)] + [(9000, None), (9001, ""), (9002, "token=abcdef " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(x.start, [k.kind for k in secret_scan.RULES].index(x.kind), x.end) for x in r.found] for r in secret_scan.scan(df, ("doc_id",)).collect()}
    assert got == {i: spans(t) for i, t in rows}
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_language(spark):
    words = {"en": ["the", "house", "and", "tree"], "de": ["das", "haus", "und", "baum"]}
    random.seed(1)
    rows = [(i, " ".join(random.choice(words[lang]) for _ in range(12)), lang) for i, lang in enumerate(["en", "de"] * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.filter(~language.held_out(df["doc_id"])))
    odd = [(1000, None, None), (1001, "12 34 !", "en"), (1002, "", None), (None, "Das Haus", None), (1003, "hausbaum", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df.unionByName(spark.createDataFrame(odd, df.schema)), model, ("doc_id",)).collect()}
    assert all(got[i][0] == lang and 0.5 < got[i][1] <= 1 for i, _, lang in rows)
    assert [got[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[None][0] == got[1003][0] == "de"
    empty = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, empty).collect()} == {"und"}


def normal(line):
    out = "".join(c.lower() if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else " " if ord(c) < 128 and not c.isalnum() else c for c in line)
    return " ".join(w for w in out.split(" ") if w)


def test_lines(spark):
    line = "The quick brown fox jumps over the lazy dog near the river bank at noon today and sleeps " * 3
    rows = [(1, f"{line}\nshort one\n{line.upper()}"), (2, f"{line.replace('quick', 'quicc')}\n\nshort one"), (3, None), (4, ""), (5, "a b c d e 1\nA, b c-d e 2\nother words than those before here"), (5, "a b c d e 7"), (None, "a b c d e 9")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_lines string")
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()), key=str)
    first = [g for g in got if g[0] == 1][0]
    assert first == (1, f"{line}\nshort one", 3, 1)
    assert (3, None, 0, 0) in got and (4, "", 1, 0) in got
    assert (5, "a b c d e 1\nother words than those before here", 3, 1) in got and (5, "", 1, 1) in got and (0, "", 1, 1) in got
    second = [g for g in got if g[0] == 2][0]
    assert second == (2, "", 3, 2)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_normal_forms_agree(col):
    cases = ["Ab-c 12é, Ü x", "  a  b\tc ", "x\x0by", "ÄB"]
    assert col(line_dedup.normalised, cases) == [normal(c) for c in cases]


ALPHABET = "abcdefghiklmnoprstu"


def line_of(n):
    return ["".join(random.choice(ALPHABET) for _ in range(random.choice([2, 3, 5, 6, 8, 9]))) for _ in range(n)]


def one_letter(words):
    k = random.randrange(len(words))
    i = random.randrange(len(words[k]))
    return [*words[:k], words[k][:i] + "xyzw"[i % 4] + words[k][i + 1 :], *words[k + 1 :]]


def one_word_less(words):
    k = random.randrange(len(words))
    return words[:k] + words[k + 1 :]


@pytest.mark.parametrize("change", [one_letter, one_word_less, lambda w: one_letter(one_letter(one_letter(w)))])
def test_recall_by_length_of_line(spark, change):
    """Of pairs at edit similarity 0.8 or more, found by brute force, at least 0.9 are linked in each class."""
    random.seed(12)
    rows, kind = [], {}
    for low, high in ((5, 9), (10, 19), (20, 39), (40, 90)):
        if low < 20 and change.__name__ == "<lambda>":
            continue
        for _ in range(90):
            words = line_of(random.randint(low, high))
            line, other = " ".join(words), " ".join(change(words))
            if 5 * line_dedup.distance(line, other) <= max(len(line), len(other)):
                kind[len(rows) + 1] = low
                rows += [(len(rows), line), (len(rows) + 1, other)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(n for i, n in got.items() if i not in kind)
    for low in set(kind.values()):
        of = [got[i] for i, k in kind.items() if k == low]
        assert sum(of) >= 0.9 * len(of), (low, sum(of), len(of))


def test_alignments_bound_the_distance():
    random.seed(3)
    for _ in range(400):
        a = " ".join(line_of(random.randint(1, 25)))
        b = a
        for _ in range(random.randint(0, 6)):
            k = random.randrange(len(b) + 1)
            b = b[:k] + random.choice(["", " ", "q", "qq zz", "abc"]) + b[k + random.randint(0, 4) :]
        d = line_dedup.distance(a, b)
        assert not line_dedup.at_most(a.split(" "), b.split(" "), d - 1)
        assert line_dedup.alike(a, b) == (5 * d <= max(len(a), len(b)))
        assert line_dedup.distance(b, a) == d
    assert line_dedup.distance("kitten", "sitting") == 3


def test_simhash_counts():
    rng = np.random.default_rng(0)
    for longest in (9, 300, 40_000):
        size = rng.integers(1, longest, 40)
        h, first = W.stream(5, int(size.sum())), np.cumsum(size) - size
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        want = np.packbits(2 * np.add.reduceat(bits, first, axis=0, dtype=np.uint32) > size[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
        assert (line_dedup.simhash(h, first) == want).all()


def test_lines_of_large_families(spark, monkeypatch):
    """Lines that share words but are not alike, in more parts than one: brute force over all pairs."""
    from quern.llm import linking

    monkeypatch.setattr(linking, "PART", 8)
    random.seed(8)
    head = line_of(14)
    rows = []
    for k in range(60):
        words = head + line_of(random.choice([2, 3, 4]))
        rows.append((k, " ".join(words)))
        rows.append((1000 + k, " ".join(one_letter(words))))
    root = {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in rows:
        for j, b in rows:
            if i < j and 5 * line_dedup.distance(a, b) <= max(len(a), len(b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sum(n == (find(i) != i) for i, n in got.items()) >= 0.97 * len(rows)


def test_columns_of_lines_pass_through(spark):
    rows = [(1, "the same long line of words here", "a", 1, 2, [1.0], 0), (1, "the same long line of words here", "a", 1, 2, [1.0], 0), (None, "a b", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _file long, _row long, row array<double>, _possible int")
    got = sorted((tuple(r) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert [g[1] for g in got] == ["", "the same long line of words here", "a b"] and got[0][2:7] == ("a", 1, 2, [1.0], 0)
    long = line_of(20_000)
    texts = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(one_word_less(long)))], "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.dedup_lines(texts).orderBy("doc_id").collect()] == [0, 1]


def test_lines_of_few_words(spark):
    rows = [(1, "重复的句子没有空格也应该去掉\nAll rights reserved."), (2, "重复的句子没有空格也应该去掉\nall rights reserved"), (3, "重复的句子没有空格也应该去除\nall rights reversed"), (4, "另一个完全不同的句子在这里出现")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("", 2) and got[4] == (rows[3][1], 0)
    assert got[3] == ("all rights reversed", 1)


def test_lines_of_light_words(spark):
    """Lines that differ by one word, of words too light for keys of their own: all pairs that brute
    force finds alike, by bits and edit similarity, are linked."""
    random.seed(21)
    rows = []
    for k in range(240):
        n = 2 + k % 26
        words = ["".join(random.choice(ALPHABET) for _ in range(random.choice([1, 2, 2, 9 if n < 5 else 2]))) for _ in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(one_letter(words) if k % 3 else one_word_less(words)))]
    want = set()
    for (i, a), (j, b) in zip(rows[::2], rows[1::2]):
        lines = line_dedup.Lines(next(iter(W.blocks(pa.array([a, b])))))
        differ = sum(int(np.bitwise_count(x[0] ^ x[1])) for x in line_dedup.line_bits(lines, np.arange(2)))
        if differ <= line_dedup.BITS and 5 * line_dedup.distance(a, b) <= max(len(a), len(b)):
            want.add(j)
    got = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_removed > 0").collect()}
    assert len(want) > 100 and want <= got
