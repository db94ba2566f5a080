"""Language identification: words first, then shorter and shorter character n-grams.

A model has, by language, the log frequencies of its most frequent words and of the character
n-grams (n from 4 to 1, with word edges) of all its training words. A known word counts with its
word scores. An unseen one counts with the mean scores of its known 4-grams; if it has none, of
its 3-grams, and so on; if it has no known n-gram at all it counts for no language.

The model is fitted on at most about ``MAX_ROWS`` labelled rows, drawn by hash, an equal share of
each language (``max_rows``); of a language at most ``MAX_WORDS`` words and ``MAX_GRAMS`` n-grams of
each length are kept, the most frequent (``max_words``, ``max_grams``), so that its size does not
depend on the corpus: one row of numbers for each of them. Prediction reads whole texts.

Words are maximal runs of letters, with the marks on them, in lower case. Only the text is used to predict.

Defined cases: a null text, or one with no letter, is ``und`` with score 0; ties go to the
language first in order; without any training rows everything is ``und``; rows without an id
are predicted but never learnt from; equal rows get equal answers.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import words as W
from quern.session import attach, scope, table

MAX_ROWS = 20_000
MAX_WORDS = 20_000
MAX_GRAMS = 5_000
LONGEST = 4
#: Evidence of more words than this makes the score no surer.
SURE_WORDS = 12
REMEMBERED = 100_000
#: So many texts are scored at once.
TEXTS = 256
UNKNOWN = "und"


def _ranges(codes: Iterable[int]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for k in codes:
        if found and k == found[-1][1] + 1:
            found[-1] = (found[-1][0], k)
        else:
            found.append((k, k))
    return found


_WORD = re.compile(r"[^\W\d_]+")
#: Combining marks, which belong to the word they stand in: Devanagari, Thai and others write vowels so.
_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(k for k in range(0x300, 0x1F000) if unicodedata.category(chr(k)).startswith("M")))
_MARK = re.compile(f"[{_MARKS}]")
_MARKED_WORD = re.compile(rf"(?:[^\W\d_][{_MARKS}]*)+")


def words(text: str | None) -> list[str]:
    """Runs of letters with their marks; numerals that aren't letters separate as digits do."""
    if not text:
        return []
    low = text.lower()
    if low.isascii():
        return _WORD.findall(low)
    try:
        low.encode("latin-1")  # marks lie beyond; this looks faster than a search
        found = _WORD.findall(low)
    except UnicodeEncodeError:
        found = (_MARKED_WORD if _MARK.search(low) else _WORD).findall(low)
    return [w for w in found if w[0].isalpha() or any(c.isalpha() for c in w)]


def grams(word: str, n: int) -> list[str]:
    edged = f" {word} "
    return [edged[i : i + n] for i in range(len(edged) - n + 1) if n > 1 or edged[i] != " "]


class Model:
    """languages, and word and n-gram scores: one row of log frequencies for each."""

    def __init__(self, counts: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        """counts: (language, length or 0 for words, word or n-gram, number); totals by language and length."""
        self.languages = sorted({c[0] for c in counts})
        place = {x: k for k, x in enumerate(self.languages)}
        self.tables: dict[int, dict[str, int]] = {n: {} for n in range(LONGEST + 1)}
        seen: dict[tuple[int, str], dict[int, int]] = {}
        for lang, n, g, k in counts:
            seen.setdefault((n, g), {})[place[lang]] = k
        sizes = Counter(n for n, _ in seen)
        floor = {n: np.array([totals.get((x, n), 0) + 0.5 * sizes[n] + 0.5 for x in self.languages]) for n in self.tables}
        self.rows = np.empty((len(seen), len(self.languages)), np.float32)
        for at, ((n, g), by) in enumerate(seen.items()):
            row = np.full(len(self.languages), 0.5)
            row[list(by)] += list(by.values())
            self.rows[at] = np.log(row / floor[n])
            self.tables[n][g] = at

    def places(self, word: str) -> list[int]:
        """The rows whose mean scores a word: its own, or those of its longest known n-grams."""
        known = self.tables[0].get(word)
        if known is not None:
            return [known]
        for n in range(LONGEST, 0, -1):
            get = self.tables[n].get
            if found := [at for g in grams(word, n) if (at := get(g)) is not None]:
                return found
        return []


def means(rows: np.ndarray, at: list[int], sizes: np.ndarray) -> np.ndarray:
    """The means of runs of rows, which ``at`` numbers; 0 for empty runs."""
    out = np.zeros((len(sizes), rows.shape[1]))
    some = np.flatnonzero(sizes)
    if len(some):
        first = np.cumsum(sizes[some]) - sizes[some]
        out[some] = np.add.reduceat(rows[at].astype(np.float64), first, axis=0) / sizes[some][:, None]
    return out


class Scorer:
    """Scores texts; remembers the words it has scored as rows of a matrix, and forgets them all
    when there are too many."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(model.languages)), np.float32)

    def learn(self, new: list[str]) -> None:
        found = [self.model.places(w) for w in new]
        scored = means(self.model.rows, [x for f in found for x in f], np.array([len(f) for f in found]))
        start = len(self.known)
        if start + len(new) > len(self.rows):
            more = np.empty((max(4096, len(self.rows), len(new)), self.rows.shape[1]), np.float32)
            self.rows = np.concatenate([self.rows, more])
        self.rows[start : start + len(new)] = scored
        self.known.update(zip(new, range(start, start + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text."""
        if not self.model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found = [words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.rows = {}, self.rows[:0]
        self.learn([w for w in set().union(*found) if w not in self.known])
        sizes = np.array([len(f) for f in found], np.int64)
        get = self.known.__getitem__
        mean = means(self.rows, [k for f in found for k in map(get, f)], sizes)
        odds = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(sizes, SURE_WORDS)[:, None])
        best = mean.argmax(axis=1)
        score = np.where(sizes > 0, odds[np.arange(len(texts)), best] / odds.sum(axis=1), 0.0)
        return [self.model.languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), sizes.tolist(), strict=True)], score


def fit(rows: DataFrame, label: str = "lang", max_rows: int = MAX_ROWS, id_col: str = "doc_id", max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """A model of the rows' ``text`` and label, on at most about ``max_rows`` rows, as many of each
    language as there are or as its equal share allows. Rows with a null text, label or id are left
    out. ``max_words`` and ``max_grams``: of each language and length, those are kept that are more
    frequent than the cutoff at which that many would be left."""
    with scope(rows.sparkSession):
        return _fit(rows, label, max_rows, id_col, max_words, max_grams)


def _fit(rows: DataFrame, label: str, max_rows: int, id_col: str, max_words: int, max_grams: int) -> Model:
    spark = rows.sparkSession
    attach(spark)
    use = rows.filter(F.col(label).isNotNull() & F.col("text").isNotNull() & F.col(id_col).isNotNull())
    use = use.select(F.col(label).cast("string").alias("lang"), "text", F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 30)).alias("draw"))
    labelled = {r["lang"]: r["n"] for r in use.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if sum(labelled.values()) > max_rows:
        share = max_rows / len(labelled)
        below = spark.createDataFrame([(lang, min(1 << 30, int(share / n * (1 << 30)))) for lang, n in labelled.items()], "lang string, below long")
        use = use.join(F.broadcast(below), "lang").filter("draw < below")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(words(text))
            for lang, counts in by.items():
                out: Counter = Counter({(0, w): k for w, k in counts.items()})
                for w, k in counts.items():
                    for m in range(1, LONGEST + 1):
                        for g in grams(w, m):
                            out[m, g] += k
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array([m for m, _ in out], pa.int32()), pa.array([g for _, g in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["lang", "n", "gram", "k"])

    counts = use.select("lang", "text").mapInArrow(run, "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    counts = table(counts, "language-counts")
    totals = {(r["lang"], r["n"]): r["k"] for r in counts.groupBy("lang", "n").agg(F.sum("k").alias("k")).collect()}
    # How many have each frequency, from the highest down: one row for each frequency that occurs.
    down = counts.groupBy("lang", "n", "k").agg(F.count("*").alias("many"))
    down = down.withColumn("kept", F.sum("many").over(Window.partitionBy("lang", "n").orderBy(F.desc("k"))))
    most = F.when(F.col("n") == 0, F.lit(max_words)).otherwise(F.lit(max_grams))
    least = down.filter(F.col("kept") <= most).groupBy("lang", "n").agg(F.min("k").alias("least"))
    top = counts.join(F.broadcast(least), ["lang", "n"]).filter("k >= least")
    return Model([(r["lang"], r["n"], r["gram"], r["k"]) for r in top.select("lang", "n", "gram", "k").collect()], totals)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (all if not given) with lang_pred and score."""
    spark = docs.sparkSession
    attach(spark)
    kept = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    source = docs.select(*kept, F.col("text").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "lang_pred string", "score double"])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)  # with the task, not as a broadcast, which workers would hold on to
        for batch in batches:
            for first in range(0, len(batch), TEXTS):
                part = batch.slice(first, TEXTS)
                found, score = scorer.predict(part.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])
        del scorer
        W.release()

    return source.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id's digits is 2 modulo 4; false without an id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))
