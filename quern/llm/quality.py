"""Quality rules whose cutoffs are risk-controlled.

Every rule rejects a document whose feature exceeds a cutoff. Cutoffs come from labelled holdout
documents. ``LEVELS`` levels of strictness are fixed beforehand: at level 0 each rule has its mildest
cutoff, at the last its strictest, in equal steps. In each stratum the levels are tested from 0 on,
each by whether the exact (Clopper-Pearson) upper bound of the share of good documents that all its
rules together reject stays within ``risk``, until one fails; the last that passed is taken. Tests in
a fixed order need no correction for their number, as none is made after a failure; over the strata
the error, 1 - ``confidence``, is divided (Bonferroni). So in all strata at once the false rejections
stay within ``risk`` with probability ``confidence``. Where the labels do not suffice to prove level
0, the rules reject nothing in that stratum. Strata of under ``MIN_LABELS`` good documents can prove
nothing and are not tested, so that stray values of the stratum cost the others no power.

Features are computed in one pass over the bytes of each text. Repeated words are found by 64-bit
hashes of five-word windows within the text.

Defined cases: a null text has no words; a null stratum is one of its own; labels that are null,
or contradict each other, or belong to no document, are left out; equal rows are judged alike; an
empty table, or one without labels, leaves only the base rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.session import attach, scope, table

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
REPEAT = 5
RISK = 0.02
CONFIDENCE = 0.95
#: With fewer good documents even none rejected proves no bound of ``RISK``: 0.98 ** 148 > 0.05.
MIN_LABELS = 148
LEVELS = 20
#: Rules in thousandths, each with its mildest and its strictest cutoff.
RULES = {
    "symbols_per_word": ("n_symbols", "n_words", 1000, 50),
    "dup_line_share": ("n_dup_lines", "n_lines", 950, 100),
    "repeat_share": ("n_repeat_words", "n_words", 200, 50),
    "word_length": ("word_chars", "n_words", 20_000, 6000),
}
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _total(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[bounds[1:]] - c[bounds[:-1]]


def _earlier(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Marks of the entries that have an equal one earlier in the same text, in the given order."""
    marks = np.zeros(len(key), bool)
    if len(key) > 1:
        order = np.lexsort((key, text))
        same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
        marks[order[1:][same]] = True
    return marks


def block_features(b: W.Block) -> dict[str, np.ndarray]:
    starts, ends, first = b.words()
    c = W.prefix_hashes(b.data)
    hashes = W.mix64(W.span_hashes(c, starts, ends))
    n = np.diff(first)
    text = np.repeat(np.arange(b.n), n)
    letters = ((b.data & 0xC0) != 0x80) & ~W.SPACE[b.data]

    line_start, line_end, line_first = b.lines()
    line_text = np.repeat(np.arange(b.n), np.diff(line_first))
    worded = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    line_hash = W.mix64(W.span_hashes(c, line_start, line_end) + (line_end - line_start).astype(np.uint64))
    dup = np.zeros(len(line_start), bool)
    dup[worded] = _earlier(line_hash[worded], line_text[worded])

    covered = np.zeros(len(hashes), bool)
    whole = n >= REPEAT
    if whole.any():
        grams, gram_first = W.shingle_hashes(hashes, first, REPEAT)
        gram_text = np.repeat(np.arange(b.n), np.diff(gram_first))
        at = first[gram_text] + np.arange(len(grams)) - gram_first[gram_text]
        use = whole[gram_text]
        grams, gram_text, at = grams[use], gram_text[use], at[use]
        order = np.lexsort((grams, gram_text))
        same = (grams[order][1:] == grams[order][:-1]) & (gram_text[order][1:] == gram_text[order][:-1])
        twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        edge = np.zeros(len(hashes) + 1, np.int64)
        edge[:-1] += np.bincount(twice, minlength=len(hashes))
        np.subtract.at(edge, twice + REPEAT, 1)
        covered = np.cumsum(edge[:-1]) > 0
    return {
        "n_words": n,
        "word_chars": _total(letters, b.bounds),
        "n_symbols": _total(SYMBOL[b.data], b.bounds),
        "n_dup_lines": np.bincount(line_text[dup], minlength=b.n),
        "n_repeat_words": np.bincount(text[covered], minlength=b.n),
        "n_lines": np.bincount(line_text[worded], minlength=b.n),
    }


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The kept columns, FEATURES and n_lines (lines with a word) of each row's ``text``."""
    attach(docs.sparkSession)
    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    made = [*FEATURES, "n_lines"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), *(f"{m} long" for m in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [block_features(b) for b in W.blocks(batch.column(len(keep)))]
            columns = [pa.array(np.concatenate([p[m] for p in parts]) if parts else np.empty(0), pa.int64()) for m in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *made])

    return source.mapInArrow(run, schema)


def upper_bound(x: int, n: int, alpha: float) -> float:
    """Exact upper confidence bound of a proportion with x of n: the p at which x or fewer have probability alpha."""
    if x >= n:
        return 1.0
    lo, hi = x / n, 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(x + 1)]
    for _ in range(60):
        p = (lo + hi) / 2
        if p <= 0.0 or p >= 1.0:
            break
        tail = math.fsum(math.exp(c + k * math.log(p) + (n - k) * math.log1p(-p)) for k, c in enumerate(logs))
        lo, hi = (p, hi) if tail > alpha else (lo, p)
    return hi


def value(rule: str) -> Column:
    """A rule's feature in thousandths; 0 where the text has nothing to divide by."""
    above, below, _, _ = RULES[rule]
    return F.when(F.col(below) > 0, F.floor(F.col(above) * 1000 / F.col(below))).otherwise(F.lit(0)).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def cutoff(rule: str, level: int) -> int:
    _, _, mild, strict = RULES[rule]
    return mild - (mild - strict) * level // (LEVELS - 1)


def cutoffs(made: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> dict[str | None, int]:
    """The level of each stratum that has one. Only counts by level reach the driver, of strata with
    ``MIN_LABELS`` good documents."""
    label = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_least"), F.max("quality").alias("_most")).filter("_least = 1 and _most = 1")
    good = made.filter(~base_failed()).join(label.select("doc_id"), "doc_id", "left_semi")
    rejects = lambda level: F.greatest(*((value(rule) > cutoff(rule, level)).cast("int") for rule in RULES))
    counts = good.groupBy(stratum).agg(F.count("*").alias("_n"), *(F.sum(rejects(level)).alias(f"_{level}") for level in range(LEVELS)))
    rows = counts.filter(F.col("_n") >= MIN_LABELS).collect()
    found: dict[str | None, int] = {}
    for row in rows:
        for level in range(LEVELS):
            if row[f"_{level}"] > risk * row["_n"] or upper_bound(row[f"_{level}"], row["_n"], (1 - confidence) / len(rows)) > risk:
                break
            found[row[stratum]] = level
    return found


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, the stratum, FEATURES, n_lines, base_failed, failed_rules (of the controlled ones) and kept."""
    spark = docs.sparkSession
    with scope(spark) as s:
        made = s.keep(table(features(docs.select("doc_id", F.col(stratum).cast("string").alias(stratum), "text"), ("doc_id", stratum)), "quality"))
    chosen = cutoffs(made, labels, stratum, risk, confidence)
    names = [f"_{rule}" for rule in RULES]
    limits = spark.createDataFrame([(k, *(cutoff(rule, level) for rule in RULES)) for k, level in chosen.items()], ", ".join(["_stratum string", *(f"{n} long" for n in names)]))
    out = made.join(F.broadcast(limits), made[stratum].eqNullSafe(limits["_stratum"]), "left")
    fails = [F.when(F.coalesce(value(rule) > F.col(n), F.lit(False)), F.lit(rule)) for rule, n in zip(RULES, names, strict=True)]
    out = out.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_compact(F.array(*fails)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_stratum", *names)
