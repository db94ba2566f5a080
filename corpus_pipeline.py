"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Language identification drops what has no language; fuzzy line deduplication cuts repeated lines;
of near-duplicate documents one stays; sources are mixed to their target weights, which repeats
or drops documents; what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bloom, language, line_dedup, mixing, near_dedup, packing
from quern.llm.queries import byte_bpe
from quern.session import drop_table, scope, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those that are ``und``, or whose score is under SURE, go, as do null
    and empty texts. Equal rows get equal answers; null ids, sources and labels are kept as they are.
    Here as in all stages but the last columns other than ``COLUMNS`` are dropped, and an empty
    table gives an empty one."""
    model = language.fit(docs.filter(~language.held_out(docs["doc_id"])))
    found = language.identify(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)).select(*COLUMNS)


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated lines; n_chars is that of the text left, null for a null text.
    Every document stays, also one that has no line left."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id. Rows that repeat an
    id are one document, of which the row first in order of text, source, language and length stays;
    rows without an id all stay. Only rows whose ids are among those to go are shuffled."""
    with scope(spark) as s:
        gone = near_dedup.groups(docs).filter("doc_id is not null and not kept").select("doc_id").distinct()
        gone = s.keep(table(gone, "near-duplicates"))
    left = without(docs.select(*COLUMNS), gone)
    again = left.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = table(again, "ids-repeated")
    if again.isEmpty():
        return left
    row = F.struct("text", "source", "lang", "n_chars")
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("_row")).select("doc_id", "_row.*")
    return without(left, again).unionByName(one.select(*COLUMNS))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among the ids, a table; a Bloom filter spares most the join."""
    blocks = bloom.size(ids.count())
    marked = bloom.probe(docs, "doc_id", bloom.build(ids, "doc_id", blocks) if blocks else None, blocks)
    some = marked.filter("_possible").select(*COLUMNS).join(ids, "doc_id", "left_anti").select(*COLUMNS)
    return some.unionByName(marked.filter("not _possible").select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none, once or twice. A null source is a source; a
    null text has size 0; equal rows are documents of their own."""
    mixed = mixing.mix(docs.select(*COLUMNS)).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; see quern.llm.packing. A null text counts as empty and has the end
    token only; rows without an id have pieces without one; repeated rows are packed each."""
    return packing.pack(docs, byte_bpe())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", fuzzy_lines),
    ("near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]
#: Language scores, line groups and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scope(spark) as s:
            docs = s.keep(table(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
