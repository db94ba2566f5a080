"""Registered queries of the curation, grading and evaluation operators, on views of the driver's
tables. ``oracles.py`` has the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import boxed, text
from quern.operators import buckets, clean, decontaminate, evaluate, grade, mix, puzzles, sample
from quern.plans import views
from quern.session import attach
from quern.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 42


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        attach(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


# Decontamination


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.classify(views.corpus(spark, sf_dir), views.evals(spark, sf_dir), 13, 0.1)


@query
def decontam_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir)


@query
def decontam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.corpus(spark, sf_dir).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    lines = lines.select((F.col("id") * (1 << 32) + F.col("pos")).alias("id"), "text")
    return decontaminate.classify(lines, views.evals(spark, sf_dir)).filter("is_hit or hit_rate > 0")


@query
def decontam_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.stats(views.corpus(spark, sf_dir), _documents(spark, sf_dir), F.col("subsource"))[0]


@query
def decontam_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.stats(views.corpus(spark, sf_dir), _documents(spark, sf_dir), F.col("subsource"))[1]


@query
def decontam_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.review(views.corpus(spark, sf_dir), _documents(spark, sf_dir))


@query
def decontam_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = views.corpus(spark, sf_dir)
    return decontaminate.clean(corpus, _documents(spark, sf_dir)).select("id", "subsource")


@query
def decontam_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.gram_index(views.evals(spark, sf_dir))


@query
def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.evals(spark, sf_dir)
    return t.select("eid", text.norm_exact(F.col("text")).alias("norm"), F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(text.ngrams(text.tokens(F.col("text")), 13)).cast("long").alias("n_grams"))


# Cleaning


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.parse(views.solutions(spark, sf_dir).withColumnRenamed("id", "index"), "train")


@query
def truth_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.solutions(spark, sf_dir).withColumn("t", boxed.ground_truth(F.col("solution")))
    return s.select("id", F.col("t.answer").alias("answer"), F.col("t.reason").alias("reason"), boxed.last_boxed(F.col("solution")).alias("last_box"), boxed.has_boxed(F.col("solution")).alias("has_box"))


@query
def five_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = clean.kept(_parsed(spark, sf_dir))
    return r.select("data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "ability", F.col("reward_model.style").alias("style"), F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.index").alias("index"), F.col("extra_info.subsource").alias("subsource"))


@query
def clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.stats(_parsed(spark, sf_dir))


@query
def clean_subsources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.subsource_stats(_parsed(spark, sf_dir))


@query
def clean_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_reasons(_parsed(spark, sf_dir))


def _eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), F.col("p_name").alias("problem"), F.when(F.col("p_partkey") % 10 == 0, F.lit(" \n")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("\t"))).alias("answer"), F.col("p_brand").alias("subject"), F.col("p_size").alias("level"), F.col("p_type").alias("unique_id"))
    return clean.eval_records(p, "test")


@query
def eval_five_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _eval_records(spark, sf_dir)
    return r.select("data_source", F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.index").alias("index"), F.col("extra_info.subject").alias("subject"), F.col("extra_info.level").cast("long").alias("level"))


@query
def eval_empty_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.empty_answers(_eval_records(spark, sf_dir))


@query
def eval_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.eval_samples(_eval_records(spark, sf_dir), "math500_test")


@query
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.read(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("m"))
    return turns.select("conv_id", F.md5(text.chat_template(F.col("m"))).alias("prompt_md5"), F.size("m").cast("long").alias("n_turns"))


@query
def prompts_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 512 tokens, by words as a stand-in for the trainer's tokenizer."""
    return views.corpus(spark, sf_dir).filter(F.size(text.tokens(F.col("text"))) <= 512).select("id")


# Sampling


@query
def sample_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.uniform(views.corpus(spark, sf_dir).select("id", "subsource"), 100, SEED, "id")


@query
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.stratified(views.corpus(spark, sf_dir).select("id", "subsource"), 150, SEED, "id", "subsource")


@query
def sample_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.first_rows(views.corpus(spark, sf_dir).select("id", "subsource"), 25, "id")


@query
def rows_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.numbered(views.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")


@query
def rows_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sample.shuffled(views.read(spark, sf_dir, "customer").select("c_custkey"), SEED, "c_custkey")
    return sample.numbered(c.withColumn("h", sample.draw(SEED, F.col("c_custkey"))), "h", "shuffle_pos").drop("h")


@query
def rows_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.random_rows(views.corpus(spark, sf_dir), 5, SEED, "id").select("id", text.preview(F.col("text"), 600).alias("text"))


@query
def rows_peeked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.peek(sample.first_rows(views.corpus(spark, sf_dir), 2, "id"), 2)


@query
def subsource_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.distribution(views.corpus(spark, sf_dir).withColumn("subsource", F.when(F.col("id") % 11 > 0, F.col("subsource"))), "subsource")


@query
def pool_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [views.read(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("pool"), "n") for n in ("documents", "benchmark", "pages")]
    return mix.union(parts).rollup("pool").agg(F.sum("n").alias("n"))


# Grading


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade.score(views.rollouts(spark, sf_dir))


@query
def answers_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.rollouts(spark, sf_dir)
    t = F.col("text")
    return r.select("sample", "idx", text.extract_strict(t).alias("strict"), text.extract_flexible(t).alias("flexible"), grade.extract_answer(F.col("data_source"), t).alias("answer"), grade.as_completion(F.col("data_source"), grade.extract_answer(F.col("data_source"), t)).alias("completion"))


@query
def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select("sample", "idx", "data_source", "grade.correctness", "grade.format_ok", "grade.total_reward")


@query
def puzzle_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.puzzles(spark, sf_dir).withColumns({"numbers": F.array("a", "b", "c"), "truth": F.col("target").cast("string"), "data_source": F.lit("countdown")})
    return grade.score(p, numbers="numbers").select("id", "grade.correctness", "grade.format_ok", "grade.total_reward")


@query
def puzzle_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.puzzles(spark, sf_dir)
    box = boxed.last_boxed(F.col("text"))
    sides = grade.segments(box)
    used = grade.integers(F.try_element_at(sides, F.lit(-1)))
    return p.select("id", F.array_join(sides, "|").alias("sides"), F.array_join(used.cast("array<string>"), ",").alias("used"), grade.target(F.col("target").cast("string")).alias("target"))


@query
def group_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.advantage(_graded(spark, sf_dir), "sample").select("sample", "idx", (F.round("advantage", 6) + F.lit(0.0)).alias("advantage"))


# Buckets


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = buckets.pass_rates(_graded(spark, sf_dir), "sample", "k")
    return rates.withColumn("source", F.element_at(F.array(F.lit("gsm8k"), F.lit("numina"), F.lit("countdown")), (F.col("sample") % 3 + 1).cast("int")))


@query
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir)


@query
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.stats(_rates(spark, sf_dir), "source").withColumn("mean_pass_rate", F.round("mean_pass_rate", 9))


@query
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.histogram(_rates(spark, sf_dir), 12)


@query
def bucket_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.rollup(_rates(spark, sf_dir), "source")


# Mix


@query
def mix_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).filter(mix.between(F.col("pass_rate"), 0.0, 1.0)).select("sample", "source")


@query
def mix_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _rates(spark, sf_dir).filter(mix.between(F.col("pass_rate"), 0.0, 1.0)).select("sample", "source")
    parts = [sample.take(rates.filter(F.col("source") == name), n, SEED, name, "sample") for name, n in (("gsm8k", 50), ("numina", 100), ("countdown", None))]
    return mix.union(parts)


@query
def mix_schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.puzzles(spark, sf_dir).withColumns({"numbers": F.array("a", "b", "c"), "expr": F.lit("")})
    both = mix.union([clean.kept(_parsed(spark, sf_dir)), puzzles.records(p, "train")])
    return both.select("data_source", F.col("extra_info.index").alias("index"), F.col("extra_info.question").alias("question"), F.array_join(F.col("extra_info.numbers").cast("array<string>"), ",").alias("numbers"), F.col("extra_info.target").cast("string").alias("target"))


# Evaluation


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.rollouts(spark, sf_dir)
    first = F.col("idx") == 0
    return r.select(F.col("data_source").alias("eval_set"), F.col("sample").alias("sample_index"), "data_source", F.col("truth").alias("ground_truth"), F.when(first, "greedy").otherwise("sampled").alias("completion_kind"), (F.col("idx").cast("long") - 1).alias("completion_index"), F.col("text").alias("completion_text"))


@query
def eval_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scored(_long(spark, sf_dir)).select("sample_index", "completion_kind", "completion_index", "extracted_answer", "correctness", "format_ok", "total_reward")


@query
def eval_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.majority_scores(evaluate.scored(_long(spark, sf_dir))).select("sample_index", "extracted_answer", "votes", "correctness")


@query
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.metrics(evaluate.scored(_long(spark, sf_dir)))
    return m.select("eval_set_name", "data_source", "num_samples", *(F.round(c, 9).alias(c) for c in ("pass_at_1", "maj_at_8", "format_rate", "total_reward_greedy", "total_reward_sampled_mean")))


@query
def eval_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.rollouts(spark, sf_dir)
    g = r.groupBy(F.col("data_source").alias("eval_set"), F.col("sample").alias("index"), "data_source", F.col("truth").alias("ground_truth")).agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("all"))
    g = g.withColumns({"greedy_completion": F.col("all")[0]["text"], "sampled_completions": F.slice(F.col("all.text"), F.lit(2), F.size("all"))})
    return evaluate.long_form(g).select("sample_index", "completion_kind", "completion_index", "completion_text")


@query
def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of each evaluation set as JSON, with six decimals."""
    m = evaluate.metrics(evaluate.scored(_long(spark, sf_dir)))
    fixed = [F.col(c).cast("decimal(12,6)").alias(c) for c in ("pass_at_1", "maj_at_8", "format_rate", "total_reward_greedy", "total_reward_sampled_mean")]
    return m.select("eval_set_name", F.to_json(F.struct("eval_set_name", "data_source", "num_samples", *fixed)).alias("json"))


@query
def source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.rollouts(spark, sf_dir)
    return r.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("data_source")), ",").alias("sources"))


# Puzzles


@query
def puzzle_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.puzzles(spark, sf_dir)
    return p.select("id", puzzles.content(F.array("a", "b", "c"), F.col("target"), "Go.").alias("content"))


@query
def puzzles_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.puzzles(spark, sf_dir).withColumn("numbers", F.array("a", "b", "c"))
    return puzzles.distinct(p, "id").select("id", "target")


@query
def puzzles_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.puzzles(spark, sf_dir).withColumn("numbers", F.array("a", "b", "c"))
    return puzzles.unseen(p.filter("id % 4 = 0"), p.filter("id % 4 > 0")).select("id", "target")


@query
def puzzles_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = puzzles.generate(spark, 500)
    return made.select("id", F.array_join(F.col("numbers").cast("array<string>"), ", ").alias("numbers"), "target", "expr")


@query
def puzzles_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated puzzles that fail their own check: none. Like ``puzzles_generated`` a source of rows,
    which reads no table."""
    return puzzles.sane(puzzles.generate(spark, 500)).select("id", "target")
