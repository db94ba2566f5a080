import pytest
from pyspark.sql import functions as F

from quern.operators import buckets, clean, decontaminate, evaluate, grade, mix, puzzles, sample
from quern.sources import config, tables

B = lambda x: f"\\boxed{{{x}}}"


def grades(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k int, data_source string, text string, truth string, numbers array<bigint>")
    return [round(r.grade.total_reward, 6) for r in grade.score(df, numbers="numbers", **kw).orderBy("k").collect()]


def test_numeric_grades(spark):
    cases = [("7 + 8 = 15\n#### 15", "15", 1.1), ("#### 1,500", "1500", 1.1), ("#### 16", "15", 0.1), ("we get 12, then 15", "15", 1.0), ("15, or rather 12", "15", 0.0), ("nothing to count", "3", 0.0), ("#### 15.00", "15", 0.1), ("#### 9\n#### 15", "15", 1.1), ("15 pears, that is it", "15", 0.0)]
    assert grades(spark, [(k, "openai/gsm8k", t, w, None) for k, (t, w, _) in enumerate(cases)]) == [c[2] for c in cases]


def test_expression_grades(spark):
    cases = [(B("(7 - 2) * 6"), 1.1), (B("7 * 6 - 2"), 0.1), (B("5 * 6"), 0.1), (f"check: {B('30 = 6 \\times (7 - 2)')}", 1.1), ("(7 - 2) * 6", 0.0), (B("6(7 - 2)"), 0.1), (B("(7 - 2) * 6 * 1"), 0.1)]
    assert grades(spark, [(k, "countdown", t, "30", [2, 6, 7]) for k, (t, _) in enumerate(cases)]) == [c[1] for c in cases]
    good = B("(7 - 2) * 6")
    assert grades(spark, [(0, "countdown", good, "30.0", [2, 6, 7]), (1, "countdown", good, "30", None), (2, "countdown", good, "30", [])]) == [0.1, 0.1, 0.1]


def test_symbolic_and_unknown_grades(spark):
    cases = [("math500", f"so it is {B(17)}", "17", 1.1), ("math500", f"so it is {B(71)}", "17", 0.1), ("numina_math", B("\\dfrac{3}{7}"), "\\frac{3}{7}", 1.1), ("math", "17, I think", "17", 0.0), ("elsewhere", B(17), "17", 0.0), ("gsm8k", "#### 17", "17", 1.1)]
    assert grades(spark, [(k, s, t, w, None) for k, (s, t, w, _) in enumerate(cases)]) == [c[3] for c in cases]


def test_null_truth_flag(spark):
    df = spark.createDataFrame([("no number", None)], "text string, truth string")
    got = df.select(grade.numeric(F.col("text"), F.col("truth")).alias("a"), grade.numeric(F.col("text"), F.col("truth"), True).alias("b")).first()
    assert (got.a.correctness, got.b.correctness) == (0.0, 1.0)


def test_extracted_answers(spark):
    cases = [("openai/gsm8k", "4 * 4\n#### 16", "16"), ("openai/gsm8k", "4 and 16", "16"), ("openai/gsm8k", "none at all", None), ("math500", f"{B(1)} and then {B('2\\pi')}", "2\\pi"), ("math500", "2\\pi", None), ("numina_math", B("y - 2"), "y - 2"), ("countdown", f"try {B('9 / 3')}", "9 / 3"), ("elsewhere", B(4), None), ("gsm8k", "#### 16", None)]
    df = spark.createDataFrame([(k, s, t) for k, (s, t, _) in enumerate(cases)], "k int, s string, t string")
    got = df.select("k", grade.extract_answer(F.col("s"), F.col("t")).alias("a")).orderBy("k").collect()
    assert [r.a for r in got] == [c[2] for c in cases]


def scored(spark):
    """Five samples of four completions each: how many are right, and whether the greedy one is marked."""
    rows = []
    for k, right in enumerate((4, 3, 2, 1, 0)):
        sampled = [f"#### {90 + k}"] * right + [f"#### {10 + k}"] * (4 - right)
        greedy = (f"#### {90 + k}", f"#### {10 + k}", f"so {90 + k}", f"so {10 + k}", "no idea")[k]
        rows.append(("set", k, "openai/gsm8k", str(90 + k), greedy, sampled))
    df = spark.createDataFrame(rows, "eval_set string, index long, data_source string, ground_truth string, greedy_completion string, sampled_completions array<string>")
    return evaluate.scored(evaluate.long_form(df))


def test_metrics(spark):
    m = evaluate.metrics(scored(spark)).first()
    assert m.num_samples == 5
    # Greedy: 1.1, 0.1, 1, 0, 0. A tie of two and two goes to the right answer, which came first.
    assert [round(x, 9) for x in (m.pass_at_1, m.format_rate, m.maj_at_8, m.total_reward_greedy, m.total_reward_sampled_mean)] == [0.4, 0.4, 0.6, 0.44, 0.6]
    assert scored(spark).filter("completion_kind = 'greedy'").count() == 5
    assert evaluate.metrics(scored(spark).limit(0)).count() == 0


def test_numbers_reach_the_grader(spark):
    rows = [("set", k, "countdown", "30", B("(7 - 2) * 6"), [B("7 * 6")], numbers) for k, numbers in enumerate([[2, 6, 7], None])]
    df = spark.createDataFrame(rows, "eval_set string, index long, data_source string, ground_truth string, greedy_completion string, sampled_completions array<string>, numbers array<bigint>")
    out = evaluate.scored(evaluate.long_form(df))
    assert "numbers" not in out.columns
    assert {(r.sample_index, r.completion_kind): r.correctness for r in out.collect()} == {(0, "greedy"): 1.0, (0, "sampled"): 0.0, (1, "greedy"): 0.0, (1, "sampled"): 0.0}


def test_completions_pair_off(spark):
    samples = spark.createDataFrame([("s", 0), ("s", 1)], "eval_set string, index long")
    on = ["eval_set", "index"]
    done = lambda rows: spark.createDataFrame([("s", i, "x") for i in rows], "eval_set string, index long, text string")
    assert tables.paired(samples, done([0, 1]), on).count() == 2
    assert tables.paired(samples, done([0, 1, 1]), on, once=False).count() == 3
    assert tables.paired(samples, done([0, 1, 2]), on, every=False).count() == 2
    for wrong in ([0], [0, 1, 1], [0, 1, 2]):
        with pytest.raises(tables.Mismatch):
            tables.paired(samples, done(wrong), on)


def test_majority_takes_the_first_seen_on_a_tie(spark):
    rows = [("s", 0, "openai/gsm8k", "1", "sampled", k, f"#### {x}") for k, x in enumerate([1, 2, 2, 1])]
    df = spark.createDataFrame(rows, "eval_set string, sample_index long, data_source string, ground_truth string, completion_kind string, completion_index long, completion_text string")
    assert evaluate.majority(evaluate.scored(df)).first().extracted_answer == "1"


def test_classification(spark):
    evals = spark.createDataFrame([("e:0", 0, "One two three four!"), ("e:1", 1, "five six seven eight"), ("e:2", 2, ""), ("e:3", 3, "one TWO three four")], "eid string, ordinal long, text string")
    recs = spark.createDataFrame([(0, "one-two three, four"), (1, "one two three x five six seven y"), (2, "one two"), (3, None), (4, "one two three four five six seven eight")], "id long, text string")
    got = {r.id: (r.is_hit, r.match_type, round(r.hit_rate, 3), r.matched_eval) for r in decontaminate.classify(recs, evals, 3, 0.3).collect()}
    assert got == {0: (True, "exact", 1.0, "e:0"), 1: (True, "ngram", 0.333, "e:0"), 2: (False, "", 0.0, None), 3: (False, "", 0.0, None), 4: (True, "ngram", 0.667, "e:0")}
    strict = {r.id: r.is_hit for r in decontaminate.classify(recs, evals, 3, 2 / 6).collect()}
    assert not strict[1]


def test_stratified_rounds_half_to_even(spark):
    df = spark.createDataFrame([(k, "a" if k < 1 else "b" if k < 4 else "c") for k in range(10)], "id long, s string")
    got = {r.s: r["count"] for r in sample.stratified(df, 5, 42, "id", "s").groupBy("s").count().collect()}
    assert got == {"b": 2, "c": 3}


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(100).repartition(7)
    one = sorted(r.id for r in sample.uniform(df, 10, 1, "id").collect())
    assert len(one) == 10 and one == sorted(r.id for r in sample.uniform(spark.range(100), 10, 1, "id").collect())
    assert sample.uniform(df, 1000, 1, "id").count() == 100 and sample.uniform(df, 0, 1, "id").count() == 0
    assert [r.row for r in sample.numbered(df, "id").orderBy("id").collect()] == list(range(100))


def test_histogram_is_dense(spark):
    rates = spark.createDataFrame([(0, 8, 0.0), (8, 8, 1.0), (8, 8, 1.0)], "correct_count long, k_samples long, pass_rate double")
    assert [r.n for r in buckets.histogram(rates, 8).orderBy("correct_count").collect()] == [1, 0, 0, 0, 0, 0, 0, 0, 2]
    s = buckets.stats(rates).first()
    assert (s.too_easy, s.too_hard, s.keep) == (2, 1, 0)


def test_mix_shortage(spark):
    pool = spark.createDataFrame([(k, k % 5, 4, (k % 5) / 4) for k in range(10)], "id long, correct_count long, k_samples long, pass_rate double")
    c = config.mix_config({"sources": {"gsm8k": {"take": 10}}})
    with pytest.raises(mix.Shortage):
        mix.build({"gsm8k": pool}, c, "id")
    rows, taken = mix.build({"gsm8k": pool}, c, "id", allow_shortage=True)
    assert rows.count() == 6 and taken[0].was_shortage and taken[0].histogram == {0: 0, 1: 2, 2: 2, 3: 2, 4: 0}


@pytest.mark.parametrize("raw", [{"sources": {}}, {"sources": {"x": {"take": 1}}}, {"sources": {"gsm8k": {"take": 0}}}, {"sources": {"gsm8k": {"take": "all"}}, "pass_rate_range": {"min_exclusive": 0.5, "max_exclusive": 0.5}}])
def test_wrong_mix_configs(raw):
    with pytest.raises(ValueError):
        config.mix_config(raw)


def test_wrong_eval_config():
    with pytest.raises(ValueError):
        config.eval_config({"version": 1})


def test_clean(spark):
    raw = spark.createDataFrame([(0, "p", B(1), "s"), (1, None, "none", None), (2, "q", B("a") + B("b"), "s")], "index long, problem string, solution string, source string")
    parsed = clean.parse(raw, "train")
    assert clean.stats(parsed).first().asDict() == {"original": 3, "kept": 1, "dropped": 2, "retention": 0.3333}
    assert {r.reason: r.n for r in clean.drop_reasons(parsed).collect()} == {"no_boxed": 1, "multi_boxed": 1}
    one = clean.kept(parsed).first()
    assert one.reward_model.ground_truth == "1" and one.prompt[0].content.startswith("p Please reason step by step") and one.extra_info.subsource == "s"
    assert clean.stats(parsed.limit(0)).first().retention == 0.0


def test_puzzles(spark):
    made = puzzles.generate(spark, 200).persist()
    assert sorted(r.id for r in made.collect()) == [*range(200)] and puzzles.sane(made).count() == 0
    keys = {(tuple(sorted(r.numbers)), r.target) for r in made.collect()}
    assert len(keys) == 200 and all(0 < t <= 1000 for _, t in keys)
    assert all(op in "".join(r.expr for r in made.collect()) for op in "+-*/")
    assert puzzles.unseen(made, made).count() == 0
    more = puzzles.generate(spark, 50, other_than=made)
    assert more.count() == 50 and not keys & {(tuple(sorted(r.numbers)), r.target) for r in more.collect()}
    r = puzzles.records(made, "train").first()
    assert r.data_source == "countdown" and f"Target: {r.extra_info.target}\nUsing each" in r.prompt[0].content
    with pytest.raises(ValueError):
        puzzles.generate(spark, 20, low=1, high=1, k_max=3)


def test_operations_in_all_orders(spark):
    state = F.struct(F.lit(12).cast("bigint").alias("v"), F.lit("12").alias("expr"))
    got = {(r.pick, r.c.v, r.c.expr) for r in spark.range(24).select(F.col("id").alias("pick"), puzzles.combine(state, F.lit(4).cast("bigint"), F.col("id"), 40).alias("c")).collect()}
    first = {e[4:5] and e.split(" ")[1] for _, _, e in got}
    assert first == {"+", "-", "/"} and len(got) == 24  # 48 is over 40
    assert {v for _, v, _ in got} == {16, 8, 3}
