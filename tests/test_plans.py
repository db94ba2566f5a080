import json

import pytest
from pyspark.sql import functions as F

from quern.plans import cli
from quern.plans.oracles import ORACLES
from quern.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["decontam_documents", "truth_parsed", "eval_metrics", "bucket_rollup", "sample_stratified"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "lineitem", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), c.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_stages_from_puzzles_to_mix(spark, tmp_path):
    base = str(tmp_path)
    assert cli.main(["puzzles", "--out", f"{base}/raw", "--train", "60", "--test", "10"], spark) == 0
    for n in ("numina", "countdown", "gsm8k"):
        spark.read.parquet(f"{base}/raw/train.parquet").write.parquet(f"{base}/data/{n}.parquet")
    # The stratum of one source is a field that puzzles lack.
    df = spark.read.parquet(f"{base}/data/numina.parquet")
    df.withColumn("extra_info", df["extra_info"].withField("subsource", df["data_source"])).write.parquet(f"{base}/data2/numina.parquet")
    for n in ("countdown", "gsm8k"):
        df = spark.read.parquet(f"{base}/data/{n}.parquet")
        df.write.parquet(f"{base}/data2/{n}.parquet")
    assert cli.main(["pool", "--data-root", f"{base}/data2", "--out", f"{base}/pool", "--numina", "30", "--countdown", "20"], spark) == 0
    assert spark.read.parquet(f"{base}/pool/candidate_countdown.parquet").count() == 20
    assert cli.main(["bucket", "--candidate-dir", f"{base}/pool", "--out", f"{base}/b"], spark) == cli.MISSING
    assert cli.main(["bucket", "--candidate-dir", f"{base}/nowhere", "--out", f"{base}/b"], spark) == cli.MISSING
    done = []
    for n, size in (("countdown", 20), ("numina", 30), ("gsm8k", 60)):
        rows = spark.read.parquet(f"{base}/pool/candidate_{n}.parquet").withColumn("i", F.col("_metadata.row_index")).collect()
        assert len(rows) == size
        done += [(n, r.i, k, "\\boxed{" + r.extra_info.example_solution + "}" if (r.i + k) % 2 else "none") for r in rows for k in range(2)]
    spark.createDataFrame(done, "source string, index long, completion_index long, text string").write.parquet(f"{base}/done.parquet")
    assert cli.main(["bucket", "--candidate-dir", f"{base}/pool", "--out", f"{base}/b", "--completions", f"{base}/done.parquet", "--k", "2"], spark) == 0
    stats = json.load(open(f"{base}/b/stats.json"))
    assert {s["name"]: s["bucket_keep_0_lt_p_lt_1"] for s in stats} == {"gsm8k": 60, "numina": 30, "countdown": 20}
    (tmp_path / "mix.yaml").write_text("sources: {gsm8k: {take: 10}, countdown: {take: all}}")
    assert cli.main(["mix", "--config", f"{base}/mix.yaml", "--bucketed-dir", f"{base}/b", "--out", f"{base}/mix"], spark) == 0
    assert spark.read.parquet(f"{base}/mix/train.parquet").count() == 30
    (tmp_path / "short.yaml").write_text("sources: {gsm8k: {take: 1000}}")
    assert cli.main(["mix", "--config", f"{base}/short.yaml", "--bucketed-dir", f"{base}/b", "--out", f"{base}/mix2"], spark) == cli.SHORT
    assert cli.main(["mix", "--config", f"{base}/none.yaml", "--bucketed-dir", f"{base}/b", "--out", f"{base}/mix2"], spark) == cli.MISSING


def test_stages_from_raw_rows_to_metrics(spark, tmp_path, capsys):
    base = str(tmp_path)
    raw = [(f"problem {k} of the set asks for the sum of all these many numbers again", f"so \\boxed{{{k}}}" if k % 4 else "no box", "a" if k % 2 else "b") for k in range(12)]
    spark.createDataFrame(raw, "problem string, solution string, source string").coalesce(1).write.parquet(f"{base}/raw/train.parquet")
    assert cli.main(["clean", "--local-dir", f"{base}/raw", "--out", f"{base}/clean", "--splits", "train"], spark) == 0
    said = json.load(open(f"{base}/clean/clean_stats.json"))[0]
    assert (said["original"], said["kept"], said["drop_reasons"]) == (12, 9, {"no_boxed": 3})
    tests = [(f"test {k}", " " if k == 2 else f" {k} ", "algebra", 1, f"u{k}") for k in range(4)]
    spark.createDataFrame(tests, "problem string, answer string, subject string, level int, unique_id string").coalesce(1).write.parquet(f"{base}/raw/test.parquet")
    assert cli.main(["--log-dir", f"{base}/logs", "math500", "--local-dir", f"{base}/raw", "--out", f"{base}/math"], spark) == 0
    assert "1 empty answers" in next((tmp_path / "logs").iterdir()).read_text()
    made = spark.read.parquet(f"{base}/math/test.parquet").orderBy("extra_info.index").collect()
    assert [r.reward_model.ground_truth for r in made] == ["0", "1", "", "3"] and made[1].prompt[0].content.startswith("test 1 Please reason")

    # One training problem is a test problem.
    copied = spark.createDataFrame([(raw[1][0].upper() + "!",)], "problem string").selectExpr("struct(problem) as extra_info")
    copied.write.parquet(f"{base}/held.parquet")
    args = ["decontaminate", "--records", f"{base}/clean/train.parquet", "--reference", f"held={base}/held.parquet", "--out", f"{base}/left.parquet", "--review", f"{base}/review.jsonl", "--stats", f"{base}/decontam.json"]
    assert cli.main(args, spark) == 0 and not (tmp_path / "left.parquet").exists()
    assert cli.main([*args, "--apply"], spark) == 0
    assert spark.read.parquet(f"{base}/left.parquet").count() == 8 and len(open(f"{base}/review.jsonl").readlines()) == 1
    assert json.load(open(f"{base}/decontam.json"))["by_type"] == {"exact": 1}

    puzzle = spark.createDataFrame([(0, [2, 6, 7], 30)], "index long, numbers array<bigint>, target long")
    puzzle = puzzle.selectExpr("'countdown' as data_source", "array(struct('user' as role, 'p' as content)) as prompt", "'math' as ability", "struct('rule' as style, '30' as ground_truth) as reward_model", "struct(index, numbers, target) as extra_info")
    puzzle.write.parquet(f"{base}/puzzle.parquet")
    sets = [{"name": "m", "path": "math/test.parquet", "data_source": "math500", "size": 4}, {"name": "p", "path": f"{base}/puzzle.parquet", "data_source": "countdown", "size": 2}]
    config = {"version": "v1", "frozen_at": "2026", "eval_sets": sets} | {k: {} for k in ("metrics", "sampling", "generation", "scoring", "engine")}
    (tmp_path / "eval.yaml").write_text(json.dumps(config))
    done = [("m", k, f"\\boxed{{{k}}}", ["x", f"\\boxed{{{k}}}"]) for k in range(4)] + [("p", 0, "\\boxed{(7 - 2) * 6}", ["x", "x"])]
    kind = "eval_set string, index long, greedy_completion string, sampled_completions array<string>"
    spark.createDataFrame(done, kind).write.parquet(f"{base}/done.parquet")
    run = ["evaluate", "--config", f"{base}/eval.yaml", "--working-dir", base, "--out", f"{base}/out", "--tag", "t", "--completions"]
    assert cli.main([*run, f"{base}/done.parquet"], spark) == 0
    files = {p.name for p in (tmp_path / "out").rglob("*")}
    found = [json.loads(p.read_text()) for p in (tmp_path / "out").rglob("*.json")]
    assert files and found and any("config_yaml_sha256" in json.dumps(x) for x in found)
    text = json.dumps(found)
    assert '"pass_at_1": 1.0' in text and '"pass_at_1": 0.75' in text
    spark.createDataFrame(done[1:], kind).write.parquet(f"{base}/short.parquet")
    assert cli.main([*run, f"{base}/short.parquet"], spark) == cli.UNPAIRED
    assert cli.main(["inspect", "--dir", base], spark) == 0 and "numina: missing" in capsys.readouterr().out


def test_tokens_are_computed_once_a_row(spark):
    plan = QUERIES["text_normalised"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3
    plan = QUERIES["decontam_documents"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("documents.parquet") <= 1
