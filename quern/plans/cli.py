"""Command line: python -m quern.plans.cli STAGE ...

Exit codes: 2 for missing inputs or arguments, 3 if a source is short, 4 if completions and samples
don't pair off.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import buckets, clean, decontaminate, evaluate, grade, mix, puzzles, sample
from quern.plans import artifacts
from quern.session import attach
from quern.sources import config, tables

MISSING, SHORT, UNPAIRED = 2, 3, 4
LOG_FORMAT = "%(asctime)s %(levelname)s %(message)s"
log = logging.getLogger("quern")


def _path(base: str, name: str) -> str:
    return name if os.path.isabs(name) or "://" in name else os.path.join(base, name)


def stage_clean(spark: SparkSession, a: argparse.Namespace) -> int:
    """Raw splits (index, problem, solution, source) to five-field records."""
    said = []
    tables.require(spark, [_path(a.local_dir, f"{s}.parquet") for s in a.splits])
    for split in a.splits:
        raw = spark.read.parquet(_path(a.local_dir, f"{split}.parquet"))
        if "index" not in raw.columns:
            raw = raw.withColumn("index", F.col("_metadata.row_index"))
        parsed = clean.parse(raw, split)
        artifacts.write_records(clean.kept(parsed), _path(a.out, f"{split}.parquet"))
        said.append(artifacts.clean_stats(split, clean.stats(parsed), clean.drop_reasons(parsed), clean.subsource_stats(parsed)))
    artifacts.write_json(Path(a.out) / "clean_stats.json", said)
    return 0


def stage_math500(spark: SparkSession, a: argparse.Namespace) -> int:
    """The rows of an evaluation set (problem, answer, subject, level, unique_id) to records; all are
    kept, and empty answers are reported."""
    source = _path(a.local_dir, f"{a.split}.parquet")
    tables.require(spark, [source])
    raw = spark.read.parquet(source).withColumn("index", F.col("_metadata.row_index"))
    out = artifacts.write_records(clean.eval_records(raw, a.split), _path(a.out, f"{a.split}.parquet"))
    made = spark.read.parquet(out)
    empty = clean.empty_answers(made).first()["n_empty"]
    log.info("%s: %d rows, %d empty answers", a.split, made.count(), empty)
    if empty:
        log.warning("%s: %d empty answers have to be looked at", a.split, empty)
    return 0


def _evals(spark: SparkSession, specs: list[str]) -> DataFrame:
    """Specifications tag=path, in order: the first that has a text names it."""
    parts = []
    for k, spec in enumerate(specs):
        tag, _, path = spec.partition("=")
        df = spark.read.parquet(path).withColumn("_row", F.col("_metadata.row_index"))
        fields = {f.name for f in df.schema["extra_info"].dataType.fields}
        text = F.col(f"extra_info.{'question' if 'question' in fields else 'problem'}")
        parts.append(df.select(F.concat(F.lit(f"{tag}:"), F.col("_row")).alias("eid"), (F.lit(k << 40) + F.col("_row")).alias("ordinal"), text.alias("text")).filter("coalesce(text, '') <> ''"))
    return mix.union(parts)


def stage_decontaminate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Without --apply review and stats are written, but no records."""
    tables.require(spark, [a.records, *(s.partition("=")[2] for s in a.reference)])
    evals = _evals(spark, a.reference)
    if evals.isEmpty():
        log.warning("the reference set is empty")
        return 0
    df = spark.read.parquet(a.records).withColumn("id", F.col("_metadata.row_index"))
    records = df.select("id", F.col("extra_info.question").alias("text"), F.coalesce(F.col("extra_info.subsource"), F.lit("unknown")).alias("subsource"))
    found = decontaminate.classify(records, evals, a.n, a.threshold).persist()
    totals, counts = decontaminate.stats(records, found, F.col("subsource"))
    artifacts.write_review(decontaminate.review(records, found, a.sample), a.review)
    artifacts.write_json(a.stats, artifacts.decontam_stats(totals, counts, "apply" if a.apply else "dry_run", a.n, a.threshold))
    if a.apply:
        artifacts.write_records(decontaminate.clean(df, found).drop("id"), a.out)
    return 0


def stage_pool(spark: SparkSession, a: argparse.Namespace) -> int:
    """Candidates: a stratified sample of one source, a uniform one of another, all of the third."""
    names = {n: _path(a.data_root, f"{n}.parquet") for n in ("numina", "countdown", "gsm8k")}
    tables.require(spark, [*names.values()])
    read = lambda n: spark.read.parquet(names[n]).withColumn("_row", F.col("_metadata.row_index"))
    numina = read("numina").withColumn("_stratum", F.coalesce(F.col("extra_info.subsource"), F.lit("unknown")))
    out = {"numina": sample.stratified(numina, a.numina, a.seed, "_row", "_stratum"), "countdown": sample.uniform(read("countdown"), a.countdown, a.seed, "_row"), "gsm8k": read("gsm8k")}
    for n, df in out.items():
        artifacts.write_records(df, _path(a.out, f"candidate_{n}.parquet"))
    return 0


def stage_bucket(spark: SparkSession, a: argparse.Namespace) -> int:
    """Candidates and their completions (source, index, completion_index, text) to pass rates."""
    names = [a.only] if a.only else list(config.SOURCES)
    paths = {n: _path(a.candidate_dir, f"candidate_{n}.parquet") for n in names}
    tables.require(spark, [*paths.values()])
    if a.dry_run:
        return 0
    if not a.completions:
        log.error("--completions is missing")
        return MISSING
    tables.require(spark, [a.completions])
    completions = spark.read.parquet(a.completions)

    def run(name: str) -> dict:
        df = spark.read.parquet(paths[name]).withColumn("_row", F.col("_metadata.row_index"))
        if a.limit_per_source:
            df = sample.first_rows(df, a.limit_per_source, "_row")
        numbers = "numbers" if "numbers" in {f.name for f in df.schema["extra_info"].dataType.fields} else None
        asked = df.select("_row", "data_source", F.col("reward_model.ground_truth").alias("truth"), *([F.col("extra_info.numbers").alias("numbers")] if numbers else []))
        own = completions.filter(F.col("source") == name).drop("source").withColumnRenamed("index", "_row")
        graded = grade.score(tables.paired(asked, own, ["_row"], once=False, every=not a.limit_per_source), numbers=numbers)
        rates = buckets.pass_rates(graded, "_row", a.k)
        out = _path(a.out, f"bucketed_{name}.parquet")
        artifacts.write_records(df.join(rates, "_row"), out)
        made = spark.read.parquet(out)
        return artifacts.bucket_stats(name, made.agg(F.min("data_source")).first()[0], buckets.stats(made), buckets.histogram(made, a.k), a.k, out)

    said = artifacts.each(names, run, Path(a.out) / "stats.json")
    artifacts.write_json(Path(a.out) / "manifest.json", artifacts.manifest(k=a.k, seed=a.seed, candidate_dir=a.candidate_dir, out_dir=a.out, sources=[s["name"] for s in said], limit=a.limit_per_source))
    return 0


def stage_mix(spark: SparkSession, a: argparse.Namespace) -> int:
    if not os.path.exists(a.config):
        log.error("no such file: %s", a.config)
        return MISSING
    c = config.load_mix_config(a.config)
    paths = {n: _path(a.bucketed_dir, f"bucketed_{n}.parquet") for n in c.sources}
    tables.require(spark, [*paths.values()])
    pools = {n: spark.read.parquet(p).withColumn("_row", F.col("_metadata.row_index")) for n, p in paths.items()}
    try:
        rows, taken = mix.build(pools, c, "_row", a.allow_shortage)
    except mix.Shortage as short:
        log.error("%s", short)
        return SHORT
    if a.dry_run:
        return 0
    out = artifacts.write_records(rows, _path(a.out, "train.parquet"))
    stats = mix.stats(taken)
    artifacts.write_json(Path(a.out) / "stats.json", stats)
    artifacts.write_json(Path(a.out) / "manifest.json", artifacts.manifest(config=c.path, config_sha256=c.sha256, config_version=c.version, seed=c.seed, pass_rate_range=list(c.pass_rate_range), bucketed_dir=a.bucketed_dir, train_parquet=out, total_rows=stats["total_rows"], allow_shortage_flag=a.allow_shortage))
    return 0


def stage_evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Evaluation sets and their completions (eval_set, index, greedy_completion,
    sampled_completions) to metrics."""
    c = config.load_eval_config(a.config)
    samples = tables.load_eval(spark, c.eval_sets, a.working_dir)
    for said in tables.checks(samples, c.eval_sets):
        log.warning(said)
    if a.skip_generation:
        return 0
    tables.require(spark, [a.completions])
    generations = tables.paired(samples, spark.read.parquet(a.completions).select("eval_set", "index", "greedy_completion", "sampled_completions"), ["eval_set", "index"])
    scored = evaluate.scored(evaluate.long_form(generations))
    meta = {"model_path": a.model, "config_version": c.version, "config_frozen_at": str(c.frozen_at), "config_yaml_path": c.path, "config_yaml_sha256": c.sha256}
    artifacts.write_all_outputs(a.out, a.tag, scored, evaluate.metrics(scored), meta)
    return 0


def stage_puzzles(spark: SparkSession, a: argparse.Namespace) -> int:
    """Train and test puzzles; no test puzzle repeats a train puzzle."""
    args = {"k_min": a.k_min, "k_max": a.k_max, "low": a.lo, "high": a.hi, "most": a.max_inter}
    train = puzzles.generate(spark, a.train, a.seed, **args)
    test = puzzles.generate(spark, a.test, a.seed + 1, **args, other_than=train)
    for name, df in (("train", train), ("test", test)):
        if bad := puzzles.sane(df).count():
            raise RuntimeError(f"{bad} puzzles of {name} don't reach their target")
        artifacts.write_records(puzzles.records(df, name), _path(a.out, f"{name}.parquet"))
    return 0


def stage_inspect(spark: SparkSession, a: argparse.Namespace) -> int:
    """Rows and subsources of each candidate file; missing ones are named."""
    total = 0
    for n in config.SOURCES:
        path = _path(a.dir, f"candidate_{n}.parquet")
        if not tables.exists(spark, path):
            print(f"{n}: missing")
            continue
        df = spark.read.parquet(path)
        total += (k := df.count())
        print(f"{n}: {k}")
        if "subsource" in {f.name for f in df.schema["extra_info"].dataType.fields}:
            tables.distribution(df.select(F.col("extra_info.subsource").alias("subsource")), "subsource").show(50, False)
    print(f"total: {total}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("--log-dir", help="also log to a file there, named by stage and time")
    sub = p.add_subparsers(dest="stage", required=True)

    def add(name: str, run, **flags) -> None:
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        for flag, kind in flags.items():
            flag = "--" + flag.rstrip("_").replace("_", "-")
            if kind is bool:
                s.add_argument(flag, action="store_true")
            elif kind is list:
                s.add_argument(flag, nargs="+", required=True)
            elif kind is str:
                s.add_argument(flag, required=True)
            else:
                s.add_argument(flag, default=kind, type=type(kind) if kind is not None else str)

    add("clean", stage_clean, local_dir=str, out=str, splits=list)
    add("math500", stage_math500, local_dir=str, out=str, split="test")
    add("decontaminate", stage_decontaminate, records=str, reference=list, out="clean.parquet", review="review.jsonl", stats="stats.json", n=13, threshold=0.8, sample=30, apply=bool)
    add("pool", stage_pool, data_root=str, out=str, numina=30000, countdown=20000, seed=42)
    add("bucket", stage_bucket, candidate_dir=str, out=str, completions=None, k=8, seed=42, only=None, limit_per_source=0, dry_run=bool)
    add("mix", stage_mix, config=str, bucketed_dir=str, out=str, allow_shortage=bool, dry_run=bool)
    add("evaluate", stage_evaluate, config=str, completions=None, model="", working_dir=".", out="out", tag="untagged", skip_generation=bool)
    add("puzzles", stage_puzzles, out=str, train=10000, test=100, k_min=3, k_max=4, lo=1, hi=99, max_inter=1000, seed=42)
    add("inspect", stage_inspect, dir=str)
    return p


def log_file(folder: str, stage: str) -> logging.Handler:
    os.makedirs(folder, exist_ok=True)
    handler = logging.FileHandler(os.path.join(folder, f"{stage}_{artifacts.now():%Y%m%d_%H%M%S}.log"), encoding="utf-8")
    handler.setFormatter(logging.Formatter(LOG_FORMAT))
    log.setLevel(logging.INFO)
    log.addHandler(handler)
    return handler


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format=LOG_FORMAT)
    to_file = log_file(a.log_dir, a.stage) if a.log_dir else None
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    attach(spark)
    try:
        return a.run(spark, a)
    except tables.MissingInputs as missing:
        log.error("%s", missing)
        return MISSING
    except tables.Mismatch as mismatch:
        log.error("%s", mismatch)
        return UNPAIRED
    finally:
        if to_file:
            log.removeHandler(to_file)
            to_file.close()


if __name__ == "__main__":
    sys.exit(main())
