"""Outputs of the stages: Parquet tables and small JSON files beside them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values here: names of columns and of JSON fields.
LONG_COLUMNS = ("eval_set", "sample_index", "data_source", "ground_truth", "completion_kind", "completion_index", "completion_text", "extracted_answer", "correctness", "format_ok", "total_reward")


def now() -> datetime:
    return datetime.now(UTC)


def write_json(path: str | Path, value: Any) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    return path


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet with the plan's schema; helper columns, which begin with an underscore, are left out."""
    df.drop(*(c for c in df.columns if c.startswith("_"))).write.mode(mode).parquet(path)
    return path


def write_review(df: DataFrame, path: str | Path) -> Path:
    """A bounded number of rows as JSON lines."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(r[0] + "\n" for r in df.select(F.to_json(F.struct("*"))).collect()), encoding="utf-8")
    return path


def clean_stats(split: str, totals: DataFrame, reasons: DataFrame, subsources: DataFrame) -> dict[str, Any]:
    row = totals.first().asDict()
    return {"split": split, **row, "drop_reasons": {r["reason"]: r["n"] for r in reasons.collect()}, "per_subsource": {r["subsource"]: {"total": r["total"], "kept": r["kept"], "rate": r["rate"]} for r in subsources.collect()}}


def decontam_stats(totals: DataFrame, counts: DataFrame, mode: str, n: int, threshold: float) -> dict[str, Any]:
    row, by = totals.first(), counts.collect()
    return {"mode": mode, "n": n, "threshold": threshold, "total": row["total"], "flagged": row["flagged"], "kept": row["kept"], "by_type": {r["match_type"]: r["n"] for r in by if r["match_type"] is not None}, "by_subsource": {r["subsource"]: r["n"] for r in by if r["match_type"] is None}}


def bucket_stats(name: str, data_source: str, stats: DataFrame, histogram: DataFrame, k: int, output_path: str) -> dict[str, Any]:
    r = stats.first()
    head = {"name": name, "data_source": data_source, "num_samples": r["num_samples"] if r else 0, "k": k}
    bins = {f"bucket_{label}": r[c] if r else 0 for label, c in (("too_easy_p_eq_1", "too_easy"), ("too_hard_p_eq_0", "too_hard"), ("keep_0_lt_p_lt_1", "keep"))}
    return {**head, **bins, "mean_pass_rate": r["mean_pass_rate"] if r else 0.0, "histogram_by_correct_count": {str(x["correct_count"]): x["n"] for x in histogram.orderBy("correct_count").collect()}, "output_path": output_path}


def manifest(**fields: Any) -> dict[str, Any]:
    return {"timestamp_utc": now().isoformat(), **fields}


def metrics(rows: DataFrame) -> dict[str, dict[str, Any]]:
    return {r["eval_set_name"]: r.asDict() for r in rows.collect()}


def write_all_outputs(out_dir: str, tag: str, scored: DataFrame, metric_rows: DataFrame, meta: dict[str, Any]) -> dict[str, str]:
    """The three artifacts of a run, in a folder named after the time and the tag."""
    run = Path(out_dir) / f"{now():%Y%m%d_%H%M%S}_{tag}"
    table = write_records(scored.select(*LONG_COLUMNS), str(run / "per_sample.parquet"))
    return {
        "metrics_json": str(write_json(run / "metrics.json", metrics(metric_rows))),
        "per_sample_parquet": table,
        "run_meta_json": str(write_json(run / "run_meta.json", manifest(tag=tag, **meta))),
    }


def each(sources: Iterable[Any], run, path: str | Path) -> list[dict[str, Any]]:
    """Stats of one source after another; the file is written anew after each, so that a crash
    leaves those of the sources that are done."""
    done: list[dict[str, Any]] = []
    for s in sources:
        done.append(run(s))
        write_json(path, done)
    return done
