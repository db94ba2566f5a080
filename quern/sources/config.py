"""YAML configurations, checked and with the hash of their text."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path
from typing import Any

# Keys of the YAML files and names of sources.
EVAL_KEYS = ("version", "eval_sets", "metrics", "sampling", "generation", "scoring", "engine")
EVAL_SET_KEYS = ("name", "path", "data_source", "size")
SOURCES = ("gsm8k", "numina", "countdown")


@dataclass(frozen=True)
class MixConfig:
    """``sources``: rows to take by name, None for all, in order."""

    version: str
    seed: int
    pass_rate_range: tuple[float, float]
    sources: dict[str, int | None]
    path: str = ""
    sha256: str = ""


@dataclass(frozen=True)
class EvalConfig:
    version: str
    frozen_at: Any
    eval_sets: list[dict[str, Any]]
    rest: dict[str, Any]
    path: str = ""
    sha256: str = ""


def read(path: str) -> tuple[dict[str, Any], str]:
    import yaml

    raw = Path(path).read_bytes()
    return yaml.safe_load(raw) or {}, hashlib.sha256(raw).hexdigest()


def mix_config(raw: dict[str, Any], path: str = "", sha256: str = "", known: tuple[str, ...] = SOURCES) -> MixConfig:
    span = raw.get("pass_rate_range") or {}
    low, high = float(span.get("min_exclusive", 0.0)), float(span.get("max_exclusive", 1.0))
    if not low < high:
        raise ValueError(f"the pass rate range ({low}, {high}) is empty")
    sources = raw.get("sources") or {}
    if not sources:
        raise ValueError("no sources are given")
    if unknown := sorted(set(sources) - set(known)):
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    takes: dict[str, int | None] = {}
    for name, spec in sources.items():
        n = (spec or {}).get("take")
        if n != "all" and (not isinstance(n, int) or isinstance(n, bool) or n <= 0):
            raise ValueError(f"{name}: take must be a positive number or all, not {n!r}")
        takes[name] = None if n == "all" else n
    return MixConfig(str(raw.get("version", "v1")), int(raw.get("seed", 42)), (low, high), takes, path, sha256)


def eval_config(raw: dict[str, Any], path: str = "", sha256: str = "") -> EvalConfig:
    if missing := [k for k in EVAL_KEYS if k not in raw]:
        raise ValueError(f"missing keys: {', '.join(missing)}")
    if not raw["eval_sets"]:
        raise ValueError("no evaluation sets are given")
    for k, spec in enumerate(raw["eval_sets"]):
        if missing := [x for x in EVAL_SET_KEYS if x not in spec]:
            raise ValueError(f"evaluation set {k}: missing keys: {', '.join(missing)}")
    rest = {k: v for k, v in raw.items() if k not in ("version", "frozen_at", "eval_sets")}
    return EvalConfig(str(raw["version"]), raw.get("frozen_at"), raw["eval_sets"], rest, path, sha256)


def load_mix_config(path: str) -> MixConfig:
    return mix_config(*(lambda raw, sha: (raw, path, sha))(*read(path)))


def load_eval_config(path: str) -> EvalConfig:
    return eval_config(*(lambda raw, sha: (raw, path, sha))(*read(path)))
