"""Checks of settings and requests, on the driver: each returns the normal form or raises ValueError."""

from __future__ import annotations

import json
import math

from pyspark.sql import SparkSession

from . import files


def load_config(spark: SparkSession, path: str, keys: set[str]) -> dict:
    """A JSON object with exactly these keys."""
    found = json.loads(files.read_text(spark, path))
    if not isinstance(found, dict):
        raise ValueError("a configuration is an object")
    if extra := set(found) - keys:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    if missing := keys - set(found):
        raise ValueError(f"missing settings: {sorted(missing)}")
    return found


def load_layers(spark: SparkSession, path: str) -> tuple[dict[str, tuple[float, float]], float]:
    """Layer ranges and the depth's size in micrometres."""
    found = json.loads(files.read_text(spark, path))
    if missing := {"layers", "y_size_um"} - set(found):
        raise ValueError(f"missing settings: {sorted(missing)}")
    return {k: (float(a), float(b)) for k, (a, b) in found["layers"].items()}, float(found["y_size_um"])


def threshold(value: float | None) -> float | None:
    """None, or a finite number of at least 0."""
    if value is None:
        return None
    if isinstance(value, bool) or not math.isfinite(float(value)) or float(value) < 0:
        raise ValueError("a threshold is a finite number of at least 0")
    return float(value)


def digits(value: int | None) -> int | None:
    """None, or a whole number of at least 0."""
    if value is None:
        return None
    if isinstance(value, bool) or int(value) != value or value < 0:
        raise ValueError("digits are a whole number of at least 0")
    return int(value)


def window(value) -> tuple[float, float]:
    """Two finite numbers in increasing order."""
    lo, hi = (float(v) for v in value)
    if not (math.isfinite(lo) and math.isfinite(hi) and lo < hi):
        raise ValueError("a window is two finite numbers in increasing order")
    return lo, hi


def trigger_pops(requested: str | list[str], available: list[str], group: str | None = None) -> tuple[list[str], str]:
    """Names of the triggers' populations and the name of their group: ``all``, one name, or distinct names with a group's name."""
    names = list(available) if requested == "all" else [requested] if isinstance(requested, str) else list(requested)
    names = [n.strip() for n in names]
    if not names or not all(names) or len(set(names)) != len(names):
        raise ValueError("populations must be distinct names")
    if unknown := [n for n in names if n not in available]:
        raise ValueError(f"unknown populations: {unknown}")
    if len(names) > 1 and not group:
        raise ValueError("several populations need a group name")
    return names, group or names[0]


def usable_archive(meta: dict, pops: list[str], pop: str) -> bool:
    """An archive of trains serves as triggers if it has the population and its times are not shifted."""
    return pop in pops and not meta.get("subtract_t0", True)
