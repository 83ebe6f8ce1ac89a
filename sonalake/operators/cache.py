"""Incremental tables: keep what is asked for, compute what is missing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cleanse import first_by


def config_hash(options: Mapping[str, object]) -> str:
    """Of canonical JSON; leave workers and paths out of the options."""
    return hashlib.sha256(json.dumps(dict(options), sort_keys=True, default=str).encode()).hexdigest()


def reconciled(existing: DataFrame, target: DataFrame, key: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(existing semi-joined with target) and extract(target without existing): hit, shrink, grow and overlap alike."""
    kept = existing.join(target.select(key), key, "left_semi")
    missing = target.join(existing.select(key), key, "left_anti")
    return kept.unionByName(extract(missing), allowMissingColumns=True)


def state(existing: DataFrame, target: DataFrame, key: str) -> str:
    """exact, shrink, grow, overlap or rebuild, from two counts."""
    e, t = existing.select(key).distinct(), target.select(key).distinct()
    extra, missing = not e.join(t, key, "left_anti").isEmpty(), not t.join(e, key, "left_anti").isEmpty()
    if not extra and not missing:
        return "exact"
    if not missing:
        return "shrink"
    if not extra:
        return "grow"
    return "rebuild" if e.join(t, key, "left_semi").isEmpty() else "overlap"


def appended_last(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old and new rows; of each key the new one stays."""
    both = old.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)), allowMissingColumns=True)
    return first_by(both, [key], [F.desc("batch")]).drop("batch")
