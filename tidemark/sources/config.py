"""Settings files: flat JSON objects over the default parameters."""

from __future__ import annotations

import dataclasses
import os
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def read_config(spark: SparkSession, paths: list[str]) -> dict[str, Any]:
    """The first of the paths that holds a JSON object, as a dict; an unreadable one is passed over; {} if none."""
    import json

    for path in paths:
        try:
            rows = spark.read.text(path, wholetext=True).select(F.col("value")).head(1)
            found = json.loads(rows[0].value) if rows else None
        except Exception as e:  # a missing path or a file that is no JSON; anything else is raised
            if not any(x in str(e) for x in ("PATH_NOT_FOUND", "Expecting", "Extra data")):
                raise
            continue
        if isinstance(found, dict):
            return found
    return {}


def write_setting(spark: SparkSession, paths: list[str], key: str, value: Any, target: str) -> dict[str, Any]:
    """Writes the settings that read_config finds, with one of them replaced, to target (a folder of one text file, which read_config reads), and returns them."""
    import json

    config = read_config(spark, paths) | {key: value}
    spark.createDataFrame([(json.dumps(config, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(target)
    return config


def apply(defaults, config: dict[str, Any]):
    """A copy of a parameter dataclass with the settings whose names and types fit; others are ignored."""
    kinds = {f.name: type(getattr(defaults, f.name)) for f in dataclasses.fields(defaults)}
    fits = {k: kinds[k](v) for k, v in config.items() if k in kinds and isinstance(v, (int, float)) and kinds[k] in (int, float) and not isinstance(v, bool)}
    return dataclasses.replace(defaults, **fits)


def data_root(default: str, variable: str = "TRAINING_DATA_ROOT") -> str:
    """The data folder: the environment variable if set, else the default."""
    return os.environ.get(variable) or default


def resolve(path: str, root: str) -> str:
    """Relative paths are taken from the root; absolute ones and URIs stay."""
    return path if os.path.isabs(path) or "://" in path else os.path.join(root, path)
