"""Metrics by name, two-stage signatures 'extract->metric', and dedup before expensive scoring."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_METRICS: dict[str, Callable] = {}


def register(name: str):
    """Decorator for a scorer: pandas Series of texts -> Series of scores. Taking a name again warns."""

    def keep(f: Callable) -> Callable:
        if name in _METRICS:
            warnings.warn(f"metric {name} is replaced", stacklevel=2)
        _METRICS[name] = f
        return f

    return keep


def get(name: str) -> Callable:
    if name not in _METRICS:
        raise ValueError(f"unknown metric {name}; known: {', '.join(sorted(_METRICS))}")
    return _METRICS[name]


def names() -> list[str]:
    return sorted(_METRICS)


def scorer(signature: str) -> Callable[[Column], Column]:
    """'metric' or 'extract->metric': the second is applied to what the first gives."""
    steps = [get(s.strip()) for s in signature.split("->")]

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        for f in steps:
            texts = f(texts)
        return texts.astype(float)

    return lambda c: run(c)


def score_once(df: DataFrame, text: str, signature: str, name: str = "score") -> DataFrame:
    """Score each distinct text once (by digest) and join the scores back; null texts score null."""
    keyed = df.withColumn("_digest", F.xxhash64(text)).withColumn("_md5", F.md5(F.col(text).cast("binary")))
    distinct = keyed.where(F.col(text).isNotNull()).groupBy("_digest", "_md5").agg(F.first(text).alias("_text"))
    scored = distinct.select("_digest", "_md5", scorer(signature)(F.col("_text")).alias(name))
    return keyed.join(scored, ["_digest", "_md5"], "left").drop("_digest", "_md5")


@register("length")
def _length(texts: pd.Series) -> pd.Series:
    return texts.str.len()


@register("question")
def _question(texts: pd.Series) -> pd.Series:
    """1 where a text asks."""
    return texts.str.contains("[?？]", regex=True, na=False).astype(float)


@register("strip")
def _strip(texts: pd.Series) -> pd.Series:
    return texts.str.strip()
