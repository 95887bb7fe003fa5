"""SQL names for the engine's own functions: ``register(spark)``, then ``SELECT ... FROM t, LATERAL kmers(seq, 5)``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinstrand.functions import alignment as A


class Kmers:
    """word, place (from 1) of every word of k letters."""

    def eval(self, seq: str, k: int) -> Iterator[tuple[str, int]]:
        for i in range(len(seq or "") - k + 1):
            yield seq[i : i + k], i + 1


def _identity(scoring: A.Scoring):
    def run(q: pd.Series, r: pd.Series) -> pd.Series:
        coded = [(scoring.encode(a), scoring.encode(b)) for a, b in zip(q.fillna(""), r.fillna(""), strict=True)]
        pairs = [(a, b, A.best_band(a, b, scoring.unit, 0.6, 20, 0)) if len(a) and len(b) else (a, b, A.Band(1, 0, 0, 0)) for a, b in coded]
        found = A.align(pairs, scoring)
        return pd.Series([x.matches / min(len(a), len(b)) if x.ok else None for x, (a, b) in zip(found, coded, strict=True)], dtype="float64")

    return run


def _hamming(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sum(c != d for c, d in zip(x, y, strict=False)) + abs(len(x) - len(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


def register(spark: SparkSession) -> None:
    """kmers(seq, k) as a table function; identity_aa(q, r), identity_nt(q, r) and hamming(a, b) as Arrow functions."""
    spark.udtf.register("kmers", F.udtf(Kmers, returnType="word string, place int"))
    spark.udf.register("identity_aa", F.pandas_udf(_identity(A.Scoring.amino()), "double"))
    spark.udf.register("identity_nt", F.pandas_udf(_identity(A.Scoring.nucleotide()), "double"))
    spark.udf.register("hamming", F.pandas_udf(_hamming, "long"))
