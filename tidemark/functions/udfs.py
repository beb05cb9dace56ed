"""The Python surface: vectors of text and injected scorers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

DIM = 64


def hashed_vector(text: str, dim: int = DIM) -> list[float]:
    """A unit vector of signed character trigram hashes: deterministic, needs no model."""
    v = np.zeros(dim, np.float32)
    s = f"  {(text or '').lower()} "
    for i in range(len(s) - 2):
        h = zlib.crc32(s[i : i + 3].encode())
        v[h % dim] += 1 if h >> 16 & 1 else -1
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def embed(text: Column | str) -> Column:
    """Vectors of texts, by Arrow batches; put a model's encode in place of hashed_vector."""

    @pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(hashed_vector)

    return run(text)


def register(spark: SparkSession) -> None:
    """The functions under SQL names."""

    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(hashed_vector)

    spark.udf.register("embed_text", run)


Scorer = Callable[[str], dict[str, float]]


def scored(df: DataFrame, text: str, scorer: Scorer, retries: int = 2) -> DataFrame:
    """Adds ``scores`` by an injected scorer (an outside service in use, a stub in tests); a text that keeps failing gets null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t in f[text]:
                made = None
                for _ in range(retries + 1):
                    try:
                        made = scorer(t)
                        break
                    except Exception:  # noqa: BLE001  whatever the service raises counts as a failed try
                        continue
                out.append(made)
            f["scores"] = out
            yield f

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{fields}, scores map<string,double>")


def weighted_score(value: Column | str, weight: Column | str) -> Column:
    """Grouped aggregate: weighted mean, 0 without weight. Sums only, so it is combined before rows are shuffled."""
    v, w = (F.col(c) if isinstance(c, str) else c for c in (value, weight))
    total = F.sum(w)
    return F.when(total != 0, F.sum(v * w) / total).otherwise(F.lit(0.0))


def with_vectors(df: DataFrame, text: str, column: str = "e") -> DataFrame:
    return df.withColumn(column, embed(text))
