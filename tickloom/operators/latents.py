"""Statistics of latent vectors in array columns, and the latent dynamics step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latent_std(df: DataFrame, column: str) -> DataFrame:
    """Unbiased deviation of each dimension (from 0)."""
    return df.select(F.posexplode(column).alias("dim", "v")).groupBy("dim").agg(F.stddev_samp(F.col("v").cast("double")).alias("std")).select(F.col("dim").cast("long").alias("dim"), "std")


def latent_cov(df: DataFrame, column: str, start: int, stop: int) -> DataFrame:
    """Unbiased covariance of each two dimensions i < j of a block, over the rows that have both; one aggregation by i, no join."""
    at = lambda k: F.get("_a", k).cast("double")
    dims = range(start + 1, stop)
    rows = df.select(F.explode(F.sequence(F.lit(start), F.lit(stop - 2))).alias("i"), F.col(column).alias("_a"))
    per = rows.withColumn("_v", at(F.col("i"))).groupBy("i").agg(F.array(*[F.struct(F.lit(j).cast("long").alias("j"), F.covar_samp("_v", at(F.lit(j))).alias("cov")) for j in dims]).alias("c"))
    return per.select(F.col("i").cast("long").alias("i"), F.explode("c").alias("c")).where("c.j > i").select("i", "c.*")


def smooth_l1(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean smooth-L1 distance of the entries of two array columns."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    loss = F.transform(d, lambda v: F.when(v < 1, v * v * 0.5).otherwise(v - 0.5))
    return df.select(F.aggregate(loss, F.lit(0.0), lambda s, v: s + v).alias("s"), F.size(loss).alias("n")).agg((F.sum("s") / F.sum("n")).alias("loss"))


def variance_penalty(df: DataFrame, column: str, blocks: list[tuple[int, int]], target: float = 1.0) -> DataFrame:
    """For each block of dimensions the mean hinge of its deviations below the target, and the mean deviation."""
    std = latent_std(df, column)
    block = F.coalesce(*[F.when(F.col("dim").between(a, b - 1), F.lit(k)) for k, (a, b) in enumerate(blocks)])
    return std.withColumn("block", block).where("block IS NOT NULL").groupBy("block").agg(F.avg(F.greatest(F.lit(0.0), F.lit(target) - F.col("std"))).alias("penalty"), F.avg("std").alias("std"))


def latent_step(df: DataFrame, latent: str, action: str, layers: list[tuple[np.ndarray, np.ndarray]], out: str = "z_next") -> DataFrame:
    """Adds z + MLP([z, action]) with SiLU between layers; layers: (weights, bias) in order."""

    @F.pandas_udf("array<float>")
    def step(z: pd.Series, a: pd.Series) -> pd.Series:
        base = np.stack(z.to_numpy()).astype(np.float32)
        x = np.concatenate([base, np.stack(a.to_numpy()).astype(np.float32)], 1)
        for k, (w, b) in enumerate(layers):
            x = x @ w.T + b
            if k < len(layers) - 1:
                x = x / (1 + np.exp(-x))
        return pd.Series(list((base + x).astype(np.float32)))

    return df.withColumn(out, step(latent, action))


def encoded(df: DataFrame, column: str, model: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], out: str = "z", dtype: str = "<f4") -> DataFrame:
    """Adds the output of an encoder that the caller brings (rows of tensors to rows of floats) for tensors kept as bytes of ``dtype``.

    Cameras of one step are averaged by the model, not here. The library has no trained encoders.
    """

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        batch = np.stack([np.frombuffer(b, dtype).reshape(shape) for b in x]) if len(x) else np.zeros((0, *shape), dtype)
        return pd.Series(list(np.asarray(model(batch), np.float32)))

    return df.withColumn(out, run(column))


def target_step(target: list[np.ndarray], online: list[np.ndarray], decay: float) -> list[np.ndarray]:
    """The slowly following weights of a target model: decay * target + (1 - decay) * online."""
    return [decay * t + (1 - decay) * o for t, o in zip(target, online, strict=True)]
