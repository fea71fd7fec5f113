"""Result tables, status rows and model bundles."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, allow_empty: bool = True, compression: str | None = None,
                mode: str = "errorifexists", fmt: str = "csv") -> None:
    """CSV with a header (or Parquet). Existing targets are refused unless ``mode`` says otherwise.

    An empty table is either written with its header only or refused.
    """
    if not allow_empty and df.isEmpty():
        raise ValueError(f"refusing to write an empty table: {path}")
    if fmt == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c)
                         for c, t in df.dtypes])
    writer = df.write.mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_compressed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_table(df, path, compression="gzip", mode=mode)


def append_rows(df: DataFrame, store: str) -> None:
    """Add finished rows to a store that a rerun reads first."""
    df.write.mode("append").parquet(store)


def run_status(spark: SparkSession, stage: str, status: str, started: datetime, finished: datetime,
               counts: dict[str, int], config: dict) -> DataFrame:
    """One status row: outcome, times, counts and parameters."""
    row = (stage, status, started.isoformat(timespec="seconds"), finished.isoformat(timespec="seconds"),
           *[int(v) for v in counts.values()], json.dumps(config, sort_keys=True))
    cols = "stage string, status string, started_at string, finished_at string, " + "".join(
        f"`{c}` long, " for c in counts) + "parameters string"
    return spark.createDataFrame([row], cols)


def write_model_bundle(spark: SparkSession, path: str, model, encoder_state: dict, training_digest: str) -> None:
    """Coefficients as Parquet rows beside one JSON row of encoder state."""
    names = encoder_state["layout"]["names"]
    rows = [(i, n, float(c)) for i, (n, c) in enumerate(zip(names, model.coef))]
    spark.createDataFrame(rows, "position int, feature string, coefficient double").write.parquet(f"{path}/coefficients")
    meta = [(model.name, float(model.alpha), float(model.intercept), training_digest, json.dumps(encoder_state))]
    spark.createDataFrame(meta, "model string, alpha double, intercept double, training_digest string, encoder string") \
        .write.parquet(f"{path}/model")


def read_model_bundle(spark: SparkSession, path: str):
    """The frozen model and its encoder state; the feature order is verified."""
    import numpy as np

    from sitewise.operators.models import RidgeModel

    meta = spark.read.parquet(f"{path}/model").first()
    state = json.loads(meta["encoder"])
    coefs = spark.read.parquet(f"{path}/coefficients").orderBy("position").collect()
    if [r["feature"] for r in coefs] != state["layout"]["names"]:
        raise ValueError("stored coefficients do not follow the encoder's feature order")
    model = RidgeModel(meta["model"], meta["alpha"], meta["intercept"],
                       np.array([r["coefficient"] for r in coefs]), state["features"])
    return model, state, meta["training_digest"]


def concat_rows(frames: Sequence[DataFrame], label: str, names: Sequence[str]) -> DataFrame:
    """Stack labelled frames; columns missing on one side become NULL."""
    tagged = [f.withColumn(label, F.lit(n)) for f, n in zip(frames, names)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
