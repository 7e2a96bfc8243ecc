"""The flagship query on the driver tables: explore ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurescape.operators import encode, filters, positions
from featurescape.operators.ids import ensure_id
from featurescape.plans.explore import explore


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    raw = ensure_id(part.select(F.col("p_partkey").alias("ID"), "p_brand", "p_type",
                                F.col("p_size").alias("size-x"), F.col("p_retailprice").alias("size-y")),
                    keep_order_column=True)
    model = encode.fit_encoder(raw)
    enc = model.transform(raw.withColumn("p_type_raw", F.col("p_type")), keep=("p_type_raw",))
    pos = positions.pair_positions(raw)
    flt = [filters.FeatureFilter("size-y", 0.1, 0.9),
           filters.TextFilter(["ECONOMY"], columns=["p_type_raw"]),
           filters.IdFilter(part.where(F.col("p_size") < 5).select(F.col("p_partkey").cast("string").alias("ID")))]
    view = explore(enc, pos, "size", flt, color_feature="size-y")
    return view.select("ID", "passive", "x", "y", "color", "clustered", "representative", "visible")
