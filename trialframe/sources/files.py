"""Readers for observation tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)


def _schema(*fields) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in fields])


# The columns of the input files, as their headers spell them.
OBSERVATIONS = _schema(
    ("RhiID", IntegerType),
    ("Treatment", StringType),
    ("Sampling", StringType),
    ("HarvestDate", DateType),
    ("RhiInitialFW_g", DoubleType),
    ("RhiSample_g", DoubleType),
    ("Root_g", DoubleType),
    ("AboveGround_g", DoubleType),
    ("Starch_Rhi", DoubleType),
    ("Sucrose_Rhi", DoubleType),
    ("Glucose_Rhi", DoubleType),
    ("Leaf.Area_cm2", DoubleType),
    ("totLeaves", DoubleType),
)
DEVELOPMENT = _schema(
    ("RhiID", IntegerType),
    ("Treatment", StringType),
    ("SamplingDate", DateType),
    ("PlantedRhi", DateType),
    ("totLeaves", DoubleType),
    ("avgLeaves", DoubleType),
    ("avgFlower", DoubleType),
)
GAS_EXCHANGE = _schema(
    ("RhiID", IntegerType),
    ("Treatment", StringType),
    ("SamplingDate", DateType),
    ("Days", IntegerType),
    ("Phase", StringType),
    ("A", DoubleType),
    ("PhiPS2", DoubleType),
    ("gsw", DoubleType),
)


def snake_case(name: str) -> str:
    parts = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.replace(".", "_"))
    return re.sub(r"_+", "_", parts).lower()


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    tidy_names: bool = True,
    row_id: str | None = None,
) -> DataFrame:
    """CSV with a header and ``NA`` as missing.

    With a schema the columns are matched by header name, whatever their order
    in the file; without one the types are inferred, at the price of a second
    pass over the file. ``row_id`` names a column to be added that grows in
    file order, for steps where the order of rows has a meaning: a value of file
    name, place of the split in the file, and row in the split, in this order.
    """
    reader = spark.read.option("header", True).option("nullValue", "NA")
    if schema is None:
        df = reader.option("inferSchema", True).csv(path)
    else:
        raw = reader.csv(path)
        df = raw.select(
            *(raw[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in schema.fields),
            *([] if row_id is None else ["_metadata"]),
        )
    place = []
    if row_id is not None:
        at = F.col("_metadata")
        place = [
            F.struct(
                at["file_path"].alias("file"),
                at["file_block_start"].alias("split"),
                F.monotonically_increasing_id().alias("row"),
            ).alias(row_id)
        ]
    names = [c for c in df.columns if c != "_metadata"]
    return df.select(
        *(F.col(f"`{c}`").alias(snake_case(c) if tidy_names else c) for c in names), *place
    )


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
