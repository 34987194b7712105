"""Selection of source files and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def limit_streams(df: DataFrame, keys: tuple[str, ...], n: int, per: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the first ``n`` series in key order, overall or per group; 0 keeps all."""
    if n <= 0:
        return df
    streams = df.select(*keys).distinct()
    if per:
        w = Window.partitionBy(*per).orderBy(*[k for k in keys if k not in per])
        chosen = streams.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    else:
        chosen = streams.orderBy(*keys).limit(n)
    return df.join(chosen, list(keys), "left_semi")


def unique_sources(paths: DataFrame, keyword: str) -> DataFrame:
    """One path per lower-cased file name: with the keyword first, then the shortest, then the first by name.

    An aggregate, so that copies of one name are reduced before the shuffle.
    """
    named = paths.select("path", F.lower(F.element_at(F.split("path", "/"), -1)).alias("name"))
    rank = F.struct((~F.lower("path").contains(keyword.lower())).alias("a"), F.length("path").alias("b"),
                    F.col("path").alias("path"))
    return named.groupBy("name").agg(F.min(rank).alias("_best")).select("name", F.col("_best.path").alias("path"))


def source_filter(name: Column, modality: str, extensions: tuple[str, ...]) -> Column:
    """Name carries the modality token and one of the extensions."""
    low = F.lower(name)
    return low.contains(f"_{modality.lower()}_face_std") & F.regexp_extract(low, r"(\.[^.]*)$", 1).isin(*extensions)
