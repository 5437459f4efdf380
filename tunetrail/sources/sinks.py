"""Write result tables and say how many rows each got."""

import os

from pyspark.sql import Observation, functions as F


def write_table(df, path, fmt="parquet", single_file=False):
    """One directory per table. `single_file` is for bounded report tables."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_tables(tables, folder, fmt="parquet", single_file=False):
    """Write {name: DataFrame}; returns (name, rows).

    A name such as `top_lists/artists` makes a sub-directory, the counterpart of a sheet.
    Rows are counted while writing, not by a second job.
    """
    rows = []
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        seen = Observation()
        write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), os.path.join(folder, name), fmt, single_file)
        rows.append((name, seen.get["rows"]))
    return spark.createDataFrame(rows, "name string, rows bigint")
