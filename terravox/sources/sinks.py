"""Writers that never leave a half-written or an emptied result behind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


POINTER = "_current"


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None, allow_empty: bool = False) -> None:
    """Write a new version below ``path`` and then let the pointer file name it.

    The pointer is replaced in one rename, so a reader (``current_table``) sees the old table or the
    new one at any moment. An empty result is refused: it is a failed run, not a result. The version
    that was current before is deleted last.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    version = f"version-{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/{version}")
    if not allow_empty and spark.read.schema(df.schema).parquet(f"{path}/{version}").isEmpty():
        raise ValueError(f"refusing to replace {path} with an empty result")
    before = current_version(spark, path)
    target = hadoop.Path(path)
    fs = target.getFileSystem(conf)
    fresh = hadoop.Path(target, f"_pointer-{uuid.uuid4().hex}")
    out = fs.create(fresh)
    out.writeBytes(version)
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(hadoop.Path(target, POINTER)), overwrite)
    if before:
        fs.delete(hadoop.Path(target, before), True)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder that the pointer of ``path`` names, or None before the first write."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pointer = hadoop.Path(path, POINTER)
    fs = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return name


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``replace_table`` published last."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{version}")


def replace_tag(df: DataFrame, path: str, tag: str = "tag") -> None:
    """Replace the partitions of the run tags present in ``df``, leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tag).parquet(path)


def csv_export(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def json_export(df: DataFrame, path: str) -> None:
    df.write.json(path)


def masks(df: DataFrame, axis_lengths: dict[str, int], path: str) -> None:
    """Mask cells, refused when an index lies outside the axis written beside them."""
    bad = df.filter(" OR ".join(f"{c} < 0 OR {c} >= {n}" for c, n in axis_lengths.items()))
    if not bad.isEmpty():
        raise ValueError("mask and axes do not match")
    df.write.parquet(path)


def markdown_rows(df: DataFrame, cols: list[str], digits: int = 2) -> DataFrame:
    """One line of a Markdown table per row; missing values show as a dash."""
    kind = dict(df.dtypes)
    cell = lambda c: F.coalesce(F.format_number(c, digits) if kind[c] in ("double", "float") else F.col(c).cast("string"), F.lit("-"))
    return df.select(*cols, F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in cols]), F.lit(" |")).alias("line"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free checksum of a table: every row is hashed where it lies, the hashes are summed.

    Two 64-bit hashes with different salts keep accidental equality out of reach; the sum needs no
    sort and no single task that sees all rows.
    """
    cols = [F.col(c) for c in sorted(df.columns)]
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    h = lambda salt: F.conv(F.substring(F.sha2(F.concat(F.lit(salt), text), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(h("a").alias("a"), h("b").alias("b")).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).select(
        "n", F.sha2(F.concat_ws("-", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("sha256"))
