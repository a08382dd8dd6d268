"""Readers for the file forms site tables, paths and polylines come in, each with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITES = "hotspot string, lat double, lon_180 double, count int, he_ratio string"
PATHS = "map<string, struct<lat array<double>, lon array<double>, depth array<double>, root_fraction double>>"


def csv_table(spark: SparkSession, path: str, schema: str, comment: str | None = None) -> DataFrame:
    r = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    return (r.option("comment", comment) if comment else r).csv(path)


def tagged(spark: SparkSession, pattern: str, schema: str, prefix: str) -> DataFrame:
    """All files of one kind; the run tag is the part of the file name after the prefix."""
    d = csv_table(spark, pattern, schema)
    return d.withColumn("tag", F.regexp_extract(F.col("_metadata.file_name"), f"^{prefix}(.+?)\\.[a-z]+$", 1))


def dated_samples(lines: DataFrame, line: str = "value") -> DataFrame:
    """Tab-separated name, latitude, longitude, age; lines that do not parse are left out."""
    p = F.split(F.col(line), "\t")
    part = lambda n: F.try_element_at(p, F.lit(n))
    num = lambda n: part(n).try_cast("double")
    d = lines.select(*[c for c in lines.columns if c != line], F.trim(part(1)).alias("name"), num(2).alias("lat"), num(3).alias("lon"), num(4).alias("age"))
    return d.filter("lat IS NOT NULL AND lon IS NOT NULL AND age IS NOT NULL")


def path_nodes(docs: DataFrame, column: str = "value") -> DataFrame:
    """Path documents (site -> parallel lists) as one row per node."""
    d = docs.select(F.explode(F.from_json(column, PATHS)).alias("site", "p"))
    z = F.arrays_zip(F.col("p.depth").alias("depth"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
    return d.select("site", F.posexplode(z).alias("n", "x")).select("site", "n", "x.depth", "x.lat", "x.lon")


def keyed_arrays(df: DataFrame, key: str = "key") -> DataFrame:
    """A composite ``kind/site`` key as two columns."""
    p = F.split(F.col(key), "/", 2)
    return df.withColumn("kind", p[0]).withColumn("site", p[1]).drop(key)


def lines_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of the line features of a GeoJSON file, one row per vertex."""
    schema = "features array<struct<properties map<string,string>, geometry struct<type string, coordinates array<array<double>>>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    f = d.select(F.posexplode("features").alias("line", "f")).filter("f.geometry.type = 'LineString'")
    v = f.select("line", F.posexplode("f.geometry.coordinates").alias("seg", "c"))
    return v.select("line", "seg", F.col("c")[1].alias("lat"), F.col("c")[0].alias("lon"))


def newest(spark: SparkSession, pattern: str) -> DataFrame:
    """The most recently written file of a kind, from the listing alone."""
    f = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime", "length")
    return f.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
