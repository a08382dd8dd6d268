"""The given tables read as gridded fields, sites, paths and votes.

The mapping is arithmetic on keys, so that SQL can state the same rows. A model is a block of
``NLAT * NLON`` consecutive vectors: the grid of one model is fixed and the number of models grows
with the data, so a model is a group of known, bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravox.operators.scaling import shuffled_join, spread_small

# Fixed values of the grid: rows, columns, shells and spacing.
NLAT, NLON, NZ = 20, 25, 64
DLAT, DLON, DZ_KM = 9.0, 14.4, 45.0
PER_MODEL = NLAT * NLON


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def depth_of(k: Column) -> Column:
    return k * DZ_KM


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per map cell with its whole depth column as an array: no shuffle is needed for
    anything that works along depth."""
    e = spread_small(table(spark, sf_dir, "embeddings"), "vec_id")
    c = F.pmod(F.col("vec_id"), F.lit(PER_MODEL))
    e = e.select(
        F.floor(F.col("vec_id") / PER_MODEL).cast("bigint").alias("model"),
        F.floor(c / NLON).cast("int").alias("j"),
        F.pmod(c, F.lit(NLON)).cast("int").alias("i"),
        F.transform("embedding", lambda x: x.cast("double") * 10.0).alias("v"),
        F.col("label").cast("int").alias("label"),
    )
    return e.select(
        "model",
        "j",
        "i",
        (F.lit(-90.0) + (F.col("j") + 0.5) * DLAT).alias("lat"),
        (F.lit(-180.0) + F.col("i") * DLON).alias("lon"),
        "v",
        "label",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per (model, j, i, k)."""
    c = columns(spark, sf_dir)
    return c.select("model", "j", "i", "lat", "lon", "label", F.posexplode("v").alias("k", "anom")).withColumn(
        "depth_km", depth_of(F.col("k"))
    )


def site_lat(key: Column) -> Column:
    return F.lit(-60.0) + F.pmod(key * 37, F.lit(1200)) / 10.0


def site_lon(key: Column) -> Column:
    return F.lit(-180.0) + F.pmod(key * 73, F.lit(3600)) / 10.0


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("site"), site_lat(k).alias("lat"), site_lon(k).alias("lon"), F.lit("hotspot").alias("kind")
    )


def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("site"), site_lat(k).alias("lat"), site_lon(k).alias("lon"), F.lit("null").alias("kind")
    )


def places(sites: DataFrame) -> DataFrame:
    """Distinct positions with the number of sites on each.

    The key arithmetic repeats after 3,600 keys, so there are at most 3,600 positions per kind
    however many sites there are; everything spatial is done once per position.
    """
    return sites.groupBy("kind", "lat", "lon").agg(F.count("*").alias("n_sites"), F.min("site").alias("site"))


def every_site(spark: SparkSession, sf_dir: str, per_place: DataFrame, kind: str) -> DataFrame:
    """Results of ``places`` handed on to all sites of each position.

    ``kind`` is the population, or ``kind`` where the rows name theirs. Positions are many fewer than
    sites, so results are computed once and meet the sites by an equi join on (kind, position).
    """
    both = {"hotspot": [hotspots], "null": [nulls], "kind": [hotspots, nulls]}[kind]
    sites = both[0](spark, sf_dir)
    for more in both[1:]:
        sites = sites.unionByName(more(spark, sf_dir))
    at = places(sites).select("kind", "lat", "lon", F.col("site").alias("_place"))
    members = sites.join(at, ["kind", "lat", "lon"]).select("kind", "_place", F.col("site").alias("_site"))
    r = per_place if kind == "kind" else per_place.withColumn("kind", F.lit(kind))
    r = shuffled_join(r.withColumnRenamed("site", "_place"), members, ["kind", "_place"]).withColumnRenamed("_site", "site").drop("_place")
    return r if kind == "kind" else r.drop("kind")


def every_site_sql(text: str, kind: str) -> str:
    """The same in SQL, around a whole query."""
    which = "q.kind" if kind == "kind" else f"'{kind}'"
    return f"""SELECT m.member AS site, q.* EXCLUDE (site) FROM ({text}) AS q JOIN (
  WITH {SITES_SQL} SELECT kind, site AS member, min(site) OVER (PARTITION BY kind, lat, lon) AS place
  FROM (SELECT *, 'hotspot' AS kind FROM hotspots UNION ALL SELECT *, 'null' AS kind FROM nulls) AS u) AS m
  ON m.place = q.site AND m.kind = {which}"""


MAX_PLACES = 2 * 3600

# The same rows in SQL, for the oracle.
CELLS_SQL = f"""cols AS (
  SELECT vec_id // {PER_MODEL} AS model, (vec_id % {PER_MODEL}) // {NLON} AS j, vec_id % {PER_MODEL} % {NLON} AS i,
         -90.0 + ((vec_id % {PER_MODEL}) // {NLON} + 0.5) * {DLAT}::DOUBLE AS lat,
         -180.0 + (vec_id % {PER_MODEL} % {NLON}) * {DLON}::DOUBLE AS lon, embedding, label
  FROM embeddings),
cells AS (
  SELECT model, j, i, lat, lon, label, k, k * {DZ_KM}::DOUBLE AS depth_km, embedding[k + 1]::DOUBLE * 10.0::DOUBLE AS anom
  FROM cols, (SELECT unnest(range({NZ})) AS k) AS ks)"""

SITES_SQL = """hotspots AS (
  SELECT s_suppkey AS site, -60.0 + ((s_suppkey * 37) % 1200) / 10.0::DOUBLE AS lat,
         -180.0 + ((s_suppkey * 73) % 3600) / 10.0::DOUBLE AS lon FROM supplier),
nulls AS (
  SELECT c_custkey AS site, -60.0 + ((c_custkey * 37) % 1200) / 10.0::DOUBLE AS lat,
         -180.0 + ((c_custkey * 73) % 3600) / 10.0::DOUBLE AS lon FROM customer),
places AS (
  SELECT kind, lat, lon, count(*) AS n_sites, min(site) AS site
  FROM (SELECT *, 'hotspot' AS kind FROM hotspots UNION ALL SELECT *, 'null' AS kind FROM nulls) AS u
  GROUP BY kind, lat, lon)"""


def arc_sql(a: str, b: str, c: str, d: str) -> str:
    """Great-circle km between (a, b) and (c, d) as SQL text."""
    return (
        f"6371.0::DOUBLE * acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, sin(radians({a})) * sin(radians({c})) "
        f"+ cos(radians({a})) * cos(radians({c})) * cos(radians({b} - {d})))))"
    )


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    """The same distance in the form that is exact for near points."""
    return (
        f"2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians({c}) - radians({a})) / 2), 2) "
        f"+ cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
    )
