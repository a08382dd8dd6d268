"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The host is what stands between the first "://" and the next "/", "?" or "#", with A-Z lower-cased; the
path goes on to "?" or "#". A null url, or one without "://", has an empty host and path. A rule fits
its host and the subdomains below it where the path starts with the rule's path; the longest fitting
rule decides. Where none fits, the model does: character runs of ``GRAM`` of host and path are hashed
apart, and a logistic regression, trained on a small labelled table of urls, blocks from ``THRESHOLD``.

All of it is DataFrame work in the JVM. The labelled table is a parameter; ``labelled_urls`` draws one
from urls that rules judge, at most ``LABELLED`` rows, picked by a hash. With labels of one class only,
or none, the model allows everything. Null urls are allowed when no rule fits, and a null key stays
null. Repeated rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
GRAM = 3
BUCKETS = 1 << 14
THRESHOLD = 0.5
#: Rows of the labelled table at most.
LABELLED = 4000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct of rule text and verdict of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: Column, path: Column, n: int = GRAM) -> Column:
    """Character runs of host and of path, marked by where they are from."""

    def of(text: Column, mark: str) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(framed) - n + 1))
        return F.transform(places, lambda i: F.concat(F.lit(mark), framed.substr(i, F.lit(n))))

    return F.concat(of(host, "h"), of(path, "p"))


def parsed(df: DataFrame, key: str, url: str, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    base = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    base = base.select("_key", host.alias("host"), path.alias("path"))
    return base.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))


def labelled_urls(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, rows: int = LABELLED) -> DataFrame:
    """A small table (host, path, label) of distinct urls that the rules judge; label 1 is block."""
    judged = parsed(df.select(url), url, url, rules).filter("_fit is not null")
    judged = judged.select("host", "path", (F.col("_fit.verdict") == "block").cast("double").alias("label")).distinct()
    return judged.orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows)


def hashed(df: DataFrame) -> DataFrame:
    df = df.withColumn("_grams", grams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_grams", outputCol="_features").transform(df).drop("_grams")


def fit(labelled: DataFrame) -> LogisticRegressionModel | None:
    """A model of ``labelled`` (host, path, label), or None unless both classes are there."""
    table = hashed(labelled)
    if labelled.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.01, maxIter=30, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r").fit(table)


def judge_urls(
    df: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES
) -> DataFrame:
    """One row per row of ``df``: key, host, path, the deciding rule or null, verdict, model score."""
    rows = parsed(df, key, url, rules)
    model = fit(labelled)
    if model is None:
        scored = rows.withColumn("_score", F.lit(0.0))
    else:
        scored = model.transform(hashed(rows)).withColumn("_score", F.round(vector_to_array("_p")[1], 9))
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(F.col("_score") >= THRESHOLD, "block").otherwise("allow"))
    return scored.select(F.col("_key").alias(key), "host", "path", F.col("_fit.rule").alias("rule"), verdict.alias("verdict"), F.col("_score").alias("score"))
