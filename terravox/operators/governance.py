"""Provenance, freshness, audit and resume as joins on small governance tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: clock tolerance in seconds between an output and its inputs.
TOLERANCE_S = 2


def stamp(outputs: DataFrame, **settings) -> DataFrame:
    """Provenance rows: what was written, when, under which settings and with their checksum."""
    s = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(settings.items())]))
    return outputs.select("name", F.current_timestamp().alias("stamped_at"), s.alias("settings"), F.sha2(s, 256).alias("settings_sha"))


def verdicts(outputs: DataFrame, inputs: DataFrame, stamps: DataFrame) -> DataFrame:
    """``ok``, ``unstamped``, ``stale`` or ``config mismatch`` per output.

    outputs: name, written, settings_sha; inputs: name, changed; stamps: name, settings_sha.
    """
    newest = inputs.groupBy("name").agg(F.max("changed").alias("changed"))
    j = outputs.join(stamps.select("name", F.col("settings_sha").alias("stamped")), "name", "left").join(newest, "name", "left")
    late = F.coalesce(F.col("changed") > F.col("written") + F.expr(f"INTERVAL {TOLERANCE_S} SECONDS"), F.lit(False))
    v = F.when(F.col("stamped").isNull(), "unstamped").when(F.col("stamped") != F.col("settings_sha"), "config mismatch").when(late, "stale").otherwise("ok")
    return j.select("name", v.alias("verdict"))


def require(verdict: DataFrame) -> DataFrame:
    """The same rows, or an error naming the first output that is not ok."""
    stop = F.raise_error(F.concat(F.col("name").cast("string"), F.lit(" is "), F.col("verdict"))).cast("string")
    return verdict.withColumn("verdict", F.when(F.col("verdict") == "ok", F.col("verdict")).otherwise(stop))


def fresh(files: DataFrame, since: Column, excused: list[str]) -> DataFrame:
    """Files older than what they depend on, unless their name starts with an excused prefix."""
    out = F.lit(False)
    for p in excused:
        out = out | F.col("name").startswith(p)
    return files.withColumn("verdict", F.when(F.col("changed") >= since, "fresh").when(out, "excused").otherwise("old"))


def audit(expected: DataFrame, computed: DataFrame, retired: list[str]) -> DataFrame:
    """Quoted values against computed ones: a missing value fails, retired labels are skipped.

    expected: label, quoted, tol; computed: label, value.
    """
    kept = expected.filter(~F.col("label").isin(retired)) if retired else expected
    j = kept.join(computed, "label", "left")
    ok = F.coalesce(F.abs(F.col("value") - F.col("quoted")) <= F.col("tol"), F.lit(False)) & ~F.coalesce(F.isnan("value"), F.lit(False))
    return j.select("label", "quoted", "value", ok.alias("ok"))


def remaining(cases: DataFrame, done: DataFrame, keys: list[str], settings: str = "settings_sha") -> DataFrame:
    """Cases still to run. Results made under other settings stop the run instead of mixing in."""
    mixed = done.join(cases.select(settings).distinct(), settings, "left_anti")
    if not mixed.isEmpty():
        raise ValueError("finished cases were made under different settings")
    return cases.join(done.select(*keys), keys, "left_anti")


# ---- frozen configurations --------------------------------------------------------------------------

CHECKSUM = "checksum"


def table_digest(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order, from one aggregate over it.

    Rows are digested on their own; their 64-bit parts are added up, so equal rows count as often as they occur.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * n, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{n}") for n in range(4)]
    seen = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    text = json.dumps([sorted(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields), *[str(x) for x in seen]])
    return hashlib.sha256(text.encode()).hexdigest()


def _seal(document: dict) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True).encode()).hexdigest()


def freeze(spark: SparkSession, path: str, settings: dict, chosen_on: str, inputs: dict[str, DataFrame]) -> dict:
    """Write settings once, with what they were chosen on, the digests of the inputs and a checksum.

    A path that is taken is refused: a frozen configuration is replaced under a new name, never changed.
    """
    document = {"settings": settings, "chosen_on": chosen_on, "inputs": {n: table_digest(df) for n, df in sorted(inputs.items())}}
    sealed = {**document, CHECKSUM: _seal(document)}
    spark.createDataFrame([(json.dumps(sealed, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(path)
    return sealed


def thaw(spark: SparkSession, path: str, used_on: str, inputs: dict[str, DataFrame]) -> dict:
    """The settings of a frozen document, or an error if it was edited, belongs to another model, or its
    inputs are not what they were."""
    held = json.loads("".join(r.value for r in spark.read.text(path).collect()))  # one short document
    document = {k: v for k, v in held.items() if k != CHECKSUM}
    if held.get(CHECKSUM) != _seal(document):
        raise ValueError("edited: the configuration is not what was frozen")
    if document["chosen_on"] != used_on:
        raise ValueError("other model: a configuration holds for what it was chosen on")
    now = {n: table_digest(df) for n, df in sorted(inputs.items())}
    if now != document["inputs"]:
        raise ValueError("inputs: " + ", ".join(sorted(n for n in {*now, *document["inputs"]} if now.get(n) != document["inputs"].get(n))) + " changed since the freeze")
    return document["settings"]
