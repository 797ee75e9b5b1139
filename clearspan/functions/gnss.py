"""GNSS sentences (RMC, GGA, GSA, BESTPOSA) parsed with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checksum(sentence: Column) -> Column:
    """The XOR of the characters between '$' and '*', as two hexadecimal digits."""
    body = F.regexp_extract(sentence, r"^\$([^*]*)\*", 1)
    codes = F.transform(F.split(body, ""), lambda c: F.ascii(c))
    return F.lpad(F.hex(F.aggregate(codes, F.lit(0), lambda a, c: a.bitwiseXOR(c))), 2, "0")


def checksum_ok(sentence: Column) -> Column:
    return F.upper(F.regexp_extract(sentence, r"\*([0-9A-Fa-f]{2})\s*$", 1)) == checksum(sentence)


def degrees_of(field: Column) -> Column:
    """ddmm.mmmm or dddmm.mmmm in degrees; hemispheres are another field and take no part."""
    number = field.try_cast("double")
    return F.floor(number / 100) + F.pmod(number, F.lit(100.0)) / 60


def parse_sentences(lines: DataFrame, column: str = "line") -> DataFrame:
    """lines with kind, ok and one struct for each kind. RMC: time, validity, speed in knots, date. GGA: lat, lon, state,
    satellites, hdop, height. GSA: pdop. BESTPOSA has no checksum to check: lat, lon and height sigma, 0 if missing."""
    fields = F.split(F.regexp_replace(F.col(column), r"\*[^*]*$", ""), "[,;]")
    at = lambda i: F.nullif(F.get(F.col("__f"), F.lit(i)), F.lit(""))
    number = lambda i: at(i).try_cast("double")
    head = F.get(F.col("__f"), F.lit(0))
    kind = F.when(head.endswith("RMC"), "RMC").when(head.endswith("GGA"), "GGA").when(head.endswith("GSA"), "GSA").when(head.contains("BESTPOSA"), "BESTPOSA").otherwise("OTHER")
    zero = lambda i: F.coalesce(number(i), F.lit(0.0))
    out = lines.withColumn("__f", fields).withColumn("kind", kind).withColumn("ok", (F.col("kind") == "BESTPOSA") | checksum_ok(F.col(column)))
    return out.withColumns({
        "rmc": F.when((F.col("kind") == "RMC") & F.col("ok"), F.struct(at(1).alias("time"), at(2).alias("validity"), number(7).alias("speed_knots"), at(9).alias("date"))),
        "gga": F.when((F.col("kind") == "GGA") & F.col("ok"), F.struct(degrees_of(at(2)).alias("lat"), degrees_of(at(4)).alias("lon"), F.coalesce(at(6).try_cast("int"), F.lit(0)).alias("state"), F.coalesce(at(7).try_cast("int"), F.lit(0)).alias("satellites"), zero(8).alias("hdop"), number(9).alias("height"))),
        "gsa": F.when((F.col("kind") == "GSA") & F.col("ok"), F.struct(zero(15).alias("pdop"))),
        "bestpos": F.when(F.col("kind") == "BESTPOSA", F.struct(zero(17).alias("lat_sigma"), zero(18).alias("lon_sigma"), zero(19).alias("height_sigma"))),
    }).drop("__f")


def sentence_counters(parsed: DataFrame) -> DataFrame:
    """How many sentences of each kind, and how many of them fail their checksum."""
    return parsed.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(~F.col("ok"), 1)).alias("bad"))


def state_fold(parsed: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with the latest value of every kind of sentence so far."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return parsed.withColumns({k: F.last(k, ignorenulls=True).over(w) for k in ("rmc", "gga", "gsa", "bestpos")})
