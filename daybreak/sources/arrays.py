"""Files that hold one JSON array each, cut into elements by as many tasks as the bytes need.

Spark's text reader splits a file at closing braces, by byte ranges, so no task reads a file whole. Whether a piece starts inside
a string and how deep it lies follow from sums over the pieces before it: of quotes that aren't escaped, and of brackets outside
strings. A record ends with the brace that leads back to the array itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.operators.ordered import joined, running
from daybreak.tables import remove, stored

CLOSE = "}"
PLACE = ["file", "part", "seat"]


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _climb(text: Column) -> Column:
    """How much deeper a text ends than it starts, closing braces apart; strings don't count."""
    outside = F.regexp_replace(text, r'"[^"]*+"?', "")
    return (_count(outside, "{[") - _count(outside, "]")).cast("long")


def elements(pieces: DataFrame) -> DataFrame:
    """(file, part, seat, value) texts between closing braces, in order of part and seat: (file, record, spot, payload) of each element, in order of record and spot.

    An element that isn't an object is in the record of the next object. A string is given as its value, null as null. A file
    that isn't one whole array is an error; a file without pieces has no elements. One element is one row, of 2 GB at most.
    """
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    head = F.regexp_extract("value", r"^[\s﻿]*(\S)", 1)
    pieces = stored(pieces.select(*PLACE, "value", head.alias("head"), _count(plain, '"').cast("long").alias("quotes"), _climb(plain).alias("from_outside"), _climb(F.concat(F.lit('"'), plain)).alias("from_inside")), "pieces")

    quoted = stored(running(pieces.drop("value"), ["file"], {"quotes_to": F.col("quotes")}), "quotes")
    within = F.col("quotes_to") % 2 == 1
    climb = F.when((F.col("quotes_to") - F.col("quotes")) % 2 == 1, F.col("from_inside")).otherwise(F.col("from_outside"))
    steps = quoted.select(*PLACE, "head", within.alias("within"), (climb - F.when(within, 0).otherwise(1)).alias("step"))
    depths = stored(running(steps, ["file"], {"depth": F.col("step")}), "depths")
    remove(quoted)

    # no brace follows the last piece of a whole array, so the one counted there leads from depth 0 to -1
    at = F.struct("part", "seat")
    ends = depths.groupBy("file").agg(F.min_by("head", at).alias("head"), F.max_by("depth", at).alias("depth"), F.max_by("within", at).alias("within"))
    broken = ends.where((F.col("head") != "[") | (F.col("depth") != -1) | F.col("within")).select(F.min("file")).first()[0]
    if broken is not None:
        remove(pieces, depths)
        raise ValueError(f"{broken} is not a JSON array")

    closes = depths.select(*PLACE, (~F.col("within") & (F.col("depth") == 1)).alias("closes"))
    numbered = running(closes, ["file"], {"record": F.col("closes").cast("long")}).withColumn("record", F.col("record") - F.col("closes").cast("long"))
    whole = joined(numbered, pieces.select(*PLACE, "value"), PLACE).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("part", "seat", "value"))).alias("texts"), F.max("closes").alias("closed"))
    text = F.array_join(F.transform("texts", lambda t: t.value), CLOSE)
    body = F.when(F.col("closed"), F.concat(text, F.lit(CLOSE))).otherwise(F.regexp_replace(text, r"\]\s*\z", ""))
    listed = F.concat(F.lit("["), F.regexp_replace(body, r"^[\s﻿]*[\[,]", ""), F.lit("]"))
    out = stored(whole.select("file", "record", F.posexplode(F.from_json(listed, "array<string>", {"mode": "FAILFAST"})).alias("spot", "payload")), "elements")
    remove(pieces, depths)
    return out


def read_array(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, record, spot, payload) of the elements of JSON arrays, one array a file; a stored table, which the caller may remove."""
    text = spark.read.option("lineSep", CLOSE).text(list(paths))
    return elements(text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("seat"), "value"))
