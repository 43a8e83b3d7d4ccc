"""Locations resolved over a table of cities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import geo
from millrace.functions.text import is_blank


def city_codes(cities: DataFrame) -> DataFrame:
    """city (lower-cased) and the code that stands for it, from rows (city, iso, nth); a city of several countries gets the one
    that geo.best_code takes from its codes in order of nth."""
    rows = cities.where(~is_blank(F.col("city")) & ~is_blank(F.col("iso")))
    codes = F.transform(F.array_sort(F.collect_set(F.struct("nth", F.upper(F.trim("iso")).alias("iso")))), lambda x: x["iso"])
    return rows.groupBy(F.lower(F.trim("city")).alias("city")).agg(codes.alias("codes")).select("city", geo.best_code(F.col("codes")).alias("iso"))


def resolve_places(rows: DataFrame, location: str, cities: DataFrame, home: tuple[str, ...] = (), iso: str = "iso") -> DataFrame:
    """rows with the code of their location's country: the one it names itself, else that of the first candidate that is a
    city of the table (city, iso, nth), which may be large: it is joined, and Spark broadcasts it only where it is small. Each
    distinct location is resolved once; blank and unknown ones have none."""
    # a place is as long as its text is: what meets the cities, and the rows afterwards, is its 128-bit name
    name = lambda c: F.unhex(F.md5(c))
    distinct = rows.where(~is_blank(F.col(location))).select(F.col(location).alias("_place")).distinct()
    named = distinct.select("_place", name("_place").alias("_id"), geo.explicit(F.col("_place"), home).alias("_iso"))
    # a place that names its country asks for no city, under a key of its own
    asked = F.when(F.col("_iso").isNull(), geo.city_candidates(F.col("_place"))).otherwise(F.array(F.concat(F.lit("\0"), F.hex("_id"))))
    candidates = named.select("_id", "_iso", F.posexplode(asked).alias("_nth", "city"))
    codes = city_codes(cities).withColumnRenamed("iso", "_code")
    first = F.min(F.when(F.col("_code").isNotNull(), F.struct("_nth", "_code")))["_code"]
    resolved = candidates.join(codes, "city", "left").groupBy("_id").agg(F.coalesce(F.max("_iso"), first).alias(iso)).where(F.col(iso).isNotNull())
    return rows.join(resolved, name(rows[location]) == resolved["_id"], "left").drop("_id")
