"""Names that hold one another, found through an index of their character runs instead of a comparison of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.text import is_blank, trim_control
from millrace.session import stored

#: Characters of a run.
RUN = 3
#: Bytes of asking names up to which they are broadcast.
MOST_SENT = 1 << 24


def _runs(name: Column, n: int) -> Column:
    """The distinct runs of n characters of a name, read in one pass; none if it is shorter."""
    return F.array_distinct(F.regexp_extract_all(name, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def _pieces(name: Column, n: int) -> Column:
    """The distinct runs of 1 to n characters of a name, read in one pass: the shorter ones begin those of n, or end the name."""
    most = F.array_distinct(F.regexp_extract_all(name, F.lit(f"(?s)(?=(.{{1,{n}}}))"), 1))
    return F.array_distinct(F.flatten(F.transform(most, lambda r: F.array(*[F.left(r, F.lit(k)) for k in range(1, n + 1)]))))


def _distinct(df: DataFrame, name: str) -> tuple[DataFrame, int | None]:
    """The distinct names with their rows counted, stored, and the length of the longest."""
    found = df.where(~is_blank(F.col(name))).groupBy(F.lower(trim_control(F.col(name))).alias("name")).agg(F.count("*").alias("n"))
    seen = Observation()
    names = stored(df.sparkSession, found.observe(seen, F.max(F.length("name")).alias("longest")), "names")
    return names, seen.get["longest"]


def _id(name: str) -> Column:
    return F.unhex(F.md5(name)).alias("id")


def _inside(inner: DataFrame, outer: DataFrame, longest: int | None, run: int, most_sent: int) -> DataFrame:
    """The pairs (inner, outer) of distinct names of which the second holds the first, with their counts n_inner and n_outer.
    longest: the length of the longest outer name."""
    spark, name = outer.sparkSession, F.col("name")
    whole = _runs(name, run)
    pieces = _pieces(name, run)
    counts = outer.select(F.explode(pieces).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    fitting = inner.where(F.length("name") <= F.lit(longest))
    asks = fitting.select(_id("name"), F.explode(F.when(F.length("name") >= run, whole).otherwise(F.array("name"))).alias("run"))
    rarest = asks.join(counts, "run", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("least")).where("least.n > 0")
    asked = stored(spark, fitting.select(_id("name"), name.alias("inner"), F.col("n").alias("n_inner")).join(rarest, "id").select("id", "inner", "n_inner", F.col("least.run").alias("run")), "asked")
    if (asked.agg(F.sum(F.octet_length("inner") + 100)).first()[0] or 0) <= most_sent:
        found = outer.select("name", F.col("n").alias("n_outer"), F.explode(pieces).alias("run")).join(F.broadcast(asked), "run")
    else:  # names are long and runs many: only ids meet by runs
        index = outer.select(_id("name").alias("outer_id"), F.explode(pieces).alias("run"))
        met = index.join(asked.select("id", "run"), "run").select("id", "outer_id")
        found = met.join(asked.select("id", "inner", "n_inner"), "id").join(outer.select(_id("name").alias("outer_id"), "name", F.col("n").alias("n_outer")), "outer_id")
    return found.where(F.contains(name, F.col("inner"))).select("inner", "n_inner", name.alias("outer"), "n_outer")


def containing_names(left: DataFrame, right: DataFrame, left_name: str, right_name: str, run: int = RUN, most_sent: int = MOST_SENT, counted: tuple[str, str] | None = None) -> DataFrame:
    """The pairs (left_name, right_name) of distinct names, lower-cased and trimmed, of which one holds the other.

    What a name holds has all of the name's runs. So each name asks for its rarest run on the other side only, and a join on that
    run fetches the names to look at; a name shorter than a run is its own run, and one with a run that the other side lacks, or
    longer than all there, asks for nothing. The asking names are stored: up to most_sent bytes they are sent to the other side's
    names, so that none of these is repeated for its runs; beyond that only 128-bit ids are. Names are made distinct before, so
    that one that stands in a third of the rows is looked at once, and stored, so that left and right are read once. Null and
    blank names hold nothing; equal names hold each other. counted: names of two more columns, how many rows of left and of right
    have the names of a pair."""
    (a, a_longest), (b, b_longest) = _distinct(left, left_name), _distinct(right, right_name)
    held = _inside(a, b, b_longest, run, most_sent)
    longer = _inside(b, a, a_longest, run, most_sent).where("inner <> outer")
    columns = [left_name, right_name, *(counted or ())]
    pairs = [p.select(*[F.col(c).alias(x) for c, x in zip(of, columns, strict=False)]) for p, of in ((held, ("inner", "outer", "n_inner", "n_outer")), (longer, ("outer", "inner", "n_outer", "n_inner")))]
    return pairs[0].union(pairs[1])


def containment_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str, run: int = RUN, keep_unnamed: bool = False) -> DataFrame:
    """The rows of left and right whose names hold one another; their other columns must have different names. With
    keep_unnamed, rows of right without a name stay, without a partner."""
    pairs = containing_names(left, right, left_name, right_name, run).select(F.col(left_name).alias("_left"), F.col(right_name).alias("_right"))
    low = lambda c: F.lower(trim_control(F.col(c)))
    met = right.withColumn("_right", low(right_name)).join(pairs, "_right").join(left.withColumn("_left", low(left_name)), "_left").drop("_left", "_right")
    return met.unionByName(right.where(is_blank(F.col(right_name))), allowMissingColumns=True) if keep_unnamed else met
