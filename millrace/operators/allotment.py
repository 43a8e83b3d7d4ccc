"""A daily allotment: of each day's candidates the first few pass, and what passes closes its contact for some days."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import ship

#: Connections a day, days that a contact stays closed, and texts a day that a model is asked about.
CONNECTIONS, COOLDOWN, QUESTIONS = 5, 7, 50
_SALTS = 16


def _heads(candidates: DataFrame, gate: str, contact: str, order: list[str], most: int) -> DataFrame:
    """The first distinct contacts of each gate and day, as many as most: groups of a day rank their own before they meet."""
    ranked = F.struct(*order)
    first = candidates.groupBy(gate, "day", contact).agg(F.min(ranked).alias("_first"))
    salted = first.withColumn("_salt", F.pmod(F.xxhash64(contact), F.lit(_SALTS)))
    own = salted.withColumn("_r", F.row_number().over(W.partitionBy(gate, "day", "_salt").orderBy("_first", contact))).where(F.col("_r") <= most)
    return own.withColumn("_r", F.row_number().over(W.partitionBy(gate, "day").orderBy("_first", contact))).where(F.col("_r") <= most).select(gate, "day", contact, "_first", "_r")


def allot(candidates: DataFrame, gate: str, contact: str, order: list[str], limit: int = CONNECTIONS, cooldown: int = COOLDOWN) -> DataFrame:
    """candidates (gate, day, contact and the order columns, which tell them apart) with outcome: `passed`, `closed` while the
    contact's last pass is less than cooldown days old (on the same day too), or `limit`.

    Days depend on those before, but not on much of them: at most limit contacts pass in a day, so at most limit * cooldown
    are closed at any time, and who passes stands among the day's first limit * (cooldown + 1) contacts. Those are found in
    parallel; only they are scanned in the order of days, by one task for each gate, which keeps the closed contacts as its state.
    Every candidate then looks up its contact's passes. Rows without a contact pass by the limit alone, each a contact of its
    own; rows without a day have no outcome."""
    ship(candidates.sparkSession)
    named = "_who"
    rows = candidates.withColumn(named, F.coalesce(F.col(contact).cast("string"), F.concat(F.lit("\x00"), F.to_json(F.struct(*order)))))
    heads = _heads(rows.where("day IS NOT NULL"), gate, named, order, limit * (cooldown + 1))
    kinds = candidates.schema
    passes = f"{gate} {kinds[gate].dataType.simpleString()}, day date, {named} string"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, today, left, closed = None, None, 0, {}
        for batch in batches:
            out = []
            for at, day, who in batch.itertuples(index=False, name=None):
                if (at, day) != (own, today):
                    closed = {w: d for w, d in closed.items() if (day - d).days < cooldown} if at == own else {}
                    own, today, left = at, day, limit
                if left and who not in closed:
                    left -= 1
                    closed[who] = day
                    out.append((at, day, who))
            yield pd.DataFrame(out, columns=[gate, "day", named])

    ordered = heads.repartition(gate).sortWithinPartitions(gate, "day", "_r").select(gate, "day", named)
    passed = ordered.mapInPandas(scan, passes)
    # a pass closes its contact on its own day and the days after it
    closing = passed.select(F.col(gate).alias("_gate"), F.col(named).alias("_passer"), F.col("day").alias("_pass"), F.explode(F.sequence("day", F.date_add("day", max(cooldown, 1) - 1))).alias("_day"))
    last = closing.groupBy("_gate", "_passer", "_day").agg(F.max("_pass").alias("_pass"))
    joined = rows.join(last, rows[gate].eqNullSafe(F.col("_gate")) & (rows[named] == F.col("_passer")) & (rows["day"] == F.col("_day")), "left")
    first = rows.where("day IS NOT NULL").groupBy(gate, "day", named).agg(F.min(F.struct(*order)).alias("_first"))
    first = first.select(F.col(gate).alias("_g"), F.col("day").alias("_d"), F.col(named).alias("_w"), "_first")
    marked = joined.join(first, joined[gate].eqNullSafe(F.col("_g")) & (joined["day"] == F.col("_d")) & (joined[named] == F.col("_w")), "left")
    outcome = F.when(F.col("day").isNull(), None).when((F.col("_pass") == F.col("day")) & (F.struct(*order) == F.col("_first")), "passed").when(F.col("_pass").isNotNull(), "closed").otherwise("limit")
    return marked.withColumn("outcome", outcome).drop("_gate", "_passer", "_day", "_pass", "_g", "_d", "_w", "_first", named)


def question_verdict(reply: Column) -> Column:
    """struct(visa, confidence, reason) of a model's reply: yes and no decide, anything else doesn't."""
    said = F.lower(F.btrim(reply, F.lit("".join(map(chr, [*range(9, 14), 32])))))
    blank = reply.isNull() | (said == "")
    visa = F.when(said == "yes", "CONFIRMED").when(said == "no", "REJECTED").otherwise("UNKNOWN")
    reason = F.when(blank, "no reply").when(said == "yes", "the model found sponsorship").when(said == "no", "the model found none").otherwise(F.concat(F.lit("unclear reply: "), said))
    return F.struct(visa.alias("visa"), F.when(visa == "UNKNOWN", 0.0).otherwise(0.7).alias("confidence"), reason.alias("reason"))


def ask_by_day(rows: DataFrame, order: list[str], reply: str, enabled: bool = True, limit: int = QUESTIONS) -> DataFrame:
    """rows (day, the order columns, which tell them apart, and the model's reply) with visa, confidence and reason: the first
    of each day up to the limit are asked, the others stay unknown."""
    first = _heads(rows.withColumn("_gate", F.lit(0)).withColumn("_id", F.struct(*order)), "_gate", "_id", order, limit if enabled else 0)
    asked = first.select(F.col("day").alias("_day"), F.col("_first").alias("_order"))
    joined = rows.join(asked, (rows["day"] == F.col("_day")) & (F.struct(*[rows[c] for c in order]) == F.col("_order")), "left")
    none = F.struct(F.lit("UNKNOWN").alias("visa"), F.lit(0.0).alias("confidence"), F.lit("daily limit reached" if enabled else "not asked").alias("reason"))
    return joined.withColumn("_v", F.when(F.col("_day").isNotNull(), question_verdict(F.col(reply))).otherwise(none)).select(*rows.columns, "_v.visa", "_v.confidence", "_v.reason")


