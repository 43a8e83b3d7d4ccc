"""The filter cascade: language, role, location, visa, experience, duplicates. The first refusal names the reason.

Every stage is a Column of struct(keep, reason); null input keeps, as does whatever a stage can't judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import Filters
from millrace.functions.dialect import any_in_lowered, any_of, jvm
from millrace.functions import geo
from millrace.functions.keys import fingerprint
from millrace.functions.text import collapse, is_blank, strip_html, strip_noise, trim_control
from millrace.session import stored

#: How years of experience are asked for.
YEARS = (
    r"(\d+)\+?\s*(?:years?|yrs?)\s*(?:of\s+)?(?:[\w-]+\s+){0,2}(?:experience|exp)",
    r"(\d+)\+?\s*(?:years?|yrs?)\s+(?:as|in)\b",
    r"(\d+)\+\s*(?:years?|yrs?)\s*[,;.()]",
)


#: What stands for the country of remote places.
REMOTE = "REMOTE_EU"


def _verdict(reason: Column) -> Column:
    return F.struct(reason.isNull().alias("keep"), reason.alias("reason"))


def _readable(text: Column, least: int) -> Column:
    """Whether so many characters are left without markup, links and images. Without any of these, the first thousand
    characters mostly tell."""
    bare = strip_html(text)
    cleaned = strip_noise(F.when(is_blank(bare), text).otherwise(bare))
    marked = text.contains("<") | text.contains("&") | text.contains("http") | text.contains("](")
    enough = lambda c: F.length(c) >= least
    return F.when(marked, enough(cleaned)).when(enough(collapse(F.left(text, F.lit(1000)))), True).otherwise(enough(collapse(text)))


def strict_match(text: Column, rules: Filters) -> Column:
    """Whether a language demand stands without a softening phrase that begins among the characters before it."""
    soft, demand = any_of(rules.language_soft), any_of(rules.language_exclude)
    return F.coalesce(text.rlike(jvm(rf"(?s)(?={demand})(?<!(?=(?:{soft})).{{1,{rules.soft_window}}})")), F.lit(False))


def language(title: Column, description: Column, lang: Column, rules: Filters, target: str = "en", least: int = 100, confidence: Column | None = None, sure: float = 0.85) -> Column:
    """Strict demands first; then a description in another language, which a column names, if the description is long
    enough as it stands and without markup, links and images, and the language is sure enough where a column says how sure
    it is. Without a description only the title is looked at."""
    names = F.create_map(*[F.lit(x) for x in ("de", "German", "nl", "Dutch", "es", "Spanish", "fr", "French", "sv", "Swedish", "it", "Italian", "pt", "Portuguese", "pl", "Polish")])
    foreign = lang != target if confidence is None else (lang != target) & (confidence >= sure)
    other = F.when(foreign & (F.length(description) >= least) & _readable(description, least), F.concat(F.lit("non-English JD ("), F.coalesce(F.try_element_at(names, lang), lang), F.lit(")")))
    both = F.concat(F.when(title.isNotNull(), F.concat(title, F.lit(" "))).otherwise(""), description)
    with_text = F.when(strict_match(both, rules), "non-English language required").otherwise(other)
    return _verdict(F.when(is_blank(description), F.when(strict_match(title, rules), "non-English title")).otherwise(with_text))


def role(title: Column, rules: Filters) -> Column:
    """Excluded words first, each as a whole word, then included patterns."""
    excluded = title.rlike(jvm(any_of([p if p.startswith(r"\b") else rf"\b{p}\b" for p in rules.role_exclude])))
    included = title.rlike(jvm(any_of(rules.role_include)))
    return _verdict(F.when(is_blank(title), None).when(excluded, "role: excluded").when(~included, "role: not relevant"))


def location(place: Column, rules: Filters, cities: dict[str, tuple[str, ...]] | None = None) -> Column:
    """struct(keep, reason, iso): remote patterns, then the country by names, codes and cities, then the rule for unknown
    places."""
    remote = trim_control(place).rlike(jvm(any_of(rules.remote)))
    unknown = None if rules.unknown_location_kept else "location: not in target locations"

    def judged(iso: Column) -> Column:
        wanted = iso.isin(*[c.upper() for c in rules.target_countries])
        reason = F.when(is_blank(place), "location: blank").when(iso == REMOTE, None).when(wanted, None).when(iso.isNotNull(), F.concat(F.lit("location: "), iso, F.lit(" not a target country"))).otherwise(F.lit(unknown).cast("string"))
        return F.struct(reason.isNull().alias("keep"), reason.alias("reason"), iso.alias("iso"))

    found = F.when(~is_blank(place), F.when(remote, REMOTE).otherwise(geo.resolve(place, cities)))
    return F.transform(F.array(found), judged)[0]  # so that the country is found once


def visa(description: Column, is_aggregator: Column, exempt: Column, rules: Filters) -> Column:
    """struct(keep, reason, status): exempt places aren't looked at; short aggregator texts wait; refusals come first."""
    status = visa_status(description, is_aggregator, exempt, rules)
    return visa_verdict(status, exempt, rules)


def visa_status(description: Column, is_aggregator: Column, exempt: Column, rules: Filters) -> Column:
    return (
        F.when(exempt, "UNKNOWN")
        .when(is_aggregator & (description.isNull() | (F.length(description) < rules.visa_least_chars)), "PENDING")
        .when(any_in_lowered(F.lower(description), rules.visa_negative), "REJECTED")
        .when(any_in_lowered(F.lower(description), rules.visa_positive), "CONFIRMED")
        .otherwise("UNKNOWN")
    )


def visa_verdict(status: Column, exempt: Column, rules: Filters) -> Column:
    unclear = ~exempt & (status == "UNKNOWN") & F.lit(not rules.unclear_visa_kept)
    reason = F.when(status == "REJECTED", "visa: sponsorship refused").when(unclear, "visa: unclear")
    return F.struct(reason.isNull().alias("keep"), reason.alias("reason"), status.alias("status"))


def years(description: Column) -> Column:
    """The most years of experience that any phrase asks for, those above 20 aside."""
    found = F.concat(*[F.regexp_extract_all(description, F.lit(jvm(p)), 1) for p in YEARS])
    return F.array_max(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda n: n <= 20))


def experience(asked: Column, rules: Filters) -> Column:
    return _verdict(F.when(asked > rules.most_years, F.concat(F.lit("requires "), asked.cast("string"), F.lit("+ years experience"))))


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns behind a generator of one row, so that what reads them doesn't repeat how they are made."""
    made = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("_made")
    return df.select("*", made).select(*df.columns, "_made.*")


def cascade(jobs: DataFrame, rules: Filters, duplicates: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Adds decision, reason, visa, yoe, country_iso and fingerprint to jobs (id, title, description, lang, location, company,
    source, is_aggregator, discovered_date; visa_exempt, for sources that only list sponsors, and lang_confidence where
    there are such columns). Of postings that no other stage refuses, those of a named company that repeat an earlier kept
    one are duplicates: own postings of own ones, aggregators' of any. What the other stages
    found is stored for that. The result has those columns of jobs that are named, or all."""
    c = F.col
    confidence = c("lang_confidence") if "lang_confidence" in jobs.columns else None
    listed = F.coalesce(c("visa_exempt"), F.lit(False)) if "visa_exempt" in jobs.columns else F.lit(False)
    jobs = jobs.drop("yoe", "fingerprint", "visa", "reason", "country_iso", "decision")
    staged = _once(jobs, {
        "_language": language(c("title"), c("description"), c("lang"), rules, confidence=confidence)["reason"], "_role": role(c("title"), rules)["reason"], "_location": location(c("location"), rules),
        "yoe": years(c("description")), "fingerprint": fingerprint(c("title"), c("company"), c("location")),
    })
    exempt = listed | F.coalesce(c("_location.iso").isin(*[x.upper() for x in rules.visa_exempt]), F.lit(False))
    staged = _once(staged, {"_exempt": exempt, "visa": visa_status(c("description"), c("is_aggregator"), exempt, rules)})
    reason = F.coalesce(c("_language"), c("_role"), c("_location.reason"), visa_verdict(c("visa"), c("_exempt"), rules)["reason"], experience(c("yoe"), rules)["reason"])
    out = staged.withColumns({"reason": reason, "country_iso": c("_location.iso")}).withColumn("decision", F.when(c("reason").isNull(), "KEEP").otherwise("SKIP"))
    kept = dict.fromkeys([*(columns or jobs.columns), "company", "source", "is_aggregator", "discovered_date", "id"])
    out = out.select(*kept, *[x for x in ("yoe", "fingerprint", "visa", "reason", "country_iso", "decision") if x not in kept])
    if not duplicates:
        return out
    out = stored(jobs.sparkSession, out, "judged")
    repeated = duplicate_of_system(out).withColumn("_twin", F.when(~is_blank(c("company")), c("duplicate_of")))
    twin = c("_twin").isNotNull()
    return repeated.withColumns({"reason": F.when(twin, F.concat(F.lit("duplicate of "), c("_twin"))).otherwise(c("reason")), "decision": F.when(twin, "SKIP").otherwise(c("decision"))}).drop("duplicate_of", "_twin")


def refilter_described(jobs: DataFrame, rules: Filters) -> DataFrame:
    """Judges kept jobs anew whose description came later: language, then experience, then visa where it was pending and the
    country (country_iso, where there is such a column) isn't exempt. A stage that refuses ends it: what later stages would
    find stays as it was. Jobs that still have no description stay as they are."""
    c = F.col
    place = c("country_iso") if "country_iso" in jobs.columns else F.lit(None).cast("string")
    exempt = F.coalesce(place.isin(*[x.upper() for x in rules.visa_exempt]), F.lit(False))
    staged = _once(jobs, {"_language": language(c("title"), c("description"), c("lang"), rules)["reason"], "_asked": years(c("description")), "_status": visa_status(c("description"), F.lit(False), exempt, rules)})
    judged = (c("decision") == "KEEP") & c("description").isNotNull()
    read = judged & c("_language").isNull()
    unasked = experience(c("_asked"), rules)["reason"]
    looked = read & unasked.isNull() & (c("visa") == "PENDING")
    reason = F.coalesce(c("_language"), unasked, F.when(looked, visa_verdict(c("_status"), exempt, rules)["reason"]))
    refused = judged & reason.isNotNull()
    made = {"reason": F.when(refused, reason).otherwise(c("reason")), "decision": F.when(refused, "SKIP").otherwise(c("decision")), "visa": F.when(looked, c("_status")).otherwise(c("visa")), "yoe": F.when(read, c("_asked")).otherwise(c("yoe"))}
    return staged.select(*[made[x].alias(x) if x in made else x for x in jobs.columns])


def duplicate_of_system(jobs: DataFrame) -> DataFrame:
    """Adds duplicate_of: an own posting is a duplicate of the first kept own one of its fingerprint, an aggregator's of
    the first kept one at all. Rows are taken by discovered_date, then id; the first ones come from pre-aggregated minima."""
    kept = F.col("decision") == "KEEP"
    place = F.struct("discovered_date", "id")
    first = F.struct(place.alias("place"), F.col("source").alias("source"))
    firsts = jobs.where(kept).groupBy("fingerprint").agg(F.min(F.when(~F.col("is_aggregator"), first)).alias("_own"), F.min(first).alias("_any"))
    before = F.when(F.col("is_aggregator"), F.col("_any")).otherwise(F.col("_own"))
    found = F.when(kept & (before["place"] < place), before["source"])
    return jobs.join(firsts, "fingerprint", "left").withColumn("duplicate_of", found).drop("_own", "_any")
