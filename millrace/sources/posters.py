"""Who posted a job: for each system paths into its JSON, then patterns on its page, with the source of what was found."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null, trim_control

#: Words and marks that stand before names, roles and pictures on the systems' pages.
_PROFILE = r"https?://(?:www\.)?linkedin\.com/in/[A-Za-z0-9_-]+/?"
_NAME, _CASED_NAME = r"[a-z]+(?:\s+[a-z]+){1,2}", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}"
_GREENHOUSE_LABELS, _GREENHOUSE_SECOND, _LEVER_LABELS = r"(?:posted\s+by|recruiter|hiring\s+manager|contact)", r"(?:recruiter|hiring\s+manager|posted\s+by)", r"(?:posted\s+by|hiring\s+manager|owner)"
_WIDGET_ROLE, _WIDGET_PICTURE = "(?:recruiter-title|job-poster-title|poster-role)", "(?:recruiter|poster)"
_SECTION = r"""(?:class=["'][^"']*recruiter[^"']*["']|data-controller=["']recruiter["'])[^>]*>(.*?)</(?:div|section)>"""

FIELDS = ("name", "title", "profile_url", "picture_url")


def _none() -> Column:
    return F.lit(None).cast("string")


def _poster(name: Column, title: Column | None = None, profile: Column | None = None, picture: Column | None = None, source: str = "JSON") -> Column:
    """A poster, or null without a name."""
    values = [_none() if c is None else blank_to_null(c) for c in (name, title, profile, picture)]
    return F.when(values[0].isNotNull(), F.struct(*[v.alias(f) for v, f in zip(values, FIELDS, strict=True)], F.lit(source).alias("source")))


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(trim_control(F.regexp_extract(text, pattern, group)), F.lit(""))


def _first(*found: Column) -> Column:
    return F.coalesce(*found)


def _at(json: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(json, path, kind)


def _text(json: Column, path: str) -> Column:
    """A path's text; numbers, objects and the like are none."""
    found = F.try_variant_get(json, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", _at(json, path))


def _person(json: Column, path: str, title: str = "title", profile: str | None = None, pictures: tuple[str, ...] = (), split_name: bool = False) -> Column:
    """The person at a path: the name, or the first and the last one."""
    at = lambda field: blank_to_null(_text(json, f"{path}.{field}"))
    name = _first(at("name"), F.concat(at("firstName"), F.lit(" "), at("lastName"))) if split_name else at("name")
    return _poster(name, at(title) if title else None, at(profile) if profile else None, _first(*map(at, pictures)) if pictures else None)


def _member(json: Column, path: str, wanted: Callable[[Column], Column], made: Callable[[Column], Column]) -> Column:
    """The first member of the array at a path that is wanted."""
    members = _at(json, path, "array<variant>")
    return made(F.try_element_at(F.filter(members, wanted), F.lit(1)))


def _greenhouse(json: Column, html: Column) -> Column:
    has = lambda m: blank_to_null(_text(m, "$.name")).isNotNull()
    team = _member(json, "$.hiring_team", has, lambda m: _poster(_text(m, "$.name"), _text(m, "$.title"), _text(m, "$.linkedin_url")))
    hiring = lambda m: F.lower(_text(m, "$.name")).contains("hiring") & blank_to_null(_text(m, "$.value")).isNotNull()
    noted = _member(json, "$.metadata", hiring, lambda m: _poster(_text(m, "$.value")))
    label = rf"(?i:{_GREENHOUSE_LABELS})[:\s]+(?:(?i:{_GREENHOUSE_SECOND})[:\s]+)?((?-i:[A-Z])(?i:[a-z]+)(?:\s+(?-i:[A-Z])(?i:[a-z]+)){{1,2}})"
    return _first(team, noted, _poster(_group(html, label), profile=_group(html, _PROFILE, 0), source="PAGE"))


def _smart(json: Column, html: Column) -> Column:
    people = [_person(json, f"$.{k}", pictures=("avatarUrl",), split_name=True) for k in ("creator", "recruiter", "postingOwner")]
    name = rf"""(?i)class=["'][^"']*recruiter[^"']*["'][^>]*>\s*(?:<[^>]+>)*\s*({_NAME})"""
    picture = rf"""(?i){_WIDGET_PICTURE}[^>]*(?:src|background-image)[=:\s"']*(?:url\()?["']?(https?://[^"'\s)]+)"""
    page = _poster(_group(html, name), _group(html, rf"""(?i){_WIDGET_ROLE}["'][^>]*>\s*([^<]+)"""), _group(html, _PROFILE, 0), _group(html, picture), "PAGE")
    return _first(*people, page)


def _teamtailor(json: Column, html: Column) -> Column:
    section = F.coalesce(F.nullif(F.regexp_extract(html, f"(?is){_SECTION}", 1), F.lit("")), html)
    name = rf"(?i)<(?:h[2-4]|span|p|strong)[^>]*>\s*({_NAME})\s*</"
    page = _poster(_group(section, name), _group(section, r"""(?i)(?:title|role|position)["'][^>]*>\s*([^<]+)"""), _group(section, _PROFILE, 0), _group(section, r"""(?i)<img[^>]+src=["']([^"']+)["']"""), "PAGE")
    return _first(_person(json, "$.recruiter", profile="linkedin", pictures=("picture", "avatar")), page)


def _ashby(json: Column, html: Column) -> Column:
    has = lambda m: blank_to_null(_text(m, "$.name")).isNotNull()
    made = lambda m: _poster(_text(m, "$.name"), _text(m, "$.title"), _text(m, "$.linkedinUrl"), _text(m, "$.photoUrl"))
    people = [_person(json, f"$.{k}", profile="linkedinUrl", pictures=("photoUrl",)) for k in ("recruiter", "hiringManager", "owner")]
    return _first(_member(json, "$.hiringTeam", has, made), *people, _member(json, "$.jobPosting.hiringTeam", has, made))


def _lever(json: Column, html: Column) -> Column:
    people = [_first(_poster(_text(json, f"$.{k}")), _person(json, f"$.{k}", title="")) for k in ("owner", "creator", "hiringManager")]
    page = _poster(_group(html, rf"(?i){_LEVER_LABELS}[:\s]*({_NAME})"), _group(html, r"""(?i)(?:title|role)[:\s"]*([A-Z][A-Za-z0-9_\s,]+?)["<\n]"""), _group(html, _PROFILE, 0), source="PAGE")
    return _first(*people, page)


#: The extractor of each system, from its JSON (a variant) and its page.
EXTRACTORS: dict[str, Callable[[Column, Column], Column]] = {"GREENHOUSE": _greenhouse, "SMARTRECRUITERS": _smart, "TEAMTAILOR": _teamtailor, "ASHBY": _ashby, "LEVER": _lever, "LEVER_EU": _lever}


def poster(system: Column, json: Column, html: Column) -> Column:
    """struct(name, title, profile_url, picture_url, source) of a posting's poster, from its system's JSON text, else its page;
    null where neither names one, the system is unknown or the JSON is no object and there is no page."""
    parsed = F.try_parse_json(json)
    return reduce(lambda out, kv: out.when(system == kv[0], kv[1](parsed, html)), list(EXTRACTORS.items())[1:], F.when(system == "GREENHOUSE", _greenhouse(parsed, html)))
