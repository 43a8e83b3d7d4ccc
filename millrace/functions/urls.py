"""Which applicant tracking system a URL or page belongs to, and parts of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (system, pattern over the whole URL, whether the first group is the company's name there), in order.
URL_PATTERNS = (
    ("GREENHOUSE", r"https?://boards(?:-api)?\.greenhouse\.io/(?:v1/boards/)?([\w-]+).*", True),
    ("LEVER_EU", r"https?://jobs\.eu\.lever\.co/([\w-]+).*", True),
    ("LEVER", r"https?://jobs\.lever\.co/([\w-]+).*", True),
    ("ASHBY", r"https?://jobs\.ashbyhq\.com/([\w-]+).*", True),
    ("WORKDAY", r"https?://[\w-]+\.wd\d+\.myworkdayjobs\.com.*", False),
    ("STEPSTONE", r"https?://www\.stepstone\.(de|at|nl|be)/.*", True),
    ("PINPOINT", r"https?://[\w-]+\.pinpointhq\.com.*", False),
    ("GREENHOUSE", r"https?://(?!boards)([\w-]+)\.greenhouse\.io.*", True),
)


def system_from_url(url: Column) -> Column:
    """struct(ats, slug) of the first pattern that matches the whole URL, or null."""
    out = None
    for ats, pattern, named in URL_PATTERNS:
        whole = f"^(?:{pattern})$"
        slug = F.regexp_extract(url, whole, 1) if named else F.lit(None).cast("string")
        value = F.struct(F.lit(ats).alias("ats"), slug.alias("slug"))
        out = F.when(url.rlike(whole), value) if out is None else out.when(url.rlike(whole), value)
    return out


#: Fixed values: (system, pattern that is looked for anywhere in a URL), in order; then parameters of its query.
FIND_PATTERNS = (
    ("GREENHOUSE", r"https?://boards(?:-api)?\.greenhouse\.io/(?:v1/boards/)?[A-Za-z0-9_-]+"), ("LEVER_EU", r"https?://jobs\.eu\.lever\.co/[A-Za-z0-9_-]+"), ("LEVER", r"https?://jobs\.lever\.co/[A-Za-z0-9_-]+"), ("ASHBY", r"https?://jobs\.ashbyhq\.com/[A-Za-z0-9_-]+"),
    ("WORKDAY", r"https?://[A-Za-z0-9_-]+\.wd[0-9]+\.myworkdayjobs\.com"), ("SMARTRECRUITERS", r"https?://[A-Za-z0-9_-]+\.smartrecruiters\.com"), ("WORKABLE", r"https?://[A-Za-z0-9_-]+\.workable\.com"), ("PERSONIO", r"https?://[A-Za-z0-9_-]+\.personio\.de"),
    ("RECRUITEE", r"https?://[A-Za-z0-9_-]+\.recruitee\.com"), ("JOIN", r"https?://[A-Za-z0-9_-]+\.join\.com"), ("BREEZY", r"https?://[A-Za-z0-9_-]+\.breezy\.hr"), ("BAMBOOHR", r"https?://[A-Za-z0-9_-]+\.bamboohr\.com"), ("TEAMTAILOR", r"https?://[A-Za-z0-9_-]+\.teamtailor\.com"),
    ("STEPSTONE", r"https?://www\.stepstone\.(?:de|at|nl|be)/"), ("ICIMS", r"https?://[A-Za-z0-9_-]+\.icims\.com"), ("PINPOINT", r"https?://[A-Za-z0-9_-]+\.pinpointhq\.com"), ("GREENHOUSE", r"https?://(?!boards)[A-Za-z0-9_-]+\.greenhouse\.io"),
    ("GREENHOUSE", r"[?&]gh_jid="), ("LEVER", r"[?&]lever_source="),
)


def system_anywhere(url: Column) -> Column:
    """The system of the first pattern that is found in a URL, then of a parameter that companies' own domains carry."""
    out = None
    for ats, pattern in FIND_PATTERNS:
        out = F.when(url.rlike(pattern), ats) if out is None else out.when(url.rlike(pattern), ats)
    return out


def host(url: Column) -> Column:
    """The host without `www.`."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def absolute_url(base: Column, link: Column) -> Column:
    """A link as seen from a base URL: absolute, scheme-relative, root-relative, or beside the base."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", "")
    return (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, F.when(folder.rlike("^https?://[^/]+$"), "/").otherwise(""), link))
    )


def candidate_urls(slug: Column, domain: Column) -> Column:
    """Where a company's postings may be found."""
    places = ("https://boards.greenhouse.io/{}", "https://jobs.lever.co/{}", "https://jobs.ashbyhq.com/{}", "https://{}.jobs.personio.de", "https://{}.pinpointhq.com")
    urls = [F.concat(F.lit(p.split("{}")[0]), slug, F.lit(p.split("{}")[1])) for p in places]
    return F.array_compact(F.array(*urls, F.when(domain.isNotNull(), F.concat(F.lit("https://careers."), domain))))


#: What a page of each system holds, in order.
PAGE_WORDS = {"GREENHOUSE": ("greenhouse.io", "boards.greenhouse"), "LEVER": ("lever.co", "lever-jobs-iframe"), "ASHBY": ("ashbyhq.com", "ashby-job-posting"), "WORKDAY": ("myworkdayjobs.com", "workday")}


def system_from_html(html: Column) -> Column:
    low = F.lower(html)
    out = None
    for ats, (first, second) in PAGE_WORDS.items():
        found = low.contains(first) | low.contains(second)
        out = F.when(found, ats) if out is None else out.when(found, ats)
    return out


def resolution(url: Column, html: Column) -> Column:
    """struct(ats, slug, confidence): the URL is sure, a page's words count where no URL pattern does, else null."""
    by_url, by_page = system_from_url(url), system_from_html(html)
    sure = F.struct(by_url["ats"].alias("ats"), by_url["slug"].alias("slug"), F.lit("HIGH").alias("confidence"))
    likely = F.struct(by_page.alias("ats"), F.lit(None).cast("string").alias("slug"), F.lit("MEDIUM").alias("confidence"))
    return F.when(by_url.isNotNull(), sure).when(by_page.isNotNull(), likely)
