"""Parts of nested pages: balanced subtrees by ordered selectors, readings of JSON-LD, totals and pages of listings.

A page is cut into tokens, tags and the text between them. Where a subtree ends is found by counting the tags of its name, which
a regular expression can't do. All of it happens within the row, in Column functions; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ENTITIES, blank_to_null, collapse, is_blank, once

#: Tags that don't part words; all others do. Tags that have no end.
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: What is no page text: comments, scripts, styles, templates.
_SILENT = r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>"
_TOKEN = r"(?s)(<[a-zA-Z/!?](?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>|<|[^<]+)"
#: What a script holds, up to its nearest end: as (.*?)</script>, but read in runs without a `<` instead of by characters.
SCRIPT_END = r"((?:[^<]+|<(?!/script>))*+)</script>"
#: Selectors of descriptions, in the order of trial, and the phrases that tell how many postings a listing has.
BLOCK_SELECTORS = (".rich-text-content", ".jb-description-item")
DETAIL_SELECTORS = (".jobdescription", ".job-description", "[class*=jobDescription]", ".contentWithSidePanel__content", "main", "#content")
LEAST_BLOCKS, MOST_DETAIL, LEAST_LD, LEAST_META = 50, 10_000, 50, 100
TOTALS = (r"Results\s+\d+\s+to\s+\d+\s+of\s+(\d+)", r"Showing\s+\d+\s+to\s+\d+\s+of\s+(\d+)", r"Results\s+\d+\s*[–-]\s*\d+\s+of\s+(\d+)")


def tokens(html: Column) -> Column:
    """Tags and texts of a page in their order, without what is silent."""
    return F.regexp_extract_all(F.regexp_replace(html, _SILENT, " "), F.lit(_TOKEN), 1)


def tag_names(tokens: Column) -> Column:
    """For each token the name of the tag it opens, that name after a slash if it closes, nothing for texts and for tags
    without an end."""
    name = lambda t: F.lower(F.regexp_extract(t, r"^<(/?[a-zA-Z][a-zA-Z0-9:-]*)", 1))
    return F.transform(tokens, lambda t: F.when(t.endswith("/>") & ~t.startswith("</"), F.concat(name(t), F.lit("/"))).otherwise(name(t)))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    return F.regexp_replace(value, "^[\"']|[\"']$", "")


def selects(selector: str, tag: Column, name: Column) -> Column:
    """Whether an opening tag fits .class, #id, [attribute*=part] or a tag's name."""
    if selector.startswith("."):
        return F.array_contains(F.split(F.lower(_attribute(tag, "class")), r"\s+"), selector[1:].lower())
    if selector.startswith("#"):
        return _attribute(tag, "id") == selector[1:]
    if found := re.fullmatch(r"\[([\w-]+)\*=(.+)]", selector):
        return F.lower(_attribute(tag, found[1])).contains(found[2].lower())
    return name == selector.lower()


def _end(names: Column, start: Column) -> Column:
    """How many tokens the subtree has whose tag stands at start (from 1): up to the tag that balances it, or to the end."""
    own = F.element_at(names, start)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, n: Column) -> Column:
        depth = s["depth"] + F.when(n == own, 1).when(n == F.concat(F.lit("/"), own), -1).otherwise(0)
        at = s["at"] + 1
        return F.when(s["end"] > 0, s).otherwise(F.struct(depth.alias("depth"), at.alias("at"), F.when(depth == 0, at).otherwise(0).alias("end")))

    rest = F.slice(names, start, F.size(names))
    return F.aggregate(rest, zero, step, lambda s: F.when(s["end"] > 0, s["end"]).otherwise(s["at"]))


def _text(tokens: Column, names: Column) -> Column:
    """The text of a run of tokens: tags that part words become spaces, references are decoded, white space collapses."""
    bare = lambda n: F.regexp_replace(n, "/", "")
    parts = F.zip_with(tokens, names, lambda t, n: F.when((n == "") & ~t.rlike("(?s)^<.+"), t).when(bare(n).isin(*INLINE), "").otherwise(" "))
    text = F.array_join(parts, "")
    for reference, char in ENTITIES:
        text = F.replace(text, F.lit(reference), F.lit(char))
    return collapse(text)


def _found(selector: str, all_of: bool) -> Column:
    """The text that a selector finds, or null: of all subtrees, parted by blank lines, or of the first."""
    t, n = F.col("_tokens"), F.col("_names")
    starts = F.filter(F.transform(n, lambda name, k: F.when((name != "") & ~name.contains("/") & ~name.isin(*VOID) & selects(selector, F.element_at(t, k + 1), name), k + 1)), lambda k: k.isNotNull())
    chosen = starts if all_of else F.slice(starts, 1, 1)
    texts = F.transform(chosen, lambda k: _text(F.slice(t, k, _end(n, k)), F.slice(n, k, _end(n, k))))
    return F.when(F.size(starts) > 0, F.array_join(F.filter(texts, lambda x: x != ""), "\n\n"))


def part(pages: DataFrame, html: str, selectors: tuple[str, ...], all_of: bool = False, least: int = 0, most: int | None = None, name: str = "description") -> DataFrame:
    """pages with the text of the first selector that finds any subtree; null where it has no more than least characters, and
    cut after most. Null and empty pages have none."""
    made = pages.withColumn("_tokens", tokens(F.col(html))).withColumn("_names", tag_names(F.col("_tokens")))
    text = F.coalesce(*[_found(s, all_of) for s in selectors])
    cut = F.left(F.col(name), F.lit(most)) if most else F.col(name)
    out = made.withColumn(name, text).drop("_tokens", "_names")
    return out.withColumn(name, F.when(F.length(name) > least, cut))


def blocks_detail(pages: DataFrame, html: str = "html") -> DataFrame:
    """description of pages whose description stands in several blocks."""
    return part(pages, html, BLOCK_SELECTORS, all_of=True, least=LEAST_BLOCKS)


def listing_detail(pages: DataFrame, html: str = "html") -> DataFrame:
    """description of pages whose description stands in one of several containers."""
    return part(pages, html, DETAIL_SELECTORS, most=MOST_DETAIL)


def total(html: Column) -> Column:
    """How many postings a listing says there are; the third phrase may have bold numbers. 0 if none says."""
    plain = F.regexp_replace(html, "</?b>", "")
    found = [F.nullif(F.regexp_extract(plain if k == 2 else html, p, 1), F.lit("")) for k, p in enumerate(TOTALS)]
    return F.coalesce(*[x.try_cast("int") for x in found], F.lit(0))


def page_offsets(listings: DataFrame, size: int = 25, html: str = "html") -> DataFrame:
    """The offsets of a listing's further pages, to be fetched and united with the first."""
    n = total(F.col(html))
    return listings.select("*", F.explode(F.when(n > size, F.sequence(F.lit(size), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))).alias("offset"))


def ld_scripts(html: Column) -> Column:
    """The texts of a page's JSON-LD blocks."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json[^>]*>""" + SCRIPT_END), 1)


def ld_blocks(found: Column, open_arrays: bool = False) -> Column:
    """The JSON-LD blocks of a page, of which ld_scripts found the texts, as variants, or those in their arrays; blocks that
    aren't JSON are null."""
    if not open_arrays:
        return F.transform(found, lambda b: F.try_parse_json(b))
    opened = lambda b: F.when(b.rlike(r"^\s*\["), F.from_json(b, "array<string>")).otherwise(F.array(b))
    return F.transform(F.flatten(F.transform(found, opened)), lambda b: F.try_parse_json(b))


def ld_description(html: Column, reading: str, scripts: Column | None = None) -> Column:
    """The description of a page's JSON-LD by one of three readings: `typed` takes job postings only, `any` whatever has a
    description, `open` job postings, job listings and what has no type, in arrays too, if the description is long enough.
    scripts: a column of what ld_scripts found, so that several readings search a page once."""
    kind = lambda v: F.try_variant_get(v, "$.@type", "string")
    text = lambda v: F.try_variant_get(v, "$.description", "string")
    wanted = {
        "typed": lambda v: kind(v) == "JobPosting",
        "any": lambda v: ~is_blank(text(v)),
        "open": lambda v: F.coalesce(kind(v).isin("JobPosting", "JobListing"), F.lit(True)) & (F.length(text(v)) > LEAST_LD),
    }[reading]
    blocks = ld_blocks(ld_scripts(html) if scripts is None else scripts, reading == "open")
    return once(text(F.try_element_at(F.filter(blocks, wanted), F.lit(1))), blank_to_null)


def page_description(html: Column) -> Column:
    """What a page that was fetched later says: its JSON-LD read openly, else a long meta description."""
    meta = F.regexp_extract(html, r"""(?is)<meta\s[^>]*name\s*=\s*["']?description["']?[^>]*>""", 0)
    content = _attribute(meta, "content")
    return F.coalesce(ld_description(html, "open"), F.when(F.length(content) > LEAST_META, content))
