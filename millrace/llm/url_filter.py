"""URL verdicts from host rules and pattern rules, each fetched by one literal token.

Null, empty and malformed urls (no `://`) have an empty host and path, fit no rule and are allowed. Repeated rows and
repeated ids each get their verdict; a url of any length is tokenized whole. Extra columns stay, also such as have names of
the judge's own helpers; columns called host, path, rule or verdict are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A token of a rule or url: a run of these, lower-cased.
TOKEN = "[a-z0-9]+"
#: Rules up to here go into the plan as one map literal; more of them are joined as tables.
MAX_LITERAL_RULES = 1_000


class HostRule(NamedTuple):
    verdict: str
    host: str
    path: str


class PatternRule(NamedTuple):
    """A regular expression over the lower-cased url, and the literal tokens that every match holds between token ends."""

    pattern: str
    tokens: tuple[str, ...]


HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: Words of hosts that sell games of chance, drugs and the like, each as a label of a host or as a part of one between
#: hyphens; then hosts, paths and queries of adverts, trackers and machinery. In the syntax of parse().
_WORDS = ("casino", "casinos", "poker", "slots", "jackpot", "roulette", "blackjack", "bets", "betting", "bookmaker", "sportsbook", "lottery", "pills", "viagra", "cialis", "levitra", "payday", "escorts", "porn", "xxx", "webcams", "warez", "keygen", "torrents")
_SHAPES = ("||{}.", "||{}-", "||*-{}.", "||*-{}-")
RULE_LIST = "\n".join(
    [
        "! hosts by a word", *(shape.format(word) for word in _WORDS for shape in _SHAPES),
        "! hosts of adverts and trackers", *(f"||{x}^" for x in ("doubleclick.net", "adserver.invalid", "popads.invalid")), *(f"||{x}." for x in ("ads", "adserver", "adclick", "banners", "popunder", "tracker", "pixel")),
        "! paths", *(f"/{x}/" for x in ("banner/ads", "popunder", "adserver", "ad-frame", "affiliate/click", "track/click", "cgi-bin/adclick")), *(f"/{x}^" for x in ("wp-login.php", "xmlrpc.php", "track/pixel.gif", "pixel.gif", "adframe.js", "prebid.js")),
        "! queries", *(f"^{x}=" for x in ("phpsessid", "jsessionid", "sessionid", "adclickid", "affid", "popunder")),
        "! whole addresses", "|http://*/setup.exe|", "|http://*/install.apk|",
    ]
)


def parse(lines: str) -> tuple[PatternRule, ...]:
    """Rules from a filter list, one a line: `||` stands before a label of the host, `|` at either end of the url, `^` for a
    separator (what isn't a letter, a digit or one of `_-.%`) or the end, `*` for anything, which in a rule with `||` stays in
    the host up to the first slash. `!` begins a comment. A rule's tokens are the runs of letters and digits that end
    where a token of the url must end too; a rule without any is refused, since nothing could fetch it."""
    out = []
    for line in map(str.strip, lines.lower().splitlines()):
        if not line or line.startswith("!"):
            continue
        body = line.removeprefix("||") if line.startswith("||") else line.removeprefix("|")
        pattern = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if line.startswith("||") else "^" if line.startswith("|") else ""
        first, last = bool(pattern), body.endswith("|")
        body = body.removesuffix("|")
        in_host = line.startswith("||")
        for c in body:
            in_host &= c != "/"
            pattern += ("[^/?#]*" if in_host else ".*") if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else c if c.isalnum() or c == "_" else "\\" + c
        found = [m for m in re.finditer(TOKEN, body) if (body[m.start() - 1] != "*" if m.start() else first) and (body[m.end()] != "*" if m.end() < len(body) else last)]
        if not found:
            raise ValueError(f"no whole literal token in rule {line!r}")
        out.append(PatternRule(pattern + ("$" if last else ""), tuple(dict.fromkeys(m.group() for m in found))))
    return tuple(out)


PATTERN_RULES = parse(RULE_LIST)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path, both empty where the url is null or holds no `://`."""
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), pattern, k), F.lit(""))
    return urls.withColumns({"host": lower_ascii(part(1)), "path": part(2)})


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the name after as many underscores as make it one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def token_counts(urls: DataFrame, tokens: list[str], url: str = "url") -> dict[str, int]:
    """In how many urls each of these tokens stands; at most one row for each token reaches the driver."""
    if not tokens:
        return {}
    own = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col(url)), F.lit(f"({TOKEN})"), 1))
    found = urls.select(F.explode(own).alias("token")).where(F.col("token").isin(*tokens))  # a hash set
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rarest(rules: tuple[PatternRule, ...], counts: dict[str, int]) -> dict[str, list[str]]:
    """The patterns under the token of each that the fewest urls hold (ties: the longest, then the first by name)."""
    index: dict[str, list[str]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(rule.pattern)
    return index


def _rule_name(hosts: tuple[HostRule, ...], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(length, rule, verdict). The rules of a host are fetched by the host's
    suffixes, which are the tokens of host rules."""
    by_host: dict[str, list[HostRule]] = {}
    for rule in hosts:
        by_host.setdefault(rule.host, []).append(rule)
    struct = lambda r: F.struct(F.lit(r.path).alias("path"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
    index = F.create_map(*[x for h, rules in by_host.items() for x in (F.lit(h), F.array(*map(struct, rules)))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fetched = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(index, s)), lambda r: r.isNotNull()))
    fitting = F.filter(fetched, lambda r: path.startswith(r["path"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _blocked(index: dict[str, list[str]], low: Column, tokens: Column) -> Column:
    """Whether any pattern fits. The url's own tokens fetch the patterns: a hash set says which of them are keys of the index,
    and only those are looked up in its map, whose lookup walks the keys. Keys are the rarest tokens, so few urls hold any."""
    if not index:
        return F.lit(False)
    table = F.create_map(*[x for t, found in sorted(index.items()) for x in (F.lit(t), F.array(*map(F.lit, found)))])
    keys = F.array_distinct(F.filter(tokens, lambda t: t.isin(*index)))
    fetched = F.transform(keys, lambda t: F.exists(F.try_element_at(table, t), lambda p: F.rlike(low, p)))
    return F.coalesce(F.exists(fetched, lambda hit: F.coalesce(hit, F.lit(False))), F.lit(False))


def _judge_joined(urls: DataFrame, hosts: tuple[HostRule, ...], patterns: tuple[PatternRule, ...], url: str) -> DataFrame:
    """judge() for rules that no plan holds: tables of rules, joined by host suffix and by token. Each distinct host and
    path, and each distinct url, is looked up once; rows find the result by value."""
    spark, out = urls.sparkSession, with_parts(urls, url)
    rule, hit = free_name(out, "found_rule"), free_name(out, "found_hit")
    places = out.select(F.col("host").alias("h"), F.col("path").alias("p")).distinct()
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    by_host = spark.createDataFrame([(r.host, r.path, r.host + r.path, r.verdict) for r in hosts], "suffix string, prefix string, rule string, verdict string")
    fitting = places.select("*", F.explode(suffixes).alias("suffix")).join(by_host, "suffix").where(F.col("p").startswith(F.col("prefix")))
    longest = fitting.groupBy("h", "p").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias(rule)).select(F.struct("h", "p").alias("place"), rule)
    left = out.alias("left")
    out = left.join(longest.alias("right"), (F.col("left.host") == F.col("right.place.h")) & (F.col("left.path") == F.col("right.place.p")), "left").select("left.*", f"right.{rule}")

    low = urls.select(lower_ascii(F.col(url)).alias("low")).where("low IS NOT NULL").distinct()
    tokens = low.select("low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(f"({TOKEN})"), 1))).alias("token"))
    asked = spark.createDataFrame([(t,) for t in sorted({t for r in patterns for t in r.tokens})], "token string")
    counts = {r["token"]: r["n"] for r in tokens.join(asked, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    by_token = spark.createDataFrame([(t, p) for t, found in rarest(patterns, counts).items() for p in found], "token string, pattern string")
    hits = tokens.join(by_token, "token").where(F.rlike("low", "pattern")).select(F.col("low").alias(hit)).distinct()
    out = out.alias("left").join(hits.alias("right"), lower_ascii(F.col(f"left.{url}")) == F.col(f"right.{hit}"), "left").select("left.*", f"right.{hit}")
    verdict = F.coalesce(F.col(f"{rule}.verdict"), F.when(F.col(hit).isNotNull(), "block").otherwise("allow"))
    return out.withColumns({"rule": F.col(f"{rule}.rule"), "verdict": verdict}).drop(rule, hit)


def judge(urls: DataFrame, hosts: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to each row. The longest fitting host rule decides; else a url that any pattern
    rule matches is blocked and others are allowed. A pattern runs only on urls that hold its rarest token."""
    if len(hosts) + len(patterns) > MAX_LITERAL_RULES:
        return _judge_joined(urls, hosts, patterns, url)
    index = rarest(patterns, token_counts(urls, sorted({t for r in patterns for t in r.tokens}), url))
    low, out = lower_ascii(F.col(url)), with_parts(urls, url)
    tokens = F.regexp_extract_all(low, F.lit(f"({TOKEN})"), 1)
    found = _rule_name(hosts, F.col("host"), F.col("path")) if hosts else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    helper = free_name(out, "found")
    out = out.withColumn(helper, F.struct(found.alias("rule"), _blocked(index, low, tokens).alias("blocked")))
    verdict = F.coalesce(F.col(f"{helper}.rule.verdict"), F.when(F.col(f"{helper}.blocked"), "block").otherwise("allow"))
    return out.withColumns({"rule": F.col(f"{helper}.rule.rule"), "verdict": verdict}).drop(helper)


def oracle(hosts: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """The same as DuckDB SQL over pages, every rule tried on every url."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    longest = sorted(hosts, key=lambda r: -len(r.host + r.path))
    fits = [(r, f"(host = {quote(r.host)} OR ends_with(host, {quote('.' + r.host)})) AND starts_with(path, {quote(r.path)})") for r in longest]
    rule = " ".join(f"WHEN {c} THEN {quote(r.host + r.path)}" for r, c in fits)
    verdict = " ".join(f"WHEN {c} THEN {quote(r.verdict)}" for r, c in fits)
    low = f"translate(url, '{UPPER}', '{LOWER}')"
    match = " OR ".join(f"regexp_matches({low}, {quote(re.sub(r'^\^', '^', r.pattern))})" for r in patterns)
    return f"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN coalesce({match}, false) THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""
