import re

from millrace.llm import url_filter as u

URLS = [None, "", "no scheme", "http://a.org", "http://A.ORG/", "https://x.EXAMPLE.org/es/1?x", "https://example.org/en/1234", "https://notexample.org/es/", "http://example.com/fr/a#b", "http://com/de/", "http://com/de",
        "http://ads.site.net/x", "http://badads.site.net/x", "http://n.net/banner/ads/1", "a://b://c/d", "http://user:pw@h.org:80/p?q/r", "http://n.net/wp-login.php", "http://d.doubleclick.net", "HTTP://X.ORG/ES/", "http://a.org?x=/", "x" * 50_000 + "://q.org/"]


def expect(url):
    head, sep, rest = (url or "").partition("://")
    host = re.split("[/?#]", rest)[0] if sep else ""
    path = re.split("[?#]", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in u.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.host + r.path), default=None)
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    verdict = best.verdict if best else "block" if any(re.search(p.pattern, low) for p in u.PATTERN_RULES) else "allow"
    return host, path, best and best.host + best.path, verdict


def test_verdicts(spark):
    rows = [(k, x, "clash") for k, x in enumerate(URLS)] + [(0, None, "clash"), (None, "http://a.org/", None)]
    got = u.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == expect(r["url"]), r["url"]
    assert u.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_plan_has_no_shuffle_of_pages(spark, sf):
    plan = u.judge(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rarest_token_is_the_index():
    rules = (u.PatternRule("a.*b", ("a", "b")), u.PatternRule("c", ("c",)))
    assert u.rarest(rules, {"a": 5, "b": 2}) == {"b": ["a.*b"], "c": ["c"]}
