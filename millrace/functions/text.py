"""Text, HTML, number and date functions as Column expressions. Every "today" is an argument."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.dialect import jvm


def trim_control(c: Column) -> Column:
    """Trims all characters up to U+0020 at both ends."""
    return F.btrim(c, F.lit("".join(map(chr, range(33)))))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however costly and however often f uses it."""
    return F.transform(F.array(c), f)[0]


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def is_blank(c: Column) -> Column:
    """Null, or nothing but characters up to U+0020; a text is read up to its first other one only."""
    return F.coalesce(~c.rlike(r"[^\x00-\x20]"), F.lit(True))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: Character references that the two strippers decode, in this order.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
DECODED_FIRST = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip_html(c: Column) -> Column:
    """Tags go without a trace, then references are decoded (&amp; last), then white space collapses."""
    c = F.regexp_replace(c, "<[^>]+>", "")
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return collapse(c)


def strip_html_decoding_first(c: Column) -> Column:
    """References are decoded first, then tags become spaces."""
    for name, char in DECODED_FIRST:
        c = F.replace(c, F.lit(name), F.lit(char))
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def tags_to_spaces(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def visible_text(c: Column, most: int = 10_000) -> Column:
    """The text outside of scripts, styles and page furniture; null if nothing is left."""
    for tag in ("script", "style", "nav", "footer", "header", "noscript", "iframe"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return blank_to_null(F.left(tags_to_spaces(c), F.lit(most)))


NOISE = r"\[https?://[^\]]*]|!?\[[^\]]*]\([^)]*\)|https?://\S+"


def strip_noise(c: Column) -> Column:
    """Bracketed and bare URLs and markdown links become spaces."""
    return collapse(F.regexp_replace(c, jvm(NOISE), " "))


def truncate(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def excerpt(c: Column, head: int = 500, tail: int = 2000) -> Column:
    """The text itself, or its head and tail where it is longer than both."""
    return F.when(F.length(c) <= head + tail, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit("\n...\n"), F.right(c, F.lit(tail))))


def name_parts(c: Column) -> Column:
    """struct(first, last) of a lower-cased name; what follows the first word is joined."""
    words = F.split(F.lower(collapse(c)), " ")
    return F.struct(words[0].alias("first"), F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), "").alias("last"))


def snake_upper(c: Column) -> Column:
    """camelCase to SNAKE_UPPER."""
    return F.upper(F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2"))


def json_slice(c: Column) -> Column:
    """What stands from the first bracket to the last in a reply that may be fenced."""
    return F.nullif(F.regexp_extract(c, r"(?s)[\[{].*[\]}]", 0), F.lit(""))


def string_hash(c: Column) -> Column:
    """The 31-based 32-bit hash of a text's characters (of the basic plane), in lower-case hexadecimal digits."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.lower(F.hex(F.aggregate(chars, F.lit(0).cast("long"), lambda h, x: (h * 31 + F.ascii(x)).bitwiseAND(F.lit(0xFFFFFFFF)))))


def keywords(c: Column, groups: dict[str, list[str]]) -> Column:
    """For each group of a keyword dictionary the distinct words found, lower-cased, in order; patterns count as whole words."""
    low = F.lower(c)
    words = lambda patterns: jvm(rf"(?i)(?<![A-Za-z0-9_])({'|'.join(patterns)})(?![A-Za-z0-9_])")
    return F.struct(*[F.array_distinct(F.regexp_extract_all(low, F.lit(words(p)), 1)).alias(name) for name, p in groups.items()])


#: Skill aliases.
SKILL_ALIASES = {
    "k8s": "Kubernetes", "kube": "Kubernetes", "kubernetes": "Kubernetes", "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "mongo": "MongoDB", "mongodb": "MongoDB",
    "dynamodb": "DynamoDB", "redis": "Redis", "elasticsearch": "Elasticsearch", "elastic": "Elasticsearch", "aws": "AWS", "amazon web services": "AWS",
    "gcp": "Google Cloud Platform", "google cloud": "Google Cloud Platform", "google cloud platform": "Google Cloud Platform", "azure": "Microsoft Azure",
    "js": "JavaScript", "javascript": "JavaScript", "ts": "TypeScript", "typescript": "TypeScript", "java": "Java", "kotlin": "Kotlin", "python": "Python", "go": "Go",
    "golang": "Go", "rust": "Rust", "react.js": "React", "reactjs": "React", "react": "React", "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js",
    "spring boot": "Spring Boot", "springboot": "Spring Boot", "spring": "Spring", "django": "Django", "flask": "Flask", "express": "Express.js", "expressjs": "Express.js",
    "express.js": "Express.js", "rabbitmq": "RabbitMQ", "kafka": "Kafka", "apache kafka": "Kafka", "docker": "Docker", "terraform": "Terraform", "ansible": "Ansible",
    "ci/cd": "CI/CD", "cicd": "CI/CD", "jenkins": "Jenkins", "github actions": "GitHub Actions", "graphql": "GraphQL", "rest": "REST APIs", "restful": "REST APIs",
    "microservices": "Microservices", "git": "Git", "sql": "SQL", "nosql": "NoSQL", "jpa": "Hibernate/JPA", "hibernate": "Hibernate/JPA", "gradle": "Gradle", "maven": "Maven",
}
SKILL_CATEGORIES = ("LANGUAGE", "FRAMEWORK", "DATABASE", "CLOUD", "INFRASTRUCTURE", "TOOL", "SOFT_SKILL")


def canonical_skill(c: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in SKILL_ALIASES.items() for x in pair])
    trimmed = trim_control(c)
    return F.when(is_blank(c), c).otherwise(F.coalesce(F.try_element_at(aliases, F.lower(trimmed)), trimmed))


def skill_category(c: Column) -> Column:
    """A known category, or TOOL."""
    upper = F.upper(trim_control(c))
    return F.when(upper.isin(*SKILL_CATEGORIES), upper).otherwise("TOOL")


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(c * 10**digits + F.lit(0.5)) / 10**digits if digits else F.floor(c + F.lit(0.5))


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def salary(c: Column) -> Column:
    """A decimal without thousands separators, or null."""
    return F.replace(trim_control(c), F.lit(",")).try_cast("decimal(12,2)")


def iso_date(c: Column) -> Column:
    """The date in the offset's own local time, or null."""
    return F.try_to_date(F.left(c, F.lit(10)), "yyyy-MM-dd")


def epoch_date(c: Column, unit: str = "s") -> Column:
    """UTC date of positive epoch seconds or milliseconds."""
    stamp = F.timestamp_seconds(c) if unit == "s" else F.timestamp_millis(c)
    return F.when(c > 0, F.to_date(stamp))


def rfc1123_date(c: Column) -> Column:
    found = F.regexp_extract(c, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1)
    return F.try_to_date(F.nullif(found, F.lit("")), "d MMM yyyy")


def posted_ago(c: Column, as_of: Column) -> Column:
    """Dates of "Posted Today", "Posted Yesterday", "Posted N Days Ago" and "Posted 30+ Days Ago"."""
    low = F.lower(c)
    days = F.regexp_extract(low, r"(\d+)\s*days?\s*ago", 1).try_cast("int")
    return F.when(low.contains("today"), as_of).when(low.contains("yesterday"), F.date_sub(as_of, 1)).when(days.isNotNull(), F.date_sub(as_of, days)).when(low.contains("30+"), F.date_sub(as_of, 30))


def relative_date(c: Column, as_of: Column) -> Column:
    """Dates of "N units ago"; units under a day are today."""
    n = F.regexp_extract(F.lower(c), r"(\d+)\s*(second|minute|hour|day|week|month|year)s?\s+ago", 1).try_cast("int")
    unit = F.regexp_extract(F.lower(c), r"(\d+)\s*(second|minute|hour|day|week|month|year)s?\s+ago", 2)
    shifted = F.when(unit == "day", F.date_sub(as_of, n)).when(unit == "week", F.date_sub(as_of, n * 7)).when(unit == "month", F.add_months(as_of, -n)).when(unit == "year", F.add_months(as_of, -12 * n)).otherwise(as_of)
    return F.when(n.isNotNull(), shifted)
