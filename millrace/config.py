"""The profile: which postings fit. Patterns use ASCII \\b; defaults are fixed values of the job-market rules."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Skill:
    name: str
    weight: float = 1.0
    #: Patterns that alone decide whether the skill is named; without any, its lower-cased name is looked for.
    variants: tuple[str, ...] = ()


@dataclass(frozen=True)
class Scoring:
    skills: tuple[Skill, ...] = (
        Skill("Java", 5.0, (r"\bjava\b", r"\bjvm\b")), Skill("Spring Boot", 4.5), Skill("Kotlin", 1.0), Skill("PostgreSQL", 2.0, (r"\bpostgres(ql)?\b",)), Skill("Kafka", 3.0), Skill("Kubernetes", 3.0, (r"\bkubernetes\b", r"\bk8s\b")),
        Skill("AWS", 2.5, (r"\baws\b",)), Skill("Docker", 2.5), Skill("TypeScript", 0.5), Skill("Microservices", 2.0), Skill("REST APIs", 1.0, (r"\brest(ful)?\b",)), Skill("CI/CD", 1.5), Skill("SQL", 1.5, (r"\bsql\b",)), Skill("Git", 0.5, (r"\bgit\b",)),
    )
    benchmark_weight: float = 22.0
    bonus_signals: tuple[str, ...] = ("ai", "machine learning", "llm", "agent", "agentic")
    bonus_weight: float = 2.0
    primary_skills: tuple[str, ...] = ("java", "spring boot", "kotlin")
    primary_cap: int = 70
    competing: tuple[str, ...] = (r"\bpython\b", r"\bgolang\b", r"\bgo\b developer", r"\bruby\b", r"\brust\b", r"\bc\+\+\b", r"\bc#\b", r"\.net\b", r"\bphp\b", r"\bnode\.?js\b", r"\bscala\b", r"\belixir\b")
    competing_cap: int = 50
    senior_words: tuple[str, ...] = ("senior", "lead", "principal", "staff", "iii")
    senior_multiplier: float = 0.7
    apply_score: int = 40
    apply_matches: int = 4
    maybe_score: int = 25
    maybe_matches: int = 2
    target_salary: float = 65_000.0
    locations: tuple[str, ...] = ("Germany", "remote")


@dataclass(frozen=True)
class Filters:
    role_include: tuple[str, ...] = (r"\bjava\b", "engineer", "developer", "programmer", r"\bsre\b", "devops", "software", "backend", r"back[\s-]end", "fullstack", r"full[\s-]stack", "platform", "infrastructure", r"\bcloud\b", r"\bml\b", r"machine\s+learning", r"site\s+reliability", r"\bai\b", "entwickler")
    role_exclude: tuple[str, ...] = ("manager", "architect", "analyst", "director", "lead", "principal", "recruiter", "designer", "marketing", "intern", "sales", "finance", "hr", "frontend", r"front[\s-]end", "qa", "test", "support", "consultant")
    remote: tuple[str, ...] = (r"^(remote|remote\s*-\s*(eu|europe|emea|global|worldwide|dach|ger(many)?))$", r"remote\s*-\s*(eu|europe|emea)", "remote.*europe", "europe.*remote")
    target_countries: tuple[str, ...] = ("de", "nl", "at", "ch", "ie", "se", "dk", "fi", "es")
    visa_exempt: tuple[str, ...] = ("de",)
    unknown_location_kept: bool = False
    language_exclude: tuple[str, ...] = (r"german\s+c[12]", r"deutsch\s+c[12]", r"flie[ßs]end\s+deutsch", r"fluent\s+german", "muttersprache", r"native\s+german", "verhandlungssicher", r"dutch\s+c[12]", r"\bnederlands\b", r"spanish\s+c[12]", "castellano", r"french\s+c[12]", r"langue\s+maternelle")
    language_soft: tuple[str, ...] = (r"nice\s+to\s+have", "preferred", r"von\s+vorteil", r"\bB[12]\b", r"basic\s+(german|dutch|french|spanish|swedish)", "bonus", "optional", r"ideal(ly)?", "advantage")
    visa_negative: tuple[str, ...] = (r"(no|not|cannot|can't|won't|unable\s+to)\s+sponsor", r"must\s+(have|hold|possess)\s+(a\s+)?(valid\s+)?work\s*(auth|permit|right)", r"(already|currently)\s+authorized", r"(eu|eea|european)\s+(citizens?|nationals?|residents?)\s+only", r"right\s+to\s+work\s+(required|necessary|needed)", r"no\s+relocation")
    visa_positive: tuple[str, ...] = (r"visa\s+sponsor", r"sponsorship\s+(available|provided|offered|included)", r"relocation\s+(package|support|assistance)", r"we\s+sponsor", r"work\s+permit\s+(support|assist)", r"visa\s+assistance", r"immigration\s+support", r"willing\s+to\s+sponsor", r"\bexpat(riate)?\b", r"(eu\s+)?blue\s+card", r"open\s+to\s+international")
    unclear_visa_kept: bool = False
    most_years: int = 5
    #: Characters of a description below which the visa decision waits, and letters before a match that may soften it.
    visa_least_chars: int = 200
    soft_window: int = 80


@dataclass(frozen=True)
class Profile:
    scoring: Scoring = field(default_factory=Scoring)
    filters: Filters = field(default_factory=Filters)
