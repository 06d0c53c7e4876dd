"""URL filter by site rules and a weighted vocabulary.

Site rules allow or block a host with all its subdomains under a path; the
longest rule that fits decides. Where none fits, an Aho-Corasick automaton
finds the vocabulary's terms in the URL. A term counts only between
boundaries (no ASCII letter or digit on either side). One strict term rejects,
and so do distinct soft terms whose weights add up to the limit; the limit is
above every weight, so that takes two of them. Percent-encoded characters are
decoded before the search.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabulary: general English terms by theme, chosen without regard to any table. Strict terms reject alone; soft ones have
# weights: 2 for words of the trade itself, 1 for words that such sites share with others.
STRICT_TERMS = (
    "porn", "porno", "pornography", "xxx", "hentai", "nsfw", "milf", "camgirl", "camgirls", "sexcam", "sexcams", "escorts", "upskirt", "bdsm",
    "viagra", "cialis", "levitra", "warez", "malware", "phishing", "ransomware", "linkfarm",
)
SOFT_TERMS: Mapping[str, int] = {
    # adult
    "adult": 2, "sex": 2, "sexy": 2, "erotic": 2, "nude": 2, "nudes": 2, "naked": 2, "escort": 2, "fetish": 2, "cam": 1, "cams": 1, "hot": 1, "girls": 1, "babes": 2, "dating": 1, "singles": 1,
    # gambling
    "casino": 2, "casinos": 2, "poker": 2, "slots": 2, "slot": 1, "roulette": 2, "blackjack": 2, "bet": 2, "bets": 2, "betting": 2, "jackpot": 2, "lottery": 2, "gambling": 2, "win": 1, "bonus": 1,
    # pharmacy and money
    "pills": 2, "pharmacy": 2, "meds": 2, "steroids": 2, "payday": 2, "loan": 1, "loans": 1, "forex": 2, "crypto": 1, "replica": 2, "replicas": 2, "cheap": 1, "discount": 1, "buy": 1, "free": 1, "deals": 1,
    # stolen goods and advertising
    "torrent": 2, "torrents": 2, "crack": 2, "cracked": 2, "keygen": 2, "serials": 2, "spam": 2, "farm": 1, "ads": 1, "adserver": 2, "clickbait": 2, "click": 1, "popup": 2, "tracker": 1, "seo": 1, "backlinks": 2, "download": 1,
}


@dataclass(frozen=True)
class SiteRule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
SITE_RULES = (
    SiteRule("net", "/", False),
    SiteRule("example.net", "/en/", True),
    SiteRule("example.com", "/de/", False),
    SiteRule("org", "/fr/", True),
)


@dataclass(frozen=True)
class Vocabulary:
    strict: Sequence[str] = STRICT_TERMS
    soft: Mapping[str, int] = field(default_factory=lambda: dict(SOFT_TERMS))
    limit: int = 3

    def __post_init__(self) -> None:
        if any(w >= self.limit for w in self.soft.values()):
            raise ValueError("a soft term must not reject alone")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and path up to ``?`` or ``#``; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _fitting_rule(rules: Sequence[SiteRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits ``host`` and ``path``."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit("allow" if r.allow else "block")).otherwise(verdict)
    return name, verdict


def vocabulary_counts(words: Vocabulary):
    """A Pandas UDF: strict hits and the weight of the distinct soft hits of each URL."""

    @F.pandas_udf("strict_hits int, soft_hits int, soft_weight int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in words.strict:
            machine.add_word(term, (term, None))
        for term, weight in words.soft.items():
            if term not in words.strict:
                machine.add_word(term, (term, weight))
        machine.make_automaton()

        def hits(url: str | None) -> tuple[int, int, int]:
            text = unquote(url or "").translate(_FOLD)
            strict, soft = 0, {}
            for end, (term, weight) in machine.iter(text):
                before, after = end - len(term), end + 1
                if before >= 0 and text[before] in _WORD or after < len(text) and text[after] in _WORD:
                    continue
                if weight is None:
                    strict += 1
                else:
                    soft[term] = weight
            return strict, len(soft), sum(soft.values())

        for urls in batches:
            yield pd.DataFrame([hits(u) for u in urls], columns=["strict_hits", "soft_hits", "soft_weight"])

    return count


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def judge_urls(pages: DataFrame, rules: Sequence[SiteRule] = SITE_RULES, words: Vocabulary | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the vocabulary's counts.

    A null or empty URL, or one without ``://``, has an empty host and path,
    fits no rule, and is judged by its terms alone (none: allow). Ids pass
    through, null or repeated; other columns are not read. An empty table
    gives an empty result.
    """
    words = words or Vocabulary()
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("_terms", vocabulary_counts(words)("_url"))
    name, verdict = _fitting_rule(rules)
    own = F.when((F.col("_terms.strict_hits") > 0) | (F.col("_terms.soft_weight") >= words.limit), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "_terms.strict_hits", "_terms.soft_hits", "_terms.soft_weight")


def oracle(rules: Sequence[SiteRule] = SITE_RULES, words: Vocabulary | None = None) -> str:
    """The registered query in SQL, from the same vocabulary."""
    words = words or Vocabulary()

    def found(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"

    def times(term: str) -> str:
        # with every separator doubled no two hits of a term share one
        doubled = "".join(c if c in _WORD else c + c for c in term)
        return f"len(regexp_extract_all(wide, '(^|[^a-z0-9]){doubled}($|[^a-z0-9])'))"

    soft = {t: w for t, w in words.soft.items() if t not in words.strict}
    fits = {r: f"((host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}'))" for r in sorted(rules, key=lambda r: -len(r.name))}
    names = " ".join(f"WHEN {c} THEN '{r.name}'" for r, c in fits.items())
    verdicts = " ".join(f"WHEN {c} THEN '{'allow' if r.allow else 'block'}'" for r, c in fits.items())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
        WITH u AS (
            SELECT page_id, translate(url_decode(coalesce(url, '')), '{upper}', '{upper.lower()}') AS low,
                   CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        h AS (
            SELECT page_id, low, regexp_replace(low, '([^a-z0-9])', '\1\1', 'g') AS wide,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM u),
        c AS (
            SELECT *, {" + ".join(times(t) for t in words.strict)} AS strict_hits,
                   {" + ".join(f"{found(t)}::INT" for t in soft)} AS soft_hits,
                   {" + ".join(f"{w} * {found(t)}::INT" for t, w in soft.items())} AS soft_weight
            FROM h)
        SELECT page_id, host, path, CASE {names} END AS rule,
               CASE {verdicts} WHEN strict_hits > 0 OR soft_weight >= {words.limit} THEN 'block' ELSE 'allow' END AS verdict,
               strict_hits::INT AS strict_hits, soft_hits::INT AS soft_hits, soft_weight::INT AS soft_weight
        FROM c
    """
