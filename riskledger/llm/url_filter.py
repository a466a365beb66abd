"""URL filter: host rules first, then a weighted vocabulary found with Aho-Corasick.

A url that a rule fits gets the rule's verdict.  Any other is blocked for one strict term or for
several distinct soft terms.  A term counts only between characters that are no letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm.common import batch_of, query, table

#: (rule, verdict): a host with its subdomains, then the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
STRICT = ("bestiality", "blowjob", "camgirl", "camgirls", "cumshot", "gangbang", "hentai", "milf", "porn", "porno",
          "pornhub", "redtube", "xhamster", "xvideos", "xxx", "youporn")
SOFT = ("adult", "bet", "betting", "casino", "cialis", "dating", "erotic", "escort", "fetish", "gambling", "jackpot",
        "lingerie", "naked", "nude", "poker", "roulette", "sex", "sexy", "slots", "viagra", "webcam", "xx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()),
                 ("strict_hits", pa.int32()), ("soft_hits", pa.int32())])


@dataclass(frozen=True)
class UrlFilter:
    """Production parameters; the lists are configuration and live on the driver."""

    rules: tuple = RULES
    strict: tuple = STRICT
    soft: tuple = SOFT
    soft_limit: int = 2


def cut(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(FOLD), tail[:stop]


class Judge:
    def __init__(self, p: UrlFilter):
        import ahocorasick
        self.p, self.rules = p, {}
        for rule, verdict in p.rules:
            host, slash, path = rule.partition("/")
            self.rules.setdefault(host, []).append((slash + path, rule, verdict))
        self.terms = ahocorasick.Automaton()
        for kind, words in (("soft", p.soft), ("strict", p.strict)):
            for word in words:
                self.terms.add_word(word, (kind, word))
        self.empty = not (p.soft or p.strict)
        self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, the first by name among equally long ones."""
        fits, labels = [], host.split(".")
        for i in range(len(labels)):
            for start, rule, verdict in self.rules.get(".".join(labels[i:]), ()):
                if path.startswith(start):
                    fits.append((-len(rule), rule, verdict))
        return min(fits)[1:] if fits else (None, None)

    def hits(self, url: str | None) -> tuple[int, int]:
        """Distinct strict and soft terms."""
        text, found = (url or "").translate(FOLD), set()
        if not self.empty:
            for end, (kind, word) in self.terms.iter(text):
                start = end + 1 - len(word)
                if not (start and text[start - 1].isalpha()) and not (end + 1 < len(text) and text[end + 1].isalpha()):
                    found.add((kind, word))
        strict = sum(kind == "strict" for kind, _ in found)
        return strict, len(found) - strict

    def __call__(self, url: str | None) -> tuple:
        host, path = cut(url)
        rule, verdict = self.rule(host, path)
        strict, soft = self.hits(url)
        if verdict is None:
            verdict = "block" if strict or soft >= self.p.soft_limit else "allow"
        return host, path, rule, verdict, strict, soft


def judged(pages: DataFrame, p: UrlFilter | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits of every row.

    A null url, or one without ``://``, has an empty host and path; a null one is allowed.  Repeated
    rows are judged each, a null page_id stays null; other columns are not read.
    """
    p = p or UrlFilter()

    def run(batches):
        judge = Judge(p)
        for batch in batches:
            if batch.num_rows:
                found = zip(*map(judge, batch.column("url").to_pylist()))
                yield batch_of(OUT, page_id=batch.column("page_id"), **dict(zip(OUT.names[1:], found)))
    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")


def _sql(p: UrlFilter) -> str:
    """The same in DuckDB: split and searched with regular expressions."""
    fold = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"

    def term(word):
        return f"regexp_matches(f, '(^|[^\\p{{L}}]){word}($|[^\\p{{L}}])')::int"
    cases = []
    for rule, verdict in sorted(p.rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        cases.append((f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{slash}{path}')", rule, verdict))
    rules = " ".join(f"when {c} then '{r}'" for c, r, _ in cases)
    verdicts = " ".join(f"when {c} then '{v}'" for c, _, v in cases)
    return f"""
with t as (select page_id, {fold} f, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
h as (select *, regexp_extract(rest, '^[^/?#]*') raw_host from t),
x as (select *, translate(raw_host, '{UPPER}', '{LOWER}') host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') path from h),
n as (select *, {' + '.join(map(term, p.strict))} strict_hits, {' + '.join(map(term, p.soft))} soft_hits from x)
select page_id, host, path, case {rules} end as rule,
  case {verdicts} when strict_hits > 0 or soft_hits >= {p.soft_limit} then 'block' else 'allow' end as verdict,
  strict_hits, soft_hits from n"""


@query("op9_url_filter", _sql(UrlFilter()))
def op9(spark, sf_dir):
    """Every page's url under the rules and the vocabulary."""
    return judged(table(spark, sf_dir, "pages"))
