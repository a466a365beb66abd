"""SQL spellings of the text signals (for the side-by-side checks)."""

from fleet_queries.registry import quote, str_list
from riskledger.catalog import names, patterns as P
from riskledger.functions.regex import to_re2


def match(text, expression):
    return f"regexp_matches({text}, {quote(to_re2(expression))})"


def any_match(text, expressions):
    return "(" + " OR ".join(match(text, e) for e in expressions) + ")"


def any_contains(text, words):
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def compact(items):
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def distinct(lst):
    """Order-preserving distinct; ``lst`` is a column or a cheap expression."""
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def pattern_items(text, table):
    return [f"CASE WHEN {match(text, e)} THEN {quote(s)} END" for s, e, _ in table]


def signal_ctes(source: str, key: str, text: str, out: str = "sig") -> str:
    """CTEs ending in ``out``: key plus the five ordered signal lists of ``source``."""
    combo = " AND ".join(any_match(text, ["(?i)" + w.replace(".", r"\.") for w in g])
                         for g in P.COMBO_GROUPS)
    legacy = any_match(text, [e for _, e, _ in P.LEGACY_SECRET_PATTERNS])
    tamper_decoded = compact(pattern_items("d", P.TAMPERING_PATTERNS))
    return f"""
{out}_raw AS (
  SELECT {key}, {text} AS body,
    {compact(pattern_items(text, P.SECRET_PATTERNS))} AS sec,
    {legacy} AS legacy,
    {compact(pattern_items(text, P.DANGEROUS_PATTERNS)
             + [f"CASE WHEN {combo} THEN {quote(P.COMBO_SIGNAL)} END"])} AS dang,
    {compact(pattern_items(text, P.SSRF_PATTERNS))} AS ssrf,
    {compact(pattern_items(text, P.TAMPERING_PATTERNS))} AS tam
  FROM {source} WHERE {text} IS NOT NULL
),
{out}_tok AS (
  SELECT {key}, pos, d, {tamper_decoded} AS hits FROM (
    SELECT {key}, pos, try(decode(from_base64(tok))) AS d FROM (
      SELECT {key}, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (
        SELECT {key}, regexp_extract_all(body, {quote(P.BASE64_TOKEN)}) AS toks FROM {out}_raw))
    WHERE length(tok) % 4 = 0 AND try(to_base64(from_base64(tok))) = tok)
  WHERE d IS NOT NULL
),
{out}_dec AS (
  SELECT {key}, flatten(list(list_concat(hits, [{quote(P.BASE64_SIGNAL)}]) ORDER BY pos)) AS dec
  FROM {out}_tok WHERE len(hits) > 0 GROUP BY {key}
),
{out}_all AS (
  SELECT r.{key} AS {key},
    CASE WHEN legacy OR len(sec) > 0 THEN list_concat(['credential_exposure_signal'], sec) ELSE sec END
      AS secret_signals,
    dang AS dangerous_signals, ssrf AS ssrf_signals,
    list_concat(tam, coalesce(dec, CAST([] AS VARCHAR[]))) AS tam2
  FROM {out}_raw r LEFT JOIN {out}_dec d ON r.{key} = d.{key}
),
{out}_cat AS (
  SELECT *, {distinct('tam2')} AS tampering_signals,
    list_concat(list_concat(dangerous_signals, ssrf_signals), tam2) AS cat FROM {out}_all
),
{out} AS (
  SELECT {key}, secret_signals, dangerous_signals, ssrf_signals, tampering_signals,
    {distinct('cat')} AS danger_signals FROM {out}_cat
)"""


def content_allowed(name):
    return (f"({name} IN ({', '.join(quote(n) for n in names.CONTENT_NAMES)}) "
            f"OR contains({name}, 'prompt') OR {name} LIKE '%.instructions.md')")


def joined(lst):
    return f"array_to_string({lst}, '|')"


def ext_of(name):
    return f"regexp_extract({name}, '^.+\\.([^.]*)$', 1)"


def words(values):
    return str_list(values)
