"""URL filters: pattern rules indexed by their rarest literal token.

Tokens are runs of letters (and non-ASCII characters) and runs of digits. Each rule names literals whose tokens stand whole in
every URL it matches (a rule without any is refused: it would have to run on every URL). Their frequencies over all URLs
are counted once; a rule is filed under its rarest token, a URL's tokens fetch candidate rules, and only those run their
regular expression. The rule set is configuration, given as rules or as a table of them (`read_rules`); it is broadcast, and refused
above `MAX_RULES` rules or `MAX_RULE_BYTES` bytes of their texts.

Defined results: a null URL or one without "://" has empty host and path, fits no host rule, and gets the pattern
verdict of its text (null: allow). Repeated rows give repeated rows. Extra input columns are ignored. An empty table
gives an empty table. Very long URLs are handled whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import Emitter, bound_batches, rows_of

MAX_RULES, MAX_RULE_BYTES = 1_000_000, 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(_UPPER, _LOWER)
_TOKEN = re.compile(r"[0-9]+|[^\x00-\x60\x7B-\x7F]+")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


@dataclass(frozen=True)
class Rule:
    """A rule on `on` ("site": lower-cased host + path; "url": the URL with A-Z lower-cased).

    `literals`: words whose tokens stand whole in every match, at least one. Among rules on "site" that fit, the longest name wins; they go before rules on "url".
    """

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    on: str = "url"


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the URL's path starts with `path`."""
    whole = [t.group() for t in _TOKEN.finditer(path) if t.end() < len(path)]  # the last one may be the start of a longer token
    return Rule(host + path, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}(?=/|\Z){re.escape(path)}", tuple(t.translate(_ASCII_LOWER) for t in _TOKEN.findall(host) + whole), "site")


def alternatives(name: str, verdict: str, before: str, words: Iterable[str], after: str) -> tuple[Rule, ...]:
    """A rule for each of several words that may stand between two patterns, as each has literals of its own."""
    return tuple(Rule(name, verdict, before + re.escape(w) + after, tuple(_TOKEN.findall(w))) for w in words)


def word_rule(words: str, verdict: str) -> Rule:
    """Fits where the space-separated words stand one after another between separators, e.g. cheap-pills."""
    tokens = words.split(" ")
    return Rule(words, verdict, rf"(?:\A|{_SEPARATOR})" + rf"{_SEPARATOR}+".join(map(re.escape, tokens)) + rf"(?:{_SEPARATOR}|\Z)", tuple(tokens))


#: Fixed values of the query's contract.
BASE_RULES = (
    host_rule("com", "/", "allow"),
    host_rule("example.com", "/en/", "block"),
    host_rule("www.example.com", "/en/", "allow"),
    host_rule("net", "/es/", "block"),
    host_rule("net", "/fr/", "block"),
)
#: The pattern rules of this engine: spam, gambling, tracking and adult sites; then pages that are no documents: logins,
#: sessions, searches, carts, calendars, feeds and downloads. Patterns keep to what both Python and RE2 know.
PATTERN_RULES = (
    *(word_rule(w, "block") for w in ("casino", "casino win", "cheap pills", "ads track", "poker", "viagra", "porn", "xxx", "free money", "payday loan")),
    *alternatives("spam farm", "block", r"://(?:[^/?#]*\.)?", ("spamfarm", "spamfarms", "spam-farm", "spam-farms"), r"[0-9]*\."),
    *alternatives("wp login", "block", r"/", ("wp-login", "wp-admin", "wp-signup"), r"(?:\.php|/|\z)"),
    *alternatives("session id", "block", r"[?&;]", ("phpsessid", "jsessionid", "sid", "sessionid"), r"=[0-9a-z]{16,}"),
    Rule("site search", "block", r"[?&]search=[^&#]+", ("search",)),
    Rule("add to cart", "block", r"[?&](?:add-to-cart|cart)=[0-9]+", ("cart",)),
    Rule("calendar day", "block", r"/calendar/[0-9]{4}/(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])(?:/|\z)", ("calendar",)),
    *alternatives("feed", "block", r"/", ("feed", "rss", "atom"), r"(?:\.xml)?/?\z"),
    *alternatives("download", "block", r"\.", ("zip", "exe", "iso", "dmg", "rar", "7z", "tar.gz"), r"(?:[?#]|\z)"),
    *alternatives("redirect", "block", r"[?&]", ("redirect", "goto", "returnurl"), r"=https?(?::|%3a)"),
)
RULE_SCHEMA = "name string, verdict string, pattern string, literals array<string>, `on` string"


def read_rules(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table of RULE_SCHEMA, in the order of their names; its size is checked before it comes to the driver."""
    n, size = table.agg(F.count("*"), F.coalesce(F.sum(F.length("name") + F.length("pattern")), F.lit(0))).first()
    if n > MAX_RULES or size > MAX_RULE_BYTES:
        raise ValueError(f"{n} rules of {size} bytes; at most {MAX_RULES} of {MAX_RULE_BYTES} are broadcast")
    return tuple(Rule(r["name"], r["verdict"], r["pattern"], tuple(r["literals"] or ()), r["on"] or "url") for r in sorted(table.collect(), key=lambda r: r["name"]))


def _compiled(pattern: str) -> re.Pattern:
    """\\z is the end of the text in RE2 and Java; Python calls it \\Z."""
    return re.compile(pattern.replace(r"\z", r"\Z"), re.S)


def _parts(url: bytes | None) -> tuple[str, str, str]:
    text = url.decode("utf-8", "replace") if url is not None else ""
    m = _URL.search(text)
    return (m[1].translate(_ASCII_LOWER), m[2], text.translate(_ASCII_LOWER)) if m else ("", "", text.translate(_ASCII_LOWER))


def token_frequencies(pages: DataFrame, tokens: set[str], url: str = "url") -> dict[str, int]:
    """In how many URLs each of the given tokens stands; at most one row a token reaches the driver."""
    if not tokens:
        return {}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for (u,) in rows_of(batches, url):
            if u is not None:
                seen.update(tokens.intersection(_TOKEN.findall(u.decode("utf-8", "replace").translate(_ASCII_LOWER))))
        yield pa.record_batch({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = pages.select(F.col(url).alias(url)).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token: r.n for r in rows}


def tokens_of(rule: Rule) -> list[str]:
    """The tokens that every match of a rule holds."""
    found = [t for w in rule.literals for t in _TOKEN.findall(w.translate(_ASCII_LOWER))]
    if not found:
        raise ValueError(f"rule {rule.name} names no literal, so it would run on every URL")
    return found


def index_rules(rules: tuple[Rule, ...], frequency: dict[str, int]) -> dict[str, list[int]]:
    """Rules by their rarest token (ties: the token that sorts first)."""
    by_token: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        by_token.setdefault(min(tokens_of(r), key=lambda t: (frequency.get(t, 0), t)), []).append(i)
    return by_token


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, pattern_rule for each row. See the module's docstring for odd rows."""
    size = sum(len(r.name) + len(r.pattern) for r in rules)
    if len(rules) > MAX_RULES or size > MAX_RULE_BYTES:
        raise ValueError(f"{len(rules)} rules of {size} bytes; at most {MAX_RULES} of {MAX_RULE_BYTES} are broadcast")
    bound_batches(pages.sparkSession)
    pages = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    shared = pages.sparkSession.sparkContext.broadcast((rules, index_rules(rules, token_frequencies(pages, {t for r in rules for t in tokens_of(r)}))))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("pattern_rule", pa.string())])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, by_token = shared.value
        compiled: dict[int, re.Pattern] = {}
        out = Emitter(schema)
        for page, raw in rows_of(batches, "page_id", "url"):
            host, path, whole = _parts(raw)
            candidates: set[int] = set()
            for token in set(_TOKEN.findall(whole)):
                candidates.update(by_token.get(token, ()))
            best: Rule | None = None
            pattern: Rule | None = None
            for i in sorted(candidates):
                r = rules[i]
                if i not in compiled:
                    compiled[i] = _compiled(r.pattern)
                if not compiled[i].search(host + path if r.on == "site" else whole):
                    continue
                if r.on == "site":
                    best = r if best is None or len(r.name) > len(best.name) else best
                else:
                    pattern = pattern or r
            verdict = best.verdict if best else pattern.verdict if pattern else "allow"
            if out.add(page, host, path, best and best.name, verdict, pattern and pattern.name):
                yield out.take()
        yield out.take()

    return pages.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, pattern_rule string")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), BASE_RULES + PATTERN_RULES)


def _sql() -> str:
    sep = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
    lower = f"translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}')"
    words = lambda r: rf"(?:\A|{sep}){(sep + '+').join(r.name.split(' '))}(?:{sep}|\z)"
    tests = ", ".join(f"CASE WHEN regexp_matches(whole, '(?s){words(r) if r == word_rule(r.name, r.verdict) else r.pattern}') THEN '{r.name}' END" for r in PATTERN_RULES)
    fits = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    cases = []
    for name in sorted(fits, key=lambda n: -len(n)):
        host, slash, path = name.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{name}'")
    verdicts = " ".join(f"WHEN '{n}' THEN '{v}'" for n, v in fits.items())
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) AS path, {lower} AS whole
  FROM pages),
ruled AS (SELECT page_id, host, path, CASE {' '.join(cases)} END AS rule, coalesce({tests}) AS pattern_rule FROM parts)
SELECT page_id, host, path, rule,
       CASE rule {verdicts} ELSE CASE WHEN pattern_rule IS NULL THEN 'allow' ELSE 'block' END END AS verdict, pattern_rule
FROM ruled"""


SQL = _sql()
