"""URL rules, found by their rarest literal token.

A rule is a pattern for the host and a pattern for the path, with the literal
tokens that every URL it fits must contain. Rules are indexed by one token
each: the one that is rarest among all URLs of the table (counted first, for
the rules' tokens only). A URL is cut into tokens, its tokens fetch candidate
rules, and regular expressions run for those only; rules without a literal
token are candidates everywhere.

The rules are a parameter, so the index is bounded by it and goes to all
tasks; the table is read twice (the url column alone) and never shuffled.

Verdict: of the site rules (host and path prefix) that fit, the longest; if
none fits, block if any pattern rule fits, else allow.

Defined results: a null url, or one without "://", has empty host and path,
fits no rule and is allowed. Site rules of equal length: block before allow,
then by code point. Repeated rows repeat their verdict; an empty table gives
an empty result; columns with the names of the results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltloom.llm.base import append

ALLOW, BLOCK = "allow", "block"
URL = re.compile(r".*?://([^/?#]*)([^?#]*)", re.DOTALL)
TOKENS = re.compile(r"[A-Za-z0-9]+")
UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """A host pattern and a path pattern that match from the start, the host's to its end."""
    name: str
    verdict: str
    host: str
    path: str
    tokens: tuple[str, ...] = ()
    site: bool = False

    @cached_property
    def _patterns(self) -> tuple[re.Pattern, re.Pattern]:
        return re.compile(self.host, re.DOTALL), re.compile(self.path, re.DOTALL)

    def fits(self, host: str, path: str) -> bool:
        h, p = self._patterns
        return h.fullmatch(host) is not None and p.match(path) is not None


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with its subdomains, and the start of the path."""
    literal = [f"h:{t}" for t in TOKENS.findall(host)]
    # The last token of a prefix may go on in a URL, so it is literal only before a delimiter.
    literal += [f"p:{m[0]}" for m in TOKENS.finditer(path) if m.end() < len(path)]
    return Rule(host + path, verdict, rf"(?:.*\.)?{re.escape(host)}", re.escape(path), tuple(literal), site=True)


SITES = (
    site_rule(ALLOW, "org", "/"), site_rule(BLOCK, "example.org", "/es/"),
    site_rule(BLOCK, "example.org", "/en/1"), site_rule(ALLOW, "com", "/fr/"), site_rule(BLOCK, "com", "/de/"),
)
PATTERNS = (
    Rule("ad host", BLOCK, r"(?:.*[.-])?ads(?:[.-].*)?", "", ("h:ads",)),
    Rule("single ad host", BLOCK, r"(?:.*[.-])?ad(?:[.-].*)?", "", ("h:ad",)),
    Rule("tracker host", BLOCK, r"(?:.*[.-])?tracker(?:[.-].*)?", "", ("h:tracker",)),
    Rule("casino host", BLOCK, r"(?:.*[.-])?casino(?:[.-].*)?", "", ("h:casino",)),
    Rule("adult host", BLOCK, r"(?:.*[.-])?porn(?:[.-].*)?", "", ("h:porn",)),
    Rule("login page", BLOCK, ".*", r"(?:.*/)?wp-login(?:[./].*)?\Z", ("p:wp", "p:login")),
)


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    found = URL.match(url) if url else None
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def tokens(host: str, path: str) -> set[str]:
    return {f"h:{t}" for t in TOKENS.findall(host)} | {f"p:{t}" for t in TOKENS.findall(path)}


def token_counts(df: DataFrame, url: str, wanted: set[str]) -> dict[str, int]:
    """In how many rows each wanted token stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(tokens(*parts(value)) & wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    counted = df.select(F.col(url)).mapInArrow(run, "token string, n long")
    # No more rows than the rules have tokens.
    return {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def index(rules: Sequence[Rule], counts: Mapping[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token ('' for rules without one)."""
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return out


def fitting(host: str, path: str, by_token: Mapping[str, Sequence[Rule]]) -> list[Rule]:
    """The rules that fit, of the candidates that the tokens fetch."""
    return [r for t in (*tokens(host, path), "") for r in by_token.get(t, ()) if r.fits(host, path)]


def decide(rules: Sequence[Rule]) -> tuple[str | None, str]:
    """(site rule, verdict) of the rules that fit a URL."""
    sites = [r for r in rules if r.site]
    if sites:
        best = min(sites, key=lambda r: (-len(r.name), r.verdict != BLOCK, r.name))
        return best.name, best.verdict
    return None, BLOCK if any(r.verdict == BLOCK for r in rules) else ALLOW


def judge(df: DataFrame, url: str = "url", rules: Sequence[Rule] = (*SITES, *PATTERNS)) -> DataFrame:
    """``df`` with host, path, rule and verdict of each url."""
    by_token = index(rules, token_counts(df, url, {t for r in rules for t in r.tokens}))

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"host": [], "path": [], "rule": [], "verdict": []}
        for value in batch.column(batch.schema.names.index(url)).to_pylist():
            host, path = parts(value)
            rule, verdict = decide(fitting(host, path, by_token) if host or path else [])
            for k, v in zip(out, (host, path, rule, verdict)):
                out[k].append(v)
        return out

    return append(df, dict.fromkeys(("host", "path", "rule", "verdict"), T.StringType()), work)
