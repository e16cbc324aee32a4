"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that any
URL it matches must hold as whole tokens (runs of ASCII letters and digits, lower case).
How many URLs hold each such token is counted over the whole table; a rule is filed under
its rarest token, and a URL runs only the rules its own tokens fetch.  Rules without a
token run on every URL.

Of the host rules that match, the longest decides.  If there is none, a URL that a
pattern rule matches is blocked, and any other is allowed.

Defined results: a null URL or one without ``://`` has empty host and path, so no rule
fits and it is allowed; of host rules of equal length those that block, then the last by text, decide;
URLs of any length are read whole; added columns replace those of the same name, others may have any
name; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is null for pattern rules, which never show as the rule that decided."""

    pattern: str
    action: str
    tokens: tuple[str, ...]
    name: str | None = None


def host_rule(action: str, text: str) -> Rule:
    """``com/en/``: URLs of the host before the slash and of all its subdomains whose path
    starts with the rest.  The last token of the path may go on in the URL, unless a
    separator follows it in the rule."""
    host, slash, path = text.partition("/")
    path = slash + path
    whole = re.findall(TOKEN, host.lower()) + re.findall(rf"{TOKEN}(?=[^a-z0-9])", path.lower())
    return Rule(rf"(?:[^/?#]*\.)?{re.escape(host.lower())}(?=/|\Z){re.escape(path)}", action, tuple(dict.fromkeys(whole)), text)


#: The rules of the query, then the advert patterns of the method.
HOST_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
AD_RULES = (
    Rule(r"(?:[^/]*\.)?ads-track\.", "block", ("ads", "track")),
    Rule(r"(?:[^/]*\.)?adserver\.", "block", ("adserver",)),
    Rule(r"[^/]*/(?:.*/)?ads/", "block", ("ads",)),
    Rule(r"[^/]*/(?:.*/)?banners/", "block", ("banners",)),
)


def default_rules() -> list[Rule]:
    return [host_rule(*x) for x in HOST_RULES] + list(AD_RULES)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rarest_token_index(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, list[int]]:
    """Token -> numbers of the rules filed under it; ``""`` for rules without one.

    Only counts of the rules' own tokens come to the driver: as many as the rules name.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(f"({TOKEN})"), F.lit(1)))
    seen = urls.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, wanted)).cast("array<string>"))).alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in seen.collect()}
    index: dict[str, list[int]] = defaultdict(list)
    for i, rule in enumerate(rules):
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(i)
    return dict(index)


def judge_urls(pages: DataFrame, url: str = "url", rules: Sequence[Rule] | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    rules = list(default_rules() if rules is None else rules)
    (judged,) = fresh(pages.columns, "_judged")
    parts = pages.drop("host", "path", "rule", "verdict").withColumns({"host": F.coalesce(url_host(pages[url]), F.lit("")), "path": F.coalesce(url_path(pages[url]), F.lit(""))})
    index = rarest_token_index(parts.select("host", "path"), rules)

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        patterns = [re.compile(r.pattern, re.DOTALL) for r in rules]
        token, always = re.compile(TOKEN), index.get("", [])
        for hosts, paths in batches:
            found = []
            for host, path in zip(hosts, paths, strict=True):
                target = host + path
                hits = [rules[i] for i in {*always, *(i for t in token.findall(target.lower()) for i in index.get(t, ()))} if patterns[i].match(target)]
                named = max((r for r in hits if r.name), key=lambda r: (len(r.name), r.action == "block", r.name), default=None)
                found.append((named.name, named.action) if named else (None, "block" if any(r.action == "block" for r in hits) else "allow"))
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return parts.withColumn(judged, decide("host", "path")).withColumns({"rule": F.col(judged)["rule"], "verdict": F.col(judged)["verdict"]}).drop(judged)
