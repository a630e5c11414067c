"""URL filter by empirical-Bayes host reputation, as DataFrame expressions.

Labelled page outcomes are summed per host, registered domain and suffix.  A suffix is shrunk to the overall rate,
a domain to its suffix, a host to its domain, each by a beta prior whose strength is the method-of-moments estimate
of how much units of that level differ.  A host is blocked when the lower bound of its posterior bad rate is above
a threshold.  Hand-written rules come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 32
# Suffixes of several labels under which names are registered: second-level registries of countries and common hosting
# domains.  Not the whole public suffix list (no wildcard rules, no regional suffixes of Japan, Norway or the US);
# every other suffix is the last label.  ``suffixes`` of judge() replaces the list.
SUFFIXES = tuple(f"{second}.{country}" for country, seconds in {
    "uk": "co org me ltd plc net ac gov sch nhs police", "au": "com net org edu gov asn id", "nz": "co net org ac govt school geek gen iwi maori",
    "jp": "co ne or ac go ed gr lg ad", "kr": "co ne or ac go re pe", "in": "co net org ac edu gov gen firm ind res nic", "za": "co net org ac gov web law",
    "br": "com net org edu gov art blog eco eng ind inf jus leg mil", "cn": "com net org edu gov ac mil", "tw": "com net org edu gov idv", "hk": "com net org edu gov idv",
    "sg": "com net org edu gov per", "my": "com net org edu gov mil name", "th": "co in ac go or net mi", "id": "co or ac go web sch net my", "ph": "com net org edu gov",
    "vn": "com net org edu gov", "tr": "com net org edu gov bel pol gen web", "il": "co org net ac gov muni k12", "mx": "com net org edu gob", "ar": "com net org edu gob gov int mil",
    "co": "com net org edu gov mil nom", "pe": "com net org edu gob nom", "ve": "co com net org edu gob web", "uy": "com net org edu gub", "ec": "com net org edu gob fin",
    "ua": "com net org edu gov in", "pl": "com net org edu gov info waw", "ru": "com net org msk spb", "es": "com nom org gob edu", "pt": "com org edu gov", "gr": "com net org edu gov",
    "cy": "com net org ac gov", "hu": "co org info", "at": "co or ac gv", "eg": "com net org edu gov", "sa": "com net org edu gov", "ae": "co net org ac gov sch", "pk": "com net org edu gov",
    "bd": "com net org edu gov ac", "lk": "com net org edu gov ac", "ng": "com net org edu gov", "ke": "co or ne go ac sc", "gh": "com org edu gov", "tz": "co or go ac ne", "ug": "co or go ac ne com org",
    "com": "blogspot appspot herokuapp wordpress weebly wixsite azurewebsites cloudfront", "io": "github gitlab readthedocs", "dev": "pages workers web", "app": "netlify vercel web firebaseapp",
}.items() for second in seconds.split()) + ("s3.amazonaws.com", "blogspot.co.uk", "blogspot.com.au", "blogspot.com.br", "nsw.edu.au", "vic.edu.au")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without it or for null."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest of ``suffixes`` that the host ends with, label by label, else the last label."""
    return _fitting(host, suffixes, 0)


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """One label more than the suffix; a numeric address is its own domain, and a bare suffix too."""
    return F.when(host.rlike(r"^[0-9.:]+$"), host).otherwise(_fitting(host, suffixes, 1))


def _fitting(host: Column, suffixes: Sequence[str], more: int) -> Column:
    """As many last labels of the host as its longest fitting suffix has, and ``more``."""
    out = F.substring_index(host, ".", -1 - more)
    for n in sorted({s.count(".") + 1 for s in suffixes} - {1}):
        out = F.when(F.substring_index(host, ".", -n).isin([s for s in suffixes if s.count(".") + 1 == n]), F.substring_index(host, ".", -n - more)).otherwise(out)
    return out


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule (verdict, host, path) that fits, else nulls.

    A rule fits its host and all subdomains, if the path starts with its own.  Of equally long rules the first in
    order of text counts.
    """
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _salted(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Left join on ``key`` whose hot keys are spread over ``SALTS`` tasks; ``right`` has one row per key."""
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(many, [key, "_salt"], "left").drop("_salt")


def _strength(units: DataFrame, floor: float, ceiling: float) -> float:
    """Prior strength from units with (n, bad): 1 / rho - 1, rho being the moment estimate of their intraclass correlation."""
    s = units.where("n > 0").agg(
        F.count("*").alias("units"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("between")).first()
    if not s.units or s.units < 2 or s.bad in (0, s.n):
        return ceiling
    p = s.bad / s.n
    spread = (s.between - s.n * p * p) / (p * (1 - p)) - (s.units - 1)
    room = s.n - s.nn / s.n - (s.units - 1)
    rho = spread / room if room > 0 else 0.0
    return min(ceiling, max(floor, 1 / rho - 1)) if rho > 0 else ceiling


def host_reputation(pages: DataFrame, labelled: DataFrame, threshold: float = 0.5, z: float = 1.645,
                    floor: float = 2.0, ceiling: float = 1000.0, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, n, bad, rate, low, blocked) for each host of ``pages`` (url).

    ``labelled`` has url and bad (0, 1 or null; null is no label).  ``rate`` is the mean of the beta posterior,
    ``low`` its lower bound ``rate - z * sd``.  Hosts without labels get their domain's rate, without these their
    suffix's, else the overall one; with no labels at all the rate is 0.5 and nothing is blocked by a bound.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.lit(0).alias("n"), F.lit(0).alias("bad")).unionAll(
        labelled.where("bad is not null").select(host_of(F.col("url")).alias("host"), F.lit(1).alias("n"), F.col("bad").cast("int").alias("bad")))
    hosts = rows.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    m = [_strength(x, floor, ceiling) for x in (suffixes, domains, hosts)]
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = whole.bad / whole.n if whole.n else 0.5

    def rate(prior: Column, strength: float) -> Column:
        return (F.col("bad") + prior * strength) / (F.col("n") + strength)
    suffixes = suffixes.select("suffix", rate(F.lit(base), m[0]).alias("suffix_rate"))
    domains = _salted(domains, suffixes, "suffix", "domain").select("domain", rate(F.col("suffix_rate"), m[1]).alias("domain_rate"))
    hosts = _salted(hosts, domains, "domain", "host").select(
        "host", "n", "bad", rate(F.col("domain_rate"), m[2]).alias("rate"), (F.col("n") + m[2] + 1).alias("_w"))
    low = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("_w"))
    return hosts.withColumn("low", low).withColumn("blocked", F.col("low") > threshold).drop("_w")


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]], **parameters) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, rate, low) for each row of ``pages`` (page_id, url).

    Rules decide first, then the host's posterior bound.  Repeated rows stay; a null url has an empty host, which
    is a host like any other.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    known = host_reputation(pages.select("url"), labelled, **parameters).select("host", "rate", "low", "blocked")
    out = _salted(parsed.withColumn("_row", F.xxhash64("page_id", "url")), known, "host", "_row")
    return out.select("page_id", "url", "host", "path", rule.alias("rule"),
                      F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "rate", "low")
