"""URL filtering: explicit rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (allowed or blocked) are counted per host. Three beta-binomial levels
shrink them: the suffix towards the global rate, the registered domain towards its suffix, the
host towards its domain. The strength of each prior is the method-of-moments estimate from the
spread between the groups of that level. A host is blocked when the lower posterior bound of
its rate of blocked pages is above a threshold.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule;
very long urls are read whole; rows that repeat are judged each; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlens.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 1000
KAPPA_RANGE = (1.0, 10_000.0)
# fixed values: common public suffixes of two labels; others may be passed in
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.cn", "com.tw", "com.hk", "com.sg", "com.mx", "com.ar", "com.tr", "co.in", "co.za", "co.il")


def host_of(url: Column) -> Column:
    rest = F.expr("substring(_url, instr(_url, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.expr("substring(_url, instr(_url, '://') + 3)")
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, path).otherwise("")


def rule_columns(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict. A rule ``host/path`` fits the host, all its
    subdomains and every path that starts with ``/path``; of rules of one length the one with the
    longer host comes first, then code point order. The list is compiled into the plan, hence
    MAX_RULES."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} is the limit of a compiled rule list")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1]))
    for what, text in reversed(order):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def parse_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page id, host, path, rule and the rule's verdict of every row."""
    d = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("_url"))
    d = d.select(id_col, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rule, verdict = rule_columns(rules)
    return d.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))


def registered_domain(host: Column, two_label_suffixes: Sequence[str] = TWO_LABELS) -> tuple[Column, Column]:
    """The registered domain and the suffix: the last label, or two for the suffixes named."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(?::\d*)?$", "")
    last2 = F.substring_index(name, ".", -2)
    two = last2.isin(list(two_label_suffixes)) if two_label_suffixes else F.lit(False)
    number = name.rlike(r"^\d+(?:\.\d+){3}$|^\[")
    domain = F.when(number, name).when(two, F.substring_index(name, ".", -3)).otherwise(last2)
    return domain, F.when(number, "").when(two, last2).otherwise(F.substring_index(name, ".", -1))


def _strength(groups: DataFrame, parents: DataFrame, on: list[str]) -> Column:
    """Prior strength of one level from the spread of its groups within their parents, as a scalar."""
    p = parents.select(*on, F.col("n").alias("pn"), F.col("b").alias("pb")) if on else parents.select(F.col("n").alias("pn"), F.col("b").alias("pb"))
    j = groups.where("n > 0")
    j = j.join(p, on) if on else j.withColumns({"pn": p.select("pn").scalar(), "pb": p.select("pb").scalar()})
    j = j.where("pn > 0")
    s = j.agg(
        F.count("*").cast("double").alias("g"),
        F.sum(F.lit(1.0) * F.col("n") / F.col("pn")).alias("parents"),
        F.sum(F.col("n")).cast("double").alias("total"),
        F.sum(F.col("n") * F.pow(F.col("b") / F.col("n") - F.col("pb") / F.col("pn"), 2)).alias("between"),
        F.sum(F.col("n") * (F.col("pb") / F.col("pn")) * (1 - F.col("pb") / F.col("pn"))).alias("within"),
        F.sum(F.lit(1.0) * F.col("n") * F.col("n") / F.col("pn")).alias("own"),
    )
    q = F.try_divide(F.col("within"), F.col("total"))
    free = F.col("g") - F.col("parents")
    rho = F.try_divide(F.col("between") - free * q, q * (F.col("total") - F.col("own") - free))
    kappa = F.when(rho > 0, F.least(F.greatest(F.try_divide(1 - rho, rho), F.lit(KAPPA_RANGE[0])), F.lit(KAPPA_RANGE[1]))).otherwise(KAPPA_RANGE[1])
    return s.select(F.coalesce(kappa, F.lit(KAPPA_RANGE[1])).alias("k")).scalar()


def host_reputation(outcomes: DataFrame, z: float = 1.645, two_label_suffixes: Sequence[str] = TWO_LABELS) -> DataFrame:
    """Per host of ``outcomes`` (host, blocked boolean or null where unlabelled): labelled pages,
    blocked ones, posterior mean and lower bound of the blocked rate."""
    domain, suffix = registered_domain(F.col("host"), two_label_suffixes)
    hosts = outcomes.groupBy("host").agg(F.count("blocked").alias("n"), F.count_if("blocked").alias("b")).withColumns({"domain": domain, "suffix": suffix})
    hosts = cut_lineage(hosts)  # every level and its prior read this
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    base = whole.select(((F.col("b") + 1) / (F.col("n") + 2)).alias("p")).scalar()

    def shrunk(prior: Column, kappa: Column) -> Column:
        return (F.col("b") + kappa * prior) / (F.col("n") + kappa)

    k_suffix, k_domain, k_host = _strength(suffixes, whole, []), _strength(domains, suffixes, ["suffix"]), _strength(hosts, domains, ["domain", "suffix"])
    s = suffixes.select("suffix", shrunk(base, k_suffix).alias("suffix_rate"))
    d = domains.join(s, "suffix").select("domain", "suffix", shrunk(F.col("suffix_rate"), k_domain).alias("domain_rate"))
    h = hosts.join(d, ["domain", "suffix"]).withColumn("kappa", k_host)
    h = h.withColumn("rate", shrunk(F.col("domain_rate"), F.col("kappa")))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("kappa") + 1))
    return h.select("host", F.col("n").alias("n_labelled"), F.col("b").alias("n_blocked"), "rate", (F.col("rate") - z * sd).alias("rate_low"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], outcomes: DataFrame | None = None, threshold: float = 0.5, z: float = 1.645, two_label_suffixes: Sequence[str] = TWO_LABELS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict for every page.

    outcomes: (host, blocked) of labelled pages; by default the pages that a rule decides serve as
    labels. Hosts without any label fall back on their domain, suffix or the global rate.
    """
    d = parse_urls(pages, rules, id_col, url_col)
    own = d.select("host", (F.col("rule_verdict") == "block").alias("blocked"))
    if outcomes is not None:
        own = own.select("host", F.lit(None).cast("boolean").alias("blocked")).unionByName(outcomes.select("host", "blocked"))
    rep = host_reputation(own, z, two_label_suffixes)
    judged = d.join(rep, "host", "left")
    verdict = F.coalesce(F.col("rule_verdict"), F.when(F.col("rate_low") > threshold, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "n_labelled", "n_blocked", F.round("rate_low", 6).alias("rate_low"))
