"""URL filter by empirical-Bayes host reputation, with built-in functions only.

Labelled page outcomes (bad or not) are shrunk through beta-binomial priors: a suffix's rate
towards the rate over all, a registered domain's towards its suffix's, a host's towards its
domain's. How strongly each level shrinks is estimated from the spread among its members
(moments of the beta-binomial). A page is blocked by the method if the lower bound of its
host's posterior bad rate (mean less ``Z`` standard deviations) passes ``MAX_BAD``. Explicit
rules come first: the longest one that fits a url decides.

Outcomes are aggregated per host before anything is joined, so a host with a third of all
pages is one row from then on; hosts without outcomes inherit their domain's posterior.

The tables give no outcomes for pages themselves, so the query takes the ``labels`` row with
``doc_id = page_id`` as the page's outcome: bad if of quality 0 or toxic. The operator takes
any (page id, bad) frame.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and
belongs to the host ''; repeated pages are judged one by one; repeated outcomes count each;
without any outcome the method allows everything.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Second-level names that act as suffixes below a two-letter country name. Fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
Z, MAX_BAD, DEFAULT_STRENGTH, STRENGTH_RANGE = 1.645, 0.5, 10.0, (1.0, 10_000.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and the path up to ``?``, ``#`` or the end."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix (last name, or the last two as in co.uk) and registered domain of a host."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    two = (n >= 2) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, n - 2).isin(*SECOND_LEVEL)
    k = F.when(two, 2).otherwise(1)
    suffix = F.substring_index(host, ".", -1)
    suffix = F.when(two, F.substring_index(host, ".", -2)).otherwise(suffix)
    domain = F.when(k == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return suffix, domain


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame, n: str, k: str) -> DataFrame:
    """One row: rate over all members and prior strength by the moments of their spread."""
    t = children.agg(F.coalesce(F.sum(n), F.lit(0)).alias("N"), F.coalesce(F.sum(k), F.lit(0)).alias("K"),
                     F.count(F.when(F.col(n) > 0, 1)).alias("m"),
                     F.coalesce(F.sum(F.when(F.col(n) > 0, F.col(k) * F.col(k) / F.col(n))), F.lit(0.0)).alias("kk"),
                     F.coalesce(F.sum(F.col(n).cast("double") * F.col(n)), F.lit(0.0)).alias("nn"))
    big, p = F.col("N").cast("double"), F.col("K") / F.nullif(F.col("N").cast("double"), F.lit(0.0))
    spread = F.col("kk") - big * p * p                       # sum of n (rate - p)^2
    noise = p * (1 - p)
    free = F.col("m") - 1.0                                  # its expectation without spread, over noise
    room = big - F.col("nn") / F.nullif(big, F.lit(0.0)) - free
    rho = (spread - noise * free) / F.nullif(noise * room, F.lit(0.0))
    lo, hi = STRENGTH_RANGE
    s = F.when((F.col("m") < 2) | rho.isNull(), F.lit(DEFAULT_STRENGTH)).when(rho <= 0, F.lit(hi)) \
        .otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), 1 / rho - 1)))
    return t.select(F.lit(1).alias("_one"), F.coalesce(p, F.lit(0.0)).alias("_rate"), s.alias("_strength"))


def host_posteriors(hosts: DataFrame) -> DataFrame:
    """Posterior of each host of ``hosts`` (host, n outcomes, k bad): mean and lower bound."""
    suffix, domain = suffix_and_domain(F.col("host"))
    h = hosts.select("host", "n", "k", suffix.alias("suffix"), domain.alias("domain"), F.lit(1).alias("_one"))
    d = h.groupBy("domain", "suffix", "_one").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    s = d.groupBy("suffix", "_one").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def shrunk(level, prior, one):  # one row of strengths joins by its constant key
        top = F.broadcast(one)
        j = level.join(top, "_one")
        return j, (F.col("k") + F.col("_strength") * prior) / (F.col("n") + F.col("_strength"))

    js, mean_s = shrunk(s, F.col("_rate"), _strength(s, "n", "k"))
    s = js.select("suffix", mean_s.alias("s_mean"))
    jd, mean_d = shrunk(d.join(s, "suffix"), F.col("s_mean"), _strength(d, "n", "k"))
    d = jd.select("domain", mean_d.alias("d_mean"))
    jh, mean_h = shrunk(h.join(d, "domain"), F.col("d_mean"), _strength(h, "n", "k"))
    weight = F.col("n") + F.col("_strength")
    return jh.select("host", mean_h.alias("bad_rate"),
                     (mean_h - Z * F.sqrt(mean_h * (1 - mean_h) / (weight + 1))).alias("bad_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url",
               rules=RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, lower bound of the host's bad rate.

    ``outcomes``: (page id, ``bad`` 0/1), any number a page."""
    host, path = host_and_path(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    seen = outcomes.filter(F.col(page_id).isNotNull()).groupBy(F.col(page_id).alias("page_id")).agg(
        F.count("bad").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    hosts = p.join(seen, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    judged = p.join(host_posteriors(hosts), "host", "left")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") > MAX_BAD, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
                         F.round("bad_bound", 6).alias("bad_bound"))


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of ``pages``: explicit rules, else the host's reputation."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    return judge_urls(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def _level(name: str, members: str) -> str:
    lo, hi = STRENGTH_RANGE
    return f"""{name}_t AS (SELECT sum(n)::DOUBLE AS big, sum(k) / sum(n)::DOUBLE AS p, count(*) FILTER (WHERE n > 0) AS m,
    sum(CASE WHEN n > 0 THEN k * k / n::DOUBLE END) AS kk, sum(n::DOUBLE * n) AS nn FROM {members}),
  {name}_r AS (SELECT *, (kk - big * p * p - p * (1 - p) * (m - 1)) / nullif(p * (1 - p) * (big - nn / big - (m - 1)), 0) AS rho
    FROM {name}_t),
  {name}_m AS (SELECT coalesce(p, 0) AS p, CASE WHEN m < 2 OR rho IS NULL THEN {DEFAULT_STRENGTH} WHEN rho <= 0 THEN {hi}
    ELSE greatest({lo}, least({hi}, 1 / rho - 1)) END AS s FROM {name}_r)"""


_SECOND = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
_ORACLE = f"""WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
  raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
  p AS (SELECT page_id, translate(h, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM raw),
  seen AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS k
    FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
  names AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS k, string_split(host, '.') AS w
    FROM p LEFT JOIN seen ON doc_id = page_id GROUP BY host),
  h AS (SELECT host, n, k, array_to_string(w[-c:], '.') AS suffix, array_to_string(w[-c - 1:], '.') AS domain FROM (
    SELECT *, CASE WHEN len(w) >= 2 AND length(w[-1]) = 2 AND w[-2] IN ({_SECOND}) THEN 2 ELSE 1 END AS c FROM names)),
  d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
  s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
  {_level('s', 's')}, {_level('d', 'd')}, {_level('h', 'h')},
  sm AS (SELECT suffix, (k + s_m.s * s_m.p) / (n + s_m.s) AS mean FROM s, s_m),
  dm AS (SELECT domain, (k + d_m.s * sm.mean) / (n + d_m.s) AS mean FROM d JOIN sm USING (suffix), d_m),
  hm AS (SELECT host, (k + h_m.s * dm.mean) / (n + h_m.s) AS mean, n + h_m.s AS w FROM h JOIN dm USING (domain), h_m),
  j AS (SELECT page_id, p.host, path, mean - {Z} * sqrt(mean * (1 - mean) / (w + 1)) AS low FROM p JOIN hm USING (host)),
  r(rh, rp, rv) AS (VALUES {', '.join(str(r) for r in RULES)}),
  best AS (SELECT j.*, (SELECT max({{'n': length(rh || rp), 'rule': rh || rp, 'v': rv}}) FROM r
    WHERE (j.host = rh OR ends_with(j.host, '.' || rh)) AND starts_with(j.path, rp)) AS b FROM j)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, CASE WHEN low > {MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
  round(low, 6) AS bad_bound FROM best"""

QUERIES = {"op4_host_reputation": op4_host_reputation}
ORACLES = {"op4_host_reputation": _ORACLE}
