"""URL filters: rules first, then empirical-Bayes host reputation, DataFrame operations only.

Pages that a rule decides, and whatever else is labelled, are the outcomes. A host's share of blocked pages is shrunk towards
its registered domain's, that towards its suffix's, and that towards the overall share: at each level
the parent's mean and a strength fitted by the method of moments make a beta prior. A page without a
rule is blocked if the lower posterior bound of its host's share exceeds a half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed

#: (host, path, verdict), fixed by the contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Suffixes of two labels that are registered below; a parameter, as there is no end to them.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
LIMIT, Z = 0.5, 1.6449
LEAST_STRENGTH, MOST_STRENGTH, PLAIN_STRENGTH = 1.0, 1000.0, 10.0


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def levels(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without its port; an address is its own domain, of suffix ``ip``."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") | bare.startswith("[")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(*suffixes)
    domain = F.when(address, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, F.when(address, "ip").when(long, two).otherwise(F.substring_index(bare, ".", -1))


def _strength(children: DataFrame) -> float:
    """Of ``children(n, k, mean)``: the method-of-moments strength of the beta prior they share; one row is fetched."""
    seen = children.where("n > 0")
    p = F.col("k") / F.col("n")
    got = seen.agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum(F.col("n") * (p - F.col("mean")) ** 2).alias("s"), F.sum(1 / F.col("n")).alias("r"), (F.sum(F.col("n") * F.col("mean") * (1 - F.col("mean"))) / F.sum("n")).alias("v")).first()
    if got.c < 2:
        return PLAIN_STRENGTH
    spread = got.c * got.s / ((got.c - 1) * got.n)
    excess = spread - got.v * got.r / got.c
    strength = (got.v - spread) / excess if excess > 0 else MOST_STRENGTH
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, strength))


def reputation(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """(host, a, b): the beta posterior of each host's share of bad pages, from ``outcomes(host, n, k)``.

    n pages are labelled, k of them bad; a host has one row. Three aggregations on ever fewer keys; from each level one row
    of moments reaches the driver.
    """
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = outcomes.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = tops.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = total.k / total.n if total.n else 0.0

    def shrunk(level: DataFrame) -> tuple[DataFrame, Column, Column]:
        s = _strength(level)
        return level, F.col("mean") * s + F.col("k"), (1 - F.col("mean")) * s + F.col("n") - F.col("k")

    level, a, b = shrunk(tops.withColumn("mean", F.lit(float(mean))))
    means = level.select("suffix", (a / (a + b)).alias("mean"))
    level, a, b = shrunk(domains.join(means, "suffix"))
    means = level.select("domain", (a / (a + b)).alias("mean"))
    level, a, b = shrunk(hosts.join(means, "domain"))
    return level.select("host", a.alias("a"), b.alias("b"))


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, suffixes=SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block), one row for each row of ``pages(page_id, url)``.

    Labelled outcomes are the verdicts of the rules, and those of ``labels(host, blocked boolean)``, if
    given. A null url, and one without ``://``, has an empty host and path and gets the overall prior's
    verdict; so does a host of which nothing is known at any level. p_block is the posterior mean of the
    host's share of blocked pages. An empty table gives no rows; repeated rows count as outcomes each;
    of rules that fit equally long the last listed wins; other columns are ignored.
    """
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule(F.col("host"), F.col("path"), rules))
    seen = rows.select("host", F.when(F.col("found").isNotNull(), F.col("found.verdict") == "block").alias("bad"))
    if labels is not None:
        seen = seen.union(labels.select("host", "blocked"))
    counts = checkpointed(seen.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("k")))  # read for every level
    known = reputation(counts, suffixes)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    bound = mean - Z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    known = known.select("host", mean.alias("p_block"), F.when(bound > LIMIT, "block").otherwise("allow").alias("judged"))
    both = rows.join(known, "host")
    return both.select("page_id", "host", "path", "found.rule", F.coalesce("found.verdict", "judged").alias("verdict"), F.round("p_block", 9).alias("p_block"))


ORACLE = r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
r as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
f as (select *, case
  when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from r),
g as (select *, case when rule is null then null when rule in ('com/', 'www.example.com/en/') then 'allow' else 'block' end ruled from f),
h0 as (select host, count(ruled) n, count(*) filter (ruled = 'block') k, regexp_replace(host, ':[0-9]*$', '') bare from g group by host),
h1 as (select *, array_to_string(string_split(bare, '.')[-2:], '.') two from h0),
h2 as (select *, regexp_matches(bare, '^[0-9]+([.][0-9]+){3}$') or starts_with(bare, '[') address from h1),
h as (select host, n, k,
  case when address then bare when two in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') then array_to_string(string_split(bare, '.')[-3:], '.') else two end as "domain",
  case when address then 'ip' when two in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') then two else string_split(bare, '.')[-1] end as suffix from h2),
d as (select "domain", suffix, sum(n) n, sum(k) k from h group by all),
t as (select suffix, sum(n) n, sum(k) k from d group by all),
tm as (select t.*, coalesce((select sum(k) / nullif(sum(n), 0) from t), 0) mean from t),
ts as (select count(*) c, sum(n) n, sum(n * (k / n - mean) ** 2) s, sum(1 / n) r, sum(n * mean * (1 - mean)) / sum(n) v from tm where n > 0),
tv as (select case when c < 2 then 10.0::double when c * s / ((c - 1) * n) - v * r / c > 0 then least(1000.0, greatest(1.0, (v - c * s / ((c - 1) * n)) / (c * s / ((c - 1) * n) - v * r / c))) else 1000.0 end z from ts),
dm as (select d.*, (tm.mean * z + tm.k) / (z + tm.n) mean from d join tm using (suffix), tv),
ds as (select count(*) c, sum(n) n, sum(n * (k / n - mean) ** 2) s, sum(1 / n) r, sum(n * mean * (1 - mean)) / sum(n) v from dm where n > 0),
dv as (select case when c < 2 then 10.0::double when c * s / ((c - 1) * n) - v * r / c > 0 then least(1000.0, greatest(1.0, (v - c * s / ((c - 1) * n)) / (c * s / ((c - 1) * n) - v * r / c))) else 1000.0 end z from ds),
hm as (select h.*, (dm.mean * z + dm.k) / (z + dm.n) mean from h join dm using ("domain"), dv),
hs as (select count(*) c, sum(n) n, sum(n * (k / n - mean) ** 2) s, sum(1 / n) r, sum(n * mean * (1 - mean)) / sum(n) v from hm where n > 0),
hv as (select case when c < 2 then 10.0::double when c * s / ((c - 1) * n) - v * r / c > 0 then least(1000.0, greatest(1.0, (v - c * s / ((c - 1) * n)) / (c * s / ((c - 1) * n) - v * r / c))) else 1000.0 end z from hs),
p as (select host, mean * z + k a, (1 - mean) * z + n - k b from hm, hv),
q as (select host, a / (a + b) m, a + b ab from p)
select page_id, host, path, rule, coalesce(ruled, case when m - 1.6449 * sqrt(m * (1 - m) / (ab + 1)) > 0.5 then 'block' else 'allow' end) verdict, round(m, 9) p_block
from g join q using (host)
"""
