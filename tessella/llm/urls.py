"""URL filters: explicit host/path rules, then empirical-Bayes host reputation.

Outcomes of labelled pages are counted by host, registered domain and public
suffix.  Each level's beta prior is centred on its parent's posterior mean; its
strength comes from the spread between siblings (a moment estimate).  A host is
blocked when the lower posterior bound of its share of bad pages is above a
limit, so hosts with little evidence follow their domain and suffix.

Null urls and urls without ``://`` have an empty host and path, fit no rule and
form one host of their own.  Null outcomes count as unlabelled.  Repeated rows
are judged alike.  A url of any length is judged whole; an empty table gives an
empty result; no other column of the pages is read.  Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import LOWER, UPPER

#: Public suffixes of two labels that are told apart from a domain under one label.
TWO_LABEL_SUFFIXES = [
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
    "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and paths that start alike; text is ``host/path``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate(str.maketrans(UPPER, LOWER))

    @property
    def path(self) -> str:
        host, slash, rest = self.text.partition("/")
        return slash + rest


@dataclass(frozen=True)
class Reputation:
    """Block where the lower bound (z posterior deviations under the mean) of the bad share exceeds limit."""

    limit: float = 0.5
    z: float = 1.645
    least_strength: float = 1.0
    most_strength: float = 1000.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def domain_of(host: Column) -> Column:
    """The registered domain; addresses and single labels stand for themselves."""
    labels = F.split(host, r"\.")
    two = F.substring_index(host, ".", -2)
    named = F.when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)
    return F.when((F.size(labels) < 2) | host.rlike(r"^[0-9.]+(:[0-9]+)?$|^\["), host).otherwise(named)


def suffix_of(domain: Column) -> Column:
    return F.regexp_extract(domain, r"^[^.]*\.?(.*)$", 1)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of text and verdict; null if none does.

    The rules are plan-time constants (a filter list, not data).
    """
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(level: DataFrame, parent: list[str], p: Reputation) -> DataFrame:
    """Prior strength from the spread of children's shares around their parent's, pooled over parents."""
    family = level.groupBy(*parent).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b2"),
    )
    share = F.col("all_bad") / F.col("all_n")
    spread = share * (1 - share)
    pooled = family.where(spread > 0).select(
        ((F.col("b2") - F.col("all_bad") * share) / spread - (F.col("k") - 1)).alias("excess"),
        (F.col("all_n") - F.col("n2") / F.col("all_n") - (F.col("k") - 1)).alias("room"),
    )
    total = pooled.agg(F.sum("excess").alias("e"), F.sum("room").alias("r"))
    rho = F.when((F.col("r") > 0) & (F.col("e") > 0), F.least(F.col("e") / F.col("r"), F.lit(1.0)))
    kappa = F.least(F.greatest(1 / rho - 1, F.lit(p.least_strength)), F.lit(p.most_strength))
    return total.select(F.coalesce(kappa, F.lit(p.most_strength)).alias("kappa"))


def host_reputation(outcomes: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """One row per host of ``outcomes(host, bad)``: n, bad, posterior mean and lower bound of the bad share.

    ``bad`` is 1, 0 or null (unlabelled); hosts without labels get their domain's prior.
    """
    hosts = (
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    )
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    labelled = lambda df: df.where("n > 0")
    prior = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("mu"))
    shrink = lambda mean: (F.col("bad") + F.col("kappa") * F.col(mean)) / (F.col("n") + F.col("kappa"))
    # One-row tables: the cross joins add columns, never rows.
    by_suffix = (
        suffixes.crossJoin(F.broadcast(_strength(labelled(suffixes).withColumn("all", F.lit(1)), ["all"], p)))
        .crossJoin(F.broadcast(prior)).select("suffix", shrink("mu").alias("suffix_mean"))
    )
    by_domain = (
        domains.join(by_suffix, "suffix").crossJoin(F.broadcast(_strength(labelled(domains), ["suffix"], p)))
        .select("suffix", "domain", shrink("suffix_mean").alias("domain_mean"))
    )
    mean, total = F.col("mean"), F.col("n") + F.col("kappa")
    return (
        hosts.join(by_domain, ["suffix", "domain"]).crossJoin(F.broadcast(_strength(labelled(hosts), ["suffix", "domain"], p)))
        .withColumn("mean", shrink("domain_mean"))
        .select("host", "n", "bad", "mean", (mean - p.z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("bound"))
    )


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], p: Reputation = Reputation()) -> DataFrame:
    """``pages(page_id, url)`` with host, path, rule, verdict and bound.

    ``outcomes(page_id, bad)`` has at most one row per page.  A rule's verdict
    beats the reputation's.  A host that holds much of the table is aggregated
    map-side; its join back is of narrow rows, which Spark splits at run time.
    """
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).join(outcomes.select("page_id", "bad"), "page_id", "left")
    reputation = host_reputation(seen.select("host", "bad"), p).select("host", "bound")
    rule = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > p.limit, "block").otherwise("allow")
    return (
        judged.join(reputation, "host", "left").withColumn("found", rule)
        .select("page_id", "host", "path", F.col("found.text").alias("rule"), F.coalesce(F.col("found.verdict"), own).alias("verdict"), "bound")
    )


#: The same judgement in DuckDB's SQL, from page outcomes (bad: quality 0 or toxic 1).
SQL = r"""
with parts as (
  select page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '') h0,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') path from pages),
low as (select page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, path from parts),
lab as (select doc_id page_id, max(case when quality = 0 or toxic = 1 then 1 when quality is null and toxic is null then null else 0 end) bad
        from labels group by 1),
h1 as (select host, count(bad) n, coalesce(sum(bad), 0)::bigint bad from low left join lab using (page_id) group by 1),
h2 as (select *, case when len(string_split(host, '.')) < 2 or regexp_matches(host, '^[0-9.]+(:[0-9]+)?$|^\[') then host
   when regexp_extract(host, '([^.]*\.[^.]*)$', 1) in (TWO_LABEL) then regexp_extract(host, '((?:[^.]*\.)?[^.]*\.[^.]*)$', 1)
   else regexp_extract(host, '([^.]*\.[^.]*)$', 1) end as domain from h1),
hosts as (select *, regexp_extract(domain, '^[^.]*\.?(.*)$', 1) suffix from h2),
domains as (select suffix, domain, sum(n) n, sum(bad) bad from hosts group by all),
suffixes as (select suffix, sum(n) n, sum(bad) bad from domains group by all),
prior as (select (coalesce(sum(bad), 0) + 0.5e0) / (coalesce(sum(n), 0) + 1) mu from suffixes),
fam as (
  select 's' lv, count(*) k, sum(n) nn, sum(bad) bb, sum(n * n) n2, sum(bad * bad / n::double) b2 from suffixes where n > 0
  union all select 'd', count(*), sum(n), sum(bad), sum(n * n), sum(bad * bad / n::double) from domains where n > 0 group by suffix
  union all select 'h', count(*), sum(n), sum(bad), sum(n * n), sum(bad * bad / n::double) from hosts where n > 0 group by suffix, domain),
ex as (select lv, (b2 - bb * (bb / nn::double)) / ((bb / nn::double) * (1 - bb / nn::double)) - (k - 1) e, nn - n2 / nn::double - (k - 1) r
  from fam where (bb / nn::double) * (1 - bb / nn::double) > 0),
st as (select lv, case when sum(r) > 0 and sum(e) > 0 then least(greatest(1 / least(sum(e) / sum(r), 1.0e0) - 1, 1.0e0), 1000.0e0) else 1000.0e0 end kappa
  from ex group by lv),
kap as (select coalesce((select kappa from st where lv = 's'), 1000.0e0) ks, coalesce((select kappa from st where lv = 'd'), 1000.0e0) kd,
  coalesce((select kappa from st where lv = 'h'), 1000.0e0) kh),
sm as (select suffix, (bad + ks * mu) / (n + ks) m from suffixes, kap, prior),
dm as (select d.suffix, d.domain, (d.bad + kd * m) / (d.n + kd) m from domains d join sm using (suffix), kap),
hm as (select host, (bad + kh * m) / (n + kh) m, n + kh t from hosts join dm using (suffix, domain), kap),
rules(rule, rhost, rpath, rv) as (values RULES),
fit as (select page_id, max_by(rule, length(rule)) rule, max_by(rv, length(rule)) rv from low, rules
  where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by 1)
select page_id, host, path, rule,
  coalesce(rv, case when m - 1.645e0 * sqrt(m * (1 - m) / (t + 1)) > 0.5 then 'block' else 'allow' end) verdict
from low join hm using (host) left join fit using (page_id)
"""


def sql(rules: list[Rule]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(r.text)}, {quoted(r.host)}, {quoted(r.path)}, {quoted(r.verdict)})" for r in rules)
    return SQL.replace("TWO_LABEL", ", ".join(map(quoted, TWO_LABEL_SUFFIXES))).replace("RULES", values)
