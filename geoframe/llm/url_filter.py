"""URL filters: rules by host and path, and for what no rule judges the reputation of the host by empirical Bayes.

A url's host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; its path is what follows up to `?`, `#` or the end.
A rule fits its host and all subdomains if the path starts with the rule's; of those that fit the longest (host and path together) wins, then the
one of the longer host, then block before allow.

Reputation: pages with a known outcome (1: bad) are counted by host, registered domain, suffix and in all.  A node's rate of bad pages has a
beta prior around the posterior mean of the node above it; how many pages that prior is worth is estimated for each level by moments from
how much more the rates of siblings differ than pages drawn at random would (beta-binomial overdispersion).  So a host with few labelled
pages is judged by its domain, a domain by its suffix.  A host is blocked if its rate of bad pages is above `limit` even at the
lower bound of its posterior (mean less `z` deviations).

The suffix is the last label, or the last two where the last has two letters and the one before is a common second level (co.uk);
the registered domain is one label more, as far as there is one.  A host of digits and dots is its own domain, without a suffix.

Defined results: a null url, or one without `://`, has an empty host and path, which are judged like any other; a null page id has no outcome; of several
outcomes of one id the worst counts; repeated pages count each and stay as rows of their own; without any outcome nothing is blocked but by rule; urls of
any length are read whole; an empty table gives an empty table; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.llm.common import ascii_lower, written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Labels that stand for a second level below a country.
SECOND_LEVELS = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Rate of bad pages that a host must surely exceed, deviations of the bound, and pages that a prior is worth: where siblings tell nothing, at least, at most.
LIMIT, Z, WORTH, WORTH_LEAST, WORTH_MOST = 0.5, 1.645, 10.0, 1.0, 1000.0
_HOST, _PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, _HOST, 1)), F.regexp_extract(text, _PATH, 1)


def split_host(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    two = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVELS)
    wide = F.when(two, 2).otherwise(1)
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    address = host.rlike(r"^[0-9.]+$")
    return F.when(address, "").otherwise(tail(wide)), F.when(address, host).otherwise(tail(wide + 1))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The struct (name, verdict) of the rule that wins, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict != "block", r))
    if not ordered:
        return F.lit(None).cast("struct<name: string, verdict: string>")
    known = F.array(*(F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in ordered))
    # With a dot before both, a host is below the rule's if it ends with it.
    fits = F.filter(known, lambda r: F.endswith(F.concat(F.lit("."), host), F.concat(F.lit("."), r["host"])) & F.startswith(path, r["path"]))
    first = F.get(fits, 0)
    return F.when(first.isNotNull(), F.struct(F.concat(first["host"], first["path"]).alias("name"), first["verdict"].alias("verdict")))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, bad: how many of each host's pages have an outcome, and how many a bad one. pages: page_id, host; labels: page_id, bad (0 or 1)."""
    told = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    return pages.join(told, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"))


def reputation(counted: DataFrame, z: float = Z) -> DataFrame:
    """host, suffix, domain, n, bad, mean, lower: posterior mean and lower bound of each counted host's rate of bad pages."""
    suffix, domain = split_host(F.col("host"))
    hosts = written(counted, "url-hosts").select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = [whole.select(c).scalar() for c in (F.col("n"), F.col("bad"), (F.col("bad") + 1) / (F.col("n") + 2))]
    above = _priors(suffixes.withColumns(dict(zip(("up_n", "up_bad", "up"), top, strict=True))))
    for nodes, keys in ((domains, ["suffix"]), (hosts, ["suffix", "domain"])):
        parents = above.select(*keys, F.col("n").alias("up_n"), F.col("bad").alias("up_bad"), F.col("mean").alias("up"))
        above = _priors(nodes.join(parents, keys))
    sd = F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
    return above.select("host", "suffix", "domain", "n", "bad", "mean", (F.col("mean") - z * sd).alias("lower"))


def _priors(level: DataFrame) -> DataFrame:
    """A level's nodes, met by their parents' n, bad and mean (up_n, up_bad, up), with their posteriors: a, b and mean."""
    worth = level.agg(_worth().alias("worth")).scalar()
    level = level.withColumn("worth", worth).withColumn("a", F.col("worth") * F.col("up") + F.col("bad"))
    level = level.withColumn("b", F.col("worth") + F.col("n") - F.col("a"))
    return level.withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))).drop("up_n", "up_bad", "up", "worth")


def _worth() -> Column:
    """Pages that a level's priors are worth, by moments. Of children with n pages, k of them bad, below parents with N and K:
    the spread S = sum k*k/n - sum of parents' K*K/N would be P*Q*(children - parents) if all children of a parent had one rate, and is more by
    P*Q*overdispersion*(pages - sum n*n/N - (children - parents))."""
    n, k, up_n, up_k = (F.col(c).cast("double") for c in ("n", "bad", "up_n", "up_bad"))
    # A parent's terms come in shares, one with each child, as the children's n add up to N.
    free = F.count("*") - F.sum(n / up_n)
    apart = F.sum(k * k / n) - F.sum(n * up_k * up_k / (up_n * up_n))
    pq = F.sum(n * up_k * (up_n - up_k) / (up_n * up_n)) / F.sum(n)
    room = F.sum(n) - F.sum(n * n / up_n) - free
    over = (apart / pq - free) / room
    told = F.greatest(F.lit(WORTH_LEAST), F.least(F.lit(WORTH_MOST), 1 / F.greatest(over, F.lit(1 / (WORTH_MOST + 1))) - 1))
    return F.when((pq > 0) & (room > 1e-9), told).otherwise(F.lit(WORTH))


def judge(pages: DataFrame, rules: Sequence[Rule], labels: DataFrame, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict: a row for each row of pages (page_id, url). labels: page_id, bad (0 or 1; 1: the page turned out bad)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = reputation(outcomes(rows.select("page_id", "host"), labels), z).where(F.col("lower") > limit).select("host", F.lit("block").alias("reputed"))
    ruled = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    return ruled.join(bad, "host", "left").select("page_id", "host", "path", F.col("fit.name").alias("rule"), F.coalesce("fit.verdict", "reputed", F.lit("allow")).alias("verdict"))


def oracle_sql(rules: Sequence[Rule], limit: float = LIMIT, z: float = Z) -> str:
    """DuckDB SQL for judge(pages, rules, labels), where a page is bad if the label of its id says quality 0."""
    known = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    second = ", ".join(f"'{s}'" for s in SECOND_LEVELS)

    def level(name: str, nodes: str, parents: str, on: str) -> str:
        return f"""
{name}_met AS (SELECT c.*, p.n AS up_n, p.bad AS up_bad, p.mean AS up FROM {nodes} c JOIN {parents} p ON {on}),
{name}_sums AS (SELECT count(*) - sum(n / up_n) AS free, sum(bad * bad / n) - sum(n * up_bad * up_bad / (up_n * up_n)) AS apart,
  sum(n * up_bad * (up_n - up_bad) / (up_n * up_n)) / sum(n) AS pq, sum(n) - sum(n * n / up_n) AS spare FROM {name}_met),
{name}_worth AS (SELECT CASE WHEN pq > 0 AND spare - free > 1e-9
  THEN greatest({WORTH_LEAST}, least({WORTH_MOST}, 1 / greatest((apart / pq - free) / (spare - free), {1 / (WORTH_MOST + 1)!r}) - 1)) ELSE {WORTH} END AS w FROM {name}_sums),
{name} AS (SELECT m.*, w * up + bad AS a, w + n - (w * up + bad) AS b, (w * up + bad) / (w + n) AS mean FROM {name}_met m, {name}_worth)"""

    return rf"""
WITH cut AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parted AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rows AS (SELECT row_number() OVER () AS i, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parted),
rules(host, path, verdict) AS (VALUES {known}),
fits AS (SELECT i, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY i ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS place
  FROM rows JOIN rules r ON ends_with('.' || rows.host, '.' || r.host) AND starts_with(rows.path, r.path)),
told AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM rows JOIN told ON doc_id = page_id GROUP BY host),
named AS (SELECT *, string_split(host, '.') AS l FROM counted),
wide AS (SELECT *, CASE WHEN len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ({second}) THEN 2 ELSE 1 END AS k, regexp_matches(host, '^[0-9.]+$') AS address FROM named),
hosts AS (SELECT host, n, bad, CASE WHEN address THEN '' ELSE array_to_string(l[greatest(len(l) - k + 1, 1):], '.') END AS suffix,
  CASE WHEN address THEN host ELSE array_to_string(l[greatest(len(l) - k, 1):], '.') END AS domain FROM wide),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
top AS (SELECT sum(n) AS n, sum(bad) AS bad, (sum(bad) + 1) / (sum(n) + 2) AS mean FROM suffixes),{level("l1", "suffixes", "top", "true")},{level("l2", "domains", "l1", "c.suffix = p.suffix")},{level("l3", "hosts", "l2", "c.suffix = p.suffix AND c.domain = p.domain")},
reputed AS (SELECT host FROM l3 WHERE mean - {z} * sqrt(a * b / (a + b + 1)) / (a + b) > {limit})
SELECT page_id, rows.host, rows.path, f.rule, coalesce(f.verdict, CASE WHEN q.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM rows LEFT JOIN fits f ON f.i = rows.i AND f.place = 1 LEFT JOIN reputed q ON q.host = rows.host"""
