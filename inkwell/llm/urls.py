"""URL filters by a temporal list join.

A list is a log of dated entries, each adding a pattern or taking it off. The entries of a pattern become validity
intervals, from each to the next; an as-of join finds for every capture the entry of each of its
patterns that was in force when it was fetched. A pattern is a domain, which covers its subdomains, or
a domain with a path, which covers the paths below. A capture is listed if any of its patterns is; the longest one is told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url):
    return F.lower(F.regexp_extract(url, HOST, 1))


def patterns(url, domain_labels=None):
    """Patterns that cover a URL: its host and the domains above, and the host with each leading part of its path.
    domain_labels: numbers of labels that domains of the list have; domains of others are left out."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    lengths = F.sequence(F.lit(1), n)
    if domain_labels is not None:
        lengths = F.array_intersect(lengths, F.array(*[F.lit(int(k)) for k in domain_labels]).cast("array<int>"))
    domains = F.transform(lengths, lambda k: F.array_join(F.slice(labels, -k, k), "."))
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    m = F.size(parts)
    paths = F.when(m > 0, F.transform(F.sequence(F.lit(1), m), lambda k: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host(url) != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def normal(pattern):
    """A pattern as patterns() writes it: the host in lower case, the path's case and order kept, no empty parts."""
    parts = F.split(pattern, "/")
    path = F.filter(F.slice(parts, 2, F.size(parts)), lambda x: x != "")
    return F.array_join(F.concat(F.array(F.lower(F.element_at(parts, 1))), path), "/")


def intervals(entries: DataFrame) -> DataFrame:
    """entries(pattern, action, at, category) as pattern, category, valid_from, valid_to (null: still).

    Each entry holds from its time to the pattern's next; of entries of one time a removal holds, else that of
    the first category. Patterns that differ in the case of the host are one. Only intervals that list the pattern are kept; entries without pattern or time are none."""
    dated = entries.filter("pattern is not null and at is not null and action in ('add', 'remove')").withColumn("pattern", normal(F.col("pattern")))
    at_once = Window.partitionBy("pattern", "at").orderBy(F.col("action").desc(), "category")
    one = dated.withColumn("_k", F.row_number().over(at_once)).filter("_k = 1")
    nxt = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    return one.withColumn("valid_to", nxt).filter("action = 'add'").select("pattern", "category", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, *, url_col="url", time_col="fetched_at") -> DataFrame:
    """captures with listed, pattern, category and since, of the longest pattern in force at the fetch.

    Captures of one URL and time are looked up once, so a hot host is as many rows as it has distinct captures; domains
    of lengths that the list has none of (top-level ones, mostly) aren't looked up at all. Repeated captures
    are rows of their own. A null or unreadable URL, or a null time, is not listed; an empty list lists nothing, an empty table
    gives no rows. Columns of captures that are named like a result give way to it."""
    results = ("listed", "pattern", "category", "since")
    u, t = "_inkwell_url", "_inkwell_at"
    own = captures.select(F.struct(*[F.col(c) for c in captures.columns if c not in results]).alias("_inkwell_row"), F.col(url_col).alias(u), F.col(time_col).alias(t))
    held = cut(intervals(entries), "intervals")
    lengths = [r[0] for r in held.filter(~F.col("pattern").contains("/")).select(F.size(F.split("pattern", r"\."))).distinct().collect()]  # a row a length
    asked = own.filter(f"{u} is not null and {t} is not null").select(u, t).distinct()
    keyed = asked.select(u, t, F.explode(patterns(F.col(u), lengths)).alias("pattern"))
    hit = keyed.join(held, "pattern").filter((F.col("valid_from") <= F.col(t)) & (F.col("valid_to").isNull() | (F.col(t) < F.col("valid_to"))))
    best = hit.groupBy(u, t).agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "category", "valid_from")).alias("b"))
    out = own.join(best, [u, t], "left")
    return out.select("_inkwell_row.*", F.col("b").isNotNull().alias("listed"), F.col("b.pattern").alias("pattern"), F.col("b.category").alias("category"), F.col("b.valid_from").alias("since"))


_HEX = "0123456789abcdef"


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list over the domains of pages, by rule from the domain's MD5: about half are listed for a time, and some anew."""
    domain = F.regexp_extract(host(F.col("url")), r"([^.]+\.[^.]+\.[^.]+)$", 1)
    d = pages.select(domain.alias("pattern")).filter("pattern != ''").distinct().withColumn("m", F.md5("pattern"))
    digit = lambda k: F.expr(f"instr('{_HEX}', substr(m, {k}, 1)) - 1")
    d = d.filter(digit(1) < 9).withColumns({"a": digit(2) * 12, "b": digit(2) * 12 + 10 + digit(3) * 8, "again": digit(4) < 6, "category": F.element_at(F.array(F.lit("spam"), F.lit("malware"), F.lit("adult"), F.lit("ads")), F.pmod(digit(5), F.lit(4)).cast("int") + 1)})
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int"))
    entry = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("at"))
    log = F.array(entry("add", day(F.col("a"))), entry("remove", day(F.col("b"))))
    log = F.when(F.col("again"), F.concat(log, F.array(entry("add", day(F.col("b") + 40))))).otherwise(log)
    return d.select("pattern", "category", F.explode(log).alias("e")).select("pattern", "category", "e.action", "e.at")


def op7(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched_at"))
    out = filter_urls(captures, sample_list(pages))
    return out.select("page_id", "url", F.col("fetched_at").cast("string").alias("fetched_at"), "listed", "pattern", "category", F.col("since").cast("string").alias("since"))


OP7_SQL = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host
  FROM pages),
d AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS pattern FROM c),
x AS (SELECT pattern, md5(pattern) AS m FROM d WHERE pattern <> ''),
y AS (SELECT pattern, instr('0123456789abcdef', substr(m, 1, 1)) - 1 AS k1, instr('0123456789abcdef', substr(m, 2, 1)) - 1 AS k2,
             instr('0123456789abcdef', substr(m, 3, 1)) - 1 AS k3, instr('0123456789abcdef', substr(m, 4, 1)) - 1 AS k4,
             instr('0123456789abcdef', substr(m, 5, 1)) - 1 AS k5 FROM x),
i AS (
  SELECT pattern, ['spam', 'malware', 'adult', 'ads'][CAST(k5 % 4 AS INTEGER) + 1] AS category,
         DATE '2024-01-01' + CAST(k2 * 12 AS INTEGER) AS f, DATE '2024-01-01' + CAST(k2 * 12 + 10 + k3 * 8 AS INTEGER) AS t FROM y WHERE k1 < 9
  UNION ALL
  SELECT pattern, ['spam', 'malware', 'adult', 'ads'][CAST(k5 % 4 AS INTEGER) + 1],
         DATE '2024-01-01' + CAST(k2 * 12 + 50 + k3 * 8 AS INTEGER), NULL FROM y WHERE k1 < 9 AND k4 < 6)
SELECT c.page_id, c.url, CAST(c.at AS VARCHAR) AS fetched_at, i.pattern IS NOT NULL AS listed, i.pattern AS pattern, i.category AS category, CAST(i.f AS VARCHAR) AS since
FROM c LEFT JOIN i ON (c.host = i.pattern OR c.host LIKE '%.' || i.pattern) AND i.f <= c.at AND (i.t IS NULL OR c.at < i.t)
"""
