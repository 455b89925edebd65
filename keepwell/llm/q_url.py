"""Query op1: every page's url judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.llm.base import query, table
from keepwell.llm.url_reputation import TWO_LABEL_SUFFIXES, Rule, judge

RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
         Rule("net", "/es/", "block"), Rule("net", "/fr/", "block")]
LIMIT, Z, LEAST, MOST = 0.2, 1.64, 2.0, 1000.0

_FIT = "(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
_RANKED = sorted(RULES, key=lambda r: -len(r.host + r.path))
_CASE = lambda pick: "CASE " + " ".join(
    f"WHEN {_FIT.format(h=r.host, p=r.path)} THEN '{pick(r)}'" for r in _RANKED) + " END"


_VAR = "{a} * {b} / (pow({a} + {b}, 2) * ({a} + {b} + 1))"
_TWO = "array_to_string(string_split(host, '.')[-2:], '.')"
_IS_TWO = f"{_TWO} IN ({', '.join(repr(x) for x in TWO_LABEL_SUFFIXES)})"


def _level(name: str, source: str) -> str:
    return f"""{name}_m AS (SELECT 1.0 / least(greatest(coalesce(
    sum(pow(k / n - mu, 2) * n - mu * (1 - mu)) / nullif(sum((n - 1) * mu * (1 - mu)), 0), 1.0),
    1.0 / {MOST + 1}), 1.0 / {LEAST + 1}) - 1 AS m FROM {source} WHERE n > 0),
{name}_r AS (SELECT s.*, m, (k + m * mu) / (n + m) AS rate,
  {_VAR.format(a='(k + m * mu)', b='(n - k + m * (1 - mu))')} + pow(m / (n + m), 2) * mu_var AS var FROM {source} s, {name}_m)"""


SQL = f"""WITH p AS (SELECT page_id, try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS page_key,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id AS page_key, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
h AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k,
  CASE WHEN {_IS_TWO} THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE {_TWO} END AS domain,
  CASE WHEN {_IS_TWO} THEN {_TWO} ELSE string_split(host, '.')[-1] END AS sfx
  FROM p LEFT JOIN o USING (page_key) GROUP BY host),
d AS (SELECT domain, sfx, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT sfx, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
a AS (SELECT coalesce(sum(k), 0) + 0.5::DOUBLE AS bad, coalesce(sum(n - k), 0) + 0.5::DOUBLE AS good FROM s),
s0 AS (SELECT s.*, bad / (bad + good) AS mu, {_VAR.format(a='bad', b='good')} AS mu_var FROM s, a), {_level("s1", "s0")},
d0 AS (SELECT d.*, s1_r.rate AS mu, s1_r.var AS mu_var FROM d JOIN s1_r USING (sfx)), {_level("d1", "d0")},
h0 AS (SELECT h.*, d1_r.rate AS mu, d1_r.var AS mu_var FROM h JOIN d1_r USING (domain)), {_level("h1", "h0")},
bound AS (SELECT host, rate, greatest(rate - {Z} * sqrt(var), 0) AS b FROM h1_r)
SELECT page_id, host, path, {_CASE(lambda r: r.host + r.path)} AS rule,
  coalesce({_CASE(lambda r: r.action)}, CASE WHEN b > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  round(rate, 6) AS host_rate, round(b, 6) AS host_bound
FROM p JOIN bound USING (host)"""


@query("op1_url_reputation", SQL)
def op1_url_reputation(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("url", "/([0-9]+)", 1).try_cast("bigint").alias("page_key"))
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("page_key")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    judged = judge(pages, labels, RULES, LIMIT, z=Z, least=LEAST, most=MOST)
    return judged.select("page_id", "host", "path", "rule", "verdict",
                         F.round("host_rate", 6).alias("host_rate"), F.round("host_bound", 6).alias("host_bound"))
