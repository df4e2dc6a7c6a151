"""``op4_url_rules``: verdict on the URL of every page."""

from lotwise.llm.registry import query, table
from lotwise.llm.url_rules import judge, rules_table

SQL = """
WITH rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
a AS (
  SELECT r, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
m AS (
  SELECT a.r, rules.host || rules.path AS rule, rules.verdict,
         row_number() OVER (PARTITION BY a.r ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC) AS n
  FROM a JOIN rules
    ON (a.host = rules.host OR ends_with(a.host, '.' || rules.host)) AND starts_with(a.path, rules.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM a LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (r)
"""


@query("op4_url_rules", SQL)
def op4_url_rules(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return judge(pages, rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")
