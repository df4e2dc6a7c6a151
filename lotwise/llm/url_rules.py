"""URL filters: host-suffix and path-prefix expressions against hashed rules.

Every URL is expanded into expressions: each suffix of its host's labels with each prefix of its
path whose length some rule's path has.  Expressions are joined with the rules by the first bytes
of their SHA-256 digest, then the whole digest is compared, and the longest rule wins (the longer
host among equals, then block before allow).

Equal (host, path start) pairs are expanded once, so a host with a third of all pages costs the
paths it has.  Only DataFrame functions are used.
"""

from pyspark.sql import functions as F

from lotwise.llm.tables import unused

PREFIX_HEX = 8
BROADCAST_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def rules_table(spark, rules=RULES):
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_of(url):
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url):
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def judge(pages, rules, default="allow", url="url"):
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``verdict``, ``host`` (lower case) and ``path``; one rule's text is host and path
    together.  Without a fitting rule ``rule`` is null and the verdict is ``default``.  A null URL
    or one without ``://`` has an empty host and path, which fit no rule.  Repeated rows stay;
    repeated rules count once, and rules with a null are left out.  Other columns stay, but columns
    of these four names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    pages = pages.withColumns({"host": host_of(address), "path": path_of(address)})
    rules = rules.dropna(subset=["verdict", "host", "path"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect())
    reach = max(lengths, default=0)
    keyed = rules.select(
        _digest(F.col("host"), F.col("path")).alias("digest"),
        F.concat("host", "path").alias("rule"), F.col("verdict"), F.length("host").alias("host_size"),
    ).withColumn("start", F.substring("digest", 1, PREFIX_HEX))
    if rules.count() <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)

    heads = pages.select("host", F.substring("path", 1, reach).alias("head")).filter("host <> ''").distinct()
    expanded = heads.select("host", "head", F.explode(_expressions(F.col("host"), F.col("head"), lengths)).alias("digest"))
    expanded = expanded.withColumn("start", F.substring("digest", 1, PREFIX_HEX))
    hits = expanded.join(keyed, "start").filter(expanded.digest == keyed.digest)
    best = hits.groupBy("host", "head").agg(
        F.max(F.struct(F.length("rule").alias("size"), "host_size", "verdict", "rule")).alias("best")
    )
    of_host, of_head = unused(pages.columns, "judged_host"), unused(pages.columns, "judged_head")
    best = best.select(
        F.col("host").alias(of_host), F.col("head").alias(of_head),
        F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"),
    )
    same = (F.col("host") == F.col(of_host)) & (F.substring("path", 1, reach) == F.col(of_head))
    judged = pages.join(best, same, "left").drop(of_host, of_head)
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _expressions(host, head, lengths):
    """Digests of all host suffixes with the path prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(head))
    paths = F.transform(fitting, lambda n: F.substring(head, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: _digest(h, p)))))
