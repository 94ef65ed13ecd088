"""URL filters: rules by host and path, and trust spread over the links between hosts.

Rules decide the pages they fit.  All allowed pages together are a trust of 1, dealt
to their hosts, and all blocked pages a distrust of 1.  Trust follows the links
(personalised PageRank from the trusted hosts), distrust runs against them from the
blocked ones: who links to a blocked host earns some.  Rounds go on until nothing
moves any more.  A page that no rule fits is blocked where its host's share of the
distrust exceeds its share of the trust by more than the host's share of all pages,
so a host is blocked when distrust is denser there than over the whole table.  All
of it is DataFrame operations.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

#: (host, path from its slash on, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING = 0.85
#: Mass, of 1, that may still move between two looks at it; and rounds from one look to the next.
SETTLED = 1e-4
STEP = 3
#: Density of distrust less trust, in multiples of the table's, above which a host is blocked (off any simple fraction).
LIMIT = 1.000001
#: Parts a host's pages are dealt to when they learn its verdict.
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a string, or null."""
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for h, p, v in rules:
        out = F.when(rule == h + p, F.lit(v)).otherwise(out)
    return out


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """src, dst, n: pages of src that link to another host dst; links within a host do not count."""
    hrefs = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"), F.lit(1))
    hosts = F.transform(hrefs, lambda u: host_of(F.regexp_replace(u, "^//", "http://")))
    found = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(hosts)).alias("dst"))
    return found.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """kind, host, mass: what the seeds (kind, host, seed; 1 in all for each kind) come to over the edges (kind, src, dst, share).

    Mass of a host without edges goes back to the seeds of its kind.  Without
    ``rounds`` it goes on until no more than SETTLED moves; each round shrinks the
    rest by ``damping``, so it ends.  Every few rounds are written to the shared
    checkpoint folder, and the folder before is removed.
    """
    now = seeds.select("kind", "host", F.col("seed").alias("mass"))
    if rounds == 0 or not edges.limit(1).count():
        return now  # nowhere to spread to
    ends = edges.select("kind", F.col("src").alias("host")).distinct()
    done, held = 0, None
    while rounds is None or done < rounds:
        new = now
        for _ in range(STEP if rounds is None else min(STEP, rounds - done)):
            # A row for each kind, of which there are two.
            idle = new.join(ends, ["kind", "host"], "left_anti").groupBy("kind").agg(F.sum("mass").alias("idle"))
            base = seeds.join(F.broadcast(idle), "kind", "left").select("kind", "host", (F.col("seed") * ((1 - damping) + damping * F.coalesce("idle", F.lit(0.0)))).alias("mass"))
            moved = new.join(edges.withColumnRenamed("src", "host"), ["kind", "host"]).select("kind", F.col("dst").alias("host"), (damping * F.col("mass") * F.col("share")).alias("mass"))
            new = base.unionByName(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
            done += 1
        new = core.checkpoint(new)
        if rounds is None:
            moves = new.unionByName(now.select("kind", "host", (-F.col("mass")).alias("mass"))).groupBy("kind", "host").agg(F.abs(F.sum("mass")).alias("m"))
            change = moves.agg(F.sum("m")).first()[0]
        if held is not None:
            core.release(held)
        now = held = new
        if rounds is None and change <= SETTLED:
            break
    return now


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, damping: float = DAMPING, rounds: int | None = None, limit: float = LIMIT) -> DataFrame:
    """id_col, host, path, rule, verdict, trust, distrust (of the host; 1 in all hosts); one row for each input row.

    ``rounds`` fixes the number of rounds; without it they go on until nothing moves.

    Nulls: a null url or one without :// has an empty host and path, fits no rule
    and is allowed; a null html has no links.  Repeated rows count as pages each.
    An empty table gives none.  Other columns are not read, whatever their names;
    texts of any length are read as they are.
    """
    rows = pages.select(F.col(id_col).alias("page"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("__html"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("own", verdict_of(F.col("rule"), rules))
    hosts = core.checkpoint(
        rows.filter("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.when(F.col("own") == "allow", 1.0).otherwise(0.0)).alias("allowed"), F.sum(F.when(F.col("own") == "block", 1.0).otherwise(0.0)).alias("blocked"))
    )
    links = core.checkpoint(host_links(rows, "__html"))
    totals = hosts.agg(F.sum("pages").alias("pages"), F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    every, allowed, blocked = (float(x or 0) for x in totals)

    def seeds(kind: str, column: str, total: float) -> DataFrame:
        return hosts.filter(F.col(column) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(column) / (total or 1.0)).alias("seed"))

    def edges(kind: str, frm: str, to: str) -> DataFrame:
        out = links.groupBy(frm).agg(F.sum("n").alias("all"))
        return links.join(out, frm).select(F.lit(kind).alias("kind"), F.col(frm).alias("src"), F.col(to).alias("dst"), (F.col("n") / F.col("all")).alias("share"))

    paths = edges("trust", "src", "dst").unionByName(edges("distrust", "dst", "src"))
    mass = spread(seeds("trust", "allowed", allowed).unionByName(seeds("distrust", "blocked", blocked)), paths, damping, rounds)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind)
    judged = (
        hosts.select("host", "pages")
        .join(mass.groupBy("host").agg(of("trust"), of("distrust")), "host", "left")
        .select("host", "pages", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
        .withColumn("verdict_host", F.when((F.col("distrust") - F.col("trust")) * every > limit * F.col("pages"), F.lit("block")).otherwise(F.lit("allow")))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    # A host may hold a third of all pages, so they are dealt to the copies of its verdict.
    out = rows.drop("__html").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(judged, ["host", "salt"], "left")
    return out.select(F.col("page").alias(id_col), "host", "path", "rule", F.coalesce("own", "verdict_host", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op1(spark, sf_dir):
    return filter_urls(core.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def verdict_sql() -> str:
    """DuckDB SQL of the same verdicts over ``pages``, with as many rounds as the masses can need to settle."""
    rounds = ceil(log(SETTLED / 2) / log(DAMPING))
    case, own = "CASE", "CASE rule"
    for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        case += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        own += f" WHEN '{h}{p}' THEN '{v}'"
    host = "translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '" + _UPPER + "', '" + _LOWER + "')"
    parts = [
        f"""WITH p AS MATERIALIZED (SELECT page_id, {host.format(u='url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
r AS MATERIALIZED (SELECT *, {own} END AS own FROM (SELECT *, {case} END AS rule FROM p)),
h AS MATERIALIZED (SELECT host, count(*) AS pages, CAST(count(*) FILTER (own = 'allow') AS DOUBLE) AS allow0, CAST(count(*) FILTER (own = 'block') AS DOUBLE) AS block0 FROM r WHERE host <> '' GROUP BY host),
hrefs AS (SELECT host AS src, page_id, {host.format(u="regexp_replace(u, '^//', 'http://')")} AS dst FROM (SELECT host, page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']?((?:https?:)?//[^\"''\\s>]+)', 1)) AS u FROM r)),
links AS MATERIALIZED (SELECT src, dst, count(DISTINCT page_id) AS n FROM hrefs WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)"""
    ]
    parts.append("""e AS MATERIALIZED (SELECT 'trust' AS kind, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS share FROM links
UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links)""")
    parts.append("""s AS MATERIALIZED (SELECT 'trust' AS kind, host, allow0 / (SELECT sum(allow0) FROM h) AS seed FROM h WHERE allow0 > 0
UNION ALL SELECT 'distrust', host, block0 / (SELECT sum(block0) FROM h) FROM h WHERE block0 > 0)""")
    parts.append("m0 AS MATERIALIZED (SELECT kind, host, seed AS mass FROM s)")
    for i in range(rounds):
        parts.append(
            f"""m{i + 1} AS MATERIALIZED (SELECT kind, host, sum(mass) AS mass FROM (
SELECT s.kind, host, seed * ({1 - DAMPING!r} + {DAMPING} * coalesce(idle, 0)) AS mass FROM s LEFT JOIN (SELECT kind, sum(mass) AS idle FROM m{i} WHERE (kind, host) NOT IN (SELECT (kind, a) FROM e) GROUP BY kind) AS i ON s.kind = i.kind
UNION ALL SELECT e.kind, b, {DAMPING} * mass * share FROM m{i} JOIN e ON m{i}.kind = e.kind AND host = a) GROUP BY kind, host)"""
        )
    return ",\n".join(parts) + f""",
v AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) - coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS more FROM m{rounds} GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(own, CASE WHEN more * (SELECT sum(pages) FROM h) > {LIMIT} * pages THEN 'block' END, 'allow') AS verdict
FROM r LEFT JOIN h ON r.host = h.host LEFT JOIN v ON r.host = v.host
"""
