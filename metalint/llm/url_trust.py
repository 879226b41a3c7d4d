"""URL verdicts: host and path rules first, then trust propagated over the links between hosts.

Hosts whose pages an allow rule fits are trusted seeds, hosts whose pages a block rule fits are blocked seeds, each
with the share of all such pages that it holds. Trust is personalised PageRank from the trusted seeds along the
links, distrust the same from the blocked seeds against them (who links to a blocked host is suspect). A host is
blocked where its distrust exceeds ``DISTRUST`` of both together. Links are host pairs counted before they are
joined; a host's trust stays its own where it links nowhere. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metalint.llm.common import ascii_lower, cut

#: (verdict, host, path): a rule fits its host and all subdomains, where the path begins with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
ROUNDS = 20
CUT_EVERY = 5
DISTRUST = 0.5

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([a-z][a-z0-9+.-]*://[^\"'\s>]*)"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z folded; empty without one."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null. The rules are a short list of a policy."""
    out = F.lit(None)
    for verdict, of, begins in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(begins)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(of + begins).alias("rule"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another, counted; relative links stay on their host."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode_outer(targets).alias("to"))
    links = links.select("src", host_of(F.col("to")).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) from seeds (kind, host, seed), along links for trust and against them for distrust.

    score = (1 - DAMPING) * seed + DAMPING * what comes in, repeated. A hub's incoming shares combine before the
    shuffle; its outgoing links only need its one score row.
    """
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = cut(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")))
    seeds = cut(seeds)
    scores = seeds.select("kind", "host", F.col("seed").alias("score"))
    if shares.isEmpty():
        return scores.select("kind", "host", ((1 - DAMPING) * F.col("score")).alias("score"))
    for turn in range(1, rounds + 1):
        sent = shares.join(scores.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (DAMPING * F.col("score") * F.col("share")).alias("score"))
        kept = seeds.select("kind", "host", ((1 - DAMPING) * F.col("seed")).alias("score"))
        scores = sent.union(kept).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if turn % CUT_EVERY == 0:
            scores = cut(scores)
    return scores


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url, html).

    Other columns are not looked at. A null url or one without :// has an empty host and path, no rule and the
    verdict allow, as nothing speaks against it. Repeated rows count as often as they occur, in seeds and in links.
    """
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("found", first_rule(F.col("host"), F.col("path"), rules))
    kind = F.when(F.col("found.verdict") == "allow", "trust").otherwise("distrust")
    counted = judged.where("found is not null").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    totals = counted.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = counted.join(totals, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed"))
    scores = propagate(seeds, host_links(pages))
    of_kind = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    hosts = scores.groupBy("host").agg(of_kind("trust").alias("trust"), of_kind("distrust").alias("distrust"))
    blocked = hosts.where(F.col("distrust") > DISTRUST * (F.col("trust") + F.col("distrust"))).select(
        F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    out = judged.join(blocked, judged["host"] == blocked["bad_host"], "left")
    method = F.when(F.col("bad"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), method).alias("verdict"))


def verdict_sql() -> str:
    url = "coalesce(url, '')"
    folded = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = folded.format(f"regexp_extract({url}, '^.*?://([^/?#]*)([^?#]*)', 1, 's')")
    to_host = folded.format("regexp_extract(dest, '^.*?://([^/?#]*)([^?#]*)', 1, 's')")
    link = _LINK.removeprefix("(?is)").replace("'", "''")
    cases = {"verdict": "", "rule": ""}
    for verdict, of, begins in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{begins}') THEN "
        cases["verdict"] += fits + f"'{verdict}' "
        cases["rule"] += fits + f"'{of}{begins}' "
    rounds = ", ".join(f"""
        r{i} AS (SELECT kind, host, sum(score) AS score FROM (
            SELECT s.kind, s.dst AS host, {DAMPING} * r.score * s.share AS score FROM shares s JOIN r{i - 1} r ON r.kind = s.kind AND r.host = s.src
            UNION ALL SELECT kind, host, {1 - DAMPING} * seed FROM seeds) GROUP BY kind, host)""" for i in range(1, ROUNDS + 1))
    return f"""
        WITH u AS (SELECT page_id, html, {host} AS host, regexp_extract({url}, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
        j AS (SELECT *, CASE {cases['verdict']} END AS rv, CASE {cases['rule']} END AS rule FROM u),
        c AS (SELECT CASE rv WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM j WHERE rv IS NOT NULL GROUP BY 1, 2),
        seeds AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS seed FROM c),
        l AS (SELECT host AS src, {to_host} AS dst, count(*) AS n
              FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1, 'si')) AS dest FROM u) GROUP BY 1, 2),
        k AS (SELECT * FROM l WHERE src <> '' AND dst <> '' AND src <> dst),
        b AS (SELECT 'trust' AS kind, src, dst, n FROM k UNION ALL SELECT 'distrust', dst, src, n FROM k),
        shares AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM b),
        r0 AS (SELECT kind, host, seed AS score FROM seeds), {rounds},
        h AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust
              FROM r{ROUNDS} GROUP BY host)
        SELECT page_id, j.host, path, rule, coalesce(rv, CASE WHEN distrust > {DISTRUST} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
        FROM j LEFT JOIN h ON h.host = j.host"""
