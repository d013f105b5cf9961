"""URL filters: rules, and for urls without a rule trust that flows along links between hosts.

Links of all pages become edges between hosts, counted and pre-aggregated in Spark. Trust is a personalised PageRank that
restarts at trusted hosts and follows links; distrust one that restarts at blocked hosts and follows them backwards, as
who links to a bad host is suspect. A host whose distrust outweighs its trust is blocked, all of its pages with it.
Blocked seeds are the hosts that a block rule for whole hosts fits (one for a part of a host says nothing of the rest),
trusted seeds those with a page that an allow rule fits; a host that is both is neither.

Each round joins ranks with edges by host and adds up by host, with partial sums before the shuffle, so a popular host
costs a row for each task; rounds are tables in the shared folder. Rounds end only when ranks change by less than `change`
in all, or there is nothing to flow.

Cases: null urls and urls without :// have an empty host and path, no rule, and the verdict of the empty host, which has
no links: allow. Null pages have no links. Repeated rows are judged one by one, and their links count each time.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, stage, unstage

Rule = tuple[str, str, str]  # verdict, host, path

#: The rules of the query.
RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = re.compile(r"""<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ABSOLUTE = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", re.I)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. Rules are configuration: a short list of literals."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts. A page counts its own links first, so it makes one row a host that it links to."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                src, dst, n = [], [], []
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found: dict[str, int] = {}
                    for m in _LINK.finditer(page or ""):
                        if to := _ABSOLUTE.match(html.unescape(m[1] or m[2] or m[3] or "").strip()):
                            name = to[1].translate(_FOLD)
                            if name and name != host:
                                found[name] = found.get(name, 0) + 1
                    src += [host] * len(found)
                    dst += found
                    n += found.values()
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string()), pa.array(n, pa.int64())], names=["src", "dst", "n"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col)).filter("host <> ''")
    return rows.mapInArrow(run, "src string, dst string, n long").groupBy("src", "dst").agg(F.sum("n").alias("n"))


_FOLD = str.maketrans(_UPPER, _LOWER)


def pagerank(graph: DataFrame, seeds: DataFrame, *, damping: float = 0.85, change: float = 1e-6, steps: int = 4) -> DataFrame:
    """(host, rank): personalised PageRank over (src, dst, weight), weights of a src adding up to 1, restarting at seeds (host). Rank that meets a host without links restarts too, by the final scaling to 1. A round is `steps` steps in one plan; each step changes at most `damping` times what the one before changed, so rounds end by themselves: 90 steps or so reach 1e-6 at 0.85."""
    count = seeds.count()
    if not count:
        return seeds.select("host", F.lit(0.0).alias("rank"))
    start = seeds.select("host", F.lit((1 - damping) / count).alias("rank"))
    now = stage(seeds.select("host", F.lit(1.0 / count).alias("rank")), "ranks")
    while True:
        nxt = now
        for _ in range(steps):
            moved = nxt.join(graph, nxt.host == graph.src).select(F.col("dst").alias("host"), (F.col("rank") * F.col("weight") * damping).alias("rank"))
            nxt = moved.union(start).groupBy("host").agg(F.sum("rank").alias("rank"))
        nxt = stage(nxt, "ranks")
        gap = now.select("host", (-F.col("rank")).alias("rank")).union(nxt).groupBy("host").agg(F.sum("rank").alias("d")).agg(F.sum(F.abs("d"))).first()[0]
        unstage(now)
        now = nxt
        if gap < change:
            break
    total = now.agg(F.sum("rank")).first()[0]
    return now.select("host", (F.col("rank") / total).alias("rank"))


def propagate(links: DataFrame, trusted: DataFrame, blocked: DataFrame, **how) -> DataFrame:
    """(host, trust, distrust) of every host that any of the two flows reach. links: (src, dst, n)."""

    def weighted(src: str, dst: str) -> DataFrame:
        out = links.groupBy(src).agg(F.sum("n").alias("_all"))
        return links.join(out, src).select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("n") / F.col("_all")).alias("weight"))

    if links.isEmpty():  # nothing flows: seeds keep what they start with
        ahead, back = (x.select("host", F.lit(1.0).alias("rank")) for x in (trusted, blocked))
    else:
        ahead = pagerank(stage(weighted("src", "dst"), "links"), trusted, **how)
        back = pagerank(stage(weighted("dst", "src"), "links"), blocked, **how)
    both = ahead.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).union(back.select("host", F.lit(0.0), F.col("rank")))
    return both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge(
    pages: DataFrame, *, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5, **how,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, suspicion): the rule's verdict, else block if the host's share of distrust, distrust / (trust + distrust), is over the threshold."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "_by_rule": verdict})
    whole = [h + p for kind, h, p in rules if kind == "block" and p == "/"]
    seeds = stage(rows.filter("_by_rule is not null").groupBy("host").agg(F.bool_or(F.col("_by_rule") == "allow").alias("good"), F.bool_or((F.col("_by_rule") == "block") & F.col("rule").isin(whole)).alias("bad")), "seeds")
    links = stage(edges(pages, url_col=url_col, html_col=html_col), "links")
    flows = propagate(links, seeds.filter("good and not bad").select("host"), seeds.filter("bad and not good").select("host"), **how)
    scored = stage(flows.select("host", (F.col("distrust") / (F.col("trust") + F.col("distrust"))).alias("suspicion")), "suspicion")
    suspect = scored.filter(F.col("suspicion") > threshold)
    out = rows.join(suspect, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", F.when(F.col("suspicion").isNotNull(), "block").otherwise("allow")).alias("verdict"), "suspicion")
