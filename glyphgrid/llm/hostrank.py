"""URL filter by link-graph propagation over host edges.

Trust is personalised PageRank from trusted hosts along links; distrust is the
same from blocked hosts against the links' direction, so that who links to bad
hosts is distrusted.  A walk ends where a host has no link to follow.  Both are in
units of one seed's own share of teleports: a seed has at least 1 at every size of
the graph.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrid.llm.common import cut, kept, parts

DAMPING, ROUNDS, MAX_DISTRUST, MIN_TRUST = 0.85, 20, 0.05, 0.0
#: A host's outgoing steps beyond so many are spread over parts of that size, so that a hub's don't meet in one task.
HUB = 100_000
TLDS = ("com", "net", "org")


def everywhere(names: Sequence[str], tlds: Sequence[str] = TLDS) -> tuple[str, ...]:
    """Each name under each of the TLDs in use, as a name is met under any of them."""
    return tuple(f"{n}.example.{t}" for n in names for t in tlds)


TRUSTED = everywhere(("tionsh", "tionble", "ththnd"))
BLOCKED = everywhere(("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets"))
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
LINK = r"(?i)<a(?:rea)?\s[^<>]*?href\s*=\s*[\"']?((?:https?:)?//[^\"'\s<>]+)"


def host(url: Column) -> Column:
    """The lower-case host of an absolute or protocol-relative URL without a closing dot, else null.

    An IPv6 address keeps its brackets.
    """
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", ""), F.lit(""))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted over all pages.

    A relative link stays on its host and is no edge, also below a <base>, which
    isn't read; character references end no host name and aren't resolved.  A tag
    that is never closed ends at the next one.
    """
    links = pages.select(host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("to"))
    return links.select("src", host(F.col("to")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def seed_table(spark: SparkSession, trusted: Sequence[str] = TRUSTED, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """(side, domain) of seeds in lists: side 0 is trusted, 1 blocked.  A table of any length does as well."""
    return spark.createDataFrame([(0, s) for s in trusted] + [(1, s) for s in blocked], "side int, domain string")


def seeded(names: DataFrame, seeds: DataFrame) -> DataFrame:
    """(side, host) of the hosts of names (host) that are a seed or below one: their parent domains meet the seeds in an equi-join."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = seeds.select("side", "domain").where("side IS NOT NULL AND domain IS NOT NULL").distinct()
    return names.select("host", F.explode(domains).alias("domain")).join(own, "domain").select("side", "host").distinct()


def rank(hosts: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, named: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(host, trust, distrust) for the hosts of hosts (host) and edges (src, dst, n) that any seed reaches.

    What each round passes on is written once and summed over all rounds, so a
    round joins only the hosts that the walk has reached with the steps from them;
    it ends early where nothing is passed on.  Without seeds there are no rows.
    Repeated edges add up; null hosts have no part.  Hosts may be of any type where
    named, in place of seeded(), finds those of the seeds.
    """
    spark = edges.sparkSession
    links = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    both = links.select(F.lit(0).alias("side"), "src", "dst", "n").unionByName(links.select(F.lit(1).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    both = kept(both.groupBy("side", "src", "dst").agg(F.sum("n").alias("n")))
    out = kept(both.groupBy("side", "src").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("links")))
    # few hosts have so many links
    hubs = F.broadcast(out.where(F.col("links") > HUB).select("side", "src", F.ceil(F.col("links") / HUB).alias("salts")))
    salted = lambda df: df.join(hubs, ["side", "src"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    step = salted(both.join(out, ["side", "src"])).select("side", "src", F.pmod(F.xxhash64("dst"), "salts").alias("salt"), "dst", (F.col("n") / F.col("total") * damping).alias("share"))
    # sorted and placed once, so that a round moves only what hosts have and pass on
    step = step.repartition(parts(spark), "side", "src", "salt").sortWithinPartitions("side", "src", "salt").persist(StorageLevel.MEMORY_AND_DISK)
    names = hosts.select("host").union(out.select("src")).where("host IS NOT NULL").distinct()
    now = kept((named or seeded)(names, seeds).withColumn("r", F.lit(1.0)))
    passed = [now]
    for _ in range(rounds if not out.isEmpty() else 0):
        at = salted(now.withColumnRenamed("host", "src")).select("side", "src", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
        sent = step.join(at.hint("merge"), ["side", "src", "salt"])
        now = kept(sent.groupBy("side", F.col("dst").alias("host")).agg(F.sum(F.col("r") * F.col("share")).alias("r")))
        if now.isEmpty():
            break
        passed.append(now)
    step.unpersist()
    total = reduce(DataFrame.unionByName, passed)
    score = lambda side: F.round(F.coalesce(F.sum(F.when(F.col("side") == side, F.col("r"))), F.lit(0.0)), 9)
    return total.groupBy("host").agg(score(0).alias("trust"), score(1).alias("distrust"))


def keeps(max_distrust: float, min_trust: float) -> Column:
    return ((F.col("distrust") < max_distrust) | (F.col("trust") > F.col("distrust"))) & (F.col("trust") >= min_trust)


def filter_pages(pages: DataFrame, seeds: DataFrame | None = None, max_distrust: float = MAX_DISTRUST, min_trust: float = MIN_TRUST, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(page_id, host, trust, distrust, keep) for every row of pages.

    seeds is a table (side, domain), by default seed_table()'s.  A page stays when
    its host has less than max_distrust, or more trust than distrust, and at
    least min_trust: the threshold is the host's, its pages share it.
    A null or relative url has no host: scores of 0, and with the default
    min_trust it stays.  Null or empty html has no links.  Repeated rows are
    judged repeatedly, and their links count again; equal scores on both sides
    count as distrust; other columns, also of the output's names, are ignored; an
    empty table gives no rows.
    """
    seeds = seed_table(pages.sparkSession) if seeds is None else seeds
    placed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host(F.col("url")).alias("host"))
    ranked = rank(placed.select("host").distinct(), cut(host_edges(pages)), seeds, rounds, damping)
    scored = placed.join(ranked, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    return scored.select("page_id", "host", "trust", "distrust", keeps(max_distrust, min_trust).alias("keep"))


def trade_graph(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hosts, edges) of a shop's site for each customer and supplier: a customer links to the suppliers of its orders, these to customers by key."""
    hosts, edges = _trade_ids(customer, orders, lineitem)
    return hosts.select(_site("host").alias("host")), edges.select(_site("src").alias("src"), _site("dst").alias("dst"), "n")


def _site(of: str) -> Column:
    """The host of a number of _trade_ids()."""
    return F.concat(F.when(F.pmod(F.col(of), F.lit(2)) == 0, "c").otherwise("s"), F.shiftright(F.col(of), 1).cast("string"), F.lit(".example.com"))


def _trade_ids(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """trade_graph() with numbers for hosts: twice the key, and one more for a supplier."""
    c, s = (lambda k: (F.col(k).cast("bigint") * 2)), (lambda k: (F.col(k).cast("bigint") * 2 + 1))
    bought = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"]).groupBy(c("o_custkey").alias("c"), s("l_suppkey").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linenumber") == 1).alias("back"))
    bought = kept(bought)
    out = bought.select(F.col("c").alias("src"), F.col("s").alias("dst"), "n").unionByName(bought.where("back > 0").select(F.col("s").alias("src"), F.col("c").alias("dst"), F.col("back").alias("n")))
    return customer.select(c("c_custkey").alias("host")), out


#: Seeds of the trade graph: few hosts on either side, so that nearly all scores come by propagation.
TRADE_SEEDS = (("c1.example.com", "s2.example.com"), ("c7.example.com", "s5.example.com"))


def trade_ranks(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust, keep) of every host of trade_graph() that a seed reaches."""
    hosts, edges = _trade_ids(customer, orders, lineitem)

    def named(names: DataFrame, seeds: DataFrame) -> DataFrame:
        sites = names.select("host", _site("host").alias("site"))
        return seeded(sites.select(F.col("site").alias("host")), seeds).withColumnRenamed("host", "site").join(sites, "site").select("side", "host")

    ranked = rank(hosts, edges, seed_table(customer.sparkSession, *TRADE_SEEDS), rounds, damping, named)
    return ranked.select(_site("host").alias("host"), "trust", "distrust", keeps(MAX_DISTRUST, MIN_TRUST).alias("keep"))


def _rank_ctes(trusted: Sequence[str], blocked: Sequence[str], rounds: int, damping: float) -> list[str]:
    """CTEs from edges (src, dst, n) and names (host) to ranked (host, trust, distrust), the rounds unrolled."""
    below = lambda seeds: " OR ".join(f"host = '{s}' OR ends_with(host, '.{s}')" for s in seeds) or "false"
    ctes = [
        "directed AS (SELECT 0 AS side, src, dst, n FROM edges UNION ALL SELECT 1, dst, src, n FROM edges)",
        "step AS MATERIALIZED (SELECT side, src, dst, n / sum(n) OVER (PARTITION BY side, src) AS share FROM directed)",
        f"r0 AS MATERIALIZED (SELECT host, 0 AS side, 1.0::DOUBLE AS r FROM names WHERE {below(trusted)} UNION ALL SELECT host, 1, 1.0 FROM names WHERE {below(blocked)})",
    ]
    for k in range(rounds):
        ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT t.dst AS host, t.side, {damping}::DOUBLE * sum(r.r * t.share) AS r FROM r{k} r JOIN step t ON t.side = r.side AND t.src = r.host GROUP BY t.side, t.dst)")
    union = " UNION ALL ".join(f"SELECT host, side, r FROM r{k}" for k in range(rounds + 1))
    ctes.append(f"ranked AS (SELECT host, round(coalesce(sum(r) FILTER (side = 0), 0), 9) AS trust, round(coalesce(sum(r) FILTER (side = 1), 0), 9) AS distrust FROM ({union}) GROUP BY host)")
    return ctes


def _keeps_sql(max_distrust: float, min_trust: float) -> str:
    return f"(coalesce(distrust, 0.0) < {max_distrust} OR coalesce(trust > distrust, false)) AND coalesce(trust, 0.0) >= {min_trust}"


def sql(trusted: Sequence[str] = TRUSTED, blocked: Sequence[str] = BLOCKED, max_distrust: float = MAX_DISTRUST, min_trust: float = MIN_TRUST, rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """filter_pages() in DuckDB SQL over the view pages."""
    at = lambda url: f"nullif(regexp_replace(lower(regexp_extract({url}, '{HOST}', 1)), '\\.+$', ''), '')"
    link = LINK.replace("'", "''")
    ctes = [
        f"placed AS MATERIALIZED (SELECT page_id, {at('url')} AS host FROM pages)",
        f"links AS (SELECT {at('url')} AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS target FROM pages)",
        f"edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT src, {at('target')} AS dst FROM links) WHERE src <> dst GROUP BY src, dst)",
        "names AS (SELECT host FROM placed WHERE host IS NOT NULL UNION SELECT src FROM edges UNION SELECT dst FROM edges)",
        *_rank_ctes(trusted, blocked, rounds, damping),
    ]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT page_id, p.host AS host, coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust, {_keeps_sql(max_distrust, min_trust)} AS keep FROM placed p LEFT JOIN ranked r ON r.host = p.host"


def trade_sql(rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """trade_ranks() in DuckDB SQL over the views customer, orders and lineitem."""
    ctes = [
        "bought AS (SELECT 'c' || o_custkey || '.example.com' AS c, 's' || l_suppkey || '.example.com' AS s, l_linenumber = 1 AS back FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
        "edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT c AS src, s AS dst FROM bought UNION ALL SELECT s, c FROM bought WHERE back) GROUP BY src, dst)",
        "names AS (SELECT 'c' || c_custkey || '.example.com' AS host FROM customer UNION SELECT src FROM edges UNION SELECT dst FROM edges)",
        *_rank_ctes(*TRADE_SEEDS, rounds, damping),
    ]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT host, trust, distrust, {_keeps_sql(MAX_DISTRUST, MIN_TRUST)} AS keep FROM ranked"
