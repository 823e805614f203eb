"""URL filter by link-graph propagation.

Edges lead from the host of a page to the hosts that its absolute links name (weight: pages with such a link), and, both
ways with weight ``FAMILY``, between a host and its parent domain, unless that is a public suffix, whose sites belong to
different owners. Trust is personalised PageRank from the trusted hosts along the edges, distrust the same from the
blocked hosts against them: whoever links to a distrusted host is distrusted. Scores are in units of a seed's own share,
so that thresholds mean the same however many seeds there are; what hosts without out-edges would pass on is lost, which
scales all scores of a propagation alike. Rounds go on until at most ``TOLERANCE`` of all score could still move. A host
is rejected if it is blocked itself, or if its distrust is at least ``LEAST`` and more than ``RATIO`` times its trust.
Both propagations run in one: each round is a join and a sum, and the edges keep their partitioning.

Defined cases: pages with a null or hostless url have a null host, no scores, and are rejected; null or empty html has
no links; links within a host don't count; very long html and urls are searched whole; repeated pages weigh as often as
they stand; a seed covers its subdomains and, if both lists cover a host, is blocked; a tie of distrust and trust passes;
without seeds all scores are 0 and all hosts pass; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read, sized

#: Seeds by default; a deployment passes its own lists, as tuples or as tables of one column.
TRUSTED = ("example.org",)
BLOCKED = ("example.net", "spam.example")
DAMPING, FAMILY = 0.85, 0.5
#: The share of the score that may still move when the rounds end.
TOLERANCE = 1e-3
LEAST, RATIO = 1e-3, 1.0
#: A host of more edges than this is hot; of many edges in all the bound rises, so that at most HOT_HOSTS are.
HOT_EDGES, HOT_HOSTS = 100_000, 100_000
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)"
LINK = r"(?:href|src|HREF|SRC)\s*=\s*[\"']?((?:[Hh][Tt][Tt][Pp][Ss]?:)?//[^\"'\s>]+)"
PARENT = r"^[^.]+\.([^.]+\..+)$"
#: Public suffixes of two labels or more, under which names belong to different owners (single labels always are).
SUFFIXES = tuple(
    f"{a}.{b}"
    for b, names in {
        "uk": "co org ac gov ltd plc me net nhs police sch", "au": "com net org edu gov id asn", "nz": "co net org ac govt geek school maori", "jp": "co or ne ac ad ed go gr lg", "kr": "co or ne re pe go ac hs ms es kg", "cn": "com net org edu gov ac", "tw": "com net org edu gov idv", "hk": "com net org edu gov idv",
        "in": "co net org firm gen ind ac edu gov res nic", "br": "com net org edu gov adv art blog eco eng ind inf jus med mil", "za": "co net org ac gov law web nom school", "mx": "com net org edu gob", "ar": "com net org edu gob gov int mil tur", "tr": "com net org edu gov bel pol gen web av dr k12", "il": "co org net ac gov muni k12", "sg": "com net org edu gov per",
        "my": "com net org edu gov mil name", "th": "co in or ac go net mi", "id": "co or net web sch ac go mil my desa biz", "ph": "com net org edu gov mil ngo i", "vn": "com net org edu gov info name pro health biz ac", "pl": "com net org edu gov info biz waw", "ua": "com net org edu gov in kiev kyiv lviv odessa", "ru": "com net org msk spb pp", "gr": "com net org edu gov", "pt": "com org edu gov", "es": "com nom org gob edu", "hu": "co org info", "ro": "com org info store firm", "at": "co or ac gv", "fr": "asso com gouv nom prd tm", "it": "gov edu", "ke": "co or ne go ac sc me mobi info", "ng": "com net org edu gov sch name mobi", "eg": "com net org edu gov sci eun", "pk": "com net org edu gov fam biz web", "bd": "com net org edu gov ac mil", "lk": "com net org edu gov ac sch ltd", "sa": "com net org edu gov med pub sch", "ae": "co net org ac gov mil sch", "pe": "com net org edu gob nom", "co": "com net org edu gov mil nom", "ve": "co com net org info web gob edu", "ec": "com net org edu gob gov fin med info", "uy": "com net org edu gub mil",
        "io": "github gitlab", "com": "blogspot wordpress appspot herokuapp weebly tumblr wixsite myshopify netlify azurewebsites cloudfunctions", "app": "netlify vercel web firebaseapp fly", "dev": "pages workers deno", "net": "azurewebsites cloudfront in-addr", "site": "business", "space": "hf", "eu": "eu", "org": "us",
    }.items()
    for a in names.split()
)


def rounds(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """After so many rounds at most tolerance of the score is still to move, on any graph."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping)))


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)


def edges(pages: DataFrame, family: float = FAMILY, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(src, dst, weight) between different hosts."""
    named = pages.select(host(F.col("url")).alias("src"), "html").where("src is not null")
    links = named.select("src", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), host))).alias("dst")).where("dst <> src")
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    own = named.select("src").distinct().select("src", F.regexp_extract("src", PARENT, 1).alias("dst")).where((F.col("dst") != "") & ~F.col("dst").isin(list(suffixes)))
    kin = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(family))
    return links.unionByName(kin).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def covered(hosts: DataFrame, seeds: tuple[str, ...] | DataFrame) -> DataFrame:
    """(host) of those that a seed covers: equal to it or below it. Each host's own name and all it lies below meet the
    list by a join, so the list may be of any length."""
    if not isinstance(seeds, DataFrame):
        seeds = hosts.sparkSession.createDataFrame([(s,) for s in seeds], "seed string")
    listed = seeds.select(F.lower(F.col(seeds.columns[0])).alias("seed")).distinct()
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return hosts.select("host", F.explode(names).alias("seed")).join(sized(listed, 64), "seed", "left_semi").select("host").distinct()


def propagate(hosts: DataFrame, graph: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score): personalised PageRank over graph (kind, src, dst, weight) from the seeds hosts (kind, host), for
    each kind by itself; a seed sends out 1 - damping of 1, and a score is in units of that. The edges of a host that has
    very many lie in all partitions, and its score is sent to them."""
    out = materialise(graph.groupBy("kind", "src").agg(F.sum("weight").alias("total"), F.count("*").alias("edges")), "out-edges")
    most = max(HOT_EDGES, (out.agg(F.sum("edges")).first()[0] or 0) // HOT_HOSTS)
    hot = out.where(F.col("edges") > most).select(F.col("kind").alias("hot_kind"), F.col("src").alias("hot_src"))
    any_hot = not hot.isEmpty()
    steps = graph.join(out, ["kind", "src"]).select(F.col("kind").alias("of"), "src", "dst", (F.col("weight") / F.col("total")).alias("p"), (F.col("edges") > most).alias("hot"))
    kept = [steps.where("not hot").repartition("of", "src").persist(StorageLevel.MEMORY_AND_DISK)]
    if any_hot:
        kept.append(steps.where("hot").repartition("of", "dst").persist(StorageLevel.MEMORY_AND_DISK))
    start = materialise(hosts.select("kind", "host", F.lit(1.0).alias("score")), "seeds")
    now = start
    n = rounds(damping, tolerance)
    moved = ["kind", F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score")]
    for i in range(1, n + 1):
        flow = now.join(kept[0], (F.col("kind") == F.col("of")) & (F.col("host") == F.col("src"))).select(*moved)
        if any_hot:
            # at most HOT_HOSTS rows
            few = now.join(F.broadcast(hot), (F.col("kind") == F.col("hot_kind")) & (F.col("host") == F.col("hot_src"))).select("kind", "host", "score")
            flow = flow.unionByName(kept[1].join(F.broadcast(few), (F.col("kind") == F.col("of")) & (F.col("host") == F.col("src"))).select(*moved))
        now = flow.unionByName(start.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % 8 == 0 or i == n:
            now = materialise(now, "rank")
    for x in kept:
        x.unpersist()
    return now.withColumn("score", F.col("score") / (1 - damping))


def host_scores(pages: DataFrame, trusted: tuple[str, ...] | DataFrame = TRUSTED, blocked: tuple[str, ...] | DataFrame = BLOCKED, damping: float = DAMPING, tolerance: float = TOLERANCE, family: float = FAMILY, least: float = LEAST, ratio: float = RATIO, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, trust, distrust, rejected) of every host of a page or an edge."""
    graph = materialise(edges(pages, family, suffixes), "host-edges")
    names = materialise(pages.select(host(F.col("url")).alias("host")).where("host is not null").unionByName(graph.select(F.col("dst").alias("host"))).distinct(), "hosts")
    bad = materialise(covered(names, blocked), "blocked")
    good = covered(names, trusted).join(bad, "host", "left_anti")
    seeds = good.withColumn("kind", F.lit(0)).unionByName(bad.withColumn("kind", F.lit(1)))
    both = graph.withColumn("kind", F.lit(0)).unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit(1).alias("kind")))
    scores = propagate(seeds, both, damping, tolerance)
    of = lambda kind, name: scores.where(F.col("kind") == kind).select("host", F.round("score", 6).alias(name))
    out = names.join(of(0, "trust"), "host", "left").join(of(1, "distrust"), "host", "left").join(bad.withColumn("bad", F.lit(True)), "host", "left").na.fill({"trust": 0.0, "distrust": 0.0, "bad": False})
    return out.select("host", "trust", "distrust", (F.col("bad") | ((F.col("distrust") >= least) & (F.col("distrust") > ratio * F.col("trust")))).alias("rejected"))


def filter_urls(pages: DataFrame, **options) -> DataFrame:
    """(page_id, host, trust, distrust, rejected) of every page."""
    scores = sized(materialise(host_scores(pages, **options), "host-scores"), 96).withColumnRenamed("host", "of")
    own = pages.select("page_id", host(F.col("url")).alias("host"))
    return own.join(scores, own["host"] == scores["of"], "left").select("page_id", "host", "trust", "distrust", F.coalesce("rejected", F.lit(True)).alias("rejected"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def oracle() -> str:
    """The same in SQL, the rounds written out."""
    quoted = [s.replace("'", "''") for s in (HOST, LINK, PARENT)]
    suffixes = ", ".join(f"'{s}'" for s in SUFFIXES)

    def host_of(x: str) -> str:
        return f"nullif(lower(regexp_extract({x}, '{quoted[0]}', 1)), '')"

    def any_of(seeds: tuple[str, ...]) -> str:
        return "(" + " OR ".join(f"host = '{s}' OR host LIKE '%.{s}'" for s in seeds) + ")"

    parts = [
        f"named AS MATERIALIZED (SELECT page_id, {host_of('url')} AS src, html FROM pages)",
        f"links AS (SELECT src, {host_of('u')} AS dst, page_id FROM (SELECT page_id, src, unnest(regexp_extract_all(html, '{quoted[1]}', 1)) AS u FROM named WHERE src IS NOT NULL))",
        f"own AS (SELECT DISTINCT src, regexp_extract(src, '{quoted[2]}', 1) AS dst FROM named WHERE regexp_extract(src, '{quoted[2]}', 1) NOT IN ('', {suffixes}))",
        f"edges AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, count(DISTINCT page_id)::DOUBLE AS w FROM links WHERE dst <> src GROUP BY ALL UNION ALL SELECT src, dst, {FAMILY}::DOUBLE FROM own UNION ALL SELECT dst, src, {FAMILY}::DOUBLE FROM own) GROUP BY ALL)",
        f"hosts AS MATERIALIZED (SELECT host, {any_of(TRUSTED)} AND NOT {any_of(BLOCKED)} AS good, {any_of(BLOCKED)} AS bad FROM (SELECT src AS host FROM named WHERE src IS NOT NULL UNION SELECT dst FROM edges))",
        "p AS MATERIALIZED (SELECT 0 AS kind, src AS a, dst AS b, w / sum(w) OVER (PARTITION BY src) AS p FROM edges UNION ALL SELECT 1, dst, src, w / sum(w) OVER (PARTITION BY dst) FROM edges)",
        "r0 AS MATERIALIZED (SELECT 0 AS kind, host, 1e0 AS s FROM hosts WHERE good UNION ALL SELECT 1, host, 1e0 FROM hosts WHERE bad)",
    ]
    n = rounds()
    for i in range(1, n + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT kind, host, sum(s) AS s FROM (SELECT p.kind, b AS host, s * p * {DAMPING}::DOUBLE AS s FROM r{i - 1} r JOIN p ON a = host AND p.kind = r.kind UNION ALL SELECT kind, host, s * (1 - {DAMPING}::DOUBLE) FROM r0) GROUP BY ALL)")
    parts.append(f"f AS MATERIALIZED (SELECT kind, host, round(s / (1 - {DAMPING}::DOUBLE), 6) AS s FROM r{n})")
    parts.append("scores AS (SELECT h.host, bad, coalesce(t.s, 0e0) AS trust, coalesce(d.s, 0e0) AS distrust FROM hosts h LEFT JOIN f t ON t.host = h.host AND t.kind = 0 LEFT JOIN f d ON d.host = h.host AND d.kind = 1)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT page_id, src AS host, trust, distrust, coalesce(bad OR (distrust >= {LEAST}::DOUBLE AND distrust > {RATIO}::DOUBLE * trust), true) AS rejected FROM named LEFT JOIN scores ON scores.host = named.src"
