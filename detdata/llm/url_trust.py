"""URL verdicts by host and path rules, and by link-graph propagation where no rule fits.

Built-in functions only. Links between hosts form a weighted edge table, one row per pair of hosts. Trust is a
personalised PageRank that starts at the hosts whose pages an allow rule covers for the most part and follows
links; distrust starts at the hosts whose pages a block rule covers for the most part and follows links
backwards, from what is linked to who links. Both run together as rows of one table, a partial aggregation and
an equi-join on the host per step, until what further steps could still add to all hosts together is below a
thousandth of the verdict's threshold. What a host starts with does not judge itself, only what reaches it over
links does: it is blocked if the distrust that reaches it is above a threshold and above the trust.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, scratch, written

#: (rule, verdict), host and path in one; a rule fits its host and all subdomains.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.85
#: Steps between two written tables of ranks.
EVERY = 4
#: Distrust that blocks a host, as a share of all distrust.
THRESHOLD = 1e-6
#: The walk ends when what is left is below this share of the threshold; sums of doubles tell no less than FINEST.
LEFT_SHARE, FINEST = 1e-3, 1e-12
HREF = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or no "://"."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): links from one host's pages to another host."""
    links = pages.select(F.col(host).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(HREF), F.lit(1)))).alias("dst"))
    links = links.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src != '' and src != dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = THRESHOLD * LEFT_SHARE) -> DataFrame:
    """seeds(kind, host, mass) over edges(src, dst, n) → (kind, host, score): what reaches each host over links.
    Trust follows the links, distrust goes against them.

    Scores only grow with the steps, and each step adds at most damping times what the last one added. So if m
    steps added x to all scores of a kind, all further steps add at most x * damping^m / (1 - damping^m); the walk
    ends when that is at most `tolerance` for both kinds. No score lacks more than this.
    """
    with scratch(edges.sparkSession):
        return written(_walk(edges, seeds, damping, tolerance), "host_scores", up=1)


def _walk(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    out = edges.groupBy("src").agg(F.sum("n").alias("t"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("t"))
    ahead = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("t")).alias("w"))
    back = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("t")).alias("w"))
    steps_table = written(ahead.unionByName(back), "host_steps")
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("all"))
    start = written(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("mass") / F.col("all") * (1 - damping)).alias("score")), "seeds")  # two rows at most
    if steps_table.isEmpty() or start.isEmpty():
        return start.select("kind", "host", F.lit(0.0).alias("score")).limit(0)
    moved = lambda rank: rank.join(steps_table, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("w") * damping).alias("score"))
    summed = lambda rows: rows.groupBy("kind", "host").agg(F.sum("score").alias("score"))
    sums = lambda rank: rank.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)) for k in ("trust", "distrust")]).first()
    rank, before = start, sums(start)
    rest = damping**EVERY / (1 - damping**EVERY)
    while True:
        for _ in range(EVERY):
            rank = summed(moved(rank).unionByName(start))
        rank = written(rank, "host_rank")
        now = sums(rank)
        if max(n - b for n, b in zip(now, before, strict=True)) * rest <= tolerance:
            return summed(moved(rank))
        before = now


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of pages: page_id, host, path, rule, verdict (allow or block), trust, distrust.

    A page that a rule fits has the rule's verdict, others their host's. A null url, or one without "://", has
    empty host and path, no rule and the verdict allow; null html has no links; repeated rows are judged alike
    and count as pages of their host; other columns are ignored; an empty table gives an empty one.
    """
    h, p = host_path(F.col(url))
    d = pages.select(F.col(page_id).alias("_id"), h.alias("host"), p.alias("path"), F.col(html).alias("_html"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    d = d.withColumn("rule", rule).withColumn("_says", says)
    edges = written(host_edges(d, "host", "_html"), "host_edges")
    of = d.where("host != ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("_says") == "allow").alias("a"), F.count_if(F.col("_says") == "block").alias("b"))
    seeds = of.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.when(F.col("a") * 2 > F.col("n"), F.col("a")).alias("m")), F.struct(F.lit("distrust").alias("kind"), F.when(F.col("b") * 2 > F.col("n"), F.col("b")).alias("m")))).alias("s")).where("s.m is not null")
    scores = propagate(edges, written(seeds.select("s.kind", "host", F.col("s.m").cast("double").alias("mass")), "seeds"), tolerance=max(threshold * LEFT_SHARE, FINEST))
    per = scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"))
    out = d.drop("_html").join(per, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    method = F.when((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.select(F.col("_id").alias(page_id), "host", "path", "rule", F.coalesce("_says", method).alias("verdict"), "trust", "distrust")
