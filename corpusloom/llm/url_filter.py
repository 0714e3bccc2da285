"""URL filter: host rules, and a character language-model ratio for all other URLs.

Smoothed Markov models of variable order (Witten-Bell, contexts of 3 characters down
to none) are counted from the URLs that the rules accept and reject. Characters are
folded to an alphabet of 41, so that there are at most 41 ** 4 (2.9 million) strings of
four: the tables of counts and scores, and what is broadcast, have that bound at any
size of input. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: rule -> verdict; a rule is a host and the start of a path
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
MICRO = 1_000_000
CALIBRATION_FOLDS = 4


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits a host and a path, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        rule_host, slash, rest = rule.partition("/")
        fits = (host == rule_host) | host.endswith("." + rule_host)
        found = F.when(fits & path.startswith(slash + rest), F.lit(rule)).otherwise(found)
    return found


def folded(url: Column) -> Column:
    """Lower case; digits are one character, what is neither letter, digit nor usual mark another."""
    s = F.translate(F.coalesce(url, F.lit("")), UPPER + "123456789", LOWER + "000000000")
    return F.regexp_replace(s, r"[^a-z0/.\-_?=&#:%+]", "~")


def grams(url: Column) -> Column:
    """The strings of four that end at each character, ^ standing before the first; none of an empty URL."""
    # a look-ahead finds overlapping strings in one pass, however long the URL is
    return F.regexp_extract_all(F.concat(F.lit("^^^"), folded(url)), F.lit("(?=(.{4}))"), F.lit(1))


def gram_scores(counts: DataFrame) -> DataFrame:
    """gram, score: log-likelihood difference (accepted less rejected) in millionths.

    ``counts`` has gram, accept and reject. A character's probability after a context
    is (n + t * p) / (N + t): n its count there, N all, t the distinct characters,
    p its probability after the context shortened by one, at last 1 / 42.
    """
    sides = ("accept", "reject")
    shorter = None
    for order in range(4):
        level = counts.groupBy(F.substring("gram", 4 - order, order + 1).alias("tail")).agg(*[F.sum(x).alias(x) for x in sides])
        contexts = level.groupBy(F.substring("tail", 1, order).alias("context")).agg(
            *[F.sum(x).alias(f"all_{x}") for x in sides], *[F.count_if(F.col(x) > 0).alias(f"kinds_{x}") for x in sides]
        )
        level = level.withColumn("context", F.substring("tail", 1, order)).join(contexts, "context")
        if shorter is None:
            level = level.withColumns({f"less_{x}": F.lit(1.0 / 42) for x in sides})
        else:
            level = level.withColumn("rest", F.substring("tail", 2, order)).join(shorter, "rest")
        p = {x: F.when(F.col(f"all_{x}") > 0, (F.col(x) + F.col(f"kinds_{x}") * F.col(f"less_{x}")) / (F.col(f"all_{x}") + F.col(f"kinds_{x}"))).otherwise(F.col(f"less_{x}")) for x in sides}
        level = level.select("tail", *[p[x].alias(x) for x in sides])
        shorter = level.select(F.col("tail").alias("rest"), *[F.col(x).alias(f"less_{x}") for x in sides])
    return level.select(F.col("tail").alias("gram"), F.round((F.log("accept") - F.log("reject")) * MICRO).cast("long").alias("score"))


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every URL.

    The models are learnt from 4 of 5 of the URLs that a rule decides (dealt by the
    URL's hash); the rest of those set the threshold: the score, in hundredths, at which most
    of them by class are told apart, the lowest of equals. The score is the mean
    difference by character, in millionths. A null or empty URL, or one without
    "://", has an empty host and path; an empty one has no score and is allowed.
    Without URLs of both kinds all scores are 0 or so and the rest is allowed at the
    threshold 0. Repeated rows give repeated results.
    """
    url = F.col("url")
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    judged = pages.select("id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    label = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("rule")]
    judged = judged.withColumn("label", label)
    train = F.pmod(F.crc32(F.coalesce(url, F.lit("")).cast("binary")), F.lit(CALIBRATION_FOLDS + 1)) > 0
    counts = (
        judged.select("label", train.alias("train"), F.explode(grams(url)).alias("gram"))
        .groupBy("gram")
        .agg(*[F.sum(F.when((F.col("label") == x) & F.col("train"), 1).otherwise(0)).alias(y) for x, y in (("allow", "accept"), ("block", "reject"))])
    )
    scores = F.broadcast(gram_scores(counts))
    # a URL with very many copies is scored once; URLs are small and their strings many, so
    # they are dealt again to as many tasks as there are partitions
    distinct = judged.select("url", "label", train.alias("train")).groupBy("url", "label", "train").agg(F.count("*").alias("copies"))
    distinct = distinct.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url")
    scored = (
        distinct.select("url", "label", "train", "copies", F.explode(grams(url)).alias("gram"))
        .join(scores, "gram")
        .groupBy("url", "label", "train", "copies")
        .agg(F.floor(F.sum("score") / F.count("*")).alias("score"))
    )
    bins = (
        scored.filter(~F.col("train") & F.col("label").isNotNull())
        .groupBy(F.floor(F.col("score") / (MICRO // 100)).alias("bin"))
        .agg(*[F.sum(F.when(F.col("label") == x, F.col("copies")).otherwise(0)).alias(x) for x in ("allow", "block")])
    )
    # at most some thousand bins, as scores by character lie between the logs of probabilities
    everything = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    total = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    split = bins.select(
        "bin",
        (
            F.coalesce(F.sum("block").over(everything), F.lit(0)) / F.greatest(F.sum("block").over(total), F.lit(1))
            - F.coalesce(F.sum("allow").over(everything), F.lit(0)) / F.greatest(F.sum("allow").over(total), F.lit(1))
        ).alias("gain"),
    )
    threshold = split.agg(F.coalesce(F.min_by("bin", F.struct(-F.round("gain", 9), "bin")), F.lit(0)).alias("threshold"))
    by_url = scored.groupBy("url").agg(F.first("score").alias("score"))
    return (
        judged.join(by_url, "url", "left")
        .crossJoin(F.broadcast(threshold))
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            "rule",
            F.coalesce("label", F.when(F.col("score") < F.col("threshold") * (MICRO // 100), "block").otherwise("allow")).alias("verdict"),
            "score",
        )
    )
