"""URL filter: host and path rules first, gradient-boosted trees for the rest.

The trees see lexical features only: lengths, depth, digit ratio, entropy,
parameter counts, and how often other hosts of the same suffix are unwanted among
the labelled URLs: what is counted of a suffix never includes the host's own
labels, so the trees cannot read a label off it.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table_join

#: (host, path, verdict); a rule is written host + path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Most labelled URLs that the trees are fitted on: the first by a hash.
TRAINING_ROWS = 20_000
#: Words of a host name that label a URL as unwanted, where no labels are given.
UNWANTED = ("ads", "bet", "bets", "casino", "loans", "pills", "porn", "spam", "track", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict): the longest that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    text = F.coalesce(url, F.lit(""))
    size = F.length(text).cast("double")
    chars = F.split(text, "")
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    # Sums in sorted order, so that equal URLs give equal numbers.
    entropy = F.aggregate(F.array_sort(F.array_distinct(F.filter(chars, lambda c: c != ""))), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    some = F.greatest(size, F.lit(1.0))
    count = lambda col, pattern: F.regexp_count(col, F.lit(pattern)).cast("double")
    return [
        size,
        F.length(host).cast("double"),
        F.length(path).cast("double"),
        count(host, r"\."),
        count(path, "/[^/]"),
        count(text, "[0-9]") / some,
        count(host, "[0-9]"),
        count(host, "-"),
        entropy,
        count(text, "[?&][^=&#]+="),
        count(text, "%[0-9A-Fa-f]{2}"),
        text.contains("#").cast("double"),
        text.startswith("https://").cast("double"),
    ]


def suffix_of(host: Column, labels: int) -> Column:
    """The last ``labels`` labels of a host."""
    return F.substring_index(host, ".", -labels)


#: Suffixes by their number of labels.
SUFFIXES = (1, 2, 3)
#: Labels that the overall rate stands for when a suffix's rate is smoothed.
STRENGTH = 5.0


def known_urls(labelled: DataFrame) -> DataFrame:
    """Distinct labelled URLs: ``url, label, host, path``; of labels that disagree the 1 counts."""
    url = F.col("url")
    known = labelled.where("url IS NOT NULL AND label IN (0, 1)").groupBy("url").agg(F.max("label").cast("double").alias("label"))
    return materialize(known.withColumn("host", host_of(url)).withColumn("path", path_of(url)), "labelled")


def host_rates(known: DataFrame, urls: DataFrame, rate: float) -> DataFrame:
    """Of every host among ``known`` and ``urls``: the rate of unwanted URLs of its suffixes, without the host's own labels, smoothed to the overall rate."""
    counted = known.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
    hosts = counted.unionByName(urls.select("host").distinct().withColumns({"n": F.lit(0).cast("long"), "bad": F.lit(0.0)})).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    for k in SUFFIXES:
        hosts = hosts.withColumn(f"suffix{k}", suffix_of(F.col("host"), k))
    rates = hosts
    for k in SUFFIXES:
        of = hosts.groupBy(f"suffix{k}").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
        others = (F.col("all_bad") - F.col("bad") + STRENGTH * rate) / (F.col("all_n") - F.col("n") + STRENGTH)
        rates = rates.join(of, f"suffix{k}").withColumn(f"rate{k}", others).drop("all_n", "all_bad")
    return materialize(rates.select("host", *[f"rate{k}" for k in SUFFIXES]), "rates")


def with_features(urls: DataFrame, rates: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, ...) with their ``features``."""
    names = [f"rate{k}" for k in SUFFIXES]
    joined = table_join(urls, rates, "host", "url")
    return joined.withColumn("features", array_to_vector(F.array(*lexical(F.col("url"), F.col("host"), F.col("path")), *names))).drop(*names)


def fit_trees(known: DataFrame, rates: DataFrame, training_rows: int):
    sample = with_features(known.orderBy(F.xxhash64("url")).limit(training_rows), rates).select("features", "label")
    return GBTClassifier(maxIter=10, maxDepth=3, seed=11, featuresCol="features", labelCol="label").fit(materialize(sample, "training"))


def base_rate(known: DataFrame) -> float:
    """Share of unwanted URLs among the labelled; 0 without any."""
    return known.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]


def own_labels(pages: DataFrame) -> DataFrame:
    """``url, label`` of the pages' own URLs, by words of their host names."""
    words = F.split(host_of(F.col("url")), r"[^a-z]+")
    return pages.select("url", F.arrays_overlap(words, F.array(*map(F.lit, UNWANTED))).cast("int").alias("label"))


def held_out_quality(labelled: DataFrame, fold: int = 0, folds: int = 5, training_rows: int = TRAINING_ROWS) -> dict[str, float]:
    """Precision and recall on the hosts of one fold, of which neither trees nor suffix rates have seen any label."""
    known = known_urls(labelled)
    held = F.pmod(F.xxhash64("host"), F.lit(folds)) == fold
    taught = known.where(~held)
    rates = host_rates(taught, known, base_rate(taught))
    judged = fit_trees(taught, rates, training_rows).transform(with_features(known.where(held), rates))
    hit = judged.agg(
        F.count_if((F.col("prediction") == 1) & (F.col("label") == 1)).alias("both"), F.count_if(F.col("prediction") == 1).alias("found"), F.count_if(F.col("label") == 1).alias("there"), F.count(F.lit(1)).alias("all")
    ).first()
    return {"precision": hit["both"] / max(hit["found"], 1), "recall": hit["both"] / max(hit["there"], 1), "unwanted": hit["there"], "urls": hit["all"]}


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row.

    ``labelled`` has ``url`` and ``label`` (1: unwanted). Without it the pages' own
    URLs are labelled by words of their host names. The trees are fitted on at
    most ``training_rows`` distinct labelled URLs; suffix statistics are counted
    over all of them.

    A null url, or one without ``://``, has an empty host and path: no rule fits
    and the trees judge it like any other. Urls may be of any length. Repeated
    rows get equal verdicts. With labels of one class only, the verdict is that
    class. An empty table gives an empty result. Extra columns are ignored.
    """
    url = F.col("url")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    known = known_urls(own_labels(plain) if labelled is None else labelled)
    rate = base_rate(known)
    judged = plain.withColumns({"host": host_of(url), "path": path_of(url)})
    if 0 < rate < 1:
        rates = host_rates(known, judged, rate)
        judged = fit_trees(known, rates, training_rows).transform(with_features(judged, rates)).withColumn("unwanted", F.col("prediction") == 1)
    else:
        judged = judged.withColumn("unwanted", F.lit(rate >= 0.5))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("unwanted"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
