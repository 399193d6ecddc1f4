"""URL filter: rules, and a character language-model ratio for the rest, in DataFrame expressions only.

URLs that a rule decides are the training text of two models of characters, one of
accepted and one of rejected URLs. Each is a variable-order Markov model: the longest
context up to four characters that the model has seen, smoothed with the shorter ones
by Witten-Bell's weights. What the rest are judged by is the difference of their log
likelihoods per character, against a threshold calibrated on labelled URLs that the
models have not seen.

All counts cover all URLs. A gram (a character after its context) is counted once for
all URLs that have it; only distinct grams meet the models, and the URLs then meet the
grams by an equality join that Spark may split where a gram is in every URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.llm.common import shuffled, written

#: (verdict, host suffix and path prefix)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 4
#: One labelled URL in so many calibrates the threshold.
HELD_OUT = 5
#: Characters a model tells apart besides those it has seen: the uniform base of the smoothing.
ALPHABET = 256
_PAD = "\x02"


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path; both empty for a null url or one without ``://``."""
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    return (pages.withColumn("rest", F.coalesce(rest, F.lit("")))
            .withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path}).drop("rest"))


def _fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    own = (F.col("host") == host) | F.col("host").endswith("." + host)
    return own & F.col("path").startswith("/" + path)


def with_rule(parts: DataFrame, rules=RULES) -> DataFrame:
    """``parts`` with rule (the longest that fits, or null) and ruled (its verdict)."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule, ruled = F.when(_fits(text), text).otherwise(rule), F.when(_fits(text), verdict).otherwise(ruled)
    return parts.withColumns({"rule": rule, "ruled": ruled})


def _characters(text: str) -> Column:
    """One gram for each character and the end: ORDER characters of context, then itself."""
    padded = F.concat(F.lit(_PAD * ORDER), F.col(text), F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def _models(training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of grams of each order, and of contexts (occurrences and distinct followers), by class.

    ``training``: gram (of full length), a and b (its occurrences in either class).
    """
    each = training.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda k: F.substring("gram", -k, k))).alias("g"), "a", "b")
    grams = each.groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    contexts = grams.groupBy(F.substring("g", F.lit(1), F.length("g") - 1).alias("c"), F.length("g").alias("k")).agg(
        F.sum("a").alias("n_a"), F.count_if(F.col("a") > 0).alias("t_a"), F.sum("b").alias("n_b"), F.count_if(F.col("b") > 0).alias("t_b"))
    return grams, contexts


def _ratios(needed: DataFrame, training: DataFrame) -> DataFrame:
    """gram, ratio: log P(character | context) of class a less that of class b, for each gram of ``needed``."""
    grams, contexts = _models(training)
    parts = needed.select("gram", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("k")).withColumn("g", F.substring("gram", -F.col("k"), F.col("k")))
    # Each ending meets the models once: those of one character would otherwise all meet at the empty context.
    endings = (parts.select("g", "k").distinct().join(shuffled(grams), "g", "left").withColumn("c", F.substring("g", F.lit(1), F.length("g") - 1))
               .join(shuffled(contexts), ["c", "k"], "left").drop("c", "k"))
    levels = parts.join(shuffled(endings), "g").groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(
        "k", *[F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in ("a", "n_a", "t_a", "b", "n_b", "t_b")]))).alias("levels"))

    def probability(x: str) -> Column:
        def smoothed(p: Column, s: Column) -> Column:
            weight = s[f"n_{x}"] + s[f"t_{x}"]
            return F.when(weight > 0, (s[x] + s[f"t_{x}"] * p) / weight).otherwise(p)
        return F.aggregate("levels", F.lit(1.0 / ALPHABET), smoothed)

    return levels.select("gram", (F.log(probability("a")) - F.log(probability("b"))).alias("ratio"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score.

    A page without host (null url, or none) has score 0 and is allowed, as nothing speaks against
    it. So are all undecided pages if either class has no labelled page to learn or to calibrate
    from. Repeated pages are judged, and counted, each for itself.
    """
    plain = with_rule(with_parts(pages.select("page_id", "url")), rules).withColumn("text", F.concat("host", "path"))
    pages_ = written(plain.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "part", F.when(F.col("ruled").isNull(), "judge").when(F.pmod(F.xxhash64("text", "page_id"), F.lit(HELD_OUT)) == 0, "calibrate").otherwise("train")), "pages")
    occurrences = pages_.filter("text <> ''").select("row", "part", "ruled", F.explode(_characters("text")).alias("gram"))
    counted = written(occurrences.groupBy("gram").agg(
        F.count_if((F.col("part") == "train") & (F.col("ruled") == "allow")).alias("a"),
        F.count_if((F.col("part") == "train") & (F.col("ruled") == "block")).alias("b"),
        F.count_if(F.col("part") != "train").alias("needed")), "grams")
    # Written: what is grouped by gram would be joined as it lies, and Spark could not split a gram of every URL.
    ratios = written(_ratios(counted.filter("needed > 0").select("gram"), counted.filter("a + b > 0")), "ratios")
    score = (occurrences.filter("part <> 'train'").select("row", "gram").join(shuffled(ratios), "gram")
             .groupBy("row").agg(F.avg("ratio").alias("score")))
    scored = written(pages_.join(score, "row", "left"), "scores")
    limit = threshold(scored.filter("part = 'calibrate'"), pages_)
    verdict = F.coalesce("ruled", F.when(F.lit(limit is not None) & (F.col("score") < F.lit(limit or 0.0)), "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"))


def threshold(held: DataFrame, pages: DataFrame) -> float | None:
    """The score at which a held-out accepted and a rejected URL are equally far off, in deviations of their class."""
    trained = {r.ruled for r in pages.filter("part = 'train'").select("ruled").distinct().collect()}
    stats = {r.ruled: r for r in held.groupBy("ruled").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev("score"), F.lit(0.0)).alias("sd")).collect()
             if r.mean is not None}
    if not {"allow", "block"} <= stats.keys() or not {"allow", "block"} <= trained:
        return None
    good, bad = stats["allow"], stats["block"]
    spread = good.sd + bad.sd
    return (good.mean * bad.sd + bad.mean * good.sd) / spread if spread else (good.mean + bad.mean) / 2
