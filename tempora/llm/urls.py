"""URL verdicts: host and path rules, else a character language-model ratio.

Two smoothed variable-order Markov models over characters, one of accepted and
one of rejected URLs, score every URL by the difference of its log-likelihoods
divided by its length.  Accepted are the URLs that an allow rule decides;
rejected those that a block rule decides, and those whose host has a word that
the caller rejects.  A fifth of both is kept out of the counts and sets the cut:
the score with the largest difference of the two shares above it, in the middle
of the gap to the next lower one.

Probabilities interpolate orders 0 to ``ORDER`` after Witten and Bell; a
context is used only where it was seen ``MIN_SEEN`` times.  Log ratios are whole
billionths, so sums do not depend on the order of rows.

Nulls: a null URL is empty.  Equal URLs get equal verdicts; repeated rows stay.
An empty table gives no rows; with no accepted or no rejected URLs to learn
from, whatever no rule decides is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.bind import let
from tempora.sources.tables import replace_table, scratch_dir

ORDER = 3
MIN_SEEN = 2
# Of a uniform base distribution, as URLs are mostly ASCII.
ALPHABET = 128
BILLION = 1_000_000_000
# Scores are calibrated in steps of a hundredth, cut at +-10: at most 2,001 rows reach the driver.
STEPS, EDGE = 100, 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rules = tuple[tuple[str, str], ...]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    own = (F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))
    return own & F.startswith(F.col("path"), F.lit(slash + path))


def _longest(rules: Rules, value: int) -> Column:
    """Rule text (value 1) or action (0) of the longest rule that fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    return F.coalesce(*[F.when(_fits(r[1]), F.lit(r[value])) for r in ordered], F.lit(None).cast("string"))


def split_and_rule(pages: DataFrame, rules: Rules, id_col: str = "page_id") -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    return parts.withColumn("rule", _longest(rules, 1)).withColumn("action", _longest(rules, 0))


# A URL stands in the tables by 128 bits of hashes.
URL = ["h1", "h2"]


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character: it and the ``ORDER`` characters before it; no URL with it."""
    text = F.concat(F.lit("^" * ORDER), F.translate(_rest(F.col("url")), UPPER + "123456789", LOWER + "0" * 9), F.lit("$"))
    grams = let(text, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - ORDER), lambda i: F.substring(t, i, F.lit(ORDER + 1))))
    return urls.select(*[c for c in urls.columns if c != "url"], F.explode(grams).alias("gram"))


def _log_ratio(counts: DataFrame) -> DataFrame:
    """``gram, ratio`` out of each gram's counts among accepted and rejected URLs."""
    out = counts.select("gram", "good", "bad", F.expr("right(gram, 1)").alias("next"))
    for side in ("good", "bad"):
        out = out.withColumn(f"p_{side}", F.lit(1.0 / ALPHABET))
    for order in range(ORDER + 1):
        key = F.expr(f"right(gram, {order + 1})")
        seen = counts.groupBy(key.alias("key")).agg(F.sum("good").alias("k_good"), F.sum("bad").alias("k_bad"))
        context = F.expr(f"left(key, {order})").alias("context")
        kinds = [F.count(F.when(F.col(f"k_{s}") > 0, 1)).alias(f"t_{s}") for s in ("good", "bad")]
        totals = [F.sum(f"k_{s}").alias(f"n_{s}") for s in ("good", "bad")]
        contexts = seen.groupBy(context).agg(*kinds, *totals)
        out = out.withColumn("key", key).join(seen, "key")
        out = out.withColumn("context", F.expr(f"left(key, {order})")).join(contexts, "context")
        for s in ("good", "bad"):
            k, t, n, p = (F.col(f"{c}_{s}") for c in "ktnp")
            out = out.withColumn(f"p_{s}", F.when(n >= MIN_SEEN, (k + t * p) / (n + t)).otherwise(p))
        out = out.drop("key", "context", *[f"{c}_{s}" for c in "ktn" for s in ("good", "bad")])
    ratio = F.round((F.log("p_good") - F.log("p_bad")) * BILLION).cast("long")
    return out.select("gram", ratio.alias("ratio"))


def _cut(scored: DataFrame) -> int:
    """Lowest step, in hundredths, that is allowed."""
    step = F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.floor(F.col("score") * STEPS))).cast("int")
    bins = scored.groupBy(step.alias("step")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("step").collect()
    good, bad = sum(b["good"] for b in bins), sum(b["bad"] for b in bins)
    if not good or not bad:
        return -EDGE - 1
    best, cut, kept_good, kept_bad, before = -1.0, 0, good, bad, None
    for b in bins:
        if kept_good / good - kept_bad / bad > best:
            best = kept_good / good - kept_bad / bad
            # In the middle of the gap below.
            cut = b["step"] if before is None else (b["step"] + before + 1) // 2
        kept_good, kept_bad, before = kept_good - b["good"], kept_bad - b["bad"], b["step"]
    return cut


def judge(pages: DataFrame, rules: Rules, id_col: str = "page_id", reject_words: tuple[str, ...] = ()) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, score`` of every page.

    ``reject_words`` are parts of a host, between dots and hyphens: a URL with
    one is a rejected example, whatever rule decides it.
    """
    scratch = scratch_dir(pages.sparkSession)
    ruled = split_and_rule(pages, rules, id_col).withColumns({"h1": F.xxhash64("url"), "h2": F.xxhash64(F.lit(1), "url")})
    listed = F.exists(F.split("host", "[.-]"), lambda x: x.isin(*reject_words)) if reject_words else F.lit(False)
    good, bad = (F.coalesce(F.col("action") == action, F.lit(False)) for action in ("allow", "block"))
    good, bad = (good & ~listed).cast("int"), (bad | listed).cast("int")
    kept_out = F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("int") % 5 == 0
    # Verdicts depend on the URL alone: score each distinct one.
    urls = ruled.select(*URL, "url", good.alias("good"), bad.alias("bad"), kept_out.alias("kept_out")).dropDuplicates(URL)
    urls = replace_table(urls, f"{scratch}/urls")
    counted = [F.sum(F.when(~F.col("kept_out"), F.col(c)).otherwise(0)).alias(c) for c in ("good", "bad")]
    counts = replace_table(_grams(urls).groupBy("gram").agg(*counted), f"{scratch}/grams")
    model = replace_table(_log_ratio(counts), f"{scratch}/model")
    scores = _grams(urls).join(model, "gram").groupBy(*URL, "good", "bad", "kept_out").agg(F.sum("ratio").alias("total"), F.count("*").alias("n"))
    scores = scores.withColumn("score", F.col("total") / F.col("n") / BILLION)
    scores = replace_table(scores, f"{scratch}/scores")
    cut = _cut(scores.where("kept_out"))
    allowed = F.when(F.floor(F.col("score") * STEPS) >= cut, "allow").otherwise("block")
    verdict = F.coalesce(F.col("action"), allowed).alias("verdict")
    return ruled.join(scores.select(*URL, "score"), URL).select("page_id", "url", "host", "path", "rule", verdict, "score")
