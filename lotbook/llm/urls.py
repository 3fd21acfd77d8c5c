"""URL filter: rules first, then the likelihood ratio of two character models, in SQL functions only.

A rule is a host and a path, ``host/path...``; it fits its host and all subdomains if the path of the url starts with
its own, and the longest rule that fits decides. Urls without a rule are judged by two character models
of variable order, one of accepted and one of rejected urls, here those that the rules decide. Host and path are
written in an alphabet of at most ``len(SYMBOLS)`` signs. A model gives each sign a probability after up to
``ORDER`` signs before it; contexts are interpolated after Witten and Bell, down to single signs with one added to
each count. The score is the difference of the log-likelihoods by sign. It is calibrated on a part of the labelled
urls that the models have not seen: the threshold lies equally many standard deviations from the mean of either class.

The models hold at most ``len(SYMBOLS) ** (ORDER + 1)`` windows (below a million), whatever the number of urls, so
their table may be broadcast: urls are cut into windows, weighed and summed up where they lie.

Nulls and odd input: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by
the models as an empty string. Repeated rows are judged alike. If either class has no url to learn from, all
urls without a rule are allowed. An empty table gives no rows. All columns of the input ride along in ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.llm.rows import carried
from lotbook.session import staged

#: Letters, a digit, marks of urls, all others (~), start (^), end ($).
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-~^$"
ORDER = 3
HELD = "3"  # md5 below this hexadecimal digit: three of sixteen urls calibrate


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest rule that fits: struct(verdict, rule), or null. ``rules``: (verdict, host/path), a short list."""
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, slash, start = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def signs(host: Column, path: Column) -> Column:
    """Host and path in the alphabet of the models."""
    small = F.translate(F.concat(host, path), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(small, "[0-9]", "0"), "[^a-z0./-]", "~")


def windows(text: Column) -> Column:
    """Each sign with the ``ORDER`` signs before it, the end mark included."""
    padded = F.concat(F.lit("^" * ORDER), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def _conditional(grams: DataFrame, name: str, total: int) -> DataFrame:
    """gram, ln P(last sign | signs before) of each window, for the counts in ``name``."""
    below = None
    for order in range(ORDER + 1):
        counts = grams.select(F.substring("gram", ORDER + 1 - order, order + 1).alias("g"), F.col(name).alias("n"))
        counts = counts.groupBy("g").agg(F.sum("n").alias("n"))
        if order == 0:
            below = counts.select("g", ((F.col("n") + 1.0) / (total + len(SYMBOLS))).alias("p"))
            continue
        context = F.substring("g", 1, order)
        contexts = counts.groupBy(context.alias("c")).agg(F.sum("n").alias("all"), F.sum((F.col("n") > 0).cast("int")).alias("kinds"))
        lower = below.select(F.col("g").alias("s"), F.col("p").alias("q"))
        joined = counts.withColumn("c", context).withColumn("s", F.substring("g", 2, order)).join(contexts, "c").join(lower, "s")
        p = F.when(F.col("all") > 0, (F.col("n") + F.col("kinds") * F.col("q")) / (F.col("all") + F.col("kinds"))).otherwise(F.col("q"))
        below = joined.select("g", p.alias("p"))
    return below.select(F.col("g").alias("gram"), F.ln("p").alias(f"ln_{name}"))


def scores(texts: DataFrame) -> DataFrame:
    """text, score of each distinct ``text``; ``texts``: text, accepted, rejected (rows to learn from, of either class)."""
    distinct = texts.groupBy("text").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    distinct = staged(distinct, "url-texts")
    cut = distinct.select("text", "accepted", "rejected", F.explode(windows(F.col("text"))).alias("gram"))
    grams = staged(cut.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "grams")
    sums = grams.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")).first()
    accepted, rejected = (_conditional(grams, c, sums[c] or 0) for c in ("accepted", "rejected"))
    both = accepted.join(rejected, "gram")
    model = staged(both.select("gram", (F.col("ln_accepted") - F.col("ln_rejected")).alias("weight")), "url-model")
    # below a million windows of four signs: bounded by the alphabet
    weighed = cut.select("text", "gram").join(F.broadcast(model), "gram")
    return weighed.groupBy("text").agg((F.sum("weight") / F.count("*")).alias("score"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """row, host, path, rule, verdict, score (null if neither class has a url)."""
    host, path = host_and_path()
    rows = pages.select(carried(pages), "url", host.alias("host"), path.alias("path"))
    rows = rows.select("row", "url", "host", "path", rule_of(rules, F.col("host"), F.col("path")).alias("r"), signs(F.col("host"), F.col("path")).alias("text"))
    held = F.md5(F.coalesce("url", F.lit(""))) < HELD
    allowed, blocked = F.coalesce(F.col("r.verdict") == "allow", F.lit(False)), F.coalesce(F.col("r.verdict") == "block", F.lit(False))
    labelled = staged(rows.select("text", (allowed & ~held).cast("int").alias("accepted"), (blocked & ~held).cast("int").alias("rejected"),
                                  (allowed & held).cast("int").alias("a"), (blocked & held).cast("int").alias("b")), "urls")
    found = staged(scores(labelled.select("text", "accepted", "rejected")), "url-scores")
    texts = labelled.groupBy("text").agg(*[F.sum(c).alias(c) for c in ("accepted", "rejected", "a", "b")])
    weighed = texts.join(found, "text")
    moments = []
    for c in ("a", "b"):
        n, s, q = (F.sum(F.col(c) * x) for x in (F.lit(1), F.col("score"), F.col("score") * F.col("score")))
        moments += [n.alias(f"n_{c}"), (s / F.nullif(n, F.lit(0))).alias(f"mean_{c}"),
                    F.sqrt(F.greatest(q / F.nullif(n, F.lit(0)) - F.pow(s / F.nullif(n, F.lit(0)), F.lit(2)), F.lit(0.0))).alias(f"sd_{c}")]
    facts = weighed.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), *moments).first()
    if not facts["accepted"] or not facts["rejected"]:
        verdict = F.lit("allow")
    else:
        verdict = F.when(F.col("score") >= F.lit(threshold(facts)), "allow").otherwise("block")
    joined = rows.join(found, "text", "left")
    return joined.select("row", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", verdict).alias("verdict"), "score")


def threshold(facts) -> float:
    """Equally many standard deviations below the accepted mean and above the rejected one; zero if not to be told."""
    if not facts["n_a"] or not facts["n_b"] or facts["mean_a"] <= facts["mean_b"]:
        return 0.0
    spread = facts["sd_a"] + facts["sd_b"]
    if spread == 0:
        return (facts["mean_a"] + facts["mean_b"]) / 2
    return (facts["mean_a"] * facts["sd_b"] + facts["mean_b"] * facts["sd_a"]) / spread
