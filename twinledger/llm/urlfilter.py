"""URL verdicts by rules, and for all other URLs by a ratio of character language models. DataFrame functions only.

URLs on which a rule decides are the examples: accepted where it allows, rejected where it blocks. For either kind a
Markov model of characters gives the probability of the next one after up to ORDER - 1 others, each order smoothed by
the one below it, so that a context never seen counts for nothing and the order varies with the evidence. A URL's
score is the mean of the log ratio over its characters; the threshold lies midway between the score that 95 % of the
accepted examples exceed and that which 95 % of the rejected ones do not.

Defined cases: a url without `://` has empty host and path and is judged by its text like any other; a null one is
judged as an empty text; without examples of both kinds all ratios are 0 and the verdict is allow; a score at the
threshold is allowed; repeated rows are judged each; an empty table gives no rows; a very long url has as many n-gram
rows as characters, counted before they are shuffled; further columns are ignored.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

ORDER, WEIGHT, ALPHABET = 4, 4.0, 128
#: Model rows up to which the model is broadcast (about 60 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def parts(url: str | Column) -> tuple[Column, Column]:
    """Host, in lower case, and path of a url; both empty without `://`."""
    url = F.col(url) if isinstance(url, str) else url
    pattern = "(?s)^.*?://([^/?#]*+)([^?#]*+)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none does."""
    rule = verdict = F
    for r in sorted(rules, key=lambda r: -len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = rule.when(fits, F.lit(r.host + r.path)), verdict.when(fits, F.lit(r.verdict))
    if rule is F:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def grams(text: Column) -> Column:
    """Each character of the text and its end mark, with the ORDER - 1 before it."""
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, ORDER))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio) of counts (gram, a, r): how often accepted and rejected URLs have each."""
    total = counts.agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    known = bool(total and total["a"] and total["r"])
    model = counts.select("gram", F.lit(1 / ALPHABET).alias("pa"), F.lit(1 / ALPHABET).alias("pr"))
    for k in range(1, ORDER + 1):
        of = lambda name, start, n: counts.groupBy(F.expr(f"substring(gram, {start}, {n})").alias(name)).agg(F.sum("a").alias(f"{name}_a"), F.sum("r").alias(f"{name}_r"))
        start = ORDER - k + 1
        model = model.withColumns({"tail": F.expr(f"substring(gram, {start}, {k})"), "before": F.expr(f"substring(gram, {start}, {k - 1})")})
        model = model.join(of("tail", start, k), "tail").join(of("before", start, k - 1), "before")
        smooth = lambda p, n, c: (F.col(n) + WEIGHT * F.col(p)) / (F.col(c) + WEIGHT)
        model = model.select("gram", smooth("pa", "tail_a", "before_a").alias("pa"), smooth("pr", "tail_r", "before_r").alias("pr"))
    return model.select("gram", (F.log("pa") - F.log("pr") if known else F.lit(0.0)).alias("ratio"))


def filtered(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) per page."""
    host, path = parts(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict, "row": F.monotonically_increasing_id()})
    rows = written(rows, "urls")  # row numbers stay as they are from here on
    each = rows.withColumn("gram", F.explode(grams(F.col("url"))))
    counts = each.groupBy("gram").agg(F.count_if(F.col("said") == "allow").alias("a"), F.count_if(F.col("said") == "block").alias("r"))
    model = written(log_ratios(written(counts, "grams")), "ratios")
    if model.count() <= BROADCAST_ROWS:
        model = F.broadcast(model)
    scored = each.join(model, "gram").groupBy("row", "id", "host", "path", "rule", "said").agg(F.avg("ratio").alias("score"))
    scored = written(scored, "scored")
    low, high = F.percentile_approx("score", 0.05, 10_000), F.percentile_approx("score", 0.95, 10_000)
    seen = {r["said"]: r for r in scored.filter("said is not null").groupBy("said").agg(low.alias("low"), high.alias("high")).collect()}
    threshold = (seen["allow"]["low"] + seen["block"]["high"]) / 2 if len(seen) == 2 else 0.0
    method = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score")
