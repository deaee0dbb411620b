"""URL filter: rules first, then the likelihood ratio of two character language models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealspan.llm.common import Scratch, ascii_lower

ORDER = 4
WEIGHT = 2.0
START, END = "\u0002", "\u0003"
#: A gram with at least this share of all places is frequent; there are at most 1000 such grams.
FREQUENT = 1e-3
#: First hex digits of a URL's md5 for which it is kept out of the models, to calibrate on.
HELD_OUT = "012"


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host_: Column, path_: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; of equals the first by name, then verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name + r.verdict])):
        fits = ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """The distinct grams of ``order`` characters and one more in each URL, with their number in it."""
    padded = F.concat(F.lit(START * order), ascii_lower(F.col("url")), F.lit(END))
    places = F.sequence(F.lit(1), F.length("url") + 1)
    at = urls.select("url", "verdict", "learns", padded.alias("padded"), F.explode(places).alias("i"))
    gram = F.substring("padded", F.col("i"), F.lit(order + 1))
    return at.select("url", "verdict", "learns", gram.alias("gram"))


def gram_ratios(grams: DataFrame, order: int, weight: float, scratch: Scratch) -> DataFrame:
    """Each gram's ``ratio``: log probability of its last character in accepted less that in rejected URLs.

    Smoothed models of variable order: the longest context's counts are mixed with the prediction of the next shorter
    one as if that had been seen ``weight`` times; the shortest is mixed with equal shares of all characters. A context
    that was not seen leaves the prediction to the shorter one. One join per order, whose keys are contexts of all
    lengths but the longest; the counts are summed in each task before they are moved.
    """
    learns = lambda v: F.sum(F.when(F.col("learns") & (F.col("verdict") == v), 1).otherwise(0)).alias(f"n_{v}")
    counts = scratch.keep(grams.groupBy("gram").agg(F.count("*").alias("places"), learns("allow"), learns("block")))
    letters = F.substring("gram", order + 1, 1).alias("letter")
    size = F.lit(1.0) / (counts.select(letters).distinct().count() + 1)
    model = None
    for n in range(order + 1):
        context = F.substring("gram", order + 1 - n, n)
        own = counts.groupBy(context.alias("context"), letters).agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))
        whole = own.groupBy("context").agg(F.sum("n_allow").alias("all_allow"), F.sum("n_block").alias("all_block"))
        own = own.join(whole, "context")  # a context has at most as many rows as there are characters
        if model is None:
            own = own.withColumn("p_allow", size).withColumn("p_block", size)
        else:
            shorter = model.withColumnRenamed("context", "rest")
            own = own.withColumn("rest", F.substring("context", 2, n)).join(shorter, ["rest", "letter"])
        p = lambda v: ((F.col(f"n_{v}") + weight * F.col(f"p_{v}")) / (F.col(f"all_{v}") + weight)).alias(f"p_{v}")
        model = own.select("context", "letter", p("allow"), p("block"))
    ratio = (F.log("p_allow") - F.log("p_block")).alias("ratio")
    model = model.select(F.concat("context", "letter").alias("gram"), ratio)
    return scratch.keep(counts.select("gram", "places").join(model, "gram"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    order: int = ORDER,
    weight: float = WEIGHT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Each page's host and path, the longest rule that fits its URL, and a verdict for every page.

    Where no rule fits, two character language models decide, learned from all URLs that rules accept and reject: the
    difference of their log-likelihoods over the number of characters, against a threshold. That is calibrated on URLs
    kept out of the models (by their md5): between the two classes' means, as many standard deviations from one as from
    the other. ``allow`` if the score is the threshold at least. If rules accept none or reject none of the URLs to
    learn or calibrate from, all other pages are allowed.

    Equal URLs are scored once. Scores of frequent grams are sent to every task, of which there are at most 1000;
    the others are joined. Returns the id column, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (null where
    a URL is null). A null or empty URL has empty host and path, and its end is all that is scored; a null one
    is allowed. Repeated rows each get a row. Other columns are not read. An empty table gives an empty result.
    """
    own = pages.select(F.col(id_col).alias("own_id"), F.col(url_col).alias("url"))
    with Scratch(pages.sparkSession) as scratch:
        urls = own.select("url").filter("url is not null").distinct()
        # Texts are small but unfold into many grams, so they go to all tasks before that.
        urls = urls.repartition(max(pages.sparkSession.sparkContext.defaultParallelism, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "url")
        name, verdict = longest_rule(host(F.col("url")), path(F.col("url")), rules)
        held = F.substring(F.md5(F.col("url")), 1, 1).isin(*HELD_OUT)
        urls = scratch.keep(urls.select("url", verdict.alias("verdict"), (~held).alias("learns")))
        grams = _grams(urls, order)
        ratios = gram_ratios(grams, order, weight, scratch)
        total = ratios.agg(F.sum("places")).first()[0] or 0
        each = grams.groupBy("url", "gram").agg(F.count("*").alias("n"))
        often = ratios.filter(F.col("places") >= FREQUENT * total).select("gram", F.col("ratio").alias("often"))
        seldom = ratios.filter(F.col("places") < FREQUENT * total).select("gram", "ratio")
        each = each.join(F.broadcast(often), "gram", "left")
        sums = each.filter("often is not null").select("url", (F.col("n") * F.col("often")).alias("x"))
        sums = sums.union(each.filter("often is null").join(seldom, "gram").select("url", (F.col("n") * F.col("ratio")).alias("x")))
        scored = sums.groupBy("url").agg(F.sum("x").alias("x")).select("url", (F.col("x") / (F.length("url") + 1)).alias("score"))
        scored = scratch.keep(urls.join(scored, "url"))
        known = scored.filter("not learns and verdict is not null").groupBy("verdict")
        known = {r.verdict: r for r in known.agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("sd")).collect()}
        learned = {r.verdict for r in scored.filter("learns and verdict is not null").select("verdict").distinct().collect()}
        threshold = float("-inf")
        if len(known) == 2 and len(learned) == 2:
            a, b = known["allow"], known["block"]
            threshold = (a["mean"] * b.sd + b["mean"] * a.sd) / (a.sd + b.sd) if a.sd + b.sd > 0 else (a["mean"] + b["mean"]) / 2
        by_method = F.when(F.coalesce(F.col("score") >= threshold, F.lit(True)), "allow").otherwise("block")
        out = own.join(scored.select("url", "score"), "url", "left")
        host_, path_ = host(F.col("url")), path(F.col("url"))
        name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
        out = out.select("own_id", host_.alias("host"), path_.alias("path"), "score")
        out = out.select(F.col("own_id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "score")
        return scratch.result(out)
