"""URL filters mined by association rules.

Given rules (host and path prefix, allow or block) decide what they fit, the longest first. The URLs they decide
are the labels: each is a basket of URL tokens. Spark's FP-growth mines the token combinations of blocked and of
allowed baskets together with the label's token; a combination is a rule if its support (MIN_SUPPORT of the baskets and
MIN_COUNT of them) and its confidence, MIN_CONFIDENCE, are reached and it isn't implied by a shorter rule of the same
verdict. The rest of the URLs are matched through an inverted index: a rule is filed under its rarest token, so a URL
looks up its tokens and checks only the rules filed there. The most confident, then most supported, then longest rule
decides, of equal ones a blocking one; none: allow.

Equal baskets are counted first. Two reductions keep the mining from growing with the subsets of a long URL, and
change no verdict: tokens that occur in the same baskets are one class, which a URL has if it has one of them (a
combination of two of a class is implied by either); and a token that only one verdict's baskets have is a rule by
itself, whatever else stands beside it, and isn't mined further. FP-growth distributes its trees over its own
partitions. The tables of classes and rules are bounded by support (a level has at most 1 / MIN_SUPPORT frequent items
for each token of an average basket) and counted before they are broadcast.

Defined results: null URL, and one without ``://``, has an empty host and path, no rule, and the method's verdict on
an empty basket, allow; repeated URLs get equal results and count as often as they occur; without any labelled URL no
rule is mined; empty tables give empty results; extra columns are never read."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_ids, discard, written

MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.005, 20, 0.9
BROADCAST_ROWS = 100_000
ALLOW, BLOCK = "allow", "block"
_LABEL = "label="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path of a rule such as ``example.com/en/``."""
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, rule) that fits, as (rule, verdict); null if none does. An order of
    conditions: the list of rules is a constant of the plan."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, own_path = split_rule(rule)
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def basket(host: Column, path: Column) -> Column:
    """Distinct tokens: the host's labels, cut at hyphens, and the path's segments that aren't numbers."""
    parts = F.filter(F.split(host, r"[.\-]"), lambda x: x != "")
    segments = F.filter(F.split(F.translate(path, _UPPER, _LOWER), r"[/.\-_]"), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    tag = lambda prefix: lambda x: F.concat(F.lit(prefix), x)
    return F.array_distinct(F.concat(F.transform(parts, tag("host:")), F.transform(segments, tag("path:"))))


class Mined(NamedTuple):
    rules: DataFrame  # (rule_id, tokens, verdict, confidence, support); tokens are classes, named by their least token
    classes: DataFrame  # (token, class)
    scratch: list[DataFrame]


def classes_of(baskets: DataFrame, least: int) -> DataFrame:
    """baskets (tokens, verdict, n), distinct -> (token, class, verdict, n, pure) of tokens that ``least`` baskets of one
    verdict have, n by that verdict. Tokens of the same baskets are one class; pure: no other verdict has it."""
    marks = [F.xxhash64(F.lit(seed), "tokens", "verdict").alias(f"h{seed}") for seed in (1, 2)]
    each = baskets.select("verdict", "n", *marks, F.explode("tokens").alias("token"))
    sums = [F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in (ALLOW, BLOCK)]
    known = each.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), *sums)
    known = known.filter((F.col(ALLOW) >= least) | (F.col(BLOCK) >= least)).withColumn("class", F.min("token").over(Window.partitionBy("c", "h1", "h2", ALLOW, BLOCK)))
    most = F.greatest(ALLOW, BLOCK)
    return known.select("token", "class", F.when(F.col(BLOCK) == most, F.lit(BLOCK)).otherwise(F.lit(ALLOW)).alias("verdict"), most.alias("n"), (F.col(ALLOW) + F.col(BLOCK) == most).alias("pure"))


def reduced(baskets: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """(key, tokens): baskets (key, tokens) by the classes (token, class) that they hold; those that hold none are left out."""
    small = F.broadcast(classes) if classes.count() <= BROADCAST_ROWS else classes
    return baskets.select(key, F.explode("tokens").alias("token")).join(small.select("token", "class"), "token").groupBy(key).agg(F.array_sort(F.collect_set("class")).alias("tokens"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> Mined:
    """labelled (tokens array<string>, verdict), at least one row."""
    from pyspark.ml.fpm import FPGrowth

    baskets = written(labelled.groupBy(F.array_sort("tokens").alias("tokens"), "verdict").agg(F.count(F.lit(1)).alias("n")), "baskets")
    total = baskets.agg(F.sum("n")).first()[0]
    least = max(math.ceil(min_support * total), MIN_COUNT)
    known = written(classes_of(baskets, least), "url-classes")
    heads = known.filter(F.col("token") == F.col("class"))
    pure = heads.filter("pure").select(F.array("class").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), (F.col("n") / total).alias("support"))
    # a combination with a token that is a sure rule by itself adds nothing, so FP-growth sees the other tokens alone
    mixed = written(known.filter("NOT pure").select("token", "class"), "url-mixed")
    rest = reduced(baskets.withColumn("id", F.struct("tokens", "verdict")), "id", mixed).join(baskets.select(F.struct("tokens", "verdict").alias("id"), "n"), "id")
    rest = written(rest.groupBy("tokens", F.col("id.verdict").alias("verdict")).agg(F.sum("n").alias("n")), "reduced")
    rows = rest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scratch = [baskets, mixed, rest, known]
    if rows < least:
        return Mined(pure.withColumn("rule_id", F.concat_ws(" ", "tokens")), known.select("token", "class"), scratch)
    items = rest.select(F.array_append("tokens", F.concat(F.lit(_LABEL), F.col("verdict"))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("n")))).select("items")
    grown = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows, minConfidence=min_confidence).fit(items)
    is_label = lambda x: x.startswith(_LABEL)
    rules = grown.associationRules.filter(is_label(F.col("consequent")[0]) & ~F.exists("antecedent", is_label))
    named = rules.select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(_LABEL) + 1, 99).alias("verdict"), "confidence", (F.round(F.col("support") * rows) / total).alias("support")
    )
    return Mined(pruned(named).unionByName(pure).withColumn("rule_id", F.concat_ws(" ", "tokens")), known.select("token", "class"), scratch)


def pruned(rules: DataFrame) -> DataFrame:
    """Rules without those that a shorter one of the same verdict and at least the same confidence implies. A rule
    meets those that it contains through its tokens, not all rules."""
    a, b = rules.alias("a"), rules.select(F.explode("tokens").alias("one"), F.col("tokens").alias("short"), F.col("verdict").alias("v"), F.col("confidence").alias("c")).alias("b")
    keyed = rules.select("*", F.explode("tokens").alias("one")).alias("a")
    implied = keyed.join(b, (F.col("a.one") == F.col("b.one")) & (F.col("b.v") == F.col("a.verdict")) & (F.col("b.c") >= F.col("a.confidence")) & (F.size("b.short") < F.size("a.tokens")) & (F.size(F.array_except("b.short", "a.tokens")) == 0))
    drop = implied.select(F.col("a.tokens").alias("tokens"), F.col("a.verdict").alias("verdict")).distinct()
    return rules.join(drop, ["tokens", "verdict"], "left_anti")


def match(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """urls (key, tokens) -> (key, verdict, mined_rule) of those that a rule matches."""
    frequency = rules.select(F.explode("tokens").alias("one")).groupBy("one").agg(F.count(F.lit(1)).alias("n"))
    filed = rules.select("*", F.explode("tokens").alias("one")).join(frequency, "one").groupBy("rule_id", "verdict").agg(F.min(F.struct("n", "one"))["one"].alias("one"), F.first("tokens").alias("need"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    index = F.broadcast(filed) if rules.count() <= BROADCAST_ROWS else filed
    looked = urls.select(key, "tokens", F.explode("tokens").alias("one")).join(index, "one").filter(F.size(F.array_except("need", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("need").alias("length"), "verdict", "rule_id"))
    return looked.groupBy(key).agg(best.alias("b")).select(key, F.col("b.verdict").alias("mined"), F.col("b.rule_id").alias("mined_rule"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, mined_rule), a row for each row of pages (key, url)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select(key, host.alias("host"), path.alias("path")).withColumn("r", fitting(F.col("host"), F.col("path"), rules))
    told = written(split.withColumn("tokens", basket(F.col("host"), F.col("path"))), "urls")
    labelled = told.filter("r is not null").select("tokens", F.col("r.verdict").alias("verdict"))
    if labelled.isEmpty():
        judged = told.withColumn("mined", F.lit(None).cast("string")).withColumn("mined_rule", F.lit(None).cast("string"))
    else:
        mined = mine(labelled)
        kept = written(mined.rules, "url-rules")
        # equal token sets are matched once, however many pages have them
        name = F.xxhash64("tokens")
        asked = told.filter("r is null").select("tokens").distinct().select(F.struct(name.alias("h"), F.concat_ws(" ", "tokens").alias("t")).alias("id"), "tokens")
        found = written(match(reduced(asked, "id", mined.classes), kept, "id"), "matched")
        discard(kept, *mined.scratch)
        judged = by_ids(told.withColumn("basket", F.struct(name.alias("h"), F.concat_ws(" ", "tokens").alias("t"))), "basket", found, "left", BROADCAST_ROWS)
    verdict = F.coalesce(F.col("r.verdict"), F.col("mined"), F.lit(ALLOW))
    shown = F.when(F.col("r").isNull(), F.col("mined_rule"))
    return judged.select(key, "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), shown.alias("mined_rule"))
