"""URL verdicts: explicit host and path rules first, mined association rules for the rest.

URLs that an explicit rule judges are the labelled rows. Spark's FP-growth finds frequent combinations of up to
MAX_TOKENS URL tokens with a label; a combination becomes a rule if its support and confidence are high enough and no
part of it says the same with as much confidence. A rule is filed under its rarest token, so a URL meets
only the rules of tokens that it has, and the rest of a rule's tokens is then tested.

FP-growth gives every frequent combination, and n tokens that come together have 2**n. So it is given less: a token
that comes with one label alone is a rule by itself, and no longer rule with it is wanted; tokens that always come
together are one item, which any of them stands for in a match; and where a URL still has more than MAX_ITEMS items,
items are dealt out to blocks of about BLOCK_ITEMS of a URL, a URL is mined once for each MAX_TOKENS blocks at most, and
a combination is counted where the blocks are its own. No combination of up to MAX_TOKENS tokens is lost.

Everything here is DataFrame functions and Spark ML.

Defined cases: null URLs and URLs without "://" have empty host and path, fit no rule and have no tokens,
so their verdict is the default; URLs of any length are whole; of rules that match, the most confident one judges, then
the one of more support, of more tokens, "block" before "allow"; repeated page_ids are judged row by row (equal rows
give equal rows); an empty table, or one without labelled rows, mines no rules; columns besides page_id and url are
ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svloom.llm.common import Workspace, small

#: (host, path prefix, verdict): the rules of the contract.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Least share of the labelled URLs that a rule is right for, least share of its matches; most tokens of a rule.
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.002, 0.8, 3
MAX_ITEMS, BLOCK_ITEMS = 12, 4
LOWER = "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, LOWER.upper(), LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the fitting rule whose host and path are longest together, null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r))
    out = None
    for rule_host, rule_path, verdict in ordered:
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Typed tokens: host labels and suffixes, path segments with numbers as <n>, query keys, scheme, fragment."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda _, i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.filter(F.split(F.regexp_replace(F.lower(path), r"[0-9]+", "<n>"), "/"), lambda x: x != "")
    places = F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, r"[-_]"))), lambda x: F.length(x) > 2), lambda x: F.concat(F.lit("word:"), x))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))))
    fragment = F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(suffixes, places, words, keys, scheme, fragment))).otherwise(F.array().cast("array<string>"))


RULE_SCHEMA = "tokens array<array<string>>, verdict string, confidence double, support double, key string"


def token_counts(transactions: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Frequent tokens (token, seen, most: of one label, x and y: marks of the set of URLs), and counts (token, verdict, freq)."""
    mark = F.xxhash64("id")
    posts = transactions.select("verdict", "id", F.explode("tokens").alias("token"))
    per = posts.groupBy("token", "verdict").agg(F.count("*").alias("freq"), F.bit_xor(mark).alias("x"), F.sum(F.shiftrightunsigned(mark, 32)).alias("y"))
    tokens = per.groupBy("token").agg(F.sum("freq").alias("seen"), F.max("freq").alias("most"), F.bit_xor("x").alias("x"), F.sum("y").alias("y"))
    return tokens.filter(F.col("seen") >= least), per.select("token", "verdict", "freq")


def mine_combinations(space: Workspace, transactions: DataFrame, items: DataFrame, least: int, max_tokens: int) -> DataFrame:
    """tokens (sorted items), label ('' for all), freq of the frequent combinations of 2 to max_tokens items.

    items: token, rank (from 0). transactions: id, tokens, verdict.
    """
    posts = transactions.select("id", "verdict", F.explode("tokens").alias("token")).join(F.broadcast(items.select("token", "rank")), "token")
    rows = space.save(posts.groupBy("id", "verdict").agg(F.collect_list("rank").alias("ranks")).filter("size(ranks) > 1"), "items")
    longest = rows.agg(F.max(F.size("ranks"))).first()[0] or 0
    n_blocks = 1 if longest <= MAX_ITEMS else -(-longest // BLOCK_ITEMS)

    def block(rank: Column) -> Column:
        return rank % n_blocks

    # all sets of up to max_tokens blocks of a URL, as sorted lists
    own = F.array_sort(F.array_distinct(F.transform("ranks", block)))
    level = F.transform(own, lambda b: F.array(b))
    sets = level
    for _ in range(min(max_tokens, n_blocks) - 1):
        level = F.flatten(F.transform(level, lambda t: F.transform(F.filter(own, lambda c: c > F.element_at(t, -1)), lambda c: F.concat(t, F.array(c)))))
        sets = F.concat(sets, level)
    dealt = rows.select("ranks", "verdict", F.explode(sets).alias("blocks"))
    name = F.concat(F.array_join(F.transform("blocks", lambda b: b.cast("string")), ","), F.lit("|"))
    inside = F.transform(F.filter("ranks", lambda r: F.array_contains(F.col("blocks"), block(r))), lambda r: F.concat(name, r.cast("string")))
    dealt = space.save(dealt.select(F.concat(inside, F.array(F.concat(name, F.lit("="), "verdict"))).alias("items")), "dealt")
    n = dealt.count()
    schema = "tokens array<string>, label string, freq long"
    if not n:
        return space.spark.createDataFrame([], schema)
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n)).fit(dealt).freqItemsets
    parts = found.select(F.substring_index(F.element_at("items", 1), "|", 1).alias("blocks"), F.transform("items", lambda x: F.substring(x, F.instr(x, "|") + 1, F.length(x))).alias("items"), "freq")
    parts = parts.select("blocks", "freq", F.transform(F.filter("items", lambda x: ~x.startswith("=")), lambda x: x.cast("int")).alias("ranks"), F.array_join(F.filter("items", lambda x: x.startswith("=")), "").alias("label"))
    its_own = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("ranks", block))), lambda b: b.cast("string")), ",") == F.col("blocks")
    parts = space.save(parts.filter((F.size("ranks") >= 2) & (F.size("ranks") <= max_tokens) & its_own), "combinations")
    named = parts.select("ranks", "label", "freq", F.explode("ranks").alias("rank")).join(F.broadcast(items.select("rank", "token")), "rank")
    return named.groupBy("ranks", "label", "freq").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select("tokens", "label", "freq")


def mine_rules(labelled: DataFrame, space: Workspace, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """tokens, verdict, confidence, support, key from labelled (tokens, verdict).

    tokens: for each item of the rule the tokens that stand for it; key: a token under which the rule is filed, one row
    for each token of its rarest item.
    """
    transactions = labelled.filter("size(tokens) > 0").select("tokens", "verdict").withColumn("id", F.monotonically_increasing_id())
    transactions = space.save(transactions, "transactions")
    total = transactions.count()
    if not total:
        return space.spark.createDataFrame([], RULE_SCHEMA)
    least = max(1, math.ceil(min_support * total))
    tokens, per = token_counts(transactions, least)
    tokens, per = space.save(tokens, "tokens"), space.save(per.filter(F.col("freq") >= least), "token-labels")
    # at most as many tokens are frequent as have a place in total / least URLs, whatever the size of the table
    order = Window.orderBy(F.desc("seen"), "token")
    classes = tokens.groupBy("seen", "x", "y", (F.col("most") == F.col("seen")).alias("decided")).agg(F.array_sort(F.collect_list("token")).alias("members"))
    classes = classes.withColumn("token", F.element_at("members", 1)).withColumn("rank", F.row_number().over(order) - 1)
    classes = space.save(classes.select("token", "members", "seen", "decided", "rank"), "classes")
    single = per.join(classes, "token").select(F.array("token").alias("tokens"), "verdict", "freq", "seen")
    frequent = space.save(mine_combinations(space, transactions, classes.filter("not decided"), least, max_tokens), "itemsets") if max_tokens > 1 else None
    rules = single
    if frequent is not None:
        whole = frequent.filter("label = ''").select("tokens", F.col("freq").alias("seen"))
        rules = rules.unionByName(frequent.filter("label <> ''").join(whole, "tokens").select("tokens", F.expr("substring(label, 2)").alias("verdict"), "freq", "seen"))
    rules = rules.select("tokens", "verdict", (F.col("freq") / F.col("seen")).alias("confidence"), (F.col("freq") / F.lit(float(total))).alias("support"))
    rules = space.save(rules.filter(F.col("confidence") >= min_confidence), "candidates")
    # a rule goes if leaving out one of its tokens gives a rule of the same verdict and at least its confidence
    parts = rules.filter(F.size("tokens") > 1).select("tokens", "verdict", "confidence", F.explode("tokens").alias("gone"))
    parts = parts.select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("gone")).alias("part"))
    smaller = rules.select(F.col("tokens").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    needless = parts.join(smaller, "part").filter((F.col("verdict") == F.col("v")) & (F.col("c") >= F.col("confidence"))).select("tokens", "verdict").distinct()
    kept = rules.join(needless, ["tokens", "verdict"], "left_anti").withColumn("item", F.explode("tokens"))
    kept = kept.join(classes.select(F.col("token").alias("item"), "members", "seen"), "item").groupBy("tokens", "verdict", "confidence", "support")
    kept = kept.agg(F.collect_list("members").alias("groups"), F.min(F.struct("seen", "members")).alias("rarest"))
    return space.save(kept.select(F.col("groups").alias("tokens"), "verdict", "confidence", "support", F.explode("rarest.members").alias("key")), "rules")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """row, mined verdict: the most confident matching rule (ties: support, more tokens, block before allow)."""
    posts = urls.select("row", F.col("tokens").alias("have"), F.explode("tokens").alias("key"))
    hits = posts.join(small(rules), "key").filter(F.forall("tokens", lambda any_of: F.arrays_overlap(any_of, F.col("have"))))
    best = F.max(F.struct("confidence", "support", F.size("tokens").alias("n"), F.col("verdict").alias("verdict")))
    return hits.groupBy("row").agg(best.alias("best")).select("row", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, default: str = "allow", **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_confidence for every row of pages.

    labels, if given, has (url, verdict) rows to learn from; else the URLs that an explicit rule judges teach.
    Equal URLs are judged once: only different URLs take part in the matching.
    """
    space = Workspace(pages.sparkSession, "urls")
    seen = pages.select("url").distinct().withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    seen = seen.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path"))).withColumn("explicit", rule_for(F.col("host"), F.col("path"), rules))
    seen = space.save(seen.withColumn("row", F.coalesce(F.col("url"), F.lit(""))), "urls")
    if labels is None:
        # every page counts, not every different URL
        weights = pages.select("url").join(seen.filter("explicit is not null").select("url", "tokens", F.col("explicit.verdict").alias("verdict")), "url")
        taught = weights.select("tokens", "verdict")
    else:
        own = labels.select("url", "verdict").withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
        taught = own.select(url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "verdict")
    mined = match_rules(seen.filter("explicit is null"), mine_rules(taught, space, **mining))
    judged = seen.join(mined, "row", "left")
    judged = judged.select(F.col("url").alias("__url"), "host", "path", F.col("explicit.rule").alias("rule"), F.coalesce("explicit.verdict", "mined", F.lit(default)).alias("verdict"), F.when(F.col("explicit").isNull(), F.col("confidence")).alias("mined_confidence"))
    return pages.select("page_id", "url").join(judged, F.col("url").eqNullSafe(F.col("__url"))).select("page_id", "host", "path", "rule", "verdict", "mined_confidence")
