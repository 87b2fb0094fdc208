"""URL filtering by association rules.

A URL is a set of tokens: labels of its host, words of its path, its extension, its query keys. Spark's FP-growth mines
token combinations from the unwanted URLs, of all items of each; tokens that stand in the same unwanted URLs are one item.
An item that no wanted URL has is a rule by itself and left out of the combinations, since it would only repeat itself in
them. Combinations in enough unwanted URLs, by count, whose exact share of unwanted ones among all labelled URLs is
high enough become rules, and a rule goes when a smaller one in it is as confident. An inverted index lists each rule under
its rarest token, so a URL meets only the rules of its own tokens and a rule matches when all its tokens are there.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.operators.small import small_side
from flowlab.session import materialize

#: Fixed values: (host and path, verdict) rules that come before mined ones.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
MIN_CONFIDENCE = 0.5
#: A rule needs so many unwanted URLs, however many are labelled.
MIN_COUNT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with the rule's."""
    rule = verdict = F.lit(None).cast("string")
    for text, judged in sorted(rules, key=lambda r: len(r[0])):  # a later one is longer and wins
        domain, _, rest = text.partition("/")
        fits = ((F.col(host) == domain) | F.col(host).endswith("." + domain)) & F.col(path).startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, judged).otherwise(verdict)
    return rule, verdict


def tokens_of(url: str = "url") -> Column:
    """Different tokens of a URL, each marked by where it stands; none without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    host_words = F.concat(F.split(host, r"\."), F.split(host, r"[.\-_]"))
    path_words = F.filter(F.split(F.lower(path), r"[/.\-_]"), lambda x: ~x.rlike(r"^\d+$"))
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    every = F.concat(marked("h:", host_words), marked("p:", path_words), marked("q:", keys))
    return F.when(u.contains("://"), F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _items(unwanted: DataFrame, known: DataFrame, min_count: int) -> DataFrame:
    """(item, token, share): tokens of enough unwanted URLs; those of the same ones share an item, named by the first of
    them. share: how many of a token's labelled URLs are unwanted."""
    bad = unwanted.select(F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"), F.explode("tokens").alias("token"))
    sets = bad.groupBy("token", "a", "b").agg(F.count("*").alias("n"))
    where = sets.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).filter(F.col("n") >= min_count)
    every = known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("all"))
    alike = where.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    return where.join(alike, ["n", "a", "b"]).join(every, "token").select("item", "token", (F.col("n") / F.col("all")).alias("share"))


def mine_rules(labelled: DataFrame, *, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """(rule, tokens, confidence, support) from (tokens, unwanted boolean): token sets that carry the label; support is the
    number of unwanted rows.

    All labelled rows count. Rows with a null label are left out. Without labelled rows there are no rules.
    """
    known = materialize(labelled.filter("unwanted IS NOT NULL AND size(tokens) > 0").select(F.array_sort("tokens").alias("tokens"), "unwanted"), "labelled")
    unwanted = known.filter("unwanted")
    n = unwanted.count()
    schema = "rule string, tokens array<string>, confidence double, support long"
    if n < min_count:
        return labelled.sparkSession.createDataFrame([], schema)
    items = materialize(_items(unwanted, known, min_count), "items")
    best = items.groupBy("item").agg(F.max("share").alias("share"))
    mixed = small_side(best.filter("share < 1").select("item"))
    spread = unwanted.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("tokens").alias("item"))
    baskets = spread.join(mixed, "item").groupBy("row").agg(F.collect_list("item").alias("items"))  # a URL's own
    baskets = materialize(baskets, "baskets")
    share = min(1.0, (min_count - 0.5) / max(1, baskets.count()))  # half a count below, so that rounding asks for no more
    found = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(baskets.select("items")).freqItemsets
    alone = best.filter("share = 1").select(F.array("item").alias("items"))
    sets = found.select("items").union(alone).select(F.monotonically_increasing_id().alias("set"), "items").withColumn("item", F.explode("items"))
    members = items.groupBy("item").agg(F.collect_list("token").alias("members"))
    sets = sets.join(members, "item").groupBy("set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("tokens"))
    rules = materialize(sets.select(F.concat_ws("\x01", "tokens").alias("rule"), "tokens").distinct(), "sets")
    counted = _met(known.groupBy("tokens", "unwanted").agg(F.count("*").alias("n")), rules, ["tokens", "unwanted", "n"])
    exact = counted.groupBy("rule").agg(F.sum(F.when(F.col("unwanted"), F.col("n"))).alias("support"), F.sum("n").alias("all"))
    confident = exact.withColumn("confidence", F.col("support") / F.col("all")).filter((F.col("support") >= min_count) & (F.col("confidence") >= min_confidence))
    found = materialize(rules.join(confident.select("rule", "confidence", "support"), "rule"), "rules")
    # a rule with a smaller, at least as confident rule inside it says nothing more
    parts = found.select(F.explode("tokens").alias("token"), "rule", "tokens", "confidence")
    inner = found.select(F.col("tokens")[0].alias("token"), F.col("tokens").alias("small"), F.col("confidence").alias("least"))
    covered = parts.join(inner, "token").filter((F.size("small") < F.size("tokens")) & (F.col("least") >= F.col("confidence")) & (F.size(F.array_except("small", "tokens")) == 0))
    return found.join(covered.select("rule").distinct(), "rule", "left_anti").select("rule", "tokens", "confidence", "support")


def _met(pages: DataFrame, rules: DataFrame, columns: list[str]) -> DataFrame:
    """(rule, columns) for each rule whose tokens a row of ``pages`` (tokens, ..) has all, through an index of rules by
    rarest token."""
    listed = rules.select("rule", F.col("tokens").alias("needed"), F.explode("tokens").alias("token"))
    wanted = small_side(listed.select("token").distinct())
    frequency = pages.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("f"))
    index = listed.join(frequency, "token").groupBy("rule", "needed").agg(F.min_by("token", F.struct("f", "token")).alias("token"))
    met = pages.select(*columns, F.col("tokens").alias("own"), F.explode("tokens").alias("token")).join(small_side(index), "token")
    return met.filter(F.size(F.array_except("needed", "own")) == 0).select("rule", *columns)


def matched(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Distinct ``key`` of (key, tokens) rows in which some rule matches."""
    return _met(pages, rules, [key]).select(key).distinct()


def judge_urls(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", unwanted: str = "toxic > 0 OR quality = 0") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages``.

    The longest fixed rule decides; else a page is blocked if a mined rule matches its URL, and allowed if none does, so
    null, empty and malformed URLs are allowed. Labels come from ``labels`` by page id; of repeated labels any
    unwanted one counts. Repeated pages are judged alike; an empty table gives no rows.
    """
    taken = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = taken.select("page_id", host_of().alias("host"), path_of().alias("path"), tokens_of().alias("tokens"))
    known = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("page_id")).agg(F.bool_or(F.expr(unwanted)).alias("unwanted"))
    rules = materialize(mine_rules(rows.join(known, "page_id")), "mined")
    rows = rows.withColumn("_set", F.xxhash64("tokens"))
    different = rows.select("_set", "tokens").distinct()
    hit = matched(different, rules, "_set").withColumn("_hit", F.lit(True))
    rule, verdict = rule_of("host", "path")
    out = rows.join(hit, "_set", "left")
    method = F.when(F.col("_hit"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
