"""URL filters: given rules by host and path, and rules mined from labels.

Mining: a URL is a set of tokens (scheme, host labels, path segments, query keys, fragment). Tokens that
stand in exactly the same labelled URLs count as one. FP-growth finds the combinations that are frequent
among URLs with the bad label; a combination's support and confidence are then counted over all labelled
URLs, and combinations below either bound are pruned. Of combinations that the same URLs have, only the
one that holds all the others is kept (the closed one), as they would say the same of the labels. What is left
are rules "these tokens imply the bad label".

Matching, for mining and use alike, is by an inverted index: a rule is listed under its rarest token
only, URLs meet rules through their tokens, and what meets is verified by set inclusion. URLs with
equal token sets are collapsed to one row before they are spread by token, so a host that a third of
all URLs share is few rows there. Only DataFrame functions and Spark's own FP-growth are used.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoscope.llm import files

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many bad URLs of one token set are dealt to a task at a time.
CHUNK = 1000
RULES = "rule bigint, tokens array<string>, support bigint, confidence double"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null without one. A rule is a host and, from its
    first ``/`` on, a path; it fits the host and all its subdomains where the URL's path starts with it.
    Ties go by the order of the text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted; digits in path segments all count as one. A URL that is null or
    has no ``://`` has none."""
    rest = _after_scheme(url)
    scheme = F.translate(F.substring(url, F.lit(1), F.locate("://", url) - 1), UPPER, LOWER)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    marked = lambda mark, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    found = F.concat(
        F.array(F.concat(F.lit("scheme="), scheme)),
        marked("host=", F.split(host(url), r"\.")),
        marked("path=", F.split(F.regexp_replace(path(url), "[0-9]+", "0"), "/")),
        marked("query=", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))),
        marked("fragment=", F.array(F.regexp_extract(rest, "#(.*)$", 1))),
    )
    return F.when(rest.isNotNull(), F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens, rule`` for every distinct token set of ``sets`` (column ``tokens``) and rule all of whose
    tokens it has."""
    spread = sets.select("tokens", F.explode("tokens").alias("token"))
    frequency = spread.groupBy("token").agg(F.count("*").alias("sets"))
    listed = rules.select("rule", F.col("tokens").alias("rule_tokens"), F.explode("tokens").alias("token")).join(frequency, "token")
    index = listed.groupBy("rule", "rule_tokens").agg(F.min_by("token", F.struct("sets", "token")).alias("token"))
    met = spread.join(index, "token").filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    return met.select("tokens", "rule")


def transactions(sets: DataFrame) -> DataFrame:
    """``items``: the tokens of every set of ``sets`` (``tokens, bad``), once for each bad URL. Counts are dealt
    out in chunks before tokens are repeated, so one set with very many bad URLs is spread over all tasks."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = F.sequence(F.lit(0).cast("bigint"), F.col("bad") - 1, F.lit(CHUNK).cast("bigint"))
    chunks = sets.filter("bad > 0").select("tokens", "bad", F.explode(firsts).alias("first")).repartition(n)
    size = F.least(F.lit(CHUNK), F.col("bad") - F.col("first")).cast("int")
    return chunks.select(F.explode(F.array_repeat("tokens", size)).alias("items"))


def together(sets: DataFrame) -> DataFrame:
    """``item, members``: the tokens of ``sets`` (``tokens, bad``), those in exactly the same sets as one group, named
    by its first token. Groups without a bad URL are left out. Sets are told apart by 128 bits, so a group is found
    by one sum per token and no list of sets is gathered; its members all stand in one URL, which bounds them."""
    marks = [F.xxhash64("tokens").alias("m1"), F.xxhash64(F.lit("second"), "tokens").alias("m2")]
    spread = sets.select(F.explode("tokens").alias("token"), "bad", *marks)
    tokens_of = spread.groupBy("token").agg(
        F.count("*").alias("sets"), F.sum("bad").alias("bad"), F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2")
    )
    groups = tokens_of.filter("bad > 0").groupBy("sets", "bad", "m1", "m2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return groups.select(F.col("members")[0].alias("item"), "members", "bad")


def closed(counted: DataFrame) -> DataFrame:
    """Of combinations (``tokens`` sorted, ``urls``), those that no other with one token more has as many URLs as."""
    shorter = counted.filter(F.size("tokens") > 1).select(F.explode("tokens").alias("token"), "tokens", "urls")
    shorter = shorter.select(F.array_except("tokens", F.array("token")).alias("tokens"), "urls").distinct()
    return counted.join(shorter, ["tokens", "urls"], "left_anti")


def mine(
    spark: SparkSession, urls: DataFrame, labels: DataFrame, min_support: float, min_count: int, min_confidence: float
) -> DataFrame:
    """Rules from ``urls`` (``page_id, url``) whose id has a label (``page_id, bad`` boolean): closed combinations
    of tokens with at least ``min_support`` of all labelled URLs and ``min_count`` of them bad, and with at
    least ``min_confidence`` of theirs bad. Null labels teach nothing; a URL counts once for each label of
    its id. Without any such combination the table is empty."""
    labelled = urls.join(labels.filter("bad IS NOT NULL"), "page_id").select(tokens(F.col("url")).alias("tokens"), "bad")
    sets, _ = files.written(
        labelled.filter(F.size("tokens") > 0)
        .groupBy("tokens")
        .agg(F.count("*").alias("urls"), F.count_if("bad").alias("bad")),
        "labelled",
    )
    total, bad = sets.agg(F.coalesce(F.sum("urls"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    least = max(min_count, min_support * total)
    if bad < least:
        return spark.createDataFrame([], RULES)
    groups, _ = files.written(together(sets).filter(F.col("bad") >= least).select("item", "members"), "groups")
    # Every set by its items that can be frequent; sets that agree in these become one.
    items = sets.withColumn("set", F.monotonically_increasing_id()).withColumn("item", F.explode("tokens"))
    items = items.join(groups.select("item"), "item").groupBy("set", "urls", "bad").agg(F.array_sort(F.collect_list("item")).alias("tokens"))
    small, _ = files.written(items.groupBy("tokens").agg(F.sum("urls").alias("urls"), F.sum("bad").alias("bad")), "items")
    model = FPGrowth(itemsCol="items", minSupport=least / bad, minConfidence=min_confidence).fit(transactions(small))
    frequent, _ = files.written(
        model.freqItemsets.select(F.monotonically_increasing_id().alias("rule"), F.array_sort("items").alias("tokens")), "itemsets"
    )
    counted = match(small, frequent).join(small, "tokens").groupBy("rule").agg(F.sum("urls").alias("urls"), F.sum("bad").alias("support"))
    counted, _ = files.written(frequent.join(counted, "rule"), "counted")
    kept = closed(counted.filter(F.col("support") >= least)).withColumn("confidence", F.col("support") / F.col("urls"))
    whole = kept.filter(F.col("confidence") >= min_confidence).withColumn("item", F.explode("tokens")).join(groups, "item")
    return whole.groupBy("rule", "support", "confidence").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("tokens")).select(
        "rule", "tokens", "support", "confidence"
    )


def judge(urls: DataFrame, rules: DataFrame, given: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For every row: ``id_col, host, path, rule`` and ``verdict`` by the given rules, ``mined_rule`` (the
    tokens of the surest mined rule that matches, with a space between) and ``confidence``. The verdict is
    the given rule's, else block with a mined rule, else allow. Null URLs and those without ``://`` have an
    empty host and path and are allowed; repeated rows are judged each."""
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", tokens(F.col("url")).alias("tokens"))
    sets = rows.select("tokens").distinct()
    best = F.max(F.struct("confidence", "support", "rule_tokens")).alias("best")
    known = rules.select("rule", F.col("tokens").alias("rule_tokens"), "confidence", "support")
    matched, _ = files.written(match(sets, rules).join(known, "rule").groupBy("tokens").agg(best), "matched")
    host_of, path_of = host(F.col("url")), path(F.col("url"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), given)
    return (
        rows.withColumns({"host": host_of, "path": path_of})
        .join(matched, "tokens", "left")
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            rule.alias("rule"),
            F.coalesce(verdict, F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"),
            F.array_join("best.rule_tokens", " ").alias("mined_rule"),
            F.col("best.confidence").alias("confidence"),
        )
    )
