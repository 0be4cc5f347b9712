"""URL filters: fixed host and path rules, and association rules mined from labels.

Spark's FP-growth finds combinations of URL tokens that occur with bad labels. Tokens that occur in the very same
labelled URLs say the same, so one of them goes into the mining and stands for its class: a URL with any token of the
class has it. That gives what mining all of them would, without naming every subset of the tokens of long URLs of one
make. Rules with enough support and confidence that no rule of some of their tokens makes
needless are kept, of any length, and match all URLs through an inverted index: each rule hangs on its rarest
token, and only URLs with that token are compared with it.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import spill

#: Fixed values: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BAD = "label=bad"


def _after_scheme() -> Column:
    at = F.instr(F.col("url"), "://")
    return F.when(at > 0, F.substring("url", at + 3, F.length("url")))


def parsed(pages: DataFrame) -> DataFrame:
    """pages with host and path; both empty where the url is null or has no ``://``."""
    rest = _after_scheme()
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def fixed(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule as host and path text, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of a URL: host labels, pairs of neighbouring labels, path segments, file ending, query keys, fragment.

    Digits read as one 0.
    """
    labels = F.filter(F.split("host", "\\."), lambda x: x != "")
    pairs = F.transform(labels, lambda x, i: F.concat(x, F.lit("."), F.coalesce(F.try_element_at(labels, i + 2), F.lit(""))))
    pairs = F.slice(pairs, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    url = F.coalesce(F.col("url"), F.lit(""))
    ending = F.lower(F.regexp_extract("path", "(?s)[^/.][.]([A-Za-z0-9]{1,8})$", 1))
    keys = F.transform(F.split(F.regexp_extract(url, "(?s)^[^?#]*[?]([^#]*)", 1), "&"), lambda q: F.regexp_extract(q, "(?s)^([^=]*)", 1))
    fragment = F.regexp_extract(url, "(?s)#(.*)$", 1)
    kinds = {"host": labels, "pair": pairs, "path": F.split("path", "/"), "ending": F.array(ending), "query": keys, "fragment": F.array(fragment)}

    def named(kind: str, x: Column) -> Column:
        return F.transform(F.filter(x, lambda t: t != ""), lambda t: F.concat(F.lit(f"{kind}:"), F.regexp_replace(t, "[0-9]+", "0")))

    return F.array_distinct(F.concat(*[named(k, x) for k, x in kinds.items()]))


def classes(labelled: DataFrame, least_rows: int) -> DataFrame:
    """(token, kept) of tokens in least_rows labelled rows and more: kept is the greatest token, by name, that occurs in the same rows."""
    rows = labelled.select("row", F.explode("items").alias("token"))
    uses = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("row") % F.lit(1 << 40)).alias("x"), F.sum(F.xxhash64("row", F.lit(1)) % F.lit(1 << 40)).alias("y")).where(F.col("n") >= least_rows)
    kept = uses.groupBy("n", "x", "y").agg(F.max("token").alias("kept"))
    return uses.join(kept, ["n", "x", "y"]).select("token", "kept")


def told(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (row, token) of rows (row, items): the tokens that stand for theirs; others are left out."""
    return rows.select("row", F.explode("items").alias("token")).join(known, "token").select("row", F.col("kept").alias("token")).distinct()


def mined(labelled: DataFrame, support: float = 0.002, confidence: float = 0.6, least_rows: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rules antecedent -> bad from rows (row, items, bad boolean), as (antecedent, support, confidence), and the ``classes`` of their tokens.

    row is a key of the row. A rule needs ``support`` of the rows and ``least_rows`` of them at least; support is the
    share of rows with the antecedent that are bad. It is needless if another with some of its tokens is as confident.
    Each token of an antecedent stands for its class.
    """
    n = labelled.count()
    share = min(1.0, max(support, least_rows / max(n, 1)))
    known = spill(classes(labelled, max(1, int(share * n))), "classes")
    inside = told(labelled, known).groupBy("row").agg(F.collect_list("token").alias("items"))
    rows = labelled.select("row", "bad").join(inside, "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    rows = rows.select(F.when(F.col("bad"), F.concat(items, F.array(F.lit(BAD)))).otherwise(items).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(rows)
    rules = spill(model.associationRules.where(F.element_at("consequent", 1) == BAD).select(F.array_sort("antecedent").alias("antecedent"), "support", "confidence"), "rules")
    return rules.join(_needless(rules), "antecedent", "left_anti"), known


def _needless(rules: DataFrame) -> DataFrame:
    """Antecedents of which some part is a rule and as confident: each rule hangs on its rarest token and meets the rules that hold it."""
    parts = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    index = parts.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    own = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("as_sure"), F.explode("antecedent").alias("token")).join(index, "token")
    hung = own.groupBy("part", "as_sure").agg(F.min(F.struct("uses", "token")).alias("least")).select("part", "as_sure", F.col("least.token").alias("token"))
    met = parts.join(hung, "token").where(F.size("part") < F.size("antecedent")).where("as_sure >= confidence")
    return met.where(F.size(F.array_except("part", "antecedent")) == 0).select("antecedent").distinct()


def matched(pages: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """(row, rule, confidence) of pages rows (row, items) that hold a token of each class of some rule: the most confident, then the shortest and least.

    ``known``: the classes of rules' tokens. A rule hangs on its rarest class, and rows with that class meet it.
    """
    parts = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    used = parts.select(F.col("token").alias("kept")).distinct()
    has = told(pages, known.join(used, "kept", "left_semi"))
    uses = has.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    index = parts.join(uses, "token").groupBy("antecedent", "confidence").agg(F.min(F.struct("uses", "token")).alias("least")).select("antecedent", "confidence", F.col("least.token").alias("token"))
    rows = has.groupBy("row").agg(F.collect_list("token").alias("items")).select("row", "items", F.explode("items").alias("token"))
    hung = rows.join(index, "token").where(F.size(F.array_except("antecedent", "items")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("minus"), F.size("antecedent").alias("size"), F.array_join("antecedent", " ").alias("rule")))
    return hung.groupBy("row").agg(best.alias("best")).select("row", F.col("best.rule").alias("rule"), (-F.col("best.minus")).alias("confidence"))


#: Parts over which equal URLs are dealt where they meet their match
SALTS = 16


def judged(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, support: float = 0.002, confidence: float = 0.6, least_rows: int = 20) -> DataFrame:
    """Per input row: page_id, host, path, rule, verdict, mined_rule and mined_confidence (null: no mined rule matches).

    verdict: the longest fixed rule's; without one, block where a mined rule matches, else allow. Labels are
    joined on page_id = doc_id; bad is quality 0 or toxic 1, and null labels are skipped. A null url, or one
    without ``://``, has empty host and path, fits no fixed rule and is allowed. mined_rule names a token for each class
    of tokens that the labelled rows don't tell apart; the url has one of each. Rules need least_rows labelled rows,
    as in ``mined``. Mining reads distinct (url, bad)
    as often as they occur; matching works on distinct urls, so repeated pages share a verdict. Without labels or
    pages no rule is mined. Columns other than page_id and url are ignored.
    """
    table = parsed(pages.select("page_id", F.col("url").cast("string").alias("url")))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    own = table.withColumn("items", tokens())
    learned, standing = mined(own.join(known, "page_id").select(F.monotonically_increasing_id().alias("row"), "items", "bad").transform(lambda df: spill(df, "labelled")), support, confidence, least_rows)
    urls = own.where("url is not null").groupBy(F.col("url").alias("row")).agg(F.first("items").alias("items"))
    hits = matched(urls, learned, standing).select(F.col("row").alias("url"), F.col("rule").alias("mined_rule"), F.col("confidence").alias("mined_confidence"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    # Equal URLs are dealt over some parts, and null ones meet nothing.
    salted = table.withColumns({"_salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"), "_at": F.when(F.col("url").isNull(), F.xxhash64("page_id").cast("string")).otherwise(F.col("url")), "_null": F.col("url").isNull()})
    hits = hits.select(F.col("url").alias("_at"), F.lit(False).alias("_null"), "_salt", "mined_rule", "mined_confidence")
    rule, verdict = fixed(rules)
    out = salted.join(hits, ["_at", "_null", "_salt"], "left").withColumns({"rule": rule, "_said": verdict})
    return out.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule", "mined_confidence")
