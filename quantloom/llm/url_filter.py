"""URL filters by association rules.

URLs become sets of tokens (scheme, host labels with their place, path words, file ending, query keys). FP-growth mines
which combinations of tokens go with a bad and which with a good label. Rules are pruned by confidence, support and lift (their
confidence as a multiple of the label's share of all labelled pages, so a rule has to say more than no rule does), and where a
rule of fewer tokens says as much. They are kept in an inverted index under their rarest token, found by a join on the tokens of
a URL and checked in full; of those that fit, the one of most lift decides. Explicit allow and block rules on host and path come
first, the longest that fits.

Defined results: a null url, or one without ``://``, has empty host and path and only its method verdict, allow where no
mined rule fits; repeated rows all stay; an empty table gives no rows; without labels there are no mined rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from quantloom.llm.common import attach, checkpoint, lower_az, read

#: verdict, host, path
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT = 0.01, 20, 0.75, 1.05
LABELS = {"label:bad": "block", "label:good": "allow"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substr(rest, F.char_length(host) + 1)
    return lower_az(host), F.regexp_extract(tail, r"^[^?#]*", 0)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The set of a URL's tokens: host labels count from the top level; digits in path words are folded together."""
    u = F.coalesce(url, F.lit(""))
    labels = F.reverse(F.split(host, r"\."))
    hosts = F.transform(F.filter(labels, lambda x: x != ""), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    words = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), r"[/._\-]+"), lambda x: x != "")
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(u, r"\?([^#]*)", 1), F.lit(r"([^&=]+)=?[^&]*"), 1), lambda x: F.concat(F.lit("q:"), x))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)))
    return F.array_distinct(F.concat(scheme, hosts, F.transform(words, lambda x: F.concat(F.lit("p:"), x)), keys))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules mined from rows (tokens, bad): anchor (rarest token), antecedent, verdict, confidence, support, lift. A rule's tokens
    and label hold in at least min_support of the labelled rows and in min_count of them."""
    bad, good = LABELS
    items = labelled.select(F.array_append("tokens", F.when(F.col("bad"), bad).otherwise(good)).alias("items"))
    items = checkpoint(items)
    n = items.count()
    empty = "anchor string, antecedent array<string>, verdict string, confidence double, support double, lift double"
    if n < min_count:
        return labelled.sparkSession.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min_confidence).fit(items)
    of = F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.col("consequent")[0])
    found = model.associationRules.filter(F.col("consequent")[0].isin(*LABELS) & (F.col("lift") >= min_lift))
    found = checkpoint(found.select(F.array_sort("antecedent").alias("antecedent"), of.alias("verdict"), "confidence", "support", "lift"))
    fewer = F.explode(F.transform("antecedent", lambda x: F.array_except("antecedent", F.array(x)))).alias("fewer")
    wider = found.select(F.col("antecedent").alias("fewer"), "verdict", F.col("lift").alias("wider_lift"))
    told = found.select("antecedent", "verdict", "lift", fewer).join(wider, ["fewer", "verdict"]).filter("wider_lift >= lift")
    rules = found.join(told.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    anchor = rules.select("antecedent", F.explode("antecedent").alias("token")).join(single, "token")
    anchor = anchor.groupBy("antecedent").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    return rules.join(anchor, "antecedent").select("anchor", "antecedent", "verdict", "confidence", "support", "lift")


def explicit(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(n, rule, verdict) of the longest rule that fits, else null."""
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return F.greatest(none, none, *fits)


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, mined_confidence of every page."""
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    p = p.withColumn("fit", explicit(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url")
    p = checkpoint(p)
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg((F.max(F.coalesce(F.col("quality"), F.lit(1))) == 0).alias("bad"))
    mined = checkpoint(mine(p.join(bad, "page_id"), **how))
    # URLs are judged once per set of tokens; many pages share one
    sets = checkpoint(p.groupBy("tokens").agg(F.count("*").alias("n")))
    hits = (
        sets.select("tokens", F.explode("tokens").alias("anchor")).join(mined, "anchor")
        .filter(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("tokens").agg(F.max(F.struct("lift", "support", "antecedent", "verdict", "confidence")).alias("best"))
    )
    out = attach(p, checkpoint(sets.join(hits, "tokens", "left")), "tokens", "n")
    method = F.coalesce("best.verdict", F.lit("allow"))
    return out.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"),
        F.col("best.antecedent").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"),
    )


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")).select(
        "page_id", "host", "path", "rule", "verdict", F.array_join("mined_rule", " ").alias("mined_rule"), "mined_confidence"
    )
