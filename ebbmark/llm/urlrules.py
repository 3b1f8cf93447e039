"""URL filters: explicit host and path rules, and rules mined by FP-growth. DataFrame functions only.

An explicit rule fits its host and all subdomains if the path starts with the rule's; the longest wins. Where none
fits, association rules decide: URL tokens (host labels, path words, extension, query keys) of labelled pages are mined for
token combinations that imply ``allow`` or ``block``; rules below the least support or confidence are pruned, and so are rules
that a shorter one with as much confidence covers. A URL is matched through an inverted index: every rule is listed under its
rarest token, so a URL meets only rules that its own tokens list, and each is then checked in full. The rule with the most
confidence, then support, then tokens wins; without any, the default verdict stands.

Labels: URLs that an explicit rule fits are labelled by it; callers may add labelled URLs. The least support is a share of the
labelled URLs, and combinations are mined among all tokens of a URL that have it. Tokens that always occur together are mined as one and
put back into the rules, which gives the same rules, as a rule with two of them is superfluous. Equal token sets are judged once, over all their tokens. The index is joined like any table: it is sent to the workers only while the optimizer sees that it is small.

Cases: a null URL, or one without ``://``, has an empty host and path and no tokens, and gets the default verdict; ties
between rules of equal length go to the first by text (they are the same rule) and between mined ones to ``block``; repeated
rows get the same result each; without labels of both kinds no rule is mined; an empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from ebbmark.llm.decontam import lower_ascii
from ebbmark.session import stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: The explicit rules of the contract.
RULES = (Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


@dataclass(frozen=True)
class Settings:
    support: float = 0.005
    confidence: float = 0.9
    default: str = "allow"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct ``rule, verdict``, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens, marked by where they stand; digits in paths count as one token."""
    h, p = host(url), lower_ascii(path(url))
    parts = F.transform(F.split(h, r"\."), lambda x: F.concat(F.lit("host:"), x))
    words = F.transform(F.regexp_extract_all(p, F.lit(r"[^/.\-_]+"), F.lit(0)),
                        lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract_all(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    asked = F.transform(query, lambda x: F.concat(F.lit("query:"), x))
    found = F.array_distinct(F.concat(parts, words, asked))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_sort(found))


def _alike(known: DataFrame, least: float) -> DataFrame:
    """``name, tokens``: tokens in at least ``least`` rows, those in exactly the same rows together."""
    rows = known.groupBy("items", "verdict").agg(F.count("*").alias("n")).select(
        "n", F.xxhash64("items", "verdict").alias("row"), F.xxhash64("verdict", "items").alias("again"), F.explode("items").alias("token"))
    return rows.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("row").alias("row"), F.bit_xor("again").alias("again")) \
        .where(F.col("n") >= least).groupBy("n", "row", "again").agg(F.min("token").alias("name"), F.collect_list("token").alias("tokens"))


def _longer(made: Column, tokens: Column) -> Column:
    """Each array of ``made`` with each of ``tokens`` at its end."""
    return F.flatten(F.transform(made, lambda x: F.transform(tokens, lambda t: F.array_append(x, t))))


def mine(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rule_id, items, verdict, confidence, support`` from ``items`` (tokens) and ``verdict``."""
    known = stored(labelled.where("size(items) > 0 AND verdict IN ('allow', 'block')").select("items", "verdict"), "url-baskets")
    empty = labelled.sparkSession.createDataFrame(
        [], "rule_id long, items array<string>, verdict string, confidence double, support double")
    if known.select("verdict").distinct().count() < 2:
        return empty
    total = known.count()
    alike = stored(_alike(known, total * settings.support), "url-tokens")
    names = alike.agg(F.collect_list("name").alias("names"))
    baskets = stored(known.crossJoin(names).select(F.concat(
        F.array(F.concat(F.lit("verdict:"), "verdict")), F.array_intersect("items", "names")).alias("items")), "url-frequent")
    model = FPGrowth(itemsCol="items", minSupport=settings.support, minConfidence=settings.confidence).fit(baskets)
    # Association rules with a verdict on their right side, from the frequent sets that hold one.
    sets = stored(model.freqItemsets, "url-itemsets")
    named = sets.select(F.filter("items", lambda x: ~x.startswith("verdict:")).alias("left"),
                        F.try_element_at(F.filter("items", lambda x: x.startswith("verdict:")), F.lit(1)).alias("right"), "freq")
    whole = named.where("right IS NULL").select(F.array_sort("left").alias("items"), F.col("freq").alias("seen"))
    rules = named.where("right IS NOT NULL AND size(left) > 0").select(F.array_sort("left").alias("items"), "right", "freq") \
        .join(whole, "items").select(
            "items", F.substring_index("right", ":", -1).alias("verdict"), (F.col("freq") / F.col("seen")).alias("confidence"),
            (F.col("freq") / F.lit(float(total))).alias("support")).where(F.col("confidence") >= settings.confidence)
    # A rule is superfluous if leaving out one token gives another rule of as much confidence.
    shorter = rules.select("items", "verdict", F.col("confidence").alias("short"))
    smaller = rules.where("size(items) > 1").select(
        "items", "verdict", "confidence", F.explode("items").alias("out")).select(
        F.col("items").alias("full"), "verdict", "confidence", F.array_remove("items", F.col("out")).alias("items"))
    covered = smaller.join(shorter, ["items", "verdict"]).where("short >= confidence").select(
        F.col("full").alias("items"), "verdict").distinct()
    short = rules.join(covered, ["items", "verdict"], "left_anti").select("*", F.posexplode("items").alias("at", "name"))
    others = alike.select("name", "tokens")
    each = short.join(others, "name").groupBy("items", "verdict", "confidence", "support").agg(
        F.collect_list("tokens").alias("tokens"))
    whole = each.select("verdict", "confidence", "support", F.explode(F.aggregate("tokens", F.array(
        F.array().cast("array<string>")), _longer)).alias("items")).select(F.array_sort("items").alias("items"), "verdict", "confidence", "support")
    return stored(whole.select(
        F.xxhash64(F.array_join("items", "\n"), "verdict").alias("rule_id"), "items", "verdict", "confidence", "support"), "url-rules")


def index(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """Every rule under its rarest token."""
    listed = rules.select("*", F.explode("items").alias("token")).join(frequency, "token", "left")
    rarest = listed.groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return stored(rules.join(rarest, "rule_id"), "url-index")


def judge(pages: DataFrame, id: str = "page_id", url: str = "url", rules: Sequence[Rule] = RULES,
          labelled: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """For each row: ``page_id, host, path, rule`` (explicit, or null), ``verdict``, ``confidence`` of the mined rule, if one
    decided. ``labelled``: further pairs ``url, verdict`` to learn from."""
    u = pages[url].cast("string")
    rows = pages.select(pages[id].alias("page_id"), host(u).alias("host"), path(u).alias("path"), tokens(u).alias("items")) \
        .withColumn("explicit", best_rule(F.col("host"), F.col("path"), rules))
    known = rows.where("explicit IS NOT NULL").select("items", F.col("explicit.verdict").alias("verdict"))
    if labelled is not None:
        known = known.union(labelled.select(tokens(labelled["url"].cast("string")), "verdict"))
    mined = mine(known, settings)
    open_sets = stored(rows.where("explicit IS NULL AND size(items) > 0").select("items").distinct(), "url-token-sets")
    listed = open_sets.select("items", F.explode("items").alias("token"))
    found = index(mined, listed.groupBy("token").agg(F.count("*").alias("n")))
    met = listed.join(found.select("token", F.col("items").alias("needs"), F.col("verdict").alias("says"), "confidence", "support"), "token") \
        .where(F.size(F.array_intersect("items", "needs")) == F.size("needs"))
    best = met.groupBy("items").agg(F.max(F.struct(
        "confidence", "support", F.size("needs").alias("size"), "says")).alias("best"))
    return rows.join(best, "items", "left").select(
        "page_id", "host", "path", F.col("explicit.rule").alias("rule"),
        F.coalesce("explicit.verdict", "best.says", F.lit(settings.default)).alias("verdict"),
        F.when(F.col("explicit").isNull(), F.col("best.confidence")).alias("confidence"))
