"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Candidates are found by patterns. Their values, as hashes, are counted over the corpus by distinct owners and distinct
repositories: a value that more than two owners hold is a copied example, one that is held by fewer is taken for a live
credential, in however many repositories they hold it, unless it has too few different characters for its kind. Repositories are reported with every
span but do not decide: a key that its owner uses in thousands of texts is leaked as much as one in a single text, and any number
that set a bound would be passed by growth alone. Besides the base kinds, long tokens of mixed character classes are candidates too; they
become spans (kind ``owned``) only if ownership shows them as live and no base span overlaps them.

A match's place follows from the lengths of the text between matches, by a running sum within the document. Only rows
for candidates are shuffled. A value that a third of all documents hold is counted by owner and repository first, with
map-side combination, and its join back is left to skew handling.

Cases: a null text is empty; null owners and repositories count as one of their own; repeated rows are one document to the
counts and get the same result each, and count for every owner they stand under; overlapping spans of different base kinds all stay; a text of any length is
read whole, one row with all its matches; an empty table gives an empty one; ``redact`` carries other columns along, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ebbmark.session import stored


@dataclass(frozen=True)
class Kind:
    """``group``: the part of a match that is the credential, of at least ``least`` characters, of which ``varied`` must be
    different in a live one. ``hint`` matches every text that has a match."""

    name: str
    pattern: str
    group: int
    least: int
    hint: str
    varied: int
    base: bool = True


#: Patterns of the base kinds are fixed values. A run of at least n characters is written as such where that gives the
#: same matches as a run of any length whose short matches are dropped.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         r"(?i:password|passwd|secret|token|api_?key)", 2),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA", 8),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}", 8),
    Kind("owned", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", 0, 20, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}", 8, base=False),
)


@dataclass(frozen=True)
class Settings:
    """A value is live if at most ``owners`` owners hold it and it has at least as many different characters as its kind asks."""

    owners: int = 2


KEY = ("doc_id", "text_hash")


def _matches(text: Column, kind: Kind, number: int) -> Column:
    """Of one text: an array of (length of the gap before, length of the match, value)."""
    pattern = F.lit(kind.pattern)
    gaps = F.transform(F.split(text, kind.pattern, -1), F.char_length)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else found
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), F.transform(found, F.char_length).alias("size"), values.alias("value")),
        lambda m: F.struct(F.lit(number).alias("kind"), m["gap"].alias("gap"), m["size"].alias("size"), m["value"].alias("value")))
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,value:string>>")
    return F.when(text.rlike(kind.hint), rows).otherwise(none)


def matches(df: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source",
               repository: str = "doc_id") -> DataFrame:
    """One row per match of a pattern: ``doc_id, text_hash, owner, repository, at, kind, gap, size, base, value_hash, varied`` and whether it is ``taken``
    for a candidate. Rows of equal id and text under several owners give a match each."""
    rows = df.select(df[id].alias("doc_id"), F.xxhash64(df[text].cast("string")).alias("text_hash"),
                     df[owner].cast("string").alias("owner"), df[repository].cast("string").alias("repository"),
                     F.coalesce(df[text].cast("string"), F.lit("")).alias("text"))
    parts = [rows.select(*KEY, "owner", "repository", F.posexplode(_matches(F.col("text"), k, i)).alias("at", "m"))
             for i, k in enumerate(KINDS)]
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    value = F.col("m.value")
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("m.kind") + 1)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")
    base = F.element_at(F.array(*[F.lit(k.base) for k in KINDS]), F.col("m.kind") + 1)
    return found.where("m.size IS NOT NULL").select(
        *KEY, "owner", "repository", "at", "m.kind", "m.gap", "m.size", base.alias("base"), F.sha2(value.cast("binary"), 256).alias("value_hash"),
        F.size(F.array_distinct(F.split(value, ""))).alias("varied"), ((F.char_length(value) >= least) & (base | mixed)).alias("taken"))


def placed(matches: DataFrame) -> DataFrame:
    """``start`` and ``end`` of the matches that are candidates, once for rows of equal id and text."""
    order = Window.partitionBy(*KEY, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return matches.drop("owner", "repository").dropDuplicates([*KEY, "kind", "at"]) \
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)) \
        .withColumn("start", F.col("end") - F.col("size")).where("taken")


def ownership(matches: DataFrame) -> DataFrame:
    """``value_hash, owners, repositories``: in how many distinct ones each value occurs, over all rows."""
    one = matches.where("taken").select("value_hash", F.coalesce("owner", F.lit("")).alias("owner"),
                                        F.coalesce("repository", F.lit("")).alias("repository"))
    return one.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one")) \
        .groupBy("value_hash", "owner").agg(F.count("*").alias("held")) \
        .groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("held").alias("repositories"))


def spans(df: DataFrame, settings: Settings = Settings(), **columns: str) -> DataFrame:
    """The spans of every document that has one: ``doc_id, text_hash, kind`` (number), ``base, start, end, owners, repositories, live``."""
    found = stored(matches(df, **columns), "secret-candidates")
    judged = placed(found).join(ownership(found), "value_hash").select(
        *KEY, "kind", "base", "start", "end", "owners", "repositories",
        ((F.col("owners") <= settings.owners)
         & (F.col("varied") >= F.element_at(F.array(*[F.lit(k.varied) for k in KINDS]), F.col("kind") + 1))).alias("live"))
    order = Window.partitionBy(*KEY).orderBy("start", "kind")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    covered = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    return judged.withColumn("covered", covered).where("base OR (live AND NOT covered)").drop("covered")


def _label(x: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))


def scan(df: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text", owner: str = "source",
         repository: str = "doc_id") -> DataFrame:
    """For each row: ``doc_id, text_hash`` and ``found``, its spans by start and kind."""
    per = spans(df, settings, id=id, text=text, owner=owner, repository=repository).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base", "live", "owners", "repositories"))).alias("found"))
    rows = df.select(df[id].alias("doc_id"), F.xxhash64(df[text].cast("string")).alias("text_hash"))
    none = F.array().cast(per.schema["found"].dataType)
    return rows.alias("r").join(per.alias("p"), F.expr("r.doc_id <=> p.doc_id AND r.text_hash = p.text_hash"), "left") \
        .select("r.doc_id", "r.text_hash", F.coalesce("found", none).alias("found"))


def labels(found: Column) -> Column:
    return F.array_join(F.transform(found, _label), ",")


def redact(df: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text", owner: str = "source",
           repository: str = "doc_id", mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``df``, with every live span of the text replaced by ``mask``."""
    live = spans(df, settings, id=id, text=text, owner=owner, repository=repository).where("live")
    order = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.max("end").over(order) < F.col("start"), F.lit(True))
    joined = live.withColumn("fresh", fresh).withColumn(  # overlapping or touching spans become one
        "run", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = joined.groupBy(*KEY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")) \
        .groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")) \
        .select(*KEY, "cuts")
    rows = df.select(F.struct("*").alias("row"), df[id].alias("doc_id"), F.xxhash64(df[text].cast("string")).alias("text_hash"))
    whole, cuts = F.col(f"row.`{text}`").cast("string"), F.col("cuts")
    piece = lambda i: F.substring(
        whole, F.coalesce(F.try_element_at(cuts, i)["end"], F.lit(0)).cast("int") + 1,
        (F.coalesce(F.try_element_at(cuts, i + 1)["start"], F.char_length(whole))
         - F.coalesce(F.try_element_at(cuts, i)["end"], F.lit(0))).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.when(i == 0, F.substring(
        whole, F.lit(1), F.element_at(cuts, 1)["start"].cast("int"))).otherwise(piece(F.greatest(i, F.lit(1)))))
    clean = F.when(cuts.isNull(), whole).otherwise(F.array_join(pieces, mask))
    return rows.alias("r").join(runs.alias("c"), F.expr("r.doc_id <=> c.doc_id AND r.text_hash = c.text_hash"), "left") \
        .withColumn("row", F.col("row").withField(f"`{text}`", clean)).select("row.*")
