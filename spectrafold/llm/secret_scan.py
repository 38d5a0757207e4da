"""Secret scan: candidate credentials by pattern, then corpus-wide ownership of each value. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, text_of, written

#: Kind, pattern, least length of what is measured, and the group that holds the value.
#: Runs of hex digits and of key characters below their least length can't match, as such a run is matched whole or not at all.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]{12,}", 16, 0),
    ("hex", r"[0-9a-f]{32,}", 32, 0),
)

#: Characters on each side of a match that tell a use of a value from a copy of that use.
NEAR = 40
#: A value that more repositories than this hold is no one's live credential.
MAX_REPOS = 16


def _near(pieces: Column, matches: Column) -> Column:
    """A hash for each match of what stands around it, no further than the matches next to it."""
    none = F.lit("")
    at = lambda c, i: F.coalesce(F.get(c, i), none)
    before = lambda i: F.right(F.concat(at(matches, i - 1), at(pieces, i)), F.lit(NEAR))
    after = lambda i: F.left(F.concat(at(pieces, i + 1), at(matches, i + 1)), F.lit(NEAR))
    return F.transform(matches, lambda _, i: F.xxhash64(before(i), after(i)))


def _found(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """Each row's matches and the lengths of what lies between them, with a row key; no text is kept."""
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), text_of(text_col).alias("_text"))
    for kind, pattern, _, _ in KINDS:
        rows = rows.withColumn(f"m_{kind}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = [F.when(F.size(f"m_{kind}") > 0, F.transform(F.split(text, pattern, -1), F.length)).alias(f"g_{kind}") for kind, pattern, _, _ in KINDS]
    near = [F.when(F.size(f"m_{kind}") > 0, _near(F.split(text, pattern, -1), F.col(f"m_{kind}"))).alias(f"a_{kind}") for kind, pattern, _, _ in KINDS]
    kept = rows.select("doc_id", "owner", "repo", *(f"m_{k[0]}" for k in KINDS), *gaps, *near)
    return written(kept.withColumn("row", F.monotonically_increasing_id()), "found")


def _candidates(found: DataFrame) -> DataFrame:
    """(row, owner, repo, kind, start, end, value, value_start, near): matches that are long enough, in code points."""
    out = None
    for order, (kind, pattern, least, group) in enumerate(KINDS):
        each = found.where(F.size(f"m_{kind}") > 0).select("row", "owner", "repo", F.posexplode(F.arrays_zip(F.col(f"g_{kind}").alias("gap"), F.col(f"m_{kind}").alias("match"), F.col(f"a_{kind}").alias("near")))).where("col.match is not null")
        each = each.select("row", "owner", "repo", "pos", F.col("col.gap").alias("gap"), F.col("col.match").alias("match"), F.col("col.near").alias("near"))
        so_far = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("row").orderBy("pos"))
        value = F.regexp_extract("match", pattern, group) if group else F.col("match")
        each = each.withColumn("end", so_far.cast("long")).withColumn("value", value).where(F.length("value") >= least)
        each = each.select("row", "owner", "repo", F.lit(order).alias("order"), F.lit(kind).alias("kind"), (F.col("end") - F.length("match")).alias("start"), "end", "value", (F.col("end") - F.length("value")).alias("value_start"), "near")
        out = each if out is None else out.unionByName(each)
    return out


def looks_random(value: Column) -> Column:
    """Letters and digits both, and at least eight different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def _independent(uses: DataFrame, max_owners: int) -> DataFrame:
    """(digest) of the values whose uses no max_owners owners account for.

    A use is a value with what stands around it, whoever holds it: copies of a document are one use. Owners are taken one by
    one, first those that alone hold a use, then the one that holds most of what is left, until all uses are held by one
    that was taken. More copies never make more owners necessary. Only where each use left is held by several can that take
    one more than the fewest.
    """
    sole = uses.groupBy("digest", "near").agg(F.min("owner").alias("owner"), F.max("owner").alias("last")).where("owner = last")
    alone = sole.groupBy("digest", "owner").agg(F.lit(1)).groupBy("digest").agg(F.count("*").alias("alone"))
    held = uses.groupBy("digest", "owner").agg(F.lit(1)).groupBy("digest").agg(F.count("*").alias("owners")).where(F.col("owners") > max_owners)
    held = written(held.join(alone, "digest", "left").select("digest", (F.coalesce("alone", F.lit(0)) > max_owners).alias("sure")), "widely_held")
    left = written(uses.join(held.where("not sure"), "digest", "left_semi"), "uses")
    for _ in range(max_owners):
        ends = left.groupBy("digest", "near").agg((F.min("owner") == F.max("owner")).alias("sole"))
        each = left.join(ends, ["digest", "near"]).groupBy("digest", "owner").agg(F.max("sole").alias("sole"), F.count("*").alias("uses"))
        taken = each.groupBy("digest").agg(F.max_by("owner", F.struct("sole", "uses", "owner")).alias("owner"))
        gone = left.join(taken, ["digest", "owner"], "left_semi").select("digest", "near")
        left = written(left.join(gone, ["digest", "near"], "left_anti"), "uses")
    return held.where("sure").select("digest").unionByName(left.select("digest").distinct())


def ownership(candidates: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """(digest, owners, repos, verdict) for each value.

    'example': its uses need more than max_owners owners once copies count as one, or more than max_repos repositories
    hold it in as many different surroundings, as a value that stands all over one owner's repositories is boilerplate,
    too. Else 'live' or 'weak' by its looks. Distinct owners, repositories and uses are counted in two steps, so a value
    that is copied everywhere is combined before each shuffle.
    """
    owned = candidates.groupBy("digest", "owner").agg(F.max("random").alias("random"))
    owners = owned.groupBy("digest").agg(F.count("*").alias("owners"), F.max("random").alias("random"))
    repos = candidates.groupBy("digest", "repo").agg(F.lit(1)).groupBy("digest").agg(F.count("*").alias("repos"))
    # A null owner is one, too, and sorts before all.
    named = F.coalesce(F.concat(F.lit("="), F.col("owner")), F.lit("")).alias("owner")
    uses = candidates.select("digest", "near", named).distinct()
    examples = _independent(uses, max_owners).withColumn("example", F.lit(True))
    places = uses.groupBy("digest", "near").agg(F.lit(1)).groupBy("digest").agg(F.count("*").alias("places"))
    repos = repos.join(places, "digest")
    everywhere = F.least("repos", "places") > max_repos
    verdict = F.when(F.col("example") | everywhere, "example").when(F.col("random"), "live").otherwise("weak")
    return owners.join(repos, "digest").join(examples, "digest", "left").select("digest", "owners", "repos", verdict.alias("verdict"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = 2, max_repos: int = MAX_REPOS) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the rows of the input (row, doc_id) and all candidate spans with their verdicts.

    Null text counts as empty; null owners and repositories are one owner, one repository. Equal rows stay separate. Spans
    have (row, kind, order, start, end, value, value_start, owners, repos, verdict); the end is exclusive, all in code points.
    """
    found = _found(docs, id_col, text_col, owner_col, repo_col)
    cands = _candidates(found).withColumn("digest", F.sha2("value", 256)).withColumn("random", looks_random(F.col("value")))
    cands = written(cands, "candidates")
    spans = cands.join(ownership(cands, max_owners, max_repos), "digest")
    return found.select("row", "doc_id"), spans


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row for each input row: counts of each kind, digest of the base spans, and all spans.

    The method adds a span live:start:end over each value that belongs to few owners and looks random; those of examples
    that many use stay with their base span alone. n_live and n_example count the two.
    """
    rows, spans = scan(docs, **options)
    base = F.struct("start", "order", "end", "kind")
    live = F.when(F.col("verdict") == "live", F.struct(F.col("value_start").alias("start"), F.lit(len(KINDS)).alias("order"), F.col("end"), F.lit("live").alias("kind")))
    per = spans.groupBy("row").agg(
        *(F.count_if(F.col("kind") == k[0]).alias(f"n_{k[0]}") for k in KINDS),
        F.collect_list(base).alias("base"), F.collect_list(live).alias("live"),
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "example").alias("n_example"),
    )
    per = per.select("*", _listed(F.col("base")).alias("base_text"), _listed(F.array_union("base", "live")).alias("spans"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    blank = F.coalesce("base_text", F.lit(""))
    return rows.join(per, "row", "left").select("doc_id", *(zero(f"n_{k[0]}") for k in KINDS), F.sha2(blank, 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"))


def redact(docs: DataFrame, *, mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with each live value in their text replaced by the mark; every other column and row as it was.

    A document is found again by its id and a hash of its text. n_chars, where there is such a column, follows the text.
    """
    row_key, row_values = free(docs, "_row_key"), free(docs, "_row_values")
    key = F.xxhash64(F.col("doc_id"), F.length(text_of()), text_of())
    keyed = docs.withColumn(row_key, key)
    rows, spans = scan(keyed, repo_col=row_key, **options)
    values = spans.where("verdict = 'live'").groupBy(F.col("repo").cast("long").alias(row_key)).agg(F.array_sort(F.collect_set("value")).alias(row_values))
    found = keyed.join(values, row_key, "left")
    longest_first = F.expr(f"array_sort({row_values}, (a, b) -> length(b) - length(a))")
    text = F.when(F.col(row_values).isNull(), F.col("text")).otherwise(F.aggregate(longest_first, F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark))))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(row_values).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
