"""Distances between samples from counts, without ever building samples x vocabulary.

Counts may be compressed (counts.compressed): a row then stands for `many` features with one vector of counts.

Every sum over the vocabulary is split into what a feature that a sample lacks contributes, which has a closed form, and
what its own features add to that. Pairs of samples then meet in the features that both have, block by block (blocks.py).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import formulas
from . import checks, vectors
from .blocks import Fields, grid_sums, pair_sums, product_sums
from .counts import by_document_frequency, feature_stats, many, overall, presence, profiles, sample_stats

#: Configurations of a grid that one task adds up together: a table of pairs of samples for each.
GRID = 8


def _one(row: DataFrame) -> DataFrame:
    return F.broadcast(row)


def every_pair(samples: DataFrame, fields: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs i < j of the samples (of one `by`) with their fields: the output of a distance has a row for each."""
    left = samples.select(*by, F.col("sample").alias("i"), *(F.col(f).alias(f"{f}_i") for f in fields))
    right = samples.select(*by, F.col("sample").alias("j"), *(F.col(f).alias(f"{f}_j") for f in fields))
    return left.join(right, list(by)).where("i < j") if by else left.join(right, F.col("i") < F.col("j"))


def weights(counts: DataFrame, kind: str = "one", beta: float | None = None, cap: float | None = None, scale: bool = False) -> DataFrame:
    """(feature, w, many): 1, or -ln G, 1 / G or 1 / sqrt(G) of the smoothed global probability G, capped or scaled to at most 1."""
    per = feature_stats(counts)
    if kind == "one":
        return per.select("feature", F.lit(1.0).alias("w"), "many")
    every = per.agg(F.sum(F.col("c") * F.col("many")).alias("total"), F.sum("many").alias("vocabulary"))
    g = checks.positive(formulas.smoothed(F.col("c"), F.col("total"), beta or 0.0, F.col("vocabulary")), "a feature's global probability is not above 0")
    out = per.crossJoin(_one(every)).select("feature", formulas.weight(g, kind).alias("w"), "many")
    if cap is not None:
        out = out.withColumn("w", F.least("w", F.lit(float(cap))))
    if scale:
        out = out.crossJoin(_one(out.agg(F.max("w").alias("_most")))).select("feature", (F.col("w") / F.col("_most")).alias("w"), "many")
    return out


def _own_sums(given: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, sample, a, wd, we, wde): sums over each sample's own features."""
    w, d, e = F.col("w"), F.col("d"), F.col("e")
    return given.groupBy(*by, "sample").agg(F.first("a").alias("a"), F.sum(w * d).alias("wd"), F.sum(w * e).alias("we"), F.sum(w * d * e).alias("wde"))


def _kl_parts(values: DataFrame, samples: DataFrame, every: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Directed divergences (*by, sample_i, sample_j, d) from values (*by, feature, sample, p, w), samples (*by, sample, a), every (*by, W).

    a is the probability of a feature that the sample lacks, W the sum of all weights. With d = p - a and e = ln p - ln a,
    sum w p_i ln p_j = a_i ln a_j W + a_i sum(w e_j) + ln a_j sum(w d_i) + sum over shared features of w d_i e_j.
    """
    given = values.join(samples, [*by, "sample"]).withColumn("d", F.col("p") - F.col("a")).withColumn("e", F.log("p") - F.log("a"))
    own = _own_sums(given, by)
    pairs = every_pair(own, ["a", "wd", "we", "wde"], by)
    pairs = pairs.join(_one(every), list(by)) if by else pairs.crossJoin(_one(every))
    meet = product_sums(given.select(*by, "feature", "sample", (F.col("w") * F.col("d")).alias("wd"), "e"), samples, "wd", "e", by)
    return _kl_joined(pairs, meet, by)


def _kl_both(pairs: DataFrame, meet: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, i, j, forward, back): the divergences of i from j and of j from i, from each sample's own sums, in pairs, and the sums over what both share."""
    joined = pairs.join(meet, [*by, "i", "j"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("ij", "ji")})

    def cross(x: str, y: str, both: str) -> Column:
        ax, ly = F.col(f"a_{x}"), F.log(f"a_{y}")
        return ax * ly * F.col("W") + ax * F.col(f"we_{y}") + ly * F.col(f"wd_{x}") + F.col(both)

    forward = cross("i", "i", "wde_i") - cross("i", "j", "ij")
    back = cross("j", "j", "wde_j") - cross("j", "i", "ji")
    return joined.select(*by, "i", "j", forward.alias("forward"), back.alias("back"))


def _kl_joined(pairs: DataFrame, meet: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, sample_i, sample_j, d): the same with a row for each direction."""
    two = F.explode(F.array(F.struct(F.col("i").alias("sample_i"), F.col("j").alias("sample_j"), F.col("forward").alias("d")), F.struct(F.col("j").alias("sample_i"), F.col("i").alias("sample_j"), F.col("back").alias("d"))))
    return _kl_both(pairs, meet, by).select(*by, two.alias("p")).select(*by, "p.*")


def kl_directed(counts: DataFrame, alpha: float = 1.0, weight: DataFrame | None = None) -> DataFrame:
    """(sample_i, sample_j, d) for all ordered pairs: sum of w p ln(p / q) over the whole vocabulary, smoothed by alpha > 0.

    weight: (feature, w, many) as weights() gives it.
    """
    if alpha <= 0:
        raise ValueError("alpha must be positive: absent features have no logarithm")
    weight = weights(counts) if weight is None else weight
    every = weight.agg(F.sum("many").alias("vocabulary"), F.sum(F.col("w") * F.col("many")).alias("W"))
    totals = sample_stats(counts).select("sample", "total").crossJoin(_one(every.select("vocabulary")))
    samples = totals.select("sample", "total", "vocabulary", formulas.smoothed(F.lit(0), F.col("total"), alpha, F.col("vocabulary")).alias("a"))
    p = checks.positive(formulas.smoothed(F.col("c"), F.col("total"), alpha, F.col("vocabulary")), "a sample's probability is not above 0")
    weight = weight.select("feature", (F.col("w") * F.col("many")).alias("w"))
    values = counts.select("sample", "feature", "c").join(samples, "sample").withColumn("p", p).join(weight, "feature").select("feature", "sample", "p", "w")
    return _kl_parts(values, samples.select("sample", "a"), every.select("W"))


def kl_grid(counts: DataFrame, grid: list[tuple[int, float, float | None]], kind: str = "one", cap: float | None = None, scale: bool = False, clip: str = "symmetric") -> DataFrame:
    """(g, sample_i, sample_j, d) for i < j: kl_symmetric for each (g, alpha, beta) of a grid."""
    vectors = profiles(counts).withColumn("k", F.lit(0))
    return kl_grid_by_k(vectors, [(g, 0, alpha, beta) for g, alpha, beta in grid], kind, cap, scale, clip)


def kl_grid_by_k(vectors: DataFrame, grid: list[tuple[int, int, float, float | None]], kind: str = "one", cap: float | None = None, scale: bool = False, clip: str = "symmetric") -> DataFrame:
    """(g, sample_i, sample_j, d) for i < j: kl_symmetric for each (g, k, alpha, beta) of a grid, of the vectors (k, profile, many) of that k.

    A vector holds all counts of its features, so their weights, an array for all betas, are made in its row. The entries get
    what is a row a sample by broadcast (the result has a row a pair), and are dealt to cells once for GRID configurations
    of each k; alpha and beta take effect within a task. All k are one plan.
    """
    betas = sorted({b or 0.0 for _, _, _, b in grid})
    number = "long" if isinstance(vectors.schema["profile"].dataType.elementType["c"].dataType, IntegralType) else "double"
    features = vectors.where(F.col("k").isin([k for _, k, _, _ in grid])).withColumn("c", F.aggregate("profile", F.lit(0).cast(number), lambda s, p: s + p["c"].cast(number)))
    every = features.groupBy("k").agg(F.sum(F.col("c") * F.col("many")).alias("total"), F.sum("many").alias("vocabulary"))
    of = lambda b: formulas.weight(formulas.smoothed(F.col("c"), F.col("total"), b, F.col("vocabulary")), kind)
    capped = lambda b: F.least(of(b), F.lit(float(cap))) if kind != "one" and cap is not None else of(b)
    names = [f"w{i}" for i in range(len(betas))]
    weight = features.join(_one(every), "k").select("k", "profile", "many", F.col("vocabulary").cast("double").alias("v"), *(capped(b).alias(n) for n, b in zip(names, betas, strict=True)))
    if kind != "one" and scale:
        most = weight.groupBy("k").agg(*(F.max(n).alias(f"most{n}") for n in names))
        weight = weight.join(_one(most), "k").select("k", "profile", "many", "v", *((F.col(n) / F.col(f"most{n}")).alias(n) for n in names))
    weight = weight.select("k", F.xxhash64("profile").cast("string").alias("feature"), "profile", "many", "v", F.array(*(F.col(n) * F.col("many") for n in names)).alias("ws"))
    sums = weight.groupBy("k").agg(F.array(*(F.sum(F.col("ws")[i]) for i in range(len(betas)))).alias("sums"))
    entries = weight.select("k", "feature", "many", "v", "ws", F.explode("profile").alias("p")).select("k", "feature", "many", "v", "ws", "p.sample", "p.c")
    totals = entries.groupBy("k", "sample").agg(F.sum(F.col("c") * F.col("many")).cast("double").alias("total"))
    values = entries.join(_one(totals), ["k", "sample"]).select("k", "feature", "sample", F.col("c").cast("double").alias("c"), "total", "v", "ws")
    passes: dict[int, list[tuple]] = {}
    for at, (g, k, alpha, beta) in enumerate(grid):
        before = sum(other[1] == k for other in grid[:at])
        passes.setdefault(before // GRID, []).append((g, k, float(alpha), betas.index(beta or 0.0)))
    out = None
    for part in passes.values():
        here = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(k).alias("k"), F.lit(alpha).alias("alpha"), F.lit(b).alias("b")) for g, k, alpha, b in part))
        own_of = lambda here=here: F.explode(F.filter(here, lambda x: x["k"] == F.col("k"))).alias("x")
        each = values.select("k", "sample", "c", "total", "v", "ws", own_of()).select("k", "x.g", "sample", "c", "total", "v", F.get("ws", F.col("x.b")).alias("w"), "x.alpha")
        p = lambda c: formulas.smoothed(c, F.col("total"), F.col("alpha"), F.col("v"))
        each = each.withColumn("a", p(F.lit(0))).withColumn("p", p(F.col("c"))).withColumn("d", F.col("p") - F.col("a")).withColumn("e", F.log("p") - F.log("a"))
        pairs = every_pair(_own_sums(each, ("k", "g")), ["a", "wd", "we", "wde"], ("k", "g"))
        pairs = pairs.join(_one(sums.select("k", "sums", own_of()).select("k", "x.g", F.get("sums", F.col("x.b")).alias("W"))), ["k", "g"])

        def factors(table: dict[str, np.ndarray], part=part) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            found, at = {}, int(table["k"][0])
            for g, _, alpha, b in (c for c in part if c[1] == at):
                mass = table["total"] + alpha * table["v"]
                found[g] = table["ws"][:, b] * (table["c"] / mass), np.log((table["c"] + alpha) / mass) - np.log(alpha / mass)
            return found

        both = _kl_both(pairs, grid_sums(values, totals, ["c", "total", "v", "ws"], factors, ("k",)), ("k", "g"))
        forward, back = ((F.greatest(c, F.lit(0.0)) if clip == "directed" else F.col(c)) for c in ("forward", "back"))
        one = both.select("g", F.col("i").alias("sample_i"), F.col("j").alias("sample_j"), ((forward + back) / 2).alias("d"))
        one = clipped(one) if clip == "symmetric" else one
        out = one if out is None else out.unionByName(one)
    return out


def symmetric(directed: DataFrame, clip: str = "symmetric", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, sample_i, sample_j, d) for i < j: the mean of both directions; negatives become 0 before ('directed'), after or never."""
    d = F.greatest("d", F.lit(0.0)) if clip == "directed" else F.col("d")
    low, high = F.least("sample_i", "sample_j"), F.greatest("sample_i", "sample_j")
    mean = directed.groupBy(*by, low.alias("sample_i"), high.alias("sample_j")).agg((F.sum(d) / 2).alias("d"))
    return clipped(mean) if clip == "symmetric" else mean


def clipped(pairs: DataFrame, tiny: float = 0.0) -> DataFrame:
    """pairs with distances below 0, or closer to it than tiny, set to 0."""
    return pairs.withColumn("d", F.when(F.abs("d") < tiny, 0.0).otherwise(F.greatest("d", F.lit(0.0))))


def before_cleanup(pairs: DataFrame) -> DataFrame:
    """One row: how many distances are negative, the least and the largest."""
    return pairs.agg(F.count_if(F.col("d") < 0).alias("negative"), F.min("d").alias("min"), F.max("d").alias("max"))


def kl_symmetric(counts: DataFrame, alpha: float = 1.0, weight: DataFrame | None = None, clip: str = "symmetric") -> DataFrame:
    return symmetric(kl_directed(counts, alpha, weight), clip)


def tfidf_directed(counts: DataFrame, strict: bool = False, epsilon: float = 1e-12) -> DataFrame:
    """Directed divergences of normalised tf-idf vectors, smoothed by (p + epsilon) / (1 + epsilon * vocabulary)."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    every = overall(counts).select("samples", "vocabulary")
    df = feature_stats(counts).crossJoin(_one(every)).select("feature", "vocabulary", F.col("many").alias("m"), formulas.idf(F.col("df"), F.col("samples"), strict).alias("idf"))
    totals = sample_stats(counts).select("sample", "total")
    score = counts.join(df, "feature").join(totals, "sample").withColumn("s", F.col("c") / F.col("total") * F.col("idf"))
    sums = score.groupBy("sample").agg(F.sum(F.col("s") * F.col("m")).alias("sum"))
    known = F.when(F.col("sum") > 0, F.col("s") / F.col("sum")).otherwise(F.raise_error(F.lit("a sample's tf-idf sums to 0")))
    p = (known + epsilon) / (1 + F.lit(epsilon) * F.col("vocabulary"))
    values = score.join(sums, "sample").select("feature", "sample", p.alias("p"), F.col("m").cast("double").alias("w"))
    samples = totals.crossJoin(_one(every)).select("sample", (F.lit(epsilon) / (1 + F.lit(epsilon) * F.col("vocabulary"))).alias("a"))
    return _kl_parts(values, samples, every.select(F.col("vocabulary").cast("double").alias("W")))


def jsd(counts: DataFrame, log_base: float = 2.0, alpha: float = 0.0) -> DataFrame:
    """(sample_i, sample_j, d): Jensen-Shannon divergence of the samples' distributions.

    Without smoothing, a feature that one sample has gives half its probability times log 2; so the shared features and the
    samples' other mass suffice. With alpha above 0, what a sample's features give against another sample that lacks them
    depends on their counts alone, so it comes from the sample's histogram of counts, and shared features correct it.
    """
    scale = 1 / math.log(log_base)
    totals = sample_stats(counts).select("sample", "total", "kinds")
    if alpha > 0:
        return _jsd_smoothed(counts, totals, scale, alpha)
    values = counts.withColumn("m", many(counts).cast("double")).join(totals, "sample").select("feature", "sample", (F.col("c") / F.col("total")).alias("p"), "m")

    def terms(i: Fields, j: Fields) -> Fields:
        return {"s": i["m"] * _halves(i["p"], j["p"]), "pi": i["m"] * i["p"], "pj": j["m"] * j["p"]}

    meet = pair_sums(values, counts, ["p", "m"], terms, ["s", "pi", "pj"])
    pairs = every_pair(totals, []).join(meet, ["i", "j"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("s", "pi", "pj")})
    d = F.col("s") * scale + F.lit(0.5 * math.log(2) * scale) * ((1 - F.col("pi")) + (1 - F.col("pj")))
    return pairs.select(F.col("i").alias("sample_i"), F.col("j").alias("sample_j"), d.alias("d"))


def _halves(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What a feature with these two probabilities gives, in natural logarithms."""
    mean = (p + q) / 2
    return (p * np.log(p / mean) + q * np.log(q / mean)) / 2


def _jsd_smoothed(counts: DataFrame, totals: DataFrame, scale: float, alpha: float) -> DataFrame:
    every = overall(counts).select(F.col("vocabulary").cast("double").alias("v"))
    p = lambda c, total: formulas.smoothed(c, total, alpha, F.col("v"))
    samples = totals.crossJoin(_one(every)).withColumn("a", p(F.lit(0), F.col("total")))
    values = counts.withColumn("m", many(counts).cast("double")).join(samples, "sample").select("feature", "sample", p(F.col("c"), F.col("total")).alias("p"), "a", "m")

    def terms(i: Fields, j: Fields) -> Fields:
        return {"s": i["m"] * (_halves(i["p"], j["p"]) - _halves(i["p"], j["a"]) - _halves(i["a"], j["p"]) + _halves(i["a"], j["a"]))}

    meet = pair_sums(values, counts, ["p", "a", "m"], terms, ["s"])
    histogram = values.groupBy("sample", "p").agg(F.sum("m").alias("m")).groupBy("sample").agg(F.collect_list(F.struct("p", "m")).alias("own"))
    pairs = every_pair(samples.join(histogram, "sample"), ["kinds", "a", "v", "own"]).join(meet, ["i", "j"], "left")

    def half(x: Column, y: Column) -> Column:
        mean = (x + y) / 2
        return (x * F.log(x / mean) + y * F.log(y / mean)) / 2

    alone = lambda own, other: F.aggregate(own, F.lit(0.0), lambda s, e: s + e["m"] * half(e["p"], other))
    neither = (F.col("v_i") - F.col("kinds_i") - F.col("kinds_j")) * half(F.col("a_i"), F.col("a_j"))
    d = neither + alone(F.col("own_i"), F.col("a_j")) + alone(F.col("own_j"), F.col("a_i")) + F.coalesce("s", F.lit(0.0))
    return pairs.select(F.col("i").alias("sample_i"), F.col("j").alias("sample_j"), (d * scale).alias("d"))


def root(pairs: DataFrame) -> DataFrame:
    """Square roots of the distances; negative ones count as 0."""
    return pairs.withColumn("d", F.sqrt(F.greatest("d", F.lit(0.0))))


def idf_weights(counts: DataFrame, least: int = 1, largest_share: float = 1.0, power: float = 1.0) -> DataFrame:
    """(feature, w): idf ** power of the features whose document frequency is in range; others, and weights of 0, are left out."""
    kept = by_document_frequency(counts, least, largest_share)
    return kept.select("feature", F.pow(formulas.idf(F.col("df"), F.col("n")), F.lit(float(power))).alias("w")).where("w * w > 0")


def cosine_similarity(counts: DataFrame, weight: DataFrame | None = None, clamp: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """(sample_i, sample_j, s) for i < j: cosine of the count vectors, each count times its feature's weight if one is given.

    A sample whose vector is 0 has similarity 0 to all. clamp keeps rounding from leaving the range.
    """
    names = counts.select("sample").distinct()
    values = counts.select("feature", "sample", F.col("c").cast("double").alias("x"), many(counts).alias("m"))
    if weight is not None:
        values = values.join(weight.select("feature", "w"), "feature").withColumn("x", F.col("x") * F.col("w")).drop("w")
    own = names.join(values.groupBy("sample").agg(F.sum(F.col("m") * F.col("x") * F.col("x")).alias("n")), "sample", "left").fillna(0.0, ["n"])
    meet = product_sums(values.select("feature", "sample", (F.col("m") * F.col("x")).alias("mx"), "x"), counts, "mx", "x").withColumnRenamed("ij", "dot")
    pairs = every_pair(own, ["n"]).join(meet, ["i", "j"], "left")
    norm = F.sqrt(F.col("n_i") * F.col("n_j"))
    s = F.when(norm > 0, F.coalesce("dot", F.lit(0.0)) / F.nullif(norm, F.lit(0.0))).otherwise(0.0)
    if clamp:
        s = F.greatest(F.lit(clamp[0]), F.least(F.lit(clamp[1]), s))
    return pairs.select(F.col("i").alias("sample_i"), F.col("j").alias("sample_j"), s.alias("s"))


def cosine_of_vectors(rows: DataFrame, vector: str, clamp: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """(sample_i, sample_j, s) for i < j of rows (sample, vector) with arrays of one length, from products of blocks."""
    named = rows.withColumn("sample", F.col("sample").cast("string")).withColumn("_none", F.lit(""))
    return vectors.similarities(vectors.units(named, vector, "_none"), *clamp)


def length_weighted(similarity: DataFrame, lengths: DataFrame) -> DataFrame:
    """Similarities times a factor that falls with the difference of the samples' lengths."""
    i = lengths.select(F.col("sample").alias("sample_i"), F.col("length").alias("_a"))
    j = lengths.select(F.col("sample").alias("sample_j"), F.col("length").alias("_b"))
    both = similarity.join(i, "sample_i").join(j, "sample_j")
    return both.select("sample_i", "sample_j", (F.col("s") * formulas.length_factor(F.col("_a"), F.col("_b"))).alias("s"))


def to_distance(similarity: DataFrame, low: float | None = 0.0) -> DataFrame:
    """1 - similarity, the similarity clipped to [low, 1] first, unless low is None."""
    s = F.col("s") if low is None else F.greatest(F.lit(float(low)), F.least(F.lit(1.0), F.col("s")))
    d = 1 - s
    return similarity.select("sample_i", "sample_j", (d if low is None else F.greatest(F.lit(0.0), d)).alias("d"))


def entropy_weights(counts: DataFrame) -> DataFrame:
    """(feature, f, h, many): share of samples with the feature, and its binary entropy."""
    return presence(counts).select("feature", "f", formulas.binary_entropy(F.col("f")).alias("h"), "many")


def kwip_kernel(counts: DataFrame) -> DataFrame:
    """(sample_i, sample_j, kernel) for i <= j: sum of c_i c_j h over features with entropy above 0."""
    entropy = entropy_weights(counts).where("h > 0").select("feature", (F.col("h") * F.col("many")).alias("h"))
    heavy = counts.select("sample", "feature", "c").join(entropy, "feature").select("feature", "sample", F.col("c").cast("double").alias("c"), "h")
    meet = product_sums(heavy, counts, "c", "c", weight="h").select("i", "j", F.col("ij").alias("kernel"))
    names = counts.select("sample").distinct()
    across = every_pair(names, []).join(meet, ["i", "j"], "left")
    own = names.join(heavy.groupBy("sample").agg(F.sum(F.col("c") * F.col("c") * F.col("h")).alias("kernel")), "sample", "left")
    both = across.unionByName(own.select(F.col("sample").alias("i"), F.col("sample").alias("j"), "kernel"))
    return both.select(F.col("i").alias("sample_i"), F.col("j").alias("sample_j"), F.coalesce("kernel", F.lit(0.0)).alias("kernel"))


def normalised_kernel(kernel: DataFrame, empty: float = 0.0) -> DataFrame:
    """(sample_i, sample_j, s) for i < j: kernel over the root of both samples' own, `empty` where that is 0, within [-1, 1]."""
    own = kernel.where("sample_i = sample_j")
    i, j = own.select("sample_i", F.col("kernel").alias("_a")), own.select("sample_j", F.col("kernel").alias("_b"))
    both = kernel.where("sample_i < sample_j").join(i, "sample_i").join(j, "sample_j")
    norm = F.sqrt(F.col("_a") * F.col("_b"))
    s = F.when(norm > 0, F.col("kernel") / F.nullif(norm, F.lit(0.0))).otherwise(float(empty))
    return both.select("sample_i", "sample_j", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)).alias("s"))


def kwip_distance(kernel: DataFrame, empty: float = 0.0) -> DataFrame:
    """sqrt(2 - 2 s) of the normalised kernel; `empty` is the s of a pair of which a sample has no weighted feature."""
    return normalised_kernel(kernel, empty).select("sample_i", "sample_j", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))).alias("d"))


def nearest(pairs: DataFrame, n: int = 1) -> DataFrame:
    """(sample_i, sample_j, d, rank): the n nearest of each sample; ties go to the smaller name."""
    both = pairs.select("sample_i", "sample_j", "d").unionByName(pairs.select(F.col("sample_j").alias("sample_i"), F.col("sample_i").alias("sample_j"), "d"))
    order = Window.partitionBy("sample_i").orderBy("d", "sample_j")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
