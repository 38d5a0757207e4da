"""The jobs as registered queries: each runs twice into one new folder, and what it wrote is read back."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import compare_samples, grow_profiles
from spectrafold.plans.shared import new_folder
from spectrafold.queries import COSINE, DENSE, JSD, KERNEL, SILHOUETTES, SYMMETRIC

COMPARE, GROW = (json.load(open(m.DEFAULT)) for m in (compare_samples, grow_profiles))

#: Counts of trigrams by language and source, as both jobs make them.
COUNTS = """docs as (select coalesce(lang, '?') || '|' || coalesce(source, '?') as sample, coalesce(lang, '?') as label, text from documents),
    grams as (select sample, substr(text, i, 3) as feature from (select sample, text, unnest(range(1, length(text) - 1)) as i from docs where length(text) >= 3)),
    counts as (select sample, feature, cast(count(*) as bigint) as c from grams where regexp_full_match(feature, '[a-z]{3}') group by 1, 2)"""


def job1_compare_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes of samples by five distances between their profiles."""
    out = new_folder(spark, "job1")
    for _ in range(2):
        compare_samples.compare(spark, f"{sf_dir}/documents.parquet", out, COMPARE)
    rows = spark.read.parquet(f"{out}/scores")
    return rows.select("run", "sample", "label", F.round("silhouette", 6).alias("silhouette"), "status", F.round("nearest", 6).alias("nearest"))


def job2_grow_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles kept up to date by a stream; the second run finds nothing new."""
    out = new_folder(spark, "job2")
    for _ in range(2):
        grow_profiles.grow(spark, f"{sf_dir}/documents.parquet", out, f"{out}/checkpoint", GROW)
    return spark.read.parquet(f"{out}/counts").select("sample", "feature", "c")


def compare_sql() -> str:
    """Dense formulas over all pairs of samples, a part for each run."""
    distances = {
        "kl": lambda run: f"{DENSE(run.get('alpha', 1.0))}, pairs as ({SYMMETRIC.format(digits=15)})",
        "jsd": lambda run: f"{DENSE(0.0)}, {JSD.format(base=2).replace('m as (', 'mm as (').replace('from m group', 'from mm group')}, pairs as (select sample_i, sample_j, sqrt(greatest(0, d)) as d from j)",
        "cosine": lambda run: f"{COSINE()}, pairs as (select sample_i, sample_j, 1 - s as d from s)",
        "kwip": lambda run: f"""{KERNEL}, pairs as (select k.sample_i, k.sample_j, sqrt(greatest(0, 2 - 2 * greatest(-1, least(1, k.kernel / sqrt(a.kernel * b.kernel))))) as d
          from k join k a on a.sample_i = k.sample_i and a.sample_j = k.sample_i join k b on b.sample_i = k.sample_j and b.sample_j = k.sample_j where k.sample_i < k.sample_j)""",
    }
    parts = []
    for run in COMPARE["runs"]:
        parts.append(f"""(with {distances[run['method']](run)}, both_ways as (select * from pairs union all select sample_j, sample_i, d from pairs),
          twice as (select sample_i, sample_j, x.label as label_i, y.label as label_j, d from both_ways join lab x on x.sample = sample_i join lab y on y.sample = sample_j), {SILHOUETTES.replace(' s from ab', ' sil from ab')},
          near as (select sample_i as sample, min(d) as nearest from both_ways group by 1)
        select '{compare_samples.name_of(run)}' as run, sample, label, round(sil.sil, 6) as silhouette, case when sil.sil > 0.1 then 'clear' when sil.sil >= 0 then 'weak/ambiguous' else 'possibly_misplaced' end as status, round(nearest, 6) as nearest from sil join near using (sample))""")
    return f"with {COUNTS}, lab as (select distinct sample, label from docs where sample in (select sample from counts)) {' union all '.join(parts)}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_compare_samples": job1_compare_samples, "job2_grow_profiles": job2_grow_profiles}
ORACLES = {"job1_compare_samples": compare_sql(), "job2_grow_profiles": f"with {COUNTS} select sample, feature, c from counts"}
