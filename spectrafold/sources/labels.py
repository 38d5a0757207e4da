"""Labels of samples, from names, headers or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import sample_name

#: Species that names are searched for, in this order.
SPECIES = ("abortus", "melitensis", "suis", "canis", "ovis", "neotomae", "pinnipedialis", "ceti", "microti", "inopinata", "vulpis", "papionis")
#: Names of the column that holds samples, and of the one that holds labels, by preference.
SAMPLE_COLUMNS = ("sample", "sample_name", "sample_id", "filename", "file", "name", "id", "genome", "accession", "strain", "isolate")
LABEL_COLUMNS = ("group", "label", "class", "category", "species", "type")


def by_class_name(name: Column, otherwise: str = "unknown") -> Column:
    """functional or pathological, whichever the name holds."""
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("functional")), "functional").when(low.rlike("pathological|pathogenic"), "pathological").otherwise(otherwise)


def by_class_code(name: Column) -> Column:
    """0 for functional, 1 for pathological, -1 for neither."""
    kind = by_class_name(name)
    return F.when(kind == "functional", 0).when(kind == "pathological", 1).otherwise(-1)


def by_number(name: Column) -> Column:
    """sample01 to sample05 are functional, sample06 to sample10 pathological, where the name doesn't say so itself."""
    number = F.try_to_number(F.regexp_extract(F.lower(name), r"sample_?0*([0-9]{1,9})", 1), F.lit("999999999"))
    kind = by_class_name(name)
    ruled = F.when(number.between(1, 5), "functional").when(number.between(6, 10), "pathological").otherwise("unknown")
    return F.when(kind == "unknown", ruled).otherwise(kind)


def by_species(name: Column, otherwise: str = "Brucella_sp") -> Column:
    """The first of the known species that the name holds."""
    out, low = None, F.lower(name)
    for species in SPECIES:
        has = F.contains(low, F.lit(species))
        out = F.when(has, species) if out is None else out.when(has, species)
    return out.otherwise(otherwise)


def by_header(header: Column) -> Column:
    """The species in a header after its accession: three words if the second is "sp.", else two; a fixed name if there are none."""
    words = F.split(F.trim(header), r"\s+")
    named = F.when((F.lower(F.get(words, F.lit(2))) == "sp.") & (F.size(words) >= 4), F.slice(words, 2, 3)).when(F.size(words) >= 3, F.slice(words, 2, 2))
    return F.coalesce(F.array_join(named, " "), F.lit("Unknown Brucella"))


def accession(name: Column) -> Column:
    """The first two parts of a name that underscores separate."""
    return F.substring_index(name, "_", 2)


def by_accession(samples: DataFrame, names: DataFrame) -> DataFrame:
    """samples with (group_id, group) of a small table (accession, group_id, group); null where there is none."""
    return samples.withColumn("accession", accession(F.col("sample"))).join(names, "accession", "left")


def _column(table: DataFrame, wanted: str | None, candidates: tuple[str, ...], other: str | None = None) -> str:
    names = {c.strip().lower(): c for c in table.columns}
    if wanted:
        if wanted.lower() not in names:
            raise ValueError(f"no column {wanted}; there are {', '.join(table.columns)}")
        return names[wanted.lower()]
    for c in candidates:
        if c in names and names[c] != other:
            return names[c]
    rest = [c for c in table.columns if c != other]
    if not rest:
        raise ValueError("no column is left for the samples")
    return rest[0]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def _some(rows: DataFrame, column: str) -> list[str]:
    return [r[0] for r in rows.select(column).orderBy(column).limit(10).collect()]


def strict(samples: DataFrame, table: DataFrame, sample_col: str = "sample", label_col: str = "group") -> tuple[DataFrame, list[str]]:
    """(samples with `label` and all other columns of the table, names that only the table has, ten at most).

    Raises ValueError where a column is absent, a sample is named twice or not at all.
    """
    for c in (sample_col, label_col):
        if c not in table.columns:
            raise ValueError(f"no column {c}")
    clean = table.select(F.trim(sample_col).alias("sample"), F.trim(F.col(label_col).cast("string")).alias("label"), *(F.col(c) for c in table.columns if c not in (sample_col, "sample", "label")))
    if twice := _some(clean.groupBy("sample").count().where("count > 1"), "sample"):
        raise ValueError(f"samples with two labels: {', '.join(twice)}")
    if missing := _some(samples.join(clean, "sample", "left_anti"), "sample"):
        raise ValueError(f"samples without a label: {', '.join(missing)}")
    return samples.join(clean, "sample", "left"), _some(clean.join(samples, "sample", "left_anti"), "sample")


def flexible(samples: DataFrame, table: DataFrame, label_col: str, sample_col: str | None = None) -> DataFrame:
    """samples with `label`: the sample column is chosen by name, and names match as they are or without their suffix.

    Raises ValueError where a sample has no label.
    """
    label = _column(table, label_col, ())
    named = table.select(F.trim(_column(table, sample_col, SAMPLE_COLUMNS, label)).alias("_name"), F.trim(F.col(label).cast("string")).alias("_label"))
    exact = named.groupBy(F.col("_name").alias("sample")).agg(F.first("_label", True).alias("_exact"))
    bare = named.groupBy(sample_name(F.col("_name")).alias("_bare")).agg(F.first("_label", True).alias("_loose"))
    out = samples.join(exact, "sample", "left").withColumn("_bare", sample_name(F.col("sample"))).join(bare, "_bare", "left")
    out = out.withColumn("label", F.coalesce("_exact", "_loose")).drop("_bare", "_exact", "_loose")
    if missing := _some(out.where("label is null"), "sample"):
        raise ValueError(f"samples without a label: {', '.join(missing)}")
    return out


def lenient(samples: DataFrame, table: DataFrame, label_col: str | None = None, sample_col: str | None = None) -> DataFrame:
    """samples with `label`, 'unknown' where there is none: both columns are chosen by name, and names match without folder, suffix and case."""
    label = _column(table, label_col, LABEL_COLUMNS)
    key = lambda c: F.lower(sample_name(F.trim(c)))
    named = table.select(key(F.col(_column(table, sample_col, SAMPLE_COLUMNS, label))).alias("_key"), F.trim(F.col(label).cast("string")).alias("_label"))
    named = named.where("_key is not null and _label is not null").groupBy("_key").agg(F.first("_label").alias("_label"))
    out = samples.withColumn("_key", key(F.col("sample"))).join(named, "_key", "left")
    return out.withColumn("label", F.coalesce("_label", F.lit("unknown"))).drop("_key", "_label")


def grouped(samples: DataFrame, table: DataFrame) -> DataFrame:
    """samples with group and integer group_id of a table (sample, group, group_id); raises ValueError where one is absent."""
    named = table.select(sample_name(F.trim("sample")).alias("_bare"), F.trim("group").alias("group"), F.col("group_id").cast("int").alias("group_id"))
    out = samples.withColumn("_bare", sample_name(F.col("sample"))).join(named, "_bare", "left").drop("_bare")
    if missing := _some(out.where("group is null or group_id is null"), "sample"):
        raise ValueError(f"samples without a group: {', '.join(missing)}")
    return out
