"""Tabular sources and sinks.

All writers are ordinary parallel DataFrame writes; where a text format needs
a header line (wide CSV, matrices), the header is written as its own small
dataset next to the body instead of funnelling the body through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelo.functions.dense import dense_text
from allelo.functions.genotype import round_half_up
from allelo.session import text_shards

# Column ordinals of the mutation table (0-based) and the first
# header token that identifies it.
MUTATION_HEADER_START = '"dbSNP_RS'
MUTATION_COLS = {"gene": 7, "individual": 10, "msi_status": 23, "bmi": 27, "bmi_cat": 28}
MUTATION_WIDTH = 29


# --------------------------------------------------------------------- S4 / A5

def write_mutations(events: DataFrame, path: str) -> str:
    """Lay mutation events out at their table ordinals (other columns empty) and write CSV."""
    slots = {v: k for k, v in MUTATION_COLS.items()}
    cols = []
    for i in range(MUTATION_WIDTH):
        name = "dbSNP_RS" if i == 0 else f"c{i}"
        cols.append((F.col(slots[i]).cast("string") if i in slots else F.lit("")).alias(name))
    events.select(*cols).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    return path


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """Mutation CSV projected by ordinal to ``individual, gene, msi_status, bmi, bmi_cat``."""
    df = spark.read.option("header", True).csv(path)
    c = df.columns
    return df.select(F.col(c[MUTATION_COLS["individual"]]).alias("individual"),
                     F.col(c[MUTATION_COLS["gene"]]).alias("gene"),
                     F.col(c[MUTATION_COLS["msi_status"]]).alias("msi_status"),
                     F.col(c[MUTATION_COLS["bmi"]]).cast("double").alias("bmi"),
                     F.col(c[MUTATION_COLS["bmi_cat"]]).alias("bmi_cat"))


def mutation_features(events: DataFrame, keep_msi: str = "MSS") -> DataFrame:
    """Per (person, gene) mutation counts with gene index and metadata.

    Counting is a partial+final hash aggregate; the gene dictionary (distinct
    genes coded in name order) and the person table are joined after.  Of several
    metadata rows of a person the smallest counts.
    """
    from allelo.operators.indexing import class_index

    counts = events.groupBy("individual", "gene").agg(F.count(F.lit(1)).alias("n"))
    genes = class_index(events, "gene", "gene_index")   # a gene vocabulary is bounded (~2e4 names)
    persons = events.groupBy("individual").agg(F.min(F.struct("msi_status", "bmi", "bmi_cat")).alias("p")) \
        .select("individual", "p.*")
    return (counts.join(genes, "gene").join(persons, "individual")
            .where(F.col("msi_status") == keep_msi)
            .select("individual", "gene", "gene_index", "n", "bmi", "bmi_cat"))


# ------------------------------------------------------------ S5 / S6 / S17

def write_wide_csv(long: DataFrame, path: str, label_name: str = "aBeta", numeric: bool = False) -> list[str]:
    """``long(id, label, feature, x)`` -> wide CSV (header file + parallel body).

    Binary layout: header ``"",aBeta,f0,..`` and rows ``id,label,x0,..``;
    numeric layout: header ``"y",f0,..`` (one field shorter than the rows).
    """
    feats = long.select("feature").distinct()
    hdr = feats.agg(F.array_join(F.transform(F.array_sort(F.collect_list("feature")),
                                             lambda f: F.concat(F.lit("f"), f.cast("string"))), ",").alias("h"))
    lead = '"y"' if numeric else f'"",{label_name}'
    hdr.select(F.concat(F.lit(lead + ","), F.col("h")).alias("value")).coalesce(1) \
        .write.mode("overwrite").text(f"{path}/header")
    rows = long.groupBy("id", "label").agg(F.array_sort(F.collect_list(F.struct("feature", "x"))).alias("e"))
    body = rows.select(F.concat_ws(",", F.col("id"), F.col("label").cast("string"),
                                   F.array_join(F.transform("e", lambda s: s["x"].cast("string")), ",")).alias("value"))
    body.write.mode("overwrite").text(f"{path}/body")
    return [f"{path}/header", f"{path}/body"]


def csv_fields(line: Column) -> Column:
    """The fields of a CSV line as an array: quoted fields may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]++|"")*+"|[^,]*)'), F.lit(1))
    return F.transform(raw, lambda x: F.when(
        x.startswith('"') & x.endswith('"') & (F.length(x) > 1),
        F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def read_wide_csv(spark: SparkSession, paths, numeric: bool = False) -> tuple[DataFrame, DataFrame]:
    """Wide labelled CSV -> (features dictionary, long cells).

    Returns ``features(feature_index, name)`` and
    ``cells(id, label, feature_index, x)``; binary labels are rounded half-up.
    All files must share one header line.
    """
    if isinstance(paths, str):
        paths = paths.split(",")
    lines = spark.read.text(paths)
    is_header = F.col("value").startswith('"y",') if numeric else F.col("value").startswith('"",')
    header = lines.where(is_header).distinct()
    if header.limit(2).count() > 1:
        raise ValueError("the files have different header lines")
    skip = 1 if numeric else 2
    rest = lambda f, k: F.slice(f, k + 1, F.greatest(F.size(f) - k, F.lit(0)))
    features = header.select(csv_fields(F.col("value")).alias("f")).select(
        F.posexplode(rest(F.col("f"), skip)).alias("feature_index", "name")).select(
        F.col("feature_index").cast("bigint"), "name")
    body = lines.where(~is_header).select(csv_fields(F.col("value")).alias("f"))
    label = F.col("f")[1].cast("double") if numeric else round_half_up(F.col("f")[1])
    cells = body.select(F.col("f")[0].alias("id"), label.alias("label"),
                        F.posexplode(rest(F.col("f"), 2)).alias("feature_index", "x")) \
        .select("id", "label", F.col("feature_index").cast("bigint"), F.col("x").try_cast("double"))
    return features, cells


def feature_by_name(features: DataFrame, name: str) -> DataFrame:
    """Index of a feature by its header name."""
    return features.where(F.col("name") == name).select("feature_index")


# ------------------------------------------------------------- S7 - S11

def write_parquet(df: DataFrame, path: str, cluster_by: str | None = None) -> str:
    """Parquet sink; optionally sorted within files for row-group skipping."""
    out = df.sortWithinPartitions(cluster_by) if cluster_by else df
    out.write.mode("overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str, header: bool = False) -> str:
    """CSV side files (subject dictionary, cluster assignments)."""
    df.write.mode("overwrite").option("header", header).csv(path)
    return path


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """``subject, cluster`` CSV."""
    return spark.read.schema("subject STRING, cluster BIGINT").csv(path)


# ------------------------------------------------------- S12 / S13 / S15 / D4 / D5

def wide_export_lines(long_idx: DataFrame, labels: DataFrame, n_samples: int,
                      n_variants: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled wide-matrix export: a label line and one int line per variant.

    ``long_idx(sample_index, variant_index, allele)``, ``labels(sample_index, label)``.
    Each variant line has ``n_samples`` values (cohort-sized row), so the lines are samples x
    variants: to be written compressed, in shards of bounded text (``n_variants``, about, sizes them).
    """
    if n_variants is None:
        n_variants = long_idx.agg(F.approx_count_distinct("variant_index")).first()[0]
    shards = text_shards(long_idx.sparkSession, n_variants, 2 * n_samples)
    lab = labels.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_index", "label"))),
                                              lambda s: s["label"].cast("string")), ",").alias("value"))
    per = long_idx.repartition(shards, "variant_index").groupBy("variant_index").agg(F.array_sort(F.collect_list(F.struct(
        F.col("sample_index").alias("i"), F.col("allele").cast("int").cast("string").alias("v")))).alias("e"))
    body = per.select("variant_index", dense_text("e", n_samples, "0").alias("value"))
    return lab, body


def gram_lines(gram_df: DataFrame, n: int) -> DataFrame:
    """Dense rows of a symmetric Gram matrix from its upper triangle, one line per row."""
    entry = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"), F.col("g"))
    both = F.when(F.col("i") == F.col("j"), F.array(entry("i", "j"))).otherwise(F.array(entry("i", "j"), entry("j", "i")))
    full = gram_df.select(F.explode(both).alias("x")).select("x.*")
    per = full.groupBy("i").agg(F.array_sort(F.collect_list(F.struct(
        F.col("j").alias("i"), F.col("g").cast("bigint").cast("string").alias("v")))).alias("e"))
    return per.select("i", dense_text("e", n, "0").alias("value"))


def cluster_member_lines(assign: DataFrame) -> DataFrame:
    """One ``Cluster Id : c-------> Samples : a,b,c`` line a cluster, members in index order.

    The line wording is a fixed value.  A line holds all names of its cluster, as the format asks.
    """
    g = assign.groupBy("cluster").agg(
        F.array_sort(F.collect_list(F.struct("subject_index", "subject_id"))).alias("m"))
    names = F.array_join(F.transform("m", lambda s: s["subject_id"]), ",")
    return g.select("cluster", F.concat(F.lit("Cluster Id : "), F.col("cluster").cast("string"),
                                        F.lit("-------> Samples : "), names).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def sif_lines(df: DataFrame, source: str, relation: str, target: str) -> DataFrame:
    """SIF edge list ``source<TAB>relation<TAB>target``."""
    return df.select(F.concat_ws("\t", F.col(source).cast("string"), F.col(relation).cast("string"),
                                 F.col(target).cast("string")).alias("value"))
