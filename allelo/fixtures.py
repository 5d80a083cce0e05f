"""Genotype-shaped inputs derived from the driver tables.

Every fixture exists twice: as a Spark DataFrame plan (used by the library
queries) and as a SQL common-table expression (used by the DuckDB oracle), and
both are computed from the same parquet tables so they grow with the data.

* F1 ``flat``    long genotypes: supplier = subject, part = variant,
                  dosage = max(quantity mod 3) per cell, zero cells dropped.
* F2 ``panel``   sample panel: nation = population, region = super-population,
                  plus gender / height / weight strings with a missing sentinel.
* F5 ``mutations`` mutation events (person, gene, msi, bmi, bmi class).
* F6 ``wide``    long form of the embeddings matrix with its label.
* F7 ``pairs``   two labelings of the same documents.
* F8 ``planted`` F1 with every 40th variant driven by the subject's region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelo.tables import load

# The missing-value sentinel used by clinical panels.
NOT_AVAILABLE = "[Not Available]"


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_id STRING, variant_key BIGINT, allele DOUBLE`` (non-zero cells)."""
    li = load(spark, sf_dir, "lineitem")
    dose = F.max(F.col("l_quantity").cast("int") % 3)
    return (li.groupBy("l_suppkey", "l_partkey").agg(dose.alias("d"))
            .where(F.col("d") > 0)
            .select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("subject_id"),
                    F.col("l_partkey").cast("bigint").alias("variant_key"),
                    F.col("d").cast("double").alias("allele")))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: like F1, but every 40th variant's dosage follows the subject's region."""
    li = load(spark, sf_dir, "lineitem")
    sup = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = (li.join(sup, li.l_suppkey == sup.s_suppkey)
         .join(F.broadcast(nat), F.col("s_nationkey") == F.col("n_nationkey")))  # 25 rows, fixed
    dose = F.when(F.col("l_partkey") % 40 == 0, (F.col("n_regionkey") + F.col("l_partkey")) % 3) \
        .otherwise(F.col("l_quantity").cast("int") % 3)
    return (j.groupBy("l_suppkey", "l_partkey").agg(F.max(dose).alias("d"))
            .where(F.col("d") > 0)
            .select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("subject_id"),
                    F.col("l_partkey").cast("bigint").alias("variant_key"),
                    F.col("d").cast("double").alias("allele")))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample, pop, super_pop, gender, height, weight`` (all strings)."""
    sup = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    k = F.col("s_suppkey")
    na = F.lit(NOT_AVAILABLE)
    return (sup.join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey)      # 25 rows, fixed
            .join(F.broadcast(reg), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows, fixed
            .select(F.concat(F.lit("S"), k.cast("string")).alias("sample"),
                    F.col("n_name").alias("pop"), F.col("r_name").alias("super_pop"),
                    F.when(k % 3 == 0, "FEMALE").when(k % 3 == 1, "MALE").otherwise("NA").alias("gender"),
                    F.when(k % 10 == 0, na).otherwise((150 + k % 50).cast("string")).alias("height"),
                    F.when(k % 11 == 0, na).otherwise((50 + k % 60).cast("string")).alias("weight")))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one mutation event per line item."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    ck = F.col("c_custkey")
    return j.select(
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("individual"),
        F.concat(F.lit("G"), (F.col("l_partkey") % 200).cast("string")).alias("gene"),
        F.when(F.col("c_acctbal") < 0, "MSI-H").otherwise("MSS").alias("msi_status"),
        (18 + ck % 25).cast("double").alias("bmi"),
        F.when(ck % 25 >= 12, "obese").otherwise("healthy").alias("bmi_cat"))


def wide_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id STRING, label INT, feature INT, x DOUBLE`` from the embeddings."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("int").alias("label"),
                    F.posexplode("embedding").alias("feature", "x")) \
        .select("id", "label", F.col("feature").cast("int").alias("feature"),
                F.col("x").cast("double").alias("x"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, c1, c2`` two labelings of the same documents."""
    return load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("c1"),
                                                F.col("toxic").alias("c2"))


# ---------------------------------------------------------------------------
# The same fixtures as SQL common-table expressions for the DuckDB oracle.
# ---------------------------------------------------------------------------

F1_SQL = """flat AS (
  select concat('S', cast(l_suppkey as varchar)) subject_id, cast(l_partkey as bigint) variant_key,
         cast(max(cast(l_quantity as int) % 3) as double) allele
  from lineitem group by l_suppkey, l_partkey
  having max(cast(l_quantity as int) % 3) > 0)"""

F8_SQL = """planted AS (
  select concat('S', cast(l_suppkey as varchar)) subject_id, cast(l_partkey as bigint) variant_key,
         cast(max(case when l_partkey % 40 = 0 then (n_regionkey + l_partkey) % 3
                       else cast(l_quantity as int) % 3 end) as double) allele
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  group by l_suppkey, l_partkey
  having max(case when l_partkey % 40 = 0 then (n_regionkey + l_partkey) % 3
                  else cast(l_quantity as int) % 3 end) > 0)"""

F2_SQL = """panel AS (
  select concat('S', cast(s_suppkey as varchar)) sample, n_name pop, r_name super_pop,
         case s_suppkey % 3 when 0 then 'FEMALE' when 1 then 'MALE' else 'NA' end gender,
         case when s_suppkey % 10 = 0 then '[Not Available]' else cast(150 + s_suppkey % 50 as varchar) end height,
         case when s_suppkey % 11 = 0 then '[Not Available]' else cast(50 + s_suppkey % 60 as varchar) end weight
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

F5_SQL = """mutations AS (
  select concat('P', cast(o_custkey as varchar)) individual, concat('G', cast(l_partkey % 200 as varchar)) gene,
         case when c_acctbal < 0 then 'MSI-H' else 'MSS' end msi_status,
         cast(18 + c_custkey % 25 as double) bmi,
         case when c_custkey % 25 >= 12 then 'obese' else 'healthy' end bmi_cat
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""

F6_SQL = """wide AS (
  select cast(vec_id as varchar) id, cast(label as int) label,
         cast(generate_subscripts(embedding, 1) - 1 as int) feature,
         cast(unnest(embedding) as double) x
  from embeddings)"""

F7_SQL = """pairs AS (select doc_id, quality c1, toxic c2 from labels)"""


# Population codes for the panel: the phase-3 code list in its fixed order,
# indexed by nation key (25 nations -> 25 of the 26 codes).
def _pop_codes():
    from allelo.functions.vocab import SUPER_POPULATION
    return [p for _, pops in SUPER_POPULATION["phase3"] for p in pops]


POP_CODES = _pop_codes()


def panel_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with a 1000-Genomes-style population code per sample."""
    sup = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    codes = F.array(*[F.lit(c) for c in POP_CODES])
    return sup.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample"),
                      F.element_at(codes, (F.col("s_nationkey") % len(POP_CODES) + 1).cast("int")).alias("pop"))


CODES_SQL = ("codes AS (select concat('S', cast(s_suppkey as varchar)) sample, "
             "([" + ", ".join(f"'{c}'" for c in POP_CODES) + f"])[s_nationkey % {len(POP_CODES)} + 1] pop "
             "from supplier)")
