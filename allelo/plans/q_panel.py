"""Registered queries: panel / metadata sources, person filters, label joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelo import fixtures
from allelo.functions import genotype as gt
from allelo.functions import vocab
from allelo.operators import metrics
from allelo.operators.indexing import class_index, dense_index, running_removed
from allelo.plans.common import KMEANS_TOL, subject_index, indexed, kmeans_sql, sql_ari, sql_indexed, with_ctes
from allelo.plans.registry import register, report
from allelo.session import scratch_path
from allelo.sources import panel as pn
from allelo.sources import tables_io as tio

NA = fixtures.NOT_AVAILABLE

PANEL_SQL = with_ctes([fixtures.F2_SQL, f"""pl AS (
  select sample individual, pop population, super_pop super_population, gender,
         case when height = '{NA}' then 0.0 else cast(height as double) end height,
         case when weight = '{NA}' then 0.0 else cast(weight as double) end weight
  from panel)""", """pb AS (
  select *, cast(case when gender = 'FEMALE' then 0 when gender = 'MALE' then 1 else -1 end as bigint) sex,
         case when height > 0 and weight > 0
              then weight / ((case when height > 10 then height / 100.0 else height end) *
                             (case when height > 10 then height / 100.0 else height end)) else 0.0 end bmi
  from pl)"""])


def _panel_file(spark, sf_dir, header_lines=1):
    """F2 written as a tab-separated file with extra columns; returns its path."""
    p = fixtures.panel(spark, sf_dir)
    k = F.regexp_replace("sample", "S", "").cast("int")
    out = p.select("sample", "pop", "super_pop", "gender", "height", "weight",
                   F.when(k % 7 == 0, F.lit("X")).otherwise(F.col("gender")).alias("gender2"))
    path = scratch_path(spark, "panel")
    if header_lines <= 1:
        out.write.option("sep", "\t").option("header", True).csv(path)
    else:
        # several header lines, as in clinical exports: every part file starts with them
        cols = "\t".join(out.columns)

        def prepend(batches):
            import pandas as pd
            yield pd.DataFrame({"value": [cols] * header_lines})
            for b in batches:
                yield b

        lines = out.select(F.concat_ws("\t", *out.columns).alias("value"))
        lines.mapInPandas(prepend, "value string").write.text(path)
    return path


def _read(spark, sf_dir, header_lines=1):
    path = _panel_file(spark, sf_dir, header_lines)
    return pn.read_panel(spark, path, header_lines=header_lines, sep="\t", null_string=NA, id_col=0, pop_col=1,
                         super_col=2, sex_col=3, height_col=4, weight_col=5, extra_cols=(3, 3, 3, 6))


@register("panel_load", PANEL_SQL + """select individual, population, super_population, sex, height, weight,
       round(bmi, 6) bmi from pb""")
def q_panel_load(spark, sf_dir):
    """Panel TSV read by ordinal with sentinel parsing and BMI."""
    p = _read(spark, sf_dir)
    return report(p.select("individual", "population", "super_population", "sex", "height", "weight", "bmi"))


@register("panel_load_multiheader", PANEL_SQL + "select individual, population, sex, round(bmi, 6) bmi from pb")
def q_panel_load_multiheader(spark, sf_dir):
    """S3: clinical-style file with three header lines."""
    p = _read(spark, sf_dir, header_lines=3)
    return report(p.select("individual", "population", "sex", "bmi"))


GROUP_INCLUDE = ["NATION_1", "NATION_6", "NATION_9", "NATION_11", "NATION_19"]
GROUP_EXCLUDE = ["NATION_9"]


@register("group_filter", PANEL_SQL + f"""select individual, population from pb
where population in ({",".join(f"'{x}'" for x in GROUP_INCLUDE)})
  and population not in ({",".join(f"'{x}'" for x in GROUP_EXCLUDE)})""")
def q_group_filter(spark, sf_dir):
    """Include / exclude population lists."""
    p = pn.filter_groups(_read(spark, sf_dir), GROUP_INCLUDE, GROUP_EXCLUDE)
    return report(p.select("individual", "population"))


@register("bmi_known", PANEL_SQL + "select individual, round(bmi, 6) bmi from pb where bmi > 0")
def q_bmi_known(spark, sf_dir):
    """People with known BMI."""
    return report(pn.bmi_known(_read(spark, sf_dir)).select("individual", "bmi"))


@register("sex_known", PANEL_SQL + "select individual, sex from pb where sex > -1")
def q_sex_known(spark, sf_dir):
    """P10: people with a known sex."""
    return report(pn.sex_known(_read(spark, sf_dir)).select("individual", "sex"))


@register("sex_code", PANEL_SQL + "select sex, count(*) n from pb group by sex")
def q_sex_code(spark, sf_dir):
    """Sex code distribution (exact upper-case match)."""
    return report(_read(spark, sf_dir).groupBy("sex").agg(F.count(F.lit(1)).alias("n")))


@register("bmi", PANEL_SQL + """select individual, height, weight, round(bmi, 6) bmi,
       cast(case when bmi >= 30 then 1 else 0 end as bigint) obese from pb""")
def q_bmi(spark, sf_dir):
    """BMI from height (cm or m) and weight, with the obesity flag."""
    p = _read(spark, sf_dir)
    return report(p.select("individual", "height", "weight", "bmi",
                           (F.col("bmi") >= 30).cast("bigint").alias("obese")))


@register("obese_counts", PANEL_SQL + """select population, count(*) n,
       cast(sum(case when bmi >= 30 then 1 else 0 end) as bigint) n_obese from pb group by population""")
def q_obese_counts(spark, sf_dir):
    """Obese (BMI >= 30) counts per population."""
    p = _read(spark, sf_dir)
    return report(p.groupBy("population").agg(F.count(F.lit(1)).alias("n"),
                                               F.count_if(F.col("bmi") >= 30).alias("n_obese")))


@register("pop_counts", PANEL_SQL + "select population, super_population, count(*) n from pb group by 1, 2")
def q_pop_counts(spark, sf_dir):
    """Individuals per population."""
    p = _read(spark, sf_dir)
    return report(p.groupBy("population", "super_population").agg(F.count(F.lit(1)).alias("n")))


@register("agree_filter", with_ctes([fixtures.F2_SQL]) + """select sample individual from panel
where cast(regexp_replace(sample, 'S', '') as int) % 7 <> 0""")
def q_agree_filter(spark, sf_dir):
    """Rows whose four extra columns agree."""
    return report(pn.agree_filter(_read(spark, sf_dir)).select("individual"))


def _case_sql(expr, pairs, default="NULL"):
    return "case " + expr + " " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs) + f" else {default} end"


def _groups(name):
    """(population, group) pairs of a vocabulary."""
    return [(p, sup) for sup, pops in vocab.SUPER_POPULATION[name] for p in pops]


_P3 = _groups("phase3")
COUNTRY_SQL = """countries AS (select concat('S', cast(s_suppkey as varchar)) sample,
  upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) country from supplier join nation on s_nationkey = n_nationkey)"""


@register("super_pop", with_ctes([fixtures.CODES_SQL, COUNTRY_SQL]) + f"""select sample, pop, {_case_sql('pop', _P3)} grp,
  {_case_sql('pop', _groups('phase1'))} phase1, country, {_case_sql('country', _groups('survey'))} survey
  from codes join countries using (sample)""")
def q_super_pop(spark, sf_dir):
    """Population code or country -> super-population under all three vocabularies, unmatched NULL."""
    name = F.concat(F.upper(F.substring("pop", 1, 1)), F.lower(F.expr("substring(pop, 2)")))
    country = fixtures.panel(spark, sf_dir).select("sample", name.alias("country"))
    p = fixtures.panel_codes(spark, sf_dir).join(country, "sample")
    return report(p.select("sample", "pop", gt.super_population("pop", "phase3").alias("grp"),
                           gt.super_population("pop", "phase1").alias("phase1"), "country",
                           gt.super_population("country", "survey").alias("survey")))


@register("label_code", with_ctes([fixtures.CODES_SQL]) + f"""select sample,
  cast(case {_case_sql('pop', _P3)} when 'EUR' then 0 when 'AFR' then 1 when 'AMR' then 2 when 'EAS' then 3
       else -1 end as bigint) label,
  cast(case pop when 'GBR' then 0 when 'ASW' then 1 when 'CHB' then 2 else -1 end as bigint) pop_label
from codes""")
def q_label_code(spark, sf_dir):
    """Fixed label codes of super-population and population (unknown -> -1)."""
    p = fixtures.panel_codes(spark, sf_dir)
    grp = gt.super_population("pop", "phase3")
    return report(p.select("sample", gt.label_code(grp, "super").alias("label"),
                           gt.label_code("pop", "population").alias("pop_label")))


@register("barcode_normal", with_ctes([fixtures.F2_SQL]) + """select
  substring('TCGA-' || lpad(replace(sample, 'S', ''), 7, '0') || '-01A', 1, 12) barcode_id, sample
from panel where cast(replace(sample, 'S', '') as int) % 4 <> 0""")
def q_barcode_normal(spark, sf_dir):
    """``ID_TYPE`` keys split into a 12-character barcode and a sample type; NORMAL kept."""
    p = fixtures.panel(spark, sf_dir)
    num = F.regexp_replace("sample", "S", "")
    key = F.concat(F.lit("TCGA-"), F.lpad(num, 7, "0"), F.lit("-01A_"),
                   F.when(num.cast("int") % 4 == 0, F.lit("TUMOR")).otherwise(F.lit("NORMAL")))
    out = pn.barcode_split(p.select("sample", key.alias("key")), "key", "NORMAL")
    return report(out.select("barcode_id", "sample"))


@register("samples_panel", with_ctes([fixtures.F1_SQL, fixtures.F2_SQL]) + """select s.subject_id, p.pop, p.super_pop
from (select distinct subject_id from flat) s join panel p on p.sample = s.subject_id""")
def q_samples_panel(spark, sf_dir):
    """Genotyped samples joined with the panel (people without metadata dropped)."""
    s = fixtures.flat(spark, sf_dir).select("subject_id").distinct()
    p = fixtures.panel(spark, sf_dir)
    return report(s.join(p, s.subject_id == p["sample"]).select("subject_id", "pop", "super_pop"))


@register("samples_bmi", PANEL_SQL.rstrip() + ",\n" + fixtures.F1_SQL + """
select s.subject_id, round(pb.bmi, 6) bmi from (select distinct subject_id from flat) s
join pb on pb.individual = s.subject_id where pb.bmi > 0""")
def q_samples_bmi(spark, sf_dir):
    """Genotyped samples joined with known BMI."""
    s = fixtures.flat(spark, sf_dir).select("subject_id").distinct()
    b = pn.bmi_known(_read(spark, sf_dir)).select(F.col("individual").alias("subject_id"), "bmi")
    return report(s.join(b, "subject_id"))


def _label_dict_sql():
    return "lab AS (select super_pop, row_number() over (order by super_pop) - 1 label from " \
           "(select distinct super_pop from panel) t)"


@register("labelled_subjects", with_ctes(sql_indexed() + [fixtures.F2_SQL, _label_dict_sql()]) + """
select subject_id, label from subj join panel on panel.sample = subj.subject_id join lab using (super_pop)""")
def q_labelled_subjects(spark, sf_dir):
    """Keep subjects present in the label map and attach the label ordinal in one join."""
    subjects = subject_index(spark, sf_dir)
    p = fixtures.panel(spark, sf_dir)
    lab = class_index(p, "super_pop", "label")
    labels = p.join(lab, "super_pop").select(F.col("sample").alias("subject_id"), "label")
    return report(subjects.join(labels, "subject_id").select("subject_id", "label"))


def _partial_panel(spark, sf_dir):
    """Panel without two nations, so some genotyped samples lack labels."""
    p = fixtures.panel(spark, sf_dir)
    return p.where(~F.col("pop").isin("NATION_6", "NATION_11"))


PARTIAL_SQL = "pp AS (select * from panel where pop not in ('NATION_6', 'NATION_11'))"


@register("label_or_unknown", with_ctes(sql_indexed() + [fixtures.F2_SQL, PARTIAL_SQL, """lab AS (
  select super_pop, row_number() over (order by super_pop) - 1 label from (select distinct super_pop from pp) t)"""]) +
    """select si sample_index, subject_id, coalesce(label, (select count(*) from lab)) label
from subj left join pp on pp.sample = subj.subject_id left join lab using (super_pop)""")
def q_label_or_unknown(spark, sf_dir):
    """Every sample's label ordinal, unknown samples get ``labelCount``."""
    subjects = subject_index(spark, sf_dir)
    p = _partial_panel(spark, sf_dir)
    lab = class_index(p, "super_pop", "label")
    n_labels = lab.count()
    lp = p.join(lab, "super_pop").select(F.col("sample").alias("subject_id"), "label")
    out = subjects.join(lp, "subject_id", "left").select(
        F.col("subject_index").alias("sample_index"), "subject_id",
        F.coalesce("label", F.lit(n_labels)).alias("label"))
    return report(out)


@register("unlabelled_count", with_ctes(sql_indexed() + [fixtures.F2_SQL, PARTIAL_SQL]) + """
select count(*) n_unlabelled from subj left join pp on pp.sample = subj.subject_id where pp.sample is null""")
def q_unlabelled_count(spark, sf_dir):
    """Samples without a known label."""
    subjects = subject_index(spark, sf_dir)
    p = _partial_panel(spark, sf_dir).select(F.col("sample").alias("subject_id"))
    return report(subjects.join(p, "subject_id", "left_anti").agg(F.count(F.lit(1)).alias("n_unlabelled")))


UNLAB_SQL = with_ctes(sql_indexed() + [fixtures.F2_SQL, PARTIAL_SQL, """flag AS (
  select si, subject_id, cast(case when pp.sample is null then 1 else 0 end as bigint) removed
  from subj left join pp on pp.sample = subj.subject_id)""", """corr AS (
  select si, subject_id, removed, cast(sum(removed) over (order by si rows between unbounded preceding and current row) as bigint) shift
  from flag)"""])


@register("index_corrections", UNLAB_SQL + "select si sample_index, removed, shift from corr")
def q_index_corrections(spark, sf_dir):
    """Running count of removed (unlabelled) samples per sample index."""
    subjects = subject_index(spark, sf_dir)
    p = _partial_panel(spark, sf_dir).select(F.col("sample").alias("subject_id"), F.lit(0).alias("known"))
    flags = subjects.join(p, "subject_id", "left").select(
        F.col("subject_index").alias("sample_index"), F.col("known").isNull().cast("bigint").alias("removed"))
    return report(running_removed(flags, "sample_index", F.col("removed")))


@register("drop_unlabelled", UNLAB_SQL + """select x.vi variant_index, cast(x.si - c.shift as bigint) sample_index, x.allele
from x join corr c on c.si = x.si where c.removed = 0""")
def q_drop_unlabelled(spark, sf_dir):
    """Drop unlabelled samples from every variant vector and compact sample indices."""
    long, subjects, variants, x = indexed(spark, sf_dir)
    p = _partial_panel(spark, sf_dir).select(F.col("sample").alias("subject_id"))
    kept = subjects.join(p, "subject_id", "left_semi")
    new_idx = dense_index(kept.select("subject_index"), ["subject_index"], "sample_index")
    out = x.join(new_idx, "subject_index").select("variant_index", "sample_index", "allele")
    return report(out)


@register("label_ordinal", with_ctes([fixtures.F2_SQL]) + """select sample, super_pop,
  dense_rank() over (order by super_pop) - 1 label_index from panel""")
def q_label_ordinal(spark, sf_dir):
    """Label names coded 0..L-1 in sorted order."""
    from allelo.operators.indexing import label_ordinal
    p = fixtures.panel(spark, sf_dir).select("sample", "super_pop")
    return report(label_ordinal(p, "super_pop"))


@register("ped_load", with_ctes([fixtures.F2_SQL]) + "select sample, pop population from panel")
def q_ped_load(spark, sf_dir):
    """Pedigree TSV (sample in column 1, population in column 6)."""
    p = fixtures.panel(spark, sf_dir)
    ped = p.select(F.lit("FAM").alias("family"), "sample", F.lit("0").alias("father"), F.lit("0").alias("mother"),
                   "gender", F.lit("-9").alias("pheno"), F.col("pop").alias("population"))
    path = scratch_path(spark, "ped")
    ped.write.option("sep", "\t").csv(path)
    return report(pn.read_ped(spark, path))


@register("mutation_load", with_ctes([fixtures.F5_SQL]) + """select individual, gene, msi_status, bmi, bmi_cat,
  count(*) n from mutations group by all""")
def q_mutation_load(spark, sf_dir):
    """Mutation table CSV read by column ordinal (counted per distinct event)."""
    path = tio.write_mutations(fixtures.mutations(spark, sf_dir), scratch_path(spark, "mut"))
    m = tio.read_mutations(spark, path)
    return report(m.groupBy("individual", "gene", "msi_status", "bmi", "bmi_cat").agg(F.count(F.lit(1)).alias("n")))


@register("mutation_features", with_ctes([fixtures.F5_SQL, """genes AS (select gene, row_number() over (order by gene) - 1 gene_index
  from (select distinct gene from mutations) t)"""]) + """select m.individual, m.gene, g.gene_index, count(*) n,
  max(m.bmi) bmi, max(m.bmi_cat) bmi_cat
from mutations m join genes g using (gene) where m.msi_status = 'MSS' group by m.individual, m.gene, g.gene_index""")
def q_mutation_features(spark, sf_dir):
    """Per (person, gene) mutation counts, gene dictionary, MSS only."""
    return report(tio.mutation_features(fixtures.mutations(spark, sf_dir)))


@register("dictionaries", with_ctes([fixtures.F5_SQL]) + """select
  (select count(distinct gene) from mutations) n_genes,
  (select count(*) from (select distinct individual, msi_status, bmi, bmi_cat from mutations) t) n_persons""")
def q_dictionaries(spark, sf_dir):
    """Distinct dictionaries (genes; persons with metadata)."""
    m = fixtures.mutations(spark, sf_dir)
    return report(m.agg(F.count_distinct("gene").alias("n_genes"),
                        F.count_distinct("individual", "msi_status", "bmi", "bmi_cat").alias("n_persons")))


@register("ari_eval", with_ctes(kmeans_sql("planted", 5) + [fixtures.F2_SQL, PARTIAL_SQL], True) + "," + sql_ari(
    "select pp.super_pop a, cast(a.cl as bigint) b, count(*) n from a join subj using (si) "
    "join pp on pp.sample = subj.subject_id group by 1, 2"))
def q_ari_eval(spark, sf_dir):
    """Cluster assignments written as CSV, read back, kept for known people, scored by ARI."""
    from allelo.operators import kmeans as km
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=False)
    res = km.fit(x, subjects, 5, tol=KMEANS_TOL)
    path = tio.write_csv(res.assignment.join(subjects, "subject_index").select("subject_id", "cluster"),
                         scratch_path(spark, "assign"))
    a = tio.read_assignments(spark, path)
    p = _partial_panel(spark, sf_dir)
    lab = a.join(p, a.subject == p["sample"])
    return report(metrics.adjusted_rand_index(lab, "super_pop", "cluster"))
