"""Shared building blocks for registered queries (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelo import fixtures
from allelo.operators.indexing import subject_dictionary, variant_dictionary
from allelo.operators.matrix import index_long, join_subjects


def indexed(spark: SparkSession, sf_dir: str, source: str = "flat", dense_variants: bool = True):
    """(long, subjects, variants, long_idx) for fixture ``flat`` (F1) or ``planted`` (F8).

    ``dense_variants=False`` keeps ``variant_index = variant_key``: algorithms that
    only need a unique, ordered variant id (k-means, chi-square, Gram, the VCF
    writer) then skip the distributed dense index and the shuffle join of every
    cell with the variant dictionary; order-based tie rules are unchanged
    because the dense index is monotone in the key.
    """
    long = fixtures.flat(spark, sf_dir) if source == "flat" else fixtures.planted(spark, sf_dir)
    # reused by both dictionaries and the index join: pin it once as a checkpoint (a plan leaf;
    # cached plans would stay in the session's cache manager after the query)
    long = long.checkpoint()
    subjects = subject_dictionary(long)
    if dense_variants:
        variants = variant_dictionary(long)
        return long, subjects, variants, index_long(long, subjects, variants)
    variants = long.select("variant_key").distinct().withColumn("variant_index", F.col("variant_key"))
    x = join_subjects(long, subjects).withColumn("variant_index", F.col("variant_key"))
    return long, subjects, variants, x


def subject_index(spark: SparkSession, sf_dir: str, source: str = "flat") -> DataFrame:
    """``(subject_id, subject_index)`` alone: distinct ids straight from the scan, no cell is kept."""
    return subject_dictionary(fixtures.flat(spark, sf_dir) if source == "flat" else fixtures.planted(spark, sf_dir))


def sql_indexed(source: str = "flat") -> list[str]:
    """CTEs ``subj(subject_id, si)``, ``var(variant_key, vi)``, ``x(si, vi, allele)`` over a fixture."""
    base = fixtures.F1_SQL if source == "flat" else fixtures.F8_SQL
    return [base,
            f"subj AS (select subject_id, row_number() over (order by subject_id) - 1 si "
            f"from (select distinct subject_id from {source}) d)",
            f"var AS (select variant_key, row_number() over (order by variant_key) - 1 vi "
            f"from (select distinct variant_key from {source}) d)",
            f"x AS (select si, vi, allele from {source} join subj using (subject_id) join var using (variant_key))"]


def sql_ari(ct_sql: str) -> str:
    """SQL for ARI from a contingency CTE body producing ``(a, b, n)``; yields ``(n, ari)``."""
    return f"""ct AS ({ct_sql}),
ari_s AS (select sum(n) n, sum(n * (n - 1) / 2.0) idx from ct),
ari_a AS (select sum(m * (m - 1) / 2.0) sa from (select a, sum(n) m from ct group by a) t),
ari_b AS (select sum(m * (m - 1) / 2.0) sb from (select b, sum(n) m from ct group by b) t),
ari_e AS (select n, idx, sa, sb, sa * sb / (n * (n - 1) / 2.0) e from ari_s, ari_a, ari_b)
select cast(n as bigint) n,
       round(case when (sa + sb) / 2.0 - e = 0 then 1.0 else (idx - e) / ((sa + sb) / 2.0 - e) end, 6) ari
from ari_e"""


def with_ctes(parts: list[str], recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


KMEANS_TOL = 1e-3


def _nearest_sql(centres: str) -> str:
    """``(si, cl, dist)``: nearest centre of every subject, for centres ``(cl, vi, c)``."""
    dist = "round(coalesce(x2.x2, 0) - 2 * coalesce(d.dot, 0) + coalesce(q.c2, 0), 9)"
    return f"""(select si, cl, dist from (
  select s.si, ks.cl, {dist} dist, row_number() over (partition by s.si order by {dist}, ks.cl) rn
  from subj s cross join ks
  left join x2 on x2.si = s.si
  left join (select x.si, c.cl, sum(x.allele * c.c) dot from x join {centres} c using (vi) group by x.si, c.cl) d
         on d.si = s.si and d.cl = ks.cl
  left join (select cl, sum(c * c) c2 from {centres} group by cl) q on q.cl = ks.cl) t where rn = 1)"""


def kmeans_sql(source: str, k: int, rounds: bool = True, c0_sql: list[str] | None = None) -> list[str]:
    """CTEs for wide k-means until no centre moves by more than the tolerance: the final assignment ``a(si, cl, dist)``.

    The recursion carries the centres of a round and how far they moved; ``ended(rounds)`` is their
    number.  Without ``rounds`` the assignment is that to the initial centres.  ``c0_sql`` optionally
    replaces these (CTEs ending in ``c0(cl, vi, c)``).  Needs ``WITH RECURSIVE``.
    """
    parts = [p.replace("x AS (", "x AS MATERIALIZED (") if p.startswith("x AS (") else p for p in sql_indexed(source)] + [
        "x2 AS MATERIALIZED (select si, sum(allele * allele) x2 from x group by si)",
        f"ks AS (select range cl from range({k}))",
    ] + (c0_sql if c0_sql else [f"c0 AS (select si cl, vi, allele c from x where si < {k})"])
    if not rounds:
        return parts + [f"a AS {_nearest_sql('c0')}"]
    return parts + [f"""cen AS (select cast(0 as bigint) r, cl, vi, c, cast('infinity' as double) moved from c0
  union all (with near as {_nearest_sql('cen')}, sz as (select cl, count(*) n from near group by cl),
    fresh as (select a.cl, x.vi, sum(x.allele) / max(sz.n) c from x join near a using (si) join sz on sz.cl = a.cl group by a.cl, x.vi),
    far as (select max(d) moved from (select cl, sqrt(sum((coalesce(f.c, 0) - coalesce(o.c, 0)) * (coalesce(f.c, 0) - coalesce(o.c, 0)))) d
      from fresh f full join (select cl, vi, c from cen) o using (cl, vi) group by cl) g)
  select (select max(r) from cen) + 1, fresh.cl, fresh.vi, fresh.c, far.moved from fresh, far
  where (select max(moved) from cen) > {KMEANS_TOL}))""",
                    "ended AS (select max(r) rounds from cen)",
                    "c_last AS MATERIALIZED (select cl, vi, c from cen, ended where r = rounds)",
                    f"a AS MATERIALIZED {_nearest_sql('c_last')}"]
