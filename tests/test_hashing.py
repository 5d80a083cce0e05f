"""The seeded hash: the same number in Spark and SQL, and evenly spread."""

import duckdb
from pyspark.sql import functions as F

from allelo.functions import hashing


def test_sql_twin(spark):
    rows = [(0, 0, "S1"), (1, 2, "S2"), (7, 10**12, ""), (2**31, 5, "é"), (123456789, 987654321, "long " * 50)]
    df = spark.createDataFrame(rows, "a long, b long, t string")
    got = [tuple(r) for r in df.select(hashing.mixed(5, F.col("a")), hashing.mixed(F.col("a"), F.col("b"), F.col("a")),
                                       hashing.mixed(9, hashing.text_key(F.col("t")))).collect()]
    con = duckdb.connect()
    con.execute("create table x (a bigint, b bigint, t varchar)")
    con.executemany("insert into x values (?, ?, ?)", rows)
    want = con.execute(f"""select {hashing.mixed_sql(5, 'a')}, {hashing.mixed_sql('a', 'b', 'a')},
        {hashing.mixed_sql(9, hashing.text_key_sql('t'))} from x""").fetchall()
    assert sorted(got) == sorted(want)
    assert all(0 <= v < hashing.SPACE for r in got for v in r)


def test_spread(spark):
    n = 20_000
    h = hashing.mixed(3, F.col("id"), F.lit(1))
    deciles = [r["count"] for r in spark.range(n).groupBy((h * 10 / hashing.SPACE).cast("int")).count().collect()]
    assert len(deciles) == 10 and max(abs(c - n / 10) for c in deciles) < 6 * (n / 10) ** 0.5
    drawn = spark.range(n).select(h % n).distinct().count()
    assert abs(drawn / n - 0.632) < 0.02  # draws with replacement
