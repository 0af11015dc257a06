"""Projections of the test tables into the shapes that the operators take.

Only whole-number arithmetic is used, so the same rows come out of any SQL engine. The SQL text of each
projection stands beside it for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CIGAR = """concat(
  CASE o_orderkey % 3 WHEN 1 THEN concat(5 + o_orderkey % 50, 'S') WHEN 2 THEN concat(3 + o_orderkey % 9, 'H', 5 + o_orderkey % 50, 'S') ELSE '' END,
  100 + o_orderkey % 900, 'M', 30 + o_custkey % 40, 'D', 50 + o_orderkey % 100, 'M', 25 + o_orderkey % 60, 'I', 10 + o_orderkey % 30, 'M',
  CASE WHEN o_orderkey % 7 = 0 THEN '20N' ELSE '' END, 60 + o_orderkey % 200, 'M', 38 + o_orderkey % 5, 'D', 40 + o_custkey % 200, 'M',
  CASE WHEN o_orderkey % 2 = 0 THEN concat(3 + o_orderkey % 20, 'S') ELSE '' END)"""

SIG_SQL = """SELECT 'chr' || (l_partkey % 5 + 1) AS contig, l_partkey * 5000 + CAST(l_quantity AS BIGINT) * 20 AS start,
  50 + (l_partkey % 40) * 50 + l_orderkey % 97 AS svlen, 'r' || l_orderkey AS read_name,
  CASE WHEN l_returnflag = 'R' THEN 'split' ELSE 'cigar' END AS source,
  CASE l_linenumber % 4 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' WHEN 2 THEN 'DUP' ELSE 'INV' END AS svtype, CAST(l_linenumber AS BIGINT) AS ord
  FROM lineitem"""

READS_SQL = f"""SELECT o_orderkey AS read_ordinal, 'r' || o_orderkey AS read_name, 'chr' || (o_custkey % 5 + 1) AS contig,
  CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 16 ELSE 2048 END AS INT) AS flag, (o_orderkey * 7919) % 2000000 AS ref_start,
  (o_orderkey * 7919) % 2000000 + 1000 + o_orderkey % 9000 AS ref_end, 1000 + o_orderkey % 9000 AS query_len,
  CAST(o_custkey % 61 AS INT) AS mapq, {CIGAR} AS cigar, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 300 AS BIGINT) END AS nm
  FROM orders"""

SEGMENTS_SQL = """SELECT 'r' || l_orderkey AS read_name, CAST(l_linenumber * 1500 + l_suppkey % 40 AS BIGINT) AS q_start,
  CAST(l_linenumber * 1500 + l_suppkey % 40 + 150 + CAST(l_quantity AS BIGINT) * 25 AS BIGINT) AS q_end,
  (l_orderkey * 1009) % 1000000 + l_linenumber * 1500 + (l_partkey % 23) * 90 AS r_start,
  (l_orderkey * 1009) % 1000000 + l_linenumber * 1500 + (l_partkey % 23) * 90 + 150 + CAST(l_quantity AS BIGINT) * 25 AS r_end,
  CAST(l_partkey % 61 AS INT) AS mapq, CASE WHEN l_suppkey % 9 = 0 THEN 'chr10' ELSE 'chr2' END AS contig,
  CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, CAST(l_partkey AS BIGINT) AS tie, CAST(l_suppkey AS BIGINT) AS tie2
  FROM lineitem"""

TRIO_SQL = """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'father' WHEN 1 THEN 'mother' ELSE 'child' END AS sample, o_orderkey AS rec_ordinal,
  'chr' || (o_custkey % 5 + 1) AS chrom, CASE o_custkey % 4 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' WHEN 2 THEN 'DUP' ELSE 'INV' END AS svtype,
  o_custkey * 6000 + o_orderkey % 6000 AS pos, 50 + (o_custkey % 50) * 40 + o_orderkey % 60 AS svlen,
  o_custkey * 6000 + o_orderkey % 6000 + 50 + (o_custkey % 50) * 40 + o_orderkey % 60 AS "end",
  CASE o_orderstatus WHEN 'F' THEN '0/1' WHEN 'O' THEN '1/1' ELSE './.' END AS gt FROM orders"""

BND_SQL = """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'father' WHEN 1 THEN 'mother' ELSE 'child' END AS sample, o_orderkey AS rec_ordinal,
  'chr' || (o_custkey % 3 + 1) AS chrom, 'chr' || (o_custkey % 2 + 4) AS chr2, 'BND' AS svtype, CAST(0 AS BIGINT) AS svlen,
  CASE o_custkey % 4 WHEN 0 THEN ']]N' WHEN 1 THEN '[[N' WHEN 2 THEN 'N]]' ELSE 'N[[' END AS form,
  o_custkey * 6000 + o_orderkey % 3000 AS pos, o_custkey * 4000 + o_orderkey % 2500 AS "end",
  CASE o_orderstatus WHEN 'F' THEN '0/1' WHEN 'O' THEN '1/1' ELSE './.' END AS gt FROM orders"""

CALLS_SQL = f"""SELECT sample, rec_ordinal * 2 AS rec_ordinal, chrom, pos, "end", svlen, svtype, CAST(NULL AS VARCHAR) AS chr2, CAST(NULL AS VARCHAR) AS form, gt FROM ({TRIO_SQL}) t
  UNION ALL SELECT sample, rec_ordinal * 2 + 1 AS rec_ordinal, chrom, pos, "end", svlen, svtype, chr2, form, gt FROM ({BND_SQL}) b"""

WINDOWS_SQL = f"""SELECT contig, start // 2000 * 2000 AS window_start, (count(*) % 100) / 100.0 AS prob FROM ({SIG_SQL}) GROUP BY ALL"""

INTERVALS_SQL = """SELECT 'chr' || (p_partkey % 4 + 1) AS contig, p_partkey * 5000 AS start, p_partkey * 5000 + p_size * 40 AS "end" FROM part"""

TEXT_SQL = """SELECT o_orderkey AS id,
  concat('SVLEN=', CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '' END, o_custkey % 900, CASE WHEN o_orderkey % 6 = 0 THEN '.7' ELSE '' END, ';PRECISE;SVTYPE=', CASE o_custkey % 6 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' WHEN 2 THEN 'DUP:TANDEM' WHEN 3 THEN 'INV' WHEN 4 THEN 'tra' ELSE 'BND' END, ';END=', CASE WHEN o_orderkey % 8 = 0 THEN 'none' ELSE CAST(o_orderkey * 3 AS VARCHAR) END, ';CHR2=chr', o_custkey % 20, ';') AS info,
  CASE o_orderkey % 5 WHEN 0 THEN concat(']chr', o_custkey % 9, ':', o_orderkey, ']N') WHEN 1 THEN concat('[chr', o_custkey % 9, ':', o_orderkey, '[N') WHEN 2 THEN concat('N]chr', o_custkey % 9, ':', o_orderkey, ']') WHEN 3 THEN concat('N[chr', o_custkey % 9, ':', o_orderkey, '[') ELSE '<DEL>' END AS alt,
  CASE o_custkey % 3 WHEN 0 THEN 'GT:DR:DV' WHEN 1 THEN 'DR:GT:DV' ELSE 'DR:DV' END AS format,
  concat(CASE o_orderkey % 4 WHEN 0 THEN '0|1' WHEN 1 THEN './.' WHEN 2 THEN '1/1' ELSE '.' END, ':', CASE o_orderkey % 3 WHEN 0 THEN '1|1' WHEN 1 THEN '0/1' ELSE '.|.' END, ':7') AS sample FROM orders"""

#: Names of the projections and the tables they read.
PROJECTIONS = {"sig": (SIG_SQL, "lineitem"), "reads": (READS_SQL, "orders"), "segments": (SEGMENTS_SQL, "lineitem"), "trio": (TRIO_SQL, "orders"), "bnd": (BND_SQL, "orders"), "calls": (CALLS_SQL, "orders"), "intervals": (INTERVALS_SQL, "part"), "texts": (TEXT_SQL, "orders")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame; its text is ANSI SQL but for the quotes of names and VARCHAR."""
    sql, source = PROJECTIONS[name]
    sql = sql.replace('"end"', "`end`").replace("AS VARCHAR", "AS STRING").replace(f"FROM {source}", "FROM {source}")
    return spark.sql(sql, source=table(spark, sf_dir, source))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability for each 2000-base window that has a signature."""
    sig = projection(spark, sf_dir, "sig")
    grid = sig.groupBy("contig", (F.floor(F.col("start") / 2000) * 2000).alias("window_start")).agg(F.count("*").alias("n"))
    return grid.select("contig", "window_start", (F.col("n") % 100 / 100.0).alias("prob"))


def with_ctes(*names: str) -> str:
    """A WITH clause of projections for the oracles."""
    return "WITH " + ", ".join(f"{n} AS ({PROJECTIONS[n][0] if n in PROJECTIONS else WINDOWS_SQL})" for n in names)
