"""Projects, part lists and stock derived from the benchmark's star schema by SQL that any engine runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Mantissas of the E12 series.
_MANTISSA = "CASE l_partkey % 12 WHEN 0 THEN '1' WHEN 1 THEN '1.2' WHEN 2 THEN '1.5' WHEN 3 THEN '1.8' WHEN 4 THEN '2.2' WHEN 5 THEN '2.7' WHEN 6 THEN '3.3' WHEN 7 THEN '3.9' WHEN 8 THEN '4.7' WHEN 9 THEN '5.6' WHEN 10 THEN '6.8' ELSE '8.2' END"
_OHMS = f"CASE WHEN l_suppkey % 7 = 6 THEN '4k7' ELSE {_MANTISSA} || CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'k' WHEN 2 THEN 'M' ELSE '00' END END"
_FARADS = f"CASE WHEN l_suppkey % 9 = 8 THEN '100n' ELSE {_MANTISSA} || CASE l_suppkey % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'u' WHEN 2 THEN 'p' ELSE '00nF' END END"
_N = "CAST(l_linenumber AS STRING)"
_T = "CAST(l_linenumber * 10 AS STRING)"
_KIND = "(l_partkey + l_linenumber) % 16"

#: A line of a project's part list for each lineitem; (at1 .. at4) orders a project's lines.
LINES = f"""
    SELECT l_orderkey AS slot, l_linenumber AS at1, l_partkey AS at2, l_suppkey AS at3, l_extendedprice AS at4,
      CASE {_KIND}
        WHEN 0 THEN 'R' || {_N} || ' ' || {_OHMS}
        WHEN 1 THEN 'C' || {_N} || ', ' || {_FARADS}
        WHEN 2 THEN 'D' || {_N} || ' ' || CASE l_partkey % 4 WHEN 0 THEN '1N4148' WHEN 1 THEN '1N914' WHEN 2 THEN '1N34A' ELSE 'LED' END
        WHEN 3 THEN 'Q' || {_N} || ' ' || CASE l_partkey % 4 WHEN 0 THEN '2N5457' WHEN 1 THEN 'MMBF5457' WHEN 2 THEN '2N3904' ELSE 'BC550C' END
        WHEN 4 THEN 'IC' || {_N} || ' ' || CASE l_partkey % 5 WHEN 0 THEN 'TL072CP' WHEN 1 THEN 'JRC4558' WHEN 2 THEN 'NE5532N' WHEN 3 THEN 'L78L05' ELSE 'LM308N' END
        WHEN 5 THEN 'volume ' || CASE l_partkey % 4 WHEN 0 THEN 'B100K' WHEN 1 THEN 'A1M' WHEN 2 THEN '10k-C' ELSE '20k' END
        WHEN 6 THEN 'MODE ' || CASE l_partkey % 3 WHEN 0 THEN 'SPDT' WHEN 1 THEN 'ON-ON' ELSE '10' END
        WHEN 7 THEN 'X' || {_N} || ' 16MHz'
        WHEN 8 THEN 'R' || {_T} || '-R' || CAST(l_linenumber * 10 + l_partkey % 6 - 1 AS STRING) || ' ' || {_OHMS}
        WHEN 9 THEN 'C' || {_T} || '-' || CAST(l_linenumber * 10 + l_suppkey % 60 AS STRING) || ' ' || {_FARADS}
        WHEN 10 THEN 'J' || {_N} || ' ' || CASE l_partkey % 3 WHEN 0 THEN 'JACK' WHEN 1 THEN 'ADAPTER' ELSE 'SOCKET8' END
        WHEN 11 THEN 'LDR' || {_N} || ' 5mm'
        WHEN 12 THEN 'PCB ' || CASE l_partkey % 3 WHEN 0 THEN 'Delay PCB' WHEN 1 THEN 'Big Fuzz' ELSE 'Chorus' END
        WHEN 13 THEN CASE l_partkey % 4 WHEN 0 THEN 'PCB' WHEN 1 THEN '* see step 3' WHEN 2 THEN 'Diodes: 4' ELSE '** ERROR **' END
        WHEN 14 THEN 'BIG DRIVE PCB v' || CAST(l_suppkey % 3 AS STRING)
        ELSE 'CLR ' || {_OHMS}
      END AS line
    FROM {{lineitem}}
"""

PROJECTS = """
    SELECT o_orderkey AS slot, 1 + o_custkey % 3 AS count,
      CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'PedalPCB ' || CAST(o_custkey % 50 AS STRING)
        WHEN 2 THEN 'Tayda: ' || CAST(o_custkey % 50 AS STRING) ELSE 'Own/' || CAST(o_custkey AS STRING) || '?' END AS name
    FROM {orders}
"""

STOCK = """
    SELECT CASE p_partkey % 5 WHEN 0 THEN 'Resistors' WHEN 1 THEN 'Capacitors' WHEN 2 THEN 'Diodes' WHEN 3 THEN 'ICs' ELSE ' ' END AS Category,
      CASE p_partkey % 5 WHEN 0 THEN ' ' || CAST(1 + p_size % 9 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) || 'k '
        WHEN 1 THEN CAST(p_size AS STRING) || 'nF 63V' WHEN 2 THEN '1N4148' WHEN 3 THEN 'TL072CP' ELSE 'x' END AS Part,
      CASE WHEN p_partkey % 11 = 0 THEN 'many' WHEN p_partkey % 13 = 0 THEN '-3' ELSE CAST(p_size AS STRING) END AS Qty
    FROM {part}
"""

#: Values over the whole range of units and forms.
VALUES = f"""
    SELECT DISTINCT CASE WHEN l_suppkey % 13 = 12 THEN CAST(l_partkey % 10 AS STRING) || 'k' || CAST(l_linenumber AS STRING)
        ELSE {_MANTISSA} || CASE l_suppkey % 12 WHEN 0 THEN '' WHEN 1 THEN 'k' WHEN 2 THEN 'M' WHEN 3 THEN 'n' WHEN 4 THEN 'u' WHEN 5 THEN 'p' WHEN 6 THEN '00nF'
          WHEN 7 THEN ' uF 16V' WHEN 8 THEN 'K' WHEN 9 THEN '.5' WHEN 10 THEN '5mm' ELSE 'R5' END END AS value
    FROM {{lineitem}}
"""

#: Keys of a preset library.
PRESET_KEYS = """
    SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN '[PedalPCB] [Fuzz] Box ' WHEN 1 THEN '[Tayda] [Boost] Box ' WHEN 2 THEN '[Tayda] Box ' ELSE 'Box ' END || CAST(o_custkey % 40 AS STRING) AS key
    FROM {orders}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, source, ordinal, line). The table is one file of one row group, hence one task, so it is dealt out first, by
    project: what looks within a project then needs no exchange, and the dealt columns are all that goes to disk."""
    raw = spark.sql(LINES, lineitem=table(spark, sf_dir, "lineitem").repartition("l_orderkey"))
    return raw.select("slot", F.lit("BOM").alias("source"), F.struct("at1", "at2", "at3", "at4").alias("ordinal"), "line")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, count, name, source): blank names give way to a numbered placeholder."""
    p = spark.sql(PROJECTS, orders=table(spark, sf_dir, "orders"))
    return p.withColumn("source", F.when(F.trim("name") != "", F.col("name")).otherwise(F.concat(F.lit("Project #"), (F.col("slot") + 1).cast("string"))))


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STOCK, part=table(spark, sf_dir, "part"))
