"""Reads derived from the order tables, by expressions that Spark and other SQL engines evaluate alike.

Every customer has a genome of 256 bases, every order is a read pair from its customer's genome: two
mates of 60 bases, 150 apart. Orders with a key divisible by 7 come from a copy of the genome with five
substitutions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The genome of a customer, as SQL over c_custkey, in the dialect of both engines.
HEX, LETTERS = "0123456789abcdef", "ACGTACGTACGTACGT"
_PARTS = " || ".join(f"md5(cast({{key}} as {{text}}) || '#{i}')" for i in range(8))
_SPOTS = (17, 67, 117, 167, 217)
#: The first mate of every 17th fragment has an ambiguous symbol, each of them in turn, every fifth read a base of quality 0.
_AMBIGUOUS = "CASE WHEN role = 'R1' AND fragment_id % 17 = 0 THEN substr(s, 1, cast(fragment_id % 60 as int)) || substr('RYSWKMBDHVN', cast(fragment_id % 11 as int) + 1, 1) || substr(s, cast(fragment_id % 60 as int) + 2) ELSE s END"
_QUALITY = "CASE WHEN (fragment_id + ascii(substr(role, 2, 1))) % 5 = 0 THEN repeat('I', cast(fragment_id * 31 % 60 as int)) || '!' || repeat('I', 59 - cast(fragment_id * 31 % 60 as int)) ELSE repeat('I', 60) END"


def genome_sql(key: str, text: str) -> str:
    return f"translate({_PARTS.format(key=key, text=text)}, '{HEX}', '{LETTERS}')"


def minor_sql(g: str) -> str:
    """The copy of a genome with a substitution at every spot."""
    parts, at = [], 1
    for spot in _SPOTS:
        parts += [f"substr({g}, {at}, {spot + 1 - at})", f"translate(substr({g}, {spot + 1}, 1), 'ACGT', 'CGTA')"]
        at = spot + 2
    return " || ".join([*parts, f"substr({g}, {at})"])


def reads_cte(text: str = "varchar") -> str:
    """CTEs `truths` (molecule, truth_class, seq), `sampled` and `reads` (fragment_id, lane, role, seq, qual)."""
    return f"""
  g AS (SELECT c_custkey, {genome_sql("c_custkey", text)} AS g0 FROM customer),
  both_copies AS (SELECT c_custkey, g0, {minor_sql("g0")} AS g1 FROM g),
  truths AS (SELECT c_custkey AS molecule, 'primary' AS truth_class, g0 AS seq FROM both_copies UNION ALL SELECT c_custkey, 'minor', g1 FROM both_copies),
  sampled AS (
    SELECT o_orderkey AS fragment_id, cast(o_custkey % 3 as int) AS lane,
           cast((o_orderkey * 7919 + o_custkey * 104729) % 107 as int) AS st,
           CASE WHEN o_orderkey % 7 = 0 THEN g1 ELSE g0 END AS g
    FROM orders JOIN both_copies ON o_custkey = c_custkey),
  mates AS (
    SELECT fragment_id, lane, 'R1' AS role, substr(g, st + 1, 60) AS s FROM sampled
    UNION ALL
    SELECT fragment_id, lane, 'R2' AS role, reverse(translate(substr(g, st + 91, 60), 'ACGT', 'TGCA')) AS s FROM sampled),
  reads AS (
    SELECT fragment_id, lane, role, {_AMBIGUOUS} AS seq, {_QUALITY} AS qual FROM mates)"""


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    # Customers are dealt out by their keys, and genomes are made in the tasks of the join: the planner takes them for short
    # strings, and would send those of all customers through the driver to every task.
    made = reads_cte("string").replace("FROM orders", "FROM {orders}").replace("FROM customer)", "FROM {customer})").replace("SELECT o_orderkey", "SELECT /*+ MERGE(both_copies) */ o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").repartition("c_custkey")
    return spark.sql(f"WITH {made} {query}", orders=orders, customer=customer)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fragment_id, lane, role, seq, qual."""
    return _sql(spark, sf_dir, "SELECT * FROM reads")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fragment_id, lane, reads: both mates in one row, so no shuffle is needed to bring them together."""
    first, second = (f"named_struct('role', '{r}', 'seq', {_AMBIGUOUS.replace('role', repr(r)).replace('substr(s,', f'substr({s},').replace('ELSE s END', f'ELSE {s} END')}, 'qual', {_QUALITY.replace('role', repr(r))})" for r, s in (("R1", "s1"), ("R2", "s2")))
    return _sql(
        spark,
        sf_dir,
        f"""SELECT fragment_id, lane, array({first}, {second}) AS reads
        FROM (SELECT fragment_id, lane, substr(g, st + 1, 60) AS s1, reverse(translate(substr(g, st + 91, 60), 'ACGT', 'TGCA')) AS s2 FROM sampled)""",
    )


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """molecule, truth_class, seq: each customer's genome and its copy."""
    return _sql(spark, sf_dir, "SELECT * FROM truths")
