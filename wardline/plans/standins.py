"""Stand-in inputs built from the driver tables.

The reference's encounter file is not available, so each stand-in gives rows
in the schema the operators expect, derived from a driver table so the work
grows with it.  A stand-in does none of the operators' work.  Each is one SQL
text: Spark runs it with DataFrame parameters (``spark.sql(text, orders=df)``)
and the DuckDB oracle runs the same text over its views.

Mapping: encounters <- orders (encounter = order, patient = customer, all
columns of the encounter file); code lookups <-
region, nation and customer; scores <- events; vectors <- embeddings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import spread
from wardline.sources.tables import DRUG_COLUMNS, ENCOUNTER_SCHEMA, read_table


def _icd(k: str) -> str:
    """An ICD-9-like code string (numeric, decimal, V/E prefixed or '?') from an integer."""
    return f"""CASE WHEN ({k}) % 53 = 0 THEN '?'
       WHEN ({k}) % 53 = 1 THEN concat('V', lpad(CAST(({k}) % 90 AS STRING), 2, '0'))
       WHEN ({k}) % 53 = 2 THEN concat('E', CAST(800 + ({k}) % 200 AS STRING))
       WHEN ({k}) % 3 = 0 THEN concat(CAST(({k}) % 1000 AS STRING), '.', CAST(({k}) % 10 AS STRING))
       ELSE CAST(({k}) % 1000 AS STRING) END"""


def _dose(i: int, drug: str) -> str:
    """Dose flags of one drug column: mostly 'No', each column in its own
    rhythm, some unknown; two columns never vary."""
    if drug in ("examide", "citoglipton"):
        return "'No'"
    if drug == "metformin":
        return """CASE o_orderpriority WHEN '1-URGENT' THEN 'Up' WHEN '2-HIGH' THEN ' Steady '
       WHEN '3-MEDIUM' THEN 'No' WHEN '4-NOT SPECIFIED' THEN '?' ELSE 'DOWN' END"""
    if drug == "insulin":
        return "CASE o_orderkey % 4 WHEN 0 THEN 'No' WHEN 1 THEN 'Steady' WHEN 2 THEN 'Up' ELSE 'Down' END"
    return (f"CASE (o_orderkey * {i + 3} + o_custkey) % {11 + i} WHEN 0 THEN 'Steady' WHEN 1 THEN 'Up' WHEN 2 THEN 'down' "
            f"WHEN 3 THEN NULL ELSE 'No' END")


DRUGS_SQL = ",\n  ".join(f"{_dose(i, c)} AS `{c}`" for i, c in enumerate(DRUG_COLUMNS))
_COLUMNS = ", ".join(f"`{c}`" for c in ENCOUNTER_SCHEMA.fieldNames() if c != "readmitted")

# The outcome follows from utilisation, age and chance (``noise``, 0 to 999), so
# features carry a signal and none is made from the outcome.
ENCOUNTERS = f"""
SELECT {_COLUMNS},
  CASE WHEN noise < 30 + 45 * number_inpatient + 40 * number_emergency + 4 * time_in_hospital
            + CASE WHEN age >= '[7' THEN 40 ELSE 0 END THEN '<30'
       WHEN noise < 450 THEN '>30' WHEN noise = 999 THEN NULL ELSE 'NO' END AS readmitted
FROM (
SELECT
  CAST(floor(((o_orderkey * 7919 + o_custkey * 104729) % 99991) * 1000 / 99991) AS INT) AS noise,
  o_orderkey AS encounter_id,
  CASE WHEN o_orderkey % 211 = 3 THEN NULL ELSE o_custkey END AS patient_nbr,
  CASE WHEN o_orderkey % 151 = 9 THEN NULL ELSE
  CASE o_custkey % 7 WHEN 0 THEN '?' WHEN 1 THEN 'AfricanAmerican' WHEN 2 THEN 'Hispanic'
       WHEN 3 THEN 'Asian' ELSE 'Caucasian' END END AS race,
  CASE WHEN o_orderkey % 97 = 5 THEN 'Unknown/Invalid' WHEN o_orderkey % 97 = 6 THEN NULL
       WHEN o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  concat('[', CAST(10 * (o_custkey % 10) AS STRING), '-',
         CAST(10 * (o_custkey % 10) + 10 AS STRING), ')') AS age,
  CASE WHEN o_orderkey % 33 = 0 THEN '[75-100)' ELSE '?' END AS weight,
  CAST(o_orderkey % 6 AS INT) AS admission_type_id,
  CASE WHEN o_orderkey % 123 = 7 THEN NULL ELSE CAST(floor(sqrt(o_orderkey % 900)) + 1 AS INT) END
    AS discharge_disposition_id,
  CAST(CASE WHEN o_orderkey % 50 = 0 THEN 900000000 + o_orderkey % 7 ELSE o_custkey END AS INT) AS admission_source_id,
  CAST(o_orderkey % 14 + 1 AS INT) AS time_in_hospital,
  CASE o_custkey % 5 WHEN 0 THEN '?' WHEN 1 THEN 'MC' WHEN 2 THEN 'HM' ELSE 'SP' END AS payer_code,
  CASE o_orderkey % 13 WHEN 0 THEN '?' WHEN 1 THEN 'Cardiology' WHEN 2 THEN 'Surgery-General'
       WHEN 3 THEN 'Family/GeneralPractice' WHEN 4 THEN 'Emergency/Trauma' WHEN 5 THEN NULL
       ELSE 'InternalMedicine' END AS medical_specialty,
  CAST(year(o_orderdate) - 1990 AS INT) AS num_lab_procedures,
  CAST(o_orderkey % 7 AS INT) AS num_procedures,
  CAST(floor(o_totalprice / 10000) AS INT) AS num_medications,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 4 ELSE 0 END AS INT) AS number_outpatient,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS INT) AS number_emergency,
  CAST(CASE (o_orderkey + o_custkey) % 9 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 0 END AS INT)
    AS number_inpatient,
  {_icd('o_orderkey')} AS diag_1,
  {_icd('o_orderkey * 7 + o_custkey')} AS diag_2,
  {_icd('o_custkey * 13 + o_orderkey % 17')} AS diag_3,
  CAST(o_orderkey % 9 + 1 AS INT) AS number_diagnoses,
  CASE o_orderkey % 8 WHEN 0 THEN '>200' WHEN 1 THEN 'Norm' ELSE 'None' END AS max_glu_serum,
  CASE o_custkey % 6 WHEN 0 THEN '>7' WHEN 1 THEN '>8' ELSE 'None' END AS `A1Cresult`,
  {DRUGS_SQL},
  CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'Ch' ELSE 'No' END AS change,
  CASE WHEN o_orderkey % 4 = 0 THEN 'No' ELSE 'Yes' END AS `diabetesMed`
FROM {{{{orders}}}}) raw
"""

# Raw lines of a stacked lookup file: three sections, each opened by a header
# line; code 1 maps to a different description in each section.  The third
# section (one code per customer, quoted descriptions holding a comma, some of
# them placeholders or missing) grows with the data.
LOOKUP_LINES = """
SELECT CAST(0 AS BIGINT) AS pos, 'admission_type_id,description' AS line
UNION ALL SELECT CAST(1 + r_regionkey AS BIGINT), concat(CAST(r_regionkey AS STRING), ',', r_name)
  FROM {region}
UNION ALL SELECT CAST(10 AS BIGINT), ','
UNION ALL SELECT CAST(11 AS BIGINT), 'discharge_disposition_id,description'
UNION ALL SELECT CAST(12 + n_nationkey AS BIGINT),
  concat(CAST(n_nationkey + 1 AS STRING), ',', n_name) FROM {nation}
UNION ALL SELECT CAST(100 AS BIGINT), ','
UNION ALL SELECT CAST(101 AS BIGINT), 'admission_source_id,description'
UNION ALL SELECT CAST(102 + c_custkey AS BIGINT),
  CASE c_custkey % 20 WHEN 3 THEN concat(CAST(c_custkey AS STRING), ',Not Mapped')
       WHEN 4 THEN concat(CAST(c_custkey AS STRING), ',Not Available') WHEN 5 THEN concat(CAST(c_custkey AS STRING), ',NULL')
       ELSE concat(CAST(c_custkey AS STRING), ',"', c_name, ', ', c_mktsegment, '"') END
  FROM {customer}
"""

# Score frame: key, label 0/1, two models' probabilities, a subgroup.
SCORES = """
SELECT event_id AS key,
       CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS INT) AS label,
       value / (value + 100.0) AS p,
       CAST(user_id % 10 AS DOUBLE) / 10.0 AS p2,
       concat('g', CAST(user_id % 4 AS STRING)) AS subgroup
FROM {events}
"""

# Vector frame: key, label (class 7 is the minority), features as array<double>.
VECTORS = """
SELECT vec_id AS key, CAST(CASE WHEN label = 7 THEN 1 ELSE 0 END AS INT) AS label,
       CAST(embedding AS ARRAY<DOUBLE>) AS features
FROM {embeddings}
"""

_TABLES = ("orders", "region", "nation", "events", "embeddings", "customer", "part", "lineitem")


def _tables_in(sql: str) -> list[str]:
    return [t for t in _TABLES if "{" + t + "}" in sql]


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a stand-in SQL text on Spark with the driver tables as parameters."""
    return spark.sql(sql, **{t: read_table(spark, sf_dir, t) for t in _tables_in(sql)})


def duck(sql: str) -> str:
    """The same stand-in text for the DuckDB oracle (plain view names)."""
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("ARRAY<DOUBLE>", "DOUBLE[]").replace("`", '"')


def encounters(spark: SparkSession, sf_dir: str, over_cores: bool = False) -> DataFrame:
    """``over_cores``: orders in few files are dealt over all cores, for costly work on each row."""
    orders = read_table(spark, sf_dir, "orders")
    return spark.sql(ENCOUNTERS_SQL, orders=spread(orders) if over_cores else orders)


def lookup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, LOOKUP_LINES)


def lookup_files(spark: SparkSession, sf_dir: str, path: str, buckets: int = 8) -> None:
    """The lookup lines as text files under ``path``: the long third section is
    dealt over all files, each with its header line."""
    lines = lookup_lines(spark, sf_dir).withColumn("part", F.when(F.col("pos") > 101, F.col("pos") % buckets).otherwise(F.lit(0)))
    headers = lines.where("pos = 101").withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(buckets - 1).cast("long"))))
    dealt = lines.unionByName(headers).repartition(buckets, "part").sortWithinPartitions("part", "pos")
    dealt.select("part", F.col("line").alias("value")).write.partitionBy("part").text(path)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, SCORES)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, VECTORS)


ENCOUNTERS_SQL = ENCOUNTERS.replace("{{orders}}", "{orders}")
