"""Readers.  Parquet for driver tables; CSV always with an explicit schema
(inference costs a pass and changes types when the data changes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators.lookup import parse_stacked_lookup
from wardline.operators.order import rank_in_order

# Medication columns of the encounter file.
DRUG_COLUMNS = [
    "metformin", "repaglinide", "nateglinide", "chlorpropamide", "glimepiride",
    "acetohexamide", "glipizide", "glyburide", "tolbutamide", "pioglitazone",
    "rosiglitazone", "acarbose", "miglitol", "troglitazone", "tolazamide",
    "examide", "citoglipton", "insulin", "glyburide-metformin",
    "glipizide-metformin", "glimepiride-pioglitazone", "metformin-rosiglitazone",
    "metformin-pioglitazone",
]

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()

ENCOUNTER_SCHEMA = T.StructType(
    [T.StructField("encounter_id", _L), T.StructField("patient_nbr", _L),
     T.StructField("race", _S), T.StructField("gender", _S), T.StructField("age", _S),
     T.StructField("weight", _S), T.StructField("admission_type_id", _I),
     T.StructField("discharge_disposition_id", _I), T.StructField("admission_source_id", _I),
     T.StructField("time_in_hospital", _I), T.StructField("payer_code", _S),
     T.StructField("medical_specialty", _S), T.StructField("num_lab_procedures", _I),
     T.StructField("num_procedures", _I), T.StructField("num_medications", _I),
     T.StructField("number_outpatient", _I), T.StructField("number_emergency", _I),
     T.StructField("number_inpatient", _I), T.StructField("diag_1", _S),
     T.StructField("diag_2", _S), T.StructField("diag_3", _S),
     T.StructField("number_diagnoses", _I), T.StructField("max_glu_serum", _S),
     T.StructField("A1Cresult", _S)]
    + [T.StructField(c, _S) for c in DRUG_COLUMNS]
    + [T.StructField("change", _S), T.StructField("diabetesMed", _S),
       T.StructField("readmitted", _S)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str = ENCOUNTER_SCHEMA,
             **options) -> DataFrame:
    """CSV with a header and a declared schema."""
    return spark.read.options(header=True, **options).schema(schema).csv(path)


def read_lookup_file(spark: SparkSession, path: str) -> DataFrame:
    """Lookup files that each stack several ``code,description`` sections.

    Files are read in Spark's usual splits.  Within a split lines come in order,
    and splits know where in their file they start; a two-level scan turns that
    into line numbers, so no file has to fit one task."""
    raw = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_nth"))
    lines = rank_in_order(raw, ["_file"], ["_start", "_nth"], "pos").where(F.length("line") > 0)
    return parse_stacked_lookup(lines, source="_file")
