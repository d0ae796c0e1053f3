"""End-to-end readmission pipeline, leak-free: everything fitted (patient
frequency, rare levels, vocabulary, scaler) is fitted on the training split
only and then applied to both splits.

    encounters -> clean (drop weight, '?' -> Unknown, gender / hospice filters)
    -> label, yes/no flags, dose ordinals, ICD groups, lookup of admission type
    -> stratified split -> drop dose columns that are constant in train
    -> fit on train: patient frequency, discharge rare-level bucket,
       one-hot vocabulary, population scaler
    -> apply to train and test -> feature vector
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import clean, encode, lookup, sample
from wardline.operators.folds import FoldEncoders, fit_fold_encoders
from wardline.operators.vocab import SparseEncoder, fit_encoder
from wardline.plans import standins as S
from wardline.session import materialize, spread
from wardline.sources.tables import DRUG_COLUMNS

EXCLUDED_DISCHARGE = [11, 19, 20, 21]
DRUGS = DRUG_COLUMNS
CATEGORICAL = ["race", "gender", "age", "admission_type_id", "disch_reduced", "medical_specialty",
               "diag_1_cat", "diag_2_cat", "diag_3_cat"]
NUMERIC = ["time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications",
           "number_outpatient", "number_emergency", "number_inpatient", "number_diagnoses",
           "patient_freq", "change", "diabetesMed"]


@dataclass
class Prepared:
    train: DataFrame            # encounter_id, label, features
    test: DataFrame
    encoder: SparseEncoder      # fitted on train: names, widths, vocabulary


def without_excluded(enc: DataFrame) -> DataFrame:
    """Rows of unknown gender and of death or hospice discharges go; a missing
    value stays."""
    return clean.exclude_codes(clean.exclude_value(enc, "gender", "Unknown/Invalid"),
                               "discharge_disposition_id", EXCLUDED_DISCHARGE)


def clean_encounters(enc: DataFrame, lookups: DataFrame) -> DataFrame:
    """Row-wise cleaning and coding (no fitted state)."""
    e = clean.drop_columns(enc, ["weight"])
    e = clean.replace_sentinel(e, "?", "Unknown")
    e = without_excluded(e)
    e = clean.binary_target(e, "readmitted", "<30")
    e = clean.yes_no_flags(e, {"change": "Ch", "diabetesMed": "Yes"})
    e = encode.encode_ordinal(e, DRUGS)
    e = encode.group_codes(e, ["diag_1", "diag_2", "diag_3"], fine=True)
    e = lookup.map_codes(e, "admission_type_id", lookups, section="admission_type_id",
                         fill="Other")
    return e


def clean_split(spark: SparkSession, sf_dir: str, seed: int = 42,
                test_size: float = 0.3) -> tuple[DataFrame, list[str], list[str]]:
    """(rows with is_test, category columns, numeric columns): everything up to
    the split, as a table in the shared checkpoint folder, so what is fitted on
    it reads a short plan.  Nothing here is fitted but the choice of dose columns,
    which looks at train alone: a constant one carries nothing."""
    enc = S.encounters(spark, sf_dir, over_cores=True)
    lk = lookup.parse_stacked_lookup(S.lookup_lines(spark, sf_dir))
    e = clean_encounters(enc, lk)
    e = e.withColumns({d: F.col(f"`{d}`").cast("int").cast("string") for d in DRUGS})
    used = [c for c in CATEGORICAL if c != "disch_reduced"] + [c for c in NUMERIC if c != "patient_freq"] + DRUGS
    e = e.select("encounter_id", "label", "patient_nbr", "discharge_disposition_id", *[F.col(f"`{c}`") for c in used])
    # the split reads its rows several times: a table, not the cleaning, and only keys and labels of it
    e = materialize(e, "clean")
    e = materialize(sample.split_stratified(e, "label", "encounter_id", test_size, seed), "clean-split")
    constant = clean.constant_column_names(e.where(F.col("is_test") == 0), DRUGS)
    return e.drop(*constant), CATEGORICAL + [d for d in DRUGS if d not in constant], list(NUMERIC)


def prepare(spark: SparkSession, sf_dir: str, seed: int = 42, test_size: float = 0.3) -> Prepared:
    """Both splits as sparse vectors, with everything fitted on train alone."""
    e, cats, nums = clean_split(spark, sf_dir, seed, test_size)
    train = e.where(F.col("is_test") == 0)
    e = encode.frequency_encode(e, "patient_nbr", "patient_freq", fit_on=train)
    e = encode.rare_bucket(e, "discharge_disposition_id", min_share=0.01, out="disch_reduced",
                           fit_on=train)
    e = materialize(e.select("encounter_id", "label", "is_test", *nums, *[F.col(f"`{c}`") for c in cats]), "encoded")
    train = e.where(F.col("is_test") == 0)
    x = encode.apply_scaler(spread(e), encode.fit_scaler(train, nums)).fillna(0.0, subset=nums)
    enc = fit_encoder(train, cats, nums)
    # the many fits that follow read this table, not the lineage
    tr, te = sample.train_test(enc.vectors(x, ["encounter_id", "label", "is_test"]))
    return Prepared(tr, te, enc)


def prepare_folds(spark: SparkSession, sf_dir: str, k: int, seed: int = 42) -> FoldEncoders:
    """The train split in k stratified folds, with encoders fitted per fold on
    the rows outside it: patient share, rare discharge levels, vocabulary,
    scaler."""
    e, cats, nums = clean_split(spark, sf_dir, seed)
    train, _ = sample.train_test(e)
    folded = materialize(sample.folds_stratified(train, k, "label", "encounter_id", seed), "folds")
    return fit_fold_encoders(folded, "encounter_id", "label", cats, nums, {"patient_freq": "patient_nbr"},
                             {"disch_reduced": ("discharge_disposition_id", 0.01)})


RAW = ["time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications", "number_outpatient",
       "number_emergency", "number_inpatient", "number_diagnoses", "change", "diabetesMed",
       "metformin", "insulin", "glipizide", "glyburide", "pioglitazone", "glyburide-metformin"]


def raw_features(spark: SparkSession, sf_dir: str, seed: int = 42,
                 as_table: bool = True) -> tuple[DataFrame, list[str]]:
    """Encounter rows before one-hot (for attribution over the original
    columns): encounter_id, label, is_test and the columns of ``RAW`` as numbers
    (an unknown dose counts as none).  Only what these columns need is computed.
    ``as_table`` writes them once as a table for callers that read them many
    times (model fits, scoring loops)."""
    e = without_excluded(S.encounters(spark, sf_dir))
    e = clean.yes_no_flags(clean.binary_target(e, "readmitted", "<30"), {"change": "Ch", "diabetesMed": "Yes"})
    doses = [c for c in RAW if c in DRUGS]
    e = encode.encode_ordinal(e, doses)
    e = sample.split_stratified(e.select("encounter_id", "label", *[F.col(f"`{c}`") for c in RAW]),
                                "label", "encounter_id", 0.3, seed)
    out = e.select("encounter_id", "label", "is_test", *[
        F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) if c in doses
        else F.col(f"`{c}`").cast("double").alias(c) for c in RAW])
    return (materialize(out, "raw-features") if as_table else out), list(RAW)
