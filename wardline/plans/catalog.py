"""Registered queries: one per operator, each paired with equivalent SQL.

Every query reads whole driver tables (through the stand-ins) and runs the
library's operators; ``ORACLE`` holds the same computation written in plain
SQL for DuckDB.  Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.codes import sanitize_name
from wardline.operators import clean, encode, lookup, metrics, report, sample
from wardline.plans import standins as S
from wardline.plans.readmission import EXCLUDED_DISCHARGE, RAW, without_excluded
from wardline.session import materialize
from wardline.sources.tables import DRUG_COLUMNS, ENCOUNTER_SCHEMA

SEED = 42
DRUGS = DRUG_COLUMNS
THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places (engines differ in the last bits)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), 6).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# ------------------------------------------------------------------ inputs

def base(spark: SparkSession, sf: str) -> DataFrame:
    """Encounters after the gender and death/hospice filters, with a 0/1 label."""
    return clean.binary_target(without_excluded(S.encounters(spark, sf)), "readmitted", "<30")


def split(spark: SparkSession, sf: str) -> DataFrame:
    return sample.split_stratified(base(spark, sf), "label", "encounter_id", 0.3, SEED)


def split_table(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """The columns ``cols`` of the split, written once as a table, for queries
    that fit on train and then apply to all rows (several reads)."""
    return materialize(split(spark, sf).select("encounter_id", *cols, "is_test"), "split")


def train_table(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and labels of the training split, written once as a table, for
    operators that read their input several times (class counts, ranks)."""
    train, _ = sample.train_test(split(spark, sf).select("encounter_id", "label", "is_test"))
    return materialize(train, "train")


def lookups(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.parse_stacked_lookup(S.lookup_lines(spark, sf))


ENC = "enc AS (" + S.duck(S.ENCOUNTERS_SQL) + ")"
BASE = ENC + """,
base AS (
  SELECT * EXCLUDE (readmitted), CAST(coalesce(readmitted = '<30', false) AS INTEGER) AS label
  FROM enc
  WHERE gender IS DISTINCT FROM 'Unknown/Invalid'
    AND NOT coalesce(discharge_disposition_id IN (11, 19, 20, 21), false))"""
SPLIT = BASE + """,
split AS (
  SELECT *, CAST(CASE WHEN row_number() OVER (PARTITION BY label
      ORDER BY md5(concat_ws(':', '42', CAST(encounter_id AS VARCHAR))), encounter_id)
      <= (count(*) OVER (PARTITION BY label) * 3 + 9) // 10 THEN 1 ELSE 0 END AS INTEGER) AS is_test
  FROM base),
train AS (SELECT * EXCLUDE (is_test) FROM split WHERE is_test = 0),
test AS (SELECT * EXCLUDE (is_test) FROM split WHERE is_test = 1)"""
LOOKUP = """
lines AS (""" + S.duck(S.LOOKUP_LINES) + """),
fields AS (
  SELECT pos,
         nullif(trim(split_part(line, ',', 1)), '') AS code,
         nullif(nullif(trim(trim(substr(line, strpos(line, ',') + 1)), '"'), ''), 'NULL') AS description
  FROM lines),
tagged AS (
  SELECT *, last_value(CASE WHEN code IS NOT NULL AND description IS NOT NULL
                             AND NOT regexp_matches(code, '^[0-9]+$') THEN code END IGNORE NULLS)
            OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
  FROM fields),
lk AS (
  SELECT section, code, description, pos FROM tagged
  WHERE code IS NOT NULL AND description IS NOT NULL AND regexp_matches(code, '^[0-9]+$')),
lkmap AS (
  SELECT section, CAST(code AS BIGINT) AS code, arg_max(description, pos) AS description
  FROM lk GROUP BY section, CAST(code AS BIGINT))"""
SCORES = "sc AS (" + S.duck(S.SCORES) + ")"


def _sql_ordinal(c: str) -> str:
    return (f"CAST(CASE lower(trim(\"{c}\")) WHEN 'no' THEN 0.0 WHEN 'down' THEN 1.0 "
            f"WHEN 'steady' THEN 2.0 WHEN 'up' THEN 3.0 END AS DOUBLE)")


def _sql_root(c: str) -> str:
    r = f"split_part({c}, '.', 1)"
    return (f"CASE WHEN starts_with({r}, 'V') OR starts_with({r}, 'E') THEN NULL "
            f"ELSE TRY_CAST({r} AS INTEGER) END")


def _sql_coarse(c: str) -> str:
    n = _sql_root(c)
    return f"""coalesce(CASE
      WHEN ({n}) BETWEEN 390 AND 459 OR ({n}) = 785 THEN 'Circulatory'
      WHEN ({n}) BETWEEN 460 AND 519 OR ({n}) = 786 THEN 'Respiratory'
      WHEN ({n}) BETWEEN 520 AND 579 OR ({n}) = 787 THEN 'Digestive'
      WHEN ({n}) BETWEEN 250 AND 251 THEN 'Diabetes'
      WHEN ({n}) BETWEEN 800 AND 999 THEN 'Injury'
      WHEN ({n}) BETWEEN 710 AND 739 THEN 'Musculoskeletal'
      WHEN ({n}) BETWEEN 140 AND 239 THEN 'Neoplasms'
      WHEN ({n}) BETWEEN 580 AND 629 OR ({n}) = 788 THEN 'Genitourinary'
      ELSE 'Other' END, 'Other')"""


def _sql_fine(c: str) -> str:
    n = _sql_root(c)
    return f"""coalesce(CASE
      WHEN ({n}) BETWEEN 390 AND 459 OR ({n}) = 785 OR ({n}) BETWEEN 460 AND 519 OR ({n}) = 786
        OR ({n}) BETWEEN 520 AND 579 OR ({n}) = 787 OR ({n}) BETWEEN 250 AND 251
        THEN 'icd_' || CAST(({n}) AS VARCHAR)
      WHEN ({n}) BETWEEN 800 AND 999 THEN 'Injury'
      WHEN ({n}) BETWEEN 710 AND 739 THEN 'Musculoskeletal'
      WHEN ({n}) BETWEEN 140 AND 239 THEN 'Neoplasms'
      WHEN ({n}) BETWEEN 580 AND 629 OR ({n}) = 788 THEN 'Genitourinary'
      ELSE 'Other' END, 'Other')"""


# Fixed by the stand-in definition: level sets of the one-hot columns.
RACE_LEVELS = ["AfricanAmerican", "Asian", "Caucasian", "Hispanic", "Unknown"]
GENDER_LEVELS = ["Female", "Male"]
AGE_LEVELS = ["[0-10)", "[10-20)", "[20-30)", "[30-40)", "[40-50)", "[50-60)",
              "[60-70)", "[70-80)", "[80-90)", "[90-100)"]
SPEC_LEVELS = ["Cardiology", "Emergency/Trauma", "Family/GeneralPractice",
               "InternalMedicine", "Surgery-General", "Unknown"]


def _sql_dummies(col: str, levels: list[str], drop_first: bool, expr: str | None = None) -> str:
    e = expr or col
    lv = levels[1:] if drop_first else levels
    return ",\n  ".join(
        f"CAST(coalesce({e} = '{x}', false) AS INTEGER) AS \"{sanitize_name(col + '_' + x)}\""
        for x in lv)


# ------------------------------------------------------------------ 0. slice

@register("rate_by_admission_type", "WITH " + BASE + "," + LOOKUP + """,
mapped AS (
  SELECT b.*, coalesce(m.description, 'Other') AS adm
  FROM base b LEFT JOIN lkmap m
    ON m.section = 'admission_type_id' AND CAST(b.admission_type_id AS BIGINT) = m.code),
g AS (SELECT adm AS admission_type_id, count(*) AS n, sum(label) AS positives FROM mapped GROUP BY adm)
SELECT admission_type_id, CAST(n AS BIGINT) AS n, CAST(positives AS BIGINT) AS positives,
       round(positives / n, 6) AS rate, round(n / sum(n) OVER (), 6) AS share FROM g""")
def q_rate_by_admission_type(spark, sf):
    """Flagship slice: filter -> lookup join -> binary target -> outcome rate per mapped level."""
    m = lookup.map_codes(base(spark, sf), "admission_type_id", lookups(spark, sf),
                         section="admission_type_id", fill="Other")
    return r6(report.rate_by_group(m, "admission_type_id").withColumn(
        "positives", F.col("positives").cast("long")))


# ------------------------------------------------------------------ 1. cleaning, lookups

@register("lookup_sections", "WITH " + LOOKUP[1:] + "\nSELECT section, code, description FROM lk")
def q_lookup_sections(spark, sf):
    return lookups(spark, sf).select("section", "code", "description")


@register("lookup_files", "WITH " + LOOKUP[1:] + "\nSELECT section, code, description FROM lk")
def q_lookup_files(spark, sf):
    """The same sections read from stacked text files."""
    from wardline.sources.tables import read_lookup_file
    path = _scratch(spark) + "/lookup"
    S.lookup_files(spark, sf, path)
    return read_lookup_file(spark, path).select("section", "code", "description")


@register("map_all_sections", "WITH " + BASE + "," + LOOKUP + """
SELECT b.encounter_id, a.description AS admission_type_id, d.description AS discharge_disposition_id,
       s.description AS admission_source_id
FROM base b
LEFT JOIN lkmap a ON a.section = 'admission_type_id' AND a.code = b.admission_type_id
LEFT JOIN lkmap d ON d.section = 'discharge_disposition_id' AND d.code = b.discharge_disposition_id
LEFT JOIN lkmap s ON s.section = 'admission_source_id' AND s.code = b.admission_source_id""")
def q_map_all_sections(spark, sf):
    cols = {c: c for c in ("admission_type_id", "discharge_disposition_id", "admission_source_id")}
    m = lookup.map_sections(base(spark, sf), lookups(spark, sf), cols)
    return m.select("encounter_id", *cols)


@register("lookup_other", "WITH " + BASE + "," + LOOKUP + """
SELECT b.encounter_id,
       CASE WHEN coalesce(m.description, 'Other') IN ('Not Available', 'NULL', 'Not Mapped')
            THEN 'Other' ELSE coalesce(m.description, 'Other') END AS admission_source_id
FROM base b LEFT JOIN lkmap m ON m.section = 'admission_source_id' AND m.code = b.admission_source_id""")
def q_lookup_other(spark, sf):
    m = lookup.map_codes(base(spark, sf), "admission_source_id", lookups(spark, sf),
                         section="admission_source_id", fill="Other")
    m = clean.merge_levels(m, ["admission_source_id"])
    return m.select("encounter_id", "admission_source_id")


_ENC_ALL = ENCOUNTER_SCHEMA.fieldNames()
_ENC_STRINGS = [f.name for f in ENCOUNTER_SCHEMA.fields if isinstance(f.dataType, T.StringType)]


@register("clean_sentinel", "WITH " + ENC + "\nSELECT encounter_id, " + ", ".join(
    f"CASE WHEN \"{c}\" = '?' THEN 'Unknown' ELSE \"{c}\" END AS \"{c}\"" for c in _ENC_STRINGS) + " FROM enc")
def q_clean_sentinel(spark, sf):
    e = clean.replace_sentinel(S.encounters(spark, sf), "?", "Unknown")
    return e.select("encounter_id", *[F.col(f"`{c}`") for c in _ENC_STRINGS])


_CATS = ["encounter_id", "patient_nbr", "admission_type_id", "discharge_disposition_id"]


@register("as_category", "WITH " + ENC + "\nSELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _CATS) + """,
  race, number_diagnoses FROM enc""")
def q_as_category(spark, sf):
    """Ids as categories, after dropping columns (unknown names are ignored)."""
    e = clean.drop_columns(S.encounters(spark, sf), [c for c in _ENC_ALL if c not in (*_CATS, "race", "number_diagnoses")] + ["no_such"])
    return clean.as_category(e, _CATS)


@register("preview", "WITH " + BASE + """
SELECT encounter_id, gender, age, label FROM base ORDER BY encounter_id LIMIT 5""")
def q_preview(spark, sf):
    return report.preview(base(spark, sf), 5, "encounter_id").select("encounter_id", "gender", "age", "label")


@register("exclude_codes", "WITH " + BASE + "\nSELECT encounter_id, gender, coalesce(discharge_disposition_id, -1) AS discharge_disposition_id FROM base")
def q_exclude_codes(spark, sf):
    return base(spark, sf).select("encounter_id", "gender", "discharge_disposition_id").fillna(-1)


@register("drop_constant", "WITH " + ENC + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(CASE WHEN count(DISTINCT \"{c}\") + max(CASE WHEN \"{c}\" IS NULL "
    f"THEN 1 ELSE 0 END) <= 1 THEN 1 ELSE 0 END AS INTEGER) AS is_constant FROM enc"
    for c in _ENC_ALL))
def q_drop_constant(spark, sf):
    e = S.encounters(spark, sf)
    const = set(clean.constant_column_names(e))
    kept = clean.drop_constant(e).columns
    rows = [(c, 1 if c in const else 0) for c in e.columns]
    assert set(kept) == {c for c, k in rows if not k}
    return spark.createDataFrame(rows, "column string, is_constant int")


@register("sanitise_names", "WITH " + ENC + """
SELECT DISTINCT replace(replace(replace(replace(replace('age_' || age, '[', '_'), ']', '_'), '<', '_lt_'),
       '>', '_gt_'), ',', '_') AS "column" FROM enc
UNION ALL
SELECT DISTINCT replace(replace(replace(replace(replace('readmitted_' || readmitted, '[', '_'), ']', '_'),
       '<', '_lt_'), '>', '_gt_'), ',', '_') FROM enc WHERE readmitted IS NOT NULL""")
def q_sanitise_names(spark, sf):
    e = S.encounters(spark, sf)
    levels = encode.vocabulary_levels(encode.fit_vocabulary(e, ["age", "readmitted"]))
    wide = clean.sanitize_columns(encode.one_hot(e.select("age", "readmitted"), levels,
                                                 drop_first=False))
    return spark.createDataFrame([(c,) for c in wide.columns], "column string")


# ------------------------------------------------------------------ 2. encoders

@register("encode_ordinal", "WITH " + ENC + "\nSELECT encounter_id, " + ", ".join(
    f'{_sql_ordinal(c)} AS "{c}"' for c in DRUGS) + " FROM enc")
def q_encode_ordinal(spark, sf):
    return encode.encode_ordinal(S.encounters(spark, sf), DRUGS).select("encounter_id", *[F.col(f"`{c}`") for c in DRUGS])


@register("code_group_coarse", "WITH " + ENC + "\nSELECT encounter_id, " + ", ".join(
    f"{_sql_coarse(c)} AS {c}_cat" for c in ("diag_1", "diag_2", "diag_3")) + " FROM enc")
def q_code_group_coarse(spark, sf):
    e = encode.group_codes(S.encounters(spark, sf), ["diag_1", "diag_2", "diag_3"], fine=False)
    return e.select("encounter_id", "diag_1_cat", "diag_2_cat", "diag_3_cat")


@register("code_group_fine", "WITH " + ENC + "\nSELECT encounter_id, " + ", ".join(
    f"{_sql_fine(c)} AS {c}_cat" for c in ("diag_1", "diag_2", "diag_3")) + " FROM enc")
def q_code_group_fine(spark, sf):
    e = encode.group_codes(S.encounters(spark, sf), ["diag_1", "diag_2", "diag_3"], fine=True)
    return e.select("encounter_id", "diag_1_cat", "diag_2_cat", "diag_3_cat")


@register("entity_frequency", "WITH " + ENC + """,
g AS (SELECT * FROM enc WHERE gender IS DISTINCT FROM 'Unknown/Invalid'),
f AS (SELECT patient_nbr, count(*) / (SELECT count(patient_nbr) FROM g) AS patient_freq
      FROM g WHERE patient_nbr IS NOT NULL GROUP BY patient_nbr)
SELECT g.encounter_id, round(f.patient_freq, 6) AS patient_freq
FROM g LEFT JOIN f USING (patient_nbr)
WHERE NOT coalesce(g.discharge_disposition_id IN (11, 19, 20, 21), false)""")
def q_entity_frequency(spark, sf):
    """Patient frequency after the gender filter, before the hospice filter."""
    e = clean.exclude_value(S.encounters(spark, sf), "gender", "Unknown/Invalid")
    e = encode.frequency_encode(e, "patient_nbr", "patient_freq")
    e = clean.exclude_codes(e, "discharge_disposition_id", EXCLUDED_DISCHARGE)
    return r6(e.select("encounter_id", "patient_freq"))


@register("rare_bucket_share", "WITH " + BASE + """,
s AS (SELECT discharge_disposition_id AS d, count(*) / sum(count(*)) OVER () AS share
      FROM base WHERE discharge_disposition_id IS NOT NULL GROUP BY 1)
SELECT b.encounter_id, coalesce(CASE WHEN s.share >= 0.01 THEN CAST(s.d AS VARCHAR) END, 'Other')
       AS disch_reduced
FROM base b LEFT JOIN s ON s.d = b.discharge_disposition_id""")
def q_rare_bucket_share(spark, sf):
    e = encode.rare_bucket(base(spark, sf), "discharge_disposition_id", min_share=0.01,
                           out="disch_reduced")
    return e.select("encounter_id", "disch_reduced")


@register("rare_bucket_count", "WITH " + BASE + """,
s AS (SELECT medical_specialty AS m, count(*) AS n FROM base WHERE medical_specialty IS NOT NULL GROUP BY 1)
SELECT b.encounter_id, coalesce(CASE WHEN s.n >= 1000 THEN s.m END, 'Other') AS specialty_grp
FROM base b LEFT JOIN s ON s.m = b.medical_specialty""")
def q_rare_bucket_count(spark, sf):
    """Specialties with fewer than 1000 rows become one level."""
    e = encode.rare_bucket(base(spark, sf), "medical_specialty", min_share=None, min_count=1000,
                           out="specialty_grp")
    return e.select("encounter_id", "specialty_grp")


# ------------------------------------------------------------------ 3. matrix

def _onehot(spark, sf, drop_first: bool) -> DataFrame:
    sp = clean.replace_sentinel(split_table(spark, sf, "race", "gender", "age"), "?", "Unknown", ["race"])
    train = sp.where(F.col("is_test") == 0)
    levels = encode.vocabulary_levels(encode.fit_vocabulary(train, ["race", "gender", "age"]))
    wide = encode.one_hot(sp.select("encounter_id", "race", "gender", "age"), levels,
                          drop_first=drop_first)
    return clean.sanitize_columns(wide)


_RACE_SQL = "CASE WHEN race = '?' THEN 'Unknown' ELSE race END"


def _sql_onehot(drop_first: bool) -> str:
    return ("WITH " + SPLIT + "\nSELECT encounter_id,\n  "
            + _sql_dummies("race", RACE_LEVELS, drop_first, _RACE_SQL) + ",\n  "
            + _sql_dummies("gender", GENDER_LEVELS, drop_first) + ",\n  "
            + _sql_dummies("age", AGE_LEVELS, drop_first) + "\nFROM split")


@register("onehot_drop_first", _sql_onehot(True))
def q_onehot_drop_first(spark, sf):
    return _onehot(spark, sf, True)


@register("onehot_keep_all", _sql_onehot(False))
def q_onehot_keep_all(spark, sf):
    return _onehot(spark, sf, False)


@register("onehot_inverse", "WITH " + SPLIT + """,
m AS (SELECT medical_specialty AS mode FROM train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT s.encounter_id, coalesce(CASE WHEN s.medical_specialty IN ('""" + "', '".join(
    l for l in SPEC_LEVELS if l != "Unknown") + """') THEN s.medical_specialty END, m.mode)
    AS medical_specialty
FROM split s, m""")
def q_onehot_inverse(spark, sf):
    """Keep-all one-hot with a train vocabulary that lacks the '?' level, then
    inverse: known levels come back, all-zero rows get the training mode."""
    sp = split_table(spark, sf, "medical_specialty")
    train = sp.where((F.col("is_test") == 0) & (F.col("medical_specialty") != "?"))
    levels = encode.vocabulary_levels(encode.fit_vocabulary(train, ["medical_specialty"]))
    mode = report.mode_level(sp.where(F.col("is_test") == 0), "medical_specialty").first()["mode"]
    wide = encode.one_hot(sp.select("encounter_id", "medical_specialty"), levels, drop_first=False)
    return encode.inverse_one_hot(wide, "medical_specialty", levels["medical_specialty"], mode) \
        .select("encounter_id", "medical_specialty")


_SCALE = ["time_in_hospital", "num_medications", "number_inpatient", "examide"]


@register("scale_population", "WITH " + SPLIT + """,
x AS (SELECT encounter_id, is_test, CAST(time_in_hospital AS DOUBLE) AS time_in_hospital,
             CAST(num_medications AS DOUBLE) AS num_medications,
             CAST(number_inpatient AS DOUBLE) AS number_inpatient, """ + _sql_ordinal("examide")
         + """ AS examide FROM split),
st AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALE)
    + """ FROM x WHERE is_test = 0)
SELECT encounter_id, """ + ", ".join(
        f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1 ELSE s_{c} END, 6) AS {c}"
        for c in _SCALE) + " FROM x, st")
def q_scale_population(spark, sf):
    sp = encode.encode_ordinal(split(spark, sf), ["examide"])
    stats = encode.fit_scaler(sp.where(F.col("is_test") == 0), _SCALE)
    return r6(encode.apply_scaler(sp, stats).select("encounter_id", *_SCALE))


@register("align_to_train", "WITH " + SPLIT + """
SELECT encounter_id, time_in_hospital, """ + _sql_dummies(
    "medical_specialty", SPEC_LEVELS, True,
    "CASE WHEN medical_specialty = '?' THEN 'Unknown' ELSE medical_specialty END") + """
FROM split WHERE is_test = 1""")
def q_align_to_train(spark, sf):
    """Test rows one-hot encoded with their own vocabulary, then aligned to the
    training columns (missing -> 0, extra dropped)."""
    sp = clean.replace_sentinel(split_table(spark, sf, "time_in_hospital", "medical_specialty"), "?", "Unknown",
                                ["medical_specialty"])
    train, test = sample.train_test(sp)
    tr_levels = encode.vocabulary_levels(encode.fit_vocabulary(train, ["medical_specialty"]))
    te_levels = encode.vocabulary_levels(encode.fit_vocabulary(test, ["medical_specialty"]))
    cols = ["encounter_id"] + encode.feature_names(tr_levels, ["time_in_hospital"])
    te = encode.one_hot(test.select("encounter_id", "time_in_hospital", "medical_specialty"),
                        te_levels, drop_first=True)
    return clean.sanitize_columns(clean.align_to(te, cols))


# ------------------------------------------------------------------ 4. sampling

@register("split_stratified", "WITH " + SPLIT + "\nSELECT encounter_id, label, is_test FROM split")
def q_split_stratified(spark, sf):
    return split(spark, sf).select("encounter_id", "label", "is_test")


@register("folds_stratified", "WITH " + BASE + """
SELECT encounter_id, label, CAST((row_number() OVER (PARTITION BY label
    ORDER BY md5(concat_ws(':', '42', CAST(encounter_id AS VARCHAR))), encounter_id) - 1) % 4 AS INTEGER)
    AS fold FROM base""")
def q_folds_stratified(spark, sf):
    return sample.folds_stratified(base(spark, sf), 4, "label", "encounter_id", SEED) \
        .select("encounter_id", "label", "fold")


@register("folds_unshuffled", "WITH " + BASE + """
,
per AS (SELECT label AS c, count(*) AS n, min(encounter_id) AS f FROM base GROUP BY label),
deal AS (SELECT c, (pos % 5) AS fold, count(*) AS m
  FROM (SELECT label AS c, row_number() OVER (ORDER BY f, encounter_id) - 1 AS pos
        FROM base JOIN per ON per.c = base.label) GROUP BY c, pos % 5),
upto AS (SELECT c, fold, sum(m) OVER (PARTITION BY c ORDER BY fold) AS last FROM deal),
r AS (SELECT encounter_id, label, row_number() OVER (PARTITION BY label ORDER BY encounter_id) AS rn FROM base)
SELECT encounter_id, label, CAST((SELECT count(*) FROM upto WHERE c = label AND last < rn) AS INTEGER) AS fold
FROM r""")
def q_folds_unshuffled(spark, sf):
    return sample.folds_stratified(base(spark, sf), 5, "label", "encounter_id", None) \
        .select("encounter_id", "label", "fold")


_OVERSAMPLE_SQL = "WITH " + SPLIT + """,
mino AS (SELECT encounter_id, label, row_number() OVER (
    ORDER BY md5(concat_ws(':', '42', CAST(encounter_id AS VARCHAR))), encounter_id) AS rn
  FROM train WHERE label = 1),
n AS (SELECT (SELECT count(*) FROM train WHERE label = 0) AS n_maj, (SELECT count(*) FROM mino) AS n_min),
draws AS (SELECT i, CAST(('0x' || substr(md5(concat_ws(':', '42', 'draw', CAST(i AS VARCHAR))), 1, 15))
                    AS BIGINT) % n_min + 1 AS rn
          FROM (SELECT unnest(range({n_draws})) AS i, n_min FROM n))
SELECT encounter_id, label FROM train WHERE label = 0
UNION ALL SELECT m.encounter_id, m.label FROM draws d JOIN mino m USING (rn){extra}"""


@register("oversample_exact", _OVERSAMPLE_SQL.format(n_draws="n_maj", extra=""))
def q_oversample_exact(spark, sf):
    train = train_table(spark, sf)
    return sample.oversample(train.select("encounter_id", "label"), "label", "encounter_id", SEED)


@register("oversample_in_fold", _OVERSAMPLE_SQL.format(
    n_draws="n_maj - n_min", extra="\nUNION ALL SELECT encounter_id, label FROM train WHERE label = 1"))
def q_oversample_in_fold(spark, sf):
    train = train_table(spark, sf)
    return sample.oversample(train.select("encounter_id", "label"), "label", "encounter_id", SEED,
                             keep_original=True)


@register("undersample", "WITH " + SPLIT + """,
r AS (SELECT encounter_id, label, row_number() OVER (PARTITION BY label
        ORDER BY md5(concat_ws(':', '42', CAST(encounter_id AS VARCHAR))), encounter_id) AS rn FROM train)
SELECT encounter_id, label FROM r WHERE rn <= (SELECT count(*) FROM train WHERE label = 1)""")
def q_undersample(spark, sf):
    train = train_table(spark, sf)
    return sample.undersample(train.select("encounter_id", "label"), "label", "encounter_id", SEED)


@register("sample_n", "WITH " + BASE + """
SELECT encounter_id, label FROM base
ORDER BY md5(concat_ws(':', '42', CAST(encounter_id AS VARCHAR))), encounter_id LIMIT 500""")
def q_sample_n(spark, sf):
    return sample.sample_n(base(spark, sf).select("encounter_id", "label"), 500, "encounter_id", SEED)


@register("class_weights", "WITH " + SPLIT + """
SELECT label, CAST(count(*) AS BIGINT) AS n,
       round((SELECT count(*) FROM train) / (SELECT count(DISTINCT label) FROM train) / count(*), 6)
       AS weight FROM train GROUP BY label""")
def q_class_weights(spark, sf):
    train, _ = sample.train_test(split(spark, sf))
    return r6(sample.class_weights(train))


@register("oversample_counts", "WITH " + SPLIT + """,
mino AS (SELECT encounter_id, label, row_number() OVER (
    ORDER BY md5(concat_ws(':', '42', CAST(encounter_id AS VARCHAR))), encounter_id) AS rn
  FROM train WHERE label = 1),
n AS (SELECT (SELECT count(*) FROM train WHERE label = 0) AS n_maj, (SELECT count(*) FROM mino) AS n_min),
draws AS (SELECT CAST(('0x' || substr(md5(concat_ws(':', '42', 'draw', CAST(i AS VARCHAR))), 1, 15))
                    AS BIGINT) % n_min + 1 AS rn
          FROM (SELECT unnest(range(n_maj)) AS i, n_min FROM n)),
t AS (SELECT rn, count(*) AS times FROM draws GROUP BY rn)
SELECT encounter_id, label, CAST(1 AS BIGINT) AS times FROM train WHERE label = 0
UNION ALL SELECT m.encounter_id, m.label, CAST(coalesce(t.times, 0) AS BIGINT) FROM mino m LEFT JOIN t USING (rn)""")
def q_oversample_counts(spark, sf):
    """How often the balanced training set has each row; no row is copied."""
    return sample.oversample_counts(train_table(spark, sf), "label", "encounter_id", SEED)


# ------------------------------------------------------------------ 4b. encoders of training folds

K = 4
FOLDS = SPLIT + f""",
folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY label
    ORDER BY md5(concat_ws(':', '42', CAST(encounter_id AS VARCHAR))), encounter_id) - 1) % {K} AS INTEGER) AS fold FROM train),
ks AS (SELECT CAST(unnest(range({K})) AS INTEGER) AS f)"""


def _folded(spark, sf, *cols):
    """Columns of the train split in four stratified folds, as a table."""
    train, _ = sample.train_test(split(spark, sf).select("encounter_id", "label", *cols, "is_test"))
    return materialize(sample.folds_stratified(train, K, "label", "encounter_id", SEED), "folds")


_FOLD_NUM = ["time_in_hospital", "num_medications", "number_inpatient", "number_diagnoses"]


@register("fold_scalers", "WITH " + FOLDS + "\n" + "\nUNION ALL ".join(
    f"""SELECT f AS fold, '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 6) AS mean,
  round(stddev_pop({c}), 6) AS sd FROM ks JOIN folded ON fold <> f GROUP BY f""" for c in _FOLD_NUM))
def q_fold_scalers(spark, sf):
    """Mean and deviation of every training fold from one scan."""
    from wardline.operators import folds
    return r6(folds.fold_scalers(_folded(spark, sf, *_FOLD_NUM), _FOLD_NUM))


_FOLD_CATS = ["race", "medical_specialty", "diag_1"]


@register("fold_vocabulary", "WITH " + FOLDS + """,
l AS (""" + "\nUNION ALL ".join(f"SELECT DISTINCT f, '{c}' AS c, {c} AS level FROM ks JOIN folded ON fold <> f WHERE {c} IS NOT NULL"
                                for c in _FOLD_CATS) + """)
SELECT f AS fold, c AS "column", level, CAST(row_number() OVER (PARTITION BY f, c ORDER BY level) - 1 AS INTEGER) AS idx FROM l""")
def q_fold_vocabulary(spark, sf):
    """The levels each training fold knows, and their places."""
    from wardline.operators import folds
    f = _folded(spark, sf, *_FOLD_CATS)
    return folds.fold_vocabulary(folds.fold_levels(f, _FOLD_CATS), K).select("fold", "column", "level", "idx")


@register("fold_patient_share", "WITH " + FOLDS + """,
n AS (SELECT f, count(patient_nbr) AS n FROM ks JOIN folded ON fold <> f GROUP BY f),
s AS (SELECT f, patient_nbr, count(*) AS c FROM ks JOIN folded ON fold <> f WHERE patient_nbr IS NOT NULL GROUP BY 1, 2)
SELECT x.encounter_id, x.fold, """ + ", ".join(
    f"round(coalesce((SELECT c FROM s WHERE f = {i} AND s.patient_nbr = x.patient_nbr) / (SELECT n FROM n WHERE f = {i}), -1), 6) AS share_{i}"
    for i in range(K)) + """
FROM folded x""")
def q_fold_patient_share(spark, sf):
    """The patient's share of the rows outside each fold (-1: unseen there)."""
    from wardline.operators import folds
    f = _folded(spark, sf, "patient_nbr")
    levels = folds.fold_levels(f, ["patient_nbr"])
    total = folds.fold_totals(levels)["patient_nbr"]
    w = folds.with_fold_counts(f, "patient_nbr", levels, "seen")
    return r6(w.select("encounter_id", "fold", *[F.coalesce(folds.share("seen", total, i), F.lit(-1.0)).alias(f"share_{i}") for i in range(K)]))


@register("fold_rare_levels", "WITH " + FOLDS + """,
n AS (SELECT f, count(discharge_disposition_id) AS n FROM ks JOIN folded ON fold <> f GROUP BY f),
s AS (SELECT f, discharge_disposition_id AS d FROM ks JOIN folded ON fold <> f JOIN n USING (f)
      WHERE discharge_disposition_id IS NOT NULL GROUP BY f, d, n HAVING count(*) / n >= 0.03)
SELECT encounter_id, """ + ", ".join(
    f"CASE WHEN discharge_disposition_id IN (SELECT d FROM s WHERE f = {i}) THEN CAST(discharge_disposition_id AS VARCHAR) ELSE 'Other' END AS level_{i}"
    for i in range(K)) + """
FROM folded""")
def q_fold_rare_levels(spark, sf):
    """Discharge codes that hold 3 % of the rows outside each fold; the rest is
    one level."""
    from wardline.operators import folds
    c = "discharge_disposition_id"
    f = _folded(spark, sf, c)
    levels = folds.fold_levels(f, [c])
    total = folds.fold_totals(levels)[c]
    w = folds.with_fold_counts(f, c, levels, "seen")
    return w.select("encounter_id", *[folds.frequent(c, "seen", total, i, 0.03).alias(f"level_{i}") for i in range(K)])


_SPARSE = ["race", "diag_1", "patient_nbr"]


@register("sparse_one_hot", "WITH " + SPLIT + """,
x AS (SELECT encounter_id, is_test, time_in_hospital, """ + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _SPARSE) + """ FROM split),
v AS (""" + "\nUNION ALL ".join(
    f"SELECT {i} AS k, level, row_number() OVER (ORDER BY level) - 1 AS p FROM (SELECT DISTINCT {c} AS level FROM x WHERE is_test = 0 AND {c} IS NOT NULL)"
    for i, c in enumerate(_SPARSE)) + """),
w AS (SELECT k, (SELECT coalesce(sum(m), 0) FROM (SELECT k AS j, count(*) - 1 AS m FROM v GROUP BY k) WHERE j < q.k) AS off FROM (SELECT DISTINCT k FROM v) q)
SELECT encounter_id, 0 AS idx, CAST(time_in_hospital AS DOUBLE) AS value FROM x WHERE time_in_hospital <> 0
""" + "\n".join(f"UNION ALL SELECT encounter_id, CAST(off + p AS INTEGER), 1.0 FROM x JOIN v ON v.k = {i} AND v.level = x.{c} JOIN w ON w.k = {i} WHERE p > 0"
                for i, c in enumerate(_SPARSE)))
def q_sparse_one_hot(spark, sf):
    """The non-zero entries of the fitted encoding, with a column of one level
    per patient; unknown and missing levels have none."""
    from wardline.operators import vocab
    sp = split_table(spark, sf, "time_in_hospital", *_SPARSE)
    enc = vocab.fit_encoder(sp.where(F.col("is_test") == 0), _SPARSE, ["time_in_hospital"])
    e = enc.entries(sp, "e")
    return e.select("encounter_id", F.explode("e").alias("x")).select("encounter_id", "x.idx", "x.value")


# ------------------------------------------------------------------ 5. metrics

def _cells_sql(pred: str) -> str:
    return (f"CAST(sum(CASE WHEN label = 1 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
            f"CAST(sum(CASE WHEN label = 0 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
            f"CAST(sum(CASE WHEN label = 1 AND {pred} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
            f"CAST(sum(CASE WHEN label = 0 AND {pred} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn")


_RATIOS_SQL = """round(CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0 END, 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


def _auc_sql(score: str, group: str | None) -> str:
    g = f"{group}, " if group else ""
    pg = f"PARTITION BY {group} " if group else ""
    return f"""SELECT {g}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
      sum(pos * (neg_before + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc
    FROM (SELECT *, coalesce(sum(neg) OVER ({pg}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
                                            AND 1 PRECEDING), 0) AS neg_before
          FROM (SELECT {g}CAST({score} AS DOUBLE) AS s,
                       sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                       sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg
                FROM sc GROUP BY {g}CAST({score} AS DOUBLE)))
    {'GROUP BY ' + group if group else ''}"""


def _scores(spark, sf):
    return S.scores(spark, sf)


@register("confusion", "WITH " + SCORES + """,
c AS (SELECT """ + _cells_sql("CAST(p > 0.5 AS INTEGER)") + """ FROM sc)
SELECT 0 AS actual, 0 AS predicted, tn AS n FROM c UNION ALL SELECT 0, 1, fp FROM c
UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c""")
def q_confusion(spark, sf):
    return metrics.confusion(metrics.predict_at(_scores(spark, sf), 0.5))


@register("metrics_row", "WITH " + SCORES + """,
c AS (SELECT CAST(count(*) AS BIGINT) AS n, """ + _cells_sql("CAST(p > 0.5 AS INTEGER)") + """ FROM sc),
a AS (""" + _auc_sql("p", None) + """)
SELECT n, tp, fp, fn, tn, """ + _RATIOS_SQL + """, round(a.auc, 6) AS auc FROM c, a""")
def q_metrics_row(spark, sf):
    return r6(metrics.evaluate(_scores(spark, sf), "label", "p", 0.5))


@register("roc_auc", "WITH " + SCORES + """,
a1 AS (""" + _auc_sql("p", None) + """), a2 AS (""" + _auc_sql("p2", None) + """)
SELECT 'p' AS model, round(auc, 6) AS auc FROM a1 UNION ALL SELECT 'p2', round(auc, 6) FROM a2""")
def q_roc_auc(spark, sf):
    sc = _scores(spark, sf)
    a = metrics.roc_auc(sc, "label", "p").select(F.lit("p").alias("model"), "auc")
    b = metrics.roc_auc(sc, "label", "p2").select(F.lit("p2").alias("model"), "auc")
    return r6(a.unionByName(b))


@register("log_loss", "WITH " + SCORES + """
SELECT round(avg(CASE WHEN label = 1 THEN -ln(least(greatest(p, 1e-15), 1 - 1e-15))
                     ELSE -ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END), 6) AS log_loss,
       round(avg(CASE WHEN label = 1 THEN -ln(least(greatest(p2, 1e-15), 1 - 1e-15))
                     ELSE -ln(1 - least(greatest(p2, 1e-15), 1 - 1e-15)) END), 6) AS log_loss_p2
FROM sc""")
def q_log_loss(spark, sf):
    sc = _scores(spark, sf)
    a = metrics.log_loss(sc, "label", "p")
    b = metrics.log_loss(sc, "label", "p2").withColumnRenamed("log_loss", "log_loss_p2")
    return r6(a.select("log_loss", F.lit(b.select("log_loss_p2").scalar()).alias("log_loss_p2")))


@register("threshold_sweep", "WITH " + SCORES + """,
t AS (SELECT CAST(unnest([""" + ", ".join(repr(t) for t in THRESHOLDS) + """]) AS DOUBLE) AS threshold),
c AS (SELECT threshold,
        CAST(sum(CASE WHEN label = 1 AND p > threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN label = 0 AND p > threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN label = 1 AND NOT p > threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn,
        CAST(sum(CASE WHEN label = 0 AND NOT p > threshold THEN 1 ELSE 0 END) AS BIGINT) AS tn
      FROM t, sc GROUP BY threshold)
SELECT threshold, tp, fp, fn, tn,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS fbeta
FROM c""")
def q_threshold_sweep(spark, sf):
    return r6(metrics.threshold_sweep(_scores(spark, sf), THRESHOLDS, "label", "p"))


_CURVE_SQL = SCORES + """,
per AS (SELECT subgroup, p AS threshold, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
               sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg FROM sc WHERE p IS NOT NULL GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY subgroup) AS pp,
               sum(neg) OVER (PARTITION BY subgroup) AS nn
        FROM per WINDOW w AS (PARTITION BY subgroup ORDER BY threshold DESC)),
curve AS (SELECT subgroup, threshold, pos, tp, fp, pp - tp AS fn, nn - fp AS tn,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS recall,
  CASE WHEN 5 * tp + 4 * (pp - tp) + fp > 0 THEN 5 * tp / (5 * tp + 4 * (pp - tp) + fp) ELSE 0 END AS fbeta FROM cum)"""


@register("pr_points", "WITH " + _CURVE_SQL + """
SELECT subgroup, round(threshold, 6) AS threshold, """ + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("pos", "tp", "fp", "fn", "tn")) + """,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(fbeta, 6) AS fbeta FROM curve""")
def q_pr_points(spark, sf):
    """Precision, recall and F2 at every distinct score, per subgroup."""
    return r6(metrics.pr_curve(_scores(spark, sf), "label", "p", ["subgroup"], 2.0))


@register("best_threshold", "WITH " + _CURVE_SQL + """
SELECT subgroup, round(max_by(threshold, (fbeta, threshold)), 6) AS threshold, round(max_by(precision, (fbeta, threshold)), 6) AS precision,
       round(max_by(recall, (fbeta, threshold)), 6) AS recall, round(max(fbeta), 6) AS fbeta,
       round(sum(pos * precision) / sum(pos), 6) AS average_precision FROM curve GROUP BY subgroup""")
def q_best_threshold(spark, sf):
    """The score with the best F2 of each subgroup, and average precision."""
    curve = metrics.pr_curve(_scores(spark, sf), "label", "p", ["subgroup"], 2.0)
    return r6(metrics.best_threshold(curve, ["subgroup"]))


@register("metrics_by_group", "WITH " + SCORES + """,
c AS (SELECT subgroup, CAST(count(*) AS BIGINT) AS n, """ + _cells_sql("CAST(p > 0.5 AS INTEGER)")
    + """ FROM sc GROUP BY subgroup),
a AS (""" + _auc_sql("p", "subgroup") + """)
SELECT c.subgroup, n, tp, fp, fn, tn, """ + _RATIOS_SQL + """, round(a.auc, 6) AS auc
FROM c LEFT JOIN a USING (subgroup)""")
def q_metrics_by_group(spark, sf):
    return r6(metrics.evaluate(_scores(spark, sf), "label", "p", 0.5, ["subgroup"]))


@register("soft_vote", "WITH " + SCORES + """
SELECT key, label, round((0.7 * p + 0.3 * p2) / 1.0, 6) AS p FROM sc""")
def q_soft_vote(spark, sf):
    sc = _scores(spark, sf)
    a = sc.select("key", "label", "p")
    b = sc.select("key", F.col("p2").alias("p"))
    return r6(metrics.soft_vote(a, b, "key", "label", 0.7, 0.3))


@register("cascade", "WITH " + SCORES + """,
c AS (SELECT CAST(count(*) AS BIGINT) AS n, """
    + _cells_sql("CAST(p > 0.6 AND p2 > 0.5 AS INTEGER)") + """ FROM sc)
SELECT n, tp, fp, fn, tn, """ + _RATIOS_SQL + " FROM c")
def q_cascade(spark, sf):
    sc = _scores(spark, sf)
    c = metrics.cascade(sc.select("key", "label", "p"), sc.select("key", F.col("p2").alias("p")),
                        0.6, 0.5)
    return r6(metrics.classification_metrics(c, "label", "pred"))


@register("model_compare", "WITH " + SCORES + """,
u AS (SELECT 'p' AS model, label, p AS s FROM sc UNION ALL SELECT 'p2', label, p2 FROM sc),
c AS (SELECT model, CAST(count(*) AS BIGINT) AS n, """ + _cells_sql("CAST(s > 0.5 AS INTEGER)")
    + """ FROM u GROUP BY model),
a AS (""" + _auc_sql("s", "model").replace("FROM sc", "FROM u") + """)
SELECT c.model, n, tp, fp, fn, tn, """ + _RATIOS_SQL + """, round(a.auc, 6) AS auc
FROM c LEFT JOIN a USING (model)""")
def q_model_compare(spark, sf):
    sc = _scores(spark, sf)
    return r6(metrics.compare_models({"p": sc.select("label", "p"),
                                      "p2": sc.select("label", F.col("p2").alias("p"))}))


# ------------------------------------------------------------------ 6. reports

@register("value_counts", "WITH " + BASE + """
SELECT patient_nbr, CAST(count(*) AS BIGINT) AS n FROM base WHERE patient_nbr IS NOT NULL GROUP BY 1""")
def q_value_counts(spark, sf):
    return report.value_counts_sorted(base(spark, sf), ["patient_nbr"])


@register("value_counts_norm", "WITH " + BASE + """
SELECT admission_source_id, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM base WHERE admission_source_id IS NOT NULL GROUP BY 1""")
def q_value_counts_norm(spark, sf):
    return r6(report.value_counts(base(spark, sf), "admission_source_id", normalize=True))


@register("mode_level", "WITH " + BASE + """,
c AS (SELECT gender, CASE WHEN medical_specialty = '?' THEN 'Unknown' ELSE medical_specialty END AS lvl,
             count(*) AS n FROM base WHERE medical_specialty IS NOT NULL GROUP BY 1, 2)
SELECT gender, arg_min(lvl, (-n, lvl)) AS mode, CAST(max(n) AS BIGINT) AS n FROM c GROUP BY gender""")
def q_mode_level(spark, sf):
    b = clean.replace_sentinel(base(spark, sf), "?", "Unknown", ["medical_specialty"])
    return report.mode_level(b, "medical_specialty", ["gender"])


@register("rate_by_group", "WITH " + BASE + """,
g AS (SELECT age, count(*) AS n, sum(label) AS positives FROM base GROUP BY age)
SELECT age, CAST(n AS BIGINT) AS n, CAST(positives AS BIGINT) AS positives, round(positives / n, 6) AS rate,
       round(n / sum(n) OVER (), 6) AS share FROM g""")
def q_rate_by_group(spark, sf):
    return r6(report.rate_by_group(base(spark, sf), "age").withColumn(
        "positives", F.col("positives").cast("long")))


_ZERO = ["number_outpatient", "number_emergency", "number_inpatient", "num_procedures"]


@register("zero_share", "WITH " + BASE + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM base"
    for c in _ZERO))
def q_zero_share(spark, sf):
    return r6(report.zero_share(base(spark, sf), _ZERO))


_HIST = ["time_in_hospital", "number_inpatient"]


@register("entity_history", "WITH " + BASE + "\nSELECT coalesce(patient_nbr, -1) AS patient_nbr, CAST(count(*) AS BIGINT) AS n_rows, " + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}_sum, round(avg({c}), 6) AS {c}_mean, max({c}) AS {c}_max"
    for c in _HIST) + ", round(avg(label), 6) AS label_rate FROM base GROUP BY patient_nbr")
def q_entity_history(spark, sf):
    h = report.entity_history(base(spark, sf), "patient_nbr", _HIST, "label")
    return r6(h.withColumns({f"{c}_sum": F.col(f"{c}_sum").cast("long") for c in _HIST}).fillna(-1, ["patient_nbr"]))


@register("entity_prior", "WITH " + BASE + """
SELECT encounter_id, coalesce(patient_nbr, -1) AS patient_nbr,
  CAST(count(*) OVER w AS BIGINT) AS prior_n,
  CAST(coalesce(sum(number_inpatient) OVER w, 0) AS BIGINT) AS number_inpatient_prior,
  CAST(coalesce(sum(number_emergency) OVER w, 0) AS BIGINT) AS number_emergency_prior
FROM base
WINDOW w AS (PARTITION BY patient_nbr ORDER BY encounter_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_entity_prior(spark, sf):
    """Per-patient history before each encounter (visits and running counts)."""
    b = base(spark, sf).select("encounter_id", "patient_nbr", "number_inpatient",
                               "number_emergency")
    h = report.entity_prior(b, "patient_nbr", "encounter_id", "encounter_id",
                            ["number_inpatient", "number_emergency"])
    return h.select("encounter_id", F.coalesce("patient_nbr", F.lit(-1)).alias("patient_nbr"), "prior_n",
                    F.col("number_inpatient_prior").cast("long").alias("number_inpatient_prior"),
                    F.col("number_emergency_prior").cast("long").alias("number_emergency_prior"))


_IMP_SQL_FEATURE = "concat(event_type, '_', CAST(user_id % 5 AS VARCHAR))"


@register("topk_importance", """
SELECT feature, round(importance, 6) AS importance FROM (
  SELECT """ + _IMP_SQL_FEATURE + """ AS feature, avg(abs(value - 100.0)) AS importance
  FROM events GROUP BY 1) ORDER BY importance DESC, feature LIMIT 15""")
def q_topk_importance(spark, sf):
    """Mean |value| per feature on a long-form attribution table, top 15."""
    ev = S.read_table(spark, sf, "events")
    long = ev.select(F.concat("event_type", F.lit("_"), (F.col("user_id") % 5).cast("string"))
                     .alias("feature"), (F.col("value") - 100.0).alias("value"))
    return r6(report.top_k(report.mean_abs(long), 15))


@register("mean_std", """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM events GROUP BY event_type""")
def q_mean_std(spark, sf):
    return r6(report.mean_std(S.read_table(spark, sf, "events"), "value", ["event_type"]))


@register("positive_rate", "WITH " + SPLIT + """
SELECT is_test, round(avg(label), 3) AS positive_rate, CAST(count(*) AS BIGINT) AS n
FROM split GROUP BY is_test""")
def q_positive_rate(spark, sf):
    return report.positive_rate(split(spark, sf), "label", ["is_test"])


@register("class_counts", "WITH " + BASE + """,
c AS (SELECT CAST(number_inpatient AS BIGINT) AS k, count(*) AS n FROM base GROUP BY 1)
SELECT g.k AS number_inpatient, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT unnest(range(0, (SELECT max(k) FROM c) + 1)) AS k) g LEFT JOIN c USING (k)""")
def q_class_counts(spark, sf):
    return report.class_counts_dense(base(spark, sf), "number_inpatient")


@register("distinct_classes", "WITH " + BASE + """
SELECT DISTINCT number_diagnoses FROM base WHERE number_diagnoses IS NOT NULL""")
def q_distinct_classes(spark, sf):
    return report.distinct_classes(base(spark, sf), "number_diagnoses")


@register("group_share", "WITH " + ENC + """
SELECT round(avg(CASE WHEN race IS NOT DISTINCT FROM 'Caucasian' THEN 1.0 ELSE 0.0 END), 6) AS share FROM enc""")
def q_group_share(spark, sf):
    return r6(report.group_share(S.encounters(spark, sf), "race", "Caucasian"))


@register("shape_report", "WITH " + BASE + """
SELECT 'base' AS name, CAST(count(*) AS BIGINT) AS n_rows, """ + str(len(_ENC_ALL)) + """ AS n_cols FROM base""")
def q_shape_report(spark, sf):
    return clean.shape_report(base(spark, sf), "base")


@register("first_n", "WITH " + BASE + """
SELECT encounter_id, coalesce(patient_nbr, -1) AS patient_nbr, label FROM base ORDER BY encounter_id LIMIT 100""")
def q_first_n(spark, sf):
    return report.first_n(base(spark, sf).select("encounter_id", "patient_nbr", "label").fillna(-1), 100,
                          "encounter_id")


# ------------------------------------------------------------------ 8. models

def _prepared(spark, sf):
    from wardline.plans.readmission import prepare
    return prepare(spark, sf, SEED)


def _fit_eval(spark, sf, name: str, make, balance: str):
    from wardline.operators import models
    p = _prepared(spark, sf)
    est = make(p)
    m = models.fit_balanced(p.train, est, balance, "label", "encounter_id", SEED)
    sc = materialize(models.score(m, p.test, "encounter_id").select("label", "p"), "scores")  # read three times
    return r6(metrics.evaluate(sc, "label", "p", 0.5).select(F.lit(name).alias("model"), "*"))


@register("fit_logistic")
def q_fit_logistic(spark, sf):
    """Logistic regression on the oversampled train split (whose size sets the
    penalty: twice the larger class); test metrics."""
    from wardline.operators import models
    return _fit_eval(spark, sf, "logistic",
                     lambda p: models.logistic(n_train=2 * sample.class_counts(p.train).agg(F.max("n")).first()[0]), "resample")


@register("fit_forest")
def q_fit_forest(spark, sf):
    """Random forest, 100 trees of depth 10, oversampled train; test metrics."""
    from wardline.operators import models
    return _fit_eval(spark, sf, "forest", lambda p: models.forest(100, 10, seed=SEED), "resample")


@register("fit_gbt")
def q_fit_gbt(spark, sf):
    """Boosted trees (100 rounds, depth 6, step 0.3) with balanced class weights."""
    from wardline.operators import models
    return _fit_eval(spark, sf, "gbt", lambda p: models.gbt(100, 6, 0.3, seed=SEED,
                                                             weight_col="weight"), "weights")


@register("fit_mlp")
def q_fit_mlp(spark, sf):
    """Feed-forward network 128-64-32 on the oversampled train split."""
    from wardline.operators import models
    return _fit_eval(spark, sf, "mlp", lambda p: models.mlp(p.encoder.size, (128, 64, 32),
                                                             max_iter=100, seed=SEED), "resample")


@register("fit_gbt_smote")
def q_fit_gbt_smote(spark, sf):
    """Boosted trees (30 rounds, depth 4) on a train split balanced by SMOTE."""
    from wardline.operators import models
    return _fit_eval(spark, sf, "gbt-smote", lambda p: models.gbt(30, 4, 0.3, seed=SEED), "smote")


# ------------------------------------------------------------------ 9. tuning

@register("cv_scores")
def q_cv_scores(spark, sf):
    """Seeded random search: 4 forest configurations x 4 stratified folds of the
    train split; encoders are fitted and the classes balanced inside each
    training fold; score F1."""
    from wardline.operators import models, tune
    from wardline.plans.readmission import prepare_folds
    enc = prepare_folds(spark, sf, 4, SEED)
    space = {"num_trees": ("int", 10, 60), "max_depth": ("int", 3, 10),
             "min_leaf": ("int", 1, 5)}
    configs = tune.draw_configs(spark, space, 4, SEED)
    scores = tune.cv_scores(enc.df, configs, lambda c: models.forest(
        c["num_trees"], c["max_depth"], c["min_leaf"], seed=SEED), "f1", "resample",
        "encounter_id", "fold", 4, SEED, enc.frame)
    return configs.join(tune.summarize(scores), "config")


_SPACE = {"num_trees": ("int", 50, 1000), "subsample": ("float", 0.6, 1.0), "step": ("logfloat", 0.01, 0.3),
          "subset": ("cat", ["sqrt", "log2", "all"])}


def _sql_u(name: str) -> str:
    return f"CAST(('0x' || substr(md5(concat('42:{name}:', CAST(config AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0"


@register("draw_configs", f"""
SELECT CAST(config AS INTEGER) AS config, CAST(least(1000, floor(50 + {_sql_u('num_trees')} * 951)) AS INTEGER) AS num_trees,
  round(0.6 + {_sql_u('subsample')} * (1.0 - 0.6), 6) AS subsample, round(exp(ln(0.01) + {_sql_u('step')} * (ln(0.3) - ln(0.01))), 6) AS step,
  ['sqrt', 'log2', 'all'][CAST(least(2, floor({_sql_u('subset')} * 3)) AS INTEGER) + 1] AS subset
FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS config)""")
def q_draw_configs(spark, sf):
    """As many seeded configurations of a mixed search space as there are customers."""
    from wardline.operators import tune
    return r6(tune.draw_configs(spark, _SPACE, S.read_table(spark, sf, "customer").count(), SEED))


_TRIALS_SQL = """SELECT CAST(user_id % 20 AS INTEGER) AS config, CAST(event_id % 4 AS INTEGER) AS fold,
       value / (value + 100.0) AS score FROM events"""


@register("best_config", "WITH t AS (" + _TRIALS_SQL + """)
SELECT config, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score,
       CAST(count(*) AS BIGINT) AS n_folds
FROM t GROUP BY config ORDER BY avg(score) DESC, config LIMIT 1""")
def q_best_config(spark, sf):
    """Best configuration of a trial score table (config, fold, score)."""
    from wardline.operators import tune
    trials = S.run(spark, sf, _TRIALS_SQL.replace("FROM events", "FROM {events}"))
    return r6(tune.best_config(trials))


# ------------------------------------------------------------------ 10. attribution

_FLAGS = {"change": "Ch", "diabetesMed": "Yes"}


def _sql_raw(c: str) -> str:
    if c in _FLAGS:
        return f"CAST(CASE WHEN \"{c}\" IS NOT DISTINCT FROM '{_FLAGS[c]}' THEN 1 ELSE 0 END AS DOUBLE) AS \"{c}\""
    return f'coalesce({_sql_ordinal(c)}, 0.0) AS "{c}"' if c in DRUGS else f'CAST("{c}" AS DOUBLE) AS "{c}"'


_RAW_SQL = ", ".join(_sql_raw(c) for c in RAW)
_LINEAR_SQL = "WITH " + SPLIT + """,
x AS (SELECT encounter_id, label, is_test, """ + _RAW_SQL + """ FROM split),
cf AS (SELECT """ + ", ".join(f'regr_slope(CAST(label AS DOUBLE), "{c}") AS "w_{c}", avg("{c}") AS "m_{c}"'
                              for c in RAW) + """ FROM x WHERE is_test = 0),
phi AS (SELECT encounter_id, """ + ", ".join(
    f'coalesce("w_{c}", 0) * ("{c}" - "m_{c}") AS "phi_{c}"' for c in RAW) + """
        FROM x, cf WHERE is_test = 1)"""


def _raw(spark, sf):
    from wardline.plans.readmission import raw_features
    return raw_features(spark, sf, SEED)


def _linear_phi(spark, sf):
    from wardline.operators import explain
    from wardline.plans.readmission import raw_features
    raw, cols = raw_features(spark, sf, SEED, as_table=False)    # two passes, no table
    coefs = explain.linear_coefficients(raw.where(F.col("is_test") == 0), cols)
    return explain.shapley_linear(raw.where(F.col("is_test") == 1), coefs, "encounter_id")


@register("shapley_linear", _LINEAR_SQL + "\nSELECT encounter_id, " + ", ".join(
    f'round("phi_{c}", 6) AS "phi_{c}"' for c in RAW) + " FROM phi")
def q_shapley_linear(spark, sf):
    """Exact Shapley values of a linear scorer fitted on train, for test rows."""
    return r6(_linear_phi(spark, sf))


@register("importance_linear", _LINEAR_SQL + """,
l AS (""" + "\nUNION ALL ".join(f"SELECT '{c}' AS feature, abs(\"phi_{c}\") AS v FROM phi" for c in RAW)
    + """)
SELECT feature, round(avg(v), 6) AS importance FROM l GROUP BY feature
ORDER BY avg(v) DESC, feature LIMIT 15""")
def q_importance_linear(spark, sf):
    """Global importance: mean |Shapley value| per feature, top 15."""
    from wardline.operators import explain
    long = explain.to_long(_linear_phi(spark, sf), "encounter_id")
    return r6(report.top_k(report.mean_abs(long, "feature", "value"), 15))


def _lr_scorer(spark, sf):
    """Logistic regression on the raw columns (train split) and a scorer for any
    frame holding those columns."""
    from pyspark.ml.functions import vector_to_array

    from wardline.operators import models
    raw, cols = _raw(spark, sf)
    train = encode.assemble(raw.where(F.col("is_test") == 0), cols)
    model = models.logistic(n_train=None).fit(train)

    def scorer(df):
        return model.transform(encode.assemble(df, cols)).withColumn(
            "p", vector_to_array("probability").getItem(1)).drop(
            "features", "rawPrediction", "probability", "prediction")
    return raw, cols, scorer


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """Accuracy drop per shuffled column, 5 repeats, on the whole test split."""
    from wardline.operators import explain
    raw, cols, scorer = _lr_scorer(spark, sf)
    test = raw.where(F.col("is_test") == 1)
    return r6(explain.permutation_importance(test, cols, scorer, "encounter_id", "label", 5, SEED))


_REPEATS = 3
_BOUND = 1 << 20


def _sql_donors(features: list[str], repeats: int, n: str) -> str:
    """(f, name, r, a, b) of every copy; ``n`` is the number of rows."""
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(features))
    return f"""donors AS (
  SELECT f, name, r, n, list_filter(list_transform(range(0, 400), lambda t: (h1 % m + t) % m + 1), lambda a: gcd(a, n) = 1)[1] AS a, h2 % n AS b
  FROM (SELECT f, name, r, n, least({_BOUND}, greatest(n, 2)) AS m,
          CAST(('0x' || substr(md5(concat('42:perm:', name, ':', CAST(r AS VARCHAR))), 1, 15)) AS BIGINT) AS h1,
          CAST(('0x' || substr(md5(concat('42:perm:', name, ':', CAST(r AS VARCHAR))), 16, 15)) AS BIGINT) AS h2
        FROM (VALUES {names}) v(f, name), (SELECT unnest(range({repeats})) AS r), (SELECT {n} AS n)))"""


def _sql_importance(features: list[str]) -> str:
    """From ``pos(x, <features>, ...)`` and ``donors`` to ``copies`` with each
    feature taken from the donor in its copy."""
    new = ", ".join(f'CASE WHEN d.name = \'{c}\' THEN q."{c}" ELSE o."{c}" END AS "{c}"' for c in features)
    return f"""copies AS (SELECT d.name, d.r, o.label, {new}
  FROM pos o CROSS JOIN donors d JOIN pos q ON q.x = (d.a * o.x + d.b) % d.n)"""


def _sql_linear_p(features: list[str]) -> str:
    terms = " + ".join(f'coalesce("w_{c}", 0.0) * ("{c}" - "m_{c}")' for c in features)
    return f"round(least(greatest(base + ({terms}), 0.001), 0.999), 9)"


def _sql_score_rows(src: str, keys: str) -> str:
    """(score, keys, s) of accuracy at 0.2, log loss and AUC of ``src(keys, label, p)``."""
    k = keys + ", " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    pg = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT 'accuracy' AS score, {k}avg(CASE WHEN CAST(p > 0.2 AS INTEGER) = label THEN 1.0 ELSE 0.0 END) AS s FROM {src} {g}
  UNION ALL SELECT 'log_loss', {k}avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) FROM {src} {g}
  UNION ALL SELECT 'auc', {k}sum(pos * (before + 0.5 * neg)) / (sum(pos) * sum(neg)) FROM (
    SELECT *, coalesce(sum(neg) OVER ({pg} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
      SELECT {k}p, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM {src} GROUP BY {k}p)) {g}"""


_POSITION = """row_number() OVER (ORDER BY md5(concat_ws(':', '42', CAST(encounter_id AS VARCHAR))), encounter_id) - 1 AS x"""


def _linear_scorer(train: DataFrame, cols: list[str]):
    """Probability from the training rate and the sum of univariate slopes."""
    from wardline.operators import explain
    coefs = explain.linear_coefficients(train, cols).collect()
    base = train.agg(F.avg(F.col("label").cast("double"))).first()[0]

    def scorer(df):
        terms = [F.lit(r["weight"] or 0.0) * (F.col(f"`{r['feature']}`") - F.lit(r["mean"])) for r in coefs]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return df.withColumn("p", F.round(F.least(F.greatest(F.lit(base) + total, F.lit(0.001)), F.lit(0.999)), 9))
    return scorer


@register("permutation_importance_linear", _LINEAR_SQL + """,
pos AS (SELECT label, """ + ", ".join(f'"{c}"' for c in RAW) + f""", {_POSITION} FROM x WHERE is_test = 1),
lin AS (SELECT cf.*, (SELECT avg(label) FROM x WHERE is_test = 0) AS base FROM cf),
""" + _sql_donors(RAW, _REPEATS, "(SELECT count(*) FROM pos)") + ",\n" + _sql_importance(RAW) + f""",
s0 AS (SELECT label, {_sql_linear_p(RAW)} AS p FROM pos, lin),
s1 AS (SELECT name, r, label, {_sql_linear_p(RAW)} AS p FROM copies, lin),
t0 AS ({_sql_score_rows("s0", "")}),
t1 AS ({_sql_score_rows("s1", "name, r")})
SELECT t1.score, name AS feature, round(avg(t0.s - t1.s), 6) AS importance_mean, round(stddev_pop(t0.s - t1.s), 6) AS importance_std
FROM t1 JOIN t0 USING (score) GROUP BY t1.score, name""")
def q_permutation_importance_linear(spark, sf):
    """Drop in accuracy (at 0.2), log loss and AUC of a closed-form linear scorer
    when one column is shuffled, 3 repeats, on the whole test split."""
    from wardline.operators import explain
    raw, cols = _raw(spark, sf)
    scorer = _linear_scorer(raw.where(F.col("is_test") == 0), cols)
    test = raw.where(F.col("is_test") == 1)
    out = None
    for score in ("accuracy", "log_loss", "auc"):
        one = explain.permutation_importance(test, cols, scorer, "encounter_id", "label", _REPEATS, SEED, 0.2, score)
        one = one.select(F.lit(score).alias("score"), "*")
        out = one if out is None else out.unionByName(one)
    return r6(out)


_HOT = [f"race_{x}" for x in RACE_LEVELS] + ["time_in_hospital"]
_INVERSE_SQL = "CASE " + " ".join(f"WHEN \"race_{x}\" = 1 THEN '{x}'" for x in RACE_LEVELS) + " ELSE m.mode END"


@register("permutation_importance_onehot", "WITH " + SPLIT + """,
x AS (SELECT encounter_id, label, is_test, """ + _RACE_SQL + """ AS race, CAST(time_in_hospital AS DOUBLE) AS time_in_hospital FROM split),
m AS (SELECT race AS mode FROM x WHERE is_test = 0 AND race IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
rate AS (SELECT race, avg(label) AS rate FROM x WHERE is_test = 0 AND race IS NOT NULL GROUP BY 1),
pos AS (SELECT label, time_in_hospital, """ + ", ".join(f"CAST(coalesce(race = '{x}', false) AS INTEGER) AS \"race_{x}\"" for x in RACE_LEVELS)
    + f""", {_POSITION} FROM x WHERE is_test = 1),
""" + _sql_donors(_HOT, 5, "(SELECT count(*) FROM pos)") + ",\n" + _sql_importance(_HOT) + f""",
i0 AS (SELECT label, time_in_hospital, {_INVERSE_SQL} AS race FROM pos, m),
i1 AS (SELECT name, r, label, time_in_hospital, {_INVERSE_SQL} AS race FROM copies, m),
s0 AS (SELECT avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) AS s FROM
  (SELECT label, round(least(greatest(rate + 0.005 * time_in_hospital, 0.001), 0.999), 9) AS p FROM i0 JOIN rate USING (race))),
s1 AS (SELECT name, r, avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) AS s FROM
  (SELECT name, r, label, round(least(greatest(rate + 0.005 * time_in_hospital, 0.001), 0.999), 9) AS p FROM i1 JOIN rate USING (race)) GROUP BY 1, 2)
SELECT name AS feature, round(avg(s0.s - s1.s), 6) AS importance_mean, round(stddev_pop(s0.s - s1.s), 6) AS importance_std
FROM s1, s0 GROUP BY name""")
def q_permutation_importance_onehot(spark, sf):
    """One-hot columns shuffled one at a time; the scorer turns each row back
    into its level (no column set: the training mode) and looks up its rate.
    Drop in log loss, 5 repeats."""
    from wardline.operators import explain
    sp = clean.replace_sentinel(split_table(spark, sf, "label", "race", "time_in_hospital"), "?", "Unknown", ["race"])
    train, test = sample.train_test(sp)
    levels = encode.vocabulary_levels(encode.fit_vocabulary(train, ["race"]))
    mode = report.mode_level(train, "race").first()["mode"]
    rates = {r["race"]: r["rate"] for r in train.where("race IS NOT NULL").groupBy("race").agg(F.avg(F.col("label").cast("double")).alias("rate")).collect()}
    wide = encode.one_hot(test.select("encounter_id", "label", F.col("time_in_hospital").cast("double").alias("time_in_hospital"), "race"),
                          levels, drop_first=False)
    rate = F.element_at(F.create_map(*[F.lit(x) for r, v in rates.items() for x in (r, v)]), F.col("race"))

    def scorer(df):
        raw = encode.inverse_one_hot(df, "race", levels["race"], mode)
        p = F.round(F.least(F.greatest(rate + F.lit(0.005) * F.col("time_in_hospital"), F.lit(0.001)), F.lit(0.999)), 9)
        return raw.withColumn("p", p)
    hot = [f"race_{x}" for x in levels["race"]] + ["time_in_hospital"]
    return r6(explain.permutation_importance(wide, hot, scorer, "encounter_id", "label", 5, SEED, score="log_loss"))


@register("shapley_sampled")
def q_shapley_sampled(spark, sf, n_explained: int = 5000, n_background: int = 100):
    """Sampled-permutation Shapley values of the logistic model for a sample of
    ``n_explained`` test rows against ``n_background`` train rows, 8 orders
    each; mean |phi|."""
    from wardline.operators import explain
    raw, cols, scorer = _lr_scorer(spark, sf)
    ex = sample.sample_n(raw.where(F.col("is_test") == 1), n_explained, "encounter_id", SEED)
    bg = sample.sample_n(raw.where(F.col("is_test") == 0), n_background, "encounter_id", SEED + 1)
    phi = explain.shapley_sampled(ex, bg, cols, scorer, "encounter_id", 8, SEED)
    return r6(report.top_k(report.mean_abs(phi, "feature", "phi"), 15))


@register("shapley_forest", "WITH " + SPLIT + """
SELECT encounter_id, CAST(0.0 AS DOUBLE) AS gap, CAST(""" + str(len(RAW)) + """ AS BIGINT) AS n_features FROM test
ORDER BY md5(concat_ws(':', '42', CAST(encounter_id AS VARCHAR))), encounter_id LIMIT 500""")
def q_shapley_forest(spark, sf):
    """Shapley values of a forest for 500 test rows against 100 weighted
    centroids of the train split; per row, how far the values are from adding up
    to the row's score less that of its background (0)."""
    from pyspark.ml.functions import vector_to_array

    from wardline.operators import explain, models
    raw, cols = _raw(spark, sf)
    train = encode.assemble(raw.where(F.col("is_test") == 0), cols)
    model = models.fit_balanced(train.select("encounter_id", "label", "features"), models.forest(20, 6, seed=SEED), "weights",
                                "label", "encounter_id", SEED)

    def scorer(df):
        return model.transform(encode.assemble(df, cols)).withColumn("p", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction")
    summary = materialize(explain.kmeans_summary(train.select("features"), 100, "features", SEED), "centroids")
    bg = explain.centroid_background(summary, cols, "encounter_id")
    ex = sample.sample_n(raw.where(F.col("is_test") == 1), 500, "encounter_id", SEED)
    phi = explain.shapley_sampled(ex, bg, cols, scorer, "encounter_id", 4, SEED, weight="size", keep_base=True)
    gap = F.abs(F.sum("phi") - (F.max("full") - F.max("base")))
    return phi.groupBy("encounter_id").agg(F.round(gap, 6).alias("gap"), F.count("*").alias("n_features"))


@register("kmeans_summary")
def q_kmeans_summary(spark, sf):
    """Background summary: 100 weighted k-means centroids of the train features."""
    from wardline.operators import explain
    p = _prepared(spark, sf)
    out = explain.kmeans_summary(p.train, 100, "features", SEED)
    return out.withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


@register("kmeans_sizes", "WITH " + SPLIT + """
SELECT CAST(100 AS BIGINT) AS n_clusters, CAST(count(*) AS BIGINT) AS n_rows FROM train""")
def q_kmeans_sizes(spark, sf):
    """The centroids' weights add up to the rows they stand for."""
    from wardline.operators import explain
    raw, cols = _raw(spark, sf)
    s = explain.kmeans_summary(encode.assemble(raw.where(F.col("is_test") == 0), cols), 100, "features", SEED)
    return s.agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_rows"))


# ------------------------------------------------------------------ 10b. two models, one vote

_CODES = ["diag_1_cat", "diag_2_cat", "diag_3_cat"]
_NUMBERS = ["time_in_hospital", "num_medications", "number_inpatient", "number_emergency", "number_diagnoses"]


def _branches(spark, sf):
    """(train, test) with coded diagnoses and counts, and their column sets."""
    e = encode.group_codes(split(spark, sf), ["diag_1", "diag_2", "diag_3"], fine=True)
    e = materialize(e.select("encounter_id", "label", "is_test", *_CODES, *_NUMBERS), "branches")
    codes, rest = clean.split_by_suffix(e, "_cat")
    train, test = sample.train_test(e)
    return train, test, {"codes": codes, "rest": [c for c in rest if c in _NUMBERS]}


@register("branch_vote", "WITH " + SPLIT + """,
x AS (SELECT encounter_id, label, is_test, """ + ", ".join(f"{_sql_fine(c[:-4])} AS {c}" for c in _CODES) + ", "
          + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _NUMBERS) + """ FROM split),
g AS (SELECT avg(label) AS base, """ + ", ".join(f"regr_slope(CAST(label AS DOUBLE), {c}) AS w_{c}, avg({c}) AS m_{c}" for c in _NUMBERS) + """ FROM x WHERE is_test = 0),
""" + ",\n".join(f"r_{c} AS (SELECT {c}, avg(label) AS rate_{c} FROM x WHERE is_test = 0 GROUP BY 1)" for c in _CODES) + """,
s AS (SELECT encounter_id, (""" + " + ".join(f"coalesce(rate_{c}, base)" for c in _CODES) + """) / 3.0 AS p_codes,
  least(greatest(base + (""" + " + ".join(f"w_{c} * ({c} - m_{c})" for c in _NUMBERS) + """) / 5.0, 0.0), 1.0) AS p_rest
  FROM x CROSS JOIN g """ + " ".join(f"LEFT JOIN r_{c} USING ({c})" for c in _CODES) + """ WHERE is_test = 1)
SELECT encounter_id, round(p_codes, 6) AS p_codes, round(p_rest, 6) AS p_rest, round((0.7 * p_codes + 0.3 * p_rest) / 1.0, 6) AS p FROM s""")
def q_branch_vote(spark, sf):
    """Closed-form models on the diagnosis columns and on the others, scored in
    one pass and voted 0.7 to 0.3."""
    from wardline.operators import ensemble
    train, test, cols = _branches(spark, sf)
    b = ensemble.fit_branches(train, cols, {"codes": ensemble.level_rates, "rest": ensemble.linear_rates})
    return r6(ensemble.vote(test, b, {"codes": 0.7, "rest": 0.3}).select("encounter_id", "p_codes", "p_rest", "p"))


@register("ensemble_vote")
def q_ensemble_vote(spark, sf):
    """Boosted trees on the diagnosis columns and a forest on the others, fitted on one
    balanced split and voted 0.7 to 0.3; test metrics of both and of the vote."""
    from wardline.operators import ensemble, models
    train, test, cols = _branches(spark, sf)
    fits = {"codes": lambda d, c: ensemble.vector_model(d, c, models.gbt(10, 4, 0.3, seed=SEED), True, balance="resample", seed=SEED),
            "rest": lambda d, c: ensemble.vector_model(d, c, models.forest(20, 6, seed=SEED), False, balance="resample", seed=SEED)}
    v = ensemble.vote(test, ensemble.fit_branches(train, cols, fits), {"codes": 0.7, "rest": 0.3})
    v = materialize(v.select("label", "p_codes", "p_rest", "p"), "votes")
    return r6(metrics.compare_models({n: v.select("label", F.col(n).alias("p")) for n in ("p_codes", "p_rest", "p")}))


# ------------------------------------------------------------------ sources / sinks

def _scratch(spark) -> str:
    import uuid

    from wardline.session import checkpoint_dir
    return f"{checkpoint_dir(spark, local_default=True).rstrip('/')}/wardline-{uuid.uuid4().hex}"


@register("csv_roundtrip", "WITH " + ENC + """
SELECT * REPLACE (coalesce(patient_nbr, -1) AS patient_nbr, coalesce(discharge_disposition_id, -1) AS discharge_disposition_id)
FROM enc""")
def q_csv_roundtrip(spark, sf):
    """CSV sink then CSV scan with the declared encounter schema (no inference)."""
    from wardline.sources.tables import read_csv
    e = S.encounters(spark, sf)
    path = _scratch(spark) + "/encounters_csv"
    (e.write.mode("overwrite").option("header", True)
      .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
      .csv(path))
    return read_csv(spark, path).fillna(-1, ["patient_nbr", "discharge_disposition_id"])


_WIDE_SQL_FEATURE = "concat(event_type, '_', CAST(user_id % 40 AS VARCHAR))"


@register("importance_csv", """
SELECT feature, round(importance, 6) AS importance FROM (
  SELECT """ + _WIDE_SQL_FEATURE + """ AS feature, avg(abs(value - 100.0)) AS importance
  FROM events GROUP BY 1) ORDER BY importance DESC, feature LIMIT 60""")
def q_importance_csv(spark, sf):
    """Top-60 of about 200 features written as CSV and read back."""
    from wardline.sources.sinks import write_top_csv
    ev = S.read_table(spark, sf, "events")
    long = ev.select(F.concat("event_type", F.lit("_"), (F.col("user_id") % 40).cast("string"))
                     .alias("feature"), (F.col("value") - 100.0).alias("value"))
    path = _scratch(spark) + "/importance_csv"
    write_top_csv(report.mean_abs(long), path, 60)
    return r6(spark.read.schema("feature string, importance double").option("header", True)
              .csv(path))


@register("model_save_load")
def q_model_save_load(spark, sf):
    """Fitted pipeline saved, loaded back and used to score the test split;
    a report (key, value) of its metrics written and read back."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from wardline.operators import models
    from wardline.sources.sinks import load_model, report_frame, save_model, write_report
    raw, cols = _raw(spark, sf)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"),
                            models.logistic(n_train=None)])
    fitted = pipe.fit(raw.where(F.col("is_test") == 0))
    base = _scratch(spark)
    save_model(fitted, base + "/model")
    loaded = load_model(base + "/model")
    sc = models.score(loaded, raw.where(F.col("is_test") == 1), "encounter_id")
    m = metrics.evaluate(sc, "label", "p").first().asDict()
    write_report(report_frame(spark, m), base + "/report")
    return spark.read.text(base + "/report")


@register("report_file", "WITH " + BASE + """,
r AS (SELECT count(*) AS n_rows, sum(label) AS positives, count(DISTINCT patient_nbr) AS patients FROM base)
SELECT 'n_rows: ' || n_rows AS value FROM r UNION ALL SELECT 'positives: ' || positives FROM r UNION ALL SELECT 'patients: ' || patients FROM r""")
def q_report_file(spark, sf):
    """A key/value report written as text and read back."""
    from wardline.sources.sinks import report_frame, write_report
    r = base(spark, sf).agg(F.count("*").alias("n_rows"), F.sum("label").alias("positives"), F.count_distinct("patient_nbr").alias("patients"))
    path = _scratch(spark) + "/report"
    write_report(report_frame(spark, r.first().asDict()), path)
    return spark.read.text(path)


@register("model_reload", "WITH " + SPLIT + """
SELECT encounter_id, CAST(1 AS INTEGER) AS same FROM test""")
def q_model_reload(spark, sf):
    """A saved and loaded pipeline gives every test row the score it gave before."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from wardline.operators import models
    from wardline.sources.sinks import load_model, save_model
    raw, cols = _raw(spark, sf)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), models.logistic()]).fit(
        raw.where(F.col("is_test") == 0))
    path = _scratch(spark) + "/model"
    save_model(fitted, path)
    test = raw.where(F.col("is_test") == 1)
    was = models.score(fitted, test, "encounter_id").select("encounter_id", F.col("p").alias("was"))
    now = models.score(load_model(path), test, "encounter_id")
    return now.join(was, "encounter_id").select("encounter_id", (F.col("p") == F.col("was")).cast("int").alias("same"))


# ------------------------------------------------------------------ 7. SMOTE

_VEC = "vec AS (" + S.duck(S.VECTORS) + ")"
_KNN_SQL = _VEC + """,
m AS (SELECT key, features FROM vec WHERE label = 1),
pairs AS (SELECT a.key AS qkey, b.key AS nkey, list_distance(a.features, b.features) AS dist
          FROM m a JOIN m b ON a.key <> b.key),
knn AS (SELECT qkey, CAST(row_number() OVER (PARTITION BY qkey ORDER BY dist, nkey) AS INTEGER) AS rank,
               nkey, dist FROM pairs
        QUALIFY row_number() OVER (PARTITION BY qkey ORDER BY dist, nkey) <= 5)"""


@register("knn_minority", "WITH " + _KNN_SQL + """
SELECT qkey, rank, nkey, round(dist, 6) AS dist FROM knn""")
def q_knn_minority(spark, sf):
    """Exact 5 nearest minority neighbours of every minority vector."""
    from wardline.operators import neighbors
    v = S.vectors(spark, sf).where(F.col("label") == 1)
    return r6(neighbors.knn_exact(v, 5, "key", "features", block_rows=64, seed=SEED))


@register("smote_rows", "WITH " + _KNN_SQL + """,
n AS (SELECT count(*) FILTER (WHERE label = 0) - count(*) FILTER (WHERE label = 1) AS n_new,
             count(*) FILTER (WHERE label = 1) AS n_min FROM vec),
ranked AS (SELECT key, features, row_number() OVER (
             ORDER BY md5(concat_ws(':', '42', CAST(key AS VARCHAR))), key) AS rn FROM m),
draws AS (SELECT i,
    CAST(('0x' || substr(md5(concat_ws(':', '42', 'smote', CAST(i AS VARCHAR))), 1, 15)) AS BIGINT) % n_min + 1 AS rn,
    CAST(CAST(('0x' || substr(md5(concat_ws(':', '42', 'nn', CAST(i AS VARCHAR))), 1, 15)) AS BIGINT) % 5 + 1 AS INTEGER) AS rank,
    CAST(('0x' || substr(md5(concat_ws(':', '42', 'gap', CAST(i AS VARCHAR))), 1, 15)) AS BIGINT) / CAST(1152921504606846976 AS DOUBLE) AS u
  FROM (SELECT unnest(range(n_new)) AS i, n_min FROM n)),
synth AS (SELECT d.i, [round(r.features[j] + d.u * (nb.features[j] - r.features[j]), 6)
                        FOR j IN range(1, len(r.features) + 1)] AS features
  FROM draws d JOIN ranked r USING (rn) JOIN knn ON knn.qkey = r.key AND knn.rank = d.rank
  JOIN m nb ON nb.key = knn.nkey)
SELECT CAST(key AS BIGINT) AS key, label, [round(x, 6) FOR x IN features] AS features, 0 AS synthetic FROM vec
UNION ALL SELECT -(i + 1), 1, features, 1 FROM synth""")
def q_smote_rows(spark, sf):
    """SMOTE on the vector stand-in: minority (class 7) grown to the majority size."""
    from wardline.operators import neighbors
    out = neighbors.smote(S.vectors(spark, sf), "label", "key", "features", 5, SEED, block_rows=64)
    return out.withColumn("features", F.transform("features", lambda x: F.round(x, 6)))


# ------------------------------------------------------------------ 11. end to end

@register("readmission_end_to_end")
def q_readmission_end_to_end(spark, sf):
    """Leak-free run: prepare (fit on train only) -> 3 stratified folds of the
    train split, encoders fitted per fold -> seeded search over 3 logistic
    configurations with oversampling inside each training fold (F1) -> best
    configuration -> refit on the oversampled train split -> test metrics."""
    from wardline.operators import models, tune
    from wardline.plans.readmission import prepare_folds
    enc = prepare_folds(spark, sf, 3, SEED)
    configs = tune.draw_configs(spark, {"reg": ("logfloat", 1e-4, 1e-1)}, 3, SEED)
    scores = tune.cv_scores(enc.df, configs, lambda c: models.logistic(max_iter=100).setRegParam(
        c["reg"]), "f1", "resample", "encounter_id", "fold", 3, SEED, enc.frame)
    best = tune.best_config(scores).join(configs, "config").first()
    p = _prepared(spark, sf)
    final = models.fit_balanced(p.train, models.logistic(max_iter=100).setRegParam(best["reg"]),
                                "resample", "label", "encounter_id", SEED)
    sc = materialize(models.score(final, p.test, "encounter_id").select("label", "p"), "scores")  # read three times
    out = metrics.evaluate(sc, "label", "p", 0.5)
    return r6(out.select(F.lit(int(best["config"])).alias("config"),
                         F.lit(float(best["reg"])).alias("reg_param"),
                         F.lit(float(best["mean_score"])).alias("cv_f1"), "*"))
