"""Column names and roles: lists worked out on the driver from a schema, applied by one select."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of date columns, of sparse measurements and of known 0/1 columns in hospital tables.
DATETIME_COLUMNS = "admittime dischtime intime outtime deathtime edregtime edouttime dnr_first_charttime timecmo_chart".split()
SPARSE_COLUMNS = """Creatinine_body_fluid_mean Lymphocytes_atypical_CSL_mean Creatinine_pleural_mean Creatinine_ascites_mean Albumin_ascites_mean
Albumin_urine_mean Lymphocytes_percent_mean Albumin_pleural_mean Calcium_urine_mean Red_blood_cell_count_pleural_mean Lymphocytes_pleural_mean
Lactate_dehydrogenase_pleural_mean Eosinophils_mean Lymphocytes_ascites_mean Red_blood_cell_count_ascites_mean Total_Protein_mean
Lymphocytes_body_fluid_mean Monocytes_CSL_mean Red_blood_cell_count_CSF_mean Total_Protein_Urine_mean Venous_PvO2_mean Lymphocytes_atypical_mean
Troponin-I_mean Chloride_urine_mean Cholesterol_LDL_mean Post_Void_Residual_mean Cholesterol_HDL_mean Cholesterol_mean White_blood_cell_count_urine_mean
Red_blood_cell_count_urine_mean Pulmonary_Capillary_Wedge_Pressure_mean Creatinine_urine_mean Height_mean Cardiac_Output_fick_mean Basophils_mean
Lactate_dehydrogenase_mean Fibrinogen_mean""".split()
SPARSE_PANEL_COLUMNS = """pH_urine_mean Monocytes_mean Lymphocytes_mean Neutrophils_mean Troponin-T_mean Albumin_mean Positive_end-expiratory_pressure_mean
Alkaline_phosphate_mean Alanine_aminotransferase_mean Asparate_aminotransferase_mean Bilirubin_mean Lactic_acid_mean Lactate_mean Weight_mean
Cardiac_Output_Thermodilution_mean Pulmonary_Artery_Pressure_mean_mean Plateau_Pressure_mean Tidal_Volume_Spontaneous_mean Potassium_serum_mean
Systemic_Vascular_Resistance_mean CO2_mean Cardiac_Index_mean Partial_pressure_of_oxygen_mean Tidal_Volume_Set_mean Fraction_inspired_oxygen_mean
Respiratory_rate_Set_mean Calcium_ionized_mean""".split()
BINARY_COLUMNS = """vent vaso adenosine dobutamine dopamine epinephrine isuprel milrinone norepinephrine phenylephrine vasopressin colloid_bolus
crystalloid_bolus nivdurations mort_icu mort_hosp hospital_expire_flag readmission_30 fullcode_first dnr_first fullcode dnr cmo_first cmo_last cmo
hospstay_seq gender sedation""".split()
ID_COLUMNS = ("subject_id", "hadm_id", "icustay_id", "hours_in")
LAG = "_lag1"


@dataclass(frozen=True)
class TrajectorySchema:
    """Roles of a longitudinal table's columns."""

    id: str
    time: str
    static: tuple[str, ...] = ()
    dynamic: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()


def normalize_column_name(name: object) -> str:
    """``('Heart Rate', 'mean')``, as a tuple or as its text, becomes ``Heart_Rate_mean``; other names stay."""
    if isinstance(name, str) and name.strip().startswith("(") and name.strip().endswith(")"):
        try:
            parsed = ast.literal_eval(name.strip())
        except (ValueError, SyntaxError, TypeError):
            return name
        if not (isinstance(parsed, tuple) and len(parsed) == 2):
            return name
        name = parsed
    return "_".join(str(part).replace(" ", "_") for part in name) if isinstance(name, tuple) else str(name)


def normalize_column_name_list(names: Iterable[object]) -> list[str]:
    """Normalised names without repeats, in order."""
    return list(dict.fromkeys(map(normalize_column_name, names)))


def flatten_column_names(df: DataFrame) -> DataFrame:
    """All columns renamed to their normalised names."""
    return df.toDF(*map(normalize_column_name, df.columns))


def columns_to_drop_mean_only_biophysical(names: Iterable[str]) -> list[str]:
    """``X_std`` and ``X_count`` where ``X_mean`` is there too."""
    names = list(names)
    have = set(names)
    return [n for n in names for end in ("_std", "_count") if n.endswith(end) and n.removesuffix(end) + "_mean" in have]


def columns_to_drop_default_feature_pruning(names: Iterable[str], sparse: Iterable[str] = (*SPARSE_COLUMNS, *SPARSE_PANEL_COLUMNS)) -> list[str]:
    """Those, and the sparse measurements with their lags, in the order of the table."""
    names = list(names)
    gone = set(columns_to_drop_mean_only_biophysical(names)) | {n + end for n in sparse for end in ("", LAG)}
    return [n for n in names if n in gone]


def prune(df: DataFrame, sparse: Iterable[str] = (*SPARSE_COLUMNS, *SPARSE_PANEL_COLUMNS)) -> DataFrame:
    return df.drop(*columns_to_drop_default_feature_pruning(df.columns, sparse))


def drop_datetime_columns(df: DataFrame, names: Iterable[str] = DATETIME_COLUMNS, by_type: bool = False) -> DataFrame:
    """Without the listed date columns and, if asked, without any of a date or time type."""
    typed = [f.name for f in df.schema if by_type and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    return df.drop(*names, *typed)


def drop_id_columns(df: DataFrame) -> DataFrame:
    return df.drop(*ID_COLUMNS)


def split_static_dynamic(names: Sequence[str], static_names: Iterable[str], id_col: str = "subject_id", time_col: str = "hours_in") -> tuple[list[str], list[str]]:
    """Static columns (those named in a side table) and dynamic ones (the rest without ids, time and lags of ids)."""
    ids = {*ID_COLUMNS, id_col, time_col}
    ids |= {f"{i}_lag{k}" for i in tuple(ids) for k in range(1, 10)}
    wanted = set(normalize_column_name_list(static_names))
    static = [n for n in names if n in wanted and n not in ids]
    return static, [n for n in names if n not in ids and n not in wanted]


def is_lagged(name: str) -> bool:
    """Whether a name ends in ``_lag1`` (other lags don't count)."""
    return name.endswith(LAG)


def get_base_feature_name(name: str) -> str:
    return name.removesuffix(LAG)


def get_known_binary_features_with_lag(names: Iterable[str] = BINARY_COLUMNS) -> set[str]:
    return {n + end for n in names for end in ("", LAG)}


def _is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def identify_feature_types(df: DataFrame, names: Sequence[str] | None = None, known_binary: Iterable[str] = (), force: bool = False) -> dict[str, list[str]]:
    """Lists ``numeric``, ``binary``, ``categorical`` and ``integer`` of columns, in one pass over the table.

    Binary: whole numbers with no value but 0 and 1; a known name counts if its values do
    too, or on the name alone with ``force``. Values decide, not the storage type, so a
    column of 0.0 and 1.0 with nulls under a known name is binary.
    """
    fields = {f.name: f.dataType for f in df.schema if names is None or f.name in names}
    known = get_known_binary_features_with_lag(known_binary)
    numeric = [n for n, k in fields.items() if isinstance(k, T.NumericType)]
    tested = [n for n in numeric if _is_integer(fields[n]) or n in known]
    flags = df.agg(*[F.coalesce(F.bool_and(F.col(f"`{n}`").isin(0, 1)), F.lit(False)).alias(str(i)) for i, n in enumerate(tested)]).first() if tested else []
    binary = {n for n, ok in zip(tested, flags, strict=True) if ok or (force and n in known)}
    return {
        "numeric": [n for n in numeric if n not in binary],
        "binary": [n for n in numeric if n in binary],
        "categorical": [n for n in fields if n not in numeric],
        "integer": [n for n in numeric if n not in binary and _is_integer(fields[n])],
    }


def is_binary_feature(df: DataFrame, name: str, known_binary: Iterable[str] = BINARY_COLUMNS) -> bool:
    return bool(identify_feature_types(df, [name], known_binary)["binary"])


def first_present(names: Iterable[str], aliases: Iterable[str]) -> str | None:
    """The first alias that is among the names."""
    have = set(names)
    return next((a for a in aliases if a in have), None)


def common_columns(*frames: DataFrame, drop: Iterable[str] = ()) -> list[str]:
    """Names that all frames have, sorted, without those dropped."""
    return sorted(set.intersection(*[set(f.columns) for f in frames]) - set(drop))


def align_to(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in order; those missing are 0, and so are nulls."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) if n in have else F.lit(0.0)).alias(n) for n in names])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def valid_common_numeric_columns(real: DataFrame, synth: DataFrame) -> list[str]:
    """Numeric columns of both tables with two finite values and some variance in each; a pass a table."""
    names = sorted(set(numeric_columns(real)) & set(numeric_columns(synth)))
    if not names:
        return []
    ok = set(names)
    for df in (real, synth):
        finite = {n: F.when(F.abs(F.col(f"`{n}`").cast("double")) < float("inf"), F.col(f"`{n}`").cast("double")) for n in names}
        row = df.agg(*[x for i, n in enumerate(names) for x in (F.count(finite[n]).alias(f"n{i}"), F.stddev_pop(finite[n]).alias(f"s{i}"))]).first()
        ok &= {n for i, n in enumerate(names) if row[f"n{i}"] >= 2 and row[f"s{i}"] and row[f"s{i}"] > 0}
    return [n for n in names if n in ok]
