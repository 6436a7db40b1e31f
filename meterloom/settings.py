"""Frozen settings with lower-cased names and values, warnings, errors, and models as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, is_dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MeterError(Exception):
    """Base of this package's errors."""


class NoBaselineData(MeterError):
    pass


class NoReportingData(MeterError):
    pass


class DataInsufficient(MeterError):
    """Raised when a disqualified meter's model is asked for."""


class DisqualifiedModel(MeterError):
    pass


@dataclass(frozen=True)
class Notice:
    qualified_name: str
    description: str
    data: dict | list | None = None

    def as_dict(self) -> dict:
        return asdict(self)


def make(kind: type, developer: bool = False, locked: frozenset[str] = frozenset(), **values):
    """Settings of a frozen dataclass. Names and text values are stripped and lower-cased; unknown names,
    and locked ones without developer=True, raise ValueError."""
    names = {f.name for f in fields(kind)}
    clean = {k.strip().lower(): v.strip().lower() if isinstance(v, str) else v for k, v in values.items()}
    if unknown := set(clean) - names:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    if not developer and (shut := set(clean) & locked):
        raise ValueError(f"settings {sorted(shut)} need developer mode")
    return replace(kind(), **clean)


def require(df: DataFrame, columns: dict[str, str | tuple[str, ...]]) -> None:
    """ValueError unless df has the columns with one of the types named (simple strings)."""
    have = dict(df.dtypes)
    for c, kinds in columns.items():
        kinds = (kinds,) if isinstance(kinds, str) else kinds
        if c not in have:
            raise ValueError(f"column {c} is missing; there are {sorted(have)}")
        if kinds and have[c] not in kinds:
            raise ValueError(f"column {c} is {have[c]}, not {' or '.join(kinds)}")


def qualified(df: DataFrame, judged: DataFrame, key: str = "meter_id", ignore: bool = False) -> DataFrame:
    """Rows of the meters without a disqualification."""
    return df if ignore else df.join(judged.where(F.size("disqualification") == 0).select(key), key, "left_semi")


def params_to_json(params: DataFrame, key: str = "meter_id", settings=None) -> DataFrame:
    """(meter, model): each meter's coefficient rows and the settings as JSON text."""
    rows = params.groupBy(key).agg(F.collect_list(F.struct(*[c for c in params.columns if c != key])).alias("submodels"))
    info = F.lit(json.dumps(asdict(settings)) if is_dataclass(settings) else "{}")
    return rows.select(key, F.to_json(F.struct("submodels", info.alias("settings"))).alias("model"))


def params_from_json(models: DataFrame, schema: str, key: str = "meter_id") -> DataFrame:
    """The rows that params_to_json was given; schema is theirs without the key."""
    parsed = models.select(key, F.from_json("model", f"submodels array<struct<{_struct(schema)}>>, settings string").alias("m"))
    return parsed.select(key, F.explode("m.submodels").alias("s")).select(key, "s.*")


def _struct(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def import_legacy(spark: SparkSession, models: list[tuple[str, dict]]) -> DataFrame:
    """Coefficients of older models (model_type and model_params) as one undivided block from -100 to 200 degrees.

    Types: intercept_only, hdd_only, cdd_only, cdd_hdd. Their intervals are unknown, so infinite."""
    rows = []
    for meter, m in models:
        kind, p = m["model_type"], m["model_params"]
        if kind not in ("intercept_only", "hdd_only", "cdd_only", "cdd_hdd"):
            raise ValueError(f"unknown model type {kind}")
        hdd, cdd = "hdd" in kind, "cdd" in kind
        hb, cb = p.get("heating_balance_point"), p.get("cooling_balance_point")
        hb, cb = (hb if hdd else cb if cdd else 0.0), (cb if cdd else hb if hdd else 0.0)
        rows.append((meter, "fw-su_sh_wi", "fw-su_sh_wi", kind, float(hb), float(p.get("beta_hdd", 0.0) if hdd else 0.0), 0.0, float(cb), float(p.get("beta_cdd", 0.0) if cdd else 0.0), 0.0, float(p["intercept"]), -100.0, 200.0, float("inf"), 0, 0.0))
    from meterloom.models.daily import PARAMS

    return spark.createDataFrame(rows, f"meter_id string, {PARAMS}")
