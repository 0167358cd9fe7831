"""Literal dimensions of the sensor domain, as small tables that join by broadcast (a fixed number of rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Metrics with their wire codes, baselines by tier, and accuracies of probes.
METRICS = [
    ("dissolved_oxygen", 97, "Dissolved oxygen", "mg/L", "doError"), ("orp", 98, "ORP", "mV", "orpError"), ("ph", 99, "pH", None, "phError"),
    ("conductivity", 100, "Conductivity", "µS/cm", "ecError"), ("temperature", 102, "Temperature", "°F", "rtdError"), ("turbidity", 72, "Turbidity", "NTU", "turbError"),
]
ALIASES = {"do": "dissolved_oxygen", "ec": "conductivity"}
TIERS = {"Freshwater": "fresh", "Brackish": "brackish", "Estuarine": "brackish", "Marine": "sea"}
BASELINES = {
    "dissolved_oxygen": {"fresh": (6, 11), "brackish": (5, 9), "sea": (5, 8)},
    "orp": {"fresh": (200, 400), "brackish": (150, 350), "sea": (200, 400)},
    "conductivity": {"fresh": (50, 1500), "brackish": (1000, 35000), "sea": (45000, 55000)},
    "ph": {"fresh": (6.5, 8.5), "brackish": (7.0, 8.3), "sea": (7.8, 8.3)},
    "turbidity": {"fresh": (5, 25), "brackish": (5, 100), "sea": (5, 10)},
}
ACCURACY_ABSOLUTE = {"ph": 0.002, "orp": 1.0, "dissolved_oxygen": 0.05}
ACCURACY_SHARE = {"conductivity": 0.02}


def metrics(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(METRICS, "key string, code int, label string, unit string, error_flag string"))


def baselines(spark: SparkSession) -> DataFrame:
    """(water_type, metric, baseline_min, baseline_max); temperature has none."""
    rows = [(water, m, float(by[tier][0]), float(by[tier][1])) for water, tier in TIERS.items() for m, by in BASELINES.items()]
    return F.broadcast(spark.createDataFrame(rows, "water_type string, metric string, baseline_min double, baseline_max double"))


def metric_key(name: str) -> str:
    """A metric by its key or alias, or `all`."""
    low = name.strip().lower()
    known = {k: k for k, *_ in METRICS} | ALIASES | {"all": "all"}
    if low not in known:
        raise ValueError(f'Unknown metric "{name}". Valid metrics: {", ".join(k for k, *_ in METRICS)}, all.')
    return known[low]


def with_baselines(series: DataFrame, water: str = "water_type") -> DataFrame:
    """The series with the baseline of its site's water; null for temperature and for water that is not known."""
    known = baselines(series.sparkSession).withColumnRenamed("water_type", water)
    return series.join(known, [water, "metric"], "left")


# Ranges that operators are told, by water; not the baselines of reports.
OPERATOR_RANGES = [
    ("ph", "6.5 to 8.5", "6.5 to 8.5"), ("orp", "200 to 400 mV", "200 to 400 mV"), ("dissolved_oxygen", "5 to 14 mg/L", "5 to 14 mg/L"), ("temperature", "32 to 95 °F", "32 to 95 °F"),
    ("conductivity", "0 to 1,500 µS/cm", "40,000 to 50,000 µS/cm"), ("turbidity", "0 to 25 NTU", "0 to 10 NTU"),
]


def operator_ranges(spark: SparkSession, water: str) -> DataFrame:
    """(metric, range) for freshwater or saltwater."""
    at = {"freshwater": 1, "saltwater": 2}[water]
    return F.broadcast(spark.createDataFrame([(r[0], r[at]) for r in OPERATOR_RANGES], "metric string, range string"))
