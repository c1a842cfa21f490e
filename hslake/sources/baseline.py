"""A readiness baseline kept as a snapshot: written whole, checked when written and when read, and compared only under the rules and the scope that it was taken with."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hslake.sources.shared import exists, publish, read_text, write_text

LAST_US = 253402300799999000
KEY = ["computer", "application", "peer"]
#: Counts of which each row of the total has at most one.
EXCLUSIVE = {"key establishment": ["pq_keys", "classical_keys", "unknown_keys"], "server authentication": ["pq_auth", "classical_auth", "unknown_auth"], "completion": ["complete", "failures"]}
MOST_ROWS, MOST_RULES, MOST_MINUTES = 20_000, 128, 525_600


class BaselineRefused(ValueError):
    """Which invariant a baseline breaks."""


def check(rows: DataFrame, about: dict, most_rows: int | None = MOST_ROWS) -> None:
    """Raises for the first broken invariant; the rows are looked at in one aggregation by key and one over its keys."""
    if about.get("schema") != 1:
        raise BaselineRefused("unsupported schema")
    rules = about.get("rules")
    if not isinstance(rules, list) or len(rules) > MOST_RULES or not all(isinstance(r, str) and 0 < len(r) <= 128 for r in rules):
        raise BaselineRefused("classification rules")
    if not isinstance(about.get("scope"), str) or len(about["scope"]) > 32768 or not about.get("database") or len(about["database"]) > 256:
        raise BaselineRefused("scope or database")
    if not isinstance(about.get("minutes"), int) or not 0 <= about["minutes"] <= MOST_MINUTES:
        raise BaselineRefused("window length")
    counts = [c for group in EXCLUSIVE.values() for c in group]
    bad = {
        "null or long keys": " or ".join(f"{k} is null or length({k}) > 4096" for k in KEY),
        "times": f"first_us is null or last_us is null or first_us < 0 or last_us < first_us or last_us > {LAST_US}",
        "counts": "total is null or total < 0 or " + " or ".join(f"{c} is null or {c} < 0 or {c} > total" for c in counts),
        **{f"exclusive counts of {n}": " + ".join(f"cast({c} as decimal(38, 0))" for c in group) + " > total" for n, group in EXCLUSIVE.items()},
    }
    keyed = rows.groupBy(*[F.lower(k).alias(k) for k in KEY]).agg(F.count("*").alias("copies"), *[F.max(F.coalesce(F.expr(f"int({e})"), F.lit(0))).alias(f"b{i}") for i, e in enumerate(bad.values())])
    found = keyed.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.coalesce(F.max("copies"), F.lit(0)).alias("copies"), *[F.coalesce(F.max(f"b{i}"), F.lit(0)).alias(f"b{i}") for i in range(len(bad))]).first()
    for i, name in enumerate(bad):
        if found[f"b{i}"]:
            raise BaselineRefused(name)
    if found.copies > 1:
        raise BaselineRefused("keys aren't unique")
    if most_rows is not None and found.n > most_rows:
        raise BaselineRefused(f"over {most_rows} rows; narrow the scope")


def save_baseline(rows: DataFrame, path: str, *, database: str, scope: str, minutes: int, rules: list[str], most_rows: int | None = MOST_ROWS, replace: bool = False) -> None:
    """Checks and publishes the cohort rows with what they were taken under."""
    about = {"schema": 1, "database": database, "scope": scope, "minutes": minutes, "rules": rules}
    check(rows, about, most_rows)

    def write(df: DataFrame, at: str) -> None:
        df.write.parquet(f"{at}/rows")
        write_text(df.sparkSession, f"{at}/about.json", json.dumps(about))

    publish(rows, path, write=write, replace=replace)


def load_baseline(spark: SparkSession, path: str, *, most_rows: int | None = MOST_ROWS) -> tuple[DataFrame, dict]:
    """The rows and what they were taken under, checked."""
    text = read_text(spark, f"{path}/about.json")
    if text is None or not exists(spark, f"{path}/rows/_SUCCESS"):
        raise BaselineRefused("no baseline")
    try:
        about = json.loads(text)
    except ValueError:
        raise BaselineRefused("unreadable") from None
    rows = spark.read.parquet(f"{path}/rows")
    check(rows, about, most_rows)
    return rows, about


def comparable(about: dict, *, scope: str, minutes: int, rules: list[str]) -> None:
    """Raises unless a baseline may be held against a view of this scope, window length and classification rules."""
    if (about["scope"], about["minutes"]) != (scope, minutes):
        raise BaselineRefused("the baseline's scope or window length isn't the view's")
    if about["rules"] != rules:
        raise BaselineRefused("the baseline was taken under other classification rules")
