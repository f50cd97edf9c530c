"""Data-quality checks. A check is a row (check, status, value, details); status is PASS, WARN, FAIL or INFO."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LEDGER = "check string, status string, value string, details string"


def assert_columns(df: DataFrame, exact: Sequence[str] = (), required: Sequence[str] = (), forbidden: Sequence[str] = ()) -> DataFrame:
    """Exact ordered header, required superset, and columns that must be absent."""
    if exact and df.columns != list(exact):
        raise ValueError(f"columns {df.columns} are not {list(exact)}")
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    if present := [c for c in forbidden if c in df.columns]:
        raise ValueError(f"columns not allowed: {present}")
    return df


def unexpected_categories(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside the list, with their rows."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def exactly_one(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The relation, each key of which must occur once; a repeated key raises when its row is read."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    first = keys[0]
    kind = dict(df.dtypes)[first]
    return df.withColumn(first, F.when(n == 1, F.col(first)).otherwise(F.raise_error(F.lit("expected one row of a key")).cast(kind)))


def find_row(df: DataFrame, **criteria):
    """The one row whose columns read as the given values; none or several raise."""
    found = df
    for k, v in criteria.items():
        found = found.filter(F.col(k).cast("string") == str(v))
    rows = found.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one row for {criteria}, found {'none' if not rows else 'several'}")
    return rows[0]


def versions() -> dict[str, str]:
    """Versions of what a run depends on, for its record."""
    import platform
    from importlib import metadata

    return {"python": platform.python_version()} | {p: metadata.version(p) for p in ("pyspark", "pyarrow", "pandas", "numpy")}


def forbidden_features(features: Sequence[str], forbidden: Sequence[str]) -> list[str]:
    """Features a model must not use: named as, or made from, a forbidden column."""
    return [f for f in features if any(f == x or f.startswith(f"{x}_") for x in forbidden)]


def same_key_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    return ka.join(kb, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(kb.join(ka, list(keys), "left_anti").withColumn("side", F.lit("right")))


def compare_relations(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Full outer comparison: difference per value, and whether all agree. Two NULLs agree, one does not."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(True).alias("_b"))
    joined = left.join(right, list(keys), "full")
    agree = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for v in values:
        both_null = F.col(f"{v}_a").isNull() & F.col(f"{v}_b").isNull()
        agree = agree & F.coalesce(both_null | (F.abs(F.col(f"{v}_a") - F.col(f"{v}_b")) <= tolerance), F.lit(False))
    return joined.withColumns({f"{v}_diff": F.abs(F.col(f"{v}_a") - F.col(f"{v}_b")) for v in values}).withColumn("agrees", agree).drop("_a", "_b")


def check_row(name: str, ok: Column, value: Column, details: str = "", otherwise: str = "FAIL") -> Column:
    return F.struct(
        F.lit(name).alias("check"), F.when(ok, "PASS").otherwise(otherwise).alias("status"),
        F.coalesce(value.cast("string"), F.lit("NA")).alias("value"), F.lit(details).alias("details"),
    )


def ledger(df: DataFrame, checks: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """Checks ``name -> (aggregate, predicate on it)``, all from one pass over the relation."""
    agg = df.agg(*[c.alias(n) for n, (c, _) in checks.items()])
    rows = F.array(*[check_row(n, ok(F.col(n)), F.col(n)) for n, (_, ok) in checks.items()])
    return agg.select(F.inline(rows))


def failed(checks: DataFrame) -> bool:
    return checks.filter(F.col("status") == "FAIL").limit(1).count() > 0


def guarded(spark: SparkSession, stage: str, run: Callable[[], DataFrame]) -> DataFrame:
    """The checks of a run, or one FAIL row that carries its error."""
    try:
        return run()
    except Exception as e:  # the failure itself is the result
        return spark.createDataFrame([(stage, "FAIL", type(e).__name__, str(e)[:500])], LEDGER)


def enumeration_invariants(windows: DataFrame, targets: DataFrame, key: str, seq: str, k: str, start: str, window: str) -> DataFrame:
    """Targets whose window count, first and last start or window text break the enumeration rule."""
    joined = windows.select(key, k, start, window).join(targets.select(key, seq), key)
    agg = joined.groupBy(key, k, F.length(seq).alias("_n")).agg(
        F.count(F.lit(1)).alias("n"), F.min(start).alias("first"), F.max(start).alias("last"),
        F.count_if(F.substring(F.col(seq), F.col(start), F.col(k)) != F.col(window)).alias("n_wrong"),
    )
    want = F.col("_n") - F.col(k) + 1
    return agg.filter((F.col("n") != want) | (F.col("first") != 1) | (F.col("last") != want) | (F.col("n_wrong") > 0)).drop("_n")


def mask_faults(df: DataFrame, original: str, masked: str, mask: str = "N") -> DataFrame:
    """Rows whose masked text differs from the original elsewhere than at masked letters."""
    pairs = F.zip_with(F.split(original, ""), F.split(masked, ""), lambda a, b: (a == b) | (b == mask))
    return df.filter((F.length(original) != F.length(masked)) | ~F.forall(pairs, lambda x: x))


def identity_faults(df: DataFrame, seq: str, length: str, digest: str) -> DataFrame:
    """Registered sequences whose length or SHA-256 is not the registered one."""
    return df.filter((F.length(seq) != F.col(length).cast("int")) | (F.sha2(seq, 256) != F.lower(F.col(digest))))


def leakage(train: DataFrame, held_out: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on both sides of a fold."""
    return train.select(*keys).distinct().join(held_out.select(*keys), list(keys), "left_semi")


def required_files(paths: Sequence[str]) -> list[str]:
    """Paths that are absent, empty or unreadable."""
    return [p for p in paths if not os.path.isfile(p) or not os.access(p, os.R_OK) or os.path.getsize(p) == 0]


def is_within(path: str, root: str) -> bool:
    """Whether a path lies in a folder, links resolved."""
    a, b = os.path.realpath(path), os.path.realpath(root)
    return os.path.commonpath([a, b]) == b


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Unchanged:
    """Context that fails if one of the files changed while it ran."""

    def __init__(self, paths: Sequence[str]):
        self.paths = list(paths)

    def __enter__(self) -> Unchanged:
        self.before = {p: file_digest(p) for p in self.paths}
        return self

    def __exit__(self, kind, *_rest) -> None:
        if kind is None and (changed := [p for p in self.paths if file_digest(p) != self.before[p]]):
            raise RuntimeError(f"inputs changed: {changed}")
