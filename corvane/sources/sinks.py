"""Writers with the fixed number format: NULL and non-finite as NA, integral floats as integers, else %.12g."""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def format_value(x, digits: int = 12, missing: str = "NA", booleans: tuple[str, str] = ("TRUE", "FALSE")) -> str:
    if x is None:
        return missing
    if isinstance(x, bool):
        return booleans[0] if x else booleans[1]
    if isinstance(x, float):
        if not math.isfinite(x):
            return missing
        return str(int(x)) if x == int(x) else f"{x:.{digits}g}"
    return str(x)


def format_column(x: Column, digits: int = 12) -> Column:
    """The same for a DOUBLE column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: format_value(None if v is None or pd.isna(v) else float(v), digits))

    return run(x)


def formatted(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 12, missing: str = "NA") -> DataFrame:
    """All columns as text in the contract's format, in the given order."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        if kinds[c] in ("double", "float"):
            v = format_column(F.col(c).cast("double"), digits)
        elif kinds[c] == "boolean":
            v = F.upper(F.col(c).cast("string"))
        else:
            v = F.col(c).cast("string")
        out.append(F.coalesce(v, F.lit(missing)).alias(c))
    return df.select(*out)


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None, sep: str = "\t", compression: str = "none", **fmt) -> None:
    """A folder of delimited part files; the committer publishes it only when complete."""
    formatted(df, columns, **fmt).write.mode("overwrite").csv(path, sep=sep, header=True, compression=compression, emptyValue="", quote='"')


def write_single_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None, order: Sequence[str] = (), limit: int = 1_000_000, **fmt) -> None:
    """One local file, written beside its name and then renamed; for reports of at most ``limit`` rows."""
    columns = list(columns or df.columns)
    rows = (df.orderBy(*order) if order else df).select(*columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a single file; use write_tsv")
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "w", newline="") as f:
        f.write("\t".join(columns) + "\n")
        for r in rows:
            f.write("\t".join(format_value(v, **fmt) for v in r) + "\n")
    os.replace(temporary, path)


def write_fasta(df: DataFrame, path: str, key: str, seq: str) -> None:
    df.select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), F.col(seq))).write.mode("overwrite").text(path)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small relation as a Markdown table."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(format_value(v) for v in r) + " |" for r in df.limit(limit).collect()]
    return "\n".join(lines) + "\n"


def canonical_json(value) -> str:
    """Sorted keys, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def javascript_wrapper(name: str, value) -> str:
    """The same as an assignment a page can load without a server."""
    return f"window.{name}={canonical_json(value)};\n"


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text with its columns in name order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))
