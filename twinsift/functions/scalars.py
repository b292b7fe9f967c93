"""Scalar column functions; all stay in generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c):
    return F.col(c) if isinstance(c, str) else c


def hamming(a, b) -> Column:
    """Bits that differ between two 64-bit fingerprints."""
    return F.bit_count(col(a).bitwiseXOR(col(b))).cast("long")


def fixed(c, digits) -> Column:
    """Text with so many decimals, ties to even; null stays null."""
    x = col(c).cast("double")
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", F.bround(x, digits)))


def humansize(c) -> Column:
    """Bytes in steps of 1024 up to GB: no decimals for B, one for the rest."""
    n = col(c).cast("double")
    return (
        F.when(n < 1024, F.concat(fixed(n, 0), F.lit("B")))
        .when(n < 1024**2, F.concat(fixed(n / 1024, 1), F.lit("KB")))
        .when(n < 1024**3, F.concat(fixed(n / 1024**2, 1), F.lit("MB")))
        .otherwise(F.concat(fixed(n / 1024**3, 1), F.lit("GB")))
    )


def finite(c) -> Column:
    """Neither null nor NaN nor infinite."""
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def file_name(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def suffix(path) -> Column:
    """The last suffix with its dot, in lower case; empty if the name has none or only a
    leading dot."""
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1))


def stem(path) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^/])\.[^./]+$", "")


def relative(path, root) -> Column:
    """The path below root; the name alone where it isn't below."""
    p = col(path)
    return F.when(p.startswith(f"{root}/"), F.substring(p, len(root) + 2, 1 << 30)).otherwise(file_name(p))


def display_path(path, root, recursive) -> Column:
    return relative(path, root) if recursive else file_name(path)


def direction(kind, weight) -> Column:
    """1 if higher is better, -1 if lower is, 0 if the row isn't scored."""
    return F.when(col(kind) == "score", 1).when(col(weight).isNull(), 0).otherwise(F.signum(weight)).cast("int")
