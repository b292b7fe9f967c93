"""File scans as relations of paths."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift import config
from twinsift.functions import images as I
from twinsift.functions.scalars import col, suffix

OTHER_SUFFIXES = (".heic", ".heif", ".webp")  # beyond the JVM's decoders


def has_suffix(path, suffixes=config.IMAGE_SUFFIXES) -> Column:
    return suffix(path).isin(*suffixes)


def outside(path, directory) -> Column:
    """Not in the directory or below it."""
    p = col(path)
    return (p != directory) & ~p.startswith(f"{directory}/")


def below(path, directory, recursive) -> Column:
    """A direct child of the directory (a name or a column), or anything below it if recursive."""
    p, folder = col(path), F.concat(directory if isinstance(directory, Column) else F.lit(directory), F.lit("/"))
    inside = p.startswith(folder) & (p != folder)
    return inside if recursive else inside & (F.instr(F.substr(p, F.length(folder) + 1), "/") == 0)


def path_key(path) -> Column:
    """Sorting by it compares path components, not characters across the separator."""
    return F.split(col(path), "/")


def plain(path) -> Column:
    """A file: path as binaryFile gives it (not encoded) without its scheme."""
    return F.regexp_replace(col(path), "^file:/+", "/")


def literal(path: str) -> str:
    """A path to load by name: its glob characters mean themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def decoded_uri(uri) -> Column:
    """A file: URI as the image source gives it (encoded) as a path; a plus sign is itself."""
    return F.url_decode(F.replace(plain(uri), F.lit("+"), F.lit("%2B")))


def select_files(paths: DataFrame, directory, recursive=False, exclude=None, suffixes=config.IMAGE_SUFFIXES, path="path") -> DataFrame:
    """The scan's filters over a relation that has a path column."""
    out = paths.filter(below(path, directory, recursive) & has_suffix(path, suffixes))
    return out.filter(outside(path, exclude)) if recursive and exclude else out


def scan(spark, cfg: config.ScanConfig, suffixes=config.IMAGE_SUFFIXES) -> DataFrame:
    """Rows path, length, modificationTime of the image files of a directory.

    The suffix test is on the path, so contents of other files are never read; names that
    start with `_` or `.` are left out by Spark's listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(cfg.recursive).lower()).load(cfg.directory)
    files = files.select(plain("path").alias("path"), "length", "modificationTime")
    return select_files(files, cfg.directory, cfg.recursive, cfg.dest_dir, suffixes)


FEW_PATHS = 20_000  # listed by name; beyond that the directory is read and joined


def images(spark, cfg: config.ScanConfig, wanted: DataFrame, few=FEW_PATHS) -> DataFrame:
    """Rows path, image (height -1 where it can't be decoded) of the `wanted` paths alone.

    Few paths (a checked number) are loaded by name, so that other files are neither read nor
    decoded; more are picked from the directory's rows.  What Spark doesn't decode goes through
    `images.other_formats`, where an optional decoder is installed.
    """
    paths = [r[0] for r in wanted.select("path").limit(few + 1).collect()]
    if not paths:
        return spark.createDataFrame([], f"path string, image {I.IMAGE_TYPE}")
    source = spark.read.format("image")
    if len(paths) <= few:
        loaded = source.load([literal(p) for p in paths])
        rows = loaded.select(decoded_uri("image.origin").alias("path"), "image")
    else:
        loaded = source.option("recursiveFileLookup", str(cfg.recursive).lower()).load(cfg.directory)
        rows = loaded.select(decoded_uri("image.origin").alias("path"), "image").join(wanted.select("path"), "path", "left_semi")
    if I.other_decoder() is None:
        return rows
    other = wanted.select("path").filter(suffix("path").isin(*OTHER_SUFFIXES))
    data = spark.read.format("binaryFile").option("recursiveFileLookup", str(cfg.recursive).lower()).load(cfg.directory).select(plain("path").alias("path"), "content")
    return rows.filter(~suffix("path").isin(*OTHER_SUFFIXES)).unionByName(data.join(other, "path", "left_semi").select("path", I.other_formats("path", "content").alias("image")))
