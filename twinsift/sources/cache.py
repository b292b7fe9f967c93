"""Fingerprint and analysis caches keyed by (path, mtime, size).

A cache is a folder of Parquet versions and a pointer file; a write makes a new version
and then renames a new pointer over the old one, so a reader sees a whole version or the one
before.  One writer at a time: of two that start from the same version the later one wins.
"""

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("path", "mtime", "size")


def lookup(files: DataFrame, cache: DataFrame, value: str) -> DataFrame:
    """Files with `value` of a valid entry, else null, and is_hit.  Valid: same time and
    size, and the value isn't null."""
    c = cache.select(*[F.col(k).alias(f"c_{k}") for k in KEYS], F.col(value))
    same = (F.col("path") == F.col("c_path")) & (F.col("mtime") == F.col("c_mtime")) & (F.col("size") == F.col("c_size"))
    return files.join(c, same, "left").drop("c_path", "c_mtime", "c_size").withColumn("is_hit", F.col(value).isNotNull())


def misses(files: DataFrame, cache: DataFrame, value: str) -> DataFrame:
    """Files whose value must be computed."""
    return files.join(cache.filter(F.col(value).isNotNull()), list(KEYS), "left_anti")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the entries of `new` in place of those of the same path."""
    return cache.join(new.select("path"), "path", "left_anti").unionByName(new)


VERSION = re.compile(r"v-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")


def _path(spark, name):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark, folder):
    """The version that the pointer names; None if there is no pointer or it is corrupt.
    Other failures are raised: a cache that can't be reached isn't an empty one."""
    path, fs = _path(spark, f"{folder}/CURRENT")
    if not fs.exists(path):
        return None
    data = fs.open(path)
    try:
        name = bytes(data.readNBytes(100)).decode(errors="replace").strip()
    except Py4JJavaError as e:
        if "ChecksumException" not in e.java_exception.getClass().getName():
            raise
        return None
    finally:
        data.close()
    if not VERSION.fullmatch(name):
        return None
    done, fs = _path(spark, f"{folder}/{name}/_SUCCESS")
    return name if fs.exists(done) else None


def read(spark, folder, schema) -> DataFrame:
    """The current version; empty if there is none.  Corrupt files of it hold no entries."""
    name = current(spark, folder)
    if name is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(f"{folder}/{name}")


def write(spark, folder, cache: DataFrame):
    """Writes a version, then makes it current by one rename over the pointer, so that there is
    always a pointer to a whole version; the version before last goes."""
    name, before = f"v-{uuid.uuid4()}", current(spark, folder)
    cache.write.parquet(f"{folder}/{name}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    (path, fs), (new, _) = _path(spark, f"{folder}/CURRENT"), _path(spark, f"{folder}/.{name}")
    out = fs.create(new, True)
    out.write(bytearray(name.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    whole = fs.makeQualified(path)
    hadoop.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), whole, over)
    for status in fs.listStatus(path.getParent()):
        old = status.getPath()
        if VERSION.fullmatch(old.getName()) and old.getName() not in (name, before):
            fs.delete(old, True)


def write_if_changed(spark, folder, cache: DataFrame, new: DataFrame) -> bool:
    """Nothing is written when there is nothing new."""
    if new.isEmpty():
        return False
    write(spark, folder, upsert(cache, new))
    return True
