"""Fingerprints: columns or relations that give each item 60 or 64 bits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_BITS = 60


def token_hash(c) -> Column:
    """60 bits of a token's MD5, so that SQL engines without unsigned shifts agree."""
    return F.conv(F.substring(F.md5(c), 1, TOKEN_BITS // 4), 16, 10).cast("long")


FIELDS, FIELD = 3, 20  # counters held in one long: bits k, k + 20 and k + 40 of the hash
CHUNK = 1 << (FIELD - 1)  # distinct words that a counter is given at most


def simhash(df: DataFrame, key, text) -> DataFrame:
    """Rows key, fp: a bit is set where more of the text's distinct words have it set.

    One exploded row a word and 20 partial sums of three packed counters each; texts of
    more than CHUNK words are counted in chunks, so that no counter runs over.  A text
    without words has no row.
    """
    words = df.select(key, F.posexplode(F.array_distinct(F.split(F.lower(text), " "))).alias("at", "w")).filter("w <> ''")
    words = words.select(key, F.floor(F.col("at") / CHUNK).alias("chunk"), token_hash(F.col("w")).alias("h"))
    ones = sum(1 << (FIELD * f) for f in range(FIELDS))
    packed = words.groupBy(key, "chunk").agg(F.count("*").alias("n"), *[F.sum(F.shiftright("h", k).bitwiseAND(ones)).alias(f"s{k}") for k in range(FIELD)])
    # a row for each text and chunk from here on: arrays keep the plan (and its code) short
    sums = F.array(*[f"s{k}" for k in range(FIELD)])
    place = F.sequence(F.lit(0), F.lit(TOKEN_BITS - 1))
    mask = (1 << FIELD) - 1
    counts = F.transform(place, lambda b: F.call_function("shiftright", F.get(sums, b % FIELD), (F.floor(b / FIELD) * FIELD).cast("int")).bitwiseAND(mask))
    votes = packed.select(key, "n", counts.alias("c")).groupBy(key).agg(F.sum("n").alias("n"), F.collect_list("c").alias("cs"))
    total = F.aggregate("cs", F.array_repeat(F.lit(0).cast("long"), TOKEN_BITS), lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    # Horner from the highest bit down
    fp = F.aggregate(F.reverse(total), F.struct(F.lit(0).cast("long").alias("f"), F.col("n").alias("n")), lambda a, c: F.struct((a["f"] * 2 + (c * 2 > a["n"]).cast("long")).alias("f"), a["n"].alias("n")), lambda a: a["f"])
    return votes.select(key, fp.alias("fp"))


def mean_bits(vector) -> Column:
    """64 bits of a 64-element array, first element highest: is it above the mean of the
    others than the first?  Null unless it has 64 elements."""
    v = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double"))
    total = F.aggregate(F.slice(v, 2, 63), F.lit(0.0), lambda a, x: a + x)
    # shifted in two's complement: the top bit is the sign
    bits = F.aggregate(v, F.struct(F.lit(0).cast("long").alias("h"), (total / 63).alias("m")), lambda a, x: F.struct((F.shiftleft(a["h"], 1) + (x > a["m"]).cast("long")).alias("h"), a["m"].alias("m")), lambda a: a["h"])
    return F.when(F.size(v) == 64, bits)
