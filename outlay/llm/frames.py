"""Small frame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.sources.storage import new_folder, shuffles_released


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back, which also cuts its lineage. The
    shuffle files of the write are not needed after it and go at its end."""
    spark = df.sparkSession
    path = new_folder(spark, f"llm-{label}")
    with shuffles_released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """A 128-bit key of a text; null and empty texts share one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def row_key() -> Column:
    """128 bits of a row's id and text; a null and an empty text have one key."""
    return text_key(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))
    )


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_bits(keys: DataFrame, key: str, max_bits: int = 1 << 27, per_key: int = 256) -> bytes:
    """A bit set of 64-bit keys for a broadcast: two bits for each key, from its upper and its
    lower end.

    Sized by the number of keys, at most `max_bits`, so that at most max_bits / 8 bytes reach the
    driver. Beyond the bound it lets more foreign keys pass; users must check what passes.
    """
    import numpy as np

    n = keys.count()
    log = max(6, min(max_bits.bit_length() - 1, (max(n, 1) * per_key - 1).bit_length()))
    ends = F.array(
        F.shiftrightunsigned(F.col(key), 64 - log), F.col(key).bitwiseAND(F.lit((1 << log) - 1))
    )
    words = (
        keys.select(F.explode(ends).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    )
    out = np.zeros(1 << (log - 6), dtype=np.int64)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def has_bit(bits, hashed):
    """Which of the uint64 values are in a bit set made by hash_bits."""
    import numpy as np

    log = int(np.log2(len(bits) * 64))

    def one(bit):
        return (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)

    upper, lower = hashed >> np.uint64(64 - log), hashed & np.uint64((1 << log) - 1)
    return (one(upper) & one(lower)) == 1
