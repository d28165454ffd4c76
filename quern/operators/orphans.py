"""References to records that do not exist, were withdrawn, or arrive later."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import ensure_checkpoint_dir

#: Most bits of a Bloom filter, which is sent to the executors (16 MB), and bits for each key. More keys than one
#: filter takes are parted by their hash into blocks, each with a filter of its own.
MAX_BITS = 1 << 27
BITS_PER_KEY = 10

REASONS = ("missing", "deleted", "late")


def _bloom(keys: DataFrame, n_keys: int) -> bytes:
    """The serialised filter of the column ``h`` of ``keys``, built with partial aggregation."""
    made = keys._jdf.stat().bloomFilter("h", n_keys, max(64, BITS_PER_KEY * n_keys))
    out = keys.sparkSession._jvm.java.io.ByteArrayOutputStream()
    made.writeTo(out)
    return bytes(out.toByteArray())


def _might_contain(spark, filter_bytes: bytes, hashed: Column) -> Column:
    """Membership as a JVM expression, so that the probe stays in generated code."""
    utils = spark._jvm.org.apache.spark.sql.classic.ExpressionUtils
    probe = spark._jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain
    return Column(utils.column(probe(utils.expression(F.lit(filter_bytes)._jc), utils.expression(hashed._jc))))


def _key(column: str, dtype: str) -> Column:
    """Text keys are compared trimmed; blank text is null."""
    c = F.col(f"`{column}`")
    return F.nullif(F.trim(c), F.lit("")) if dtype == "string" else c


def parent_states(parents: DataFrame, keys: Sequence[str], received: str, deleted: str | None) -> DataFrame:
    """One row per key: __k0.., ``__born`` (earliest arrival) and ``__gone`` (earliest withdrawal)."""
    kinds = dict(parents.dtypes)
    cols = [_key(k, kinds[k]).alias(f"__k{i}") for i, k in enumerate(keys)]
    gone = F.col(f"`{deleted}`") if deleted else F.lit(None).cast("timestamp_ntz")
    rows = parents.select(*cols, F.col(f"`{received}`").alias("__born"), gone.alias("__gone"))
    names = [f"__k{i}" for i in range(len(keys))]
    return rows.dropna(subset=names).groupBy(*names).agg(F.min("__born").alias("__born"), F.min("__gone").alias("__gone"))


def find_orphans(
    refs: DataFrame,
    parents: DataFrame,
    *,
    row_id: str,
    ref_keys: Sequence[str],
    parent_keys: Sequence[str],
    ref_received: str,
    parent_received: str,
    parent_deleted: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """References of ``refs`` whose key is 'missing' in ``parents``, 'deleted' or 'late' when the reference arrived.

    Result: ``row_id``, the ``carry`` columns and ``reason``. A reference with a null or blank key part is none.
    'deleted' holds if a row of the key was withdrawn at or before the reference's arrival, else 'late' if the
    key's earliest arrival is after the reference's; unknown times are neither. Repeated referring rows are
    reported one by one; an empty parent table makes every reference 'missing'.

    A Bloom filter of the parent keys is sent along with the tasks: what it rejects is certainly missing and never
    shuffled. Only references that pass it, narrowed to keys and time, are joined exactly with one row per key; adaptive
    execution splits a key that holds most of them. With more keys than a filter takes, references and keys are written
    to the shared folder by blocks of their hash, without a shuffle, and each block is probed with its own filter, so
    that driver and executors hold one filter at a time, however many keys there are.
    """
    kinds, parent_kinds = dict(refs.dtypes), dict(parents.dtypes)
    names = [f"__k{i}" for i in range(len(ref_keys))]
    states = parent_states(parents, parent_keys, parent_received, parent_deleted)
    narrow = refs.select(
        F.col(f"`{row_id}`"), *[F.col(f"`{c}`") for c in carry], *[_key(k, kinds[k]).alias(n) for k, n in zip(ref_keys, names)], F.col(f"`{ref_received}`").alias("__at")
    ).dropna(subset=names)

    typed = [F.col(n).cast(dict(states.dtypes)[n]) for n in names]
    narrow = narrow.select(row_id, *carry, *[t.alias(n) for t, n in zip(typed, names)], "__at")
    n_keys = parents.count()  # at least the number of keys; read from the files' footers
    if n_keys == 0:
        return narrow.select(row_id, *carry, F.lit("missing").alias("reason"))
    hashed = parents.select(*[_key(k, parent_kinds[k]).alias(n) for k, n in zip(parent_keys, names)]).dropna().select(F.xxhash64(*names).alias("h"))
    probed = _probed(narrow, hashed, F.xxhash64(*[F.col(n) for n in names]), n_keys)
    reason = F.when(F.col("__born").isNull() & F.col("__known").isNull(), "missing").when(F.col("__gone") <= F.col("__at"), "deleted").when(F.col("__born") > F.col("__at"), "late")
    absent = probed.where(~F.col("__hit")).select(row_id, *carry, F.lit("missing").alias("reason"))
    met = probed.where("__hit").drop("__hit").join(states.withColumn("__known", F.lit(True)), names, "left").withColumn("reason", reason)
    return absent.unionByName(met.where(F.col("reason").isNotNull()).select(row_id, *carry, "reason"))


def _probed(narrow: DataFrame, keys: DataFrame, hashed: Column, n_keys: int) -> DataFrame:
    """``narrow`` with ``__hit``: whether the filter of the hashes in ``keys`` lets the row pass."""
    spark = narrow.sparkSession
    blocks = math.ceil(BITS_PER_KEY * n_keys / MAX_BITS)
    if blocks <= 1:
        hit = F.lit(False) if keys.isEmpty() else _might_contain(spark, _bloom(keys, n_keys), hashed)
        return narrow.withColumn("__hit", hit)
    folder = f"{ensure_checkpoint_dir(spark)}/orphans-{uuid.uuid4().hex}"
    block = lambda h: F.pmod(h, F.lit(blocks)).cast("int")
    narrow.withColumn("__block", block(hashed)).write.partitionBy("__block").parquet(f"{folder}/refs")
    keys.withColumn("__block", block(F.col("h"))).write.partitionBy("__block").parquet(f"{folder}/keys")
    rows = spark.read.schema(T.StructType([*narrow.schema.fields, T.StructField("__block", T.IntegerType())])).parquet(f"{folder}/refs")
    known = spark.read.schema("h long, __block int").parquet(f"{folder}/keys")
    for b in range(blocks):
        mine = known.where(F.col("__block") == b)
        n = mine.count()
        hit = _might_contain(spark, _bloom(mine, n), hashed) if n else F.lit(False)
        rows.where(F.col("__block") == b).drop("__block").withColumn("__hit", hit).write.mode("append").parquet(f"{folder}/probed")
    return spark.read.parquet(f"{folder}/probed")


def orphan_report(orphans: DataFrame, period: str, by: Sequence[str] = ("ref_table", "ref_field")) -> DataFrame:
    """Orphans counted per table, field, period and reason; partial counts are made before the shuffle."""
    return orphans.groupBy(*by, period, "reason").agg(F.count(F.lit(1)).alias("orphans"))
