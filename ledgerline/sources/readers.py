"""Typed source readers (never infer a schema).

* ``read_typed``   Parquet / JSON / CSV with an explicit StructType, cast
                   to the declared types (decimal money, NTZ timestamps)
* ``jdbc_options`` connection options from the session conf or the
                   environment (``spark.ledgerline.source.*`` / ``LEDGERLINE_SOURCE_*``),
                   never spliced into SQL text
* ``read_jdbc``    partitioned JDBC extract on a numeric key (parallel
                   range reads), projection and filter pushed to the source
* ``split_points`` even splits of a skewed key from a quantile sketch, as predicates
* ``ingest``       typed rows and rejects with their reasons, from one scan
* ``extract_*``    the three source extracts of the load
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas as S


class MissingColumnError(ValueError):
    pass


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Select and cast to the declared schema; a missing declared column without a default is an error."""
    defaults = defaults or {}
    missing = [f.name for f in schema.fields if f.name not in df.columns and f.name not in defaults]
    if missing:
        raise MissingColumnError(f"the source lacks {', '.join(missing)}")
    df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                     for f in schema.fields])
    return apply_defaults(df, defaults)


def read_typed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               defaults: dict | None = None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if fmt != "parquet":
        reader = reader.schema(schema)
    return conform(reader.load(path), schema, defaults)


def jdbc_options(spark: SparkSession, prefix: str = "source") -> dict[str, str]:
    """url/user/password/driver from ``spark.ledgerline.<prefix>.*`` or
    ``LEDGERLINE_<PREFIX>_*`` environment variables."""
    out = {}
    for k in ("url", "user", "password", "driver"):
        v = spark.conf.get(f"spark.ledgerline.{prefix}.{k}", None) or \
            os.environ.get(f"LEDGERLINE_{prefix.upper()}_{k.upper()}")
        if v:
            out[k] = v
    return out


def custom_schema(schema: T.StructType) -> str:
    """JDBC ``customSchema`` text for the declared types."""
    return ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in schema.fields)


def read_jdbc(spark: SparkSession, table: str, schema: T.StructType, options: dict[str, str],
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    r = (spark.read.format("jdbc").options(**options).option("dbtable", table)
         .option("customSchema", custom_schema(schema)))
    if partition_column:
        if lower is None or upper is None or num_partitions is None:
            raise ValueError("a partitioned read needs lower, upper and num_partitions")
        r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower))
             .option("upperBound", str(upper)).option("numPartitions", str(num_partitions)))
    return conform(r.load(), schema)


def extract_customers(customers: DataFrame) -> DataFrame:
    """Active customers, staging columns (filter and projection reach the source)."""
    return customers.where(F.col("is_active")).select(*S.STG_CUSTOMER_COLS)


def extract_loans(loans: DataFrame) -> DataFrame:
    return loans.select(*S.STG_LOAN_COLS)


def extract_payments(payments: DataFrame) -> DataFrame:
    return payments.select(*[F.coalesce(F.col(c), F.lit(0).cast(S.MONEY)).alias(c) if c == "penalty_portion"
                             else F.col(c) for c in S.STG_PAYMENT_COLS])


def apply_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Column defaults at ingest: NULL -> declared default."""
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c]).cast(df.schema[c].dataType)).alias(c)
                       if c in defaults else F.col(c) for c in df.columns])


def ingest(df: DataFrame, schema: T.StructType, defaults: dict | None = None, lengths: dict[str, int] | None = None) -> DataFrame:
    """The declared columns by ``try_cast``, the raw row as JSON, and ``reasons``: what is wrong with it, in the order of the columns.

    A row with a value that is not of its declared type, is missing without default, or is too long
    has reasons; the others have an empty array.  No row is dropped and none fails the run.
    """
    defaults, lengths = defaults or {}, lengths or {}
    missing = [f.name for f in schema.fields if f.name not in df.columns and f.name not in defaults]
    if missing:
        raise MissingColumnError(f"the source lacks {', '.join(missing)}")
    values, reasons = [], []
    for f in schema.fields:
        raw = F.col(f.name) if f.name in df.columns else F.lit(None).cast("string")
        value = raw.try_cast(f.dataType)
        reason = F.when(raw.isNotNull() & value.isNull(), F.lit(f"{f.name}: not {f.dataType.simpleString()}"))
        if f.name in lengths:
            reason = reason.when(F.length(value) > lengths[f.name], F.lit(f"{f.name}: longer than {lengths[f.name]}"))
        if f.name in defaults:
            value = F.when(raw.isNull(), F.lit(defaults[f.name]).cast(f.dataType)).otherwise(value)
        elif not f.nullable:
            reason = reason.when(raw.isNull(), F.lit(f"{f.name}: missing"))
        values.append(value.alias(f.name))
        reasons.append(reason)
    raw_row = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(*values, raw_row.alias("raw"), F.array_compact(F.array(*reasons)).alias("reasons"))


def ingest_into(df: DataFrame, schema: T.StructType, path: str, defaults: dict | None = None,
                lengths: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with raw row and reasons): the source is scanned once, both are written side by side under ``path``."""
    spark = df.sparkSession
    tagged = ingest(df, schema, defaults, lengths)
    bad = F.size("reasons") > 0
    # good rows need no raw image
    tagged.withColumn("raw", F.when(bad, F.col("raw"))).withColumn("rejected", bad).write.mode("errorifexists").partitionBy("rejected").parquet(path)
    back = spark.read.schema(T.StructType([*tagged.schema.fields, T.StructField("rejected", T.BooleanType())])).parquet(path)
    return back.where("NOT rejected").select(*[f.name for f in schema.fields]), back.where("rejected").select("raw", "reasons")


def split_points(keys: DataFrame, key: str, splits: int) -> list:
    """At most ``splits`` - 1 rising values that cut the rows evenly, from a quantile sketch (one pass; ``splits`` numbers are gathered).

    The sketch's rank error is a hundredth of a split.  A value that fills several splits cuts once.
    """
    at = [i / splits for i in range(1, splits)]
    got = keys.where(F.col(key).isNotNull()).agg(F.percentile_approx(key, at, 100 * splits).alias("p")).first()["p"] if at else None
    return sorted(set(got)) if got else []


def split_predicates(key: str, points: list) -> list[str]:
    """Conditions in SQL that hold for each row in exactly one place: half-open ranges, and null with the first."""
    text = [f"'{p}'" if not isinstance(p, (int, float)) else str(p) for p in points]
    if not text:
        return ["1 = 1"]
    inner = [f"{key} > {a} AND {key} <= {b}" for a, b in zip(text, text[1:])]
    return [f"{key} <= {text[0]} OR {key} IS NULL", *inner, f"{key} > {text[-1]}"]


def read_jdbc_splits(spark: SparkSession, table: str, schema: T.StructType, options: dict[str, str], key: str, points: list) -> DataFrame:
    """A parallel extract, a connection per split; ``points`` come from the keys of the last extract (``split_points``)."""
    options = dict(options)
    url = options.pop("url")
    return conform(spark.read.jdbc(url, table, predicates=split_predicates(key, points),
                                   properties={**options, "customSchema": custom_schema(schema)}), schema)
