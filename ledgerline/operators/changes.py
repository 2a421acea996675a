"""Change capture, change apply and point-in-time state.

* ``diff``          two versions of a keyed table -> change log rows
                    (INSERT after-image, UPDATE before+after, DELETE before)
* ``touch_updated`` refresh ``updated_at`` on changed rows only
* ``latest_per_key`` last change per record as one aggregation
                    (``max_by`` on the log id: partial aggregation before
                    the shuffle, so a hot record never lands whole in one task)
* ``apply_changes`` fold a change log into a base table
* ``state_as_of``   table state at time T from the log alone
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import row_json
from .keys import assign_dense_keys

OPS = ("INSERT", "UPDATE", "DELETE")


def diff(old: DataFrame, new: DataFrame, key: str, compare: list[str] | None = None,
         table_name: str = "loans") -> DataFrame:
    """Change log between two versions.  Only real changes are emitted
    (columns compared NULL-safely); images are JSON keeping NULL fields."""
    cols = [c for c in new.columns]
    compare = compare or [c for c in cols if c != key]
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns]).withColumn("_o", F.lit(True))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in cols]).withColumn("_n", F.lit(True))
    j = o.join(n, F.col(f"o_{key}") == F.col(f"n_{key}"), "full_outer")
    changed = F.lit(False)
    for c in compare:
        changed = changed | ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    op = (F.when(F.col("_o").isNull(), "INSERT").when(F.col("_n").isNull(), "DELETE")
          .when(changed, "UPDATE"))
    changed_cols = F.concat_ws(",", *[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.lit(c))
                                       for c in compare])
    old_img = row_json(*[F.col(f"o_{c}").alias(c) for c in old.columns])
    new_img = row_json(*[F.col(f"n_{c}").alias(c) for c in cols])
    return (j.withColumn("operation", op).where(F.col("operation").isNotNull())
            .select(F.lit(table_name).alias("table_name"), "operation",
                    F.coalesce(F.col(f"n_{key}"), F.col(f"o_{key}")).alias("record_id"),
                    F.when(F.col("operation") == "UPDATE", changed_cols).alias("changed_columns"),
                    F.when(F.col("operation") != "INSERT", old_img).alias("old_values"),
                    F.when(F.col("operation") != "DELETE", new_img).alias("new_values")))


def audit_log(old: DataFrame | None, new: DataFrame, key: str, at: Column, by: str, start: int = 0,
              compare: list[str] | None = None, table_name: str = "loans") -> DataFrame:
    """The changes from ``old`` (None: empty) to ``new`` as log rows: dense ids after ``start``, time, author, images."""
    log = diff(old if old is not None else new.limit(0), new, key, compare, table_name).drop("changed_columns")
    log = assign_dense_keys(log, ["record_id"], "log_id", start)
    return log.select("log_id", "table_name", "operation", F.col("record_id").cast("long").alias("record_id"),
                      F.lit(by).alias("changed_by"), at.cast("timestamp_ntz").alias("change_time"), "old_values", "new_values")


def as_variant(log: DataFrame) -> DataFrame:
    """The log with its images parsed once into VARIANT (null fields stay, as null), read field by field later on."""
    return log.withColumns({c: F.parse_json(c) for c in ("old_values", "new_values") if c in log.columns})


def image_field(image: str | Column, name: str, kind: str = "string") -> Column:
    """A field of a VARIANT image; null where the image lacks it, holds null, or something of another kind."""
    return F.try_variant_get(image, f"$.{name}", kind)


def state_from_variant(log: DataFrame, at: Column, schema: T.StructType) -> DataFrame:
    """Like ``state_from_images`` of a log with VARIANT images: each column is taken out of the stored value, no text is parsed."""
    last = latest_per_key(log.where(F.col("change_time") <= at).select("record_id", "log_id", "operation", "new_values"))
    # times without zone are texts in the image
    return last.where(F.col("operation") != "DELETE").select(*[
        (image_field("new_values", f.name).cast(f.dataType) if isinstance(f.dataType, (T.TimestampNTZType, T.DateType))
         else image_field("new_values", f.name, f.dataType.simpleString())).alias(f.name) for f in schema.fields])


def state_from_images(log: DataFrame, at: Column, schema: T.StructType) -> DataFrame:
    """The table at time ``at``, read back from the after-images of its log."""
    last = latest_per_key(log.where(F.col("change_time") <= at).select("record_id", "log_id", "operation", "new_values"))
    row = F.from_json("new_values", schema).alias("row")
    return last.where(F.col("operation") != "DELETE").select(row).select("row.*")


def touch_updated(old: DataFrame, new: DataFrame, key: str, at: Column,
                  col: str = "updated_at") -> DataFrame:
    """``new`` with ``updated_at`` = ``at`` where the row changed, else the old value."""
    compare = [c for c in new.columns if c not in (key, col)]
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in compare], F.col(col).alias("_o_ts"), F.lit(True).alias("_o_is"))
    j = new.join(o, key, "left")
    changed = F.lit(False)
    for c in compare:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return (j.withColumn(col, F.when(F.col("_o_is").isNull(), F.col(col))
                         .when(changed, at).otherwise(F.col("_o_ts")))
            .select(*new.columns))


def latest_per_key(log: DataFrame, key: str = "record_id", order: str = "log_id") -> DataFrame:
    """Last change per key: one aggregation with max_by over the order column."""
    payload = [c for c in log.columns if c != key]
    agg = log.groupBy(key).agg(F.max_by(F.struct(*payload), F.col(order)).alias("_last"))
    return agg.select(key, *[F.col(f"_last.{c}").alias(c) for c in payload])


def apply_changes(base: DataFrame, log: DataFrame, key: str, attrs: list[str],
                  order: str = "log_id") -> DataFrame:
    """Base table after the changes in ``log`` (columns: key, operation,
    order column, attrs).  The last change per key wins; DELETE removes the
    row; UPDATE of an absent key inserts it; keys without changes keep
    their base row."""
    last = latest_per_key(log.select(key, order, "operation", *attrs), key, order)
    b = base.select(key, *attrs).withColumn("_in_base", F.lit(True))
    j = b.alias("b").join(last.alias("c"), key, "full_outer")
    has_change = F.col("c.operation").isNotNull()
    out = j.where(~has_change | (F.col("c.operation") != "DELETE"))
    return out.select(key, *[F.when(has_change, F.col(f"c.{a}")).otherwise(F.col(f"b.{a}")).alias(a)
                             for a in attrs])


def fold_changes(state: DataFrame | None, log: DataFrame, key: str, attrs: list[str], order: str = "log_id") -> DataFrame:
    """State with the log id and a delete marker of each key, after the changes in ``log``.

    Only a greater log id replaces a key's row, so batches may come in any
    order and more than once.  ``live_state`` drops the markers.
    """
    last = latest_per_key(log.select(key, order, "operation", *attrs), key, order)
    rows = last.select(key, *attrs, F.col(order).alias("_log_id"), (F.col("operation") == "DELETE").alias("_deleted"))
    if state is not None:
        rows = state.select(*rows.columns).unionByName(rows)
    payload = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*payload), F.col("_log_id")).alias("_last"))
    return best.select(key, *[F.col(f"_last.{c}").alias(c) for c in payload])


def live_state(state: DataFrame) -> DataFrame:
    return state.where(~F.col("_deleted")).drop("_log_id", "_deleted")


def state_as_of(log: DataFrame, at: Column, key: str, attrs: list[str], time_col: str = "change_time",
                order: str = "log_id") -> DataFrame:
    """State at time ``at`` from the log: last change per key up to ``at``,
    deleted keys dropped.  The time filter reaches the scan."""
    last = latest_per_key(log.where(F.col(time_col) <= at).select(key, order, "operation", time_col, *attrs),
                          key, order)
    return last.where(F.col("operation") != "DELETE").select(key, *attrs, time_col)


def latest_changes(log: DataFrame, n: int = 20, order: str = "log_id") -> DataFrame:
    """Newest ``n`` log rows (top-k: each task keeps its own top n)."""
    return log.orderBy(F.col(order).desc()).limit(n)


def events_as_change_log(events: DataFrame) -> DataFrame:
    """The driver's ``events`` stream as a change log of a user table:
    signup -> INSERT, error -> DELETE, anything else -> UPDATE."""
    op = (F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE")
          .otherwise("UPDATE"))
    return events.select(
        F.col("event_id").alias("log_id"), F.lit("users").alias("table_name"), op.alias("operation"),
        F.col("user_id").alias("record_id"), F.lit(None).cast("string").alias("changed_by"),
        F.col("ts").alias("change_time"), F.col("event_type"), F.col("value"), F.col("props"))

