"""Keyed load operators on immutable table versions.

There is no in-place DML on Parquet: each operator takes the current
version and the staged batch and returns the next version as a
DataFrame, which the caller writes to a fresh directory and commits.

* ``upsert``         insert new keys, refresh ``update_cols`` of matched keys
* ``one_per_key``    rows that repeat count once, rows of one key that differ are marked
* ``conflicts``      the keys whose rows differ, with both images
* ``insert_absent``  append rows whose key is not present yet
* ``scd2``           close changed rows, open new versions
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import assign_dense_keys, next_key_start


class DuplicateKeyError(ValueError):
    pass


class ConflictingRowsError(DuplicateKeyError):
    pass


def assert_unique_keys(df: DataFrame, key: str | list[str], what: str = "batch") -> None:
    """Fail fast when one batch holds a key twice (a keyed upsert cannot
    decide which row wins)."""
    keys = [key] if isinstance(key, str) else key
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    dup = df.where(present).groupBy(*keys).count().where("count > 1").limit(1).collect()
    if dup:
        raise DuplicateKeyError(f"{what}: key {dup[0].asDict()} occurs more than once")


#: Up to so many keys that repeat are broadcast to find their rows.
MOST_REPEATED = 100_000


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys of more than one row (null is a key): only the key column is read, and counted before it is shuffled."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(key)


def with_dup_count(staged: DataFrame, key: str, refuse: str | None = None) -> DataFrame:
    """``_dup`` = rows sharing the row's key.  Whole rows are shuffled (by a window) only if some key repeats.

    ``refuse`` names a table that takes no such batch: it fails here, before any row is moved or written."""
    if repeated_keys(staged, key).isEmpty():
        return staged.withColumn("_dup", F.lit(1).cast("long"))
    if refuse:
        raise DuplicateKeyError(f"{refuse}: the batch holds a key more than once")
    return staged.withColumn("_dup", F.count(F.lit(1)).over(Window.partitionBy(key)))


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key: equal rows count once.  ``_conflict`` is 1 where rows of the key differ (the least of
    them is shown), so that the writer can refuse the batch.

    The keys are counted first.  Rows of a key of their own stay where they are; only those of keys that repeat
    are compared (all rows, if such keys are too many to broadcast)."""
    again = repeated_keys(df, key)
    n = again.limit(MOST_REPEATED + 1).count()
    if n > MOST_REPEATED:
        return _least_image(df, key)
    single = df.withColumn("_conflict", F.lit(0).cast("long"))
    if not n:
        return single
    again = F.broadcast(again.withColumnRenamed(key, "_again"))
    same = F.col(key).eqNullSafe(F.col("_again"))
    return single.join(again, same, "left_anti").unionByName(_least_image(df.join(again, same, "left_semi"), key))


def _least_image(df: DataFrame, key: str) -> DataFrame:
    """The least row of each key, and whether it has others.  Least and greatest image are combined before the
    shuffle; no key gathers its rows in one task."""
    image = F.struct(*[c for c in df.columns if c != key])
    held = df.groupBy(key).agg(F.min(image).alias("_least"), F.max(image).alias("_most"))
    return held.select(key, "_least.*", (~F.col("_least").eqNullSafe(F.col("_most"))).cast("long").alias("_conflict")) \
        .select(*df.columns, "_conflict")


def conflicts(df: DataFrame, key: str) -> DataFrame:
    """The keys whose rows differ: number of rows, and the least and the greatest row as structs."""
    image = F.struct(*[c for c in df.columns if c != key])
    held = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.min(image).alias("least"), F.max(image).alias("most"))
    return held.where(~F.col("least").eqNullSafe(F.col("most")))


def upsert(existing: DataFrame | None, staged: DataFrame, key: str,
           update_cols: list[str], sk_col: str | None = None,
           on_update: Mapping[str, Column] | None = None,
           on_insert: Mapping[str, Column] | None = None,
           columns: list[str] | None = None, dup_check: bool = False,
           key_start: int | None = None, refuse: str | None = None) -> DataFrame:
    """Next version of a keyed table.

    Matched keys take ``update_cols`` from the staged row (NULL in the
    source overwrites: the choice is made by a match flag, not by
    coalesce) and keep every other column; ``on_update`` columns are set
    on matched rows.  New keys take the staged row plus ``on_insert``
    columns and a fresh dense surrogate key after the current maximum.
    ``key_start`` is the current maximum surrogate key when the caller
    knows it (the store records it per version); otherwise it is read.
    The result carries ``_op`` ('insert' / 'update' / 'keep'); with
    ``dup_check`` also ``_dup`` (rows of the batch with the same key) so
    the writer can refuse the version when a batch holds a key twice; with
    ``refuse`` (the table's name) such a batch fails at once.
    """
    on_update = dict(on_update or {})
    on_insert = dict(on_insert or {})
    if columns is None:
        columns = [c for c in (existing.columns if existing is not None else staged.columns)
                   if c != sk_col] if existing is not None else \
            [c for c in staged.columns] + [c for c in on_insert if c not in staged.columns]
    extra = ["_dup"] if dup_check else []
    if dup_check:
        staged = with_dup_count(staged, key, refuse)
    if existing is None:
        new = staged.select(*[(on_insert[c].alias(c) if c in on_insert else F.col(c)) for c in columns], *extra)
        new = new.withColumn("_op", F.lit("insert"))
        if sk_col:
            new = assign_dense_keys(new, [key], sk_col, 0)
        return new

    # matched rows and new keys by a join each: neither result is computed twice, and only new rows are checkpointed
    staged_cols = set(staged.columns)
    e = existing.alias("e")
    s = staged.withColumn("_in_s", F.lit(True)).alias("s")
    in_s = F.col("s._in_s").isNotNull()
    out, ins = [], []
    for c in columns:
        upd = on_update[c] if c in on_update else F.col(f"s.{c}") if c in update_cols and c != key else None
        out.append((F.col(f"e.{c}") if upd is None else F.when(in_s, upd).otherwise(F.col(f"e.{c}"))).alias(c))
        ins.append((on_insert[c] if c in on_insert else F.col(c) if c in staged_cols else F.lit(None)).cast(existing.schema[c].dataType).alias(c))
    if sk_col:
        out.append(F.col(f"e.{sk_col}").alias(sk_col))
    old = e.join(s, F.col(f"e.{key}") == F.col(f"s.{key}"), "left").select(
        *out, F.when(in_s, "update").otherwise("keep").alias("_op"), *[F.col(f"s.{c}").alias(c) for c in extra])
    new = _unknown(existing, staged, key).select(*ins, F.lit("insert").alias("_op"), *extra)
    if sk_col:
        new = assign_dense_keys(new, [key], sk_col, key_start if key_start is not None else next_key_start(existing, sk_col))
    return old.unionByName(new)


def _unknown(existing: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Staged rows whose key ``existing`` lacks.  If they can be few, their keys are looked for first, and whole rows are
    shuffled only if those keys are too many to broadcast."""
    keys = existing.select(key)
    if staged.count() - existing.count() <= MOST_REPEATED:
        new = staged.select(key).join(keys, key, "left_anti").distinct()
        n = new.limit(MOST_REPEATED + 1).count()
        if not n:
            return staged.where(F.lit(False))
        if n <= MOST_REPEATED:
            new = F.broadcast(new.withColumnRenamed(key, "_new"))
            return staged.join(new, F.col(key).eqNullSafe(F.col("_new")), "left_semi")
    return staged.join(keys, key, "left_anti")


def absent(existing: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Staged rows whose key ``existing`` lacks.

    Only existing keys inside the batch's key range can match: the range
    filter runs at the scan (Parquet min/max stats skip older files when
    keys grow over time), so the anti-join shuffles O(batch range), not
    the whole history.
    """
    return staged.join(_in_range(existing, staged, key), key, "left_anti")


def _in_range(existing: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """The keys of ``existing`` between the least and the greatest one of ``staged``."""
    bounds = staged.agg(F.struct(F.min(key).alias("lo"), F.max(key).alias("hi"))).scalar()
    return existing.select(key).where((F.col(key) >= bounds["lo"]) & (F.col(key) <= bounds["hi"]))


def insert_absent(existing: DataFrame | None, staged: DataFrame, key: str,
                  sk_col: str | None = None, key_start: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(next version, inserted rows): append staged rows whose key is new.  Their keys are looked for first."""
    if existing is None:
        new = staged
        start = 0
    else:
        new = _unknown(_in_range(existing, staged, key), staged, key)
        start = (key_start if key_start is not None else next_key_start(existing, sk_col)) if sk_col else 0
    if sk_col:
        new = assign_dense_keys(new, [key], sk_col, start)
    if existing is None:
        return new, new
    return existing.unionByName(new, allowMissingColumns=True), new


def scd2(existing: DataFrame | None, staged: DataFrame, key: str, tracked: list[str],
         sk_col: str, as_of: Column, other_cols: list[str] | None = None) -> DataFrame:
    """Type-2 history: a changed tracked attribute closes the current row
    (``expiry_date`` = as_of - 1 day, ``is_current`` false) and opens a new
    version with a new surrogate key, ``effective_date`` = as_of.  A version
    that began on ``as_of`` itself is amended in place, so no interval is
    negative.  A key that the batch lacks is closed too; if it comes back, a
    new version opens.  A ``_dup`` column of ``staged`` is passed on."""
    other_cols = other_cols or []
    attrs = tracked + [c for c in other_cols if c not in tracked]
    base_cols = [key, *attrs]
    extra = [c for c in ("_dup",) if c in staged.columns]
    as_of = as_of.cast("date")
    if existing is None:
        first = staged.select(*base_cols, *extra).withColumn("effective_date", as_of) \
            .withColumn("expiry_date", F.lit(None).cast("date")).withColumn("is_current", F.lit(True))
        return assign_dense_keys(first, [key], sk_col, 0)

    cur = existing.where("is_current").alias("c")
    hist = existing.where(~F.col("is_current"))
    s = staged.select(*base_cols, *extra).alias("s")
    j = cur.join(s, F.col(f"c.{key}") == F.col(f"s.{key}"), "full_outer")
    in_c = F.col(f"c.{key}").isNotNull()
    in_s = F.col(f"s.{key}").isNotNull()
    changed = F.lit(False)
    for c in tracked:
        changed = changed | ~F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}"))
    tagged = j.select(
        F.coalesce(F.col(f"c.{key}"), F.col(f"s.{key}")).alias(key),
        *[F.col(f"c.{c}").alias(f"_c_{c}") for c in attrs],
        *[F.col(f"s.{c}").alias(f"_s_{c}") for c in attrs],
        F.col(f"c.{sk_col}").alias(sk_col), F.col("c.effective_date").alias("effective_date"),
        in_c.alias("_in_c"), in_s.alias("_in_s"),
        (in_c & in_s & changed & (F.col("c.effective_date") < as_of)).alias("_chg"),
        (in_c & in_s & changed & (F.col("c.effective_date") >= as_of)).alias("_amend"), *[F.col(f"s.{c}").alias(c) for c in extra],
    )
    # each current row stays, amended or not, or is closed: one row out, one pass
    closing = F.col("_chg") | ~F.col("_in_s")
    current = tagged.where("_in_c").select(
        sk_col, key, *[F.when(F.col("_amend"), F.col(f"_s_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in attrs], "effective_date",
        F.when(closing, F.greatest(F.date_sub(as_of, 1), F.col("effective_date"))).alias("expiry_date"), (~closing).alias("is_current"), *extra)
    opened = tagged.where("_chg OR (_in_s AND NOT _in_c)").select(
        key, *[F.col(f"_s_{c}").alias(c) for c in attrs], *extra,
        as_of.alias("effective_date"), F.lit(None).cast("date").alias("expiry_date"),
        F.lit(True).alias("is_current"))
    opened = assign_dense_keys(opened, [key], sk_col, next_key_start(existing, sk_col))
    cols = [sk_col, key, *attrs, "effective_date", "expiry_date", "is_current", *extra]
    hist = hist.select("*", *[F.lit(None).cast("long").alias(c) for c in extra])
    return hist.select(*cols).unionByName(current.select(*cols)).unionByName(opened.select(*cols))


def update_where(df: DataFrame, cond: Column, assignments: Mapping[str, Column]) -> DataFrame:
    """Keyed UPDATE as a new version: assigned columns change where ``cond`` holds."""
    return df.select(*[F.when(cond, assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments
                       else F.col(c) for c in df.columns])


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keyed DELETE as a new version (anti-join on the key)."""
    return df.join(keys.select(key).distinct(), key, "left_anti")
