"""Table versions laid out by key range, with their digests: differences are looked for only where digests differ."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as CH
from ..operators import digests as D
from .store import TableStore


def write(store: TableStore, tables: dict[str, tuple[DataFrame, str]], width: int) -> int:
    """Commit a version of tables (rows, integer key): a directory per top, and the leaves' digests as ``<table>_digests``."""
    prev, version, entries = store.manifest(), store.current_version() + 1, []
    for name, (df, key) in tables.items():
        top = F.floor(D.leaf_of(key, width) / D.FAN).cast("int")
        e = store.write_buckets(name, df, version, key, 0, by=top)
        leaves = D.leaf_digests(store.read_buckets(e), key, width)
        e["layout"] = json.dumps(json.loads(e["layout"]) | {"width": width})
        entries += [e, store.write_table(f"{name}_digests", leaves.coalesce(1), version)]
    return store.commit(entries, version, keep=prev)


def faulty(store: TableStore, table: str, version: int | None = None) -> list[tuple[int, int]]:
    """The key ranges of a stored version whose rows are not those that its digests were taken of."""
    e = store.manifest(version)[table]
    layout = json.loads(e["layout"])
    leaves = D.differing(store.read(f"{table}_digests", version), D.leaf_digests(store.read_buckets(e), layout["key"], layout["width"]))
    return D.ranges(leaves, layout["width"])


def changed_part(store: TableStore, table: str, old: int, new: int) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """Both versions' rows in the ranges that differ, and the ranges: only the directories of their tops are read."""
    entries = [store.manifest(v)[table] for v in (old, new)]
    layouts = [json.loads(e["layout"]) for e in entries]
    if layouts[0]["width"] != layouts[1]["width"]:
        raise ValueError(f"{table}: the versions are laid out in leaves of different width")
    key, width = layouts[1]["key"], layouts[1]["width"]
    leaves = D.differing(*[store.read(f"{table}_digests", v) for v in (old, new)])
    found = leaves.collect()                                                  # at most the table's leaves
    keys = D.ranges(leaves, width)
    only = sorted({r["leaf"] // D.FAN for r in found if r["leaf"] is not None})
    only += [b for x in layouts for b in x["buckets"] if not b.lstrip("-").isdigit()] if any(r["leaf"] is None for r in found) else []
    parts = [_rows(store, e, only).where(D.within(key, keys, any(r["leaf"] is None for r in found))) for e in entries]
    return *parts, keys


def _rows(store: TableStore, entry: dict, only: list) -> DataFrame:
    layout = json.loads(entry["layout"])
    layout["buckets"] = {b: p for b, p in layout["buckets"].items() if b in {str(x) for x in only}}
    return store.read_buckets(dict(entry, layout=json.dumps(layout)))


def diff(store: TableStore, table: str, old: int, new: int, compare: list[str] | None = None) -> DataFrame:
    """The change log between two versions, like ``changes.diff`` of the whole tables."""
    a, b, _ = changed_part(store, table, old, new)
    key = json.loads(store.manifest(new)[table]["layout"])["key"]
    return CH.diff(a, b, key, compare, table)
