"""A stored change log with marks: the state at a time from the last mark and the tail of the log.

Each append is a segment of its own, whose least and greatest time the manifest
keeps.  A mark is the state of every key, deleted ones included, after all rows up to its time;
one is written when the rows since the last outnumber both ``every`` and the
keys of the last, so marks cost no more than the log itself.  The state at
T is the last mark not after T, folded with the segments that came after the mark or
reach beyond its time, as far as they begin by T.  Rows that come late, with a time before a mark, lie in a
segment after it and count; the greatest log id of a key wins, so rows that
both the mark and the tail hold change nothing.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.changes import fold_changes, live_state
from .store import TableStore

LOG, MARKS = "change_log", "state_marks"


class ChangeLog:
    """A log table and its marks in a store.  ``attrs`` hold the row after the change; ``time_col`` is one of the log's columns."""

    def __init__(self, store: TableStore, key: str, attrs: list[str], time_col: str = "change_time", order: str = "log_id",
                 every: int = 1_000_000):
        self.store, self.key, self.time_col, self.order, self.every = store, key, time_col, order, every
        self.attrs = attrs if time_col in attrs else [*attrs, time_col]

    # ------------------------------------------------------------- what is stored
    def _listed(self, table: str) -> list[dict]:
        e = self.store.manifest().get(table)
        return json.loads(e["layout"])["parts"] if e else []

    def segments(self) -> list[dict]:
        """path, rows, least and greatest time of each append (one entry an append)."""
        return self._listed(LOG)

    def marks(self) -> list[dict]:
        """path, time, number of segments before it and keys of each mark, oldest first."""
        return self._listed(MARKS)

    def _read(self, table: str, paths: list[str]) -> DataFrame | None:
        return self.store.read_paths(",".join(paths), self.store.manifest()[table]["schema_json"]) if paths else None

    def read(self) -> DataFrame | None:
        return self.store.read(LOG)

    # -------------------------------------------------------------------- append
    def append(self, rows: DataFrame) -> int:
        """Add rows as a segment, and a mark where one is due, in one commit; returns the version."""
        prev, version = self.store.manifest(), self.store.current_version() + 1
        e = self.store.write_table(LOG, rows, version, append_to=prev.get(LOG), metrics={
            "least": F.min(self.time_col), "most": F.max(self.time_col)})
        parts = self.segments()
        if e["new_rows"]:
            parts.append({"path": e["new_path"], "rows": e["new_rows"], "least": _text(e["metrics"]["least"]), "most": _text(e["metrics"]["most"])})
        e["layout"] = json.dumps({"parts": parts})
        self.store.commit([e], version, keep=prev)
        last = self.marks()[-1] if self.marks() else {"before": 0, "keys": 0}
        if sum(p["rows"] for p in parts[last["before"]:]) >= max(self.every, last["keys"]):
            return self.mark()
        return version

    def mark(self) -> int:
        """Write the state after all rows so far as a mark, folded from the mark before."""
        prev, version, parts = self.store.manifest(), self.store.current_version() + 1, self.segments()
        time = max(p["most"] for p in parts if p["most"])
        e = self.store.write_table(MARKS, self._folded(time), version)
        marks = [*self.marks(), {"path": e["new_path"], "time": time, "before": len(parts), "keys": e["new_rows"]}]
        e["layout"] = json.dumps({"parts": marks})
        return self.store.commit([dict(e, path=",".join(m["path"] for m in marks), row_count=sum(m["keys"] for m in marks))], version, keep=prev)

    def compact(self) -> int:
        """Rewrite the segments before the last mark as one, ordered by time; marks stay valid."""
        marks, parts = self.marks(), self.segments()
        before = marks[-1]["before"] if marks else 0
        if before < 2:
            return self.store.current_version()
        prev, version = self.store.manifest(), self.store.current_version() + 1
        old = self._read(LOG, [p["path"] for p in parts[:before]])
        e = self.store.write_table(LOG, old.repartitionByRange(self.time_col, self.order).sortWithinPartitions(self.time_col, self.order), version)
        one = {"path": e["new_path"], "rows": e["new_rows"], "least": min(p["least"] for p in parts[:before] if p["least"]),
               "most": max(p["most"] for p in parts[:before] if p["most"])}
        rest = [one, *parts[before:]]
        e |= {"path": ",".join(p["path"] for p in rest), "row_count": sum(p["rows"] for p in rest), "layout": json.dumps({"parts": rest})}
        # a mark that knew only some of the merged segments takes the merged one as new to it: its rows fold again
        moved = [dict(m, before=max(0, m["before"] - before + 1) if m["before"] >= before else 0) for m in marks]
        return self.store.commit([e, dict(prev[MARKS], layout=json.dumps({"parts": moved}))], version, keep=prev)

    # --------------------------------------------------------------------- as of
    def tail(self, time: str) -> tuple[dict | None, list[dict]]:
        """The last mark not after ``time``, and the segments that the state then needs besides."""
        mark = next((m for m in reversed(self.marks()) if m["time"] <= time), None)
        tail = [p for i, p in enumerate(self.segments()) if p["least"] and p["least"] <= time
                and (mark is None or i >= mark["before"] or p["most"] > mark["time"])]
        return mark, tail

    def _folded(self, time: str) -> DataFrame:
        mark, tail = self.tail(time)
        log = self._read(LOG, [p["path"] for p in tail])
        state = self._read(MARKS, [mark["path"]]) if mark else None
        if log is None:
            log = self.read().limit(0)
        return fold_changes(state, log.where(F.col(self.time_col) <= _at(time)), self.key, self.attrs, self.order)

    def as_of(self, time: str | dt.datetime) -> DataFrame:
        """The live rows at ``time``: key and attributes.  Times are UTC wall times."""
        return live_state(self._folded(_text(time)))


def _text(time: str | dt.datetime | None) -> str | None:
    """Times as text of one length, so that they compare like times."""
    if time is None:
        return None
    time = dt.datetime.fromisoformat(time) if isinstance(time, str) else time
    return time.strftime("%Y-%m-%d %H:%M:%S.%f")


def _at(time: str) -> Column:
    return F.lit(time).cast("timestamp_ntz")
