"""Stateful processors over the event log: one value of state a call, and one a log for its index runs.

They say what :mod:`plcatlas.operators.telemetry` says of a whole log, event by event. State has no time limit of its own, so a call or run may stay open for as long
as it takes; it is kept in the state store, on disk, and not in memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plcatlas.operators.telemetry import DONE_KINDS, NO_START

CALL_STATE = (
    "s_id BIGINT, s_ts BIGINT, s_tool STRING, s_args STRING, e1_id BIGINT, e1_ts BIGINT, e1_ms BIGINT, e_id BIGINT, e_tool STRING, e_ms BIGINT, "
    "e_kind STRING, e_error STRING"
)
CALL_ROW = "call_id STRING, version BIGINT, tool STRING, started_ms BIGINT, args_preview STRING, duration_ms BIGINT, status STRING, error STRING"
RUN_STATE = "runs STRING"
RUN_ROW = (
    "log STRING, workspace STRING, run BIGINT, version BIGINT, total_files BIGINT, indexed_files BIGINT, skipped_files BIGINT, total_entities BIGINT, "
    "total_edges BIGINT, failed BIGINT, total_time_ms BIGINT, status STRING"
)


def schema(ddl: str) -> T.StructType:
    """Of numbers and texts only; workers have no session that could read a schema."""
    kinds = {"BIGINT": T.LongType(), "STRING": T.StringType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def names(ddl: str) -> list[str]:
    return schema(ddl).names


def table(rows: list[dict], ddl: str) -> pd.DataFrame:
    """Rows as a frame whose numbers stay whole where some are missing."""
    whole = {f.name: "Int64" if f.dataType == T.LongType() else "object" for f in schema(ddl)}
    return pd.DataFrame(rows, columns=names(ddl)).astype(whole)


def plain(value):
    """A cell as text or whole number, which a column with gaps holds as a fraction; missing ones are None."""
    return None if value is None or pd.isna(value) else value if isinstance(value, str) else int(value)


def events_in_order(frames: Iterator[pd.DataFrame]) -> list[dict]:
    rows = [{k: plain(v) for k, v in row.items()} for frame in frames for row in frame.to_dict("records")]
    return sorted(rows, key=lambda r: r["id"])


class Calls(StatefulProcessor):
    """Of each call the start with the highest id, the first end and the last one. Every batch that touches a call gives its row again, with the id of its last event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("call", schema(CALL_STATE))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(names(CALL_STATE), map(plain, self.state.get()))) if self.state.exists() else dict.fromkeys(names(CALL_STATE))
        for r in events_in_order(rows):
            if r["kind"] == "tool_started":
                if held["s_id"] is None or r["id"] >= held["s_id"]:
                    held.update(s_id=r["id"], s_ts=r["ms"], s_tool=r["tool"], s_args=r["argsPreview"])
                continue
            took = r["durationMs"] or 0
            if held["e1_id"] is None or r["id"] <= held["e1_id"]:
                held.update(e1_id=r["id"], e1_ts=r["ms"], e1_ms=took)
            if held["e_id"] is None or r["id"] >= held["e_id"]:
                error = None if r["kind"] != "tool_failed" else r["error"] if r["error"] is not None else "(unknown error)"
                held.update(e_id=r["id"], e_tool=r["tool"], e_ms=took, e_kind=r["kind"], e_error=error)
        self.state.update(tuple(held[n] for n in names(CALL_STATE)))
        yield table([self.row(key[0], held)], CALL_ROW)

    @staticmethod
    def row(call_id: str, held: dict) -> dict:
        running = held["e_id"] is None or (held["s_id"] is not None and held["s_id"] > held["e_id"])
        return {
            "call_id": call_id, "version": max(x for x in (held["s_id"], held["e_id"]) if x is not None), "tool": held["s_tool"] if running else held["e_tool"],
            "started_ms": held["s_ts"] if held["s_id"] is not None else held["e1_ts"] - held["e1_ms"], "args_preview": held["s_args"] or "",
            "duration_ms": None if running else held["e_ms"], "error": None if running else held["e_error"],
            "status": "running" if running else "completed" if held["e_kind"] == "tool_completed" else "failed",
        }

    def close(self) -> None:
        pass


class Runs(StatefulProcessor):
    """The index runs of a log, read in the order of its ids. Events that name no workspace belong to that of the last start.

    Of each workspace (of the whole log if it isn't ``divided``) the state holds the current run only; a run is touched no more once another has started.
    """

    def __init__(self, divided: bool):
        self.divided = divided

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("runs", schema(RUN_STATE))

    @staticmethod
    def fresh(run: int) -> dict:
        return {"run": run, "closed": False, "files": 0, "entities": 0, "edges": 0, "failed": 0, "started": None, "done": None, "last": {}}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else {"workspace": None, "runs": {}}
        touched = {}
        for r in events_in_order(rows):
            if r["kind"] == "index_started":
                held["workspace"] = r["workspace"]
            named = r["workspace"] if r["workspace"] is not None else held["workspace"]
            at = json.dumps(named if self.divided else None)
            if r["kind"] == "index_started" or at not in held["runs"]:
                held["runs"][at] = self.fresh(r["id"] if r["kind"] == "index_started" else NO_START)
            own = held["runs"][at]
            self.step(own, r, named if self.divided else r["workspace"])
            touched[at, own["run"]] = (own, r["id"])
        self.state.update((json.dumps(held),))
        out = [self.row(key[0], json.loads(at), own, version) for (at, _), (own, version) in touched.items()]
        yield table([r for r in out if r], RUN_ROW)

    @staticmethod
    def step(own: dict, r: dict, workspace: str | None) -> None:
        if r["kind"] == "index_started":
            own["started"] = [workspace, r["totalFiles"]]
        elif r["kind"] in DONE_KINDS:
            whole = r["kind"] == "index_done"
            own["closed"] = True
            own["done"] = [workspace, r["indexedFiles"] if whole else None, (r["totalTimeMs"] if whole else r["duration"]) or 0]
            if whole:
                own["last"].update({c: r[c] for c in ("indexedFiles", "skippedFiles", "totalEntities", "totalEdges") if r[c] is not None})
        elif not own["closed"]:
            if r["kind"] == "index_file_failed":
                own["failed"] += 1
            else:
                own["files"] += 1
                own["entities"] += r["entities"] or 0
                own["edges"] += r["edges"] or 0

    @staticmethod
    def row(log: str, workspace: str | None, own: dict, version: int) -> dict | None:
        if own["run"] == NO_START and own["done"] is None and not own["files"]:
            return None
        last, done = own["last"], own["done"] or [None, None, 0]
        indexed, skipped = last.get("indexedFiles", own["files"]), last.get("skippedFiles", 0)
        total = own["started"][1] if own["started"] else None
        if total is None:
            total = (indexed if done[1] is None else done[1]) + skipped + own["failed"]
        called = next((x[0] for x in (own["started"], own["done"]) if x and x[0] is not None), "(unknown)")
        return {
            "log": log, "workspace": called, "run": own["run"], "version": version, "total_files": total, "indexed_files": indexed, "skipped_files": skipped,
            "total_entities": last.get("totalEntities", own["entities"]), "total_edges": last.get("totalEdges", own["edges"]), "failed": own["failed"],
            "total_time_ms": done[2], "status": "completed" if own["done"] else "failed" if own["failed"] else "running",
        }

    def close(self) -> None:
        pass
