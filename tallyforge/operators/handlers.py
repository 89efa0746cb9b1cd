"""User functions as check handlers, run as batch inference over planned checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "task_id string, agent string, result_task_id string, result_agent string, status string, evidence_ids array<string>, message string"
#: handler(planned row as dict) -> dict with status and, if it likes, task_id, agent, evidence_ids, message
Handler = Callable[[dict], dict]


def apply_handlers(planned: DataFrame, handlers: dict[str, Handler], on_error: str = "raise") -> DataFrame:
    """One result row per planned check. An agent without a handler gives UNCERTAINTY.

    on_error="row" makes an exception of a handler an ERROR row and goes on; "raise" fails the job.
    result_task_id and result_agent are what the handler answered for, to be compared by reject_wrong_owner.
    """
    if on_error not in ("raise", "row"):
        raise ValueError("on_error is raise or row")

    def one(row: dict) -> dict:
        own = {"task_id": row["task_id"], "agent": row["agent"], "result_task_id": row["task_id"], "result_agent": row["agent"], "evidence_ids": [], "message": None}
        handler = handlers.get(row["agent"])
        if handler is None:
            return own | {"status": "UNCERTAINTY", "message": f"No runtime handler registered for {row['agent']}."}
        try:
            got = handler(row)
        except Exception as e:
            if on_error == "raise":
                raise
            return own | {"status": "ERROR", "message": f"Runtime error: {e}"}
        return own | {"result_task_id": got.get("task_id", row["task_id"]), "result_agent": got.get("agent", row["agent"]), "status": got["status"], "evidence_ids": list(got.get("evidence_ids", [])), "message": got.get("message")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            yield pd.DataFrame([one(r) for r in batch.to_dict("records")], columns=names)

    return planned.mapInPandas(run, SCHEMA)
