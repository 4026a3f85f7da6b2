"""Which folder holds a table now.

A table that was rewritten as a whole has a pointer file beside it with the folder of
its newest generation; without one, the table's own folder holds it.  The pointer is
replaced by a rename as the last step, so a reader finds the old generation or the new
one.  A frame goes on reading the generation it was made with: old folders are deleted
only after a grace time.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession

from wayside.sources.files import read_content, remove, write_over
from wayside.sources.lease import Lease, log_folder

# Seconds that folders of former generations are kept for their readers.
GRACE = 7 * 24 * 3600.0


def _pointer(table: str) -> str:
    return f"{log_folder(table)}/current.json"


def _state(spark: SparkSession, table: str) -> dict:
    first = {"folder": table.rstrip("/").rpartition("/")[2], "number": 0, "retired": []}
    return read_content(spark, _pointer(table)) or first


def _place(table: str, folder: str) -> str:
    """Folders stand beside the table and are named without their parent, so a table can
    be read by another path."""
    parent, slash, _ = table.rstrip("/").rpartition("/")
    return f"{parent}{slash}{folder}"


def current_folder(spark: SparkSession, table: str) -> str:
    return _place(table, _state(spark, table)["folder"])


def generation(spark: SparkSession, table: str) -> int:
    """0 until the table is replaced for the first time, then the lease number under
    which it was."""
    return _state(spark, table)["number"]


def fresh_folder(table: str) -> str:
    """A new folder for a generation to be written to."""
    return f"{table.rstrip('/')}.{uuid.uuid4().hex}"


def switch(lease: Lease, folder: str) -> None:
    """Make ``folder`` the table's newest generation."""
    spark, table = lease.spark, lease.table
    state = _state(spark, table)
    retired = [*state["retired"], {"folder": state["folder"], "at": time.time()}]
    name = folder.rstrip("/").rpartition("/")[2]
    lease.check()
    write_over(
        spark, _pointer(table), {"folder": name, "number": lease.number, "retired": retired}
    )


def retire(lease: Lease, grace: float = GRACE) -> list[str]:
    """Delete the former generations whose grace time is over."""
    spark, table = lease.spark, lease.table
    state = _state(spark, table)
    over = [old for old in state["retired"] if old["at"] + grace <= time.time()]
    if over:
        for old in over:
            remove(spark, _place(table, old["folder"]))
        left = [old for old in state["retired"] if old not in over]
        lease.check()
        write_over(spark, _pointer(table), {**state, "retired": left})
    return [old["folder"] for old in over]
