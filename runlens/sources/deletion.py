"""Deleting, listing, restoring and purging records of a local store.

A deletion first moves the record into a slot ``deleted/TICKET/record`` beside a receipt, and
only a purge removes bytes. A purge leaves its mark before it removes anything, and a slot
with that mark is never restored. These are commands on one store by the driver; the slots
can be read as a table.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import re
import shutil
import time

from pyspark.sql import DataFrame, SparkSession

from .trace import record_ids, resolve

TICKET = re.compile(r"[0-9a-fA-F]{1,32}-[0-9]+")
MAX_DEPTH = 128


class Refused(Exception):
    """A command that would lose or overwrite evidence."""


@contextlib.contextmanager
def locked(root: str):
    """The store's lock, without waiting."""
    with open(os.path.join(root, ".lock"), "a") as handle:
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as error:
            raise Refused("the store is busy") from error
        yield


def _slot(root: str, ticket: str) -> tuple[str, dict]:
    folder = os.path.join(root, "deleted", ticket)
    if not TICKET.fullmatch(ticket) or os.path.islink(folder) or not os.path.isdir(folder):
        raise Refused("no such deletion ticket")
    try:
        with open(os.path.join(folder, "receipt.json"), "rb") as src:
            receipt = json.load(src)
        if receipt["schema_version"] != 1 or receipt["ticket"] != ticket or not TICKET.fullmatch(receipt["id"]):
            raise ValueError("receipt of another slot")
    except (OSError, ValueError, KeyError, TypeError) as error:
        raise Refused(f"damaged slot: {error}") from error
    return folder, receipt


def _preflight(folder: str, depth: int = 0) -> None:
    """The whole tree is walked before anything moves; links aren't followed."""
    if depth > MAX_DEPTH:
        raise Refused("record is nested too deeply")
    with os.scandir(folder) as items:
        for item in items:
            if item.is_dir(follow_symlinks=False):
                _preflight(item.path, depth + 1)


def isolate(root: str, key: str) -> str:
    """Move the record with this id or name out of the catalogue; returns its ticket."""
    with locked(root):
        run_id = resolve(root, key)
        source = os.path.join(root, "runs", run_id)
        _preflight(source)
        name = None
        with contextlib.suppress(OSError, ValueError, AttributeError), open(os.path.join(source, "metadata.json"), "rb") as src:
            name = json.load(src).get("name")
        ticket = f"{time.time_ns():x}-{os.getpid()}"
        folder = os.path.join(root, "deleted", ticket)
        os.makedirs(folder, mode=0o700)
        with open(os.path.join(folder, "receipt.json"), "w") as out:
            json.dump({"schema_version": 1, "ticket": ticket, "id": run_id, "name": name}, out)
            out.flush()
            os.fsync(out.fileno())
        os.rename(source, os.path.join(folder, "record"))
        return ticket


def state(folder: str) -> str:
    if not os.path.isdir(os.path.join(folder, "record")):
        return "no_record"
    return "purge_started" if os.path.exists(os.path.join(folder, "purge-started")) else "isolated"


def deleted(root: str) -> list[dict]:
    """All slots by the bytes of their ticket; one that can't be read is listed as damaged."""
    home, rows = os.path.join(root, "deleted"), []
    for ticket in sorted(os.listdir(home), key=os.fsencode) if os.path.isdir(home) else []:
        try:
            folder, receipt = _slot(root, ticket)
            rows.append({"ticket": ticket, "id": receipt["id"], "name": receipt.get("name"), "state": state(folder), "error": None})
        except Refused as error:
            rows.append({"ticket": ticket, "id": None, "name": None, "state": "damaged", "error": str(error)})
    return rows


def deleted_table(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(deleted(root), "ticket string, id string, name string, state string, error string")


def purge(root: str, ticket: str) -> str:
    """Remove a slot for good; returns the id of its record."""
    with locked(root):
        folder, receipt = _slot(root, ticket)
        record = os.path.join(folder, "record")
        if os.path.isdir(record):
            _preflight(record)
            with open(os.path.join(folder, "purge-started"), "a") as mark:
                os.fsync(mark.fileno())
            shutil.rmtree(record)
        shutil.rmtree(folder)
        return receipt["id"]


def restore(root: str, ticket: str) -> str:
    """Put a record back unless a purge began, or its id or name is in use; returns its id."""
    with locked(root):
        folder, receipt = _slot(root, ticket)
        if (now := state(folder)) != "isolated":
            raise Refused(f"restore refused: {now}")
        for key in {receipt["id"], receipt.get("name")} - {None}:
            if key in record_ids(root):
                raise Refused(f"restore refused: {key} is in use")
            try:
                resolve(root, key)
            except LookupError as error:
                if not str(error).startswith("0 "):
                    raise Refused(f"restore refused: {key} is in use") from error
            else:
                raise Refused(f"restore refused: {key} is in use")
        os.rename(os.path.join(folder, "record"), os.path.join(root, "runs", receipt["id"]))
        shutil.rmtree(folder)
        return receipt["id"]
