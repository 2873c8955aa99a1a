"""Stored chains of steps: saved, listed, loaded and deleted, each by one commit of a store."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chain import Step
from .store import State, Store

TABLE = "sessions"
_SCHEMA = "chain_id string, name string, created string, steps string"


def safe_id(chain_id: str) -> str:
    """Letters, digits, "-" and "_" of an id; ValueError if nothing is left."""
    kept = "".join(re.findall(r"[\w-]", chain_id))
    if not kept:
        raise ValueError(f"no id: {chain_id!r}")
    return kept


def steps_of(text: str) -> list[Step]:
    """Steps from JSON; keys that a step doesn't know are left out, absent ones take their defaults."""
    known = {f.name for f in fields(Step)}
    return [Step(**{k: tuple(v) if isinstance(v, list) else v for k, v in one.items() if k in known}) for one in json.loads(text)]


def save(store: Store, chain_id: str, name: str, created: str, steps: list[Step]) -> str:
    """Add a chain or replace the one of its id; its id."""
    key = safe_id(chain_id)
    row = store.spark.createDataFrame([(key, name, created, json.dumps([asdict(s) for s in steps], ensure_ascii=False))], _SCHEMA)

    def step(base: State):
        old = store.read(TABLE, base)
        rows = row if old is None else old.where(F.col("chain_id") != key).unionByName(row)
        return {TABLE: [store.add_part(TABLE, rows.coalesce(1))]}, {}

    store.change(step)
    return key


def listed(store: Store) -> DataFrame:
    """chain_id, name, created, n_steps of all chains, the newest first."""
    rows = store.read(TABLE)
    if rows is None:
        rows = store.spark.createDataFrame([], _SCHEMA)
    return rows.select("chain_id", "name", "created", F.json_array_length("steps").alias("n_steps")).orderBy(F.desc("created"), "chain_id")


def load(store: Store, chain_id: str) -> list[Step]:
    """The steps of a chain; LookupError if there is none."""
    rows = store.read(TABLE)
    found = rows.where(F.col("chain_id") == safe_id(chain_id)).select("steps").first() if rows is not None else None
    if found is None:
        raise LookupError(f"no chain {chain_id!r}")
    return steps_of(found["steps"])


def delete(store: Store, chain_id: str) -> bool:
    """Whether there was such a chain."""
    key, before = safe_id(chain_id), store.state()

    def step(base: State):
        rows = store.read(TABLE, base)
        if rows is None or rows.where(F.col("chain_id") == key).isEmpty():
            return None
        return {TABLE: [store.add_part(TABLE, rows.where(F.col("chain_id") != key).coalesce(1))]}, {}

    return store.change(step).number > before.number
