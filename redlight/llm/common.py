"""Helpers shared by the corpus operators: tables, scratch space, worker state."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, new_path  # noqa: F401

# Functions travel to the workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules["redlight"])

#: Splits text into words ``[^\x20\x09-\x0D]+`` (Java regular expression).
SPACES = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def enter(owner: str) -> None:
    """Called as an operator starts a task: frees what another operator left in the worker.

    Workers outlive jobs; without this the caches of all operators of a pipeline add up.
    """
    home = sys.modules.setdefault("_redlight_worker", types.ModuleType("_redlight_worker"))
    if getattr(home, "_owner", None) == owner:
        return
    for name in [n for n in vars(home) if not n.startswith("_")]:
        delattr(home, name)
    home._owner = owner
    give_back()


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """State that a Python worker keeps from task to task (tokenizers, caches)."""
    home = sys.modules.setdefault("_redlight_worker", types.ModuleType("_redlight_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def utf8(col: str | Column) -> Column:
    """Text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def wrapped(docs: DataFrame, **beside: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``row``, so that no name can clash, and ``beside``."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, *(v.alias(k) for k, v in beside.items()))


def unwrapped(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` out of ``row``, then ``new``. A column of ``docs`` that has a
    new one's name (in any case) gives way to it."""
    gone = {k.lower() for k in new}
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in gone), *(v.alias(k) for k, v in new.items()))


def fold(doc_id: str | Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; a null id falls in no labelled row."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m
