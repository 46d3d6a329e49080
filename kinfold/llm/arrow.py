"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.types as pt


def schema_of(ddl: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in ddl])


def spark_ddl(fields: list[tuple[str, pa.DataType]]) -> str:
    """The Spark DDL of Arrow fields."""

    def one(t: pa.DataType) -> str:
        if pt.is_list(t):
            return f"array<{one(t.value_type)}>"
        if pt.is_struct(t):
            return "struct<" + ",".join(f"{f.name}:{one(f.type)}" for f in t) + ">"
        return {pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary", pa.float32(): "float"}[t]

    return ", ".join(f"`{n}` {one(t)}" for n, t in fields)


def packed(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of ``limit`` units in sum at most (one larger row goes alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


_held: dict[str, tuple[str, object]] = {}


def worker_cache(owner: str, key: str, build):
    """What an operator keeps in a worker process between tasks: one object for one owner."""
    got = _held.get(owner)
    if got is None or got[0] != key:
        _held.clear()
        _held[owner] = (key, build())
    return _held[owner][1]


def release_worker_cache() -> None:
    """Workers are used again by later operators, which need no memory of earlier ones."""
    _held.clear()
