"""Conversations as rows of turns: a global order that splits long ones, and their rows by whole conversations.

A conversation may hold a third of all rows, so none is gathered by its id. Rows
are dealt to ranges of (conv_id, turn, role, start of the text) and sorted within
them. A task finishes the conversations that lie within its range; those at its
two ends, which may go on in the next range, and those that are longer than a
task may hold, are `parts`: their rows go on one by one, numbered in order.

Rows of equal turn are in the order of role, then of text; null turns come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import plain

#: What a task holds of one conversation, and of whole conversations together, at most.
ROWS, BYTES = 1 << 14, 8 << 20
START = 32  # characters of a text that take part in the ranges: the sampled bounds stay small


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text by ranges, each sorted; rows of one conversation are in one range or in ranges that follow each other."""
    rows = plain(turns, "conv_id", "turn", "role", "text")
    start = F.substring("text", 1, START)
    return rows.repartitionByRange("conv_id", "turn", "role", start).sortWithinPartitions("conv_id", "turn", "role", "text")


def _changes(ids: pa.Array) -> np.ndarray:
    """Where another id starts, but for the first place."""
    value, known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_valid(ids).to_numpy(zero_copy_only=False)
    return np.flatnonzero((value[1:] != value[:-1]) | (known[1:] != known[:-1])) + 1


def by_conversation(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[tuple[bool, int, pa.Table]]:
    """Tables of sorted rows, each with its first row's number in the task: of whole conversations (True), or of one that may go on elsewhere."""
    held: list[pa.Table] = []  # rows of the conversation that is open
    held_rows = held_size = 0
    part = True  # the task's first conversation may have begun elsewhere
    ready: list[pa.Table] = []
    ready_rows = ready_size = ready_at = 0
    at, last = 0, None

    def flush() -> Iterator[tuple[bool, int, pa.Table]]:
        nonlocal ready, ready_rows, ready_size
        if ready:
            yield True, ready_at, pa.concat_tables(ready)
        ready, ready_rows, ready_size = [], 0, 0

    def close(as_part: bool) -> Iterator[tuple[bool, int, pa.Table]]:
        """The open conversation's rows so far, as a part or to those that are ready."""
        nonlocal held, held_rows, held_size, ready, ready_rows, ready_size, ready_at
        if held and as_part:
            yield from flush()
            yield False, at - held_rows, pa.concat_tables(held)
        elif held:
            if not ready:
                ready_at = at - held_rows
            ready += held
            ready_rows, ready_size = ready_rows + held_rows, ready_size + held_size
            if ready_rows >= rows or ready_size >= size:
                yield from flush()
        held, held_rows, held_size = [], 0, 0

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        ids = batch.column("conv_id")
        cuts = [0, *_changes(ids).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            this = ids[begin].as_py()
            if last is not None and this != last[0]:
                yield from close(part)
                part = False
            last = (this,)
            piece = table.slice(begin, end - begin)
            weight = (pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0) + 64 * (end - begin)
            if held_rows + end - begin > rows or held_size + weight > size:
                part = True
                yield from close(True)
            held.append(piece)
            held_rows, held_size, at = held_rows + end - begin, held_size + weight, at + end - begin
    yield from close(True)  # the last one may go on elsewhere
    yield from flush()
