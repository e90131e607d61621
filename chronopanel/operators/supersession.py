"""Bitemporal histories: rows that supersede others, and what was current at an instant.

A row says which earlier row of its business key it replaces, so the rows of a key form a chain.  Keys of a bounded number of
rows are put together by one shuffle, and their chains are followed in batches of whole keys.  The chains of larger keys are
followed by pointer jumping: each round a row takes over the pointer of the row that it points at, with what was gathered on
the way, so a chain of n rows takes about log2(n) rounds and equi-joins only, and no task holds such a key.  A row stops being
current when the first row behind it in the chain becomes known, which need not be the next one: facts arrive late and out of
order.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.session import stage

#: Keys of more rows are followed by joins.
KEY_ROWS = 4096


def follow(links: DataFrame, fold: Callable[[Column, Column], Column]) -> DataFrame:
    """(id, to, acc) of ``links`` (id, to, acc; one an id) with ``to`` at the end of the chain and ``acc`` folded on the way.

    A round settles at least one row unless all that are left lead into a cycle, which is an error."""
    state, left = stage(links.select("id", "to", "acc", F.lit(True).alias("open")), "links"), None
    while True:
        onward = state.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("acc").alias("more"), F.col("open").alias("further"))
        joined = state.where("open").join(onward, "to", "left")
        moved = joined.select("id", F.coalesce("next", "to").alias("to"), F.when(F.col("next").isNull(), F.col("acc")).otherwise(fold(F.col("acc"), F.col("more"))).alias("acc"), F.coalesce("further", F.lit(False)).alias("open"))
        state = stage(state.where("not open").unionByName(moved), "links")
        still = state.where("open").count()
        if not still:
            return state.drop("open")
        if still == left:
            raise ValueError(f"supersession runs in a circle: {state.where('open').agg(F.min('id')).first()[0]}")
        left = still


def checked_links(rows: DataFrame, id_col: str, supersedes: str, keys: list[str]) -> DataFrame:
    """(id, before, at) of the rows, or an error: an id twice, a row superseded twice or by itself, an unknown one, one of another key."""
    key = F.struct(*keys)
    own = rows.select(F.col(id_col).alias("id"), F.col(supersedes).alias("before"), key.alias("key"), F.col("available_at").alias("at"))
    counted = own.groupBy("id").agg(F.count("*").alias("times"), F.first("key").alias("old_key"))
    taken = own.where("before is not null").groupBy("before").agg(F.count("*").alias("takers"))
    held = own.join(counted.select(F.col("id"), "times"), "id").join(counted.select(F.col("id").alias("before"), "old_key"), "before", "left").join(taken, "before", "left")
    name = F.col("id").cast("string")
    fault = (
        F.when(F.col("times") > 1, "an id twice: ").when(F.col("before") == F.col("id"), "supersedes itself: ").when(F.col("takers") > 1, "superseded twice, as by: ")
        .when(F.col("before").isNotNull() & F.col("old_key").isNull(), "supersedes an unknown row: ").when(F.col("old_key") != F.col("key"), "supersedes a row of another key: "))
    ok = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, name)).cast("boolean")).otherwise(F.lit(True))
    return held.where(ok).select("id", "before", "at")


def jumps(to: np.ndarray, acc: np.ndarray, fold: Callable, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """``follow`` in a batch: ``to`` holds places, an end's its own."""
    for _ in range(rounds):
        acc, to = fold(acc, acc[to]), to[to]
    return to, acc


def whole_keys(batches: Iterator[pa.RecordBatch], id_col: str, supersedes: str) -> Iterator[pa.RecordBatch]:
    """Rows in the order of keys, the first of each told by __first, with chain, position, superseded_at, is_current and __fault."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        starts = np.flatnonzero(table["__first"].to_numpy())
        last = int(starts[-1]) if len(starts) else 0  # its key may go on in the next batch
        if last:
            yield from followed(table.slice(0, last), id_col, supersedes).to_batches()
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield from followed(held, id_col, supersedes).to_batches()


def followed(table: pa.Table, id_col: str, supersedes: str) -> pa.Table:
    table = table.combine_chunks()
    one = lambda c: pa.concat_arrays(table[c].chunks)
    ids, at, first = one(id_col), one("available_at"), table["__first"].to_numpy()
    n, group = len(ids), np.cumsum(first) - 1
    own, named = np.arange(n), np.asarray(one(supersedes).is_valid())
    before = pc.fill_null(pc.index_in(one(supersedes), value_set=ids, skip_nulls=True), -1).to_numpy().astype(np.int64)
    links = named & (before >= 0) & (group[before] == group) & (before != own)
    after = np.full(n, -1)
    after[before[links]] = own[links]
    rounds = int(np.bincount(group).max()).bit_length() + 1
    root, position = jumps(np.where(links, before, own), links.astype(np.int64), np.add, rounds)
    known = pc.rank(at, "ascending", null_placement="at_end", tiebreaker="first").to_numpy().astype(np.int64) - 1
    row_of = np.empty(n + 1, np.int64)
    row_of[known], row_of[n] = own, -1
    _, soonest = jumps(np.where(after >= 0, after, own), np.where(after >= 0, known[after], n), np.minimum, rounds)
    until = row_of[soonest]
    fault = (named & ~links) | links[root]  # no link within the key, or a circle
    fault[links] |= np.bincount(before[links], minlength=n)[before[links]] > 1
    fault |= np.bincount(group, after < 0)[group] > 1
    out = table.drop_columns(["__first"])
    for name, values in (("chain", ids.take(pa.array(root))), ("position", pa.array(position)), ("superseded_at", at.take(pa.array(until, mask=until < 0))), ("is_current", pa.array(after < 0)), ("__fault", pa.array(fault))):
        out = out.append_column(name, values)
    return out


def history(rows: DataFrame, id_col: str, supersedes: str, keys: list[str], key_rows: int = KEY_ROWS) -> DataFrame:
    """``rows`` (with available_at) and chain, position, superseded_at and is_current.

    chain: the first id of the chain; position: rows before this one in it; superseded_at: when the first of the rows behind
    it became known, null if there are none; is_current: whether there are none.  A key with two chains has two current
    rows, which is an error, as are the faults of ``checked_links`` and cycles.  Keys of up to ``key_rows`` rows meet in a
    task, larger ones in joins; faults are named by the way of joins."""
    large = stage(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > key_rows).select(*[F.col(k).alias(f"__{k}") for k in keys]), "large")
    any_large, small, rest = bool(large.limit(1).count()), rows, None
    if any_large:
        small, rest = rows.join(large, same_keys(keys), "left_anti"), stage(rows.join(large, same_keys(keys), "left_semi"), "rest")
    kinds = {f.name: f.dataType for f in rows.schema}
    more = [("chain", kinds[id_col]), ("position", T.LongType()), ("superseded_at", kinds["available_at"]), ("is_current", T.BooleanType()), ("__fault", T.BooleanType())]
    schema = T.StructType([*rows.schema, *[T.StructField(n, t) for n, t in more]])
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(id_col)) == 1
    found = stage(small.withColumn("__first", first).mapInArrow(lambda b: whole_keys(b, id_col, supersedes), schema), "found")
    ids = found.select(id_col) if rest is None else found.select(id_col).unionByName(rest.select(id_col))
    twice = ids.groupBy(id_col).agg(F.count("*").alias("__n")).where("__n > 1")
    if found.where("__fault").limit(1).count() or twice.limit(1).count():
        return joined_history(rows, id_col, supersedes, keys)  # names the fault
    found = found.drop("__fault")
    return found if rest is None else found.unionByName(joined_history(rest, id_col, supersedes, keys))


def joined_history(rows: DataFrame, id_col: str, supersedes: str, keys: list[str]) -> DataFrame:
    """``history`` by pointer jumping over joins, for keys of any number of rows."""
    links = stage(checked_links(rows, id_col, supersedes, keys), "chain")
    back = links.where("before is not null")
    roots = follow(back.select("id", F.col("before").alias("to"), F.lit(1).cast("bigint").alias("acc")), lambda a, b: a + b)
    ahead = back.select(F.col("before").alias("id"), F.col("id").alias("to"), F.col("at").alias("acc"))
    ends = follow(ahead, lambda a, b: F.least(a, b))
    found = rows.join(roots.select(F.col("id").alias(id_col), F.col("to").alias("chain"), F.col("acc").alias("position")), id_col, "left")
    found = found.join(ends.select(F.col("id").alias(id_col), F.col("acc").alias("superseded_at"), F.lit(True).alias("__past")), id_col, "left")
    found = found.withColumns({"chain": F.coalesce("chain", F.col(id_col)), "position": F.coalesce("position", F.lit(0).cast("bigint")), "is_current": F.col("__past").isNull()}).drop("__past")
    return one_current(found, keys)


def same_keys(keys: list[str]) -> Column:
    """Keys equal those of a table that has them as __name; a null is a key too."""
    return functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])


def one_current(found: DataFrame, keys: list[str]) -> DataFrame:
    """``found``, or an error naming a key with more than one current row."""
    current = found.where("is_current").groupBy(*keys).agg(F.count("*").alias("n"))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    ok = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("more than one current row of "), name)).cast("boolean")).otherwise(F.lit(True))
    alone = current.where(ok).select(*[F.col(k).alias(f"__{k}") for k in keys])
    return found.join(alone, same_keys(keys), "left_semi")


def as_of(found: DataFrame, instant: Column) -> DataFrame:
    """The rows of a ``history`` that were current at an instant: known by then, and nothing behind them was."""
    return found.where((F.col("available_at") <= instant) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > instant)))
