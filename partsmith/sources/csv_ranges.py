"""Records of CSV files of any size, read in byte ranges side by side.

A line break ends a record only outside of quotes, and whether a range begins
inside of them is known only once all ranges before it are.  So each range is
read twice.  First it is reduced to one row: how many records begin in it and
in which state it ends, for either state it could begin in.  These maps are
composed along each file, a row per range, which gives every range its state
and the number of its first record.  Then the ranges are read again, each from
its first true record; the few records that run across ranges are put together
by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from partsmith.session import stage

_RANGES = "file string, range long, lines long, starts0 long, starts1 long, end0 boolean, end1 boolean"
_PIECES = "file string, range long, record long, whole boolean, text string"


def ends_quoted(line: str, quoted: bool, sep: str = ",") -> bool:
    """Whether a line that begins outside of quotes (or inside) ends inside.

    A quote opens a field only as its first character, a doubled one within
    quotes is a character, and what follows a closing quote up to the next
    separator belongs to the field.  So ``5" pipe,x`` opens nothing.
    """
    at, n = 0, len(line)
    while True:
        if not quoted:
            if at < n and line[at] == '"':
                at += 1
            else:
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
        while True:  # inside: look for a quote that stands alone
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            break
        at = line.find(sep, at + 1)
        if at < 0:
            return False
        at += len(sep)
        quoted = False


def begin_states(lines: list[str], state: tuple[bool, bool], sep: str) -> tuple[np.ndarray, tuple[bool, bool]]:
    """Per line whether it begins inside of quotes, for both states the range may begin in; and the states at the end."""
    out = np.empty((len(lines), 2), bool)
    for i, line in enumerate(lines):
        out[i] = state
        if '"' in line:
            state = tuple(ends_quoted(line, s, sep) for s in state) if state[0] != state[1] else (ends_quoted(line, state[0], sep),) * 2
    return out, state


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order within each range; a carriage return at the end stays."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")


def _runs(batches, columns: list[str]) -> Iterator[tuple[tuple, list[str]]]:
    """Consecutive lines of one range within a batch, with the values of ``columns`` that they share."""
    for batch in batches:
        if not len(batch):
            continue
        keys = [batch.column(c) for c in columns]
        at = batch.column("range").to_numpy()
        file = batch.column("file").dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((at[1:] != at[:-1]) | (file[1:] != file[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(batch)]):
            yield tuple(k[int(a)].as_py() for k in keys), batch.column("value").slice(a, b - a).to_pylist()


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _summarise(sep: str):
    def run(batches):
        key, state, starts, lines = None, (False, True), np.zeros(2, np.int64), 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, lines, int(starts[0]), int(starts[1]), state[0], state[1])],
                                              names=[c.split()[0] for c in _RANGES.split(", ")])

        for here, values in _runs(batches, ["file", "range"]):
            if here != key:
                if key is not None:
                    yield row()
                key, state, starts, lines = here, (False, True), np.zeros(2, np.int64), 0
            begins, state = begin_states(values, state, sep)
            filled = np.array([not _blank(v) for v in values])
            starts = starts + (~begins & filled[:, None]).sum(axis=0)
            lines += len(values)
        if key is not None:
            yield row()

    return run


def _assemble(sep: str):
    """Records as numbered in their file; those that began in an earlier range, or go on in a later one, in pieces."""
    def run(batches):
        key, quoted, number, held = None, False, 0, None  # held: [record, lines, began here]
        out: list[tuple] = []

        def close(goes_on: bool):
            if held is not None:
                out.append((*key, held[0], held[2] and not goes_on, "\n".join(held[1])))

        def batch_of():
            columns = list(zip(*out)) if out else [()] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _PIECES.split(", ")])

        for (file, at, inside, first), values in _runs(batches, ["file", "range", "inside", "first"]):
            if (file, at) != key:
                close(quoted)
                key, quoted, number, held = (file, at), inside, first, None
            begins, (quoted, _) = begin_states(values, (quoted, quoted), sep)
            for line, within in zip(values, begins[:, 0]):
                if within:
                    if held is None:
                        held = [number - 1, [], False]
                    held[1].append(line)
                elif not _blank(line):
                    close(False)
                    held = [number, [line], True]
                    number += 1
            if out:
                yield batch_of()
                out = []
        close(quoted)
        if out:
            yield batch_of()

    return run


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``(file, record, text)``: every record of the files at ``path``, numbered from 0 within its file.

    Empty lines outside of quotes are no records.  A record keeps its line
    breaks; the carriage return before a line break that ends it is cut off.
    The facts of a range are one small row for each range of
    ``spark.sql.files.maxPartitionBytes``; they are sent to the lines.
    """
    ranges = stage(_lines(spark, path).mapInArrow(_summarise(sep), _RANGES), "csv_ranges")
    # a range keeps the state, swaps it, or ends in one state whatever came; the last such range and the swaps since decide
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    swaps = F.sum(F.when(F.col("end0") & ~F.col("end1"), 1).otherwise(0))
    settled = F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").alias("state"), F.col("swaps").alias("swaps")))
    placed = ranges.withColumn("swaps", swaps.over(upto)).withColumns({
        "last": F.last(settled, ignorenulls=True).over(before), "so_far": F.coalesce(F.lag("swaps").over(Window.partitionBy("file").orderBy("range")), F.lit(0))})
    odd = (F.col("so_far") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1
    placed = placed.withColumn("inside", F.coalesce("last.state", F.lit(False)) != odd).withColumn(
        "first", F.coalesce(F.sum(F.when(F.col("inside"), F.col("starts1")).otherwise(F.col("starts0"))).over(before), F.lit(0))).select(
        "file", "range", "inside", "first")
    lines = _lines(spark, path).join(F.broadcast(placed), ["file", "range"])
    pieces = stage(lines.select("file", "range", "inside", "first", "value").mapInArrow(_assemble(sep), _PIECES), "csv_records")
    glued = pieces.where("not whole").groupBy("file", "record").agg(
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("range", "text"))), lambda p: p["text"])).alias("text"))
    found = pieces.where("whole").select("file", "record", "text").unionByName(glued)
    return found.withColumn("text", F.regexp_replace("text", "\r$", ""))
