"""Records that cross line ends, read split by split: scan each split, compose the states over a file's splits, then cut."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableferry.session import BROADCAST_BYTES, scratch_dir, stored_bytes

CUT = "file string, block bigint, part string, section string, value string"


def pin_splits(spark: SparkSession) -> None:
    """Files are cut alike by every scan of this session, also when executors come and go in between."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))


def pieces(spark: SparkSession, path: str | list[str], end: str) -> DataFrame:
    """What stands between the ends ``end`` of each file, in order inside each split."""
    pin_splits(spark)
    block = F.col("_metadata.file_block_start").alias("block")
    return spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("file"), block, "value")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str], dict]]:
    """The pieces of a task as ``(file, block, pieces of this batch, memory of this split)``; a split may come in several batches."""
    now, memory = None, {}
    for batch in batches:
        files, blocks, values = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
        at = 0
        while at < len(values):
            where = (files[at], blocks[at])
            end = at
            while end < len(values) and files[end] == where[0] and blocks[end] == where[1]:
                end += 1
            if where != now:
                now, memory = where, {}
            yield *where, iter(values[at:end]), memory
            at = end


def starts(
    spark: SparkSession, found: DataFrame, scan: Callable[[tuple, str], tuple], states: list[tuple], compose: Callable[[tuple, tuple, tuple], tuple]
) -> DataFrame:
    """``file, block, state``: the state in which each split starts, as text.

    ``scan`` takes a piece from a state to the next; every split is scanned from each of ``states``. ``compose(state, start, end)``
    applies what a split made of ``start`` to a state that equals it but for what ``scan`` only adds to. One row per split is
    put together by file.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple, list[tuple]] = {}
        for file, block, values, _ in by_split(batches):
            now = ends.setdefault((file, block), list(states))
            for value in values:
                now[:] = [scan(s, value) for s in now]
        keys = list(ends)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [repr(ends[k]) for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["file", "block", "ends"])

    def composed(splits: pd.DataFrame) -> pd.DataFrame:
        import ast

        splits = splits.sort_values("block")
        state, out = states[0], []
        for ends in splits["ends"]:
            out.append(repr(state))
            for start, end in zip(states, ast.literal_eval(ends)):
                if start[0] == state[0]:
                    state = compose(state, start, end)
                    break
        return pd.DataFrame({"file": splits["file"], "block": splits["block"], "state": out})

    summaries = written(spark, found.mapInArrow(scanned, "file string, block bigint, ends string"), "split-ends")
    return written(spark, summaries.groupBy("file").applyInPandas(composed, "file string, block bigint, state string"), "split-starts")


def cut_records(
    spark: SparkSession, found: DataFrame, started: DataFrame, cut: Callable[[Iterator[str], dict], Iterator[tuple]], close: Callable[[dict], Iterator[tuple]],
    glue: str = "",
) -> DataFrame:
    """``file, block, part, section, value`` of every record, by the split where it begins; written once.

    ``cut`` yields ``(part, section, text)`` with part ``whole``, or ``head`` for the end of a record that began in an earlier
    split, ``close`` the ``open`` one that a split leaves; other parts are handed on. Only heads and open records, a few rows per split, are shuffled and joined.
    A split that the second reading cuts elsewhere than the first is an error, not a loss.
    """
    import ast

    folders = {f.rsplit("/", 1)[0] for f in started.inputFiles()}
    if sum(stored_bytes(spark, f) for f in folders) > BROADCAST_BYTES:
        raise ValueError("too many splits to send their states to all tasks; read the files in parts")
    joined = found.join(F.broadcast(started), ["file", "block"], "left")
    state = F.coalesce("state", F.raise_error(F.lit("the files were cut differently when they were read again")))
    joined = joined.select("file", "block", "value", state.alias("state"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [[]] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                ["file", "block", "part", "section", "value"],
            )

        last: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            state_of = batch.column("state").to_pylist()
            at = 0
            for file, block, values, memory in by_split(iter([batch.select(["file", "block", "value"])])):
                if last is not None and last[:2] == (file, block):
                    memory = last[2]
                elif last is not None:
                    out += [(*last[:2], *r) for r in close(last[2])]
                values = list(values)
                memory.setdefault("state", ast.literal_eval(state_of[at]))
                memory.setdefault("block", block)
                at += len(values)
                out += [(file, block, *r) for r in cut(iter(values), memory)]
                last = (file, block, memory)
            yield rows(out)
        if last is not None:
            yield rows([(*last[:2], *r) for r in close(last[2])])

    parts = written(spark, joined.mapInArrow(run, CUT), "records")
    loose = parts.filter("part in ('head', 'open')")
    order = Window.partitionBy("file").orderBy("block", F.col("part") == "open")
    began = F.last(F.when(F.col("part") == "open", F.struct("block", "section")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = F.when(F.col("part") == "open", F.struct("block", "section")).otherwise(began)
    loose = loose.withColumn("began", own).groupBy("file", "began").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.col("part") == "open", "value"))), lambda x: x["value"]), glue).alias("value")
    )
    return parts.filter("part not in ('head', 'open')").select("file", "block", "part", "section", "value").unionByName(
        loose.select("file", F.col("began.block").alias("block"), F.lit("whole").alias("part"), F.col("began.section").alias("section"), "value")
    )


def open_after(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted cell is open at the end of a line; a quote opens one only where a cell starts."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line[at + 1 : at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
        elif line[at : at + 1] == '"':
            at, inside = at + 1, True
            continue
        inside, at = False, line.find(sep, at)
        if at < 0:
            return False
        at += 1


def csv_records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """``file, section, value``: the rows of delimited files as texts, line breaks in quoted cells kept; blank lines are no rows.

    ``section`` is ``first`` for the first row of a file.
    """

    def scan(state: tuple, line: str) -> tuple:
        return (open_after(line, state[0], sep),) if '"' in line else state

    def started(memory: dict) -> str | None:
        return "first" if memory["block"] == 0 and not memory["seen"] else None

    def cut(lines: Iterator[str], memory: dict) -> Iterator[tuple]:
        if "inside" not in memory:
            memory |= {"inside": memory["state"][0], "continues": memory["state"][0], "waiting": [], "seen": False}
        waiting = memory["waiting"]
        for line in lines:
            if not memory["inside"] and not line.strip():
                continue
            memory["inside"] = open_after(line, memory["inside"], sep) if '"' in line else memory["inside"]
            waiting.append(line)
            if not memory["inside"]:
                text = "\n".join(waiting).removesuffix("\r")
                first = started(memory)
                yield ("head" if memory["continues"] else "whole"), first, text.removeprefix("\ufeff") if first else text
                memory["continues"], memory["seen"] = False, True
                waiting.clear()

    def close(memory: dict) -> Iterator[tuple]:
        if memory["waiting"]:
            yield ("head" if memory["continues"] else "open"), started(memory), "\n".join(memory["waiting"])

    found = pieces(spark, path, "\n")
    states = starts(spark, found, scan, [(False,), (True,)], lambda state, start, end: end)
    return cut_records(spark, found, states, cut, close, "\n").select("file", "section", "value")


TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[\[\]{}]|[^\s,:\[\]{}"]+', re.S)
CLOSE_STRING = re.compile(r'(?:[^"\\]|\\.)*(?:"|\\?\Z)', re.S)


def _closed(text: str, at: int, end: int) -> bool:
    """Whether the string token ends with its quote."""
    return end - at > 1 and text[end - 1] == '"' and (end - 1 - len(text[at : end - 1].rstrip("\\")) - at) % 2 == 0


def _after(state: tuple, piece: str, event: Callable[[str, int, int, int], None] | None = None) -> tuple:
    """``(in a string, depth)`` after a piece and the brace that ended it; ``event`` gets the tokens outside strings."""
    inside, depth = state
    text, at = piece + "}", 0
    if inside:
        at = CLOSE_STRING.match(text).end()
        if not _closed('"' + text, 0, at + 1):
            return True, depth
    for token in TOKEN.finditer(text, at):
        first, before = token[0][0], depth
        if first == '"' and not _closed(text, *token.span()):
            return True, depth
        depth += (first in "[{") - (first in "]}")
        if event:
            event(first, token.start(), token.end(), before)
    return False, depth


@dataclass
class Walk:
    """Where the reading of one split of a JSON document stands. Records lie in the root array, or in an array the root holds."""

    at: tuple
    root: str | None
    section: str | None
    open: bool
    continues: bool
    key: str = ""
    held: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, state: tuple) -> Walk:
        inside, depth, root = state
        between = depth > (1 if root == "[" else 2) if root else False
        return cls((inside, depth), root, "" if root == "[" else None, between, between)

    def read(self, piece: str) -> Iterator[tuple]:
        text, out, begin = piece + "}", [], 0

        def event(first: str, start: int, end: int, depth: int) -> None:
            nonlocal begin
            if self.root is None:
                if first not in "[{":
                    raise ValueError("a JSON document is an array or an object")
                self.root, self.section = first, "" if first == "[" else None
                return
            base = 1 if self.root == "[" else 2
            if depth == 1 and base == 2:
                if first == '"':
                    self.key = text[start + 1 : end - 1]
                elif first in "[{":
                    # An object that the root holds is no list of records, whatever its name.
                    self.section = self.key if first == "[" else "{" + self.key
                    out.append(("section", self.section, ""))
            elif depth == base and not self.open:
                if first == "{":
                    self.open, begin = True, start
                elif first not in "]}" and self.section in ("", "data"):
                    raise ValueError("an array of records holds values that are not objects")
            elif depth == base + 1 and first == "}" and self.open:
                out.append(("head" if self.continues else "whole", self.section, "".join([*self.held, text[begin:end]])))
                self.held, self.open, self.continues = [], False, False

        self.at = _after(self.at, piece, event)
        if self.open:
            self.held.append(text[begin:])
        yield from out


def lines_of_records(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the files, each of which begins with an object, whose first line is a whole object and not the last line."""

    def first_breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, values, memory in by_split(batches):
            for value in values if "done" not in memory else ():
                if block == 0 and "seen" not in memory:
                    # What stands before the first object is no line; the object itself is none that ends here.
                    memory["seen"], value = True, value.lstrip("\ufeff \t\r\n")
                if "\n" in value or "\r" in value:
                    memory["done"] = True
                    after = value.lstrip(" \t")
                    ended = after[:1] in ("\r", "\n") and after.lstrip()[:1] not in ("", ",", "]")
                    yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "ended": [ended]})
                    break

    breaks = pieces(spark, paths, "}").mapInArrow(first_breaks, "file string, block bigint, ended boolean")
    first = breaks.groupBy("file").agg(F.min_by("ended", "block").alias("ended")).filter("ended")
    return [unquote(r[0]) for r in first.select("file").collect()]


def json_records(spark: SparkSession, path: str | list[str], wrapper: str = "data") -> tuple[DataFrame, DataFrame]:
    """Records of JSON documents that are an array or wrap one in ``data``: ``file, value``, and the files that are neither.

    Files are cut at closing braces, wherever these stand, so that an array in one line is split like any other. A split is
    scanned once as if it began outside and once as if it began inside a string; one row per split then tells where each
    begins. Fields beside ``data`` are not read. Arrays that hold anything but objects fail the read.
    """

    def cut(values: Iterator[str], memory: dict) -> Iterator[tuple]:
        walk = memory.setdefault("walk", None) or Walk.of(memory["state"])
        memory["walk"] = walk
        for piece in values:
            yield from walk.read(piece)

    def close(memory: dict) -> Iterator[tuple]:
        walk = memory["walk"]
        if walk.held:
            yield "head" if walk.continues else "open", walk.section, "".join(walk.held)
        yield "last", walk.section, ""

    def scan(state: tuple, piece: str) -> tuple:
        root = state[2] if state[2] is not None else piece.lstrip("\ufeff \t\r\n")[:1] or None
        return (*_after(state[:2], piece), root)

    def compose(state: tuple, start: tuple, end: tuple) -> tuple:
        return end[0], state[1] + end[1] - start[1], end[2] if state[2] is None else state[2]

    found = pieces(spark, path, "}")
    states = starts(spark, found, scan, [(False, 0, None), (True, 0, "")], compose)
    records = cut_records(spark, found, states, cut, close)
    # A split that begins inside an array of the root learns its name from the splits before.
    last = records.filter("part = 'last'").select("file", "block", F.col("section").alias("now"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = states.select("file", "block").join(last, ["file", "block"], "left")
    carried = carried.select("file", "block", F.last("now", ignorenulls=True).over(before).alias("carried"))
    whole = records.filter("part = 'whole'").join(F.broadcast(carried), ["file", "block"])
    own = F.coalesce("section", "carried").isin("", wrapper)
    known = records.filter(F.col("part").isin("section", "last") & F.col("section").isin("", wrapper)).select("file").distinct()
    other = states.select("file").distinct().join(known, "file", "left_anti")
    return whole.filter(own).select("file", "value"), other
