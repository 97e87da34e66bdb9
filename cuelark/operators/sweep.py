"""Ordered sweeps: folds over the rows of a key in order, with a state that moves on and never holds the key's rows.

Rows are dealt by key, sorted within the task by Spark (which spills), and reach a fold in Arrow batches. A fold sees one row at a time and
gives output rows when they are ready; what it keeps is its own affair: the cues that are still heard, or the run it is about to close. So
a media of any length, even one that never pauses, costs memory for its voices only, and time in proportion to its rows.

Where one key may hold a large share of all rows, `split_over` cuts keys with more rows than that at moments that nothing crosses: bins of time are
summed first, a bin whose first start lies beyond all earlier ends begins a new piece, and pieces are dealt like keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

PIECE_MS = 600_000
FLUSH = 10_000


class Fold(Protocol):
    def add(self, row: tuple) -> Iterable[tuple]: ...

    def done(self) -> Iterable[tuple]: ...


def pieces(df: DataFrame, keys: Sequence[str], most: int, gap_ms: int | None, start: str = "start_ms", end: str = "end_ms", bin_ms: int = PIECE_MS) -> DataFrame:
    """df with `__piece`: 0 for keys of up to `most` rows, else the number of the piece between two moments that nothing crosses.

    gap_ms as for islands: None parts rows that touch, 0 keeps them together, more keeps rows up to that gap apart together."""
    at = F.floor(F.col(start) / bin_ms)
    bins = df.groupBy(*keys, at.alias("__bin")).agg(F.count("*").alias("n"), F.min(start).alias("a"), F.max(end).alias("z"))
    w = Window.partitionBy(*keys).orderBy("__bin")
    reach = F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    clear = F.col("a") >= reach if gap_ms is None else F.col("a") > reach + gap_ms
    bins = bins.withColumn("__cut", F.coalesce(clear.cast("int"), F.lit(0))).withColumn("__all", F.sum("n").over(Window.partitionBy(*keys)))
    bins = bins.withColumn("__piece", F.sum("__cut").over(w)).where(F.col("__all") > most).select(*keys, "__bin", "__piece")
    joined = df.withColumn("__bin", at).join(bins, [*keys, "__bin"], "left")
    return joined.select(*df.columns, F.coalesce("__piece", F.lit(0)).alias("__piece"))


def sweep(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], fold: Callable[[tuple], Fold], schema: str | StructType, split_over: int | None = None, gap_ms: int | None = None) -> DataFrame:
    """Rows that `fold(key)` gives for the rows (as tuples of `columns`) of each key in order; a fold's rows come without its key, which is put before them.

    schema has the keys first. split_over needs columns start_ms and end_ms."""
    out = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow, n_keys = to_arrow_schema(out), len(keys)
    by = list(keys)
    own = df.select(*dict.fromkeys([*keys, *order, *columns]))
    if split_over is not None:
        own, by = pieces(own, keys, split_over, gap_ms), [*keys, "__piece"]
    names = [*by, *columns]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        listed = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(listed, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, rows = None, None, []
        for b in batches:
            listed = [b.column(c).to_pylist() for c in names]
            for row in zip(*listed, strict=True):
                if row[: len(by)] != at:
                    if state is not None:
                        rows += [(*at[:n_keys], *r) for r in state.done()]
                    at = row[: len(by)]
                    state = fold(at[:n_keys])
                given = state.add(row[len(by) :])
                if given:
                    rows += [(*at[:n_keys], *r) for r in given]
                    if len(rows) >= FLUSH:
                        yield batch(rows)
                        rows = []
        if state is not None:
            rows += [(*at[:n_keys], *r) for r in state.done()]
        yield batch(rows)

    return own.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, out)


def cues_heard(threshold_ms: int) -> Callable[[tuple], Fold]:
    """Conflicts of cues (start, end, idx, speaker): gives (idx,) of both cues of each pair that goes."""

    class Conflicts:
        def __init__(self, _key: tuple):
            self.live: list[tuple] = []

        def add(self, cue: tuple) -> Iterable[tuple]:
            start, end, idx, speaker = cue
            self.live = [a for a in self.live if a[1] > start]
            for i, a in enumerate(self.live):
                if a[3] != speaker and min(a[1], end) - max(a[0], start) > threshold_ms:
                    del self.live[i]
                    return ((a[2],), (idx,))
            self.live.append(cue)
            return ()

        def done(self) -> Iterable[tuple]:
            return ()

    return Conflicts


class Clip:
    """A run of clips (start, end, entry_idx, raw_speaker, excerpt, full_text, kind) as the one clip it becomes. Of what is cut only the part that shows is kept."""

    RAW, EXCERPT = 60, 120

    def __init__(self, clip: tuple):
        self.start, self.end, self.entry_idx, raw, excerpt, text, self.first_kind = clip
        self.n, self.single = 1, self.first_kind == "single"
        self.first_raw, self.first_excerpt = raw, excerpt
        self.raws, self.excerpt, self.texts, self.lead = raw, excerpt, [text] if text else [], None

    def add(self, clip: tuple) -> None:
        start, end, _, raw, excerpt, text, kind = clip
        self.n += 1
        self.start, self.end = min(self.start, start), max(self.end, end)
        if kind == "single" and not self.single and self.first_kind == "multi":
            # a single row that joins multi rows puts its raw speaker in front
            self.lead, self.single = raw, True
        else:
            self.single = self.single or kind == "single"
            self.raws = self._and(self.raws, raw, self.RAW)
        self.excerpt = self._and(self.excerpt, excerpt, self.EXCERPT)
        if text:
            self.texts.append(text)

    @staticmethod
    def _and(said: str, more: str, most: int) -> str:
        return said if len(said) > most else f"{said} / {more}"

    def row(self) -> tuple:
        raws = self.raws if self.lead is None else f"{self.lead} / {self.raws}"
        many = self.n > 1
        return (self.start, self.end, raws[: self.RAW] if many else self.first_raw, self.excerpt[: self.EXCERPT] if many else self.first_excerpt, " ".join(self.texts), "single" if self.single else self.first_kind, self.entry_idx, self.n)


def clips_joined(joins: Callable[[Clip, int, tuple], bool]) -> Callable[[tuple], Fold]:
    """Runs of clips: a clip joins the open run if `joins(run, reach of all before, clip)`."""

    class Runs:
        def __init__(self, _key: tuple):
            self.run: Clip | None = None
            self.reach = 0

        def add(self, clip: tuple) -> Iterable[tuple]:
            done: tuple = ()
            if self.run is not None and joins(self.run, self.reach, clip):
                self.run.add(clip)
            else:
                done = () if self.run is None else (self.run.row(),)
                self.run = Clip(clip)
            self.reach = clip[1] if not self.reach else max(self.reach, clip[1])
            return done

        def done(self) -> Iterable[tuple]:
            return () if self.run is None else (self.run.row(),)

    return Runs


def cues_merged(gap_ms: int) -> Callable[[tuple], Fold]:
    """Runs of cues (start, end, src, text, is_multi, is_lyric) within the gap; a lyric cue stays alone and ends the run before it."""

    class Runs:
        def __init__(self, _key: tuple):
            self.run: list | None = None

        def add(self, cue: tuple) -> Iterable[tuple]:
            start, end, src, text, multi, lyric = cue
            out = []
            if self.run is not None and not lyric and start <= self.run[1] + gap_ms:
                run = self.run
                run[1] = max(run[1], end)
                run[3] = run[3] or (multi and len(run[5]) == 1)
                run[4] = run[4] or multi
                run[5].append(src)
                if text:
                    run[2].append(text)
                return ()
            out += self.done()
            self.run = [start, end, [text] if text else [], multi, multi, [src]]
            return [*out, *self.done()] if lyric else out

        def done(self) -> Iterable[tuple]:
            if self.run is None:
                return ()
            (start, end, texts, early, some, sources), self.run = self.run, None
            tags = (["MULTI"] if some else []) if len(sources) == 1 else ["MULTI", "MERGED"] if early else ["MERGED", "MULTI"] if some else ["MERGED"]
            return ((start, end, " / ".join(texts), tags, sources, len(sources) - 1),)

    return Runs
