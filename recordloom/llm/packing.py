"""Pack token sequences of documents into as few sequences of one capacity as possible.

Every document is its token ids and an end id. Documents above the capacity are
cut into pieces of exactly the capacity and a shorter rest; nothing else is cut.

Only the histogram of piece lengths matters for packing, and it has at most
``capacity`` entries at any number of documents. On it:

1. Martello-Toth reduction: for a piece of length a, a set with it is fixed if
   no better use of the remaining room exists: alone if nothing fits beside it;
   with the largest piece that fits if that fills the sequence, if no two others
   fit, or if no two others together are longer; with the two largest that fit
   if no other two can be exchanged for better. All copies of such a set are
   fixed at once. Passes repeat until nothing more can be fixed.
2. Best fit, longest first, of the rest, for all pieces of one length at once.

The plan is a list of patterns with counts. Each piece gets its rank among the
pieces of its length (running count in its task, plus the counts of the tasks
before), and the rank says which sequence and offset are its own. No task
gathers the pieces of a length, and the documents are not moved.

Edge cases: null texts are empty (the end id alone); repeated rows and null or
repeated doc_ids are packed row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.durable import materialise
from recordloom.llm.common import crc_of, short_batches, text_bytes
from recordloom.llm.tokens import default_path, encoder

CAPACITY = 4096
END_ID = 1

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, times in one sequence), ...), sequences


class _Lengths:
    """A multiset of lengths, kept sorted."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.keys = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.keys.pop(bisect_left(self.keys, length))

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest lengths once one piece of length ``without`` is gone."""
        out: list[int] = []
        for key in self.keys:
            out += [key] * min(n - len(out), self.count[key] - (key == without))
            if len(out) == n:
                break
        return out

    def largest_up_to(self, room: int, used: tuple[int, ...]) -> int | None:
        at = bisect_right(self.keys, room)
        while at:
            at -= 1
            if self.count[self.keys[at]] > used.count(self.keys[at]):
                return self.keys[at]
        return None

    def best_pair_sum(self, room: int, used: int) -> int:
        """Largest sum of two pieces within ``room`` once one piece of length ``used`` is gone."""
        left = [(k, self.count[k] - (k == used)) for k in self.keys[: bisect_right(self.keys, room)]]
        left = [(k, n) for k, n in left if n]
        best, low, high = 0, 0, len(left) - 1
        while low <= high:
            total = left[low][0] + left[high][0]
            if total > room:
                high -= 1
            else:
                if low < high or left[low][1] > 1:
                    best = max(best, total)
                low += 1
        return best


def _dominating(pool: _Lengths, a: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``a`` that no other set with it beats, or None if none is proven."""
    room = capacity - a
    few = pool.smallest(3, a)
    if not few or few[0] > room:
        return (a,)
    single = pool.largest_up_to(room, (a,))
    if single == room or len(few) < 2 or few[0] + few[1] > room:
        return (a, single)
    if len(few) == 3 and sum(few) <= room:
        return None  # three others may fit: no proof by sets of at most three
    if pool.best_pair_sum(room, a) <= single:
        return (a, single)
    second = pool.largest_up_to(room - single, (a, single))
    if second is None:
        return None
    # A pair that beats (single, second) has its smaller piece above second.
    above = [k for k in pool.keys[bisect_right(pool.keys, second) :] for _ in range(min(2, pool.count[k] - (k == a)))][:2]
    return None if len(above) == 2 and sum(above) <= room else (a, single, second)


def reduce_instance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed patterns, and what is left of the histogram."""
    pool, fixed, changed = _Lengths(counts), [], True
    while changed:
        changed = False
        for a in sorted(pool.count, reverse=True):
            while a in pool.count and (found := _dominating(pool, a, capacity)):
                each = {k: found.count(k) for k in found}
                n = min(pool.count[k] // t for k, t in each.items())
                if len(found) > 2 or n == 0:
                    n = min(n, 1)
                if not n:
                    break
                for k, t in each.items():
                    pool.take(k, n * t)
                fixed.append((tuple(sorted(each.items(), reverse=True)), n))
                changed = True
    return fixed, pool.count


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit, longest first, for all pieces of one length at once."""
    rooms: list[int] = []
    open_bins: dict[int, list[list]] = defaultdict(list)  # room -> [contents, sequences]

    def put(room: int, content: dict[int, int], n: int) -> None:
        if room not in open_bins:
            insort(rooms, room)
        open_bins[room].append([content, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if full := left // each:
                    put(capacity - each * length, {length: each}, full)
                if left % each:
                    put(capacity - left % each * length, {length: left % each}, 1)
                break
            room = rooms[at]
            content, n = open_bins[room][-1]
            fits = room // length  # the fullest sequence takes them until none fits
            some = min(n, left // fits)
            used = fits if some else left
            some = some or 1
            put(room - used * length, content | {length: content.get(length, 0) + used}, some)
            left -= used * some
            entry = next(x for x in open_bins[room] if x[0] is content)
            entry[1] -= some
            if not entry[1]:
                open_bins[room].remove(entry)
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(bisect_left(rooms, room))
    return [(tuple(sorted(c.items(), reverse=True)), n) for found in open_bins.values() for c, n in found]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids), and its place in its task; written once."""
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path).raw, defaultdict(int)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for i, raw in enumerate(encode(text_bytes(batch))):
                all_ids = np.frombuffer(raw + end, "<u4")
                for k, at in enumerate(range(0, len(all_ids), capacity)):
                    own = all_ids[at : at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(own))
                    crc.append(crc_of(own))
                    rank.append(seen[len(own)])
                    seen[len(own)] += 1
                    if with_ids:
                        ids.append(own.astype(np.int32))
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "_part": pa.array([part] * len(row), pa.int32()),
                "_rank": pa.array(rank, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, _part int, _rank long"
    cut = docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)
    return materialise(cut, "pieces")


def _place(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: first rank, first sequence, sequences, offset in them."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    base = 0
    for content, n in patterns:
        offset = 0
        for length, times in content:
            runs[length].append((ranks[length], base, n, offset))
            ranks[length] += n * times
            offset += length * times
        base += n
    return {length: tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) for length, found in runs.items()}


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset."""
    cut = pieces(docs, path, end_id, capacity, with_ids)
    sizes = materialise(cut.groupBy("length", "_part").agg(F.count("*").alias("n")), "sizes")
    # At most ``capacity`` rows, whatever the number of documents.
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = _place(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = cut.join(offsets, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = ranked.select(*names, "_rank")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                first, base, n, at = placed[length]
                k = np.searchsorted(first, rank[own], "right") - 1
                inside = rank[own] - first[k]
                sequence[own] = base[k] + inside % n[k]
                offset[own] = at[k] + inside // n[k] * length
            arrays = [batch.column(name) for name in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")
