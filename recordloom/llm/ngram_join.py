"""Documents whose shingle sets are alike, joined by adaptive multi-match prefixes.

Words are maximal runs of other characters than space and U+0009..U+000D, A-Z
lower-cased. A document's set holds its different shingles of ``WIDTH`` words;
fewer words are one shingle, none are the empty set, which is linked with
nothing. Two sets link when 100 * intersection >= ``LEAST`` * union.

Prefixes. All shingles have one global order, rare ones first: by the counts of
a sketch over all documents, then by hash. Linked sets of sizes n and m share at
least t = ceil(``LEAST`` * n / 100) shingles, and as many seen from m. So the
first n - t + l of one and the first m - t + l of the other share at least l,
for every l; two documents with prefixes made for l and l' share at least the
smaller of both. Each document takes the l with the least estimated cost: a
longer prefix is more rows, but fewer partners are expected to be verified, at
most the summed frequencies of its shingles divided by l.

Candidates. Equal sets are one class, so copies are never paired. Groups hold
the classes with one shingle in their prefix and sizes that may fit; a class that
is in fewer groups than it would have to share with anyone is left out. Each class
is first paired with one pivot of its group, the same in all groups of near
copies, and verified where both share enough prefix shingles in such groups.
What these links connect is one component, and pairs inside it need no further
look. In groups of more than ``BLOCK`` classes with several components left
further pivots are drawn and tried while that pays. Then, where a group has at
most ``BLOCK`` classes, a join counts what its pairs of different components
share, and those that share enough are verified. A larger group is dealt into
parts; a task gets a pair of parts with the prefix shingles and texts of its
classes, counts, verifies what shares enough, each pair in the first of the
groups where it meets, and returns a forest of the links. So no pair of
different texts is lost, and rows for pairs are bounded for each class and group.

Verification brings the text of a class to the class it is compared with, in
parts of at most ``BLOCK``, and intersects the whole sets.

Shingles are compared by 64-bit hashes, sets by a 128-bit digest. A class has a
number of 64 bits made of its digest with a salt by which no two classes of the
table have the same.

Edge cases: null and empty texts have no shingle and are their own component;
null doc_ids are linked like others and never chosen while there is another;
repeated rows are copies; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.durable import materialise
from recordloom.llm.common import short_batches, text_bytes
from recordloom.llm.near_duplicates import components

WIDTH = 4
LEAST = 85
# Counters of the sketch; its size does not depend on the data.
COUNTERS = 1 << 18
# What a candidate costs, in rows of a prefix for each shingle of the document: its whole text is brought.
PAIR_COST = 0.5
# Partners that a shingle is expected to have if its counter shows none.
EXPECTED = 0.1
# Classes of a group whose pairs are rows of a join, and of a part of a larger group.
BLOCK = 256
PART_ROWS = 1024
# Pivots are drawn again while this share of the pairs tried is linked; so many are tried for a class.
WORTH, TRIES = 0.25, 8
# Shingles that are counted at once in a group.
COLUMNS = 4096
# Bytes that are hashed at once, and digests that a task remembers.
PIECE = 1 << 20
REMEMBERED = 1 << 16
# Bits that say which texts may be needed; 4 MB for any number of them, in maps of 4 kB.
MARK_BITS, MAP_BITS = 1 << 25, 1 << 15

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_random = np.random.default_rng(20)
_WORD = _random.integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)


def _weights(n: int) -> np.ndarray:
    """Random odd factors of the byte positions in a word; the same in every process."""
    return np.random.default_rng(21).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


_BYTE = _weights(64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word: bytes times random factors of their places, summed, mixed."""
    global _BYTE
    raw = np.frombuffer(data.lower(), np.uint8)  # bytes.lower() changes A-Z only
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    longest = int(lengths.max())
    if longest > len(_BYTE):
        _BYTE = _weights(1 << (longest - 1).bit_length())
    places = np.flatnonzero(inside) - np.repeat(starts, lengths)
    values = (raw[inside].astype(np.uint64) + np.uint64(1)) * _BYTE[places]
    return _mixed(np.add.reduceat(values, np.cumsum(lengths) - lengths)), starts


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """Of every text the sorted hashes of its different shingles."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        piece, size = [], 0
        while at < len(texts) and (not piece or size < PIECE):
            piece.append(texts[at] or b"")
            size += len(piece[-1]) + 1
            at += 1
        words, starts = _word_hashes(b" ".join(piece))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in piece]))
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for j in range(width):
            rolled = rolled + words[j : j + len(rolled)] * _WORD[j]
        rolled = _mixed(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                short = (words[a:b] * _WORD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(_mixed(np.array([short])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def sketch(docs: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur, over all documents; ``COUNTERS`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            if batch.num_rows:
                counts += np.bincount(_counter(np.concatenate(shingle_sets(text_bytes(batch)))), minlength=COUNTERS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"counter": pa.array(used, pa.int64()), "n": pa.array(counts[used], pa.int64())})

    summed = docs.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNTERS, np.int64)
    for part in materialise(summed, "shingle-sketch").toArrow().to_batches():  # at most COUNTERS rows
        counts[part.column("counter").to_numpy()] = part.column("n").to_numpy()
    return counts


def needed(size: int, least: int = LEAST) -> int:
    """Shingles that a set of this size shares with any linked one, at least."""
    return -(-least * size // 100)


def prefix(own: np.ndarray, counts: np.ndarray, common: float) -> tuple[int, np.ndarray]:
    """The number of matches asked for, and that prefix of a set.

    ``common`` is the count from which a counter says more than chance does.
    """
    seen = counts[_counter(own)]
    order = np.lexsort((own, seen))
    t = needed(len(own))
    shortest = len(own) - t + 1
    partners = np.cumsum(np.maximum(seen[order] - common, EXPECTED))
    matches = np.arange(1, t + 1)
    lengths = shortest + matches - 1
    best = int((lengths + PAIR_COST * len(own) * partners[lengths - 1] / matches).argmin())
    return int(matches[best]), own[order[: lengths[best]]]


def prints(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, text_hash, digest, n, matches, prefix of every row; written once.

    A task gives the prefix of equal sets once, so copies are few before anything is shuffled.
    """
    usual = float(np.median(counts))
    common = usual + 4 * usual**0.5 + 1
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = sent.value, OrderedDict()
        for batch in batches:
            digests, sizes, matches, prefixes = [], [], [], []
            for own in shingle_sets(text_bytes(batch)):
                digest = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
                digests.append(digest)
                sizes.append(len(own))
                if digest is None or digest in known:
                    matches.append(0)
                    prefixes.append(None)
                    continue
                known[digest] = True
                if len(known) > REMEMBERED:
                    known.popitem(last=False)
                least, chosen = prefix(own, table, common)
                matches.append(least)
                prefixes.append(chosen.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.array(matches, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "digest", "n", "matches", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = slim.mapInArrow(run, f"doc_id {kind}, text_hash long, digest binary, n long, matches long, prefix array<long>")
    return materialise(made, "shingle-prints")


def class_of(salt: int) -> Column:
    """The number of a row's class, told from its digest alone: no row has to be sent for it."""
    return F.xxhash64("digest", F.lit(salt))


def numbered_classes(rows: DataFrame) -> tuple[DataFrame, int]:
    """digest, c, doc_id, text_hash, least of every class, and a salt by which no two classes have one number."""
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    classes = rows.where("n > 0").groupBy("digest").agg(first, F.min("doc_id").alias("least"))
    classes = materialise(classes.select("digest", "first.*", "least"), "shingle-classes")
    salt = 0
    while not classes.groupBy(class_of(salt).alias("c")).count().where("count > 1").isEmpty():
        salt += 1
    return classes.withColumn("c", class_of(salt)), salt


def groups(rows: DataFrame, salt: int) -> DataFrame:
    """token, lead, band, side, c, n, matches: classes of a shingle that may be alike in size meet in one group; written once.

    ``lead`` marks the part of a prefix that would be asked for one match; two
    linked classes share a shingle of that part of both. Sizes that fit lie in
    one band or in neighbouring ones. A group has the classes of a band (side 0)
    and of the one above (side 1); pairs of side 1 meet in their own group, so
    every pair that fits meets once at a shingle, and always in the same band.
    Classes that share fewer shingles in a band than any of the classes met
    there asks for are left out of it.

    A posting is sent once, to its shingle: copies from several tasks are told
    there by their equal numbers, and bands are made of what has come together.
    """
    postings = rows.where("prefix IS NOT NULL").select("prefix", F.expr("size(prefix) - matches + 1").alias("leads"), class_of(salt).alias("c"), "n", "matches")
    postings = postings.select(F.posexplode("prefix").alias("pos", "token"), "leads", "c", "n", "matches").withColumn("lead", F.col("pos") < F.col("leads")).drop("pos", "leads")
    at = Window.partitionBy("token")
    postings = postings.withColumn("before", F.lag("c").over(at.orderBy("c"))).withColumns({"a": F.min("c").over(at), "b": F.max("c").over(at)})
    postings = postings.where("a <> b AND (before IS NULL OR before <> c)").drop("before", "a", "b")
    width = math.log(100 / (LEAST - 0.5))  # a little wide, against rounding
    both = F.expr("array(struct(band, 0 AS side), struct(band - 1 AS band, 1 AS side))")
    banded = postings.withColumn("band", F.floor(F.log("n") / width).cast("int")).withColumn("b", F.explode(both)).drop("band")
    banded = banded.select("token", "lead", "b.band", "b.side", "c", "n", "matches")
    met, own = Window.partitionBy("token", "band"), Window.partitionBy("c", "band")
    banded = banded.withColumns({"size": F.count("*").over(met), "low": F.min("side").over(met), "asked": F.least("matches", F.min("matches").over(met))})
    banded = materialise(banded.where("size > 1 AND low = 0").drop("size", "low"), "shingle-buckets")
    grouped = banded.withColumns({"have": F.count("*").over(own), "asked": F.min("asked").over(own)})
    return materialise(grouped.where("have >= asked").drop("asked", "have"), "shingle-groups")


def star_pairs(grouped: DataFrame) -> DataFrame:
    """x, c: every class with the pivots of its groups, where sizes fit and enough of these groups agree."""
    # Windows send the rows of a group once, a join with its pivot would do so twice.
    pairs = grouped.withColumn("x", F.min(F.expr("if(side = 0, c, NULL)")).over(Window.partitionBy("token", "band"))).where("c <> x")
    pairs = pairs.groupBy("x", "c").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("matches").alias("matches"))
    info = grouped.select(F.col("c").alias("x"), F.col("n").alias("other_n"), F.col("matches").alias("other_matches")).distinct()
    fine = f"100 * least(n, other_n) >= {LEAST} * greatest(n, other_n) AND shared >= least(matches, other_matches)"
    return materialise(pairs.join(info, "x").where(fine).select("x", "c"), "shingle-stars")


def mixed_groups(grouped: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of all groups that hold several components, with the number of parts ``k`` of large ones; written once."""
    comps = components(edges).select(F.col("node").alias("c"), "root")
    placed = grouped.join(comps, "c", "left").withColumn("comp", F.coalesce("root", "c")).drop("root")
    met = Window.partitionBy("token", "band")
    mixed = placed.withColumns({"size": F.count("*").over(met), "low": F.min("side").over(met), "a": F.min("comp").over(met), "b": F.max("comp").over(met)})
    mixed = mixed.where("a <> b AND low = 0").withColumn("k", F.when(F.col("size") > block, F.ceil(F.col("size") / PART_ROWS)).otherwise(0).cast("int"))
    return materialise(mixed.drop("size", "low", "a", "b"), "shingle-mixed")


def drawn_pairs(left: DataFrame, turn: int) -> DataFrame:
    """x, c: classes of large groups with some that are drawn for their groups, where components differ and sizes fit."""
    hot = left.where("k > 0 AND lead")
    draw = F.xxhash64("c", "token", "band", F.lit(turn))
    drawn = hot.where("side = 0").groupBy("token", "band").agg(F.min(draw).alias("draw"))
    pivots = hot.withColumn("draw", draw).join(drawn, ["token", "band", "draw"]).where("side = 0")
    pivots = pivots.select("token", "band", F.col("c").alias("x"), F.col("n").alias("other_n"), F.col("comp").alias("other_comp"))
    pairs = hot.join(pivots, ["token", "band"]).where(f"comp <> other_comp AND 100 * least(n, other_n) >= {LEAST} * greatest(n, other_n)")
    some = Window.partitionBy("c").orderBy(F.xxhash64("x", F.lit(turn)))
    pairs = pairs.select("x", "c").distinct().withColumn("try", F.row_number().over(some))
    # Only a start: what is not tried here is compared later.
    return materialise(pairs.where(F.col("try") <= TRIES).select("x", "c"), "shingle-drawn")


def crossing_pairs(left: DataFrame) -> DataFrame:
    """x, c: the pairs of different components that meet in small groups and may share enough prefix shingles."""
    many = left.where("k > 0").groupBy("c", "band").agg(F.count("*").alias("unseen"))
    few = left.where("k = 0").join(many, ["c", "band"], "left").withColumn("unseen", F.coalesce("unseen", F.lit(0)))
    other = few.select("token", "band", *[F.col(name).alias(f"other_{name}") for name in ("side", "c", "n", "matches", "comp", "unseen")])
    fits = f"c < other_c AND comp <> other_comp AND side + other_side < 2 AND 100 * least(n, other_n) >= {LEAST} * greatest(n, other_n)"
    # What a class has in large groups may be shared as well.
    least = F.least("matches", "other_matches") - F.least("unseen", "other_unseen")
    met = few.join(other, ["token", "band"]).where(fits).groupBy("c", "other_c").agg(F.count("*").alias("shared"), F.first(least).alias("least"))
    return materialise(met.where("shared >= least").select(F.col("c").alias("x"), F.col("other_c").alias("c")), "shingle-crossing")


def _shared(lists: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many numbers each list of ``first`` has in common with each of ``second``."""
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    # What only one list has cannot be shared.
    numbers, keep = np.cumsum(times > 1) - 1, times[column] > 1
    owner, column, width = owner[keep], numbers[column[keep]], int((times > 1).sum())
    at = np.full((2, len(lists)), -1)
    at[0, first], at[1, second] = np.arange(len(first)), np.arange(len(second))
    shared = np.zeros((len(first), len(second)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        own, col, wide = owner[a:b], column[a:b] - start, min(COLUMNS, width - start)
        marks = [np.zeros((len(rows), wide), np.float32) for rows in (first, second)]
        for place, mark in zip(at[:, own], marks, strict=True):
            mark[place[place >= 0], col[place >= 0]] = 1
        shared += marks[0] @ marks[1].T
    return shared


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1])


def _linked(rows: pa.Table, token: int, one_part: bool) -> Iterator[tuple[int, int]]:
    """Links of a group's rows (or of two parts of it), as a forest, among the pairs that have no smaller group."""
    rows = rows.combine_chunks().to_batches()[0]
    part, comp, side, n, matches, c = (rows.column(name).to_numpy() for name in ("part", "comp", "side", "n", "matches", "c"))
    first, second = (np.arange(len(n)),) * 2 if one_part else (np.flatnonzero(part == part.min()), np.flatnonzero(part != part.min()))
    if not len(second) or (comp == comp[0]).all():
        return
    fine = (np.minimum(n[first][:, None], n[second]) * 100 >= LEAST * np.maximum(n[first][:, None], n[second])) & (comp[first][:, None] != comp[second])
    fine &= side[first][:, None] + side[second] < 2
    if one_part:
        fine &= first[:, None] < second
    fine &= _shared(_lists(rows.column("list")), first, second) >= np.minimum(matches[first][:, None], matches[second])
    fine &= _shared([own[own < token] for own in _lists(rows.column("hot"))], first, second) == 0
    used = np.zeros(len(n), bool)
    used[first[fine.any(axis=1)]] = used[second[fine.any(axis=0)]] = True
    if not used.any():
        return
    found = shingle_sets([text if u else None for text, u in zip(text_bytes(rows), used.tolist(), strict=True)])
    same = _shared(found, first, second)
    size = np.array([len(own) for own in found], float)
    fine &= 100 * same >= LEAST * (size[first][:, None] + size[second] - same)
    root = list(range(len(n)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*(at.tolist() for at in np.nonzero(fine)), strict=True):
        i, j = int(first[i]), int(second[j])
        if top(i) != top(j):
            root[top(i)] = top(j)
            yield int(max(c[i], c[j])), int(min(c[i], c[j]))


def links_in_parts(left: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: links of the pairs that meet in a large group, as a forest of each pair of its parts."""
    hot = left.where("k > 0 AND lead")
    # All shingles that two classes of different components share are in mixed groups of both.
    lists = left.join(hot.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.collect_set("token").alias("list"))
    hots = hot.groupBy("c", "band").agg(F.collect_set("token").alias("hot"))
    both = F.expr("transform(sequence(0, k - 1), j -> struct(least(part, j) AS i, greatest(part, j) AS j))")
    own = hot.join(lists, "c").join(hots, ["c", "band"]).join(marked(texts, "c", hot.select("c")), "c")
    dealt = own.withColumn("part", F.pmod(F.xxhash64("c"), F.col("k")).cast("int")).withColumn("p", F.explode(both))
    keys = ["token", "band", "i", "j"]
    dealt = dealt.select("token", "band", "p.i", "p.j", "c", "comp", "part", "side", "n", "matches", "list", "hot", "text")
    short_batches(left.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def ended() -> pa.RecordBatch:
            links = list(_linked(pa.Table.from_batches(held), key[0], key[2] == key[3])) if held else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            rows = np.stack([batch.column(name).to_numpy().astype(np.int64) for name in keys], axis=1)
            edges = np.flatnonzero((np.diff(rows, axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
                own = tuple(rows[a].tolist()) if b > a else key
                if own != key:
                    yield ended()
                    key, held = own, []
                held.append(batch.slice(a, b - a))
        yield ended()

    return materialise(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long").distinct(), "shingle-links")


def marked(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """The rows whose hash ``name`` may be among those of ``wanted``, and all that are, without a shuffle of ``rows``.

    They are held against a map of bits, of a size that does not depend on the data.
    """
    place = F.pmod(wanted[0], F.lit(MARK_BITS))
    maps = wanted.select(F.floor(place / MAP_BITS).cast("int").alias("_map"), F.pmod(place, F.lit(MAP_BITS)).alias("_bit"))
    maps = F.broadcast(maps.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    own = F.pmod(name, F.lit(MARK_BITS))
    held = rows.withColumns({"_map": F.floor(own / MAP_BITS).cast("int"), "_at": F.pmod(own, F.lit(MAP_BITS)).cast("int")}).join(maps, "_map")
    return held.where("shiftright(cast(conv(hex(substring(_bits, _at div 8 + 1, 1)), 16, 10) AS int), _at % 8) & 1 = 1").select(*rows.columns)


def verify(pairs: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v of the pairs (x, c) whose whole sets link; ``texts`` has c and text."""
    sizes = pairs.groupBy("x").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    dealt = pairs.join(sizes, "x").select("x", F.pmod(F.xxhash64("c"), F.col("k")).cast("int").alias("part"), "c", F.lit(1).alias("place"))
    pivots = sizes.select("x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.col("x").alias("c"), F.lit(0).alias("place"))
    wanted = materialise(dealt.unionByName(pivots), "shingle-wanted")
    brought = marked(texts, "c", wanted.select("c")).join(wanted, "c").select("x", "part", "place", "c", "text")
    short_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            u, v = [], []
            own = zip(batch.column("x").to_pylist(), batch.column("part").to_pylist(), batch.column("place").to_pylist(), batch.column("c").to_pylist(), shingle_sets(text_bytes(batch)), strict=True)
            for x, part, place, c, found in own:
                if place == 0:
                    key, pivot = (x, part), found
                elif key == (x, part):
                    same = len(np.intersect1d(pivot, found, assume_unique=True))
                    if 100 * same >= LEAST * (len(pivot) + len(found) - same):
                        u.append(max(x, c))
                        v.append(min(x, c))
                else:
                    raise ValueError("a document without the one that it is compared with")
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    sorted_ = brought.repartition("x", "part").sortWithinPartitions("x", "part", "place")
    return materialise(sorted_.mapInArrow(run, "u long, v long").distinct(), "shingle-links")


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """c and text of the classes; written once, as all verification reads them."""
    where = classes.select("c", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    hashed = marked(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), "text_hash", where.select("_hash"))
    same = (hashed["text_hash"] == where["_hash"]) & hashed["doc_id"].eqNullSafe(where["_id"])
    return materialise(hashed.join(where, same).select("c", "text"), "shingle-texts")


def near_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row."""
    docs = docs.select("doc_id", "text")
    rows = prints(docs, sketch(docs))
    classes, salt = numbered_classes(rows)
    grouped = groups(rows, salt)
    texts = _texts(docs, classes.join(grouped.select("c").distinct(), "c", "left_semi"))
    edges = verify(star_pairs(grouped), texts)
    left = mixed_groups(grouped, edges)
    turn = 0
    while True:
        # Large groups of near copies whose members are not all like one pivot.
        pairs = drawn_pairs(left, turn)
        tried = pairs.count()
        if not tried:
            break
        new = verify(pairs, texts)
        linked = new.count()
        if linked:
            edges = materialise(edges.unionByName(new).distinct(), "shingle-edges")
            left, turn = mixed_groups(grouped, edges), turn + 1
        if linked < WORTH * tried:
            break
    rest = verify(crossing_pairs(left), texts).unionByName(links_in_parts(left, texts))
    found = components(materialise(edges.unionByName(rest).distinct(), "shingle-edges"))
    rooted = classes.join(found.withColumnRenamed("node", "c"), "c", "left").select("digest", "least", F.coalesce("root", "c").alias("root"))
    rooted = materialise(rooted, "shingle-rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("digest", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
