"""The row element of XML files, found from their tags by all tasks at once.

A file is read in bundles of text that end at ``<``. Tags are levels by a running
sum of those opened and closed; the parent of an element is the last one opened
a level higher. Within a bundle both are gone through tag by tag; what came
before a bundle is a prefix over few short rows for each. Elements are grouped
by parent and name: groups that no other bundle can add to are settled where they
are, the others are put together.

Comments and CDATA sections may hold what looks like tags. What stands behind a
``<`` lies in one if the last piece that opens or closes such a section opens it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.durable import materialise
from recordloom.sources.file_parts import BEFORE, BUNDLE, KEYS, along, bundles

# How sections that are not markup begin, behind their ``<``, and how they end.
SECTIONS = {"comment": (b"!--", b"-->"), "cdata": (b"![CDATA[", b"]]>")}
# An end tag, or a name and its attributes up to the end of the tag.
_TAG = re.compile(rb"""<(?:(/[^\s><]+\s*+)|([^\s/>!?"'<]+)((?:"[^"<]*+"|'[^'<]*+'|[^>"'<]++)*+))>""")


def _event(piece: bytes, begin: bytes, end: bytes) -> bool | None:
    """Whether a piece leaves such a section open; None if it has nothing to do with one."""
    return False if end in piece else True if piece.startswith(begin) else None


def _about(text: bytes) -> dict[str, bool | None]:
    """Of each section what the last of its pieces says."""
    last = dict.fromkeys(SECTIONS)
    for name, (begin, end) in SECTIONS.items():
        if begin in text or end in text:
            events = (_event(piece, begin, end) for piece in reversed(text.split(b"<")))
            last[name] = next((e for e in events if e is not None), None)
    return last


def _markup(text: bytes, inside: dict[str, bool]) -> tuple[bytes, bool]:
    """The pieces of a bundle that lie in no section, each behind its ``<``, and whether sections hold parts of each other."""
    if not any(inside.values()) and not any(mark in text for marks in SECTIONS.values() for mark in marks):
        return b"<" + text, False
    inside, kept, mixed = dict(inside), [], False
    for piece in text.split(b"<"):
        events = {name: _event(piece, *marks) for name, marks in SECTIONS.items()}
        mixed |= bool(events["cdata"] and inside["comment"] or events["comment"] and inside["cdata"])
        if not any(inside.values()):
            kept.append(piece)
        inside |= {name: event for name, event in events.items() if event is not None}
    return b"".join(b"<" + piece for piece in kept), mixed


def _groups(markup: bytes) -> tuple[int, list[dict[str, object]], list[dict[str, int]]]:
    """How much deeper a bundle ends, groups of its elements, and the last element of each level.

    Levels start at 0. A group has the level, name, parent (None if an earlier
    bundle has it), number and first of its elements. Once a level has another
    last element, the groups of an earlier parent are whole: of those only the
    first with several elements matters.
    """
    level, seen, groups = 0, {}, {}
    for i, (closed, name, rest) in enumerate(_TAG.findall(markup)):
        if closed:
            level -= 1
            continue
        own = level + 1
        key = own, seen.get(level), name
        if (group := groups.get(key)) is None:
            groups[key] = [1, i]
        else:
            group[0] += 1
        seen[own] = i
        if not rest.endswith(b"/"):
            level = own
    open_, whole = [], None
    for (own, parent, name), (n, first) in groups.items():
        found = {"level": own, "parent": parent, "name": name.decode("utf-8", "replace"), "n": n, "first": first}
        if parent is None or seen[own - 1] == parent:
            open_.append(found)
        elif n > 1 and (whole is None or first < whole["first"]):
            whole = found
    return level, open_ + [whole] * (whole is not None), [{"level": own, "last": i} for own, i in seen.items()]


def _tagged(spark: SparkSession, path: str, size: int) -> DataFrame:
    """_path, _block, all (levels by which a bundle goes deeper), groups and lasts of every bundle; written once."""
    told = ", ".join(f"{name} boolean" for name in SECTIONS)
    found = materialise(bundles(spark, path, "<", _about, told, size), "xml-bundles")
    before = [F.coalesce(F.last(name, ignorenulls=True).over(along().rowsBetween(*BEFORE)), F.lit(False)).alias(name) for name in SECTIONS]
    parts = materialise(found.select(*KEYS, *before), "xml-parts")
    # Never more tasks than bundles, however small the parts that files are read in.
    most = max(1, parts.count())
    placed = found.select("text", *KEYS).coalesce(most).join(parts.coalesce(most), list(KEYS))
    group = pa.struct([("level", pa.int64()), ("parent", pa.int64()), ("name", pa.string()), ("n", pa.int64()), ("first", pa.int64())])
    last = pa.struct([("level", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = zip(*(batch.column(name).to_pylist() for name in SECTIONS), strict=True)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            markup = [_markup(text, dict(zip(SECTIONS, state, strict=True))) for text, state in zip(texts, states, strict=True)]
            made = [(mixed, *_groups(text)) for text, mixed in markup]
            kinds = pa.bool_(), pa.int64(), pa.list_(group), pa.list_(last)
            columns = [batch.column(name) for name in KEYS] + [pa.array([x[i] for x in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEYS, "mixed", "all", "groups", "lasts"])

    kinds = "groups array<struct<level: long, parent: long, name: string, n: long, first: long>>, lasts array<struct<level: long, last: long>>"
    tagged = materialise(placed.mapInArrow(run, f"_path string, _block long, mixed boolean, all long, {kinds}"), "xml-tags").coalesce(most)
    if not tagged.where("mixed").isEmpty():
        raise ValueError(f"{path}: comments and CDATA sections hold parts of each other; state row_tag")
    return tagged.drop("mixed")


def row_elements(spark: SparkSession, path: str, size: int = BUNDLE) -> DataFrame:
    """_path, name: of each file the first element, depth first, that stands more than once under one parent, else the root."""
    tagged = _tagged(spark, path, size)
    base = F.coalesce(F.sum("all").over(along().rowsBetween(*BEFORE)), F.lit(0)).alias("base")
    placed = tagged.join(tagged.select(*KEYS, base), list(KEYS))
    # ``of`` is the level of an element; a parent is kept at the level of its children.
    children = placed.select(*KEYS, "base", F.explode("groups").alias("x"))
    children = children.select(
        *KEYS, (F.col("base") + F.col("x.level")).alias("of"), F.when(F.col("x.parent").isNotNull(), F.struct("_block", F.col("x.parent").alias("_place"))).alias("own"),
        F.col("x.name").alias("child"), "x.n", F.struct("_block", F.col("x.first").alias("_place")).alias("first"),
    )
    lasts = placed.select(*KEYS, "base", F.explode("lasts").alias("x"))
    lasts = lasts.select(*KEYS, (F.col("base") + F.col("x.level") + 1).alias("of"), F.struct("_block", F.col("x.last").alias("_place")).alias("last"))
    last = lasts.unionByName(children.select(*KEYS, "of"), allowMissingColumns=True).groupBy(*KEYS, "of").agg(F.max("last").alias("last"))
    last = last.select(*KEYS, "of", F.last("last", ignorenulls=True).over(along("of").rowsBetween(*BEFORE)).alias("carried"))
    children = children.join(last, [*KEYS, "of"]).withColumn("parent", F.coalesce("own", "carried"))
    groups = children.groupBy("_path", "of", "parent", "child").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    repeated = groups.where("n > 1").groupBy("_path").agg(F.min_by("child", "first").alias("name"))
    roots = groups.where("of = 1").groupBy("_path").agg(F.min_by("child", "first").alias("root"))
    return roots.join(repeated, "_path", "left").select("_path", F.coalesce("name", "root").alias("name"))
