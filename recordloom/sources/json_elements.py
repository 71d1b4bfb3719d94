"""Elements of JSON documents as one line each, found by all tasks at once.

A document is read in bundles of text that end at commas. Whether a bundle
starts inside a string is the parity of the quotes before it, and how deep it
starts is the sum of the brackets outside of strings before it. Both are carried
along within the part of the file that a task reads, for a part that starts
outside and one that starts inside of a string; which of them holds is a prefix
over one short row for each part. The elements of a list are then what stands
between commas at the list's own depth. Those that lie in one bundle are cut out
where it is, and only the ends of bundles are brought together: no document has
to fit into a row, only its elements. Texts meet few short rows, are read and
handed to Python few at a time, and are sent once, to put the lines in order.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.durable import materialise, shared_folder
from recordloom.sources.file_parts import BEFORE, BUNDLE, FEW_BYTES, FEW_ROWS, KEYS, along, bundles, joined, with_owner, with_settings

# The column of plain values in a top-level array, and in a list of an object.
TOP_VALUES, LIST_VALUES = "0", "value"

_QUOTE, _COMMA, _OPEN, _CLOSE = b'",[]'
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_MARK = _STEP != 0
_MARK[[_QUOTE, _COMMA]] = True


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and bytes of brackets and commas, and the quotes before each; the last one stands for the end of the text."""
    if b"\\" in text:
        text = re.sub(rb"(?s)\\.", b"  ", text)
    raw = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_MARK[raw])
    kind = raw[at]
    quotes = np.cumsum(kind == _QUOTE)
    keep = kind != _QUOTE
    total = quotes[-1:] if len(quotes) else np.zeros(1, np.int64)
    return np.append(at[keep], len(text)), np.append(kind[keep], 0), np.append(quotes[keep], total)


def _about(text: bytes) -> dict[str, int]:
    """Quotes, and by whether the text starts outside (0) or inside (1) of a string: how much deeper it ends, its lowest depth."""
    _, kind, quotes = _marks(text)
    found = {"quotes": int(quotes[-1])}
    for inside in (0, 1):
        depth = np.cumsum(np.where((quotes + inside) % 2 == 0, _STEP[kind], 0))
        found |= {f"all{inside}": int(depth[-1]), f"low{inside}": min(0, int(depth.min()))}
    return found


def _carry(before: dict[str, int] | None, own: dict[str, int]) -> dict[str, int]:
    """What ``_about`` says, by whether the part starts outside (0) or inside (1) of a string; turn and base are of the quotes and depth before in the part."""
    turn = (before["turn"] + before["quotes"]) % 2 if before else 0
    found = {"turn": turn, "quotes": own["quotes"]}
    for part in (0, 1):
        inside, base = (part + turn) % 2, before[f"base{part}"] + before[f"all{part}"] if before else 0
        found |= {f"base{part}": base, f"all{part}": own[f"all{inside}"], f"low{part}": base + own[f"low{inside}"]}
    return found


def _bundles(spark: SparkSession, path: str, size: int) -> tuple[DataFrame, int]:
    """text, _path, _block, _part and what ``_carry`` says of all bundles, written once; their number."""
    told = "turn long, quotes long, base0 long, all0 long, low0 long, base1 long, all1 long, low1 long"
    with with_settings(spark, FEW_ROWS):
        found = materialise(bundles(spark, path, ",", _about, told, size, _carry), "json-bundles")
    # Never more tasks than bundles, however small the parts that files are read in.
    most = max(1, found.count())
    return found.coalesce(most), most


def _parts(found: DataFrame) -> DataFrame:
    """One row per part: inside (1 if it starts inside a string), depth at its start, and list (the depth of the file's elements, 0 if there is no list)."""
    kind = F.substring(F.regexp_replace(F.substring("text", 1, 1 << 16), r"^\s+", ""), 1, 1)
    files = found.where("_block = 0").select("_path", kind.alias("kind"))
    files = files.select("_path", F.expr("CASE kind WHEN '[' THEN 1 WHEN '{' THEN 2 ELSE 0 END").alias("list"))
    parts = found.groupBy("_path", F.col("_part").alias("_block")).agg(F.sum("quotes").alias("quotes"), F.sum("all0").alias("all0"), F.sum("all1").alias("all1"))
    parts = parts.withColumn("inside", F.coalesce(F.sum("quotes").over(along().rowsBetween(*BEFORE)), F.lit(0)) % 2)
    parts = parts.selectExpr(*KEYS, "inside", "if(inside = 0, all0, all1) AS all")
    parts = parts.withColumn("depth", F.coalesce(F.sum("all").over(along().rowsBetween(*BEFORE)), F.lit(0)))
    return parts.join(files, "_path").selectExpr("_path", "_block AS _part", "inside", "depth", "list")


def _placed(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Bundles with quotes and start (1 if inside a string), base (depth), ends (depth), low (lowest depth) and the other columns of their parts."""
    both = found.join(parts, ["_path", "_part"])
    others = [name for name in parts.columns if name not in ("_path", "_part", "inside", "depth")]
    depths = {"base": ("base0", "base1"), "ends": ("base0 + all0", "base1 + all1"), "low": ("low0", "low1")}
    own = [f"depth + if(inside = 0, {a}, {b}) AS {name}" for name, (a, b) in depths.items()]
    return both.selectExpr("text", *KEYS, "quotes", "(turn + inside) % 2 AS start", *own, *others)


def _outside(text: bytes, start: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and bytes of the brackets and commas outside of strings, and the depths behind them."""
    at, kind, quotes = _marks(text)
    keep = (quotes + start) % 2 == 0
    keep[-1] = False
    at, kind = at[keep], kind[keep]
    return at, kind, base + np.cumsum(_STEP[kind])


def _binary(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _lists(found: DataFrame, parts: DataFrame) -> DataFrame:
    """The parts, with where the list of their file begins and ends; list is 0 if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends = [], []
            own = zip(_binary(batch), *(batch.column(name).to_pylist() for name in ("start", "base", "list")), strict=True)
            for text, start, base, level in own:
                at, kind, after = _outside(text, start, base)
                begin, end = at[(kind == _OPEN) & (after == level)], at[(kind == _CLOSE) & (after == level - 1)]
                begins.append(int(begin[0]) if len(begin) else None)
                ends.append(int(end[0]) if len(end) else None)
            columns = [*(batch.column(name) for name in KEYS), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEYS, "p", "q"])

    # Only bundles that are somewhere less deep than the elements hold an end of the list.
    near = _placed(found, parts).where("list > 0 AND low < list").select("text", *KEYS, "start", "base", F.col("list").cast("bigint").alias("list"))
    near = near.mapInArrow(run, "_path string, _block long, p long, q long")
    both = [F.min(F.when(F.col(at).isNotNull(), F.struct("_block", at))).alias(name) for at, name in (("p", "begin"), ("q", "end"))]
    lists = parts.join(near.groupBy("_path").agg(*both), "_path", "left")
    return lists.withColumn("list", F.when(F.col("begin").isNull(), 0).otherwise(F.col("list")))


def _line(element: bytes, level: int) -> bytes:
    """An element as a line, empty if there is nothing; see ``_as_line``."""
    element = re.sub(rb"[\r\n\t]+", b" ", element).strip(b" ")
    if not element or element.startswith(b"{"):
        return element
    return b'{"%s": %s}' % ((LIST_VALUES if level == 2 else TOP_VALUES).encode(), element)


def _as_line(text: Column, level: Column) -> Column:
    text = F.trim(F.regexp_replace(text, r"[\r\n\t]+", " "))
    name = F.when(level == 2, F.lit(LIST_VALUES)).otherwise(F.lit(TOP_VALUES))
    return F.when((text == "") | text.startswith("{"), text).otherwise(F.concat(F.lit('{"'), name, F.lit('": '), text, F.lit("}")))


def _elements(held: DataFrame) -> DataFrame:
    """Of bundles between the ends of a list: value (the lines of its whole elements), head (what an earlier bundle began) and tail (what goes on)."""

    def cut(text: bytes, start: int, base: int, ends: int, quotes: int, level: int, begin: int | None, end: int | None) -> tuple[bytes, bytes | None, bytes | None]:
        at, kind, after = _outside(text, start, base)
        a, b = 0 if begin is None else begin + 1, len(text) if end is None else end
        cuts = at[(kind == _COMMA) & (after == level) & (at >= a) & (at < b)].tolist()
        parts = [text[i:j] for i, j in zip([a, *(c + 1 for c in cuts)], [*cuts, b], strict=True)]
        goes_on = end is None and (ends != level or (start + quotes) % 2 == 1)
        head = parts.pop(0) if begin is None and (base != level or start == 1) else None
        # A bundle without a place to cut, inside an element, is its head.
        tail = parts.pop() if parts and goes_on else None
        return b"\n".join(line for part in parts if (line := _line(part, level))), head, tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "base", "ends", "quotes", "list", "begin", "end")
        for batch in batches:
            own = zip(_binary(batch), *(batch.column(name).to_pylist() for name in names), strict=True)
            found = [cut(*row) for row in own]
            columns = [*(batch.column(name) for name in (*KEYS, "list"))] + [pa.array([x[i] for x in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEYS, "list", "value", "head", "tail"])

    inner = held.where("list > 0 AND _block >= begin._block AND (end IS NULL OR _block <= end._block)")
    at = ["if(_block = begin._block, begin.p, NULL) AS begin", "if(_block = end._block, end.q, NULL) AS end"]
    inner = inner.selectExpr("text", *KEYS, "start", "base", "ends", "quotes", "cast(list AS bigint) AS list", *at)
    return inner.mapInArrow(run, "_path string, _block long, list long, value string, head string, tail string")


def lines(spark: SparkSession, path: str, size: int = BUNDLE) -> str:
    """Write every row of the documents as one line of JSON, in order; the folder they are in.

    A top-level array gives its elements; an object those of its first list, or
    itself if it has none. Plain values become objects of one field.
    """
    with with_settings(spark, FEW_BYTES):
        found, most = _bundles(spark, path, size)
        parts = materialise(_parts(found), "json-parts").coalesce(most)
        parts = materialise(_lists(found, parts), "json-lists").coalesce(most)
        held = _placed(found, parts)
        with with_settings(spark, FEW_ROWS):
            inner = materialise(_elements(held), "json-inner").coalesce(most)
    whole = held.where("list = 0").select(F.col("text").alias("value"), *KEYS, F.lit(0).alias("_place"), F.lit(None).alias("_owner"))
    whole = joined(whole, ",").withColumn("list", F.lit(0))

    # The head of a bundle stands before its lines, the tail behind them.
    heads = inner.where("head IS NOT NULL").select(F.col("head").alias("value"), *KEYS, F.lit(-1).alias("_place"), F.lit(0).alias("_no"), "list")
    tails = inner.where("tail IS NOT NULL").select(F.col("tail").alias("value"), *KEYS, F.lit(1).alias("_place"), F.lit(1).alias("_no"), "list")
    each = joined(with_owner(heads.unionByName(tails)), ",", F.first("list").alias("list"))
    each, whole = (df.select(_as_line(F.col("text"), F.col("list")).alias("value"), *KEYS, "_place") for df in (each, whole))
    rows = each.unionByName(whole).unionByName(inner.select("value", *KEYS, F.lit(0).alias("_place"))).where("value <> ''")
    return line_folder(rows.orderBy(*KEYS, "_place").select("value"))


def line_folder(rows: DataFrame) -> str:
    """Write texts as lines into the shared folder."""
    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/recordloom/json-lines-{uuid.uuid4().hex}"
    rows.write.text(path)
    return path
