"""Operator 5: benchmark decontamination by a broadcast hash set of test n-grams.

Benchmark texts become windows of ``size`` normalised words (an item with fewer is one
window).  Their hashes travel to every task; each document is scanned once: its words turn
into vocabulary numbers, a rolling hash finds windows that may occur, and the numbers of
every hit are compared.  The set is broadcast only up to ``MAX_BLOCK_WINDOWS`` windows; a
larger benchmark is dealt into blocks of that size, each scanned on its own, and the hits of
a row are merged by a number that the row has got before.

Edge cases: null and empty texts have no words, in documents and in the benchmark; an item
without words has no window; repeated items each count; an empty benchmark leaves all
documents clean.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Workspace, arrow_map, each_batch, text_column, texts

WINDOW = 10
#: Windows of the benchmark that are broadcast together.
MAX_BLOCK_WINDOWS = 200_000

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Normalised words: A-Z lower-cased, cut at ASCII characters other than letters and digits."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Windows:
    """The windows of one block of the benchmark."""

    def __init__(self, items: list[tuple[object, list[bytes]]], size: int):
        vocabulary: dict[bytes, int] = {}
        for _, ws in items:
            for w in ws:
                vocabulary.setdefault(w, len(vocabulary))
        self.vocabulary = vocabulary
        self.exact: dict[bytes, set] = {}
        hashes: dict[int, set[int]] = {}
        for item, ws in items:
            n = min(size, len(ws))
            if n:
                ids = np.array([vocabulary[w] for w in ws], dtype=np.int32)
                for k, h in enumerate(_rolling(ids, n).tolist()):
                    hashes.setdefault(n, set()).add(h)
                    self.exact.setdefault(ids[k : k + n].tobytes(), set()).add(item)
        self.by_length = {n: np.array(sorted(h), dtype=np.uint64) for n, h in hashes.items()}
        self.filters = {n: _bits(h) for n, h in self.by_length.items()}

    def scan(self, ws: list[bytes]) -> tuple[np.ndarray, set]:
        """A flag for each word inside an occurring window, and the items with one."""
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), dtype=np.int32, count=len(ws))
        hit, items = np.zeros(len(ws), dtype=bool), set()
        for n, known in self.by_length.items():
            if len(ids) < n or (n > 1 and not _run_of(ids, n)):
                continue
            h = _rolling(ids, n)
            at = np.flatnonzero(self.filters[n][(h >> np.uint64(44)).astype(np.int64)])
            for k in at[np.isin(h[at], known)].tolist():
                found = self.exact.get(ids[k : k + n].tobytes())
                if found:
                    hit[k : k + n] = True
                    items |= found
        return hit, items


def _run_of(ids: np.ndarray, n: int) -> bool:
    """Whether n words in a row are of the vocabulary."""
    gaps = np.flatnonzero(ids < 0)
    return len(gaps) == 0 or max(gaps[0], len(ids) - 1 - gaps[-1], int(np.diff(gaps).max(initial=1)) - 1) >= n


def _bits(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, dtype=bool)
    out[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return out


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    x = (ids.astype(np.int64) + 2).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * _PRIME + x[k : len(ids) - n + 1 + k]
    return out ^ (out >> np.uint64(29)) * _PRIME


def _blocks(benchmark: DataFrame, size: int, most: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their words, in blocks of at most ``most`` windows (one item at least)."""
    block, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ws = words(row["text"])
        more = max(1, len(ws) - size + 1)
        if block and n + more > most:
            yield block
            block, n = [], 0
        if ws:
            block.append((row["item_id"], ws))
            n += more
    yield block


def _runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"from": int(a), "to": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


SPANS = "hits array<struct<from: int, to: int>>, items array<bigint>"


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = MAX_BLOCK_WINDOWS, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``_keep`` (a struct of the columns named), ``_text`` if asked for, ``n_words``, ``hits``, ``items``.

    ``hits`` are runs of hit words, as word numbers.  With several blocks the rows are
    numbered and written first, and the hits of a row are merged by its number.
    """
    benchmark = text_column(benchmark)
    df = text_column(docs).select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep"), F.col("text").alias("_text"))
    schema = f"_keep {df.schema['_keep'].dataType.simpleString()}, {'_text string, ' * with_text}n_words bigint, {SPANS}"
    blocks = _blocks(benchmark, size, most)
    first, second = next(blocks), next(blocks, None)
    send = docs.sparkSession.sparkContext.broadcast
    if second is None:
        return arrow_map(df, _scanner(send(first), size, 1 + with_text), schema)
    ws = Workspace(docs.sparkSession)
    rows = ws.write(df.withColumn("_row", F.monotonically_increasing_id()))
    numbered = rows.select("_row", "_text")
    parts = None
    for k, block in enumerate(chain([first, second], blocks)):
        part = arrow_map(numbered, _scanner(send(block), size, 1), f"_row bigint, n_words bigint, {SPANS}")
        # the first block says how many words there are, of the others only hits matter
        part = ws.write(part if k == 0 else part.filter(F.size("hits") > 0))
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = rows.join(merged, "_row").withColumn("hits", _coalesced("hits"))
    return joined.select("_keep", *["_text"] * with_text, "n_words", "hits", "items")


def _scanner(sent, size: int, n_keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(sent.value, size)
        for b in each_batch(batches):
            n, hits, items = [], [], []
            for t in texts(b, "_text"):
                ws = words(t)
                flags, found = windows.scan(ws)
                n.append(len(ws))
                hits.append(_runs(flags) if found else [])
                items.append(sorted(found))
            run_type = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n_keep], pa.array(n, pa.int64()), pa.array(hits, run_type), pa.array(items, pa.list_(pa.int64()))],
                names=[*b.schema.names[:n_keep], "n_words", "hits", "items"],
            )

    return run


def _coalesced(column: str) -> Column:
    """Sorted runs as one run wherever they overlap or touch."""

    def add(done: Column, h: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["from"].alias("from"), F.greatest(last["to"], h["to"]).alias("to"))
        return F.when(last["to"] >= h["from"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(h)))

    return F.aggregate(column, F.filter(column, lambda h: F.lit(False)), add)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests for each document of :func:`scan`."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["to"] - h["from"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("_keep.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _without(text: str, runs: list[dict]) -> str:
    """The text without its hit words, each run with what stands between its words."""
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(data)]
    out, frm = [], 0
    for r in runs:
        out.append(data[frm : at[r["from"]][0]])
        frm = at[r["to"] - 1][1]
    out.append(data[frm:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_share: float = 0.5) -> DataFrame:
    """``docs`` without the benchmark: hit spans are cut out, and a document goes if over ``max_share`` of its words are hit.

    The columns and types of ``docs`` stay.
    """
    names = [c for c in docs.columns if c != "text"]
    found = scan(docs, benchmark, size, keep=tuple(names), with_text=True)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["to"] - h["from"])
    kept = found.filter((F.size("hits") == 0) | (n_hit <= F.col("n_words") * max_share)).select("_keep", "_text", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            cut = [_without(t, r) if r else t for t, r in zip(texts(b, "_text"), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.string())], names=["_keep", "_text"])

    cut = kept.mapInArrow(run, kept.select("_keep", "_text").schema)
    return cut.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"_keep.`{c}`").alias(c) for c in docs.columns])
