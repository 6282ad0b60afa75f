"""Operator 7: SimHash near-duplicates by segment popcounts.

A fingerprint's 64 bits are cut into 32 segments of 2 bits; its embedding is the count of
set bits in each segment.  The Manhattan distance of two embeddings is at most the Hamming
distance of the fingerprints, so pairs within ``DISTANCE`` lie within that distance of each
other in the embedding.  The range join runs on a grid: the 32 axes fall into 6 groups, and
a pair whose embeddings are within 3 differs in at most 3 groups, so it agrees on at least 3.
Every choice of 3 groups, with the counts in them, is a cell; each distinct fingerprint lies
in 20.  Within a cell the embedding distance is tested first, then the Hamming distance.

Equal fingerprints are collapsed before, with a map-side combine, so exact copies cost
nothing.  A cell gives back a spanning forest of its links, never all pairs; the links lost
are implied by those kept.  A cell with more than ``CELL_BLOCK`` fingerprints is dealt into
blocks, and every pair of blocks is a row of work of its own, so a crowded cell is neither
held in one task nor cut.  Components come from :mod:`plumbline.llm.graph`.

:func:`keep_one_similar` takes similarity of word shingles instead of a number of bits.  Its
candidates are the links above, over shingles of five words, and texts that share a cell in the
MinHash bands of :mod:`plumbline.llm.lines`: at similarity 0.8 fingerprints differ in ten bits
of 64 on average, where no grid is selective.  All candidates are verified by exact Jaccard
similarity of the distinct shingles.

Edge cases: null, empty and blank texts have fingerprint zero, which links like any other;
texts under three words have one shingle; repeated rows are in one component; an empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import lines
from plumbline.llm.common import Workspace, arrow_map, each_batch, text_column, texts
from plumbline.llm.graph import connected_components

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Axis groups of the grid, as numbers of 2-bit segments.
GROUPS = (6, 6, 5, 5, 5, 5)
CELL_BLOCK = 2048
#: Words in a shingle and least similarity of near-duplicates where no number of bits is asked for.
WORDS, SIMILARITY = 5, 0.8
#: Shingles that are hashed at a time; a long text takes several turns.
CHUNK = 20_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of the text's word shingles; 0 without words."""
    ws = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not ws:
        return 0
    line = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    n = max(1, len(ws) - size + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(size, len(ws)) - 1 :].tolist()
    h64 = xxhash.xxh64_intdigest
    over = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 20_000):
        h = np.array([h64(line[a:b], seed) for a, b in zip(starts[at : at + 20_000], stops[at : at + 20_000], strict=True)], dtype="<u8")
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * over > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            fp = np.array([fingerprint(t, size) for t in texts(b)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return arrow_map(text_column(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- grid


def _spread(groups: tuple[int, ...]) -> list[int]:
    """Bit masks of the axis groups."""
    out, at = [], 0
    for g in groups:
        out.append(((1 << 2 * g) - 1) << at)
        at += 2 * g
    return out


def _popcounts(v: np.ndarray) -> np.ndarray:
    """Bit counts of all 2-bit segments, each in the place of its segment."""
    low = np.uint64(0x5555555555555555)
    return (v & low) + ((v >> np.uint64(1)) & low)


def _cells(fp: np.ndarray, groups: tuple[int, ...], distance: int) -> np.ndarray:
    """Cell numbers of each fingerprint, one column for each choice of groups.

    A cell number is a hash of the choice and of the counts in it; cells that share a
    number are tested together, which costs time but no link.
    """
    counts = _popcounts(fp)
    cols = []
    for k, choice in enumerate(combinations(_spread(groups), len(groups) - distance)):
        x = (counts & np.uint64(sum(choice))) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        cols.append((x ^ (x >> np.uint64(31))).view(np.int64))
    return np.stack(cols, axis=1)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Pairs (i, j) of a and b within the distance: first by the embedding, then by the bits."""
    ca, cb = _popcounts(a), _popcounts(b)
    x, y = ca[:, None], cb[None, :]
    # a count differs by 1 or 2: 01/10 ^ 00, 10 ^ 01 = 11, 10 ^ 00 = 10
    low = np.uint64(0x5555555555555555)
    diff = x ^ y
    one = diff & low
    two = (diff >> np.uint64(1)) & ~diff & low
    maybe = np.argwhere(np.bitwise_count(one) + 2 * np.bitwise_count(two) <= distance)
    exact = np.bitwise_count(a[maybe[:, 0]] ^ b[maybe[:, 1]]) <= distance
    return maybe[exact]


def _links(a: np.ndarray, b: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a, or of those between a and b."""
    other = a if b is None else b
    base = 0 if b is None else len(a)
    label = np.arange(len(a) + (0 if b is None else len(b)))
    out = []
    step = max(1, 1_000_000 // len(other))
    for at in range(0, len(a), step):
        pairs = _near(a[at : at + step], other, distance)
        pairs = pairs[pairs[:, 0] + at != pairs[:, 1]] if b is None else pairs
        if not len(pairs):
            continue
        rows, firsts = np.unique(pairs[:, 0], return_index=True)
        for i, js in zip((rows + at).tolist(), np.split(pairs[:, 1], firsts[1:]), strict=True):
            roots, where = np.unique(label[js + base], return_index=True)
            for r, w in zip(roots.tolist(), where.tolist(), strict=True):
                if r != label[i]:
                    out.append((int(a[i]), int(other[js[w]])))
                    label[label == r] = label[i]
    return out


def _signed(fp: np.ndarray) -> np.ndarray:
    return fp.astype(np.uint64).view(np.int64)


def _edge_batch(edges: list[tuple[int, int]], crowded: list[tuple[int, int]]) -> pa.RecordBatch:
    """Rows (cell, a, b): a link has no cell, a member of a crowded cell no b."""
    links = _signed(np.array(edges, dtype=np.uint64).reshape(-1, 2))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None] * len(edges) + [c for c, _ in crowded], pa.int64()),
            pa.array(links[:, 0].tolist() + [f for _, f in crowded], pa.int64()),
            pa.array(links[:, 1].tolist() + [None] * len(crowded), pa.int64()),
        ],
        names=["cell", "a", "b"],
    )


def near_links(fps: DataFrame, ws: Workspace, distance: int = DISTANCE, groups: tuple[int, ...] = GROUPS, block: int = CELL_BLOCK) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that connect all pairs within the distance."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            fp = b.column(0).to_numpy(zero_copy_only=False)
            cells = _cells(fp.view(np.uint64), groups, distance)
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(fp, cells.shape[1]))], names=["cell", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell; a cell may go on in the next batch."""
        cell, held, full = None, [], False
        edges: list[tuple[int, int]] = []
        crowded: list[tuple[int, int]] = []

        def close() -> None:
            nonlocal held, full
            if held and not full:
                fp = np.concatenate(held)
                if len(fp) > 1:
                    edges.extend(_links(fp.view(np.uint64), None, distance))
            held, full = [], False

        for b in each_batch(batches):
            cells = b.column(0).to_numpy(zero_copy_only=False)
            fp = b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(cells)) + 1
            starts, stops = [0, *cuts.tolist()], [*cuts.tolist(), len(cells)]
            for s, e in zip(starts, stops, strict=True):
                if cells[s] != cell:
                    close()
                    cell = cells[s]
                elif e - s == 1 and not held and not full:
                    continue
                if full:
                    crowded.extend((int(cell), x) for x in fp[s:e].tolist())
                    continue
                held.append(fp[s:e])
                if sum(map(len, held)) > block:
                    crowded.extend((int(cell), x) for h in held for x in h.tolist())
                    held, full = [], True
            if edges or crowded:
                yield _edge_batch(edges, crowded)
                edges.clear()
                crowded.clear()
        close()
        if edges:
            yield _edge_batch(edges, crowded)

    cells = arrow_map(fps.select("fp"), spread, "cell bigint, fp bigint")
    found = ws.write(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(join, "cell bigint, a bigint, b bigint"))
    links = found.filter("cell is null").select("a", "b")
    crowded = found.filter("cell is not null").select("cell", F.col("a").alias("fp"))
    if crowded.isEmpty():
        return links
    return links.unionByName(_crowded_links(crowded, distance, block))


def _crowded_links(crowded: DataFrame, distance: int, block: int) -> DataFrame:
    """Links within crowded cells: each pair of blocks of a cell is one row of work."""
    blocks = crowded.groupBy("cell").agg(F.ceil(F.count("*") / (block // 2)).cast("int").alias("n"))
    dealt = crowded.join(blocks, "cell").withColumn("k", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = dealt.select(
        "cell", "fp", "k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")
    ).select("cell", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "fp")
    work = pairs.groupBy("cell", "i", "j").agg(
        F.collect_list(F.when(F.col("k") == F.col("i"), F.col("fp"))).alias("p"),
        F.collect_list(F.when(F.col("k") != F.col("i"), F.col("fp"))).alias("q"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            out = []
            for i, j, p, q in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                p, q = (np.array(x, dtype=np.int64).view(np.uint64) for x in (p, q))
                out.extend(_links(p, None, distance) if i == j else _links(p, q, distance) if len(p) and len(q) else [])
            if out:
                yield _edge_batch(out, []).select(["a", "b"])

    return work.select("i", "j", "p", "q").mapInArrow(run, "a bigint, b bigint")


def components(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id``: component_id is the smallest doc_id reachable over links."""
    ws = Workspace(docs.sparkSession)
    prints = ws.write(fingerprints(docs, size))
    fps = ws.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(near_links(fps, ws, distance), ws)
    placed = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = ws.write(placed.join(least, "root").select("fp", "component_id"))
    ws.keep_only(prints, labels)
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with the document of smallest id of every component (each row of it, should ids repeat)."""
    kept = components(docs, size, distance).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


# ---------------------------------------------------------------- similar texts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sketch(text: str, size: int, orders: np.ndarray) -> tuple[int, np.ndarray]:
    """SimHash and MinHash lanes (-1: no shingle in the group) of a text of words with one space between."""
    words = text.encode("utf-8", "surrogatepass").split(b" ") if text else []
    lanes = np.full((lines.GROUPS, lines.MINIMA), -1, dtype=np.int64)
    if not words:
        return 0, lanes.ravel()
    w = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - size + 1)
    least = np.full(lanes.shape, np.iinfo(np.uint64).max, dtype=np.uint64)
    over = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        m = min(CHUNK, n - at)
        h = np.zeros(m, dtype=np.uint64)
        for k in range(min(size, len(w))):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[at + k : at + k + m]
        h = _mixed(h)
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        group = (h & np.uint64(lines.GROUPS - 1)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        present, starts = np.unique(group[order], return_index=True)
        least[present] = np.minimum(least[present], np.minimum.reduceat(h[order, None] ^ orders, starts, axis=0))
        # the lowest bits are the group's, and the highest are near 0 in every minimum
        lanes[present] = ((least[present] >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)
    return int.from_bytes(np.packbits(2 * over > n, bitorder="little").tobytes(), "little"), lanes.ravel()


def _sketched(docs: DataFrame, ws: Workspace, size: int) -> DataFrame:
    """``id, k1, k2, doc, occurrences, fp, cells, q`` of every distinct text, as the line operator has them of lines."""
    bands = np.array(lines.bands())
    packed = np.array(lines.packed_lanes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = np.array([m % (1 << 64) for m in lines.masks(lines.MINIMA)], dtype=np.uint64)
        for b in each_batch(batches):
            sketches = [_sketch(t, size, orders) for t in texts(b, "line")]
            fp = np.array([x for x, _ in sketches], dtype=np.uint64).view(np.int64)
            lanes = np.stack([x for _, x in sketches])
            of = lanes[:, bands]
            x = np.broadcast_to(np.arange(1, len(bands) + 1, dtype=np.uint64), of.shape[:2])
            for k in range(of.shape[2]):
                x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + of[:, :, k].astype(np.uint64))
            cells = pa.array(x.view(np.int64).ravel(), mask=(of < 0).all(axis=2).ravel())
            ends = pa.array(np.arange(len(lanes) + 1, dtype=np.int32) * len(bands))
            twos = (np.maximum(lanes[:, packed], 0) & 3).astype(np.uint64) << (2 * np.arange(len(packed), dtype=np.uint64))
            q = np.bitwise_or.reduce(twos, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(3)), pa.array(fp), pa.ListArray.from_arrays(ends, cells), pa.array(q)],
                names=["doc_id", "k1", "k2", "fp", "cells", "q"],
            )

    rows = arrow_map(_normalised(docs).select("doc_id", *lines.keys(), "line"), run, "doc_id bigint, k1 bigint, k2 bigint, fp bigint, cells array<bigint>, q bigint")
    own = [F.first(c).alias(c) for c in ("fp", "cells", "q")]
    distinct = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.count("*").alias("occurrences"), *own)
    return ws.write(distinct.select(F.monotonically_increasing_id().alias("id"), "*"))


def _normalised(docs: DataFrame) -> DataFrame:
    """``doc_id, line``: the lower-cased words with one space between."""
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    line = F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))
    return text_column(docs).select(F.col("doc_id").cast("long").alias("doc_id"), line.alias("line"))


def _word_shingles(size: int) -> lines.Shingles:
    def every(line: str) -> Column:
        at = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))
        return lines.let(F.split(line, " "), lambda w: F.transform(at(w), lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(size)))))

    return every


def _print_pairs(sig: DataFrame, ws: Workspace, distance: int) -> DataFrame:
    """Pairs ``(a, b)`` of ids that connect all texts whose fingerprints are within the distance."""
    reps = ws.write(sig.groupBy("fp").agg(F.min("id").alias("rep")))
    equal = sig.join(reps, "fp").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = near_links(reps, ws, distance)
    for c in "ab":
        links = links.join(reps.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_id")), c)
    return equal.unionByName(links.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")))


def keep_one_similar(docs: DataFrame, similarity: float = SIMILARITY, size: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with the document of smallest id of every group linked by Jaccard similarity of word shingles.

    Texts of equal words are one text, those without words among them.  A text of fewer words
    than a shingle is one shingle.  Rows that share the id of a document that stays, stay.
    """
    ws = Workspace(docs.sparkSession)
    sig = _sketched(docs, ws, size)
    roots = lines.similar_roots(_normalised(docs), sig, ws, similarity, _word_shingles(size), _print_pairs(sig, ws, distance))
    placed = sig.join(roots, F.col("id") == F.col("node"), "left").select(F.coalesce("root", "id").alias("root"), "doc")
    kept = placed.groupBy("root").agg(F.min("doc").alias("_kept")).select("_kept").distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).distinct()
    gone = ws.write(ids.join(kept, F.col("_id").eqNullSafe(F.col("_kept")), "left_anti"))
    ws.keep_only(gone)
    # few documents go, so that their ids can be broadcast and no text is shuffled
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_id"]), "left_anti")


def hex_print(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
