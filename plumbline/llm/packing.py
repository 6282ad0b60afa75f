"""Operator 10: packing by best fit, bin completion and a branch and bound of bounded effort.

Documents become token pieces in one Arrow pass.  Which lengths share a sequence depends
only on how many pieces have each length, so the solver sees a histogram of at most
``capacity`` entries, however many documents there are.  Its answer is a list of fillings
with multiplicities, a few for each length at most.  Pieces then find their place by their rank among the pieces of
their length: ranks are counted within salted groups, so one common length does not meet
in one task.

Edge cases: a null or empty text is one piece holding only the end token; repeated rows
are separate documents; an empty table gives an empty result; other columns are ignored.
A null doc_id is kept.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Workspace, arrow_map, each_batch, text_column, texts

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are ranked together.
RANK_GROUP = 16_384
#: Steps after which one completion search takes the best filling found; its first descent is free.
SEARCH_NODES = 4000
#: Times as many steps for the branch and bound over all sequences.
SEARCH_FACTOR = 50

# ---------------------------------------------------------------- tokens

#: Texts of these characters alone are tokenized word by word from a memo; others by the library as a whole.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")
_MEMO_WORDS = 300_000
_loaded: dict = {}


class WordTokens:
    """Token ids of whole texts as little-endian uint32 bytes, equal to the library's ids.

    New words go through the same merges in a rank table, where a NUL stands for the end of a
    word; a text with any other character than plain ones goes to the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = tuple(t["content"] for t in spec["added_tokens"])
        self.memo: dict[str, bytes] = {}
        self.ranks, self.ends = self._rank_table(spec)

    def _rank_table(self, spec: dict):
        """The vocabulary as ranks, or None where ids don't follow the order of the merges."""
        import tiktoken

        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if not suffix or made != sorted(made):
            return None, None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in byte.values())}
        ranks, ends = {}, np.zeros(max(vocab.values()) + 1, dtype=bool)
        for s, i in vocab.items():
            if s not in self.added:
                ends[i] = s.endswith(suffix)
                ranks[bytes(byte[c] for c in (s[: -len(suffix)] if ends[i] else s)) + b"\0" * bool(ends[i])] = i
        return tiktoken.Encoding("words", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={}), ends

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.ranks.encode_ordinary("\0".join(words) + "\0"), dtype="<u4")
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        raw, frm = ids.tobytes(), 0
        for w, to in zip(words, cuts, strict=True):
            self.memo[w] = raw[frm:to]
            frm = to

    def encode(self, text: str) -> bytes:
        if self.ranks is None or not _PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return self._whole(text)
        words = _WORDS.findall(text.lower())
        try:
            return b"".join(map(self.memo.__getitem__, words))
        except KeyError:
            distinct = set(words)
            if len(distinct) > _MEMO_WORDS:
                return self._whole(text)
            new = [w for w in distinct if w not in self.memo]
            if len(self.memo) + len(new) > _MEMO_WORDS:
                self.memo.clear()
                new = list(distinct)
            self._learn(new)
            return b"".join(map(self.memo.__getitem__, words))


def _tokens(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32``."""
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokens(tokenizer)
        for b in each_batch(batches):
            cols: tuple[list, ...] = ([], [], [], [], [])
            ids = b.column(0).to_pylist()
            for doc, raw in zip(ids, (tok.encode(t or "") + end for t in texts(b)), strict=True):
                for k, at in enumerate(range(0, len(raw), width)):
                    part = raw[at : at + width]
                    for col, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return arrow_map(text_column(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


# ---------------------------------------------------------------- solver


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: no packing has fewer sequences."""
    if not counts:
        return 0
    size = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        size[n] = c
    number = np.concatenate([[0], np.cumsum(size)])
    tokens = np.concatenate([[0], np.cumsum(size * np.arange(capacity + 1))])
    half = capacity // 2 + 1
    k = np.arange(half)  # large: over capacity-k; middle: over half; small: k to half
    large = number[capacity + 1] - number[capacity - k + 1]
    middle = number[capacity - k + 1] - number[half]
    spare = middle * capacity - (tokens[capacity - k + 1] - tokens[half])
    more = np.maximum(0, -(-(tokens[half] - tokens[k] - spare) // capacity))
    return max(-(-int(tokens[-1]) // capacity), int((large + middle + more).max()))


Plan = list[tuple[int, dict[int, int]]]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """The packing of best-fit decreasing, with equal sequences held together.

    The fullest sequence that a piece fits into takes pieces of that length until no more
    fit, so sequences of equal content stay equal but for the last one of a length.
    """
    groups: dict[int, list[tuple[int, dict[int, int]]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, need: dict[int, int]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((times, need))

    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c > 0:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                times, need = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, times, need = capacity, -(-c // (capacity // n)), {}
            each = room // n
            full = min(times, c // each)
            if full:
                put(room - each * n, full, need | {n: each})
                c -= full * each
            if full < times and 0 < c:  # fewer are left than one sequence takes
                put(room - c * n, 1, need | {n: c})
                full, c = full + 1, 0
            if full < times:
                put(room, times - full, need)
    return [(t, need) for gs in groups.values() for t, need in gs]


class Budget:
    """Steps that a search may still take."""

    def __init__(self, steps: int):
        self.steps = steps


def fillings(room: int, left: dict[int, int], most: list[int], budget: Budget) -> Iterator[tuple[int, dict[int, int]]]:
    """``waste, {length: pieces}`` of the fillings of ``room`` that waste at most ``most[0]``, larger pieces first.

    Depth-first with a stack of its own; all pieces of a length that fit are taken at once
    and given back one by one.  A branch ends when the tokens of the shorter pieces can't
    bring the waste down to ``most[0]``, which the caller may lower meanwhile.  The first
    descent is free, so there is a filling whatever the budget, if its waste is allowed.
    """
    lengths = sorted(n for n, c in left.items() if c > 0)
    have = [left[n] for n in lengths]
    below = [0, *accumulate(n * c for n, c in zip(lengths, have, strict=True))]
    stack: list[list[int]] = []  # index of a length, pieces of it
    at, first = len(lengths), True
    while True:
        at = min(at, bisect_right(lengths, room))
        budget.steps -= not first
        if at and room - below[at] <= most[0]:
            at -= 1
            k = min(have[at], room // lengths[at])
            stack.append([at, k])
            room -= k * lengths[at]
            continue
        if not at and room <= most[0]:
            yield room, {lengths[i]: k for i, k in stack}
        first = False
        if not stack or budget.steps <= 0:
            return
        at, k = stack[-1]
        room += lengths[at]
        if k == 1:
            stack.pop()
        else:
            stack[-1][1] -= 1


def complete(room: int, left: dict[int, int], steps: int) -> dict[int, int]:
    """The filling of least waste that the steps find; the first descent takes the largest piece that fits each time."""
    most, best = [room], {}
    for waste, fill in fillings(room, left, most, Budget(steps)):
        best, most[0] = fill, waste - 1
        if waste == 0:
            break
    return best


def dominated(waste: int, fill: dict[int, int], left: dict[int, int], lengths: list[int]) -> bool:
    """Whether a piece that is left over could take the place of nothing, one or two pieces of the filling.

    It must fit and leave no more room than before; whatever packing holds the filling can
    swap them for it, so the filling needn't be tried.
    """
    free = lambda n: left[n] > fill.get(n, 0)
    own = sorted(fill)
    sums = {0} | {a + b for i, a in enumerate(own) for b in own[i:] if a != b or fill[a] > 1}
    for s, frm in [(s, s) for s in sums] + [(a, a + 1) for a in own]:
        for n in lengths[bisect_left(lengths, max(frm, 1)) : bisect_right(lengths, s + waste)]:
            if free(n):
                return True
    return False


def _moves(left: dict[int, int], capacity: int, most: list[int], budget: Budget) -> Iterator[tuple[int, int, dict[int, int]]]:
    """``waste, times, need``: undominated completions of the largest piece left, each taken as often as it can be, then less often."""
    left = {n: c for n, c in left.items() if c > 0}
    top = max(left)
    left[top] -= 1
    lengths = sorted(left)
    for waste, fill in fillings(capacity - top, left, most, budget):
        if dominated(waste, fill, left, lengths):
            continue
        need = fill | {top: fill.get(top, 0) + 1}
        for times in range(min((left[n] + (n == top)) // k for n, k in need.items()), 0, -1):
            if waste * times <= most[0]:
                yield waste, times, need


def branch(counts: dict[int, int], capacity: int, plan: Plan, bound: int, budget: Budget) -> Plan:
    """The best packing that backtracking over completions finds within the budget, ``plan`` if none is better.

    A branch ends when its waste exceeds what a better packing may waste, when the bound of
    what is left says so, or when the same pieces were left before after as few sequences.
    """
    fewest, total = sum(t for t, _ in plan), sum(n * c for n, c in counts.items())
    left = {n: c for n, c in counts.items() if c > 0}
    taken: Plan = []
    closed, waste = 0, 0
    most = [(fewest - 1) * capacity - total]
    seen: dict[tuple, int] = {}
    stack = [_moves(left, capacity, most, budget)] if left and most[0] >= 0 else []
    while stack and fewest > bound and budget.steps > 0:
        move = next(stack[-1], None)
        if move is None:
            stack.pop()
            if taken:
                times, need = taken.pop()
                for n, k in need.items():
                    left[n] += k * times
                closed -= times
                waste -= times * (capacity - sum(n * k for n, k in need.items()))
                most[0] = (fewest - 1) * capacity - total - waste
            continue
        lost, times, need = move
        if lost * times > most[0]:
            continue
        for n, k in need.items():
            left[n] -= k * times
        taken.append((times, need))
        closed, waste = closed + times, waste + lost * times
        budget.steps -= 1 + len(left) // 16
        rest = {n: c for n, c in left.items() if c}
        if not rest and closed < fewest:
            plan, fewest = list(taken), closed
        most[0] = (fewest - 1) * capacity - total - waste
        state = tuple(sorted(rest.items()))
        if rest and most[0] >= 0 and seen.get(state, fewest) > closed and closed + lower_bound(rest, capacity) < fewest:
            seen[state] = closed
            stack.append(_moves(rest, capacity, most, budget))
        else:
            stack.append(iter(()))
    return plan


def _completed(counts: dict[int, int], capacity: int, steps: int) -> Plan:
    """The largest piece left is completed with least waste, the filling taken as often as the counts allow."""
    left = {n: c for n, c in counts.items() if c > 0}
    plan: Plan = []
    while left:
        top = max(left)
        left[top] -= 1
        need = complete(capacity - top, left, steps)
        left[top] += 1
        need[top] = need.get(top, 0) + 1
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append((times, need))
    return plan


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> Plan:
    """Fillings with multiplicities, ``[(times, {length: pieces})]``, that use up ``counts``.

    The incumbent is best-fit decreasing, or least-waste completion where that is better.  If
    it exceeds the bound, branch and bound looks for fewer sequences.  The result is optimal
    when it meets the bound or the search ends by itself; the problem is NP-hard, so the
    search has a budget, after which the incumbent is returned.
    """
    bound = lower_bound(counts, capacity)
    plan = best_fit_decreasing(counts, capacity)
    size = lambda p: sum(t for t, _ in p)
    if size(plan) > bound:
        plan = min(plan, _completed(counts, capacity, nodes), key=size)
    if size(plan) > bound:
        plan = branch(counts, capacity, plan, bound, Budget(nodes * SEARCH_FACTOR))
    return plan


# ---------------------------------------------------------------- places


def _slots(plan: list[tuple[int, dict[int, int]]], capacity: int) -> tuple[np.ndarray, ...]:
    """Where the pieces of each length go, sorted by length and rank: key, rank, pieces per sequence, sequence, offset."""
    rows, taken, sequence = [], {}, 0
    for times, need in plan:
        offset = 0
        for n, k in sorted(need.items(), reverse=True):
            frm = taken.get(n, 0)
            rows.append((n, frm, k, sequence, offset))
            taken[n] = frm + k * times
            offset += n * k
        sequence += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def place(df: DataFrame, ws: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces."""
    df = ws.write(df)
    counts = {int(r["length"]): int(r["n"]) for r in df.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(solve(counts, capacity), capacity)
    salts = max(1, -(-sum(counts.values()) // RANK_GROUP))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    group = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    sizes = dealt.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = (
        dealt.withColumn("_rank", F.row_number().over(group) - 1)
        .join(base, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_base"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, frm, per, first, offset = slots
        step = (1 << 62) // (capacity + 1)
        key = length * step + frm
        for b in each_batch(batches):
            n = b.column(3).to_numpy(zero_copy_only=False)
            r = b.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, n * step + r, side="right") - 1
            k = r - frm[at]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(first[at] + k // per[at]), pa.array(offset[at] + (k % per[at]) * n)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, PIECES + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs ``docs(doc_id, text)``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return place(pieces(docs, tokenizer, capacity, end_id), Workspace(docs.sparkSession), capacity)
