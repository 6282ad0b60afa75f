"""Token counts and packing against the library and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import packing, tokens
from tests.llm.texts import ODD, odd_texts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def table():
    return tokens.PrefixCounts(BYTES)


def _count(lib, text):
    return len(lib.encode(text, add_special_tokens=False).ids)


def test_every_prefix_has_the_library_count(table):
    lib = Tokenizer.from_file(BYTES)
    for text in odd_texts(400, seed=1):
        want = [_count(lib, text[:k]) for k in range(len(text) + 1)]
        assert table.table(text) == want, text
        for budget in (0, 1, 3, 7):
            assert table.longest_within(text, budget) == max(k for k, n in enumerate(want) if n <= budget), (text, budget)


def test_batches_equal_single_texts(table):
    batch = odd_texts(300, seed=2) + ["", " " * 5000, "a" * 3000, "word " * 2000]
    lib = Tokenizer.from_file(BYTES)
    for text, (n, chars) in zip(batch, table.counts(batch, 5), strict=True):
        assert n == _count(lib, text)
        assert chars == (len(text) if n <= 5 else table.longest_within(text, 5))


def test_token_count_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (3, "", "z"), (None, "<|endoftext|>", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(df, BYTES, limit=1).collect())
    assert got == [(0, 13, 1, False), (1, 3, 2, True), (1, 3, 2, True), (2, 0, 0, False), (3, 0, 0, False)]
    assert tokens.token_counts(df.limit(0), BYTES).count() == 0
    full = tokens.token_counts(df, BYTES, with_table=True).filter("doc_id = 1").first()
    assert full["prefix_tokens"] == [0, 1, 2, 2]


def test_word_ids_equal_the_library():
    mine = packing.WordTokens(WORDS)
    for text in odd_texts(400, seed=3) + ["É ß ñ Ñ"]:
        want = np.array(mine.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert mine.encode(text) == want, text


@pytest.mark.parametrize("seed", range(6))
def test_solver_uses_all_pieces_and_keeps_within(seed):
    rng = random.Random(seed)
    capacity = (20, 64, 100, 4096)[seed % 4]
    counts: dict[int, int] = {}
    for _ in range(rng.choice((5, 200, 3000))):
        n = rng.randint(1, capacity)
        counts[n] = counts.get(n, 0) + 1
    plan = packing.solve(counts, capacity)
    used: dict[int, int] = {}
    for times, need in plan:
        assert sum(n * k for n, k in need.items()) <= capacity
        for n, k in need.items():
            used[n] = used.get(n, 0) + k * times
    assert used == counts
    total, bound = sum(t for t, _ in plan), packing.lower_bound(counts, capacity)
    assert bound <= total <= bound * 1.05 + 1


def test_solver_finds_what_best_fit_misses():
    counts = {60: 2, 50: 2, 40: 2, 30: 2, 20: 2}  # 400 tokens: four full sequences
    assert sum(t for t, _ in packing.solve(counts, 100)) == 4
    assert packing.solve({}, 100) == [] and packing.lower_bound({}, 100) == 0


def _fewest(pieces, capacity):
    """The optimum by trying every sequence for every piece."""
    pieces, best = sorted(pieces, reverse=True), len(pieces)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for k, r in enumerate(rooms):
            if r >= pieces[i] and r not in rooms[:k]:
                go(i + 1, [*rooms[:k], r - pieces[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - pieces[i]])

    go(0, [])
    return best


def test_solver_equals_the_optimum_of_small_cases():
    rng = random.Random(4)
    cases = [([30, 29, 28, 17, 16, 14, 8, 5], 50)]
    for _ in range(400):
        capacity = rng.choice((20, 30, 50, 100))
        least = rng.choice((1, capacity // 5))
        cases.append(([rng.randint(least, capacity * rng.choice((1, 2)) // 2) for _ in range(rng.randint(1, 10))], capacity))
    for ps, capacity in cases:
        assert sum(t for t, _ in packing.solve({n: ps.count(n) for n in ps}, capacity)) == _fewest(ps, capacity)


def test_many_short_pieces_fill_a_sequence():
    assert sum(t for t, _ in packing.solve({1: 10_000}, 4096)) == 3
    assert sum(t for t, _ in packing.solve({1: 10_000, 2: 5000, 3: 4000, 2000: 30}, 4096)) == 23


def test_ten_thousand_empty_texts(spark):
    df = spark.range(10_000).selectExpr("id as doc_id", "if(id % 2 = 0, '', null) as text")
    sizes = packing.pack(df, WORDS).groupBy("sequence_id").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in sizes) == [10_000 - 2 * 4096, 4096, 4096]


def test_packed_sequences_are_gapless(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(ODD + ["alpha", "beta"]) for _ in range(rng.choice((0, 3, 40, 400)))), "e") for i in range(120)]
    rows += [(200, None, "e"), (201, "", "e"), (5, "twice", "e"), (5, "twice", "e"), (None, "no id", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(df, WORDS, capacity=64).collect()
    lib = Tokenizer.from_file(WORDS)
    want = []
    for i, t, _ in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want += [(i or -1, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(df.limit(0), WORDS).count() == 0
