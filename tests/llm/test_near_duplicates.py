"""SimHash, fuzzy lines and components against brute force; the pipeline's stages."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import graph, lines, simhash
from plumbline.llm.common import SHUFFLE_CLEANUP, SHUFFLE_PARTITIONS, Workspace
from tests.conftest import DATA


def _roots(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "cliques"])
def test_components(spark, shape):
    rng = random.Random(1)
    n = 120
    links = {
        "chain": [(i, i + 1) for i in range(n - 1)],
        "star": [(0, i) for i in range(1, n)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(70)],
        "cliques": [(a + 10 * k, b + 10 * k) for k in range(12) for a, b in itertools.combinations(range(9), 2)],
    }[shape]
    names = rng.sample(range(-(10**12), 10**12), n)
    names.sort()
    df = spark.createDataFrame([(names[b], names[a]) for a, b in links] + [(names[0], names[0]), (None, names[1])], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.connected_components(df, Workspace(spark)).collect()}
    roots = _roots(n, links)
    inside = {x for a, b in links if a != b for x in (a, b)}
    assert got == {names[i]: names[roots[i]] for i in inside}
    assert graph.connected_components(df.limit(0), Workspace(spark)).count() == 0


def _print(text):
    ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(300)]
    texts = [None, "", " \n", "A", "a", "one TWO", "x y z"]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append("\n".join(base))
    ids = rng.sample(range(1000), len(texts))
    df = spark.createDataFrame([(i, t, "e") for i, t in zip(ids, texts, strict=True)] + [(ids[9], texts[9], "e")], "doc_id long, text string, fp string")
    order = sorted(range(len(texts)), key=lambda k: ids[k])
    fps = [_print(texts[k]) for k in order]
    links = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    roots = _roots(len(fps), links)
    want = {ids[k]: (f"{fps[i]:016x}", ids[order[roots[i]]]) for i, k in enumerate(order)}
    got = simhash.components(df).select("doc_id", simhash.hex_print("fp").alias("h"), "component_id").collect()
    assert len(got) == len(texts) + 1 and {r["doc_id"]: (r["h"], r["component_id"]) for r in got} == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(set(r["doc_id"] for r in kept.collect())) == sorted({c for _, c in want.values()})
    assert simhash.components(df.limit(0)).count() == 0


def _five(text):
    ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _edit(words, rng, vocabulary, n):
    words = list(words)
    for _ in range(n):
        k, kind = rng.randrange(len(words)), rng.randrange(3)
        words[k : k + (kind < 2)] = [rng.choice(vocabulary)] if kind else []
    return words


def _kept_ids(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, id long, line string")
    kept = simhash.keep_one_similar(df)
    assert kept.columns == df.columns
    return sorted(r["doc_id"] for r in kept.collect())


def test_similar_documents_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(500)]
    rows, pairs, alike = [], 0, set()
    while pairs < 150:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 400))]
        other = _edit(base, rng, vocabulary, max(1, len(base) // rng.randint(35, 60)))
        j = _jaccard(_five(" ".join(base)), _five(" ".join(other)))
        if 0.8 <= j <= 0.9 or (j < 0.8 and rng.random() < 0.2):
            pairs += j >= 0.8
            alike |= {2 * len(rows) + 1} if j >= 0.8 else set()
            rows.append((" ".join(base), "\n ".join(other).upper()))
    table = [(2 * k + e, t, "f", 0, "l") for k, pair in enumerate(rows) for e, t in enumerate(pair)]
    gone = set(range(len(table))) - set(_kept_ids(spark, table))
    assert gone <= alike and len(gone) >= 0.95 * len(alike) and len(alike) < len(rows)


def test_similar_documents_in_a_crowd(spark):
    """Near copies of one text, of which many are only linked through others, and texts that share half of it."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(500)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = [" ".join(_edit(base, rng, vocabulary, rng.randint(0, 6))) for _ in range(120)]
    texts += [" ".join(base[:75] + [rng.choice(vocabulary) for _ in range(75)]) for _ in range(30)]
    sets = [_five(t) for t in texts]
    roots = _roots(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if _jaccard(sets[a], sets[b]) >= 0.8])
    want = sorted({*roots})
    got = _kept_ids(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])
    assert set(want) <= set(got) and len(got) <= len(want) + 2


def test_similar_documents_edge_cases(spark):
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(45_000))
    texts = [None, "", " \n\t", "one TWO", "ONE\ntwo ", "one two three", long, long + " end", "漢字 かな", "漢字  かな", "A b c d e", "a B c d e f"]
    rows = [(k + 1, t, "f", 1, "l") for k, t in enumerate(texts)]
    # rows without an id, or with one that repeats, stay where any document of that id does
    rows += [(None, "one two", "f", 1, "l"), (None, "nothing else like it", "f", 1, "l"), (4, "quite another text", "f", 1, "l")]
    kept = simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string, fp string, id long, line string"))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 4, 4, 6, 7, 9, 11, 12]
    empty = spark.createDataFrame([], "doc_id long, text string, fp string, id long, line string")
    assert simhash.keep_one_similar(empty).count() == 0
    assert simhash.keep_one_similar(spark.createDataFrame([(1, None), (2, None)], "doc_id long, text void")).count() == 1


def test_crowded_cells_lose_no_link(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 150:
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(30)}
    signed = [int(np.array([x], dtype=np.uint64).view(np.int64)[0]) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.near_links(df, Workspace(spark), block=8)
    got = {r["node"]: r["root"] for r in graph.connected_components(links, Workspace(spark)).collect()}
    signed.sort()
    near = [(a, b) for a, b in itertools.combinations(range(len(signed)), 2) if ((signed[a] ^ signed[b]) & (2**64 - 1)).bit_count() <= 3]
    roots = _roots(len(signed), near)
    inside = {x for p in near for x in p}
    assert got == {signed[i]: signed[roots[i]] for i in inside}


def _shingles(line):
    return {line.lower()[i : i + 5] for i in range(len(line) - 4)}


def test_fuzzy_lines_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    ls = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60))) for _ in range(60)]
    for base in ls[:40]:
        for _ in range(2):
            w = base.split()
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            ls.append(" ".join(w))
    sets = [_shingles(x) for x in ls]
    near = [(a, b) for a, b in itertools.combinations(range(len(ls)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = _roots(len(ls), near)
    docs = spark.createDataFrame([(i, f"{x}\nshort\n{x}", "e") for i, x in enumerate(ls)], "doc_id long, text string, line string")
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    want = {i for i, r in enumerate(roots) if r == i}
    kept = {i for i, r in got.items() if r["n_removed"] < 2}
    assert want <= kept and len(kept - want) <= 0.02 * len(ls)  # nothing clean goes; banding finds nearly all
    assert all(r["text"] == (f"{ls[i]}\nshort" if i in kept else "short") for i, r in got.items())


def _banded(spark, pairs):
    """How many pairs of lines lose one to the other, each pair being judged by itself."""
    rows = [(2 * i + k, line) for i, p in enumerate(pairs) for k, line in enumerate(p)]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return sum(got[2 * i + 1] for i in range(len(pairs)))


def test_recall_on_short_lines(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    pairs = []
    while len(pairs) < 1000:
        ws = [word() for _ in range(rng.randint(4, 16))]
        other, k = list(ws), rng.randrange(len(ws))
        edit = len(pairs) % 3
        if edit == 0:
            at = rng.randrange(len(ws[k]))
            other[k] = ws[k][:at] + rng.choice("0123456789") + ws[k][at + 1 :]
        elif edit == 1:
            other.insert(k, word()[:3])
        else:
            del other[k]
        a, b = " ".join(ws), " ".join(other)
        x, y = _shingles(a), _shingles(b)
        if min(len(a), len(b)) >= 20 and len(x & y) >= 0.8 * len(x | y):
            pairs.append((a, b))
    assert _banded(spark, pairs) >= 990


def test_case_and_lines_without_spaces(spark):
    rng = random.Random(9)
    some = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    prose = [" ".join(some("abcdefgh", 5) for _ in range(8)) for _ in range(60)]
    pairs = [(x, x.upper() if k % 2 else x.title()) for k, x in enumerate(prose)]
    for n in (60, 125, 130, 300, 500, 520, 3000):
        for _ in range(10):
            x = some([chr(0x4E00 + k) for k in range(3000)], n)
            pairs.append((x, "字" + x[1:]))
            x = some("abcdefghijklmnop/%", n)
            pairs.append((x, f"#{x[1:]}\t"))
    assert _banded(spark, pairs) == len(pairs)


def _edited(line, kind, rng, share):
    other = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    if kind in ("characters", "unspaced"):
        return "".join(rng.choice("0123456789") if rng.random() < share / 5 else x for x in line)
    if kind == "words":
        return " ".join(other() if rng.random() < share else w for w in line.split())
    return " ".join(y for w in line.split() for y in ([w, other()] if rng.random() < share else [w]))


@pytest.mark.parametrize("kind", ["characters", "words", "inserted", "unspaced"])
def test_recall_just_above_the_threshold(spark, kind):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    pairs = []
    while len(pairs) < 250:
        a = ("" if kind == "unspaced" else " ").join(word() for _ in range(rng.randint(6, 80)))
        b = _edited(a, kind, rng, rng.uniform(0.03, 0.2))
        x, y = _shingles(a), _shingles(b)
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            pairs.append((a, b))
    assert _banded(spark, pairs) >= 238


def _crowd(rng, n):
    """Lines that share a passage, many of them just under or over the threshold to one another."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passage, vocabulary = [word() for _ in range(40)], [word() for _ in range(60)]
    out = set()
    while len(out) < n:
        w = [x for x in passage if rng.random() > rng.choice((0, 0.02, 0.1))]
        at = rng.randrange(len(w))
        out.add(" ".join(w[:at] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))] + w[at:]))
    return sorted(out)


def test_shingles_and_parities_equal_plain_ones(spark):
    rng = random.Random(8)
    texts = ["abcde", "x" * 30, "\u0130stanbul \U0001f600 stra\u00dfe \u4e2d\u6587\u5b57 ABC", "".join(rng.choices("ab c\u00e9\U00010400", k=300))]
    every = spark.createDataFrame(list(enumerate(texts)), "id long, line string").select("id", F.lower("line").alias("low"), lines._every("line").alias("h"))
    for r in every.collect():
        plain = [xxhash.xxh64_intdigest(r["low"][i : i + 5].encode("utf-32-be"), seed=42) for i in range(len(r["low"]) - 4)]
        assert [h % (1 << 64) for h in r["h"]] == plain
    sets = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (0, 1, 7, 400)]
    looks = lines._parities(F.concat("h", F.array(F.lit(7).cast("long"))))
    for r in spark.createDataFrame(list(enumerate(sets)), "id long, h array<long>").select("h", looks.alias("bits")).collect():
        words = [0] * lines.WORDS
        for h in [*r["h"], 7]:
            words[h // 64 % lines.WORDS] ^= 1 << h % 64
        assert [w % (1 << 64) for w in r["bits"]] == words
    # the hashes are made once, and a shingle's place takes no arithmetic
    assert str(looks).startswith("Column<'get(transform(array(concat(") and "*(" not in str(lines._every("line"))


def test_what_remains_of_a_crowded_cell_loses_no_pair(spark):
    ls = _crowd(random.Random(12), 160)
    sets = [_shingles(x) for x in ls]
    near = [(a, b) for a, b in itertools.combinations(range(len(ls)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    ws = Workspace(spark)
    texts = spark.createDataFrame([(i, x, len(sets[i])) for i, x in enumerate(ls)], "id long, line string, n int")
    crowd = spark.createDataFrame([(k % 2, i) for i in range(len(ls)) for k in range(2 - (i % 5 == 0))], "cell long, id long")
    both = {i for i in range(len(ls)) if i % 5}
    for linked in ([p for k, p in enumerate(near) if k % 7 == 0], [p for p in near if 3 in p], []):
        roots = _roots(len(ls), linked)
        inside = {x for p in linked for x in p}
        got_roots = spark.createDataFrame([(i, roots[i]) for i in inside], "node long, root long")
        to_hub, pairs = lines._remaining(crowd, spark.createDataFrame(linked, "a long, b long"), got_roots, texts, ws, 0.8)
        hubs, found = ({(r["a"], r["b"]) for r in d.collect()} for d in (to_hub, pairs))
        assert hubs <= set(near)
        after = _roots(len(ls), linked + sorted(hubs))
        left = {(a, b) for a, b in near if after[a] != after[b] and (a in both and b in both or a % 5 == b % 5 == 0 or a in both or b in both)}
        assert left <= found
        apart = sum(1 for a, b in itertools.combinations(range(len(ls)), 2) if after[a] != after[b])
        assert len(found - set(near)) < 0.5 * apart


def test_crowds_against_brute_force(spark):
    rng = random.Random(13)
    ls = _crowd(rng, 220) + _crowd(rng, 60)
    sets = [_shingles(x) for x in ls]
    near = [(a, b) for a, b in itertools.combinations(range(len(ls)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {i for i, r in enumerate(_roots(len(ls), near)) if r == i}
    docs = spark.createDataFrame(list(enumerate(ls)), "doc_id long, text string")
    kept = {r["doc_id"] for r in lines.dedup_lines(docs).collect() if not r["n_removed"]}
    assert want <= kept and len(kept - want) <= 0.02 * len(ls)


def test_ids_in_sequence_are_filtered_and_small_shuffles_have_few_partitions(spark):
    names = [(part << 33) + k for part in range(8) for k in range(500)]
    rows = spark.createDataFrame([(x, 2 if k % 100 == 0 else 1) for k, x in enumerate(names)], "id long, n long")
    wanted = set(names[3:500:7])
    ids = spark.createDataFrame([(x,) for x in wanted], "id long")
    through = lambda *more: {r["id"] for r in lines._filtered(rows, "id", ids, F.xxhash64, *more).collect()}
    # low bits of the ids are alike in every part, so that they alone would let 8 times as many through
    assert wanted <= through() and len(through() - wanted) < 0.1 * len(names)
    assert through() | set(names[::100]) == through(F.col("n") > 1)
    ws, before = Workspace(spark), spark.conf.get(SHUFFLE_PARTITIONS)
    inside = {}
    for n in (0, 99, 100, 250, 10**9):
        with ws.dealt(n, 100):
            inside[n] = spark.conf.get(SHUFFLE_PARTITIONS)
    assert list(inside.values()) == ["1", "1", "2", "3", before] and spark.conf.get(SHUFFLE_PARTITIONS) == before
    spark.conf.set(SHUFFLE_PARTITIONS, "200")
    try:
        with ws.sorted_shuffles():
            assert spark.conf.get(SHUFFLE_PARTITIONS) == "201"
        assert spark.conf.get(SHUFFLE_PARTITIONS) == "200"
    finally:
        spark.conf.set(SHUFFLE_PARTITIONS, before)


def test_line_edge_cases(spark):
    long = "this line is long enough to count as one"
    rows = [(5, None, "e"), (6, "", "e"), (1, f"{long}\n\nshort", "a"), (2, f"short\n{long}", "b"), (3, long, "c"), (3, long, "c"), (None, long, "d"), (7, " \n ", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _drop string")
    got = sorted(((r["doc_id"] or 0), r["text"], r["n_removed"]) for r in lines.dedup_lines(df).collect() if r["text"] is not None)
    assert got == [(0, long, 0), (1, f"{long}\n\nshort", 0), (2, "short", 1), (3, "", 1), (3, "", 1), (6, "", 0), (7, " \n ", 0)]
    kept = lines.without_duplicate_lines(df)
    assert kept.columns == df.columns and kept.filter("doc_id = 5").first()["_drop"] == "e"
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 5, 6, 7]
    assert lines.dedup_lines(df.limit(0)).count() == 0
    plan = lines.dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    ws = Workspace(spark)
    names, seen = [n for n, _ in corpus_pipeline.STAGES], [docs]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pack"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], str(DATA))
        assert out.columns == columns
        seen.append(ws.write(out))
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True)
    # near-duplicates: of brute-force groups of what came in, the smallest id stays
    came = sorted((r["doc_id"], _five(r["text"])) for r in seen[2].collect())
    links = [(a, b) for a, b in itertools.combinations(range(len(came)), 2) if _jaccard(came[a][1], came[b][1]) >= 0.8]
    roots = _roots(len(came), links)
    assert sorted(r["doc_id"] for r in seen[3].select("doc_id").collect()) == [came[i][0] for i, r in enumerate(roots) if i == r]
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], str(DATA))
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert corpus_pipeline.run(spark, str(DATA)).count() == packed.count()


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getName() for k in range(found.size())}


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    ws, before, setting = Workspace(spark), _shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    df = ws.write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    left = {f for f in _shuffle_files(spark) - before if f.startswith("shuffle_")}
    assert df.count() == 7 and not left and spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_few_links_come_in_one_file(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = graph.connected_components(spark.createDataFrame([(k, k + 1) for k in range(0, 90, 3)], "a long, b long"), Workspace(spark))
        assert len(got.inputFiles()) == 1 and {(r["node"], r["root"]) for r in got.collect()} == {(k + j, k) for k in range(0, 90, 3) for j in (0, 1)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_few_near_duplicates_go_without_a_shuffle_of_texts(spark):
    rows = [(k, " ".join(str((k * 7919 + j * j) % 100_003) for j in range(12))) for k in range(3000)]
    rows += [(3000, rows[5][1]), (None, rows[5][1]), (None, "w"), (7, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        out = simhash.keep_one_similar(docs)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        got = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted([*range(3000), 7])
    assert out.filter("doc_id is null").count() == 2
