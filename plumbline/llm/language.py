"""Operator 1: languages of a document as a mixture, by expectation-maximisation.

Training counts character trigrams of a bounded sample of labelled documents, the same
number for each language, and turns them into conditional letter probabilities.  A document
is then a bag of words, each drawn from one of the languages: EM estimates the shares.  The
language set is the one of least penalised likelihood among nested sets (the largest shares
first), so a few borrowed words don't add a language.  The prediction is the largest share.

Letters of any script take part: the most telling ones have a class each, all others that
were seen share those classes by a hash.

Edge cases: a text that is null or has no letter gets ``und`` and score 0; letters that no
language has seen count the same for all of them, and a text of such letters alone gets the
first language with an even share for a score; ties go to the first language by name;
labels that are null teach nothing; without any label every text is ``und``.  Very long texts
are read in slices, so memory doesn't grow with one text.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, each_batch, text_column, texts

UNDETERMINED = "und"
#: Labelled documents that each language learns from, at most.
TRAINING_DOCUMENTS = 400
#: Bytes of a text that is learned from, at most; longer texts teach nothing.  With the number above it bounds what the driver holds.
TRAINING_BYTES = 65_536
#: Different labels that there may be.
MAX_LANGUAGES = 1000
#: Classes of letters that were seen.
ALPHABET = 62
#: Code points that a slice of the letter arrays may hold.
SLICE = 250_000
#: Words of the documents whose mixtures are estimated together.
WORDS_AT_ONCE = 60_000
EM_ROUNDS = 8
#: Words by which a further language must pay for itself, beyond the criterion's log n / 2.
PENALTY = 6.0

_SIDE = ALPHABET + 2  # 0: boundary, 1: a letter that wasn't seen
_TOP = 0x110000


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # letter class by code point
    logp: np.ndarray  # log probability of a letter after two others, by trigram and language


def _codes(text: str, classes: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return classes[points].astype(np.int32)


def _letter_classes(letters: dict[str, float]) -> np.ndarray:
    """Class by code point.  ``letters``: those seen, with the greatest share that each has in a language."""
    out = np.zeros(_TOP, dtype=np.uint8)
    out[[i for i in range(_TOP) if chr(i).isalpha()]] = 1
    for k, c in enumerate(sorted(letters, key=lambda c: (-letters[c], c))):
        out[ord(c)] = 2 + (k if k < ALPHABET else (ord(c) * 2654435761 >> 13) % ALPHABET)
    return out


def _trigrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all letters and word ends, and where in them each word begins."""
    c = np.concatenate([[0, 0], codes, [0]])
    c0, c1, c2 = c[:-2], c[1:-1], c[2:]
    c0 = np.where(c1 == 0, 0, c0)  # nothing is remembered across a boundary
    part = (c1 > 0) | (c2 > 0)
    tri = (c0 * _SIDE + c1) * _SIDE + c2
    return tri[part], np.flatnonzero((c1 == 0)[part])


def learn(rows: list[tuple[str, str]]) -> Model:
    """``rows``: (text, language)."""
    languages = sorted({lang for _, lang in rows})
    seen = {lang: Counter() for lang in languages}
    for text, lang in rows:
        seen[lang].update(text.lower())
    letters: dict[str, float] = {}
    for found in seen.values():
        found = {c: n for c, n in found.items() if c.isalpha()}
        total = sum(found.values())
        for c, n in found.items():
            letters[c] = max(letters.get(c, 0.0), n / total)
    classes = _letter_classes(letters)
    counts = np.zeros((_SIDE**3, len(languages)))
    for text, lang in rows:
        tri, _ = _trigrams(_codes(text, classes))
        counts[:, languages.index(lang)] += np.bincount(tri, minlength=_SIDE**3)
    c3 = counts.reshape(_SIDE, _SIDE, _SIDE, -1)
    one = c3.sum(axis=(0, 1)) + 0.5
    one /= one.sum(axis=0)
    two = c3.sum(axis=0) + 4 * one[None]
    two /= two.sum(axis=1, keepdims=True)
    three = c3 + 4 * two[None]
    three /= three.sum(axis=2, keepdims=True)
    three[:, :, 1] = three[:, :, 1].min()  # a strange letter tells nothing
    three[:, 1, 0] = three[:, 1, 0].min()  # nor does a word's end after one
    return Model(languages, classes, np.log(three).reshape(_SIDE**3, -1).astype(np.float32))


def word_likelihoods(model: Model, text: str) -> np.ndarray:
    """Log likelihood of every word (a run of letters) of the text, by language."""
    out, at = [], 0
    while at < len(text):
        to = at + SLICE
        while to < len(text) and text[to].isalpha() and to < at + 2 * SLICE:
            to += 1
        tri, starts = _trigrams(_codes(text[at:to], model.classes))
        if len(starts):
            out.append(np.add.reduceat(model.logp[tri], starts, axis=0))
        at = to
    return np.concatenate(out) if out else np.zeros((0, len(model.languages)), dtype=np.float32)


def mixtures(logs: np.ndarray, sizes: np.ndarray, rounds: int = EM_ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Language shares by document.  ``logs``: words of all documents in turn; ``sizes``: words of each, over 0."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    top = logs.max(axis=1, keepdims=True)
    odds = np.exp(logs - top).astype(np.float32)

    def em(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            r = odds * np.repeat(share, sizes, axis=0)
            r /= r.sum(axis=1, keepdims=True)
            share = np.add.reduceat(r, starts, axis=0) / sizes[:, None]
        mix = np.log((odds * np.repeat(share, sizes, axis=0)).sum(axis=1) + 1e-30)
        return share, np.add.reduceat(mix.astype(np.float64), starts)

    n_lang = logs.shape[1]
    full, fit = em(np.full((len(sizes), n_lang), 1 / n_lang, dtype=np.float32), rounds)
    order = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    price = penalty + 0.5 * np.log(sizes)
    best, least = full, -fit + (n_lang - 1) * price
    for k in range(n_lang - 1, 0, -1):
        share = np.where(order < k, full, 0)
        share /= share.sum(axis=1, keepdims=True)
        share, fit = em(share.astype(np.float32), rounds // 2 if k > 1 else 0)
        cost = -fit + (k - 1) * price
        better = cost <= least
        best = np.where(better[:, None], share, best)
        least = np.where(better, cost, least)
    return best


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: the crc32 of their id, as text, is 2 modulo 4."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, per_language: int = TRAINING_DOCUMENTS) -> Model | None:
    """Learns from the labelled documents of least hash, ``per_language`` of each language.

    Ids are chosen from two narrow columns.  A share of the hash's range that holds a few
    times ``per_language`` documents is cut off before they are ranked, so that a common
    language doesn't gather in one task; only the texts chosen come to the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError("too many languages")
    if not sizes:
        return None
    share = lambda n: min(1.0, 3 * per_language / n + 100 / n)
    cut = F.try_element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, share(n))]), F.col("lang"))
    low = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5 <= cut
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").filter(low).withColumn("_k", F.row_number().over(rank)).filter(F.col("_k") <= per_language)
    chosen = [r["doc_id"] for r in ids.select("doc_id").collect()]
    taught = F.col("doc_id").isin(chosen) & (F.octet_length("text") <= TRAINING_BYTES)
    rows = known.filter(taught).select("text", "lang").collect() if chosen else []
    rows = [(r["text"], r["lang"]) for r in sorted(rows)]
    return learn(rows) if any(any(map(str.isalpha, t)) for t, _ in rows) else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``_keep`` (a struct of all columns but the text), ``_text``, ``lang_pred``, ``score``, ``languages`` (their shares)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    df = text_column(docs).select(F.struct(*rest).alias("_keep"), F.col("text").alias("_text"))
    schema = f"_keep {df.schema['_keep'].dataType.simpleString()}, _text string, lang_pred string, score double, languages map<string, double>"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in each_batch(batches):
            ts = texts(b, "_text")
            pred, score, shares = [UNDETERMINED] * len(ts), [0.0] * len(ts), [[] for _ in ts]
            todo: list[tuple[int, np.ndarray]] = []
            held, blind = 0, set()
            for k, t in enumerate(ts):
                if t and model and any(map(str.isalpha, t)):
                    logs = word_likelihoods(model, t)
                    if len(logs):
                        if not np.ptp(logs, axis=1).any():
                            blind.add(k)
                        todo.append((k, logs))
                        held += len(logs)
                if todo and (held > WORDS_AT_ONCE or k == len(ts) - 1):
                    got = mixtures(np.concatenate([x for _, x in todo]), np.array([len(x) for _, x in todo]))
                    for (j, _), share in zip(todo, got, strict=True):
                        best = int(share.argmax())
                        pred[j], score[j] = model.languages[best], 1 / len(share) if j in blind else min(1.0, float(share[best]))
                        shares[j] = [(lang, float(s)) for lang, s in zip(model.languages, share, strict=True) if s > 0]
                    todo, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                names=["_keep", "_text", "lang_pred", "score", "languages"],
            )

    return arrow_map(df, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` of every document."""
    found = predict(docs.select("doc_id", "text"), train(docs))
    doc_id = F.col("_keep.doc_id")
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score", "languages")


def reject(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without those whose language can't be told (no text, no letter); a null ``lang`` becomes the prediction."""
    found = predict(docs, model).filter(F.col("lang_pred") != UNDETERMINED)
    made = {"text": F.col("_text"), "lang": F.coalesce(F.col("_keep.`lang`").cast("string"), "lang_pred")}
    return found.select(*[made.get(c, F.col(f"_keep.`{c}`")).alias(c) for c in docs.columns])
