"""Operator 4: exact token counts at every prefix by dynamic programming.

A text falls into units: the pieces that the tokenizer's pattern cuts, where a run of white
space stays with the piece after it.  No token crosses a unit, and how a unit is tokenized
doesn't depend on the text around it.  Within a piece, byte pair encoding has one valid
encoding for every prefix, and it extends the encoding of a shorter prefix by one token.
So the last token of every prefix follows from those of shorter prefixes: the candidate is
the token that ends there and stays unmerged beside the last token before it.  The counts
of a unit's prefixes are kept in a memo, and the table of a text is their running sum: the
tokens of any prefix, or the longest prefix within a budget, are then look-ups.

Edge cases: a null text counts as empty; an empty text has no tokens; special strings in a
text are one token, as the library's default has it; prefixes end between code points.
Repeated rows give repeated rows; an empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, each_batch, text_column, texts

LIMIT = 512
_MEMO_UNITS = 300_000
#: Units longer than this are counted anew each time.
_MEMO_LENGTH = 200
_MEMO_PAIRS = 500_000

#: The pattern of byte-level vocabularies (fixed value).
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over plain characters, for the standard library's faster matcher.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN_UNIT = re.compile(
    rf"(?:[ \t\n\r]*[\t\n\r])?'(?:s|t|re|ve|m|ll|d)|[ \t\n\r]*(?:[{_L}]+|[0-9]+|[^ \t\n\r{_L}0-9]+)|[ \t\n\r]+"
)
_PLAIN_PIECE = re.compile(rf" ?(?:[{_L}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+)")
_ANY_PIECE = regex.compile(_PIECE)
_CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")
_SPACES = regex.compile(r"\s*")
_loaded: dict = {}


class PrefixCounts:
    """Counts of tokens at every prefix of a text, for a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level vocabulary without normalizer is needed")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in byte.values())}
        of = lambda s: bytes(byte[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = {of(s) for s in spec["model"]["vocab"] if s not in self.special}
        self.longest = max(map(len, self.tokens))
        self.rank = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[of(a), of(b)] = k
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.units: dict[str, bytes] = {}
        self.totals: dict[str, int] = {}
        self._prefix: tuple[bytes, list[bytes], list[int]] = (b"", [b""], [0])

    def _merge(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            k, i = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if k == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stays(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a and b beside each other stay as they are; an empty a: whether b alone does."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > _MEMO_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self._merge(a + b) == ([a, b] if a else [b])
        return got

    def _piece(self, data: bytes) -> list[int]:
        """Token counts of the prefixes of a piece, by bytes; the first is of the empty prefix.

        Entries of the prefix that the piece shares with the one before it are taken over.
        """
        tokens, pairs, longest = self.tokens, self.pairs, self.longest
        before, last, count = self._prefix
        k = 0
        for a, b in zip(data, before, strict=False):
            if a != b:
                break
            k += 1
        last, count = last[: k + 1], count[: k + 1]
        for end in range(k + 1, len(data) + 1):
            for frm in range(end - longest if end > longest else 0, end):
                t = data[frm:end]
                if t in tokens:
                    pair = last[frm], t
                    stays = pairs.get(pair)
                    if self._stays(*pair) if stays is None else stays:
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(t)
            count.append(count[frm] + 1)
        self._prefix = data, last, count
        return count

    def _chars(self, piece: str) -> list[int]:
        """Token counts of the prefixes of a piece, by code points, without the empty one."""
        data = piece.encode()
        counts = self._piece(data)
        if len(data) == len(piece):
            return counts[1:]
        return [n for n, b in zip(counts[1:], [*data[1:], 0], strict=True) if b & 0xC0 != 0x80]

    def _unit(self, unit: str) -> list[int]:
        """Token counts of the prefixes of a unit, by code points, without the empty one."""
        if _PLAIN_PIECE.fullmatch(unit):
            return self._chars(unit)
        body = _strip(unit)
        space = unit[: len(unit) - len(body)]
        out = self._chars(space) if space else []  # white space that ends a text is one piece
        if not body:
            return out
        before = self._chars(space[:-1])[-1] if len(space) > 1 else 0
        if space and space[-1] == " ":
            return out + [before + n for n in self._chars(" " + body)[1:]]
        if space:
            before += self._chars(space[-1])[-1]
        if _CONTRACTION.fullmatch(body):  # its prefixes are other pieces
            return out + [before + sum(self._chars(m)[-1] for m in _ANY_PIECE.findall(body[:k])) for k in range(1, len(body) + 1)]
        return out + [before + n for n in self._chars(body)]

    def _of(self, unit: str) -> list[int]:
        got = self.units.get(unit)
        if got is None:
            got = self._unit(unit)
            if len(unit) <= _MEMO_LENGTH and got[-1] < 256 and max(got) < 256:
                self.units[unit] = got = bytes(got)
        return got

    def split(self, text: str) -> list[str]:
        """Units of a text without special strings."""
        if _PLAIN.fullmatch(text):
            return _PLAIN_UNIT.findall(text)
        units: list[str] = []
        for piece in _ANY_PIECE.findall(text):
            if units and not _strip(units[-1]):
                units[-1] += piece
            else:
                units.append(piece)
        return units

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        if self.cut is None or not any(s in text for s in self.special):
            yield text, False
        else:
            for k, x in enumerate(self.cut.split(text)):
                if x:
                    yield x, bool(k % 2)

    def total(self, text: str) -> int:
        """The last entry of the table."""
        n = 0
        for part, special in self.parts(text):
            if special:
                n += 1
                continue
            units = self.split(part)
            try:
                n += sum(map(self.totals.__getitem__, units))
            except KeyError:
                totals = self.totals
                for u in units:
                    if u in totals:
                        n += totals[u]
                    else:
                        if len(totals) >= _MEMO_UNITS:
                            self.units.clear()
                            totals.clear()
                        k = self._of(u)[-1]
                        n += k
                        if len(u) <= _MEMO_LENGTH:
                            totals[u] = k
        return n

    def counts(self, batch: list[str], budget: int) -> list[tuple[int, int]]:
        """Tokens, and code points of the longest prefix within the budget, of each text.

        The new units of a batch are counted in their order, so that each continues the table
        of the prefix it shares with the one before.
        """
        split = [None if any(s in t for s in self.special) else self.split(t) for t in batch]
        distinct: set[str] = set().union(*(u for u in split if u is not None))
        if len(distinct) > _MEMO_UNITS:
            return [(n, len(t) if (n := self.total(t)) <= budget else self.longest_within(t, budget)) for t in batch]
        totals = self.totals
        new = distinct - totals.keys()
        if len(totals) + len(new) > _MEMO_UNITS:
            self.units.clear()
            totals.clear()
            new = distinct
        for u in sorted(new):
            totals[u] = self._of(u)[-1]
        out = []
        for t, units in zip(batch, split, strict=True):
            n = self.total(t) if units is None else sum(map(totals.__getitem__, units))
            if n <= budget:
                out.append((n, len(t)))
            elif units is None:
                out.append((n, self.longest_within(t, budget)))
            else:
                base = at = 0
                for u in units:
                    k = totals[u]
                    if base + k > budget:
                        break
                    base += k
                    at += len(u)
                inside = [i for i, k in enumerate(self._of(u), 1) if base + k <= budget]
                out.append((n, at + (inside[-1] if inside else 0)))
        for u in new:
            if len(u) > _MEMO_LENGTH:
                del totals[u]
        return out

    def walk(self, text: str) -> Iterator[list[int]]:
        """The table in pieces: token counts at the prefixes of each unit, without the units before it."""
        before = ""
        for part, special in self.parts(text):
            if special:  # its own prefixes are ordinary text after the text before
                base = self.total(before)
                yield [self.total(before + part[:k]) - base for k in range(1, len(part))] + [1]
                before = ""
                continue
            before = part
            yield from map(self._of, _PLAIN_UNIT.findall(part) if _PLAIN.fullmatch(part) else self.split(part))

    def table(self, text: str) -> list[int]:
        """Token counts at every prefix, by code points: entry k is of ``text[:k]``."""
        out, base = [0], 0
        for counts in self.walk(text):
            out.extend(n + base for n in counts)
            base += counts[-1]
        return out

    def _within(self, text: str, budget: int) -> int:
        best = at = base = 0
        for counts in self.walk(text):
            if base > budget:
                break
            if base + counts[-1] <= budget:
                best = at + len(counts)
            else:
                best = max([best, *(at + k + 1 for k, n in enumerate(counts) if n + base <= budget)])
            base += counts[-1]
            at += len(counts)
        return best

    def longest_within(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens, from the table's start.

        Every prefix has its exact count whatever follows, so the table of a start of the text
        will do as long as the answer lies inside it.
        """
        size = 12 * budget + 64
        while size < len(text) and not any(s in text for s in self.special):
            if (best := self._within(text[:size], budget)) < size - 64:
                return best
            size *= 8
        return self._within(text, budget)


def _strip(s: str) -> str:
    return s[_SPACES.match(s).end() :]


def loaded(path: str) -> PrefixCounts:
    if path not in _loaded:
        _loaded[path] = PrefixCounts(path)
    return _loaded[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, with_table: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, chars_within``, and ``prefix_tokens`` if asked for.

    ``chars_within`` is how many code points of the text fit into ``limit`` tokens.
    ``prefix_tokens[k]`` is the count of tokens of the first k code points.
    """
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, chars_within bigint"
    schema += ", prefix_tokens array<bigint>" * with_table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dp = loaded(tokenizer)
        for b in each_batch(batches):
            ts = [t or "" for t in texts(b)]
            counts = dp.counts(ts, limit)
            n = [x for x, _ in counts]
            cols = [
                b.column(0),
                pa.array([len(t.encode()) for t in ts], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_()),
                pa.array([x for _, x in counts], pa.int64()),
            ]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within"]
            if with_table:
                cols.append(pa.array([dp.table(t) for t in ts], pa.list_(pa.int64())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(text_column(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
