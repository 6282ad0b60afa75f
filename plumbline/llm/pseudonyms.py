r"""Operator 6: personal numbers and dates become format-preserving pseudonyms.

Each value found is validated (Luhn digit, octets, number ranges, calendar) and permuted by a
keyed Feistel network inside its own format: a card number stays a valid card number of the
same length and first digit, a date a date, and separators stay in place.  The permutation
depends on the key, the kind and the value alone, so equal values stay linked across
documents, however they are written, and different values stay different.

Everything is Spark expressions: a text is split at its matches, and the matches are
transformed and put back.  Texts in which no pattern can match (no digit, no @, no key id and
no word that introduces a secret) are passed on.  A match keeps the kind whose pattern found
it, so a secret of digits is permuted as a secret.

Kinds: e-mail (letters, in their case, and digits of the local part; the domain stays), phone, card, social security number,
IPv4 address, date, and access keys (hexadecimal secrets, AWS key ids).  Numbers that fail
their validation stay as they are.

Edge cases: a null text stays null, an empty one empty; a very long text is one row's work;
repeated rows give repeated rows; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Words that introduce a secret, in any case (fixed values).
SECRET_WORDS = "(?i:password|passwd|secret|token|api_key|apikey)"
#: Patterns by kind, first match first (fixed values).
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": rf"(?<={SECRET_WORDS} {{0,2}}[=:] {{0,2}}[\x22\x27]?)[0-9a-f]{{12,64}}(?![0-9A-Za-z])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3][0-9][./](?:0[0-9]|1[0-2])[./](?:19|20)[0-9]{2})(?![0-9/-]|\.[0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])\+[0-9]{8,15}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: All of them; the first group is a secret.
PATTERN = "|".join(f"({p})" if kind == "secret" else f"(?:{p})" for kind, p in PATTERNS.items())
#: What a text has if any pattern matches in it.
POSSIBLE = f"[0-9@]|AKIA|{SECRET_WORDS} {{0,2}}[=:]"

#: Dates are permuted among the days from the first to before 2100, that is ``SPAN`` of 270 * 271.  A place
#: beyond is permuted again until it is inside, ``WALK`` times at most: one in 600 is outside, one in 10**22 would stay so.
FIRST_DAY, DAYS, SPAN, WALK = "1900-01-01", (270, 271), 73_049, 7


def _hash(key: str, kind: str, sizes: Column, i: Column, x: Column) -> Column:
    """60 keyed bits of a half; kind and sizes of the halves are part of what is hashed."""
    said = F.concat_ws("|", F.lit(key), F.lit(kind), sizes, i.cast("string"), x.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs (a, b), a < size_a, b < size_b: a struct of both."""

    def turn(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, size_a).otherwise(size_b)
        sizes = F.concat_ws("x", size_a.cast("string"), size_b.cast("string"))
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(_hash(key, kind, sizes, i, s["b"]), size), size).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(radix: int, n: Column) -> Column:
    return F.get(F.array(*[F.lit(radix**k) for k in range(12)]), n.cast("int")).cast("long")


def _number(s: Column, radix: int) -> Column:
    return F.coalesce(F.when(s == "", 0), F.conv(s, radix, 10).cast("long"), F.lit(0))


def _written(n: Column, radix: int, width: Column) -> Column:
    return F.when(width == 0, "").otherwise(F.lpad(F.lower(F.conv(n.cast("string"), 10, radix)), width, "0"))


def permute_text(s: Column, radix: int, key: str, kind: str) -> Column:
    """Permutes strings of digits of a radix (lower case, up to 36) among those of their length, 22 at a time."""

    def part(x: Column) -> Column:
        u = F.floor(F.char_length(x) / 2).cast("int")
        v = (F.char_length(x) - u).cast("int")
        pair = feistel(
            _number(F.substr(x, F.lit(1), u), radix), _number(F.substr(x, u + 1, v), radix), _power(radix, u), _power(radix, v), key, kind
        )
        made = F.transform(F.array(pair), lambda p: F.concat(_written(p["a"], radix, u), _written(p["b"], radix, v)))
        return F.get(made, F.lit(0))

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s).{1,22}"), F.lit(0)), part), "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _put_back(match: Column, old: str, new: Column) -> Column:
    """``match`` with its characters of the class ``old`` replaced in order by those of ``new``."""
    gaps = F.split(match, old, -1)
    return F.array_join(F.zip_with(gaps, F.concat(F.split(new, "(?<=.)(?=.)"), F.array(F.lit(""))), lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of all digits, the last one counted once."""
    n = F.char_length(digits)

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - 1 - i) % 2 == 1, twice).otherwise(d)

    values = F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), value)
    return F.aggregate(values, F.lit(0), lambda s, v: s + v)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.char_length(d)
    body = F.concat(F.substring(d, 1, 1), permute_text(F.substr(d, F.lit(2), n - 2), 10, key, "card"))
    check = F.pmod(10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return F.when(_luhn_sum(d) % 10 == 0, _put_back(m, "[0-9]", F.concat(body, check)))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    keep = F.greatest(F.char_length(d) - 9, F.lit(1)).cast("int")
    return _put_back(m, "[0-9]", F.concat(F.substr(d, F.lit(1), keep), permute_text(F.substr(d, keep + 1), 10, key, "phone")))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 0..897
    pair = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def written(p: Column) -> Column:
        at = F.floor(p["a"] / 99)
        number = F.when(at > 664, at + 2).otherwise(at + 1)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), w, "0") for x, w in ((number, 3), (p["a"] % 99 + 1, 2), (p["b"] + 1, 4))])

    return F.when(valid, F.get(F.transform(F.array(pair), written), F.lit(0)))


def _ipv4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    pair = feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), F.lit(65536), F.lit(65536), key, "ipv4")

    def written(p: Column) -> Column:
        parts = (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)
        return F.concat_ws(".", *[x.cast("string") for x in parts])

    return F.when(F.forall(o, lambda x: x < 256), F.get(F.transform(F.array(pair), written), F.lit(0)))


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    sep = F.substring(m, 3, 1)
    day = F.when(iso, m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).try_cast("date")
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))

    def walk(s: Column, i: Column) -> Column:
        outside = s["a"] * DAYS[1] + s["b"] >= SPAN
        return F.when((i == 0) | outside, feistel(s["a"], s["b"], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")).otherwise(s)

    place = F.struct(F.floor(n / DAYS[1]).cast("long").alias("a"), F.pmod(n, F.lit(DAYS[1])).cast("long").alias("b"))
    pair = F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), place, walk)

    def written(p: Column) -> Column:
        made = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DAYS[1] + p["b"]).cast("int"))
        day_first = F.concat(F.date_format(made, "dd"), sep, F.date_format(made, "MM"), sep, F.date_format(made, "yyyy"))
        return F.when(iso, made.cast("string")).otherwise(day_first)

    inside = day.isNotNull() & (n >= 0) & (n < SPAN)
    return F.when(inside, F.get(F.transform(F.array(pair), written), F.lit(0)))


_LETTERS, _AS_DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def _email(m: Column, key: str) -> Column:
    given, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    local = F.lower(given)
    letters = F.translate(F.regexp_replace(local, "[^a-z]", ""), _LETTERS, _AS_DIGITS)
    new = F.translate(permute_text(letters, 26, key, "email"), _AS_DIGITS, _LETTERS)
    local = F.when(letters != "", _put_back(local, "[a-z]", new)).otherwise(local)
    d = _digits(local)
    local = F.when(d != "", _put_back(local, "[0-9]", permute_text(d, 10, key, "email"))).otherwise(local)
    every = lambda c: F.split(c, "(?<=.)(?=.)")
    cased = F.zip_with(every(given), every(local), lambda old, new: F.when(old.rlike("[A-Z]"), F.upper(new)).otherwise(new))
    return F.concat(F.array_join(cased, ""), F.lit("@"), domain)


def _key_id(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(permute_text(F.lower(F.substring(m, 5, 16)), 36, key, "key")))


def _secret(m: Column, key: str) -> Column:
    return permute_text(m, 16, key, "secret")


_MAKERS = {
    "email": _email, "key": _key_id, "secret": _secret, "date": _date,
    "ipv4": _ipv4, "phone": _phone, "ssn": _ssn, "card": _card,
}


def kind_of(m: Column) -> Column:
    """The kind of a match that isn't a secret, by its whole text."""
    return F.coalesce(*[F.when(m.rlike(rf"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items() if k != "secret"])


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """What stands for a match of a kind; null if it isn't valid."""
    return reduce(lambda c, k: c.when(kind == k, _MAKERS[k](m, key)), _MAKERS, F.when(F.lit(False), m))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_replaced, kinds``: texts with pseudonyms; ``kinds`` are those replaced, in order.

    ``key`` is the caller's secret: who has it can undo the permutations.
    """
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    none = F.array().cast("array<string>")
    matches = lambda group: F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(group))
    found = F.when(F.col("text").rlike(POSSIBLE), matches(0)).otherwise(none)
    secret = F.when(F.col("text").rlike(SECRET_WORDS), matches(1)).otherwise(none)
    df = df.select("doc_id", "text", found.alias("m"), secret.alias("s"))
    kind = lambda m, s: F.when(s != "", "secret").otherwise(kind_of(m))
    kinds = F.zip_with("m", "s", lambda m, s: F.struct(m.alias("old"), kind(m, s).alias("kind")))
    made = F.transform(kinds, lambda x: F.struct(x["old"].alias("old"), x["kind"].alias("kind"), pseudonym(x["old"], x["kind"], key).alias("new")))
    df = df.select("doc_id", "text", F.when(F.size("m") > 0, made).alias("m"))
    gaps = F.split("text", PATTERN, -1)
    again = F.zip_with(gaps, F.col("m"), lambda g, m: F.concat(g, F.coalesce(m["new"], m["old"], F.lit(""))))
    valid = F.filter("m", lambda m: m["new"].isNotNull())
    return df.select(
        "doc_id",
        F.when(F.col("m").isNull(), F.col("text")).otherwise(F.array_join(again, "")).alias("text"),
        F.coalesce(F.size(valid), F.lit(0)).cast("long").alias("n_replaced"),
        F.coalesce(F.transform(valid, lambda m: m["kind"]), none).alias("kinds"),
    )
