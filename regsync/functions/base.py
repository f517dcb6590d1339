"""Building blocks for column functions."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: White space of any kind, and what else parts an address at its end.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SEPARATORS = _BLANK + ",/|-"
_LITERALS: dict[tuple, Column] = {}


def built_once(f):
    """``f()`` makes columns that only name other columns; they are made once for a Spark context, as making them takes thousands of calls to the JVM."""
    made = {}

    @functools.wraps(f)
    def call():
        key = id(SparkContext._active_spark_context)
        if key not in made:
            made[key] = f()
        return made[key]

    return call


def lit(value: str) -> Column:
    """A literal text, made once for a Spark context: expressions here hold hundreds, and each costs some calls to the JVM."""
    key = (id(SparkContext._active_spark_context), value)
    if key not in _LITERALS:
        _LITERALS[key] = F.lit(value)
    return _LITERALS[key]


def sub(text: Column, pattern: str, new: str = "") -> Column:
    return F.regexp_replace(text, lit(pattern), lit(new))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, lit(_BLANK))


def strip_marks(text: Column) -> Column:
    return F.btrim(text, lit(".,;- "))


def rstrip_separators(text: Column) -> Column:
    return F.ltrim(F.rtrim(text, lit(_SEPARATORS)), lit(_BLANK))


def filled(text: Column) -> Column:
    """The text; null for an empty one."""
    return F.nullif(text.cast("string"), lit(""))


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else ''."""
    return F.coalesce(*[filled(t) for t in texts], lit(""))


def words(text: Column) -> Column:
    """The text's words, parted by white space of any kind."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _accents() -> tuple[str, str]:
    """Latin characters whose compatibility decomposition without marks is one of a-z, 0-9 or space, and their replacements."""
    old, new = [], []
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x20A0)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii() and plain != chr(code) and (plain == " " or plain.isalnum() and plain == plain.lower()):
            old.append(chr(code))
            new.append(plain)
    return "".join(old), "".join(new)


_OLD, _NEW = _accents()


def fold(text: Column) -> Column:
    """Lower case, stripped, without accents; all but a-z, 0-9 and white space become a space.  Null: ''.

    Inner and trailing spaces that replace punctuation stay.  Ligatures and letters outside the Latin blocks become
    spaces here; ``fold_exact`` decomposes them.
    """
    out = strip(F.lower(F.coalesce(text.cast("string"), lit(""))))
    out = sub(F.translate(out, _OLD, _NEW), r"\p{M}")
    return sub(out, r"(?U)[^a-z0-9\s]", " ")


def fold_exact(text: Column) -> Column:
    """``fold`` for all of Unicode, by Arrow batches in Python: for decompositions beyond the blocks that ``fold`` knows."""

    def one(t):
        plain = unicodedata.normalize("NFKD", (t or "").lower().strip())
        return re.sub(r"[^a-z0-9\s]", " ", "".join(c for c in plain if not unicodedata.combining(c)))

    return F.pandas_udf(lambda s: s.map(one), "string")(text)
