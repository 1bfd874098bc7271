"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters a token may have beside a-z, 0-9 and the hyphen.
TOKEN_BREAK = "[^a-z0-9à-ÿ-]+"
#: The apostrophes that are read as a straight one.
APOSTROPHES = "’‘ʼ"
CITATION_APOSTROPHES = "’‘ʼ＇"
#: Elided forms that are dropped before a word.
ELISION = r"(?<![\p{L}\p{N}_])(?:jusqu|lorsqu|puisqu|quoiqu|presqu|aujourd|qu|[ldjmnstc])'"
LETTERED = r"(?<![\p{L}\p{N}_])([lrd])\.?\s*(\d{1,4}(?:-\d+)+)(?![\p{L}\p{N}_])"
#: Accented Latin letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: The levels of a path, outermost first.
LEVELS = ("livre", "titre", "chapitre", "section", "sous-section")


def straight(text: Column) -> Column:
    """Typographic apostrophes as straight ones."""
    return F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))


def tokens(text: Column) -> Column:
    """Tokens of a lower-cased text, in order."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: (t != "") & (t != "-"))


def without_elision(text: Column) -> Column:
    return F.regexp_replace(straight(F.lower(text)), ELISION, "")


def fold(text: Column) -> Column:
    """Accents dropped from lower-case Latin letters."""
    return F.translate(text, ACCENTED, PLAIN)


def glued_references(text: Column) -> Column:
    """``l. 313-7`` as one token ``l313-7``."""
    return F.regexp_replace(text, LETTERED, "$1$2")


def citation_key(text: Column) -> Column:
    """What extracts are compared by: apostrophes, white space and case made alike."""
    plain = F.translate(text, CITATION_APOSTROPHES, "'" * len(CITATION_APOSTROPHES))
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def path(*levels: Column | str) -> Column:
    """Levels that are there, joined."""
    return F.concat_ws(" > ", *levels)


def roman(text: Column) -> Column:
    """The value of a roman number of I, V, X, L and C; null where another letter occurs."""
    value = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100)
    digits = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), value)
    after = F.concat(F.slice(digits, 2, F.size(digits)), F.array(F.lit(0)))
    signed = F.zip_with(digits, after, lambda v, n: F.when(v < n, -v).otherwise(v))
    return F.aggregate(signed, F.lit(0), lambda a, v: a + v)


def windows(words: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that overlap by ``overlap``."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap, F.lit(1)) - 1, F.lit(size - overlap))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))
