"""Folding of text to comparable words. Rows in Latin script stay in the JVM; others go through one Arrow function.

Spark has no NFKC or NFKD. Characters that fold to one ASCII character, whatever stands beside them, are translated; only
rows with others need Python. Two folds are kept apart:
``fold`` joins dotted initials and spells out ``&``; ``fold_marks`` deletes apostrophes and all marks first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ASCII = r"^[\x00-\x7F]*$"
_INITIALS = r"(?<!\w)(?:[^\W\d_]\.){2,}"
_INITIALS_RE = re.compile(_INITIALS + r"(?:[^\W\d_](?!\w))?")
#: Letters without a decomposition; fixed values.
PLAIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i"}


def fold_text(text: str | None) -> str:
    """Compatibility form, ``&`` as a word, lower case, no accents, initials joined, words parted by one space."""
    if not text:
        return ""
    text = re.sub(r"\s*&\s*", " and ", unicodedata.normalize("NFKC", text)).lower()
    text = "".join(PLAIN.get(c, c) for c in text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = _INITIALS_RE.sub(lambda m: m[0].replace(".", ""), text)
    return " ".join(re.split(r"[\W_]+", text)).strip()


def fold_marks_text(text: str | None) -> str:
    """Decomposed, without marks (of any class), lower case, apostrophes deleted, words parted by one space."""
    kept = (c for c in unicodedata.normalize("NFKD", text or "") if unicodedata.category(c)[0] != "M")
    text = re.sub(r"[&+]", " and ", re.sub(r"['’`]", "", "".join(kept).lower()))
    words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text)
    return " ".join(words.split(" ")).strip() if "  " not in words else re.sub(" +", " ", words).strip()


@F.pandas_udf(StringType())
def _fold_arrow(s: pd.Series) -> pd.Series:
    return s.map(fold_text)


@F.pandas_udf(StringType())
def _fold_marks_arrow(s: pd.Series) -> pd.Series:
    return s.map(fold_marks_text)


def _only_if(condition: Column, value: Column) -> Column:
    """Null where the condition fails, so that an Arrow function gets nothing to do there."""
    return F.when(condition, value)


def _alike(one: Callable[[str], str], kept: str = "") -> tuple[str, str]:
    """Non-ASCII characters that ``one`` turns into one ASCII character or into none (a space), and those characters.

    Combining marks aren't among them, so a character means the same in any text.
    """
    found = {}
    for c in map(chr, [*range(0x00A0, 0x0250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]):
        to = one(f"a{c}a")[1:-1]
        if len(to) == 1 and to.isascii() and one(c) in (to, "") and c not in kept:
            found[c] = to
    return "".join(found), "".join(found.values())


_PLAIN_FOLD = _alike(fold_text)
_PLAIN_MARKS = _alike(fold_marks_text, "’")


def fold(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    plain = F.translate(F.replace(c, F.lit("ß"), F.lit("ss")), *_PLAIN_FOLD)
    plain = F.when(c.rlike(ASCII), c).otherwise(plain)
    native = plain.rlike(ASCII) & ~plain.rlike("(?i)" + r"(?<!\w)(?:[a-z]\.){2,}")
    spelled = F.lower(F.regexp_replace(plain, r"\s*&\s*", " and "))
    return F.when(native, F.trim(F.regexp_replace(spelled, r"[\W_]+", " "))).otherwise(_fold_arrow(_only_if(~native, c)))


def fold_marks(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    plain = F.when(c.rlike(ASCII), c).otherwise(F.translate(c, *_PLAIN_MARKS))
    native = plain.rlike(r"^[\x00-\x7Fß’]*$")
    spelled = F.regexp_replace(F.regexp_replace(F.lower(plain), r"['`’]", ""), r"[&+]", " and ")
    return F.when(native, F.trim(F.regexp_replace(spelled, r"[^a-z0-9ß]+", " "))).otherwise(_fold_marks_arrow(_only_if(~native, c)))


def strip_spaces(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
