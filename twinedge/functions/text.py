"""Author ids, blocking keys and display strings as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefix of a derived author id.
AUTHOR_ID_PREFIX = "00|author______::"

# Letters of Latin-1 and Latin Extended-A that fold to another
# letter without being an accented form of it, or to more than one letter.
FOLD_ONE = {"Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ħ": "H", "ħ": "h",
            "ı": "i", "Ł": "L", "ł": "l", "Ŧ": "T", "ŧ": "t", "ĸ": "k", "ſ": "s",
            "Ŀ": "L", "ŀ": "l"}
FOLD_MANY = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th",
             "Ĳ": "IJ", "ĳ": "ij", "ŉ": "'n", "Ŋ": "ng", "ŋ": "ng"}

# Whitespace of ASCII as a string library strips it; SQL trim removes blanks only.
SPACE = r"[ \t-\r\x1c-\x1f]"


def fold_pairs() -> tuple[str, str]:
    """From/to strings for ``translate``: base letters of accented ones, by rule."""
    one = dict(FOLD_ONE)
    for code in range(0xC0, 0x180):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii():
            one[chr(code)] = parts[0]
    return "".join(one), "".join(one.values())


def ascii_fold(text: Column) -> Column:
    source, target = fold_pairs()
    folded = F.translate(text, source, target)
    for letter, spelled in FOLD_MANY.items():
        folded = F.replace(folded, F.lit(letter), F.lit(spelled))
    return folded


def author_id(fullname: str, pub_id: str) -> Column:
    """Prefix and md5 of the publication id followed by the full name."""
    return F.concat(F.lit(AUTHOR_ID_PREFIX), F.md5(F.concat(F.col(pub_id), F.col(fullname))))


def lnfi_key(name: str, surname: str) -> Column:
    """Last name and first initial, folded, lower case; '' if either is missing
    or the name is empty (an empty surname is fine)."""
    usable = F.col(name).isNotNull() & (F.col(name) != "") & F.col(surname).isNotNull()
    joined = F.concat(F.col(surname), F.substring(F.col(name), 1, 1))
    trimmed = F.regexp_replace(F.lower(ascii_fold(joined)), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(usable, trimmed).otherwise(F.lit(""))


def is_wellformed(name: str, surname: str) -> Column:
    """Neither part is the empty string; a null is not the empty string."""
    return ~F.col(name).eqNullSafe("") & ~F.col(surname).eqNullSafe("")


def replace_char(text: str, pos: int | Column, by: str) -> Column:
    """Replace the character at a 0-based position; negative counts from the
    end, a position outside the text gives null."""
    pos = F.lit(pos) if isinstance(pos, int) else pos
    size = F.char_length(F.col(text))
    at = F.when(pos < 0, size + pos).otherwise(pos)
    return F.when((at >= 0) & (at < size), F.overlay(F.col(text), F.lit(by), at + 1, F.lit(1)))


def author_display(fullname: str, orcid: str) -> Column:
    return F.concat(F.col(fullname), F.lit(" (ORCID: "), F.col(orcid), F.lit(")"))
