"""String cleaning expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

ColOrName = Column | str


def _c(c: ColOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: ColOrName) -> Column:
    """``NULLIF(TRIM(c), '')``: trimmed text, empty -> NULL."""
    return F.nullif(F.trim(_c(c)), F.lit(""))


def trim_lower(c: ColOrName) -> Column:
    """``LOWER(TRIM(c))``."""
    return F.lower(F.trim(_c(c)))


# fixed values: letters that have no canonical decomposition
_STROKES = ("ØøŁłĐđĦħŦŧı", "OoLlDdHhTti")
_LIGATURES = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe"}


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Pairs (accented letter, base letter) derived by rule from Unicode:
    every Latin letter in U+00C0..U+024F and U+1E00..U+1EFF whose canonical
    decomposition is an ASCII letter followed only by combining marks."""
    src, dst = [], []
    for cp in list(range(0x00C0, 0x0250)) + list(range(0x1E00, 0x1F00)):
        ch = chr(cp)
        dec = unicodedata.normalize("NFD", ch)
        if len(dec) > 1 and dec[0].isascii() and dec[0].isalpha() and \
                all(unicodedata.combining(x) for x in dec[1:]):
            src.append(ch)
            dst.append(dec[0])
    return "".join(src), "".join(dst)


def accent_fold(c: ColOrName) -> Column:
    """Strip diacritics (``UNACCENT``) on the JVM side: composed letters and
    letters with a stroke are mapped, marks of decomposed letters removed, and
    ligatures spelt out."""
    src, dst = _accent_table()
    out = F.regexp_replace(F.translate(_c(c), src + _STROKES[0], dst + _STROKES[1]), r"\p{Mn}+", "")
    for ligature, letters in _LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out


def fold_key(c: ColOrName) -> Column:
    """Case- and accent-insensitive comparison key (an ``_ai_ci`` collation):
    ``lower(unaccent(trim(c)))``."""
    return F.lower(accent_fold(F.trim(_c(c))))


def pad_code(c: ColOrName, width: int = 5, fill: str = "0") -> Column:
    """Left-pad a code to ``width`` (``LPAD(c::text, 5, '0')``); longer values
    are truncated to ``width`` as LPAD does."""
    return F.lpad(_c(c).cast("string"), width, fill)


def split_first(c: ColOrName, sep: str = ",") -> tuple[Column, Column]:
    """Head and tail at the first ``sep``.

    Head is NULL when ``sep`` is absent; the tail keeps any leading blank and
    is the whole string when ``sep`` is absent.
    """
    s = _c(c)
    pos = F.locate(sep, s)
    head = F.when(pos > 0, s.substr(F.lit(1), pos - 1))
    tail = s.substr(pos + len(sep), F.length(s) + 1)
    return head, tail


def split_right(c: ColOrName, n: int, sep: str = ",", max_parts: int = 4) -> Column:
    """n-th part counted from the right after turning ``sep`` into dots
    (``PARSENAME(REPLACE(c, sep, '.'), n)``): NULL when missing, empty, or
    when the value has more than ``max_parts`` parts."""
    parts = F.split(F.replace(_c(c), F.lit(sep), F.lit(".")), r"\.")
    n_parts = F.size(parts)
    return F.when((n_parts <= max_parts) & (n_parts >= n),
                  F.nullif(F.element_at(parts, -n), F.lit("")))


def recode(c: ColOrName, mapping: dict) -> Column:
    """Searched CASE: mapped values replaced, all others (and NULL) kept."""
    col = _c(c)
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return col if out is None else out.otherwise(col)


def recode_prefix(c: ColOrName, prefix: str, to: str, fold: bool = False) -> Column:
    """Values starting with ``prefix`` become ``to`` (``LIKE 'prefix%'``).
    ``fold`` compares case- and accent-insensitively."""
    col = _c(c)
    probe = fold_key(col) if fold else col
    pat = fold_key(F.lit(prefix)) if fold else F.lit(prefix)
    return F.when(probe.startswith(pat), F.lit(to)).otherwise(col)


def strip_trailing(c: ColOrName, chars: str = ".", only_if_prefix: str | None = None) -> Column:
    """``TRIM(TRAILING chars FROM c)``, optionally only where c starts with
    ``only_if_prefix``."""
    col = _c(c)
    stripped = F.rtrim(col, F.lit(chars))
    if only_if_prefix is None:
        return stripped
    return F.when(col.startswith(only_if_prefix), stripped).otherwise(col)
