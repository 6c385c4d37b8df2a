"""File names from templates."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions.clean import BLANKS, clean_text

#: What a template may name.
TOKENS = ("manga", "chapter", "numbering", "website", "author", "artist", "filename")
_VOLUME = re.compile(r"vol", re.I | re.A)
_DIGITS = re.compile(r"[0-9]+")


def put(template: str, token: str, value: str) -> str:
    """A token's value in its place; where it is empty, a bracket on either side of the first place goes with it."""
    text, mark, value = template.strip(BLANKS), f"%{token.upper()}%", value.strip(BLANKS)
    at = text.find(mark)
    if at < 0:
        return text
    left = text[at - 1] if at and text[at - 1] in "([{" else ""
    right = text[at + len(mark)] if text[at + len(mark) : at + len(mark) + 1] in tuple(")]}") else ""
    return text.replace(left + mark + right, left + value + right if value else "")


def padded(name: str, volume: int, chapter: int) -> str:
    """The volume's number, after the first ``vol`` that begins a word, and the chapter's, the next one, in so many digits."""
    found, after = [], 0
    word = _VOLUME.search(name) if volume else None
    if word and (word.start() < 2 or name[word.start() - 1] in ",.-_ ") and "VOLUME NOT AVAILABLE" not in name.upper():
        if own := _DIGITS.search(name, word.start()):
            found, after = [(own, volume)], own.end()
    if chapter and (next_one := _DIGITS.search(name, after if after < len(name) else len(name))):
        found.append((next_one, chapter))
    for m, width in reversed(found):
        name = name[: m.start()] + m[0].rjust(width, "0") + name[m.end() :]
    return name


def bare(value: str, delete: str = "", other: str | None = None) -> str:
    """A value as part of a file name: entities decoded; ``delete`` characters go, or else slashes become underscores;
    ``other`` stands for each UTF-16 unit beyond ASCII."""
    out = clean_text(value)
    out = out.translate(dict.fromkeys(map(ord, delete))) if delete else re.sub("[/\x00]", "_", out)
    return out if other is None else "".join(c if 31 <= ord(c) <= 127 else other * (1 + (ord(c) > 0xFFFF)) for c in out)


def renamed(template: str, values: dict[str, str], fix: Callable[[str], str], volume: int = 0, chapter: int = 0, trim: bool = True) -> str:
    """The template with its values. A chapter gets its number in front where the template names neither; an empty result
    falls back to the number, then to the manga's name."""
    out = template
    if values["chapter"]:
        if "%NUMBERING%" not in out and "%CHAPTER%" not in out:
            out = values["numbering"] + out
        out = put(out, "numbering", values["numbering"])
        out = put(out, "chapter", fix(padded(values["chapter"].strip(BLANKS), volume, chapter))) or values["numbering"]
    for token in ("website", "manga", "author", "artist", "filename"):
        out = put(out, token, fix(values[token]))
    out = (out or fix(values["manga"])).strip("/\\")
    return out.rstrip(". ") if trim else out


def custom_rename(template: str, pad: tuple[int, int] = (0, 0), delete: str = "", other: str | None = None, **columns: Column) -> Column:
    """:func:`renamed` over columns by token; those not given, and nulls, are empty. ``pad`` is for volume and chapter."""

    @F.pandas_udf(T.StringType())
    def run(rows: pd.DataFrame) -> pd.Series:
        fix = lambda v: bare(v, delete, other)
        filled = rows.fillna("").to_dict("records")
        return pd.Series([renamed(template, r, fix, *pad, trim=not delete) for r in filled], dtype=object)

    return run(F.struct(*[columns.get(t, F.lit("")).cast("string").alias(t) for t in TOKENS]))


def page_name(template: str, name: Column, place: Column) -> Column:
    """A page's file name: its own name, else its place from 1 in three digits, in the template."""
    number = (place + 1).cast("string")
    own = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))
    return F.replace(F.lit(template), F.lit("%FILENAME%"), own)


def fitted(name: Column, most: int) -> Column:
    """The end of a name, at most ``most`` UTF-16 units; a character of two of which one fits goes."""
    units = F.encode(name, "UTF-16BE")
    tail = F.substring(units, -2 * most, 2 * most) if most else F.lit(b"")
    half = F.hex(F.substring(tail, 1, 1)).between("DC", "DF")  # the second half of a character
    whole = F.when(half, F.substring(tail, 3, 2 * most)).otherwise(tail)
    return F.when(F.octet_length(units) > 2 * most, F.decode(whole, "UTF-16BE")).otherwise(name)
