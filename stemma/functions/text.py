"""Text functions: normalisation, repair, identifiers."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Glyphs that a font re-encoding puts in place of Vietnamese vowels, and marks printed beside names.
GLYPHS = {"{": "à", "|": "á", "}": "â", "~": "ã", "[": "À", "\\": "Á"}
SYMBOLS = "●♠♦♣*†§¤"

_LETTER = "A-Za-zÀ-ỹĐđ"
_GLYPH = "[" + "".join("\\" + g for g in GLYPHS) + "]"
_IN_WORD = f"(?<=[{_LETTER}]){_GLYPH}|{_GLYPH}(?=[{_LETTER}])"
#: A private-use character that marks glyphs to replace.
_TAG = "\ue000"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def folded(text: str) -> str:
    """Without combining marks; letters such as đ stay."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@F.pandas_udf(T.StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(folded, na_action="ignore")


# Latin letters of the first blocks that lose their marks.
_MARKED = {c: folded(c) for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if len(folded(c)) == 1 and folded(c) != c}


def fold(text: Column) -> Column:
    """Without combining marks; letters such as đ stay. Only texts with letters beyond the Latin blocks are seen by Python."""
    plain = F.translate(text, "".join(_MARKED), "".join(_MARKED.values()))
    other = F.when(plain.rlike(r"[^\x00-\u024F\u1E00-\u1EFF]"), text)
    return F.coalesce(_fold(other), plain)


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML character references decoded."""
    return text.map(html.unescape, na_action="ignore")


def slug(text: Column) -> Column:
    """Folded, runs of other than letters and digits as one underscore, none at the ends."""
    plain = F.translate(fold(text.cast("string")), "đĐ", "dD")
    return F.btrim(F.regexp_replace(plain, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def repair_glyphs(text: Column) -> Column:
    """Substituted glyphs next to a letter become the letters they stand for; all are judged on the text as it was."""
    out = F.regexp_replace(text, _IN_WORD, _TAG + "$0")
    for glyph, letter in GLYPHS.items():
        out = F.replace(out, F.lit(_TAG + glyph), F.lit(letter))
    return out


def glyph_repairs(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_IN_WORD))


def squeeze(text: Column) -> Column:
    """White space runs, of any Unicode kind, as one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def symbols_in(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(f"[{SYMBOLS}]"), F.lit(0)), "")


def without_symbols(text: Column) -> Column:
    return F.translate(text, SYMBOLS, "")


def str_after(text: Column, mark: str) -> Column:
    """What follows the first occurrence of mark, '' if there is none."""
    at = F.instr(text, F.lit(mark))
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).otherwise("")


def iri_tail(iri: Column) -> Column:
    return F.element_at(F.split(iri, "/"), -1)


def iri_fragment(iri: Column) -> Column:
    return F.split_part(iri, F.lit("#"), F.lit(2))


def head_and_rest(text: Column, mark: str = "_") -> tuple[Column, Column]:
    """Before and after the first mark; the rest is '' if there is none."""
    at = F.instr(text, F.lit(mark))
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), str_after(text, mark)


def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def embeddable_json(json: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


_FIELDS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


def runs_of_fields(line: str) -> list[tuple[int, int, str]]:
    """Runs of words with single spaces between them, with their columns."""
    out, start = [], None
    for i, c in enumerate(line + "  "):
        gap = c.isspace()
        if start is None:
            start = None if gap else i
        elif gap and (c != " " or (line + "  ")[i + 1].isspace()):
            out.append((start, i, line[start:i]))
            start = None
    return out


@F.pandas_udf(_FIELDS)
def fields(line: pd.Series) -> pd.Series:
    return line.map(lambda x: [dict(zip(("start", "end", "text"), f, strict=True)) for f in runs_of_fields(x)], na_action="ignore")
