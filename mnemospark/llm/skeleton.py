"""Visually identical text with different characters: the confusables skeleton.

skeleton(text): drop signs that do not show, decompose (compatibility), replace every character by the prototype of its
look-alike class, fold case, decompose again, squeeze blanks. Two texts look the same to a reader exactly when their
skeletons are equal. Visible accents stay, as combining marks in canonical order. Null gives null, an empty or invisible
text gives the empty skeleton. Texts of any length are processed whole.
"""

from __future__ import annotations

import re
import unicodedata as u

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Look-alike letters by prototype. Letters of either case are listed; a lower-case letter without a Latin
# twin of its own follows its capital, for letter case is no difference.
LOOKALIKES = {
    "a": "аАαΑɑ",
    "b": "вВΒβ",
    "c": "сСϲϹⅽ",
    "d": "ԁԀ",
    "e": "еЕΕε",
    "f": "ϝ",
    "g": "ɡց",
    "h": "һҺнНΗηհ",
    "i": "іІΙιıӀ",
    "j": "јЈϳ",
    "k": "кКΚκ",
    "l": "ӏ",
    "m": "мМΜμϺ",
    "n": "Νո",
    "o": "оОοΟօՕσ",
    "p": "рРρΡ",
    "q": "ԛԚզ",
    "s": "ѕЅՏ",
    "t": "тТΤτ",
    "u": "սυ",
    "v": "νѵѴ",
    "w": "ԝԜѡ",
    "x": "хХΧχ",
    "y": "уУүҮΥγ",
    "z": "ΖζᴢᏃ",
    "'": "’‘ʼ′`´ʹʻʽ‛ꞌ＇",
    "-": "−⁃➖",
}
# The same for Cherokee, Lisu and Coptic letters, and for quotation marks.
LOOKALIKES_MORE = {
    "a": "ᎪꓮⲀⲁ", "b": "ᏴꓐⲂ", "c": "ᏟꓚⲤⲥ", "d": "Ꭰꓓ", "e": "Ꭼꓰ", "f": "ꓝ", "g": "Ꮐꓖ", "h": "ᎻꓧⲎ", "i": "ꓲⲒⲓ", "j": "Ꭻꓙ", "k": "ᏦꓗⲔⲕ", "l": "Ꮮꓡ", "m": "ᎷꓟⲘ", "n": "ꓠⲚ", "o": "ꓳⲞⲟ",
    "p": "ᏢꓑⲢⲣ", "r": "Ꭱꓣ", "s": "Ꮪꓢ", "t": "ᎢꓔⲦ", "u": "ꓴ", "v": "Ꮩꓦ", "w": "Ꮃꓪ", "x": "ꓫⲬⲭ", "y": "ꓬⲨ", "z": "ꓜ", '"': "“”„‟″＂",
}
_PROTOTYPE = {c: p for t in (LOOKALIKES, LOOKALIKES_MORE) for p, cs in t.items() for c in cs}
#: Words wholly in a script whose small letters look like other letters than its capitals do: they are compared by their capitals.
_WHOLE = re.compile(r"(?<!\w)(?:[\u0370-\u03ff\u1f00-\u1fff]{2,}|[\u0530-\u058f]{2,})(?!\w)")


class _Shown(dict):
    """Character -> its prototype, filled as characters turn up."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        if c in _PROTOTYPE:
            r = _PROTOTYPE[c]
        elif c.isspace() or u.category(c) == "Zs":
            r = " "
        elif _hidden(o, c):
            r = ""
        elif u.category(c) == "Pd":
            r = "-"
        elif m := re.fullmatch(r"LATIN LETTER SMALL CAPITAL (\w)", u.name(c, "")):
            r = m[1].lower()
        elif (d := u.normalize("NFKD", c)) != c:
            r = "".join(self[ord(x)] for x in d)
        else:
            r = c
        self[o] = r
        return r


def _hidden(o: int, c: str) -> bool:
    """Signs that do not show: controls, format characters, fillers, joiners and variation selectors."""
    return u.category(c) in ("Cf", "Cc", "Cn", "Co", "Cs") or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


_SHOWN = _Shown()


def skeleton_text(s: str) -> str:
    """The skeleton of one text."""
    s = _WHOLE.sub(lambda m: m[0].upper(), s)
    s = u.normalize("NFD", s.translate(_SHOWN).casefold().translate(_SHOWN))
    return " ".join(s.split(" ")).strip() if "  " not in s else re.sub(" +", " ", s).strip()


@pandas_udf(StringType())
def skeleton_udf(s: pd.Series) -> pd.Series:
    return s.map(skeleton_text, na_action="ignore")


def skeleton(col: str | Column) -> Column:
    return skeleton_udf(F.col(col) if isinstance(col, str) else col)


def consistent(df: DataFrame, text_col: str, out: str = "consistent_text") -> DataFrame:
    """df with the consistent text of text_col; null stays null."""
    return df.withColumn(out, skeleton(text_col))


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, stored_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: different ids whose texts look the same while the stored forms differ.

    Null ids and texts pair with nothing; null as a stored form differs from any text. Rows repeated whole count once.
    Equality of skeletons is a shuffle join that adaptive execution splits where one skeleton is hot.
    """
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(stored_col).alias("n")).where("id is not null and t is not null").distinct()
    d = d.select("id", skeleton("t").alias("s"), "n").distinct()
    shared = d.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s")
    d = d.join(shared, "s", "left_semi")
    a, b = d.alias("a"), d.alias("b")
    return a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.id") < F.col("b.id")) & ~F.col("a.n").eqNullSafe(F.col("b.n"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def lookalike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per id: its consistent text, the class (smallest id with that text) and the class's size and spellings."""
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null").groupBy("id").agg(F.min("t").alias("t"))
    d = d.select("id", "t", skeleton("t").alias("consistent_text"))
    g = d.where("consistent_text is not null").groupBy("consistent_text").agg(F.min("id").alias("class_id"), F.count("*").alias("members"), F.countDistinct("t").alias("spellings"))
    return d.select("id", "consistent_text").join(g, "consistent_text", "left").select("id", "consistent_text", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("spellings", F.lit(0)).alias("spellings"))
