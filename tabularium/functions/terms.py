"""Terms of a text, as JVM expressions: references resolved, invisible characters and accents dropped, lower case.

A term is a maximal run of letters of at least ``min_len``. No Python runs per row.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from html.entities import name2codepoint
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are not seen, and combining marks of decomposed letters.
INVISIBLE = "[\\p{M}\\u00AD\\u200B-\\u200F\\u2060-\\u2064\\uFEFF]"


@cache
def accent_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, by the rule of canonical decomposition."""
    pairs = []
    for code in chain(range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            pairs.append((chr(code), base[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def resolve_references(text: Column) -> Column:
    """Character references (named Latin-1 and symbol ones, decimal, hexadecimal) resolved; unknown ones stay."""
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(chr(v))) for k, v in sorted(name2codepoint.items())))

    def utf(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]{1,7});?", 1)
        dec = F.regexp_extract(piece, "^#([0-9]{1,6});?", 1)
        hexa = F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]{1,5});?", 1)
        rest = F.regexp_replace(piece, "^(?:#[0-9]{1,6}|#[xX][0-9a-fA-F]{1,5}|[A-Za-z][A-Za-z0-9]{1,7});?", "")
        return (
            F.when(names[name].isNotNull(), F.concat(names[name], rest))
            .when(dec != "", F.concat(utf(F.conv(dec, 10, 16)), rest))
            .when(hexa != "", F.concat(utf(hexa), rest))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(text, "&", -1)
    joined = F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, 1_000_000_000), one), ""))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def fold(text: Column, references: bool = True) -> Column:
    """Lower case without accents in any Unicode form and without invisible characters; null stays null."""
    src, dst = accent_table()
    text = resolve_references(text) if references else text
    return F.lower(F.regexp_replace(F.translate(text, src, dst), INVISIBLE, ""))


def terms(text: Column, min_len: int = 3) -> Column:
    """The terms of a text in order, repeated ones included; null and term-less texts give an empty array."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(f"\\p{{L}}{{{min_len},}}"), F.lit(0)), F.array().cast("array<string>"))
