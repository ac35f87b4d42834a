"""Text functions as JVM expressions: cleaning, tokens, sentences, titles, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabularium.functions.terms import accent_table

#: Portuguese function words and formulaic legal words that carry no subject.
STOPWORDS = (
    "a à ao aos aquela aquelas aquele aqueles aquilo as às até "
    "com como da das de dela delas dele deles depois do dos "
    "e é ela elas ele eles em entre era eram éramos essa essas "
    "esse esses esta está estamos estão estas estava estavam estávamos "
    "este estes estou eu foi fomos for foram fosse fossem fôssemos "
    "há haja hajam havemos havia hei houve houvemos houver houvera "
    "isso isto já lhe lhes mais mas me mesmo meu meus minha "
    "minhas muito na não nas nem no nos nós nossa nossas nosso "
    "nossos num numa o os ou para pela pelas pelo pelos por "
    "qual quando que quem são se seja sejam sejamos sem ser "
    "será serão serei seremos seria seriam seríamos seu seus só "
    "somos sou sua suas também te tem tém temos tenha tenham "
    "tenhamos tenho terá terão terei teremos teria teriam teríamos "
    "teu teus teve tinha tinham tínhamos tive tivemos tiver tivera "
    "tiveram tivéssemos tu tua tuas um uma você vocês vos "
    "dispoe dispõe art artigo lei decreto outras providencias providências "
    "altera revoga institui dá nova redacao redação concede"
).split()
#: Fixed value: the letters, digits and blanks that cleaning keeps.
KEPT = "[^a-zA-Z0-9áàâãéèêíïóôõöúçñÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ\\s]"
_ACCENTED, _PLAIN = "áàâãéèêíïóôõöúçñ", "aaaaeeeiiooooucn"


def clean(text: Column) -> Column:
    """Letters, digits and single blanks only, trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, KEPT, " "), "\\s+", " "))


def is_stopword(token: Column) -> Column:
    """Whether a token or its unaccented form is a stop word."""
    return token.isin(STOPWORDS) | F.translate(token, _ACCENTED, _PLAIN).isin(STOPWORDS)


def tokens(text: Column, stopwords: bool = False) -> Column:
    """Lower-case tokens of two characters or more, in order; without stop words unless asked for."""
    parts = F.split(F.lower(clean(text)), " ")
    return F.filter(parts, lambda t: (F.length(t) > 1) if stopwords else (F.length(t) > 1) & ~is_stopword(t))


#: Fixed value: where sentences end.
SENTENCE_END = "(?<=[.!?\\n;])\\s+|(?<=\\s-\\s)|(?<=\\s–\\s)"


def sentences(text: Column) -> Column:
    """Trimmed sentences: split after . ! ? ; or a line end with blanks, and after a dash between blanks."""
    parts = F.split(F.trim(text), SENTENCE_END)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")


def unaccented(text: Column) -> Column:
    """text without accents, precomposed or combining; case is kept."""
    import unicodedata

    src, _ = accent_table()
    dst = "".join(unicodedata.normalize("NFD", c)[0] for c in src)
    return F.regexp_replace(F.translate(text, src, dst), "\\p{M}", "")


def sanitize_title(text: Column) -> Column:
    """An official title as stored: no accents, no signs at the ends, single blanks, upper case; null becomes empty."""
    edge = "[.,;:\\]\\[=\\-–—\\s]+"
    plain = F.regexp_replace(F.regexp_replace(unaccented(F.trim(text)), edge + "$", ""), "^" + edge, "")
    return F.coalesce(F.trim(F.upper(F.regexp_replace(plain, "\\s+", " "))), F.lit(""))


def normalize_name(text: Column) -> Column:
    """A name as stored: trimmed, single blanks, upper case."""
    return F.upper(F.regexp_replace(F.trim(text), "\\s+", " "))


def abbreviate(text: Column, size: int) -> Column:
    """text cut to size characters, the last three of which are dots; shorter texts stay."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def identifier(kind: Column, number: Column, year: Column, key: Column) -> Column:
    """'Kind nº N/Year (ID key)'; a null or zero number, year or kind is left out."""
    n = F.when(F.coalesce(number, F.lit(0)) > 0, F.concat(F.lit(" nº "), number.cast("string"))).otherwise("")
    y = F.when(F.coalesce(year, F.lit(0)) > 0, F.concat(F.lit("/"), year.cast("string"))).otherwise("")
    return F.concat(F.coalesce(kind, F.lit("Norma")), n, y, F.lit(" (ID "), key.cast("string"), F.lit(")"))


def occurrences(text: Column, pattern: str) -> Column:
    """How often a literal occurs in a text, without overlaps; null for null text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(pattern)))) / len(pattern)).cast("bigint")


def not_blank(text: Column) -> Column:
    """Neither null nor white space only."""
    return text.isNotNull() & text.rlike("\\S")
