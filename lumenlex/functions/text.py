"""Sentence and token functions as column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Ethiopic letters, the marks that end a sentence, and what separates tokens.
ETHIOPIC_LETTER = r"\x{1200}-\x{135A}"
SENTENCE_END = r"[\n።፧?!]+"
TOKEN = r"[^\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}]+"
# Character classes of the quality report, by code point.
BUCKETS = (
    ("ethiopic_letters", ((0x1200, 0x135A),)),
    ("ethiopic_numerals", ((0x1369, 0x137C),)),
    ("ascii_letters", ((0x41, 0x5A), (0x61, 0x7A))),
    ("ascii_digits", ((0x30, 0x39),)),
)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends. (``trim`` takes U+0020 only.)"""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def not_blank(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?U)\S"))


def split_sentences(text: Column) -> Column:
    """Sentences of a clean text: a line break or a run of marks ends one; blank pieces are left out."""
    return F.filter(F.transform(split_pieces(text), strip), lambda s: s != "")


def split_pieces(text: Column) -> Column:
    """What ``split_sentences`` strips: some pieces are blank."""
    return F.split(F.coalesce(text, F.lit("")), SENTENCE_END)


def join_initialisms(sentence: Column) -> Column:
    """Single Ethiopic letters joined by periods become one word: the period between two lone letters goes.

    The pattern begins with the period, so that the search stops at periods only.
    """
    letter = f"[{ETHIOPIC_LETTER}]"
    return F.regexp_replace(sentence, f"\\.(?<=(?<!{letter}){letter}\\.)(?={letter}(?!{letter}))", "")


def tokenize(sentence: Column) -> Column:
    """Runs of characters that are no white space, punctuation, symbol or control; case and form are kept."""
    return F.regexp_extract_all(join_initialisms(sentence), F.lit(TOKEN), F.lit(0))


def has_ethiopic_letter(token: Column) -> Column:
    return F.rlike(token, F.lit(f"[{ETHIOPIC_LETTER}]"))


def character_bucket(character: Column) -> Column:
    """The class of a character in the quality report."""
    point, found = F.ascii(character), F.lit("other")
    for name, ranges in reversed(BUCKETS):
        inside = F.lit(False)
        for low, high in ranges:
            inside = inside | point.between(low, high)
        found = F.when(inside, name).otherwise(found)
    return found


def code_point_label(character: Column) -> Column:
    """U+ and the code point in at least four upper-case hexadecimal digits."""
    digits = F.hex(F.ascii(character).cast("bigint"))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))
