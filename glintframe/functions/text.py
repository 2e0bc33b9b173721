"""Text normalization and splitting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F�]"
SPACES = r"[\t\n\r    -     　]"
CJK = r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}])"
MARKS = r"[\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}]"
TOKEN = r"[\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}\s]"
#: White space as strip() and \s of text handling see it.
BLANK = r"[\s\x1C-\x1F\u0085   -     　]"
# Signs that end a sentence and a clause; lengths beyond which a sentence, and a single line, are split.
SENTENCE_END, CLAUSE_END = "。！？.!?\\n", "，；,;"
#: A longer sentence is split at clauses, too; a single longer line is split into sentences.
LONG_SENTENCE, LONG_LINE = 120, 100


def every(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def cleaned(text: Column) -> Column:
    """Without control characters and U+FFFD; other white space becomes a space."""
    return every(every(text, CONTROL, ""), SPACES, " ")


def cjk_spaced(text: Column) -> Column:
    return every(text, CJK, " $1 ")


def without_marks(text: Column) -> Column:
    """Without combining marks; letters with an accent of their own stay."""
    return every(text, MARKS, "")


def word_tokens(text: Column) -> Column:
    """Words and single signs of a cleaned text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def basic_tokens(text: Column) -> Column:
    """Lower case, clean, space CJK, strip marks, split at signs."""
    return word_tokens(without_marks(cjk_spaced(cleaned(F.lower(text)))))


def stripped(text: Column) -> Column:
    return every(text, f"^{BLANK}+|{BLANK}+$", "")


def _parts(text: Column, ends: str) -> Column:
    pieces = F.transform(F.split(text, f"(?<=[{ends}]){BLANK}*"), stripped)
    return F.filter(pieces, lambda p: p != "")


def sentences(text: Column) -> Column:
    """Array of sentences; long ones are split at clauses; never empty."""
    whole = F.flatten(F.transform(_parts(text, SENTENCE_END), lambda p: F.when(F.length(p) > LONG_SENTENCE, _parts(p, CLAUSE_END)).otherwise(F.array(p))))
    # bound to a lambda's variable, so that the pieces are made once
    return F.get(F.transform(F.array(whole), lambda w: F.when(F.size(w) == 0, F.array(text)).otherwise(w)), 0)


# Places where a space was lost, in the order in which they are mended. Digits are ASCII ones, as the
# engines compared take \d differently.
LOST_SPACES = [
    (r"([a-zA-Z])([0-9])", "$1 $2"),
    (r"([0-9])([a-zA-Z])", "$1 $2"),
    (r"([a-zA-Z0-9])\(", "$1 ("),
    (r"\)([a-zA-Z0-9])", ") $1"),
    (r",([a-zA-Z])", ", $1"),
    (r"\.([A-Z])", ". $1"),
    (r"([a-z])([A-Z])", "$1 $2"),
]


def spaced(text: Column) -> Column:
    for pattern, to in LOST_SPACES:
        text = every(text, pattern, to)
    return text


def space_gate(text: Column) -> Column:
    """What to do with a text: `spell` (short or well spaced), `keep` (mostly CJK and beyond) or `mend`."""
    n = F.length(text)
    spaces = n - F.length(F.replace(text, F.lit(" "), F.lit("")))
    high = n - F.length(every(text, r"[\x{4E00}-\x{10FFFF}]", ""))
    return F.when((n < 10) | (spaces / F.greatest(n, F.lit(1)) > 0.05), "spell").when(high > n * 0.3, "keep").otherwise("mend")


def case_like(pattern: Column, word: Column) -> Column:
    """word with the case of pattern: Capitalized, UPPER, else as it is."""
    capital = (F.substring(pattern, 1, 1) != F.lower(F.substring(pattern, 1, 1))) & (F.substring(pattern, 2, 1 << 20) == F.lower(F.substring(pattern, 2, 1 << 20)))
    return F.when(capital, F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 20)))).when(pattern == F.upper(pattern), F.upper(word)).otherwise(word)
