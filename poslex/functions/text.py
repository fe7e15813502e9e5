"""Column functions on annotation text and on codes of the stored formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space.
_WHITE_ASCII = "\t\n\x0b\x0c\r "
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def words(text: Column) -> Column:
    """Array of the maximal runs outside blank, tab, line feed and carriage return."""
    return F.filter(F.split(text, "[ \\t\\n\\r]+", -1), lambda x: x != "")


def trimmed(line: Column) -> Column:
    """The line without white space at either end (Unicode White_Space, line ends included)."""
    # Spark looks for a character in the whole of the set, so lines of ASCII only get the short one
    plain = F.char_length(line) == F.octet_length(line)
    return F.when(plain, F.btrim(line, F.lit(_WHITE_ASCII))).otherwise(F.btrim(line, F.lit(_WHITE)))


def collocate_offset(code: Column) -> Column:
    """Offset of a collocate from its stored code: 1 is none, even c is c / 2, odd c is -(c / 2) truncated."""
    half = F.shiftright(code, 1)
    return F.when(code == 1, F.lit(None)).when(code % 2 == 0, half).otherwise(-half).cast("int")


def score(quantised: Column, least: float = -10.0, norm: float = 4096 / 30) -> Column:
    """A stored score as the number that it stands for."""
    return quantised / F.lit(float(norm)) + F.lit(float(least))


def adjusted_scale(delta: int, bits: int, greatest: float) -> tuple[float, float]:
    """(least, norm) of scores stored with an adjusted scale: least is -(delta - 1)."""
    least = -float(delta - 1)
    return least, 2.0**bits / (greatest - least)


def log_dice(both: Column, one: Column, other: Column) -> Column:
    """14 + log2(2 f(x, y) / (f(x) + f(y)))."""
    return F.lit(14.0) + F.log2(F.lit(2.0) * both / (one + other))
