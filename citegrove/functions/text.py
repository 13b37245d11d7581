"""Column expressions for text: accents, spaces, noise."""
import unicodedata

from pyspark.sql import Column, functions as F

from citegrove.functions.literals import map_literal
from citegrove.functions.spans import let


def _fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Single characters and their accent-free compatibility form, derived from the Unicode database:
    one-to-one folds as a pair of `translate` strings, the rest as (char, replacement)."""
    src, dst, longer = [], [], []
    ranges = [(0xA0, 0x24F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x2070, 0x209F), (0x2100, 0x214F),
              (0xFB00, 0xFB06), (0xFF01, 0xFF5E)]
    for lo, hi in ranges:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            folded = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
            if folded == ch:
                continue
            if len(folded) == 1:
                src.append(ch)
                dst.append(folded)
            else:
                longer.append((ch, folded))
    return "".join(src), "".join(dst), longer


FOLD_FROM, FOLD_TO, FOLD_LONGER = _fold_table()
# plain letters are passed by a range: a long list of signs is tried one by one
_NOT_PLAIN = "(?![\\x{0}-\\x{9f}])(?:\\p{M}|[" + "".join(c for c, _ in FOLD_LONGER) + "])"


def strip_accents(col: Column) -> Column:
    """Accents and compatibility forms off ('º' -> 'o'); one-to-one folds keep the length of the text."""
    expand = map_literal(dict(FOLD_LONGER))

    def stripped(c: Column) -> Column:
        plain = F.translate(c, FOLD_FROM, FOLD_TO)
        longer = F.array_join(F.transform(F.split(F.regexp_replace(plain, "\\p{M}+", ""), ""),
                                          lambda x: F.coalesce(F.try_element_at(expand, x), x)), "")
        return F.when(c.rlike(_NOT_PLAIN), longer).otherwise(plain)
    return let(col, stripped)


def fold_same_length(col: Column) -> Column:
    """Accent-free upper case with exactly one character per input character, so that offsets hold."""
    return F.upper(F.translate(col, FOLD_FROM + "°ß", FOLD_TO + "os"))


def collapse_spaces(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, "(?U)\\s+", " "), "^ | $", "")


# Shape of a snippet, sign by sign: 9 digit (5 stays, it may be an S), l capital or l that looks like a digit, v small a or o (they follow numbers as
# ordinals), x other letter, - dot or hyphen, one blank for white space, _ anything else.  Scanning leaves these shapes:
_SHAPE_OF = [("[0-46-9]", "9"), ("[OlLISBGZ]", "l"), (r"[ao]", "v"), (r"[\p{L}&&[^lvªº]]", "x"), (r"[.\-]", "-"), (r"\s++", " "), (r"[^95lvx\- ]", "_")]
NOISE_SHAPES = ["[95] [95]", "[95] ?- [95]", "[95]- ?-", "[95][lx]", "[lvx][95]", "(?<![95lvx_])[l5]{1,3}-? [95]"]


def _shape_table() -> tuple[str, str]:
    """ASCII and Latin-1 signs with their kinds, as `translate` strings."""
    signs = [chr(c) for c in range(256)]

    def kind(sign: str) -> str:
        if sign in "0123456789":
            return "5" if sign == "5" else "9"
        if sign in "OlLISBGZ":
            return "l"
        if sign in "aov":
            return "v"
        if sign.isspace() and not "\x1c" <= sign <= "\x1f":
            return " "
        return "x" if sign.isalpha() and sign not in "ªº" else "-" if sign in ".-" else "_"
    return "".join(signs), "".join(map(kind, signs))


_SHAPE_FROM, _SHAPE_TO = _shape_table()


def noise_flag(col: Column) -> Column:
    """Whether a snippet shows a broken line, blanks or doubled links within a number, or letters among its digits."""
    def shape_of(known: Column) -> Column:
        shape = known
        for signs, kind in _SHAPE_OF:
            shape = F.regexp_replace(shape, "(?U)" + signs, kind)
        # signs beyond Latin-1 are read rule by rule, in snippets that have some
        return F.when(known.rlike(r"[^\x{0}-\x{ff}]"), shape).when(F.contains(known, F.lit("  ")), F.regexp_replace(known, "  ++", " ")).otherwise(known)
    return let(col, lambda c: F.contains(c, F.lit("\n")) | let(F.translate(c, _SHAPE_FROM, _SHAPE_TO), shape_of).rlike("|".join(NOISE_SHAPES)))
