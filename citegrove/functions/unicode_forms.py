"""Canonical composition (NFC) of character clusters as column expressions.

The tables are derived from the Unicode database.  They are pairs of strings for `translate`, which looks a character up in constant time: a character
that decomposes is first and second part, one level at a time; a starter is composed with a mark by the strings of that mark."""
import unicodedata

from pyspark.sql import Column, functions as F

from citegrove.functions.spans import let

_HANGUL = (0xAC00, 0xD7A3)


def _pairs() -> list[tuple[str, str]]:
    """Characters with a canonical decomposition (first part, or all of it where it is one character)."""
    out = []
    for cp in range(0xC0, 0x30000):
        if not _HANGUL[0] <= cp <= _HANGUL[1]:
            d = unicodedata.decomposition(chr(cp))
            if d and not d.startswith("<"):
                out.append((chr(cp), "".join(chr(int(x, 16)) for x in d.split())))
    return out


_DECOMPOSED = _pairs()
SINGLES_FROM = "".join(c for c, d in _DECOMPOSED if len(unicodedata.normalize("NFC", c)) == 1 and unicodedata.normalize("NFC", c) != c)
SINGLES_TO = "".join(unicodedata.normalize("NFC", c) for c in SINGLES_FROM)
# characters that even alone become several
EXPANDING = "".join(c for c, _ in _DECOMPOSED if len(unicodedata.normalize("NFC", c)) > 1)
_PARTED = "".join(c for c, _ in _DECOMPOSED)
_FIRST, _SECOND = "".join(d[0] for _, d in _DECOMPOSED), "".join(d[1] if len(d) > 1 else "￿" for _, d in _DECOMPOSED)
_NOTHING = "￿"
# combining class of each mark that has one, as a character (class + 0x100, so that characters sort as classes do)
_MARKS = "".join(chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c)))
_CLASSES = "".join(chr(0x100 + unicodedata.combining(c)) for c in _MARKS)
_NO_CLASS = chr(0x100)
# starters that a mark composes with, by mark
_COMPOSING: dict[str, tuple[str, str]] = {}
for _c, _d in _DECOMPOSED:
    if len(_d) == 2 and unicodedata.normalize("NFC", _d) == _c:
        _starters, _composed = _COMPOSING.get(_d[1], ("", ""))
        _COMPOSING[_d[1]] = (_starters + _d[0], _composed + _c)
_BY_USE = sorted(_COMPOSING, key=lambda m: -len(_COMPOSING[m][0]))

JAMO = "[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|[가-힣][ᆨ-ᇂ]"
NEEDS_COMPOSING = r"\p{M}|[ᅡ-ᅵᆨ-ᇂ" + EXPANDING + "]"
# a composed sequence: jamo, or a character with its marks
CLUSTER = rf"(?s)(?:{JAMO})|\P{{M}}\p{{M}}*|\p{{M}}+"


def _code(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")


def _syllable(cluster: Column) -> Column:
    """A Hangul syllable from its jamo, or from a syllable without a final and its final."""
    first, size = F.substring(cluster, 1, 1), F.length(cluster)
    part = lambda i: _code(F.substring(cluster, i, 1))
    whole = first.rlike("[가-힣]")
    open_ = F.when(whole, _code(first)).otherwise(0xAC00 + ((part(1) - 0x1100) * 21 + part(2) - 0x1161) * 28)
    final = F.when(whole, part(2) - 0x11A7).when(size == 3, part(3) - 0x11A7).otherwise(0)
    made = F.decode(F.unhex(F.lpad(F.hex(open_ + final), 4, "0")), "UTF-16BE")
    # a syllable that has a final takes no other
    return F.when(whole & ((_code(first) - 0xAC00) % 28 != 0), cluster).otherwise(made)


def _parts(c: Column) -> Column:
    """Full decomposition of one character: three levels are enough for every character there is."""
    def level(x: Column) -> Column:
        first = F.translate(x["s"], _PARTED, _FIRST)
        second = F.translate(x["s"], _PARTED, _SECOND)
        return F.struct(first.alias("s"), F.when((second == _NOTHING) | (first == x["s"]), x["rest"]).otherwise(F.concat(second, x["rest"])).alias("rest"))
    done = F.struct(c.alias("s"), F.lit("").alias("rest"))
    for _ in range(3):
        done = let(done, level)
    return let(done, lambda x: F.concat(x["s"], x["rest"]))


def _joined(starter: Column, mark: Column) -> Column:
    """The starter composed with the mark; the starter itself where they don't compose."""
    out = None
    for m in _BY_USE:
        hit = F.translate(starter, *_COMPOSING[m])
        out = F.when(mark == m, hit) if out is None else out.when(mark == m, hit)
    return out.otherwise(starter)


def compose(cluster: Column) -> Column:
    """NFC of one cluster (see CLUSTER): parts in canonical order, then each mark joins the starter unless a mark of its class or a higher one is left
    between them."""
    def ordered(parts: Column) -> Column:
        keyed = F.transform(F.split(parts, ""), lambda c, i: F.struct(F.when(F.contains(F.lit(_MARKS), c), F.translate(c, _MARKS, _CLASSES)).otherwise(_NO_CLASS).alias("k"), i.alias("i"), c.alias("c")))
        return keyed

    def sorted_(keyed: Column) -> Column:
        # a character of no class ends a stretch of marks; stretches stay where they are
        stretch = F.transform(keyed, lambda x: F.struct(F.size(F.filter(keyed, lambda y: (y["i"] <= x["i"]) & (y["k"] == _NO_CLASS))).alias("n"), x["k"].alias("k"), x["i"].alias("i"), x["c"].alias("c")))
        return F.array_sort(stretch)

    def step(acc: Column, x: Column) -> Column:
        blocked = (acc["rest"] != "") & ((acc["last"] >= x["k"]) | (x["k"] == _NO_CLASS))
        return let(F.when(blocked | (acc["s"] == ""), acc["s"]).otherwise(_joined(acc["s"], x["c"])), lambda s: F.when(
            acc["s"] == "", F.struct(x["c"].alias("s"), F.lit("").alias("rest"), F.lit(_NO_CLASS).alias("last"), acc["done"].alias("done")))
            .when(s != acc["s"], F.struct(s.alias("s"), acc["rest"].alias("rest"), acc["last"].alias("last"), acc["done"].alias("done")))
            .when(x["k"] == _NO_CLASS, F.struct(x["c"].alias("s"), F.lit("").alias("rest"), F.lit(_NO_CLASS).alias("last"), F.concat(acc["done"], acc["s"], acc["rest"]).alias("done")))
            .otherwise(F.struct(acc["s"].alias("s"), F.concat(acc["rest"], x["c"]).alias("rest"), x["k"].alias("last"), acc["done"].alias("done"))))
    start = F.struct(F.lit("").alias("s"), F.lit("").alias("rest"), F.lit(_NO_CLASS).alias("last"), F.lit("").alias("done"))
    marked = let(let(let(F.array_join(F.transform(F.split(cluster, ""), _parts), ""), ordered), sorted_),
                 lambda cs: F.aggregate(cs, start, step, lambda a: F.concat(a["done"], a["s"], a["rest"])))
    slow = F.when(cluster.rlike(f"^(?:{JAMO})$"), _syllable(cluster)).otherwise(marked)

    # the usual cluster: one or two marks that join the starter as they come
    def usual(c: Column) -> Column:
        first, second, third = (F.substring(c, i, 1) for i in (1, 2, 3))
        return let(_joined(first, second), lambda one: F.when(one == first, "").when(F.length(c) == 2, one).when(
            F.length(c) == 3, let(_joined(one, third), lambda two: F.when(two != one, two).otherwise(""))).otherwise(""))
    return let(F.when(F.length(cluster).between(2, 3), usual(cluster)).otherwise(""), lambda u: F.when(u != "", u).otherwise(slow))
