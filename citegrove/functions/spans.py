"""Match positions as array columns.

Spark's regex functions return the matched text but not where it was found.  `match_spans` marks every match in
one pass, splits at the marks and adds up the lengths, so positions come out in code points without a shuffle.
"""
from pyspark.sql import Column, functions as F

_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002"
_BLOCK = 256
SPAN_TYPE = "array<struct<start:int,end:int,match:string>>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it.  Spark does not share common
    subexpressions inside lambdas, so nested array functions would otherwise repeat the work."""
    return F.transform(F.array(value), lambda v: body(v))[0]


WHOLE = _OPEN + "$0" + _CLOSE


def unmarked(text: Column) -> Column:
    """The text with the signs of the marks replaced; most texts have none and are not gone through sign by sign."""
    has = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    return F.when(has, F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)).otherwise(text)


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches, half-open code-point offsets; NULL without a match.

    Lengths are added up in two levels (within blocks of 256 pieces, then over blocks), so the work stays close
    to linear in the number of matches of a text."""
    marked = F.split(F.regexp_replace(unmarked(text), pattern, WHOLE), _OPEN)
    return let(marked, _positions)


def _positions(pieces: Column) -> Column:
    n = F.size(pieces) - 1
    blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / _BLOCK).cast("int")),
                         lambda b: F.slice(pieces, b * _BLOCK + 2, F.lit(_BLOCK)))

    def size_of(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda s, p: s + F.length(p) - 1)
    bases = F.aggregate(
        blocks, F.struct(F.length(pieces[0]).alias("pos"), F.array().cast("array<int>").alias("out")),
        lambda acc, b: F.struct((acc["pos"] + size_of(b)).alias("pos"),
                                F.concat(acc["out"], F.array(acc["pos"])).alias("out")),
        lambda acc: acc["out"])

    def place(block: Column, base: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            found = F.substring_index(p, _CLOSE, 1)
            span = F.struct(acc["pos"].alias("start"), (acc["pos"] + F.length(found)).alias("end"),
                            found.alias("match"))
            return F.struct((acc["pos"] + F.length(p) - 1).alias("pos"),
                            F.concat(acc["out"], F.array(span)).alias("out"))
        return F.aggregate(block, F.struct(base.alias("pos"), F.array().cast(SPAN_TYPE).alias("out")), step,
                           lambda acc: acc["out"])
    return F.when(n > 0, F.flatten(F.zip_with(blocks, bases, place)))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points."""
    return F.substring(text, start + 1, end - start)


def left_of(text: Column, pos: Column, size: int) -> Column:
    start = F.greatest(pos - size, F.lit(0))
    return F.substring(text, start + 1, pos - start)
