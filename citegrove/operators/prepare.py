"""Text preparation with offset maps, and the way back to source offsets."""
from pyspark.sql import Column, DataFrame, functions as F

from citegrove.functions.spans import let
from citegrove.functions.unicode_forms import CLUSTER, EXPANDING, NEEDS_COMPOSING, SINGLES_FROM, SINGLES_TO, compose
from citegrove.rules import DOUBLE_QUOTE_CHARS, HYPHEN_CHARS, INVISIBLE_CHARS, SINGLE_QUOTE_CHARS

_CONTROLS = "".join(chr(c) for c in [*range(0, 9), 11, 12, *range(14, 32), 127])
_SWAP_FROM = HYPHEN_CHARS + DOUBLE_QUOTE_CHARS + SINGLE_QUOTE_CHARS + _CONTROLS + SINGLES_FROM
_SWAP_TO = ("-" * len(HYPHEN_CHARS) + '"' * len(DOUBLE_QUOTE_CHARS) + "'" * len(SINGLE_QUOTE_CHARS)
            + " " * len(_CONTROLS) + SINGLES_TO)
# signs that keep their place are passed by a range: a long list of signs is tried one by one
_KEEPING = r"[\x{0}-\x{ac}\x{ae}-\x{2ff}]"
_NEEDS_MAP = f"(?!{_KEEPING})(?:[" + INVISIBLE_CHARS + "]|" + NEEDS_COMPOSING + ")"
# a stretch of signs that are clusters by themselves and change one to one (no marks, no Hangul, nothing that vanishes or expands) is one piece
_SINGLE = rf"(?:{_KEEPING}|(?!{_NEEDS_MAP})[^\x{{1100}}-\x{{11ff}}\x{{ac00}}-\x{{d7a3}}])(?!\p{{M}})"
# what a sign that is swapped is one of; most texts have none and are not gone through sign by sign
_SWAPPED = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _SWAP_FROM if c < "\u0300") + r"\x{300}-\x{10ffff}]"
_PIECE = f"(?:{_SINGLE})++|{CLUSTER}"
_STRETCH = f"^(?:{_SINGLE})"
_BLOCK = 256


def _cluster_pieces(text: Column) -> Column:
    """Each piece's length, its prepared form and whether it is a stretch of single signs, which are looked up; other pieces are clusters: a character alone
    is looked up too, clusters and characters that expand are composed."""
    def form(c: Column) -> Column:
        alone = F.translate(c, _SWAP_FROM, _SWAP_TO)
        return F.when(F.contains(F.lit(INVISIBLE_CHARS), c), F.lit("")).when((F.length(c) == 1) & ~F.contains(F.lit(EXPANDING), c), alone).otherwise(compose(c))
    return F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), lambda c: let(c.rlike(_STRETCH), lambda plain: F.struct(
        F.length(c).alias("n"), F.when(plain, F.translate(c, _SWAP_FROM, _SWAP_TO)).otherwise(form(c)).alias("s"), plain.alias("plain"))))


def _offsets(pieces: Column) -> Column:
    """Start offset of every piece; blocks keep the running sums near linear on long texts."""
    blocks = F.transform(F.sequence(F.lit(0), (F.size(pieces) / _BLOCK).cast("int")),
                         lambda b: F.slice(pieces, b * _BLOCK + 1, F.lit(_BLOCK)))
    empty = F.array().cast("array<int>")

    def grow(size):
        return lambda acc, x: F.struct((acc["pos"] + size(x)).alias("pos"),
                                       F.concat(acc["out"], F.array(acc["pos"])).alias("out"))
    start = F.struct(F.lit(0).alias("pos"), empty.alias("out"))
    bases = F.aggregate(blocks, start, grow(lambda b: F.aggregate(b, F.lit(0), lambda s, p: s + p["n"])),
                        lambda acc: acc["out"])
    return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.aggregate(
        b, F.struct(base.alias("pos"), empty.alias("out")), grow(lambda p: p["n"]), lambda acc: acc["out"])))


def prepare_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `prepared`, `map_start`, `map_end`: NFC, no invisible characters, one kind of hyphen and quote,
    controls as spaces.  Texts that keep their length (nearly all) have NULL maps, meaning identity."""
    col = F.col(text)
    mapped = docs.withColumn("_pieces", F.when(col.rlike(_NEEDS_MAP), _cluster_pieces(col)))
    mapped = mapped.withColumn("_at", F.when(F.col("_pieces").isNotNull(), _offsets(F.col("_pieces"))))
    zipped = F.zip_with("_pieces", "_at", lambda p, a: F.struct(p["s"].alias("s"), p["plain"].alias("plain"), a.alias("a"),
                                                               (a + p["n"]).alias("b")))
    per_char = lambda end: F.flatten(F.transform(
        zipped, lambda z: F.when(z["plain"], F.sequence(z["a"] + 1, z["b"]) if end else F.sequence(z["a"], z["b"] - 1)).otherwise(
            F.array_repeat(z["b"] if end else z["a"], F.length(z["s"])))))
    return mapped.select(
        *docs.columns,
        F.when(F.col("_pieces").isNull(), F.when(col.rlike(_SWAPPED), F.translate(col, _SWAP_FROM, _SWAP_TO)).otherwise(col))
        .otherwise(F.array_join(F.transform("_pieces", lambda p: p["s"]), "")).alias("prepared"),
        F.when(F.col("_pieces").isNotNull(), per_char(False)).alias("map_start"),
        F.when(F.col("_pieces").isNotNull(), per_char(True)).alias("map_end"))


def source_start(start: Column, map_start: Column) -> Column:
    return F.when(map_start.isNull(), start).otherwise(F.try_element_at(map_start, start.cast("int") + 1))


def source_end(end: Column, map_end: Column) -> Column:
    return F.when(map_end.isNull(), end).otherwise(F.try_element_at(map_end, end.cast("int")))


def map_offsets_back(spans: DataFrame) -> DataFrame:
    """Spans on prepared text (`start`, `end` with the maps in the row) moved to source offsets."""
    return (spans.withColumn("start", source_start(F.col("start"), F.col("map_start")))
            .withColumn("end", source_end(F.col("end"), F.col("map_end"))).drop("map_start", "map_end"))
