"""Column expressions for procedural classes: any spelling becomes an array of acronyms."""
from pyspark.sql import Column, functions as F

from citegrove.functions.literals import map_literal
from citegrove.functions.text import strip_accents
from citegrove.rules import CLASS_SPELLINGS, CLASS_VOCABULARY, IGNORABLE_ORDINALS, IGNORABLE_WORDS, WORD_SWAPS

_DIRECTIONS = [seen + meant for seen, meant in WORD_SWAPS if len(seen) == 1]
_SPELLINGS = [(s, acr) for acr, spellings in CLASS_SPELLINGS for s in spellings]
# leftmost-first alternation: rules in order (spellings of one first letter stand together, in order), then any other word
_BY_LETTER: dict[str, list[str]] = {}
for _s, _ in _SPELLINGS:
    _BY_LETTER.setdefault(_s[0], []).append(_s[1:])
CLASS_TOKEN = "(?:" + "|".join(c + "(?:" + "|".join(rest) + ")" for c, rest in _BY_LETTER.items()) + r")\b|\S+"
IGNORABLE = "^(?:" + "|".join(IGNORABLE_WORDS) + "|" + IGNORABLE_ORDINALS + ")$"


def _collapse_py(word: str) -> str:
    return word.replace("RN", "M").translate(str.maketrans("051LC", "OSIIE"))


def _collapse(w: Column) -> Column:
    return F.translate(F.replace(w, F.lit("RN"), F.lit("M")), "051LC", "OSIIE")


def _lookalikes(vocabulary: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for w in vocabulary:
        out.setdefault(_collapse_py(w), []).append(w)
    return out


def class_map() -> Column:
    return map_literal({s: acr for s, acr in reversed(_SPELLINGS)})


_HEADS = ("EMBARGOS", "AGRAVO", "RECURSO")


def prepare_class_text(col: Column) -> Column:
    """Words of a class, accent-free and upper case, one blank apart.  Stops, dashes, slashes and brackets end a word, but
    'A.RESP' is one; a word glued to what it introduces ('NOAGRAVO', 'AGAIRR') is taken apart."""
    plain = F.regexp_replace(F.upper(strip_accents(F.translate(col, "°", "º"))), r"\s*+\.\s*+", ".")
    joined = F.regexp_replace(plain, r"\bA\.(?=RESP)", "A")
    words = F.filter(F.split(joined, r"(?U)[\s.\-–—/()]++"), lambda w: w != "")
    return F.array_join(F.transform(words, _apart), " ")


_INTRODUCED = {"NOS": _HEADS, "NAS": _HEADS, "NO": _HEADS, "NA": _HEADS, "AG": ("AIRR", "ARR", "RRAG", "RR")}


def _apart(word: Column) -> Column:
    out = word
    for first, rest in reversed(_INTRODUCED.items()):
        n = len(first)
        after = F.substring(word, F.lit(n + 1), F.length(word))
        fits = after.isin(*rest) if first == "AG" else F.lit(False)
        for r in rest if first != "AG" else ():
            fits = fits | after.startswith(r)
        out = F.when(word.startswith(first) & fits, F.concat(F.lit(first + " "), after)).otherwise(out)
    return out


def swaps_between(seen: Column, meant: Column) -> Column:
    """How many OCR swaps turn `seen` into `meant`; NULL when it takes anything else."""
    s = F.when(F.length(seen) == F.length(meant), seen).otherwise(F.replace(seen, F.lit("RN"), F.lit("M")))
    shrunk = F.length(seen) - F.length(meant)
    pairs = F.zip_with(F.split(s, ""), F.split(meant, ""), lambda a, b: F.concat(a, b))
    changed = F.filter(pairs, lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))
    total = shrunk + F.size(changed)
    letters = F.exists(changed, lambda p: ~F.substring(p, 1, 1).rlike("[0-9]")) | (shrunk > 0)
    ok = ((F.length(s) == F.length(meant)) & F.forall(changed, lambda p: p.isin(_DIRECTIONS))
          & (~letters | (F.length(seen) >= 4)))
    return F.when(ok, total)


def repair_word(w: Column, vocabulary: list[str] | None = None) -> Column:
    """A word outside the vocabulary read back with at most two OCR swaps undone; itself when none fits.
    Words are bucketed by a look-alike key, so no variants are generated."""
    vocabulary = CLASS_VOCABULARY if vocabulary is None else vocabulary
    table = map_literal(_lookalikes(vocabulary))
    known = w.isin(*vocabulary)
    n_letters = F.length(F.regexp_replace(w, r"[^\p{L}]", ""))
    n_digits = F.length(F.regexp_replace(w, "[^0-9]", ""))
    options = F.filter(
        F.transform(F.coalesce(F.try_element_at(table, _collapse(w)), F.array().cast("array<string>")),
                    lambda v: F.struct(swaps_between(w, v).alias("n"), v.alias("v"))),
        lambda o: o["n"].between(1, 2))
    best = F.array_min(options)["v"]
    return (F.when(known, w)
            .when((n_letters >= 2) & (n_digits <= n_letters - 1), F.coalesce(best, w))
            .otherwise(w))


def repair_class_text(prepared: Column) -> Column:
    return F.array_join(F.transform(F.split(prepared, " "), lambda w: repair_word(w)), " ")


def acronyms_of(repaired: Column) -> Column:
    """Ordered acronyms of a prepared and repaired class text; unknown words come out as '?WORD'."""
    table = class_map()
    return F.flatten(F.transform(
        F.regexp_extract_all(repaired, F.lit(CLASS_TOKEN), F.lit(0)),
        lambda t: F.coalesce(F.try_element_at(table, t),
                             F.when(t.rlike(IGNORABLE), F.array().cast("array<string>"))
                             .otherwise(F.array(F.concat(F.lit("?"), t))))))


def canonical_class(col: Column) -> Column:
    return acronyms_of(repair_class_text(prepare_class_text(col)))


def known_acronyms(arr: Column) -> Column:
    return F.filter(arr, lambda x: ~x.startswith("?"))


def unknown_words(arr: Column) -> Column:
    return F.transform(F.filter(arr, lambda x: x.startswith("?")), lambda x: F.substring(x, F.lit(2), F.length(x)))


def base_class(arr: Column) -> Column:
    """The last acronym that is not an unknown word."""
    return F.try_element_at(known_acronyms(arr), F.lit(-1))


def known_word(col: Column) -> Column:
    return F.forall(F.split(prepare_class_text(col), " "),
                    lambda p: (p == "") | repair_word(p).isin(*CLASS_VOCABULARY))
