"""Citation detectors: documents in, span rows out.

A detector is a way to find matches (a pattern, or a scan) and a function from one match (with the text beside it) to the spans
it stands for.  Matches
of all detectors are marked within the row, exploded once and read from bounded windows, so a scan of the documents
is enough for any number of detectors and texts never leave the map side: only span rows are shuffled, to settle
overlaps.
"""
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from citegrove.functions.cached import per_session
from citegrove.functions.classes import canonical_class, known_acronyms
from citegrove.functions.courts import court_code
from citegrove.functions.dockets import docket_of_digits, is_cnj, repair_digits
from citegrove.functions.laws import law_code_from_name, law_code_from_number, read_law
from citegrove.functions.numbers import numbers
from citegrove.functions.spans import left_of, let, match_spans
from citegrove.functions.text import fold_same_length, noise_flag
from citegrove.operators import patterns as P
from citegrove.operators.overlaps import resolve_overlaps
from citegrove.operators.prepare import prepare_text, source_end, source_start
from citegrove.plans.tables import stored
from citegrove.rules import COURTS, NEUTRAL_WORDS

CLASS_WINDOW, HEAD_WINDOW, YEAR_WINDOW_LEFT, YEAR_WINDOW_RIGHT, LAW_WINDOW = 130, 110, 40, 120, 200
_FIELDS = {"kind": "string", "start": "int", "end": "int", "number": "string", "class": "array<string>", "uf": "string",
           "court": "string", "norm_key": "string", "law": "string", "year": "int", "rapporteur": "string",
           "noisy": "boolean"}


_ITEMS = "array<struct<start:int,end:int,run:string,suffix:string,uf:string>>"


@dataclass(frozen=True)
class Detector:
    """`spans(m)` reads a match m (start, end, match, left, right, items) into an array of spans, or NULL.  Matches are those of a pattern,
    or what `find(text)` returns: (start, end, items)."""
    name: str
    order: int
    pattern: str | None
    spans: Callable[[Column], Column]
    left: int = 0
    right: int = 0
    find: Callable[[Column], Column] | None = None


def _span(snippet: Column, **columns: Column) -> Column:
    columns["noisy"] = noise_flag(snippet)
    return F.struct(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in _FIELDS.items()])


def _group(text: Column, pattern: str, i: int) -> Column:
    """A group of the pattern over a text; NULL when it took no part."""
    g = F.regexp_extract(text, pattern, i)
    return F.when(g != "", g)


@per_session
def _found(detectors: tuple[Detector, ...], text: str, maps: bool = False) -> Column:
    """Matches of the detectors in a text column, with the place in the list and the windows each asked for; with maps, the
    stretch of the offset maps that spans of the match can reach (`_base` is where it starts)."""
    def found(i: int, d: Detector) -> Column:
        def stretch(name: str, m: Column) -> Column:
            first = F.greatest(m["start"] - d.left, F.lit(0))
            return F.slice(F.col(name), first + 1, m["end"] + d.right - first)
        matches = d.find(F.col(text)) if d.find else match_spans(F.col(text), d.pattern)
        return F.transform(matches, lambda m: F.struct(
            F.lit(i).alias("d"), m["start"].alias("start"), m["end"].alias("end"), (F.lit("") if d.find else m["match"]).alias("match"),
            (m["items"] if d.find else F.lit(None)).cast(_ITEMS).alias("items"),
            (left_of(F.col(text), m["start"], d.left) if d.left else F.lit("")).alias("left"),
            (F.substring(F.col(text), m["end"] + 1, F.lit(d.right)) if d.right else F.lit("")).alias("right"),
            *([F.greatest(m["start"] - d.left, F.lit(0)).alias("_base"), stretch("map_start", m).alias("map_start"),
               stretch("map_end", m).alias("map_end")] if maps else [])))
    more = ",_base:int,map_start:array<int>,map_end:array<int>" if maps else ""
    none = F.array().cast(f"array<struct<d:int,start:int,end:int,match:string,items:{_ITEMS},left:string,right:string{more}>>")
    return F.concat(*[F.coalesce(found(i, d), none) for i, d in enumerate(detectors)])


@per_session
def _read(detectors: tuple[Detector, ...], match: str) -> Column:
    """Spans of one match, by the detector that found it."""
    read = None
    for i, d in enumerate(detectors):
        here = F.col(f"{match}.d") == i
        read = F.when(here, d.spans(F.col(match))) if read is None else read.when(here, d.spans(F.col(match)))
    return read


def read_spans(detectors: list[Detector], text: str) -> Column:
    """Spans of a short text as one array (for columns that are too short to be worth exploding)."""
    read = F.transform(_found(tuple(detectors), text), lambda m: _read_lambda(tuple(detectors), m))
    return F.flatten(F.filter(read, lambda s: s.isNotNull()))


def _read_lambda(detectors: tuple[Detector, ...], m: Column) -> Column:
    read = None
    for i, d in enumerate(detectors):
        read = F.when(m["d"] == i, d.spans(m)) if read is None else read.when(m["d"] == i, d.spans(m))
    return read


def run_detectors(docs: DataFrame, detectors: list[Detector], text: str = "text", maps: bool = False) -> DataFrame:
    """Spans of the detectors, overlaps included.  Rules repeat as loops and in one way only, and functions yield NULLs for bad
    input, so no text takes a detector down.  With maps (columns map_start, map_end of `prepare_text`), spans come with
    offsets of the source; only the stretch of the maps that a match can reach travels with it."""
    keep = [c for c in docs.columns if c not in (text, *(("map_start", "map_end") if maps else ()))]
    rows = docs.select(*keep, F.explode(_found(tuple(detectors), text, maps)).alias("_m"))
    order = F.expr("array(" + ", ".join(str(d.order) for d in detectors) + ")")
    spans = (rows.select(*keep, order[F.col("_m.d")].alias("detector"), F.explode(_read(tuple(detectors), "_m")).alias("s"),
                         *(["_m._base", "_m.map_start", "_m.map_end"] if maps else []))
             .select(*keep, "detector", "s.*", *(["_base", "map_start", "map_end"] if maps else [])))
    if not maps:
        return spans
    return (spans.withColumn("start", F.when(F.col("map_start").isNull(), F.col("start")).otherwise(
                source_start(F.col("start") - F.col("_base"), F.col("map_start"))))
            .withColumn("end", F.when(F.col("map_end").isNull(), F.col("end")).otherwise(
                source_end(F.col("end") - F.col("_base"), F.col("map_end")))).drop("_base", "map_start", "map_end"))


# ------------------------------------------------------------------ numbers and classes

def scan_numbers(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every number of a text, tolerating OCR letters, spaces and line breaks: doc columns + start, end, number_text."""
    keep = [c for c in docs.columns if c != text]
    return (docs.select(*keep, F.explode(numbers(F.col(text))).alias("m"))
            .select(*keep, "m.start", "m.end", F.col("m.match").alias("number_text")))


def known_run(left: Column) -> Column:
    """The class words that end the text on the left of a number."""
    n = F.length(F.regexp_extract(F.regexp_replace(fold_same_length(left), P.BEFORE_RUN, ""), P.KNOWN_RUN, 0))
    return let(n, lambda k: F.when(k > 0, F.substring(left, F.length(left) - k + 1, k)))


def _suffixes(run: Column) -> Column:
    """The text from each word on, farthest first."""
    return let(F.split(run, r"(?U)(?<=\s)(?=\S)"), lambda words: F.transform(
        F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), "")))


def _read_class(text: Column) -> Column:
    return F.struct(text.alias("text"), canonical_class(text).alias("acr"))


def _first_read(texts: Column, valid: Callable[[Column], Column]) -> Column:
    """The first text whose class reading is valid; later ones are not read."""
    start = F.struct(F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("acr"))
    return F.aggregate(texts, start, lambda acc, t: F.when(acc["text"].isNotNull(), acc).otherwise(
        let(_read_class(t), lambda x: F.when(valid(x), x).otherwise(acc))))


def _is_class_text(x: Column) -> Column:
    return ((F.size(known_acronyms(x["acr"])) > 0)
            & F.forall(x["acr"], lambda a: ~a.startswith("?")
                       | F.substring(a, F.lit(2), F.length(a)).isin(NEUTRAL_WORDS))
            & ~x["text"].rlike(r"(?U)(?<!\S)e\s*$")
            & ~(F.array_contains(x["acr"], "E") & x["text"].rlike(r"(?U)(?<!\S)e(?!\S)")))


def anchor_class(left: Column) -> Column:
    """struct(text, acr, court) of the farthest start from which a class runs up to the number; text is NULL
    when there is none."""
    def trim(x: Column) -> Column:
        return let(F.regexp_replace(x["text"], P.CLASS_TRIM, ""), lambda t: F.when(t == x["text"], x).otherwise(_read_class(t)))

    def accept(x: Column) -> Column:
        court = F.filter(x["acr"], lambda a: a.isin(["?" + c for c in COURTS]))
        return let(known_acronyms(x["acr"]), lambda acr: F.struct(
            F.when((F.size(acr) > 0) & ~F.trim(x["text"]).rlike("^[a-zà-ú]{1,4}$"), x["text"]).alias("text"), acr.alias("acr"),
            F.substring(F.try_element_at(court, F.lit(1)), 2, 3).alias("court")))
    return let(let(_first_read(_suffixes(known_run(left)), _is_class_text), trim), accept)


def docket_chains(text: Column) -> Column:
    """array<struct<start, end, items>>: numbers of a text with the internal appeals and the state after them; numbers that only an 'e' links are one
    chain ('1.741.784/PR e 1.996.496/RJ').  Numbers that stand after a break sign, where no class can be, are left out."""
    def with_tail(n: Column) -> Column:
        suffix = F.regexp_extract(n["tail"], "^" + P.INTERNAL_SUFFIX, 0)
        return let(suffix, lambda x: let(F.regexp_extract(F.substring(n["tail"], F.length(x) + 1, F.length(n["tail"])), "(?U)^" + P.UF_RIGHT, 0), lambda uf: F.struct(
            n["start"].alias("start"), (n["end"] + F.length(x) + F.length(uf)).alias("end"), n["match"].alias("run"), x.alias("suffix"),
            _group(uf, "([A-Z]{2})", 1).alias("uf"), (F.length(x) + F.length(uf)).alias("used"), n["end"].alias("stop"), n["lead"].alias("lead"),
            n["tail"].alias("tail"), n["first"].alias("first"), n["apart"].alias("apart"))))

    def linked(items: Column, i: Column) -> Column:
        last, this = items[i - 1], items[i]
        between = F.when(this["first"], F.concat(last["tail"], this["lead"])).otherwise(this["lead"])
        return (i > 0) & (F.length(between) == this["start"] - last["stop"]) & F.substring(between, last["used"] + 1, F.length(between)).rlike(P.LINK)

    def grouped(items: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: ~linked(items, i))

        def chain(heads: Column) -> Column:
            return F.transform(heads, lambda h, k: F.slice(items, h + 1, F.coalesce(F.get(heads, k + 1), F.size(items)) - h))
        return F.transform(F.filter(let(heads, chain), lambda c: ~c[0]["apart"]), lambda c: F.struct(c[0]["start"].alias("start"), F.element_at(c, -1)["end"].alias("end"),
            F.transform(c, lambda x: F.struct((x["start"] - c[0]["start"]).alias("start"), (x["end"] - c[0]["start"]).alias("end"), x["run"].alias("run"),
                                              x["suffix"].alias("suffix"), x["uf"].alias("uf"))).alias("items")))
    return let(F.transform(numbers(text, beside=True), with_tail), lambda items: F.when(F.size(items) > 0, grouped(items)))


def _docket_items(items: Column) -> Column:
    return F.transform(items, lambda x: let(repair_digits(x["run"]), lambda d: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["run"].alias("run"), x["suffix"].alias("suffix"),
        x["uf"].alias("uf"), docket_of_digits(d).alias("number"), d.alias("digits"))))


def _inherits(prev: Column, x: Column) -> Column:
    similar = F.abs(F.length(x["digits"]) - F.length(F.regexp_replace(prev["number"], "[^0-9]", ""))) <= 1
    return F.coalesce(
        (is_cnj(x["number"]) == is_cnj(prev["number"])) & similar & ~x["run"].rlike(r"^\s*(?:19|20)\d\d\s*$")
        & (is_cnj(x["number"]) | (prev["uf"].isNotNull() & x["uf"].isNotNull())), F.lit(False))


def _refused(class_text: Column, first: Column, after: Column) -> Column:
    """A year, a number in another paragraph, the day of a date, a paragraph number."""
    short = F.length(first["digits"]) <= 2
    return ((first["run"].rlike(r"^\s*(?:19|20)\d\d\s*$") & class_text.rlike(r"(?iU)\b(?:de|em)\s*$"))
            | (F.contains(class_text, F.lit("\n")) & class_text.rlike("\n[ \t ]*\n")) | (short & after.rlike(r"^/\d{1,2}\b"))
            | (short & class_text.rlike(r"(?U)[A-Za-zÀ-ú]{3,}\.\s+$")) | first["number"].isNull())


def _docket_spans(m: Column) -> Column:
    def spans(x: Column) -> Column:
        a, items = x["a"], x["items"]
        linked = F.transform(items, lambda it, i: (i == 0) | _inherits(items[F.greatest(i - 1, F.lit(0))], it))
        count = let(F.array_position(linked, F.lit(False)).cast("int"),
                    lambda p: F.when(p > 0, p - 1).otherwise(F.size(items)))
        rows = F.transform(F.slice(items, F.lit(1), count), lambda it, i: _span(
            F.concat(F.when(i == 0, a["text"]).otherwise(""), it["run"], it["suffix"], F.coalesce(it["uf"], F.lit(""))),
            kind=F.lit("acordao"), end=m["start"] + it["end"],
            start=F.when(i == 0, m["start"] - F.length(a["text"])).otherwise(m["start"] + it["start"]),
            number=it["number"], uf=it["uf"], court=a["court"],
            **{"class": F.concat(F.when(it["suffix"] == "", F.array().cast("array<string>")).otherwise(
                F.reverse(known_acronyms(canonical_class(it["suffix"])))), a["acr"])}))
        return F.when(~_refused(a["text"], items[0], m["right"]), rows)

    def with_items(a: Column) -> Column:
        pair = F.struct(a.alias("a"), _docket_items(m["items"]).alias("items"))
        return F.when(a["text"].isNotNull(), let(pair, spans))
    return let(anchor_class(m["left"]), with_items)


# ------------------------------------------------------------------ súmulas and themes

def sumula_key(court: Column, binding: Column, n: Column) -> Column:
    return F.when(court.isNotNull(), F.concat(F.lit("sumula|"), court, F.lit("|"), binding.cast("string"),
                                              F.lit("|"), n))


def article_key(law: Column, n: Column) -> Column:
    return F.concat(F.lit("artigo|"), law, F.lit("|"), n)


def plain_int(raw: Column) -> Column:
    return F.regexp_replace(repair_digits(raw), "^0+(?!$)", "")


def _court_of(text: Column) -> Column:
    return F.when(text.isNotNull(), court_code(text))


def _plural_spans(m: Column) -> Column:
    """'Súmulas 5, 7 e 83/STJ': one span per number; the first starts at the head, the last ends at the court."""
    lead = F.length(F.regexp_extract(m["match"], P.SUMULAS, 1))
    court = _court_of(_group(m["match"], P.COURT_AT_END, 1))

    def place(x: Column) -> Column:
        nums = x["nums"]
        at = F.transform(nums, lambda v, i: F.struct(
            F.when(i == 0, 0).otherwise(x["lead"] + v["start"]).alias("a"),
            F.when(i == F.size(nums) - 1, F.length(m["match"])).otherwise(x["lead"] + v["end"]).alias("b"),
            v["match"].alias("n")))
        return F.transform(at, lambda v: _span(
            F.substring(m["match"], v["a"] + 1, v["b"] - v["a"]), kind=F.lit("sumula"), start=m["start"] + v["a"],
            end=m["start"] + v["b"], court=x["court"], norm_key=sumula_key(x["court"], F.lit(False), plain_int(v["n"]))))
    return let(F.struct(lead.alias("lead"), court.alias("court"),
                        match_spans(F.regexp_extract(m["match"], P.SUMULAS, 2), P.SUMULA_NUMBER).alias("nums")), place)


def _sumula_spans(m: Column) -> Column:
    """Head, binding, number and court of one match; a heading that other bodies use too counts with a court or 'da Súmula' only."""
    read = F.struct(F.lower(F.regexp_extract(m["match"], P.SUMULA_HEAD, 1)).alias("head"), m["match"].rlike(P.SUMULA_BINDING).alias("binding"),
                    F.regexp_extract(m["match"], P.SUMULA, 1).alias("n"), m["match"].rlike(P.SUMULA_OF).alias("of_sumula"),
                    _court_of(_group(m["match"], P.COURT_AT_END, 1)).alias("named"))

    def span(x: Column) -> Column:
        court = F.coalesce(x["named"], F.when(x["binding"], F.lit("STF")))
        loose = x["head"].isin("enunciado", "verbete") & ~x["of_sumula"] & x["named"].isNull()
        return F.when(~loose, F.array(_span(
            m["match"], kind=F.lit("sumula"), start=m["start"], end=m["end"], court=court,
            norm_key=sumula_key(court, x["binding"], plain_int(x["n"])))))
    return let(read, span)


def _theme_spans(m: Column) -> Column:
    return F.array(_span(m["match"], kind=F.lit("tema"), start=m["start"], end=m["end"],
                         number=repair_digits(F.regexp_extract(m["match"], P.THEME, 1))))


# ------------------------------------------------------------------ articles

def _article_spans(m: Column) -> Column:
    """'art. 373, I, do CPC': the law is read from the text after the article; no law, no span."""
    return let(read_law(m["right"]), lambda law: F.when(law["code"].isNotNull(), F.array(_span(
        F.concat(m["match"], F.substring(m["right"], F.lit(1), law["length"])), kind=F.lit("artigo"), start=m["start"],
        end=m["end"] + law["length"], law=law["code"],
        norm_key=article_key(law["code"], plain_int(F.regexp_extract(m["match"], P.ARTICLE, 1)))))))


def _inverse_article_spans(m: Column) -> Column:
    """'CPC, art. 1.022': the name before the article must be a law by itself."""
    name = F.regexp_extract(m["match"], P.ARTICLE_INVERSE, 1)
    law = F.coalesce(law_code_from_number(name), law_code_from_name(name))
    return let(law, lambda x: F.when(x["length"] == F.length(name), F.array(_span(
        m["match"], kind=F.lit("artigo"), start=m["start"], end=m["end"], law=x["code"],
        norm_key=article_key(x["code"], plain_int(F.regexp_extract(m["match"], P.ARTICLE_INVERSE, 2)))))))


# ------------------------------------------------------------------ decisions without a number

def _decision_head(text: Column) -> Column:
    """The head that ends a text: 'julgado', 'acórdão', ... or a class, without leading connectives."""
    word = F.regexp_extract(text, r"(?iuU)(?<!\S)" + P.HEAD_WORDS + r"\s*$", 0)
    segments = F.filter(F.transform(_suffixes(known_run(text)), lambda s: F.regexp_replace(
        s, rf"(?iU)^(?:{P.CONNECTIVES}\s+)+", "")), lambda s: s != "")
    as_class = _first_read(segments, lambda x: (F.size(x["acr"]) > 0)
                           & F.forall(x["acr"], lambda a: ~a.startswith("?")))["text"]
    return let(word, lambda w: F.when(w != "", w).otherwise(as_class))


def _incomplete_spans(m: Column) -> Column:
    """A decision without a number: head, optional court, year and rapporteur; the year on either side of the name."""
    tail = F.regexp_extract(F.right(m["left"], F.lit(YEAR_WINDOW_LEFT)), P.YEAR_BEFORE, 0)
    ahead = F.regexp_extract(m["right"], P.YEAR_AFTER, 0)
    year_after = F.regexp_extract(m["right"], P.YEAR_AFTER, 1)

    def with_year(y: Column) -> Column:
        before = F.length(y["tail"]) > 0
        window = F.right(F.substring(m["left"], F.lit(1), F.length(m["left"]) - F.length(y["tail"])), F.lit(HEAD_WINDOW))

        def with_middle(w: Column) -> Column:
            middle = F.when(before, F.regexp_extract(w, P.MIDDLE_YEAR, 0)) \
                .otherwise(F.regexp_extract(w, P.MIDDLE_RAPPORTEUR, 0))
            court = _group(middle, P.COURT_INSIDE, 1)

            def with_head(k: Column) -> Column:
                head = _decision_head(F.substring(w, F.lit(1), F.length(w) - F.length(k["middle"])))
                return F.when(~before | (k["middle"] != ""), let(head, lambda h: F.when(h.isNotNull(), F.array(_span(
                    F.concat(h, k["middle"], y["tail"], m["match"], F.when(before, "").otherwise(y["ahead"])),
                    kind=F.lit("incompleta"), court=_court_of(k["court"]),
                    start=m["start"] - F.length(y["tail"]) - F.length(k["middle"]) - F.length(h),
                    end=m["end"] + F.when(before, 0).otherwise(F.length(y["ahead"])),
                    year=F.when(before, F.substring(y["tail"], 1, 4)).otherwise(y["year_after"]),
                    rapporteur=F.regexp_extract(m["match"], P.RAPPORTEUR, 2))))))
            return let(F.struct(middle.alias("middle"), court.alias("court")), with_head)
        return F.when(before | (y["year_after"] != ""), let(window, with_middle))
    return let(F.struct(tail.alias("tail"), ahead.alias("ahead"), year_after.alias("year_after")), with_year)


# ------------------------------------------------------------------ detectors as jobs

INCOMPLETE = Detector("incomplete", 0, P.RAPPORTEUR, _incomplete_spans, YEAR_WINDOW_LEFT + HEAD_WINDOW,
                      YEAR_WINDOW_RIGHT)
SUMULAS = Detector("sumulas", 1, P.SUMULAS, _plural_spans)
SUMULA = Detector("sumula", 2, P.SUMULA, _sumula_spans)
THEME = Detector("theme", 3, P.THEME, _theme_spans)
ARTICLE = Detector("article", 4, P.ARTICLE, _article_spans, right=LAW_WINDOW)
ARTICLE_INVERSE = Detector("article_inverse", 5, P.ARTICLE_INVERSE, _inverse_article_spans)
DOCKET = Detector("docket", 6, None, _docket_spans, left=CLASS_WINDOW, right=4, find=docket_chains)
DETECTORS = [INCOMPLETE, SUMULAS, SUMULA, THEME, ARTICLE, ARTICLE_INVERSE, DOCKET]


def extract_incomplete(docs: DataFrame, text: str = "text") -> DataFrame:
    return run_detectors(docs, [INCOMPLETE], text)


def extract_sumulas(docs: DataFrame, text: str = "text") -> DataFrame:
    return run_detectors(docs, [SUMULAS, SUMULA], text)


def extract_sumulas_plural(docs: DataFrame, text: str = "text") -> DataFrame:
    return run_detectors(docs, [SUMULAS], text)


def extract_themes(docs: DataFrame, text: str = "text") -> DataFrame:
    return run_detectors(docs, [THEME], text)


def extract_articles(docs: DataFrame, text: str = "text") -> DataFrame:
    return run_detectors(docs, [ARTICLE], text)


def extract_articles_inverse(docs: DataFrame, text: str = "text") -> DataFrame:
    return run_detectors(docs, [ARTICLE_INVERSE], text)


def extract_dockets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Decisions cited by number: a class on the left, optional internal appeals and state on the right; numbers of
    an enumeration inherit the class."""
    return run_detectors(docs, [DOCKET], text)


def extract_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    return run_detectors(docs, DETECTORS, text)


def extract_all(docs: DataFrame, text: str = "text") -> DataFrame:
    """Disjoint spans of all detectors, with offsets on the source text."""
    keep = [c for c in docs.columns if c != text]
    prepared = prepare_text(docs, text).select(*keep, "prepared", "map_start", "map_end")
    return resolve_overlaps(run_detectors(prepared, DETECTORS, "prepared", maps=True))


@dataclass(frozen=True)
class CustomDetector:
    """A user's own detector: find(text) yields (start, end, kind) and may raise."""
    name: str
    order: int
    find: Callable[[str], Iterable[tuple[int, int, str]]]


def run_custom(docs: DataFrame, detectors: list[CustomDetector], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(spans, quarantine) of users' detectors.  A detector that raises on a document loses only its spans of that document: the quarantine has one row
    for each such pair, with doc columns, detector, error (its class) and message.  Spans outside the text are an error too; a null text has none.
    Texts are read in Arrow batches in one pass for all detectors; that pass is written once, so a failing detector is not run twice."""
    keep = [c for c in docs.columns if c != text]
    found = "array<struct<detector:int,start:int,end:int,kind:string,error:string,message:string>>"

    def one(d: CustomDetector, t: str) -> list[dict]:
        try:
            spans = [(int(s), int(e), str(k)) for s, e, k in d.find(t)]
            if any(not 0 <= s < e <= len(t) for s, e, _ in spans):
                raise ValueError("a span outside the text")
            return [{"detector": d.order, "start": s, "end": e, "kind": k, "error": None, "message": None} for s, e, k in spans]
        except Exception as e:  # noqa: BLE001  (whatever a user's rule raises is quarantined)
            return [{"detector": d.order, "start": None, "end": None, "kind": None, "error": type(e).__name__, "message": str(e)[:200]}]

    @F.pandas_udf(found)
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [x for d in detectors for x in one(d, t)])
    names = F.element_at(F.create_map(*[F.lit(x) for d in detectors for x in (d.order, d.name)]), F.col("detector"))
    rows = stored(docs.select(*keep, F.explode(scan(F.col(text))).alias("_x")).select(*keep, "_x.*"), "custom-spans")
    spans = rows.filter("error IS NULL").select(*keep, "detector", *[
        (F.col(c) if c in ("kind", "start", "end") else F.lit(False) if c == "noisy" else F.lit(None)).cast(t).alias(c) for c, t in _FIELDS.items()])
    return spans, rows.filter("error IS NOT NULL").select(*keep, names.alias("detector"), "error", "message")


def extract_isolated(docs: DataFrame, custom: list[CustomDetector], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(disjoint spans of the detectors of this library and of users' ones, quarantine of the latter).  Offsets are those of the source text."""
    keep = [c for c in docs.columns if c != text]
    prepared = prepare_text(docs, text).select(*keep, "prepared", "map_start", "map_end")
    own, failed = run_custom(docs, custom, text)
    return resolve_overlaps(run_detectors(prepared, DETECTORS, "prepared", maps=True).unionByName(own)), failed
