"""Numbers of a text with their places, in one pass.

A zone is a longest stretch of signs that can stand in or between the pieces of a number and that holds a digit; zones are found without
going back, each sign is read once. A zone is then cut at white space, every word is read into a token, and a fold over the tokens with a state
of fixed size puts runs of tokens together.
"""
from pyspark.sql import Column, functions as F

from citegrove.functions.grammar import one_of
from citegrove.functions.spans import _CLOSE, _OPEN, WHOLE, _positions, let, unmarked
from citegrove.rules import CLASS_SPELLINGS, OCR_LETTERS, UFS

LINKS = r".\-–—"
_BREAKS = "/(),;:"
_WORD_SIGN, _SEPARATOR = rf"[^\s{_BREAKS}]", rf"[\s{_BREAKS}]"
_LOOSE_SIGNS = rf"{OCR_LETTERS}{LINKS}\s"
ZONE = rf"(?U)(?<![\d{_LOOSE_SIGNS}])[{_LOOSE_SIGNS}]*+\d[\d{_LOOSE_SIGNS}]*+"
# what may be glued to a number: before it an ordinal sign, an acronym with a hyphen or 'n.'; after it a hyphen with letters or a state that no
# other state follows.  Groups: 1 what stands before, 2 the signs of the number
_BEFORE = one_of(".*[º°]", ".*[A-Za-z]{2}-", r"(?:.*[^A-Za-z])?[nN]\.")
_STATE = one_of(*UFS) + rf"\b(?!\s*[/\-–(]\s*[A-Z]{{2}}\b)"
_AFTER = one_of(r"-[A-Za-z]{2}\b", r"(?<=\d)-[A-Za-z]{2}", rf"(?<=\d){_STATE}") + _WORD_SIGN + "*+"
WORD = rf"(?U)^({_BEFORE}?)([\d{OCR_LETTERS}{LINKS}]+?)({_AFTER})?(?={_SEPARATOR}|$)"
ORDINAL = "^" + one_of("[nN][º°.]+", "N[º°o.]*") + "$"
# loose letters that are a class by themselves unless they stand within a number or after an ordinal
CLASS_LIKE = sorted({w.lower() for _, spellings in CLASS_SPELLINGS for w in spellings if len(w) <= 2 and set(w) <= set(OCR_LETTERS)})
# the usual zone: numeric words without two letters beside each other, before them at most the end of some other word, which _GLUED marks (_WORDED, if the
# part before the zone ends with two letters: an acronym whose hyphen links it to the first numeric word), after them words without a digit, as many as there
# are: none of these opens a run, and whichever closes it, it ends with the last numeric word.  The last one may be the start of some other word.
# If _CALM says that no sign after the zone could be read with its last word (_HEADS), the word before may be such an acronym, end with one link ('n.',
# 'Esp.') or be an ordinal sign that a blank follows.  Group 1: the numeric words
_GLUED, _WORDED, _CALM = "x", "y", "+"
_HEADS = "[º°]|[A-Za-z]{2}-|[nN][.]"
_NUMERIC = rf"(?!\S*[A-Za-z]{{2}})[{OCR_LETTERS}{LINKS}]*+\d[\d{OCR_LETTERS}{LINKS}]*+"
_WORD_END = f"[{_GLUED}{_WORDED}][A-Za-z|!]*+"
PLAIN_ZONE = (rf"(?U)^(?:[{_CALM}]{_WORDED}[A-Za-z]*+-(?=\S)|{_WORD_END}(?=\s)|[{_CALM}](?:{_WORD_END}[{LINKS}]?+|[º°])(?=\s))?+\s*+"
              rf"({_NUMERIC}(?:\s++{_NUMERIC})*+)(?:\s\D*+)?+$")
# the part before a zone ends with two letters, and no ordinal sign stands in that word
_ACRONYM = rf"(?U)(?:^|[\s{_BREAKS}])[^\s{_BREAKS}º°]*[A-Za-z]{{2}}$"
CONTEXT = 96
NUMBER_TYPE = "array<struct<start:int,end:int,match:string,lead:string,tail:string,first:boolean,apart:boolean>>"


def zones(text: Column) -> Column:
    """array<struct<start, match, lead, tail>>: every zone with the text up to the zones beside it; NULL without one."""

    def beside(pieces: Column) -> Column:
        between = F.transform(pieces, lambda p: F.substring_index(p, _CLOSE, -1))
        n = F.size(pieces) - 1
        left = F.zip_with(_positions(pieces), F.slice(between, F.lit(1), n), lambda z, t: F.struct(z["start"].alias("start"), z["match"].alias("match"), t.alias("lead")))
        return F.when(n > 0, F.zip_with(left, F.slice(between, F.lit(2), n), lambda z, t: F.struct(
            z["start"].alias("start"), z["match"].alias("match"), z["lead"].alias("lead"), F.left(t, F.lit(CONTEXT)).alias("tail"))))
    return let(F.split(F.regexp_replace(unmarked(text), ZONE, WHOLE), _OPEN), beside)


def _token(word: Column, before: Column, after: Column) -> Column:
    """One word of a zone, with what stands before it (first word) and after it (last word) in the text.  kind: N numeric, K links only, M one or two
    loose letters, C such letters that are a class, X anything else, empty: no word.  from, to: its signs, counted from the start of the word."""
    whole = F.concat(before, word, after)
    seen = F.struct(whole.alias("whole"), F.length(before).alias("shift"), F.length(word).alias("size"), F.regexp_extract(whole, WORD, 1).alias("head"),
                    F.regexp_extract(whole, WORD, 2).alias("core"), F.regexp_extract(whole, WORD, 3).alias("glued"))

    def read(s: Column) -> Column:
        bare = F.regexp_replace(s["core"], f"[{LINKS}]", "")
        kind = let(bare, lambda b: F.when(F.substring(s["whole"], 1, 1).rlike(rf"(?U)^(?:[\s{_BREAKS}]|$)"), "").when(s["core"] == "", "X").when(b == "", "K")
                   .when(b.rlike(r"(?U)\d"), "N").when((F.length(b) > 2) | (b == "o"), "X").when(F.lower(b).isin(CLASS_LIKE), "C").otherwise("M"))
        start = F.length(s["head"]) - s["shift"]
        return F.struct(kind.alias("kind"), s["size"].alias("size"), start.alias("from"),
                        (start + F.length(F.regexp_replace(s["core"], r"[.\-–]+$", ""))).alias("to"), (s["head"] != "").alias("fresh"),
                        (s["glued"] != "").alias("cut"), s["head"].rlike("[º°]$").alias("marked"), s["whole"].rlike(ORDINAL).alias("ordinal"))
    return let(seen, read)


_RUNS = "array<struct<start:int,end:int>>"
_STATE_TYPE = f"struct<at:int,open:int,stop:int,wait:int,last:string,out:{_RUNS}>"


def _step(s: Column, t: Column) -> Column:
    """Numeric tokens open or lengthen a run; loose letters wait for one; what is neither closes it.  Links change nothing."""
    last = F.when(t["marked"], "O").when(t["fresh"], "X").otherwise(s["last"])
    loose = (t["kind"] == "M") | ((t["kind"] == "C") & last.isin("N", "O"))
    closes = t["fresh"] | (t["kind"] == "X") | ((t["kind"] == "C") & ~loose)
    start, end = s["at"] + t["from"], s["at"] + t["to"]
    open_ = F.when(closes, -1).otherwise(s["open"])
    wait = F.when(closes, -1).otherwise(s["wait"])
    numeric = t["kind"] == "N"
    now = F.when(~numeric, open_).when(open_ >= 0, open_).when(wait >= 0, wait).otherwise(start)
    stop = F.when(numeric, end).otherwise(s["stop"])
    cut = t["cut"] & (now >= 0)
    run = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
    ended = closes & (s["open"] >= 0)
    out = F.when(ended & cut, F.concat(s["out"], run(s["open"], s["stop"]), run(now, stop))).when(ended, F.concat(s["out"], run(s["open"], s["stop"]))) \
        .when(cut, F.concat(s["out"], run(now, stop))).otherwise(s["out"])
    moved = F.struct((s["at"] + t["size"] + 1).alias("at"), F.when(t["cut"], -1).otherwise(now).alias("open"), stop.alias("stop"),
                     F.when(numeric | t["cut"], -1).when(loose & (wait < 0), start).otherwise(wait).alias("wait"),
                     F.when(t["ordinal"], "O").when(t["cut"], "X").otherwise(t["kind"]).alias("last"), out.alias("out"))
    empty = F.struct((s["at"] + t["size"] + 1).alias("at"), *[s[c].alias(c) for c in ("open", "stop", "wait", "last", "out")])
    return F.when(t["kind"] == "", empty).otherwise(moved).cast(_STATE_TYPE)


def _runs(zone: Column) -> Column:
    """Runs of one zone, as places within it."""
    before = F.regexp_extract(F.right(zone["lead"], F.lit(24)), rf"(?U){_WORD_SIGN}*$", 0)
    after = F.substring(zone["tail"], 1, 16)

    def tokens(words: Column) -> Column:
        return F.transform(words, lambda w, i: _token(w, F.when(i == 0, before).otherwise(""), F.when(i == F.size(words) - 1, after).otherwise("")))
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("open"), F.lit(0).alias("stop"), F.lit(-1).alias("wait"), F.lit("").alias("last"),
                     F.array().cast(_RUNS).alias("out")).cast(_STATE_TYPE)
    end = lambda s: F.when(s["open"] >= 0, F.concat(s["out"], F.array(F.struct(s["open"].alias("start"), s["stop"].alias("end"))))).otherwise(s["out"])
    return F.aggregate(let(F.split(zone["match"], r"(?U)\s", -1), tokens), start, _step, end)


def _plain_runs(zone: Column) -> Column:
    """The one run of a usual zone; NULL for other zones."""
    last, next_ = F.right(zone["lead"], F.lit(1)), F.substring(zone["tail"], 1, 1)
    calm = F.when(F.substring(zone["tail"], 1, 16).rlike(_HEADS), "").otherwise(_CALM)
    glued = F.when(last.isin("º", "°"), last).when(F.right(zone["lead"], F.lit(24)).rlike(_ACRONYM), _WORDED).otherwise(_GLUED)
    before = F.when((last == "") | last.rlike(f"[{_BREAKS}]"), "").otherwise(F.concat(calm, glued))
    after = F.when((next_ == "") | next_.rlike(f"[{_BREAKS}]"), "").otherwise(_GLUED)
    marked = F.struct(F.concat(before, zone["match"], after).alias("text"), F.length(before).alias("shift"))

    def run(m: Column) -> Column:
        # no digit comes before the words, so they are first found where they stand
        return let(F.regexp_extract(m["text"], PLAIN_ZONE, 1), lambda words: F.when(words != "", let(
            F.position(words, m["text"]) - 1 - m["shift"], lambda start: F.array(F.struct(
                start.alias("start"), (start + F.length(F.regexp_replace(words, r"[.\-–]+$", ""))).alias("end"))))))
    return let(marked, run)


def numbers(text: Column, beside: bool = False) -> Column:
    """Every number of a text in order: place and text.  With `beside` also the text of its zone before it (from the number before on), the text
    after it, whether it is the first one of its zone, and whether it stands apart (a sign that ends a number comes before it).  NULL without a zone."""
    def of_zone(z: Column) -> Column:
        def placed(runs: Column) -> Column:
            def number(r: Column, i: Column) -> Column:
                found = [(z["start"] + r["start"]).alias("start"), (z["start"] + r["end"]).alias("end"),
                         F.substring(z["match"], r["start"] + 1, r["end"] - r["start"]).alias("match")]
                if not beside:
                    return F.struct(*found)
                from_ = F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["end"])
                return F.struct(
                    *found, let(from_, lambda f: F.substring(z["match"], f + 1, r["start"] - f)).alias("lead"),
                    F.substring(F.concat(F.substring(z["match"], r["end"] + 1, F.lit(CONTEXT)), z["tail"]), 1, CONTEXT).alias("tail"), (i == 0).alias("first"),
                    ((i == 0) & F.substring(z["match"], 1, r["start"]).rlike(r"(?U)^\s*$") & z["lead"].rlike(r"[,;:()]$")).alias("apart"))
            return F.transform(runs, number)
        return let(let(_plain_runs(z), lambda plain: F.coalesce(plain, _runs(z))), placed)
    return F.flatten(F.transform(zones(text), of_zone)).cast(NUMBER_TYPE if beside else "array<struct<start:int,end:int,match:string>>")
