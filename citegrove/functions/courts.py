"""Column expressions for courts, states and rapporteurs."""
from pyspark.sql import Column, functions as F

from citegrove.functions.literals import map_literal
from citegrove.functions.text import strip_accents
from citegrove.rules import STATES


def court_code(col: Column) -> Column:
    """'Superi0r Tribunal de Justiça' | '5TJ' | 'STJ' -> 'STJ'."""
    t = F.translate(F.upper(strip_accents(col)), "051Ｔ", "OSLT")
    out = F.when(F.contains(t, F.lit("SUPREMO")), "STF")
    for key, code in (("JUSTI", "STJ"), ("TRABA", "TST"), ("ELEITORA", "TSE"), ("MILITA", "STM")):
        out = out.when(F.contains(t, F.lit(key)), code)
    return out.otherwise(t)


def state_code(col: Column) -> Column:
    return F.try_element_at(map_literal(STATES), F.trim(F.upper(strip_accents(col))))


def normalise_rapporteur(col: Column) -> Column:
    r = F.regexp_replace(F.trim(F.coalesce(col, F.lit(""))),
                         r"(?i)^(?:Min(?:istr[oa])?\.?|Des(?:embargador[a]?)?\.?)\s+", "")
    return F.when(r.rlike("^[A-ZÁÉÍÓÚÂÊÔÃÕÇ]"), r)
