"""Column expressions for docket numbers (plain numbers and 20-digit CNJ numbers)."""
from pyspark.sql import Column, functions as F

from citegrove.functions.spans import let
from citegrove.rules import JUSTICE_COURT, OCR_LETTER_DIGITS, OCR_LETTERS


def repair_digits(col: Column) -> Column:
    """Look-alike letters back to digits, everything else dropped: '1.528.4S5' -> '1528455'."""
    return F.regexp_replace(F.translate(col, OCR_LETTERS, OCR_LETTER_DIGITS), "[^0-9]", "")


def canonical_docket(col: Column) -> Column:
    """Plain digits without leading zeros, or 'NNNNNNN-DD.AAAA.J.TR.OOOO' from 14 digits on; NULL when the
    sequence is longer than 7 digits or there is no digit."""
    return let(repair_digits(col), docket_of_digits)


def docket_of_digits(d: Column) -> Column:
    """`canonical_docket` of digits that are read already."""
    n = F.length(d)

    def part(back: int, size: int) -> Column:
        return F.substring(d, n - F.lit(back - 1), F.lit(size))
    cnj = F.concat(F.lpad(F.substring(d, F.lit(1), n - 13), 7, "0"), F.lit("-"), part(13, 2), F.lit("."),
                   part(11, 4), F.lit("."), part(7, 1), F.lit("."), part(6, 2), F.lit("."), part(4, 4))
    return (F.when(n == 0, F.lit(None).cast("string"))
            .when(n > 20, F.lit(None).cast("string"))
            .when(n >= 14, cnj)
            .when(F.startswith(d, F.lit("0")), F.regexp_replace(d, "^0+(?!$)", ""))
            .otherwise(d))


def is_cnj(col: Column) -> Column:
    return F.coalesce(F.contains(col, F.lit(".")), F.lit(False))


def cnj_segment(col: Column) -> Column:
    """The justice digit of a CNJ number; NULL for plain numbers."""
    return F.when(is_cnj(col), F.substring(col, 17, 1))


def cnj_check_ok(col: Column) -> Column:
    """Check digit (mod 97).  The 20-digit operand would overflow BIGINT, so the trailing '00' is applied after
    a first reduction of the 18 leading digits."""
    head = F.concat(F.substring(col, 1, 7), F.substring(col, 12, 4), F.substring(col, 17, 1),
                    F.substring(col, 19, 2), F.substring(col, 22, 4)).try_cast("bigint")
    dv = F.substring(col, 9, 2).try_cast("bigint")
    return F.when(is_cnj(col), F.lit(98) - ((head % 97) * 100) % 97 == dv).otherwise(F.lit(False))


def justice_court(col: Column) -> Column:
    """Superior court implied by the justice digit of a CNJ number; NULL when there is none."""
    table = F.create_map(*[F.lit(x) for kv in JUSTICE_COURT.items() for x in kv])
    return F.try_element_at(table, cnj_segment(col))
