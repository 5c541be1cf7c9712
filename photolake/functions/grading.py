"""Grades, reasons and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photolake import schema as S


def grade(sharpness: Column, over: Column, under: Column, score: Column, sharp_at: float, good_at: float) -> Column:
    bad = (sharpness < sharp_at) | over | under
    return F.when(bad, F.lit(S.BAD)).when(score >= good_at, F.lit(S.GOOD)).otherwise(F.lit(S.OK))


def _fixed(x: Column, digits: int) -> Column:
    """Text of a number with ``digits`` decimals, ties to the even digit."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits).cast("double"))


def reason(sharpness: Column, over: Column, under: Column, score: Column, sharp_at: float) -> Column:
    """Faults in a fixed order, or the aesthetic score of a photo that has none."""
    faults = F.concat_ws(", ", F.when(sharpness < sharp_at, F.concat(F.lit("Blurry (sharpness: "), _fixed(sharpness, 0), F.lit(")"))), F.when(over, F.lit("Overexposed")), F.when(under, F.lit("Underexposed")))
    return F.when(faults != "", faults).otherwise(F.concat(F.lit("Aesthetic score: "), _fixed(score, 1), F.lit("/10")))


def shown_reason(stored: Column, source: Column, grade_: Column, sharpness: Column, score: Column, sharp_at: float) -> Column:
    """The stored reason, else one from the scores of an automatic grade, else null."""
    auto = F.when((grade_ == S.BAD) & (sharpness < sharp_at), F.concat(F.lit("Blurry (sharpness: "), _fixed(sharpness, 0), F.lit(")")))
    auto = auto.when(grade_ == S.BAD, F.lit("Exposure issue (over/underexposed)")).when(score.isNotNull(), F.concat(F.lit("Aesthetic: "), _fixed(score, 1)))
    return F.coalesce(stored, F.when(source == S.AUTO, auto))


def grade_label(grade_: Column) -> Column:
    return F.when(grade_ == S.OK, F.lit("OK")).otherwise(grade_)


def source_label(source: Column) -> Column:
    return F.when(source == S.AUTO, F.lit("auto")).otherwise(F.lit("manual"))


def needs_grading(graded_at: Column, source: Column) -> Column:
    return graded_at.isNull() & (source != S.MANUAL)


def needs_detection(detected_at: Column) -> Column:
    return detected_at.isNull()


def exported(grade_: Column, which: str) -> Column:
    """Whether a grade passes ``All``, ``OkAndGood`` (ungraded photos too) or ``GoodOnly``."""
    if which == "All":
        return F.lit(True)
    if which == "OkAndGood":
        return grade_.isin(S.OK, S.GOOD, S.UNGRADED)
    if which == "GoodOnly":
        return grade_ == S.GOOD
    raise ValueError(f"no such export: {which}")
