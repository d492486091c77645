"""Dates as people write them, and spreadsheets' day numbers.

Day 0 is 1899-12-30; days before 1900-03-01 are not dates, as two calendars of day numbers disagree there. Two-digit years
below 30 belong to the century from 2000.
"""

from __future__ import annotations

from folium.functions.dialect import SPARK, Spark

NUMERIC = r"^([0-9]{1,2})([-./])([0-9]{1,2})([-./])([0-9]{4}|[0-9]{2})$"
ISO = r"^([0-9]{4})([-./])([0-9]{1,2})([-./])([0-9]{1,2})$"
#: A time of day that may follow either.
TAIL = r"[ t]([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[ap][.]?m[.]?)?)$"
# Month names in small letters; the first three letters tell them apart.
NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTHS = [n[:3] for n in NAMES]
NAME = "(" + "|".join(f"{n[:3]}(?:{n[3:]})?" if n != "september" else "sep(?:t(?:ember)?)?" for n in NAMES) + ")"
DAY_NAMED = rf"^([0-9]{{1,2}})[.]?([ -]){NAME}[.]?([ -])([0-9]{{4}}|[0-9]{{2}})$"
NAMED_DAY = rf"^{NAME}[.]? ([0-9]{{1,2}}),? ([0-9]{{4}})$"
NAMED_YEAR = rf"^{NAME}[.]?[ -]([0-9]{{4}})$"
CLOCK = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([ap])[.]?m[.]?)?$"


def year(y: str, d: Spark = SPARK) -> str:
    return f"CASE WHEN {d.chars(y)} = 2 THEN CASE WHEN {d.integer(y)} < 30 THEN concat('20', {y}) ELSE concat('19', {y}) END ELSE {y} END"


def parts(x: str, d: Spark = SPARK) -> str:
    """What a text is as a date, taken apart once: kind|first|second|third|mark|mark, empty for what is none. Kinds: iso, num, day, name."""
    low = f"lower({x})"
    core = d.replace(low, TAIL, "")
    ways = [(core, ISO, "iso|$1|$3|$5|$2|$4"), (core, NUMERIC, "num|$1|$3|$5|$2|$4"), (low, DAY_NAMED, "day|$1|$3|$5|$2|$4"), (low, NAMED_DAY, "name|$2|$1|$3||"), (low, NAMED_YEAR, "name|1|$1|$2||")]
    return "CASE " + " ".join(f"WHEN {d.matches(t, p)} THEN {d.replace(t, p, to)}" for t, p, to in ways) + " ELSE '' END"


def _part(p: str, i: int) -> str:
    return f"split_part({p}, '|', {i})"


def proof_of(p: str, d: Spark = SPARK) -> str:
    """DMY or MDY if the parts of a numeric date can only be read one way."""
    a, b = d.integer(_part(p, 2)), d.integer(_part(p, 3))
    return f"CASE WHEN {_part(p, 1)} <> 'num' OR {_part(p, 5)} <> {_part(p, 6)} THEN NULL WHEN {a} BETWEEN 13 AND 31 AND {b} BETWEEN 1 AND 12 THEN 'DMY' WHEN {b} BETWEEN 13 AND 31 AND {a} BETWEEN 1 AND 12 THEN 'MDY' END"


def order_proof(x: str, d: Spark = SPARK) -> str:
    """DMY or MDY if a numeric date can only be read one way."""
    return proof_of(parts(x, d), d)


def way_of(p: str, order: str, d: Spark = SPARK) -> str:
    """How the parts are read: a numeric date by its proof, else by the column's order; equal parts and points need none."""
    a, b = d.integer(_part(p, 2)), d.integer(_part(p, 3))
    read = f"coalesce({proof_of(p, d)}, CASE WHEN {order} IN ('DMY', 'MDY') THEN {order} WHEN {a} = {b} OR {_part(p, 5)} = '.' THEN 'DMY' END)"
    return f"CASE WHEN {_part(p, 5)} <> {_part(p, 6)} THEN NULL WHEN {_part(p, 1)} = 'num' THEN {read} WHEN {_part(p, 1)} = 'iso' THEN 'YMD' WHEN {_part(p, 1)} <> '' THEN 'DNY' END"


def date_of(p: str, way: str, d: Spark = SPARK) -> str:
    """The calendar date of parts that are read in that way."""
    one, two, three = (_part(p, i) for i in (2, 3, 4))
    number = "CASE " + " ".join(f"WHEN {two} LIKE '{n}%' THEN '{i + 1}'" for i, n in enumerate(MONTHS)) + " END"
    y = f"CASE WHEN {way} = 'YMD' THEN {one} ELSE {year(three, d)} END"
    m = f"CASE {way} WHEN 'YMD' THEN {two} WHEN 'DMY' THEN {two} WHEN 'MDY' THEN {one} ELSE {number} END"
    day = f"CASE {way} WHEN 'YMD' THEN {three} WHEN 'MDY' THEN {two} ELSE {one} END"
    return f"CASE WHEN {way} IS NOT NULL THEN {d.date(y, m, day)} END"


def guarded(day: str) -> str:
    """The date, null before 1900-03-01."""
    return f"CASE WHEN {day} >= cast('1900-03-01' AS DATE) THEN {day} END"


def parse(x: str, order: str, d: Spark = SPARK) -> str:
    """The calendar date a text stands for, as one expression; queries go step by step, so that a text is matched once."""
    p = parts(x, d)
    return guarded(date_of(p, way_of(p, order, d), d))


def time_of(x: str, d: Spark = SPARK) -> str:
    """The fraction of a day of the time after a date, 0 without one, null for one that is none."""
    tail = d.extract(f"lower({x})", TAIL, 1)
    return f"CASE WHEN {tail} = '' THEN 0.0 ELSE {clock(tail, d)} END"


def clock(x: str, d: Spark = SPARK) -> str:
    """The fraction of a day that a time of day stands for."""
    low = f"lower({x})"
    h, m, s = (f"coalesce({d.integer(d.extract(low, CLOCK, i))}, 0)" for i in (1, 2, 3))
    half = d.extract(low, CLOCK, 4)
    hour = f"CASE WHEN {half} = '' THEN {h} WHEN {half} = 'p' THEN {h} % 12 + 12 ELSE {h} % 12 END"
    return f"CASE WHEN {d.matches(low, CLOCK)} AND ({half} = '' AND {h} < 24 OR {h} BETWEEN 1 AND 12) AND {m} < 60 AND {s} < 60 THEN (({hour}) * 3600 + {m} * 60 + {s}) / cast(86400 AS DOUBLE) END"
