"""Numbers as people write them.

`shape` sorts a cleaned text into one of a few ways of writing a number; everything else follows from it. An ambiguous
single group such as 1,234 is read by the decimal mark the column's evidence gives (`POINT`, `COMMA` or unknown).
"""

from __future__ import annotations

from folium.functions.dialect import SPARK, Spark

APOSTROPHE = "['’]"
SPACES = r"[\x{00A0}\x{202F}\x{2009}\x{2007}\x{2002}\x{2003}]"
DASHES = "[−–‒]"
# Currency signs and codes before a number (codes with a space), and after one.
SIGNS = ["US$", "A$", "C$", "NZ$", "HK$", "S$", "R$", "$", "£", "€", "¥", "₹", "₩", "₽", "₺", "₪", "₫", "₱", "₦", "฿"]
CODES = ["USD", "EUR", "GBP", "CHF", "JPY", "CAD", "AUD", "NZD", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF", "INR", "CNY", "ZAR", "BRL", "MXN", "TRY", "Rs.", "Rs"]
AFTER = ["$", "£", "€", "¥", "₹", "₽", "₺", "₪", "USD", "EUR", "GBP", "CHF", "JPY", "CAD", "AUD", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF", "kr.", "kr", "zł", "Kč", "Ft", "lei"]


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace("$", "[$]").replace(".", "[.]") for w in words) + ")"


BEFORE = rf"(?:{_any(SIGNS)} ?|{_any(CODES)}  ?)"
MONEY = rf"(?:{_any(SIGNS)}|{_any(CODES)}|{_any(AFTER)})"
SINGLE = r"^[1-9][0-9]{0,2}[.,][0-9]{3}$"


def clean(x: str, d: Spark = SPARK) -> str:
    """Unicode spaces and dashes made plain, edges stripped."""
    return f"trim({d.replace(d.replace(x, SPACES, ' '), DASHES, '-')})"


def negative(x: str, d: Spark = SPARK) -> str:
    """Whether a cleaned text marks a negative number: brackets, a minus before the digits, or a trailing one after a written-out amount."""
    return f"({d.matches(x, r'^[^0-9]*[(].*[)][^0-9]*$')} OR {d.matches(x, r'^[^0-9]*-')} OR {d.matches(x, r'[.,][0-9]+-$')})"


def bare(x: str, d: Spark = SPARK) -> str:
    """The digits and marks of a cleaned text, without signs, brackets, currency and percent."""
    inner = d.replace(x, r"^[(](.*)[)]$", "$1")
    inner = d.replace(inner, rf"^[+-]? ?(?:{BEFORE}(?:- ?)?)?", "")
    inner = d.replace(inner, rf"(?: ?{_any(AFTER)}| ?%)$", "")
    inner = d.replace(inner, r"^[(](.*)[)]$", "$1")
    return f"CASE WHEN {d.matches(x, '^[0-9.,]*$')} THEN {x} ELSE {d.replace(inner, r'([.,][0-9]+)-$', '$1')} END"


#: Ways of writing digits: the mark between groups, sizes of groups, the decimal mark that may follow, and the decimal mark that it proves, if any.
WAYS = {
    "us": (",", "{1,3}", "{3}", "[.]"), "eu": ("[.]", "{1,3}", "{3}", ","), "space": (" ", "{1,3}", "{3}", "[.,]"),
    "apostrophe": ("['’]", "{1,3}", "{3}", "[.]"),
}


def shape(b: str, d: Spark = SPARK) -> str:
    """How digits are written: integer, single (one group, ambiguous), zero_point and zero_comma (0.123), a way of grouping, indian, point, comma; null if not a number."""
    tests = {"integer": r"^[0-9]+$", "zero_point": r"^0[.][0-9]{3}$", "zero_comma": r"^0,[0-9]{3}$", "single": SINGLE}
    tests |= {way: f"^[0-9]{head}({gap}[0-9]{group})+({mark}[0-9]+)?$" for way, (gap, head, group, mark) in WAYS.items()}
    tests |= {"indian": r"^[0-9]{1,2}(,[0-9]{2})+,[0-9]{3}([.][0-9]+)?$", "point": r"^[0-9]*[.][0-9]+$", "comma": r"^[0-9]*,[0-9]+$"}
    return "CASE " + " ".join(f"WHEN {d.matches(b, p)} THEN '{name}'" for name, p in tests.items()) + " END"


def is_code(b: str, d: Spark = SPARK) -> str:
    """Digits that name something: a leading zero, or more plain digits than an amount has."""
    return f"({d.matches(b, r'^0[0-9]')} OR {d.matches(b, r'^[0-9]{12,}$')} OR {d.chars(d.replace(b, '[^0-9]', ''))} > 15)"


def value(b: str, kind: str, mark: str, d: Spark = SPARK) -> str:
    """The number that digits b of shape kind stand for, given the column's decimal mark; null where the mark forbids it."""
    commas = d.number(d.replace(d.replace(b, r"[.]", ""), ",", "."))
    points = d.number(d.replace(b, ",", ""))
    spaced = f"CASE WHEN {d.matches(b, ',')} AND {mark} = 'POINT' OR {d.matches(b, '[.]')} AND {mark} = 'COMMA' THEN NULL ELSE {d.number(d.replace(d.replace(b, ' ', ''), ',', '.'))} END"
    return (
        f"CASE {kind} WHEN 'integer' THEN {d.number(b)} WHEN 'us' THEN {points} WHEN 'indian' THEN {points} WHEN 'eu' THEN {commas} WHEN 'zero_point' THEN {d.number(b)} WHEN 'zero_comma' THEN {commas}"
        f" WHEN 'space' THEN {spaced} WHEN 'apostrophe' THEN {d.number(d.replace(b, APOSTROPHE, ''))}"
        f" WHEN 'single' THEN CASE WHEN {d.matches(b, ',')} = ({mark} = 'COMMA') THEN {d.number(d.replace(b, ',', '.'))} ELSE {d.number(d.replace(b, '[.,]', ''))} END"
        f" WHEN 'point' THEN CASE WHEN {mark} <> 'COMMA' THEN {d.number(b)} END WHEN 'comma' THEN CASE WHEN {mark} <> 'POINT' THEN {commas} END END"
    )


def evidence(b: str, kind: str, d: Spark = SPARK) -> str:
    """What a text proves about the decimal mark: POINT, COMMA or nothing."""
    point, comma = d.matches(b, "[.]"), d.matches(b, ",")
    return (
        f"CASE WHEN {kind} IN ('point', 'zero_point', 'apostrophe', 'indian') OR ({kind} = 'us' AND ({point} OR {d.matches(b, ',.*,')})) OR ({kind} = 'space' AND {point}) THEN 'POINT'"
        f" WHEN {kind} IN ('comma', 'zero_comma') OR ({kind} = 'eu' AND ({comma} OR {d.matches(b, '[.].*[.]')})) OR ({kind} = 'space' AND {comma}) THEN 'COMMA' END"
    )


def detector_number(x: str, d: Spark = SPARK) -> str:
    """The stricter reading used while tables are looked for: no apostrophes, no Indian groups, one or two places after a comma."""
    c = d.replace(d.replace(x, r"^[(](.*)[)]$", "-$1"), rf"{MONEY}|%| ", "")
    return (
        f"CASE WHEN {d.matches(c, r'^-?[0-9]+([.][0-9]+)?$')} THEN {d.number(c)} WHEN {d.matches(c, r'^-?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?$')} THEN {d.number(d.replace(c, ',', ''))}"
        f" WHEN {d.matches(c, r'^-?[0-9]{1,3}([.][0-9]{3})*,[0-9]{1,2}$')} THEN {d.number(d.replace(d.replace(c, '[.]', ''), ',', '.'))} END"
    )


def looks_numeric(x: str, d: Spark = SPARK) -> str:
    """A number, a dash or another sign for no value."""
    return f"(({detector_number(x, d)}) IS NOT NULL OR {d.matches(f'lower({x})', r'^(-+|–|—|n/a|n[.]a[.]|nil)$')})"


def csv_number(x: str, d: Spark = SPARK) -> str:
    """A number as an import of separated values takes it: plain, grouped by commas, or with an exponent."""
    ok = d.matches(x, r"^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)([.][0-9]*)?([eE][+-]?[0-9]+)?$")
    n = d.number(d.replace(x, ",", ""))
    return f"CASE WHEN {ok} AND abs({n}) < 1e308 THEN {n} + 0 END"


def format_code(x: str, b: str, kind: str, d: Spark = SPARK) -> str:
    """The number format that a text was shown in."""
    places = d.chars(d.extract(b, r"[.,]([0-9]+)$", 1))
    zeros = f"CASE WHEN {kind} IN ('integer') OR ({kind} IN ('us', 'eu', 'space', 'single', 'indian', 'apostrophe') AND {d.matches(b, r'^[0-9]{1,3}([.,]|[^0-9.,])')} AND {d.chars(d.replace(b, '[0-9]', ''))} = 1 AND {places} = 3) THEN '' WHEN {places} > 0 THEN concat('.', repeat('0', {places})) ELSE '' END"
    groups = f"CASE WHEN {kind} IN ('us', 'eu', 'space', 'single', 'indian', 'apostrophe') THEN '#,##0' ELSE '0' END"
    percent = f"CASE WHEN {d.matches(x, '%$')} THEN '%' ELSE '' END"
    return f"concat({groups}, {zeros}, {percent})"
