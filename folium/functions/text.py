"""Texts: what is shown, escaped, quoted, normalised or guarded."""

from __future__ import annotations

from folium.functions.dialect import SPARK, Spark


def visible(x: str, d: Spark = SPARK) -> str:
    """Without control characters."""
    return d.replace(x, r"[\x00-\x1f\x7f-\x{9f}]" if d is SPARK else r"[\x00-\x1f\x7f-\x{9f}]", "")


def clean(x: str, d: Spark = SPARK) -> str:
    """Without soft hyphens, carriage returns and non-characters."""
    return d.replace(x, "[­\r￾￿]", "")


def signature(x: str, d: Spark = SPARK) -> str:
    """What stays the same in a running line from page to page: digits and Roman numerals become #."""
    return f"trim({d.replace(d.replace(d.replace(f'lower({x})', '[0-9]+', '#'), r'^ *[ivxlc]+ *$', '#'), ' +', ' ')})"


def trim_marks(x: str, d: Spark = SPARK) -> str:
    return f"trim({d.replace(x, '''[,;:.!?\"']+$''', '')})" if d is not SPARK else f"trim(regexp_replace({x}, '[,;:.!?\"\\']+$', ''))"


def page_token(x: str, d: Spark = SPARK) -> str:
    """A page number without the marks around it; null if nothing but digits does not remain."""
    core = d.replace(x, r"^[-–—|( \[]+|[-–—|) \].]+$", "")
    return f"CASE WHEN {d.matches(core, r'^[0-9]{1,4}$')} THEN {d.integer(core)} END"


def csv_quote(x: str, d: Spark = SPARK) -> str:
    """A field of separated values, quoted where it must be."""
    return f"CASE WHEN {d.matches(x, '[,\"\n\r]')} OR {x} <> trim({x}) OR {d.matches(x, r'^[\s]|[\s]$')} THEN concat('\"', replace({x}, '\"', '\"\"'), '\"') ELSE {x} END"


def inert(x: str, d: Spark = SPARK) -> str:
    """A text that a spreadsheet would run as a formula gets an apostrophe, unless it is a sign or a signed number."""
    return f"CASE WHEN {d.matches(x, r'^[=@\t\r]')} OR ({d.matches(x, r'^[+-]')} AND NOT {d.matches(x, r'^[+-]([0-9][0-9.,]*)?%?$')}) THEN concat({d.text(chr(39)) if d is SPARK else chr(39) * 4}, {x}) ELSE {x} END"


def markdown(x: str, d: Spark = SPARK) -> str:
    """Marks of Markdown escaped, entities of markup opened."""
    out = f"replace(replace({x}, '&', '&amp;'), '<', '&lt;')"
    return d.replace(out, r"([\\`*_\[\]|])", r"\\$1" if d is SPARK else r"\\$1")


def line_guard(x: str, d: Spark = SPARK) -> str:
    """A line that would start a heading, quote or list gets a backslash."""
    out = d.replace(x, r"^([#>+-])( |$)", r"\\$1$2")
    return d.replace(out, r"^([0-9]{1,9})([.)])( |$)", r"$1\\$2$3")


def xml(x: str, d: Spark = SPARK) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def leaders(x: str, d: Spark = SPARK) -> str:
    """Whether a text is a run of leader dots or lines."""
    return d.matches(x, r"([.]|[.] |_|-){10}" if d is SPARK else r"([.]|[.] |_|-){10,}")  # ten are enough; Java's stack ends in runs of thousands


def heading_level(x: str, d: Spark = SPARK) -> str:
    return d.integer(d.extract(x, r"Heading ?([1-9])", 1))


MARKER = r"^(\(?)([0-9]{1,3}|[a-zA-Z]|[ivxlcdm]{2,}|[IVXLCDM]{2,})([.)])$"


def marker_kind(x: str, d: Spark = SPARK) -> str:
    """What numbers a list entry by its first word: bullet, decimal, roman, letter; null for a plain word."""
    core, open_, close = d.extract(x, MARKER, 2), d.extract(x, MARKER, 1), d.extract(x, MARKER, 3)
    fits = f"({d.matches(x, MARKER)} AND ({open_} = '' OR {close} = ')') AND {core} <> '0')"
    roman = d.matches(core, r"^(?i)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") if d is SPARK else d.matches(core, r"(?i)^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
    return (
        f"CASE WHEN {d.matches(x, '^[•◦▪–*-]$')} THEN 'bullet' WHEN NOT {fits} THEN NULL WHEN {d.matches(core, '^[0-9]')} THEN 'decimal'"
        f" WHEN {d.chars(core)} = 1 AND {core} NOT IN ('i', 'I', 'v', 'V', 'x', 'X') THEN 'letter' WHEN {roman} THEN 'roman' WHEN {d.chars(core)} = 1 THEN 'letter' END"
    )


def roman_value(x: str, d: Spark = SPARK) -> str:
    """The value of a well-formed Roman numeral, from the counts of its letters and of its subtractive pairs."""
    up = f"upper({x})"
    count = lambda p: d.count(up, p)
    whole = " + ".join(f"{v} * {count(c)}" for c, v in (("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1)))
    less = " + ".join(f"{v} * {count(p)}" for p, v in (("C[MD]", 200), ("X[CL]", 20), ("I[XV]", 2)))
    return f"({whole} - ({less}))"


def letter_label(n: str) -> str:
    """a, b, ... z, aa, bb: the letter repeats."""
    return f"repeat(chr(cast(97 + ({n} - 1) % 26 AS INT)), cast(floor(({n} - 1) / 26) + 1 AS INT))"


def safe_url(x: str, d: Spark = SPARK) -> str:
    """A link that may be kept: web, file transfer or mail, with spaces and letters beyond ASCII percent-encoded by the caller; else null."""
    t = f"trim({x})"
    return f"CASE WHEN {d.matches(f'lower({t})', r'^(https?|ftp)://[^/ ]+|^mailto:[^ ]+@')} THEN replace({t}, ' ', '%20') END"


def first_cap(x: str) -> str:
    return f"concat(upper(substring({x}, 1, 1)), substring({x}, 2))"


def hidden_style(x: str, d: Spark = SPARK) -> str:
    """Whether a style hides its element: no display, no opacity, nothing of it within the page."""
    s = d.replace(f"lower({x})", r"\s+", "")
    return f"({d.matches(s, r'(^|;)display:none')} OR {d.matches(s, r'(^|;)visibility:hidden')} OR {d.matches(s, r'(^|;)opacity:0([.]0+)?(;|$)')} OR ({d.matches(s, r'position:absolute')} AND {d.matches(s, r'(left|top):-[0-9]{4,}px')}))"
