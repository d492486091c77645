"""Queries on scalar functions: the same expressions are built for Spark and for the checking engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folium.functions import dates as D
from folium.functions import numbers as N
from folium.functions import text as X
from folium.functions.dialect import DUCK, SPARK, Spark
from folium.plans.base import Catalogue
from folium.session import short_methods, table

catalogue = Catalogue()
Steps = Callable[[Spark], list[dict[str, str]]]


def dual(name: str, source: str, steps: Steps, where: str = "") -> None:
    """A query of select lists over each other: every step may use the columns of the one before."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        short_methods(spark)
        df = table(spark, sf_dir, source)
        for step in steps(SPARK):
            df = df.selectExpr(*[f"{e} AS {c}" for c, e in step.items()])
        return df.where(where) if where else df

    sql = source
    for step in steps(DUCK):
        sql = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in step.items()) + f" FROM {sql})"
    run.__name__ = name
    catalogue.queries[name] = run
    catalogue.oracle[name] = f"SELECT * FROM {sql}" + (f" WHERE {where}" if where else "")


CENTS = "cast(round(l_extendedprice * 100) AS BIGINT)"


def _grouped(mark: str) -> str:
    w = f"floor({CENTS} / 100)"
    return f"CASE WHEN {w} < 1000 THEN cast(cast({w} AS BIGINT) AS VARCHAR(20)) ELSE concat(cast(cast(floor({w} / 1000) AS BIGINT) AS VARCHAR(20)), '{mark}', lpad(cast(cast({w} % 1000 AS BIGINT) AS VARCHAR(20)), 3, '0')) END"


PLACES = f"lpad(cast({CENTS} % 100 AS VARCHAR(20)), 2, '0')"
QUANTITY = "cast(cast(l_quantity AS INT) AS VARCHAR(20))"


def number_text() -> str:
    """Prices and quantities of lineitem as people write them, a way for each of twelve kinds of rows."""
    ways = [
        f"concat({_grouped(',')}, '.', {PLACES})", f"concat({_grouped('.')}, ',', {PLACES})", f"concat({_grouped(' ')}, ',', {PLACES})", f"concat('$', {_grouped(',')}, '.', {PLACES})",
        f"concat('(', {_grouped(',')}, ')')", f"concat({QUANTITY}, '%')", f"concat('-', {QUANTITY}, '.5')", f"concat('0', {QUANTITY})", f"concat({_grouped(',')}, '.', {PLACES}, '-')",
        f"concat('€ ', {_grouped('.')}, ',', {PLACES})", _grouped(","), "concat('lot ', l_returnflag)",
    ]
    return "CASE (l_orderkey + l_linenumber) % 12 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(ways)) + " END"


KEY = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber"}
MARK = "CASE l_returnflag WHEN 'A' THEN 'POINT' WHEN 'N' THEN 'COMMA' ELSE 'ANY' END"


def _numbers(d: Spark) -> list[dict[str, str]]:
    more = {"mark": "mark", "c": "c"}
    return [
        KEY | {"mark": MARK, "t": number_text()},
        KEY | {"mark": "mark", "c": N.clean("t", d)},
        KEY | more | {"b": N.bare("c", d), "neg": N.negative("c", d)},
        KEY | more | {"b": "b", "neg": "neg", "kind": f"CASE WHEN {N.is_code('b', d)} THEN NULL ELSE {N.shape('b', d)} END"},
        KEY | more | {"kind": "kind", "b": "b", "neg": "neg", "v": N.value("b", "kind", "mark", d)},
    ]


dual("parse_numbers", "lineitem", lambda d: [*_numbers(d), KEY | {"shown": "c", "kind": "kind", "number": f"round(CASE WHEN neg THEN -v ELSE v END / CASE WHEN {d.matches('c', '%$')} THEN 100 ELSE 1 END + 0, 6)"}])
dual("decimal_evidence", "lineitem", lambda d: [*_numbers(d), KEY | {"proof": N.evidence("b", "kind", d)}])
dual("code_test", "lineitem", lambda d: [*_numbers(d), KEY | {"b": "b", "code": N.is_code("b", d)}])
dual("detector_numbers", "lineitem", lambda d: [KEY | {"t": number_text()}, KEY | {"t": "t", "number": f"round({N.detector_number('t', d)}, 6)", "numeric": N.looks_numeric("t", d)}])
dual("csv_numbers", "lineitem", lambda d: [KEY | {"t": number_text()}, KEY | {"t": "t", "number": f"round({N.csv_number('t', d)}, 6)"}])
dual("format_codes", "lineitem", lambda d: [*_numbers(d), KEY | {"code": f"CASE WHEN kind IS NOT NULL THEN {N.format_code('c', 'b', 'kind', d)} END"}])

Y, M, DAY = (f"cast(cast(extract({p} FROM l_shipdate) AS INT) AS VARCHAR(20))" for p in ("YEAR", "MONTH", "DAY"))


def date_text() -> str:
    month = "CASE extract(MONTH FROM l_shipdate) " + " ".join(f"WHEN {i + 1} THEN '{m.capitalize()}'" for i, m in enumerate(D.MONTHS)) + " END"
    ways = [f"concat({Y}, '-', lpad({M}, 2, '0'), '-', lpad({DAY}, 2, '0'))", f"concat({DAY}, '.', {M}, '.', {Y})", f"concat({M}, '/', {DAY}, '/', {Y})", f"concat({DAY}, ' ', {month}, ' ', {Y})", f"concat({month}, ' ', {DAY}, ', ', {Y})", f"concat({DAY}, '-', {month}, '-', substring({Y}, 3, 2))", f"concat('31/02/', {Y})", f"concat({DAY}, '-', {M}, '/', {Y})", "concat('on ', l_linestatus)"]
    return "CASE (l_orderkey + l_linenumber) % 9 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(ways)) + " END"


ORDER = "CASE l_returnflag WHEN 'A' THEN 'MDY' WHEN 'N' THEN 'DMY' ELSE 'ANY' END"
dual("parse_dates", "lineitem", lambda d: [
    KEY | {"fallback": ORDER, "t": date_text()}, KEY | {"t": "t", "fallback": "fallback", "p": D.parts("t", d)}, KEY | {"t": "t", "p": "p", "proof": D.proof_of("p", d), "way": D.way_of("p", "fallback", d)},
    KEY | {"t": "t", "proof": "proof", "day": D.date_of("p", "way", d), "part": D.time_of("t", d)}, KEY | {"t": "t", "proof": "proof", "day": D.guarded("day"), "part": "part"}, KEY | {"t": "t", "proof": "proof", "serial": f"{d.days('day')} + part"}])
dual("parse_clocks", "lineitem", lambda d: [
    KEY | {"t": "CASE l_linenumber % 4 WHEN 0 THEN concat(cast(l_linenumber % 12 + 1 AS VARCHAR(9)), ':', lpad(cast(cast(l_quantity AS INT) AS VARCHAR(9)), 2, '0'), ' PM') WHEN 1 THEN concat(cast(cast(l_quantity AS INT) % 30 AS VARCHAR(9)), ':15') WHEN 2 THEN '14:30:59' ELSE '9 am' END"},
    KEY | {"t": "t", "part": f"round({D.clock('t', d)}, 9)"}])
dual("excel_serial", "orders", lambda d: [{"o_orderkey": "o_orderkey", "serial": f"cast({d.days('cast(o_orderdate AS DATE)')} AS INT)"}, {"o_orderkey": "o_orderkey", "serial": "serial", "serial1904": "serial - 1462"}])

DOC = {"doc_id": "doc_id"}


def _each_line(f: Callable[[str], str], d: Spark, text: str = "text", between: str = "chr(10)") -> str:
    """f of every line of a text, joined again."""
    parts = f"transform(split({text}, chr(10)), x -> {f('x')})" if d is SPARK else f"list_transform(string_split({text}, chr(10)), lambda x: {f('x')})"
    return f"array_join({parts}, {between})" if d is SPARK else f"array_to_string({parts}, {between})"


dual("visible_text", "documents", lambda d: [DOC | {"shown": d.chars(X.visible("text", d))}])
dual("clean_text", "documents", lambda d: [DOC | {"kept": d.chars(X.clean("text", d))}])
dual("trim_marks", "part", lambda d: [{"p_partkey": "p_partkey", "word": X.trim_marks("concat(p_name, CASE p_size % 3 WHEN 0 THEN ',;' WHEN 1 THEN '!?\"' ELSE '' END)", d)}])
dual("page_tokens", "orders", lambda d: [{"o_orderkey": "o_orderkey", "number": X.page_token("CASE o_orderkey % 4 WHEN 0 THEN concat('- ', cast(o_orderkey AS VARCHAR(20)), ' -') WHEN 1 THEN concat('(', cast(o_custkey AS VARCHAR(20)), ')') WHEN 2 THEN o_orderpriority ELSE cast(o_custkey AS VARCHAR(20)) END", d)}])
dual("csv_inert", "lineitem", lambda d: [KEY | {"t": "CASE l_linenumber % 7 WHEN 0 THEN concat('=A', l_returnflag) WHEN 1 THEN '-1,250.5' WHEN 2 THEN concat('-', l_linestatus) WHEN 3 THEN '-' WHEN 4 THEN '@cmd' WHEN 5 THEN '+12%' ELSE l_returnflag END"}, KEY | {"field": X.inert("t", d)}])
dual("xml_escape", "pages", lambda d: [{"page_id": "page_id", "n": d.chars(X.xml("html", d))}])
dual("signature_norm", "documents", lambda d: [DOC | {"sigs": _each_line(lambda x: X.signature(x, d), d)}])
dual("markdown_escape", "documents", lambda d: [DOC | {"shown": _each_line(lambda x: X.line_guard(X.markdown(x, d), d), d)}])
dual("csv_quote", "documents", lambda d: [DOC | {"field": X.csv_quote("text", d)}])
dual("leaders", "documents", lambda d: [
    DOC | {"t": "concat(text, CASE doc_id % 3 WHEN 0 THEN '. . . . . . . . . . . .' WHEN 1 THEN '........' ELSE '____________' END)"},
    DOC | {"dots": _each_line(lambda x: f"CASE WHEN {X.leaders(x, d)} THEN '1' ELSE '0' END", d, "t", "''")}])
dual("heading_levels", "lineitem", lambda d: [KEY | {"style": "CASE l_linenumber % 3 WHEN 0 THEN concat('Heading', cast(l_linenumber AS VARCHAR(9))) WHEN 1 THEN concat('Heading ', cast(l_linenumber AS VARCHAR(9))) ELSE 'Title' END"}, KEY | {"level": X.heading_level("style", d)}])
WORDS = "CASE l_orderkey % 12 WHEN 0 THEN concat(cast(l_linenumber AS VARCHAR(9)), '.') WHEN 1 THEN concat('(', lower(l_returnflag), ')') WHEN 2 THEN 'IV.' WHEN 3 THEN '(a]' WHEN 4 THEN '12' WHEN 5 THEN 'iiii.' WHEN 6 THEN '•' WHEN 7 THEN 'hello' WHEN 8 THEN 'xlii)' WHEN 9 THEN '0.' WHEN 10 THEN 'i.' ELSE 'MCMXCIV.' END"
dual("list_markers", "lineitem", lambda d: [KEY | {"w": WORDS}, KEY | {"w": "w", "kind": X.marker_kind("w", d)}, KEY | {"kind": "kind", "value": f"CASE WHEN kind = 'roman' THEN cast({X.roman_value('w', d)} AS INT) END"}])
dual("letter_labels", "orders", lambda d: [{"o_orderkey": "o_orderkey", "label": X.letter_label("(o_orderkey % 80 + 1)")}])
dual("safe_links", "pages", lambda d: [{"page_id": "page_id", "u": "CASE page_id % 5 WHEN 0 THEN concat('java', 'script:', url) WHEN 1 THEN concat('  ', url, '?a b ') WHEN 2 THEN 'mailto:a@example.com' WHEN 3 THEN concat('file://', url) ELSE url END"}, {"page_id": "page_id", "link": X.safe_url("u", d)}])
dual("case_switches", "part", lambda d: [{"p_partkey": "p_partkey", "up": "upper(p_name)", "low": "lower(p_name)", "first": X.first_cap("p_name")}])
dual("hidden_styles", "lineitem", lambda d: [KEY | {"css": "CASE l_linenumber % 6 WHEN 0 THEN 'opacity: 0' WHEN 1 THEN 'color:red; display : none' WHEN 2 THEN 'position:absolute;left:-9999px' WHEN 3 THEN 'opacity:0.5' WHEN 4 THEN 'left:-10px;position:absolute' ELSE 'visibility:hidden;' END"}, KEY | {"hidden": X.hidden_style("css", d)}])
dual("numeric_look", "lineitem", lambda d: [KEY | {"t": "CASE l_linenumber % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '--' WHEN 2 THEN '1.234,50' WHEN 3 THEN l_returnflag ELSE '(12)' END"}, KEY | {"numeric": N.looks_numeric("t", d)}])
dual("json_model", "events", lambda d: [{"event_id": "event_id", "k": "cast(get_json_object(props, '$.k') AS INT)" if d is SPARK else "cast(json_extract_string(props, '$.k') AS INT)", "missing": "get_json_object(props, '$.none')" if d is SPARK else "json_extract_string(props, '$.none')"}])
dual("colour_parse", "lineitem", lambda d: [KEY | {"hex": "concat('#', lpad(cast(cast(floor(l_extendedprice) AS BIGINT) % 1000000 AS VARCHAR(9)), 6, '0'))"}, KEY | {
    c: f"cast(conv(substring(hex, {at}, 2), 16, 10) AS INT)" if d is SPARK else f"cast(concat('0x', substring(hex, {at}, 2)) AS INT)" for c, at in (("r", 2), ("g", 4), ("b", 6))},
    KEY | {"rgb": "r * 65536 + g * 256 + b", "tint": "cast(floor(r + (255 - r) * 0.4 + 0.5) AS INT)", "shade": "cast(floor(g * 0.6 + 0.5) AS INT)"}])
dual("text_width", "part", lambda d: [{"p_partkey": "p_partkey", "width": f"round(0.5 * {d.chars('p_name')} - 0.25 * {d.count('p_name', '[iljtf ]')} + 0.3 * {d.count('p_name', '[mwMW]')}, 4)"}])
dual("script_counts", "documents", lambda d: [DOC | {"latin": d.count("text", r"\p{L}" if d is DUCK else r"\p{L}"), "digits": d.count("text", "[0-9]"), "beyond": d.count("text", r"[^\x00-\x7f]")}])
dual("unsupported_formats", "pages", lambda d: [{"page_id": "page_id", "kind": f"CASE WHEN {d.matches('html', '^<!DOCTYPE html')} THEN 'html' WHEN {d.matches('html', '^%PDF-')} THEN 'pdf' WHEN {d.matches('html', '^PK')} THEN 'zip' ELSE 'unknown' END"}])
