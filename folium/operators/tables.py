"""Tables of cells: types of columns, headers, joins over pages, and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conventions(cells: DataFrame, by: list[str], mark_proof: Column, order_proof: Column, text: Column) -> DataFrame:
    """Decimal mark and date order that the cells of a column prove; currency breaks a tie of orders."""
    votes = {f"n_{p.lower()}": F.sum(F.when(c == p, 1).otherwise(0)) for c, p in ((mark_proof, "POINT"), (mark_proof, "COMMA"), (order_proof, "MDY"), (order_proof, "DMY"))}
    votes |= {"n_dollar": F.sum(F.when(text.contains("$"), 1).otherwise(0)), "n_euro": F.sum(F.when(text.rlike("[£€]"), 1).otherwise(0))}
    v = cells.groupBy(*by).agg(*[c.cast("long").alias(n) for n, c in votes.items()])
    pick = lambda a, b, x, y, tie: F.when(F.col(a) > F.col(b), x).when(F.col(b) > F.col(a), y).otherwise(tie)
    money = pick("n_dollar", "n_euro", "MDY", "DMY", F.lit("UNKNOWN"))
    return v.withColumn("mark", pick("n_point", "n_comma", "POINT", "COMMA", F.lit("UNKNOWN"))).withColumn("order", pick("n_mdy", "n_dmy", "MDY", "DMY", money))


def inherit(column: DataFrame, document: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Conventions of a column, the document's where it has none; a contrary mark needs `least` proofs."""
    both = column.join(document.select(*by, F.col("mark").alias("doc_mark"), F.col("order").alias("doc_order")), by)
    proofs = F.greatest("n_point", "n_comma")
    own = (F.col("mark") != "UNKNOWN") & ((F.col("doc_mark") == "UNKNOWN") | (F.col("mark") == F.col("doc_mark")) | (proofs >= least))
    return both.withColumn("mark", F.when(own, F.col("mark")).otherwise(F.col("doc_mark"))).withColumn("order", F.when(F.col("order") != "UNKNOWN", F.col("order")).otherwise(F.col("doc_order"))).drop("doc_mark", "doc_order")


def typed_columns(cells: DataFrame, by: list[str], is_number: Column, is_code: Column, is_word: Column, filled: Column) -> DataFrame:
    """number or text for each column: codes from 20 % or words from 60 % of filled cells on make it text; else a majority of numbers."""
    n = lambda c: F.sum(F.when(filled & c, 1).otherwise(0)).cast("long")
    v = cells.groupBy(*by).agg(n(is_number).alias("numbers"), n(is_code).alias("codes"), n(is_word).alias("words"), n(F.lit(True)).alias("filled"))
    text = (F.col("codes") >= 0.2 * F.col("filled")) | (F.col("words") >= 0.6 * F.col("filled"))
    return v.withColumn("type", F.when(text, "text").when(F.col("numbers") * 2 > F.col("filled"), "number").otherwise("text"))


def inferred_header(cells: DataFrame, by: list[str], row: str, col: str, text: str, is_number: Column) -> DataFrame:
    """Tables whose first row is a header: all text, two labels or more, three rows or more, numbers below one of the labels."""
    first = F.col(row) == 0
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per = cells.groupBy(*by, col).agg(
        F.max(F.when(first & ~is_number & (F.length(text) > 0), 1).otherwise(0)).alias("label"), F.max(F.when(first & is_number, 1).otherwise(0)).alias("number"),
        n(~first & (F.length(text) > 0)).alias("filled"), n(~first & is_number).alias("numbers"), F.max(row).alias("last"),
    )
    got = per.groupBy(*by).agg(F.sum("label").alias("labels"), F.max("number").alias("numeric"), F.max("last").alias("last"), F.max(F.when((F.col("label") == 1) & (F.col("filled") > 0) & (F.col("numbers") * 2 >= F.col("filled")), 1).otherwise(0)).alias("below"))
    return got.select(*by, ((F.col("numeric") == 0) & (F.col("labels") >= 2) & (F.col("last") >= 2) & (F.col("below") == 1)).alias("header"))


def key_column(cells: DataFrame, by: list[str], col: str, text: str) -> DataFrame:
    """The column with most filled cells; of equals the first."""
    filled = cells.groupBy(*by, col).agg(F.sum(F.when(F.length(F.trim(text)) > 0, 1).otherwise(0)).alias("c"))
    return filled.groupBy(*by).agg(F.min_by(col, F.struct(-F.col("c"), F.col(col))).alias("key_column"))


def split_plan(pieces: DataFrame, by: list[str], row: str, count: str, share: float = 0.6) -> DataFrame:
    """Into how many pieces most rows of a column fall: two pieces, two rows and `share` of the rows at least."""
    c = pieces.groupBy(*by, count).agg(F.count(F.lit(1)).alias("rows"))
    best = c.groupBy(*by).agg(F.min_by(count, F.struct(-F.col("rows"), F.col(count))).alias("pieces"), F.max("rows").alias("agree"), F.sum("rows").alias("rows"))
    return best.where((F.col("pieces") >= 2) & (F.col("agree") >= 2) & (F.col("agree") >= share * F.col("rows")))


def runs(df: DataFrame, by: list[str], order: list[str], follows: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of rows in which each follows the one before; `follows` may use lag() over the same order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("starts__", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn(name, F.sum("starts__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts__")


def continues(by: list[str], order: list[str], columns: str, width: str, left: str) -> Column:
    """Whether a table goes on from the one before: as many columns, a like width and left edge."""
    w = Window.partitionBy(*by).orderBy(*order)
    was = lambda c: F.lag(c).over(w)
    return (was(columns) == F.col(columns)) & (F.abs(F.col(width) - was(width)) <= F.greatest(F.lit(6.0), F.abs(F.col(width)) * 0.1)) & (F.abs(F.col(left) - was(left)) <= 12)


def repeated_headers(rows: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    """Without rows that repeat the first row of their run."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    marked = rows.withColumn("head__", F.first(same).over(w)).withColumn("place__", F.row_number().over(w))
    return marked.where((F.col("place__") == 1) | (same != F.col("head__"))).drop("head__", "place__")


def drop_empty_lines(cells: DataFrame, by: list[str], line: str, text: str, name: str) -> DataFrame:
    """Without rows (or columns) that are empty; the others are numbered anew."""
    full = cells.groupBy(*by, line).agg(F.max(F.length(F.trim(text)) > 0).alias("full")).where("full")
    kept = full.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(line)) - 1).drop("full")
    return cells.join(kept, [*by, line])


def split_at_titles(rows: DataFrame, by: list[str], order: list[str], size: str, alone: Column, factor: float = 1.25) -> DataFrame:
    """Numbers the parts of a table that titles divide: rows of one cell, in a size well above the upper median."""
    n = rows.groupBy(*by).agg(F.sort_array(F.collect_list(size)).alias("sizes")).select(*by, F.expr("sizes[cast(size(sizes) / 2 as int)]").alias("median"))
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.join(n, by).withColumn("title", alone & (F.col(size) >= factor * F.col("median")))
    return rows.withColumn("part", F.sum(F.when(F.col("title"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def prose_like(cells: DataFrame, by: list[str], row: str, text: str) -> DataFrame:
    """Tables that are prose: two rows, three words a row, half the rows starting small, and a sentence that ends inside."""
    line = cells.groupBy(*by, row).agg(F.sum(F.size(F.split(F.trim(text), r"\s+"))).alias("words"), F.min_by(text, "col").alias("first"), F.max(F.col(text).rlike(r"[.!?] ")).alias("ends"))
    got = line.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg("words").alias("words"), F.avg(F.when(F.col("first").rlike(r"^\p{Ll}"), 1.0).otherwise(0.0)).alias("small"), F.max("ends").alias("ends"))
    return got.withColumn("prose", (F.col("rows") >= 2) & (F.col("words") >= 3) & (F.col("small") >= 0.5) & F.col("ends"))


def pipe_cells(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line, col, cell) of the lines that pipes divide."""
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line", "t")).where(F.col("t").contains(" | "))
    return lines.select(doc, "line", F.posexplode(F.split("t", r" \| ")).alias("col", "cell"))


def pipe_table(cells: DataFrame, by: list[str], row: str, col: str, text: str) -> DataFrame:
    """Each row of a grid as a line of a pipe table, padded to the table's width."""
    width = cells.groupBy(*by).agg((F.max(col) + 1).alias("width"))
    lines = cells.groupBy(*by, row).agg(F.map_from_entries(F.collect_list(F.struct(col, F.replace(F.col(text), F.lit("|"), F.lit("\\|"))))).alias("m")).join(width, by)
    shown = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    return lines.select(*by, row, F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |")).alias("line"))


def list_labels(items: DataFrame, by: list[str], order: list[str], level: str, deepest: int = 3) -> DataFrame:
    """Numbers of list entries, as 2.1.3; a number starts anew when a shallower entry has come between."""
    w = Window.partitionBy(*by).orderBy(*order)
    items = items.withColumn("r0__", F.lit(0))
    for k in range(1, deepest + 1):
        shallower = F.sum(F.when(F.col(level) < k, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        items = items.withColumn(f"r{k}__", shallower)
    for k in range(1, deepest + 1):
        own = Window.partitionBy(*by, f"r{k}__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        items = items.withColumn(f"n{k}__", F.sum(F.when(F.col(level) == k, 1).otherwise(0)).over(own))
    shown = F.array(*[F.when(F.col(level) >= k, F.greatest(F.col(f"n{k}__"), F.lit(1)).cast("string")) for k in range(1, deepest + 1)])
    return items.withColumn("label", F.array_join(F.array_compact(shown), ".")).drop(*[f"r{k}__" for k in range(deepest + 1)], *[f"n{k}__" for k in range(1, deepest + 1)])
