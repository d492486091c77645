"""Statistics over a corpus that later steps look up: styles, headings, running lines, language, hyphenation, page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mode(df: DataFrame, by: list[str], value: str, weight: Column) -> DataFrame:
    """The value of most weight in each group; of equals the least."""
    sums = df.groupBy(*by, value).agg(F.sum(weight).alias("weight"))
    return sums.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("weight"), F.col(value))).alias("mode"), F.max("weight").alias("weight"))


def majority(flag: Column, weight: Column) -> Column:
    """More than half of the weight, strictly."""
    return F.sum(F.when(flag, weight).otherwise(0)) * 2 > F.sum(weight)


def weighted_median(df: DataFrame, by: list[str], value: str, weight: Column, bin_width: float = 0.5) -> DataFrame:
    """The first bin at which the running weight passes half; bins are aggregated before they are ordered."""
    bins = df.withColumn("bin", F.round(F.col(value) / bin_width) * bin_width).groupBy(*by, "bin").agg(F.sum(weight).alias("w"))
    whole = Window.partitionBy(*by)
    run = bins.withColumn("upto", F.sum("w").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(whole))
    return run.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*by).agg(F.min("bin").alias("median"))


def order_statistic(df: DataFrame, by: list[str], value: str, nth: Column) -> DataFrame:
    """The value at 0-based place nth(count) in ascending order, without interpolation; from counts of distinct values."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(*by)
    run = counts.withColumn("upto", F.sum("c").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("count", F.sum("c").over(whole))
    return run.where(F.col("upto") > nth).groupBy(*by).agg(F.min(value).alias("value"))


def pitch_modes(lines: DataFrame, size: str, pitch: str, least: int = 2) -> DataFrame:
    """The usual distance of lines for each size, in quarter points; 1.2 times the size below `least` samples, 1.5 times at most."""
    bins = lines.withColumn("q", F.round(F.col(pitch) * 4) / 4).groupBy(size, "q").agg(F.count(F.lit(1)).alias("c"))
    best = bins.groupBy(size).agg(F.min_by("q", F.struct(-F.col("c"), F.col("q"))).alias("q"), F.max("c").alias("c"))
    usual = F.when(F.col("c") >= least, F.col("q")).otherwise(F.col(size) * 1.2)
    return best.select(size, F.least(usual, F.col(size) * 1.5).alias("pitch"))


def heading_tiers(styles: DataFrame, size: str, bold: str, chars: str, body: Column, tiers: int = 6) -> DataFrame:
    """Styles that are headings: larger than the body, or bold and not much smaller, with less than a quarter of all letters."""
    sums = styles.groupBy(size, bold).agg(F.sum(chars).alias("chars"))
    total = sums.agg(F.sum("chars").alias("total"))  # one row
    ok = (F.col(size) >= 1.12 * body) | (F.col(bold) & (F.col(size) > body - 0.6))
    kept = sums.crossJoin(F.broadcast(total)).where(ok & (F.col("chars") * 4 < F.col("total")))
    return kept.withColumn("tier", F.row_number().over(Window.orderBy(F.col(size).desc(), F.col(bold).desc()))).where(F.col("tier") <= tiers).select(size, bold, "tier")


def running_lines(lines: DataFrame, doc: str, page: str, signature: str, share: float = 0.4) -> DataFrame:
    """Signatures that stand on at least max(2, ceil(share * pages)) pages of a document."""
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    seen = lines.where(F.length(signature) > 0).groupBy(doc, signature).agg(F.countDistinct(page).alias("seen"))
    return seen.join(pages, doc).where(F.col("seen") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * share)))


def offset_vote(df: DataFrame, by: list[str], number: str, index: str, share: float = 0.3) -> DataFrame:
    """The difference of page number and page index that most pages agree on, if enough do."""
    votes = df.groupBy(*by, (F.col(number) - F.col(index)).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    total = Window.partitionBy(*by)
    best = votes.withColumn("sampled", F.sum("votes").over(total)).withColumn("r", F.row_number().over(total.orderBy(F.col("votes").desc(), "offset")))
    return best.where((F.col("r") == 1) & (F.col("votes") >= F.greatest(F.lit(3), F.ceil(F.col("sampled") * share)))).drop("r")


def constant_offsets(df: DataFrame, by: list[str], number: str, index: str) -> DataFrame:
    """Runs whose numbers keep the same distance from the index, seen at least twice."""
    off = F.col(number) - F.col(index)
    return df.groupBy(*by).agg(F.min(off).alias("offset"), F.max(off).alias("hi"), F.count(F.lit(1)).alias("seen")).where((F.col("offset") == F.col("hi")) & (F.col("seen") >= 2)).drop("hi")


# Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "in", "that", "is", "for", "with", "this"],
    "fr": ["le", "la", "les", "des", "et", "est", "dans", "pour", "que", "une"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "mit", "für", "den"],
    "es": ["el", "los", "las", "que", "con", "para", "una", "del", "por", "es"],
}
MARKER_LETTERS = {"en": "", "fr": "éèêçà", "de": "äöüß", "es": "ñíóá"}


def language_vote(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """For each document the language of most points: two for a function word, one for a letter that marks it; of equals the first named.

    Counted on the row with patterns, so no words move; the tables of words are literals.
    """
    every = sorted({w for words in FUNCTION_WORDS.values() for w in words})
    found = F.regexp_extract_all("low", F.lit(r"(?:^|[\s.,])(" + "|".join(every) + r")(?=[\s.,]|\z)"), F.lit(1))
    marked = F.regexp_extract_all("low", F.lit("([" + "".join(MARKER_LETTERS.values()) + "])"), F.lit(1))
    texts = docs.select(doc, F.lower(text).alias("low")).select(doc, found.alias("found"), marked.alias("marked"))  # a text is searched once for all languages
    points = []
    for i, (code, words) in enumerate(FUNCTION_WORDS.items()):
        hits = F.size(F.filter("found", lambda w: w.isin(words)))
        marks = F.size(F.filter("marked", lambda c: c.isin(list(MARKER_LETTERS[code])))) if MARKER_LETTERS[code] else F.lit(0)
        points.append(F.struct((hits * 2 + marks).alias("points"), F.lit(-i).alias("order"), F.lit(code).alias("code")))
    best = texts.select(doc, F.when(F.col("found").isNotNull(), F.greatest(*points)).alias("best"))
    return best.select(doc, F.when(F.col("best.points") >= 4, F.col("best.code")).alias("language"), F.col("best.points").cast("long").alias("points"))


def right_to_left(text: Column) -> Column:
    """More than half of a text's letters are written from right to left."""
    return F.regexp_count(text, F.lit(r"[\x{0590}-\x{08FF}]")) * 2 > F.regexp_count(text, F.lit(r"\p{L}"))


def cjk_language(text: Column) -> Column:
    """ja, ko or zh by shares of kana and hangul; null without such letters."""
    kana, hangul, han = (F.regexp_count(text, F.lit(p)) for p in (r"[\x{3040}-\x{30FF}]", r"[\x{AC00}-\x{D7AF}]", r"[\x{4E00}-\x{9FFF}]"))
    return F.when((kana + hangul + han) == 0, F.lit(None)).when((kana > 0) & (kana * 20 >= han + hangul), "ja").when(hangul * 5 >= F.greatest(han, F.lit(1)), "ko").otherwise("zh")


def auto_hyphenated(lines: DataFrame, by: list[str], text: str) -> DataFrame:
    """Whether a document breaks words: at least three lines end in a hyphen, and over 2 % of all."""
    hit = F.sum(F.when(F.col(text).rlike(r"\p{L}-$"), 1).otherwise(0))
    return lines.groupBy(*by).agg(hit.alias("hyphens"), F.count(F.lit(1)).alias("lines")).withColumn("auto", (F.col("hyphens") >= 3) & (F.col("hyphens") * 50 > F.col("lines")))


def dehyphenate(text: Column) -> Column:
    """Lines joined where a word was broken: the hyphen goes if a small letter follows, a soft hyphen always."""
    return F.regexp_replace(F.regexp_replace(text, "­\n?", ""), r"(\p{L})-\n(\p{Ll})", "$1$2")


def page_sample(df: DataFrame, by: list[str], order: list[str], whole: int = 40, head: int = 20, tail: int = 5, pairs: int = 15) -> DataFrame:
    """A fixed sample of pages: all up to `whole`; else the first, the last and pairs spread evenly between."""
    w = Window.partitionBy(*by)
    df = df.withColumn("page", F.row_number().over(w.orderBy(*order)) - 1).withColumn("pages", F.count(F.lit(1)).over(w))
    span = F.col("pages") - head - tail
    between = F.array(*[F.floor(head + span * k / (pairs + 1)) for k in range(1, pairs + 1)])
    spread = F.array_contains(between, F.col("page").cast("long")) | F.array_contains(between, (F.col("page") - 1).cast("long"))
    return df.where((F.col("pages") <= whole) | (F.col("page") < head) | (F.col("page") >= F.col("pages") - tail) | spread)
