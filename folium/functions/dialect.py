"""SQL expressions that Spark runs and that other SQL engines can check: the few spellings in which they differ."""

from __future__ import annotations


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


class Spark:
    """Spark SQL; patterns are Java regular expressions in raw literals."""

    def text(self, x: str) -> str:
        return 'r"' + x + '"' if "'" in x else f"r'{x}'"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def integer(self, x: str) -> str:
        return f"try_cast({x} AS INT)"

    def date(self, y: str, m: str, d: str) -> str:
        return f"try_cast(concat(lpad({y}, 4, '0'), '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')) AS DATE)"

    def days(self, date: str) -> str:
        return f"datediff({date}, DATE'1899-12-30')"

    def chars(self, x: str) -> str:
        return f"char_length({x})"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, {self.text(pattern)})"


class Duck(Spark):
    """DuckDB."""

    def text(self, x: str) -> str:
        return quoted(x)

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        import re

        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(re.sub(r'[$]([0-9])', r'\\\1', by))}, 'g')"

    def days(self, date: str) -> str:
        return f"date_diff('day', DATE '1899-12-30', {date})"

    def chars(self, x: str) -> str:
        return f"length({x})"

    def count(self, x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {self.text(pattern)}))"


SPARK, DUCK = Spark(), Duck()
