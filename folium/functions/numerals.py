"""Numbers written as words, letters and the digits of other scripts; the direction of a text; lengths given by formulas."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def roman(n: int) -> str:
    out = ""
    for value, sign in ROMAN:
        out += sign * (n // value)
        n %= value
    return out


def cardinal(n: int) -> str:
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + ("-" + ONES[n % 10] if n % 10 else "")
    for size, word in ((1_000_000, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            return f"{cardinal(n // size)} {word}" + (f" {cardinal(n % size)}" if n % size else "")
    raise ValueError(n)


def ordinal(n: int) -> str:
    end = "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return f"{n}{end}"


def cjk(n: int) -> str:
    """Counting with units, below ten thousand; ten to nineteen without a leading one."""
    digits, units = "〇一二三四五六七八九", ["", "十", "百", "千"]
    if n == 0:
        return digits[0]
    out, gap = "", False
    for p in range(3, -1, -1):
        d = n // 10**p % 10
        if d:
            out += (digits[0] if gap and out else "") + ("" if d == 1 and p == 1 and not out else digits[d]) + units[p]
            gap = False
        else:
            gap = bool(out)
    return out


def full_width(n: int) -> str:
    return "".join(chr(ord(c) + 0xFEE0) for c in str(n))


def hebrew(n: int) -> str:
    """Letters by value below a thousand; 15 and 16 are written 9+6 and 9+7."""
    out = ""
    for value, sign in ((400, "ת"), (300, "ש"), (200, "ר"), (100, "ק")):
        while n >= value:
            out, n = out + sign, n - value
    if n in (15, 16):
        return out + "ט" + "וז"[n - 15]
    if n >= 10:
        out, n = out + "יכלמנסעפצ"[n // 10 - 1], n % 10
    return out + ("אבגדהוזחט"[n - 1] if n else "")


def direction(text: str | None) -> str | None:
    """rtl or ltr by the first strong letter; null without one."""
    for c in text or "":
        kind = unicodedata.bidirectional(c)
        if kind in ("R", "AL"):
            return "rtl"
        if kind == "L":
            return "ltr"
    return None


UNITS = {"px": 0.75, "pt": 1.0, "in": 72.0, "cm": 72 / 2.54, "mm": 7.2 / 2.54, "pc": 12.0, "": 1.0}


def length(formula: str, whole: float = 0.0, em: float = 12.0) -> float | None:
    """Points that a length of a style sheet stands for: numbers with units, calc(), min(), max() and clamp()."""
    tokens = re.findall(r"[a-z]+\(|[0-9.]+(?:[a-z]+|%)?|[-+*/(),]", formula.lower().strip())
    at = 0

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def atom() -> float:
        t = take()
        if t == "-":
            return -atom()
        if t == "(" or t.endswith("("):
            values = [total()]
            while peek() == ",":
                take()
                values.append(total())
            if take() != ")":
                raise ValueError(formula)
            if t == "clamp(":
                return max(values[0], min(values[1], values[2]))
            return {"min(": min, "max(": max}.get(t, lambda v: v[0])(values)
        number, unit = re.fullmatch(r"([0-9.]+)([a-z%]*)", t).groups()
        return float(number) * (whole / 100 if unit == "%" else em if unit in ("em", "rem") else UNITS[unit])

    def product() -> float:
        x = atom()
        while peek() in ("*", "/"):
            x = x * atom() if take() == "*" else x / atom()
        return x

    def total() -> float:
        x = product()
        while peek() in ("+", "-"):
            x = x + product() if take() == "+" else x - product()
        return x

    try:
        x = total()
        return x if at == len(tokens) else None
    except (IndexError, KeyError, ValueError, AttributeError, ZeroDivisionError):
        return None


def column(f: Callable, c: Column, kind: str = "string") -> Column:
    """One of these functions over a column, in Arrow batches; null stays null."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None or x != x else f(int(x) if isinstance(x, float) else x)), kind)(c)
