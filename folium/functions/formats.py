"""Numbers shown as a spreadsheet shows them. These need exact decimals, so they run in Arrow batches."""

from __future__ import annotations

import datetime as dt
import re
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def general(x: float | None) -> str | None:
    """15 significant digits at most; scientific from 1e15 on or below 1e-9, with three digits of a positive exponent."""
    if x is None or x != x:
        return None
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    d = Decimal(repr(x))
    digits = d.adjusted()
    d = d.quantize(Decimal(1).scaleb(digits - 14), ROUND_HALF_UP)
    if digits >= 15 or digits < -9:
        body = f"{d.scaleb(-d.adjusted()):f}".rstrip("0").rstrip(".")
        return f"{body}E{d.adjusted():+04d}" if digits > 0 else f"{body}E-{-d.adjusted():02d}"
    out = f"{d:f}"
    return out.rstrip("0").rstrip(".") if "." in out else out


SECTION = re.compile(r'(?:[^;"\\]|\\.|"[^"]*")+|(?<=;)(?=;|$)|^(?=;)')
TOKEN = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]|AM/PM|A/P|y+|m+|d+|h+|s+|[#0?][#0?,.]*(?:[eE][+-][0#?]+)?|[#0?.]+|%|.', re.IGNORECASE)


def sections(code: str) -> list[str]:
    return SECTION.findall(code)


def show(code: str, x: float | None) -> str | None:
    """A number by a format code: sections by sign, grouping, places, percent, exponents, dates and literals."""
    if x is None:
        return None
    if code.lower() in ("", "general"):
        return general(x)
    parts = sections(code)
    part = parts[0]
    if x < 0 and len(parts) > 1:
        part, x = parts[1], -x
    elif x == 0 and len(parts) > 2:
        part = parts[2]
    tokens = TOKEN.findall(part)
    if any(re.fullmatch(r"[yd]+|h+|s+", t, re.IGNORECASE) for t in tokens):
        return _date(tokens, x)
    sign = "-" if x < 0 else ""
    x = abs(x) * 100 ** tokens.count("%")
    out = []
    for t in tokens:
        if t[0] in '"':
            out.append(t[1:-1])
        elif t[0] == "\\":
            out.append(t[1])
        elif t[0] == "_":
            out.append(" ")
        elif t[0] in "*[":
            continue
        elif t[0] in "#0?.":
            out.append(sign + _number(t, x))
            sign = ""
        else:
            out.append(t)
    return sign + "".join(out)


def _number(mask: str, x: float) -> str:
    mask, _, power = mask.partition("E") if "E" in mask else mask.partition("e")
    scaled = Decimal(repr(x))
    if power:
        exponent = scaled.adjusted() if scaled else 0
        body = _number(mask, float(scaled.scaleb(-exponent)))
        return f"{body}E{'-' if exponent < 0 else '+' if power[0] == '+' else ''}{abs(exponent):0{len(power) - 1}d}"
    whole, _, places = mask.partition(".")
    while whole.endswith(","):
        whole, scaled = whole[:-1], scaled / 1000
    keep = len(re.sub("[^0#?]", "", places))
    scaled = scaled.quantize(Decimal(1).scaleb(-keep), ROUND_HALF_UP)
    a, _, b = f"{scaled:f}".partition(".")
    least = whole.count("0")
    a = a.lstrip("0").rjust(least, "0")
    if "," in whole and a:
        a = re.sub(r"(?<=\d)(?=(\d{3})+$)", ",", a)
    need = len(places.rstrip("#?"))
    while len(b) > need and b.endswith("0"):
        b = b[:-1]
    return a + ("." + b if b or "." in mask and need else "")


NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _date(tokens: list[str], x: float) -> str:
    t = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(x * 86400))
    half = any(k.upper() in ("AM/PM", "A/P") for k in tokens)
    out, clock = [], False
    for i, k in enumerate(tokens):
        low = k.lower()
        later = next((n.lower() for n in tokens[i + 1 :] if re.fullmatch(r"[ymdhs]+", n, re.IGNORECASE)), "")
        if low[0] == "y":
            out.append(f"{t.year:04d}" if len(k) > 2 else f"{t.year % 100:02d}")
        elif low[0] == "m" and set(low) == {"m"}:
            if clock or later[:1] == "s":
                out.append(f"{t.minute:02d}" if len(k) > 1 else str(t.minute))
            else:
                out.append(NAMES[t.month - 1] if len(k) == 4 else NAMES[t.month - 1][:3] if len(k) == 3 else f"{t.month:0{len(k)}d}")
        elif low[0] == "d":
            out.append(t.strftime("%A") if len(k) > 3 else t.strftime("%a") if len(k) == 3 else f"{t.day:0{len(k)}d}")
        elif low[0] == "h":
            hour = (t.hour - 1) % 12 + 1 if half else t.hour
            out.append(f"{hour:0{min(2, len(k))}d}")
            clock = True
        elif set(low) == {"s"}:
            out.append(f"{t.second:0{min(2, len(k))}d}")
        elif low in ("am/pm", "a/p"):
            out.append(("AM" if t.hour < 12 else "PM")[: 2 if len(k) > 3 else 1])
        elif k[0] in '"':
            out.append(k[1:-1])
        elif k[0] == "\\":
            out.append(k[1])
        elif k[0] not in "*[_":
            out.append(k)
    return "".join(out)


def shown(code: Column, number: Column) -> Column:
    return F.pandas_udf(lambda c, x: pd.Series([show(a, None if b != b else b) for a, b in zip(c, x)]), "string")(code, number)
