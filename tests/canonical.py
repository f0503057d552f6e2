"""Canonical JSON (RFC 8785) in plain Python, to test the column functions against."""

from __future__ import annotations

import json
import math


def number_text(x: float) -> str:
    """A number the way ECMAScript prints it."""
    if isinstance(x, int):
        x = float(x)
    if not math.isfinite(x):
        raise ValueError("canonical JSON has no non-finite numbers")
    if x == 0:
        return "0"
    sign, digits = ("-", repr(-x)) if x < 0 else ("", repr(x))
    mantissa, _, exp = digits.partition("e")
    whole, _, frac = mantissa.partition(".")
    frac = "" if frac == "0" else frac
    point = len(whole) + int(exp or 0)
    body = (whole + frac).lstrip("0")
    point -= len(whole + frac) - len((whole + frac).lstrip("0"))
    body = body.rstrip("0")
    n = len(body)
    if n <= point <= 21:
        return sign + body + "0" * (point - n)
    if 0 < point <= 21:
        return sign + body[:point] + "." + body[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + body
    e = point - 1
    tail = "." + body[1:] if n > 1 else ""
    return f"{sign}{body[0]}{tail}e{'+' if e >= 0 else '-'}{abs(e)}"


def canonical(value) -> str:
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, list):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    # Keys sort by UTF-16 code units.
    keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
