"""Numeric text of fixed-width table fields."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal


def rendered(value: Decimal, width: int, decimals: int) -> bytes:
    """A number right-justified in width: at its scale, else without a leading zero, else in scientific form; raises if none fits."""
    fixed = format(value.quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_EVEN), "f")
    if len(fixed) > width and decimals:
        sign, body = ("-", fixed[1:]) if fixed.startswith("-") else ("", fixed)
        if body.startswith("0."):
            fixed = sign + body[1:]
    if len(fixed) <= width:
        return fixed.rjust(width).encode("ascii")
    for digits in range(width, -1, -1):
        text = f"{value:.{digits}E}"
        if len(text) <= width:
            return text.rjust(width).encode("ascii")
    raise ValueError(f"{value} doesn't fit {width} characters")
