"""Packed scalar values of row images -> text, and back where tests need it.

Text keeps what a Spark type can't: zero and partial dates, TIME beyond a day,
decimals of up to 65 digits.
"""

from __future__ import annotations

import struct

_DIGITS_TO_BYTES = (0, 1, 1, 2, 2, 3, 3, 4, 4, 4)


def decimal_size(precision: int, scale: int) -> int:
    whole = precision - scale
    return whole // 9 * 4 + _DIGITS_TO_BYTES[whole % 9] + scale // 9 * 4 + _DIGITS_TO_BYTES[scale % 9]


def decimal_text(data: bytes, precision: int, scale: int) -> str:
    """A packed decimal: big-endian groups of nine digits, the first bit is set for numbers from zero up, negatives inverted."""
    raw = bytearray(data)
    negative = not raw[0] & 0x80
    raw[0] ^= 0x80
    if negative:
        raw = bytearray(b ^ 0xFF for b in raw)
    whole, at, digits = precision - scale, 0, []

    def take(count: int) -> None:
        nonlocal at
        size = _DIGITS_TO_BYTES[count]
        digits.append(str(int.from_bytes(raw[at : at + size], "big")).rjust(count, "0"))
        at += size

    if whole % 9:
        take(whole % 9)
    for _ in range(whole // 9):
        take(9)
    left = "".join(digits).lstrip("0") or "0"
    digits = []
    for _ in range(scale // 9):
        take(9)
    if scale % 9:
        take(scale % 9)
    return ("-" if negative else "") + left + ("." + "".join(digits) if scale else "")


def date_text(value: int) -> str:
    """Three packed bytes: day in 5 bits, month in 4, year above; zero and partial dates stay as they are."""
    return f"{value >> 9:04d}-{value >> 5 & 15:02d}-{value & 31:02d}"


def year_text(value: int) -> str:
    return f"{1900 + value:04d}" if value else "0000"


def _fraction(data: bytes, precision: int) -> str:
    if not precision:
        return ""
    number = int.from_bytes(data, "big")
    return "." + f"{number:0{len(data) * 2}d}"[:precision]


def datetime_text(data: bytes, precision: int) -> str:
    """Five bytes (sign, year*13+month in 17 bits, day 5, hour 5, minute 6, second 6) and the fraction."""
    packed = int.from_bytes(data[:5], "big") - (1 << 39)
    date, time = packed >> 17, packed & 0x1FFFF
    months = date >> 5
    return f"{months // 13:04d}-{months % 13:02d}-{date & 31:02d} {time >> 12:02d}:{time >> 6 & 63:02d}:{time & 63:02d}{_fraction(data[5:], precision)}"


def time_text(data: bytes, precision: int) -> str:
    """Three bytes (hour 10 bits, minute 6, second 6, around an offset) and the fraction; negatives count whole and fraction together."""
    extra = (precision + 1) // 2
    value = int.from_bytes(data[: 3 + extra], "big") - (1 << (8 * (3 + extra) - 1))
    sign = "-" if value < 0 else ""
    value = abs(value)
    whole, part = value >> (8 * extra), value & ((1 << (8 * extra)) - 1)
    fraction = "." + f"{part:0{2 * extra}d}"[:precision] if precision else ""
    return f"{sign}{whole >> 12 & 0x3FF:02d}:{whole >> 6 & 63:02d}:{whole & 63:02d}{fraction}"


def timestamp_text(data: bytes, precision: int) -> str:
    """Four bytes of seconds since 1970 in UTC and the fraction; 0 is the zero value."""
    import datetime

    (seconds,) = struct.unpack(">I", data[:4])
    if not seconds and not any(data[4:]):
        return "0000-00-00 00:00:00" + ("." + "0" * precision if precision else "")
    moment = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)
    return moment.strftime("%Y-%m-%d %H:%M:%S") + _fraction(data[4:], precision)


def float_text(value: float, single: bool = False) -> str:
    """The shortest text that reads back to the same number; -0.0 keeps its sign."""
    if single:
        for digits in range(6, 10):
            text = f"{value:.{digits}g}"
            if struct.pack("<f", float(text)) == struct.pack("<f", value):
                return repr(float(text))
    return repr(value)
