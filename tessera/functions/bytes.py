"""Byte, bit and pixel expressions, all built from SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def byte_at(binary: Column | str, offset: Column | int) -> Column:
    """The byte at an offset (from 0) of a binary column, as a number; null beyond the end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.conv(F.hex(F.substr(c(binary), (at + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")


def _turned(digits: Column, n: int) -> Column:
    """2 n hexadecimal digits with their pairs in reverse order."""
    return digits if n == 1 else F.regexp_replace(digits, "(..)" * n, "".join(f"${k}" for k in range(n, 0, -1)))


def le_int(binary: Column | str, offset: Column | int, n: int) -> Column:
    """n bytes (seven at most) from an offset as a little-endian number; null if any lies beyond the end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    part = F.hex(F.substr(c(binary), (at + 1).cast("int"), F.lit(n)))
    return F.when(F.octet_length(c(binary)) >= at + n, F.conv(_turned(part, n), 16, 10).cast("bigint"))


def le_bytes(number: Column | str | int, n: int) -> Column:
    """A number as n little-endian bytes (seven at most)."""
    v = F.lit(number) if isinstance(number, int) else c(number)
    return F.unhex(_turned(F.lpad(F.hex(v.cast("bigint").bitwiseAND(F.lit((1 << (8 * n)) - 1))), 2 * n, "0"), n))


def fourcc(binary: Column | str, offset: Column | int) -> Column:
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.decode(F.substr(c(binary), (at + 1).cast("int"), F.lit(4)), "ISO-8859-1")


def ascii_bytes(text: Column | str) -> Column:
    return F.encode(F.lit(text) if isinstance(text, str) else text, "US-ASCII")


def clamp8(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("int")


def wrap8(x: Column) -> Column:
    """Modulo 256, into 0..255."""
    return F.pmod(x, F.lit(256)).cast("int")


def signed8(x: Column) -> Column:
    return F.pmod(x + 128, F.lit(256)) - 128


def div0(a: Column, b: Column | int) -> Column:
    """Integer quotient, truncated toward zero."""
    return F.call_function("div", a.cast("bigint"), (F.lit(b) if isinstance(b, int) else b).cast("bigint"))


def avg2(a: Column, b: Column) -> Column:
    """Truncating mean of two bytes."""
    return F.shiftright((a + b).cast("bigint"), 1).cast("int")


def argb(r: str = "r", g: str = "g", b: str = "b", a: str = "a") -> Column:
    """A pixel as one unsigned 32-bit number in a LONG."""
    w = lambda x, k: F.shiftleft(F.col(x).cast("bigint"), k)
    return w(a, 24).bitwiseOR(w(r, 16)).bitwiseOR(w(g, 8)).bitwiseOR(F.col(b).cast("bigint"))


def color_slot(color: Column, bits: int) -> Column:
    """Cache slot of a colour: the top bits of a multiplicative 32-bit hash (fixed multiplier 0x1e35a7bd)."""
    # split so that the product stays within 63 bits
    low, high = color.bitwiseAND(F.lit(0xFFFF)), F.shiftright(color, 16)
    product = low * F.lit(0x1E35A7BD) + F.shiftleft((high * F.lit(0x1E35A7BD)).bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftright(product.bitwiseAND(F.lit(0xFFFFFFFF)), 32 - bits).cast("int")


def prefix_code(n: Column) -> tuple[Column, Column, Column]:
    """(symbol, extra, extra_bits) of a length or distance n >= 1: its size class, and where it stands in it. 0 gives zeros."""
    n = n.cast("bigint")
    top = F.length(F.bin(n - 1)) - 1
    symbol = F.when(n <= 5, F.greatest(n - 1, F.lit(0))).otherwise(2 * top + F.call_function("shiftright", n - 1, (top - 1).cast("int")).bitwiseAND(F.lit(1)))
    bits = F.when(symbol < 4, F.lit(0)).otherwise(F.shiftright((symbol - 2).cast("bigint"), 1))
    base = F.call_function("shiftleft", (F.lit(2) + symbol.bitwiseAND(F.lit(1))).cast("bigint"), bits.cast("int"))
    extra = F.when(n <= 5, F.lit(0)).otherwise(n - 1 - base)
    return symbol.cast("int"), extra.cast("bigint"), bits.cast("int")


def prefix_decode(symbol: Column, extra: Column) -> Column:
    bits = F.shiftright((symbol - 2).cast("bigint"), 1)
    return F.when(symbol < 4, symbol + 1).otherwise(F.call_function("shiftleft", (F.lit(2) + symbol.bitwiseAND(F.lit(1))).cast("bigint"), bits.cast("int")) + extra + 1).cast("bigint")


def tile_key(x: Column | str, bits: int) -> Column:
    return F.shiftright(c(x), bits)


def tile_count(size: Column | str, bits: int) -> Column:
    """Tiles of 2**bits pixels that cover a side."""
    return F.shiftright(c(size) + ((1 << bits) - 1), bits)


def packing_factor(n_colors: Column) -> Column:
    """Palette indices that fit one byte."""
    return F.when(n_colors <= 2, 8).when(n_colors <= 4, 4).when(n_colors <= 16, 2).otherwise(1)


def symbol_label(alphabet: Column, symbol: Column) -> Column:
    """A name for a symbol: green literal, length, cache slot, red, blue, alpha, distance."""
    s = symbol.cast("string")
    green = F.when(symbol < 256, F.concat(F.lit("G"), s)).when(symbol < 280, F.concat(F.lit("LEN"), (symbol - 256).cast("string"))).otherwise(F.concat(F.lit("CC"), (symbol - 280).cast("string")))
    return F.when(alphabet == 0, green).when(alphabet == 1, F.concat(F.lit("R"), s)).when(alphabet == 2, F.concat(F.lit("B"), s)).when(alphabet == 3, F.concat(F.lit("A"), s)).otherwise(F.concat(F.lit("D"), s))
