"""Small number formats as column expressions: half precision, packed integers, variable-length integers, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_to_double(bits: Column) -> Column:
    """Value of the 16 bits of a half-precision number, exactly."""
    bits = bits.cast("int").bitwiseAND(F.lit(0xFFFF))
    sign = F.when(bits.bitwiseAND(F.lit(0x8000)) != 0, -1.0).otherwise(1.0)
    exponent, mantissa = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023)).cast("double")
    normal = F.pow(F.lit(2.0), exponent - 15) * (1 + mantissa / 1024)
    special = F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 0, mantissa / F.lit(float(1 << 24))).when(exponent == 31, special).otherwise(normal)


def double_to_half(x: Column) -> Column:
    """Bits of the half-precision number next to ``x`` towards zero. Magnitudes of 65536 and more, and NaN, become infinite;
    those below 2**-14 become zero."""
    x = x.cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(F.when((size >= 2.0**-14) & (size < 65536.0), size).otherwise(1.0))).cast("int")
    exponent = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    mantissa = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * 1024).cast("int")
    sign = F.when((x < 0) | (F.signum(x).cast("string") == "-0.0"), 0x8000).otherwise(0)
    return sign + F.when(F.isnan(x) | (size >= 65536.0), 0x7C00).when(size < 2.0**-14, 0).otherwise(F.shiftleft(exponent + 15, 10) + mantissa)


def varint_length(x: Column, bits: int = 32) -> Column:
    """Bytes of the variable-length form of a whole number: seven bits a byte, negative numbers as unsigned."""
    x = x.cast("long")
    full = -(-bits // 7)
    steps = F.lit(1)
    for k in range(1, full):
        steps = steps + F.when((x < 0) | (x >= F.lit(1 << 7 * k)), 1).otherwise(0)
    return steps


def varint_hex(x: Column) -> Column:
    """The variable-length form of a 32-bit number, in hexadecimal digits."""
    u = x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    n = varint_length(x)
    byte = lambda k: F.lpad(F.hex(F.shiftright(u, 7 * k).bitwiseAND(F.lit(127)) + F.when(n > k + 1, 128).otherwise(0)), 2, "0")
    return F.lower(F.concat(*[F.when(n > k, byte(k)).otherwise(F.lit("")) for k in range(5)]))


def pack_position(x: Column, y: Column, z: Column) -> Column:
    """26, 26 and 12 bits of x, z and y, in this order, in one number."""
    x, y, z = (c.cast("long") for c in (x, y, z))
    return F.shiftleft(x.bitwiseAND(F.lit(0x3FFFFFF)), 38).bitwiseOR(F.shiftleft(z.bitwiseAND(F.lit(0x3FFFFFF)), 12)).bitwiseOR(y.bitwiseAND(F.lit(0xFFF)))


def unpack_position(p: Column) -> tuple[Column, Column, Column]:
    """x, y and z of a packed position; shifts keep the sign."""
    return F.shiftright(p, 38), F.shiftright(F.shiftleft(p, 52), 52), F.shiftright(F.shiftleft(p, 26), 38)


def pack_xz(x: Column, z: Column) -> Column:
    """Two places of a section in one byte."""
    return F.shiftleft(x.bitwiseAND(F.lit(15)), 4).bitwiseOR(z.bitwiseAND(F.lit(15)))


def turn_to_byte(degrees: Column) -> Column:
    """An angle in 256ths of a turn, as a signed byte."""
    step = F.pmod(F.floor(degrees * 256 / 360), F.lit(256))
    return F.when(step > 127, step - 256).otherwise(step).cast("int")


def offline_uuid(name: Column) -> Column:
    """Version 3 identifier of a name without an account: MD5 of a fixed prefix and the name."""
    h = F.md5(F.concat(F.lit("OfflinePlayer:"), name).cast("binary"))
    variant = F.element_at(F.split(F.lit("8 9 a b"), " "), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def rounded(value: Column, digits: int) -> Column:
    """``F.round(value, digits)`` of a double, bit for bit. That goes through decimals, one object a value; here only values do that are large or lie near the middle between two results.

    Below 2**44 units of the last digit, scaling is off by less than 1/256 of a unit, so whatever lies 1/64 or more from the middle has a sure whole number, and its quotient is the double nearest to the decimal."""
    scale = F.lit(10.0**digits)
    units = value * scale
    sure = (F.abs(units) < F.lit(2.0**44)) & (F.abs(units - F.floor(units) - F.lit(0.5)) > F.lit(1 / 64))
    return F.when(sure, F.floor(units + F.lit(0.5)) / scale).otherwise(F.round(value, digits))
