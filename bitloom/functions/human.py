"""Values as people read them.

Fractions are rounded from exact integer tenths or hundredths, half to even of the exact value, as C's %.1f does for values
that are themselves exact; operands are integers, so ties are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(value: Column, divisor: int, digits: int) -> Column:
    """value / divisor with ``digits`` decimals, ties to even, from integers."""
    scale = 10**digits
    scaled = value.cast("decimal(38,0)") * scale
    whole, rest = _div(scaled, divisor), F.pmod(scaled, F.lit(divisor)) * 2
    up = F.when(rest > divisor, 1).when((rest == divisor) & (whole % 2 == 1), 1).otherwise(0)
    n = whole + up
    return F.concat(_div(n, scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("bigint").cast("string"), digits, "0"))


def _div(value: Column, divisor: int) -> Column:
    """Integer division, exact beyond 2^53."""
    return F.call_function("div", value, F.lit(divisor))


def _scaled(value: Column, step: int, units: list[str], first: Column, beyond: Column) -> Column:
    """``beyond``: the number of the last unit's, from ``step`` of them on."""
    out = first
    for k, unit in enumerate(units, 1):
        out = out.when(value < step ** (k + 1), F.concat(_fixed(value, step**k, 1), F.lit(f" {unit}")))
    return out.otherwise(F.concat(beyond, F.lit(f" {units[-1]}")))


def file_size(value: Column) -> Column:
    """Bytes up to 9999, then KB, MB, GB, TB of 1024."""
    return _scaled(value, 1024, ["KB", "MB", "GB", "TB"], F.when(value < 10000, F.concat(value.cast("string"), F.lit(" bytes"))), _div(value, 1024**4).cast("string"))


def bit_size(value: Column) -> Column:
    """Bits, then Kbit, Mbit, Gbit, Tbit of 1000."""
    return _scaled(value, 1000, ["Kbit", "Mbit", "Gbit", "Tbit"], F.when(value < 1000, F.concat(value.cast("string"), F.lit(" bits"))), _div(value, 1000**4).cast("string"))


def bit_rate(value: Column) -> Column:
    return F.concat(bit_size(value), F.lit("/sec"))


def frequency(value: Column) -> Column:
    """Hz, then kHz, MHz, GHz, THz of 1000."""
    return _scaled(value, 1000, ["kHz", "MHz", "GHz", "THz"], F.when(value < 1000, F.concat(value.cast("string"), F.lit(" Hz"))), (value / F.lit(1e12)).cast("string"))


def duration_ms(value: Column) -> Column:
    """Milliseconds as the three most significant of years (365 days), days, hours, min, sec and ms, in the plural; "0 ms" for none."""
    units = [("years", 365 * 86_400_000), ("days", 86_400_000), ("hours", 3_600_000), ("min", 60_000), ("sec", 1000), ("ms", 1)]
    left, parts = value.cast("bigint"), []
    for name, size in units:
        n = _div(left, size)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"))))
        left = left % size
    text = F.array_join(F.slice(F.array_compact(F.array(*parts)), 1, 3), " ")
    return F.when(value == 0, "0 ms").otherwise(text)


def duration_ns(value: Column) -> Column:
    """Nanoseconds: as such below 1000, then usec and ms with two decimals, from a second on as :func:`duration_ms`."""
    v = value.cast("bigint")
    return (
        F.when(v < 1000, F.concat(v.cast("string"), F.lit(" nsec"))).when(v < 1_000_000, F.concat(_fixed(v, 1000, 2), F.lit(" usec")))
        .when(v < 1_000_000_000, F.concat(_fixed(v, 1_000_000, 2), F.lit(" ms"))).otherwise(duration_ms(_div(v, 1_000_000)))
    )


def unix_attributes(mode: Column) -> Column:
    """Permission bits as rwx text with set-id and sticky marks, then the whole mode in octal in brackets."""
    bit = lambda k: F.shiftright(mode, k).bitwiseAND(1) == 1
    kind = F.shiftright(mode, 12).bitwiseAND(15)
    # Letters of the file types
    letter = F.when(kind == 1, "p").when(kind == 2, "c").when(kind == 4, "d").when(kind == 6, "b").when(kind == 10, "l").when(kind == 12, "s").when(kind.isin(0, 8), "-").otherwise("?")
    text = [letter]
    for who, (special, mark) in enumerate(((11, "s"), (10, "s"), (9, "t"))):
        base = 6 - 3 * who
        execute = F.when(bit(special), F.when(bit(base), mark).otherwise(mark.upper())).otherwise(F.when(bit(base), "x").otherwise("-"))
        text += [F.when(bit(base + 2), "r").otherwise("-"), F.when(bit(base + 1), "w").otherwise("-"), execute]
    return F.concat(*text, F.lit(" ("), F.conv(mode.cast("string"), 10, 8), F.lit(")"))


def degrees(d: Column, m: Column, s: Column, hemisphere: Column) -> Column:
    """Degrees, minutes and seconds as one number, negative unless N or E."""
    value = d + m / 60.0 + s / 3600.0
    return F.when(hemisphere.isin("N", "E"), value).otherwise(-value)


def channels(n: Column) -> Column:
    return F.when(n == 1, "mono").when(n == 2, "stereo").otherwise(n.cast("string"))
