"""Text: newlines, printable forms, charsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest metadata text.
LONGEST = 300


def normalize_newline(value: Column) -> Column:
    """CRLF and CR as LF, runs of LF as one."""
    return F.regexp_replace(F.regexp_replace(value, "\r\n?", "\n"), "\n+", "\n")


def normalize_string(value: Column) -> Column:
    """Without spaces, tabs, line ends and NULs at both ends."""
    return F.regexp_replace(value, "^[ \t\u000b\n\r\u0000]+|[ \t\u000b\n\r\u0000]+$", "")


def truncate(value: Column, most: int = LONGEST) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("(...)"))).otherwise(value)


def printable(value: Column, charset: str = "UTF-8", quote: str | None = None, smart: bool = True) -> Column:
    """Control characters as escapes: by letter where there is one, else by two hex digits, which ``smart`` shortens to one octal
    digit where none follows. Characters that ``charset`` (UTF-8, ISO-8859-1, ASCII) lacks become escapes too. ``quote`` is put around
    and escaped within; quoted nothing is "(empty)". Clean texts pass untouched.
    """
    # Letters of control characters.
    letters = {7: "a", 8: "b", 9: "t", 10: "n", 13: "r"}
    out = value
    for code in (*range(32), 127):
        out = F.replace(out, F.lit(chr(code)), F.lit("\\" + letters.get(code, f"x{code:02x}")))
    if quote:
        out = F.when(value == "", "(empty)").otherwise(F.concat(F.lit(quote), F.replace(out, F.lit(quote), F.lit("\\" + quote)) if quote in "\"'" else out, F.lit(quote)))
    if smart:
        out = F.regexp_replace(out, r"\\x0([0-7])(?=[^0-7]|$)", r"\\$1")
    touched = F.lit(True) if quote else value.rlike(r"[\x00-\x1f\x7f]")
    out = F.when(touched, out).otherwise(value)
    if charset != "UTF-8":
        lacking = {"ASCII": r"[^\x00-\x7f]", "ISO-8859-1": r"[^\x00-\xff]"}[charset]
        code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint")
        number = lambda c: F.lower(F.hex(code(c)))
        escape = lambda c: F.when(code(c) < 256, F.concat(F.lit("\\x"), F.lpad(number(c), 2, "0"))).when(code(c) < 65536, F.concat(F.lit("\\u"), F.lpad(number(c), 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(number(c), 8, "0")))
        escaped = F.array_join(F.transform(F.regexp_extract_all(out, F.lit(r"([\s\S])"), 1), lambda c: F.when(c.rlike(lacking), escape(c)).otherwise(c)), "")
        out = F.when(out.rlike(lacking), escaped).otherwise(out)
    return out


def escape_regex(value: Column) -> Column:
    return F.regexp_replace(value, r"([\]\[^.+*?{}|()\\$])", r"\\$1")


# Characters outside ASCII that tell a charset if a text has no others, in the order they are tried.
CHARSETS = (("ISO-8859-1", "©®éêèàç"), ("ISO-8859-15", "©®éêèàç€"), ("MacRoman", "©®"), ("ISO-8859-7", "εδηιθκμοΡσςυΈί"))


def charset(data: Column, default: str | None = None) -> Column:
    """UTF-8 or UTF-16 by byte order mark, then ASCII, then UTF-8 if valid, then the first charset whose tell-tale characters cover all
    bytes beyond ASCII, else ``default``."""
    h = F.hex(data)
    out = F.when(h.startswith("EFBBBF"), "UTF-8").when(h.startswith("FFFE"), "UTF-16-LE").when(h.startswith("FEFF"), "UTF-16-BE")
    out = out.when(h.rlike("^(?:[0-7].)*+$"), "ASCII").when(F.is_valid_utf8(data.cast("string")), "UTF-8")
    for name, characters in CHARSETS:
        pairs = "|".join(f"{b:02X}" for b in characters.encode(name.replace("MacRoman", "mac_roman")))
        out = out.when(h.rlike(f"^(?:[0-7].|{pairs})*+$"), name)
    return out.otherwise(F.lit(default)) if default else out


def ends_like(value: Column, suffixes: list[str]) -> Column:
    return F.lower(F.element_at(F.split(value, r"\."), -1)).isin(suffixes)


def extension(filename: Column) -> Column:
    """Lower-case last extension with its dot; null without one."""
    return F.nullif(F.lower(F.regexp_extract(filename, r"(\.[^./\\]+)$", 1)), F.lit(""))
