"""Regular expressions as values that can be joined, compared and measured before they become one pattern for Spark.

Expressions are immutable; ``+`` follows one by another, ``|`` offers either, :meth:`Regex.repeat` repeats. Alternatives
share prefixes and single characters become one class, so that many fixed texts make a compact pattern.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

_SPECIAL = frozenset("][^.+*?{}|()\\$")


def escape(text: str) -> str:
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


class Regex:
    """Base of all expressions."""

    def text(self) -> str:
        raise NotImplementedError

    def lengths(self) -> tuple[int, int | None]:
        """Least and most characters that match; None: unbounded."""
        raise NotImplementedError

    def __add__(self, other: Regex) -> Regex:
        return sequence([self, other])

    def __or__(self, other: Regex) -> Regex:
        return union([self, other])

    def repeat(self, least: int = 0, most: int | None = None) -> Regex:
        if (least, most) == (1, 1):
            return self
        if most == 0 or isinstance(self, Text) and not self.value:
            return Text("")
        if isinstance(self, Repeat) and self.least <= 1 and self.most is None and least <= 1 and most is None:
            return Repeat(self.item, self.least * least, None)
        return Repeat(self, least, most)

    def single(self) -> str | None:
        """The one text that matches, or None if there are others."""
        return None

    def __str__(self) -> str:
        return self.text()


@dataclass(frozen=True)
class Text(Regex):
    value: str

    def text(self) -> str:
        return escape(self.value)

    def lengths(self):
        return len(self.value), len(self.value)

    def single(self):
        return self.value


@dataclass(frozen=True)
class Anchor(Regex):
    mark: str

    def text(self) -> str:
        return self.mark

    def lengths(self):
        return 0, 0


@dataclass(frozen=True)
class Any(Regex):
    def text(self) -> str:
        return "."

    def lengths(self):
        return 1, 1


@dataclass(frozen=True)
class Chars(Regex):
    """A class of characters, as sorted ranges that don't touch."""

    ranges: tuple[tuple[int, int], ...]
    exclude: bool = False

    @staticmethod
    def of(ranges: Iterable[tuple[int, int]], exclude: bool = False) -> Regex:
        merged: list[list[int]] = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        if len(merged) == 1 and merged[0][0] == merged[0][1] and not exclude:
            return Text(chr(merged[0][0]))
        return Chars(tuple((a, b) for a, b in merged), exclude)

    def text(self) -> str:
        quote = lambda c: "\\" + chr(c) if chr(c) in "]^-\\[&" else chr(c)
        body = "".join(quote(a) if a == b else f"{quote(a)}{quote(b)}" if b == a + 1 else f"{quote(a)}-{quote(b)}" for a, b in self.ranges)
        return f"[{'^' if self.exclude else ''}{body}]"

    def lengths(self):
        return 1, 1


@dataclass(frozen=True)
class Sequence(Regex):
    items: tuple[Regex, ...]

    def text(self) -> str:
        return "".join(f"(?:{x.text()})" if isinstance(x, Union) else x.text() for x in self.items)

    def lengths(self):
        all_ = [x.lengths() for x in self.items]
        return sum(a for a, _ in all_), None if any(b is None for _, b in all_) else sum(b for _, b in all_)


@dataclass(frozen=True)
class Union(Regex):
    items: tuple[Regex, ...]

    def text(self) -> str:
        return "|".join(x.text() for x in self.items)

    def lengths(self):
        all_ = [x.lengths() for x in self.items]
        return min(a for a, _ in all_), None if any(b is None for _, b in all_) else max(b for _, b in all_)


@dataclass(frozen=True)
class Repeat(Regex):
    item: Regex
    least: int
    most: int | None

    def text(self) -> str:
        inner = self.item.text()
        one = isinstance(self.item, (Any, Chars)) or isinstance(self.item, Text) and len(self.item.value) == 1
        inner = inner if one else f"(?:{inner})"
        mark = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((self.least, self.most))
        if mark is None:
            mark = f"{{{self.least}}}" if self.least == self.most else f"{{{self.least},{'' if self.most is None else self.most}}}"
        return inner + mark

    def lengths(self):
        a, b = self.item.lengths()
        return a * self.least, None if b is None or self.most is None else b * self.most


def sequence(items: Iterable[Regex]) -> Regex:
    """One after the other; neighbouring texts become one."""
    out: list[Regex] = []
    for x in items:
        for y in x.items if isinstance(x, Sequence) else (x,):
            if isinstance(y, Text) and not y.value:
                continue
            if out and isinstance(y, Text) and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + y.value)
            else:
                out.append(y)
    return out[0] if len(out) == 1 else Sequence(tuple(out)) if out else Text("")


def union(items: Iterable[Regex]) -> Regex:
    """Any of them: repeats dropped, single characters in one class, texts with a common beginning joined behind it.

    Earlier alternatives stay earlier where one could match instead of another.
    """
    flat: list[Regex] = []
    for x in items:
        for y in x.items if isinstance(x, Union) else (x,):
            if y not in flat:
                flat.append(y)
    chars = [x for x in flat if isinstance(x, Chars) and not x.exclude or isinstance(x, Text) and len(x.value) == 1]
    if len(chars) > 1 and len(chars) == len(flat):
        return Chars.of([r for x in chars for r in (x.ranges if isinstance(x, Chars) else ((ord(x.value), ord(x.value)),))])
    out: list[Regex] = []
    for x in flat:
        before = out[-1] if out else None
        head = before.items[0] if isinstance(before, Sequence) else before
        if isinstance(x, Text) and isinstance(head, Text) and x.value[:1] and x.value[:1] == head.value[:1]:
            n = next((i for i, (a, b) in enumerate(zip(x.value, head.value)) if a != b), min(len(x.value), len(head.value)))
            tail = sequence([Text(head.value[n:]), *(before.items[1:] if isinstance(before, Sequence) else ())])
            out[-1] = sequence([Text(head.value[:n]), union([tail, Text(x.value[n:])])])
        else:
            out.append(x)
    return out[0] if len(out) == 1 else Union(tuple(out))


def parse(pattern: str) -> Regex:
    """The expression that ``pattern`` writes: literals, escapes, classes, ``.``, anchors, groups, ``|`` and repeats."""
    at = 0

    def alternatives() -> Regex:
        nonlocal at
        options = [items()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(items())
        return union(options) if len(options) > 1 else options[0]

    def items() -> Regex:
        nonlocal at
        parts: list[Regex] = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated(atom()))
        return sequence(parts)

    def repeated(item: Regex) -> Regex:
        nonlocal at
        while at < len(pattern) and pattern[at] in "*+?{":
            c = pattern[at]
            at += 1
            if c == "{":
                stop = pattern.index("}", at)
                least, _, most = pattern[at:stop].partition(",")
                at = stop + 1
                item = item.repeat(int(least), int(least) if "," not in pattern[stop - len(least) - len(most) - 1 : stop] else int(most) if most else None)
            else:
                item = item.repeat(*{"*": (0, None), "+": (1, None), "?": (0, 1)}[c])
        return item

    def atom() -> Regex:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "(":
            if pattern.startswith("?:", at):
                at += 2
            inner = alternatives()
            if at >= len(pattern):
                raise ValueError("a group isn't closed")
            at += 1
            return inner
        if c == "[":
            return klass()
        if c == ".":
            return Any()
        if c in "^$":
            return Anchor(c)
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "b":
                return Anchor("\\b")
            if c == "x":
                at += 2
                return Text(chr(int(pattern[at - 2 : at], 16)))
            if c.isalnum() and c not in "nrt":
                raise ValueError(f"the escape \\{c} is not supported")
            return Text({"n": "\n", "r": "\r", "t": "\t"}.get(c, c))
        return Text(c)

    def klass() -> Regex:
        nonlocal at
        exclude = pattern[at] == "^"
        at += exclude
        ranges, first = [], True
        while first or pattern[at] != "]":
            first = False
            a = one()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                ranges.append((ord(a), ord(one())))
            else:
                ranges.append((ord(a), ord(a)))
        at += 1
        return Chars.of(ranges, exclude)

    def one() -> str:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = {"n": "\n", "r": "\r", "t": "\t"}.get(pattern[at], pattern[at])
            at += 1
        return c

    out = alternatives()
    if at != len(pattern):
        raise ValueError(f"unexpected {pattern[at]!r} at {at}")
    return out
