import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.functions import regexalg as R


@pytest.mark.parametrize("pattern", ["abc", "a|b", "foo|fool|foot", "(ab)+c?", "[a-z0-9]{2,4}x", "[^abc]*", "a.c", "^start", r"a\.b", "(a|b)(c|d)", "x{3}", "claim [0-9]+"])
def test_same_matches(pattern):
    got = R.parse(pattern).text()
    for text in ("abc", "a", "b", "fool", "foot", "foo", "ababc", "abc1x", "zzzx", "a.b", "axc", "start", "bd", "xxx", "claim 12", "", "azc"):
        assert bool(re.search(got, text)) == bool(re.search(pattern, text)), (got, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc.+", min_size=1, max_size=5), min_size=1, max_size=6), st.text("abc.+", max_size=5))
def test_union_of_texts(texts, probe):
    r = R.union([R.Text(t) for t in texts])
    assert bool(re.fullmatch(r.text(), probe)) == (probe in texts)
    assert r.lengths() == (min(map(len, texts)), max(map(len, texts)))


def test_algebra():
    assert (R.parse("a") | R.parse("b") | R.parse("c")).text() == "[a-c]"
    assert (R.Text("ab") + R.Text("c")).single() == "abc"
    assert R.parse("a").repeat(0, None).repeat(1, None).text() == "a*"
    assert R.parse("a+").lengths() == (1, None)
    with pytest.raises(ValueError):
        R.parse("(a")
