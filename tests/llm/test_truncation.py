import itertools
import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.llm import nearcopies as N
from bitloom.llm import truncation as T

WORDS = ["Silver", "Golden", "Broken", "Hidden", "Quiet"]
NOUNS = ["Harbor", "Meadow", "Telescope", "Lantern", "Cathedral"]
SCHEMA = "row_id long, source_id long, volume_id int, kind string, field string, value string"


def rows(spark, extra):
    titles = [f"{a} of the {w} {b}" for a, w, b in itertools.product(NOUNS, WORDS, NOUNS)]
    data = [(i, 1000 + i, 1, "title", "title", t) for i, t in enumerate(titles)]
    comments = [f"The {a.lower()} was moved to the {b.lower()} by the volunteers." for a, b in itertools.product(NOUNS, NOUNS)]
    data += [(500 + i, 3000 + i, 1, "comment", "comment", c) for i, c in enumerate(comments)]
    return spark.createDataFrame(data + extra, SCHEMA)


def test_cut_values(spark):
    cut = ["Harbor of the Sil", "Meadow of th", "Lantern of the", "Harbor of the Quiet Teles"]
    whole = ["Silver Harbor", "Harbor of the Silver Meadow", "Harbor of the Silver Meadow (Reprise)", None, "", "  ", "untitled", "x" * 50_000]
    extra = [(10_000 + i, 5000 + i, 2, "title", "title", v) for i, v in enumerate(cut + whole)]
    comments = ["The harbor was moved to the mead", "The harbor was moved", "The harbor was moved to the meadow by the"]
    extra += [(20_000 + i, 6000 + i, 2, "comment", "comment", v) for i, v in enumerate([*comments, "The harbor was moved to the meadow by the volunteers", "The harbor was moved to the meadow by the volunteers. :-)"])]
    extra += [(30_000, 9, 2, "title", "title", "Unseen Words Entirely"), (30_001, 9, 2, "title", "title", "Unseen Words Entirely Longer")]
    extra += extra[:3]
    got = {r["row_id"]: r for r in T.find_truncated(rows(spark, extra)).collect()}
    assert {i for i, r in got.items() if r["cut"] and 10_000 <= i < 20_000} == {10_000 + i for i in range(len(cut))}
    assert {i for i, r in got.items() if r["cut"] and 20_000 <= i < 30_000} == {20_000 + i for i in range(len(comments))}
    assert got[30_000]["why"] == "copy" and not got[30_001]["cut"]
    assert sum(r["cut"] for i, r in got.items() if i < 10_000) == 0
    assert T.find_truncated(rows(spark, []).limit(0)).count() == 0


def distinct(spark, norms, kind="comment"):
    return spark.createDataFrame([(kind, x) for x in norms], "kind string, norm string")


def test_near_copies_meet(spark):
    """A copy cut anywhere meets the whole value, which continues it."""
    value = "the second take was recorded inside the limestone chapel with two ribbon microphones."
    cuts = [value[:n] for n in range(1, len(value) - 1) if value[n - 1].isalpha() and value[n].isalpha()]
    found = {r["norm"]: r["how"] for r in N.continued(distinct(spark, [value, *cuts])).collect()}
    assert found == dict.fromkeys(cuts, "word")


def test_recall_of_the_bands_on_edited_copies(spark):
    """Of copies cut within a word, with one or two random edits before the closing word, 9 in 10 are found."""
    rnd = random.Random(4)
    places = ["in the old granary", "beside the abandoned railway", "behind the northern workshop", "at the municipal theatre", "on the upper balcony"]
    wholes = [f"{a} {c} {b} was {v} {p} by {n} volunteers in {y}" for a, c, b, v, p, n, y in itertools.product(["the", "an"], ["quiet", "broken"], ["harbor", "cathedral", "lantern"], ["stored", "restored"], places, ["seven", "thirteen"], ["november", "february"])]
    cut = {}
    for whole in wholes:
        at = rnd.choice([i for i in range(24, len(whole)) if whole[i - 2 : i + 1].isalpha()])
        text, edge = list(whole[:at]), whole.rfind(" ", 0, at)
        for _ in range(rnd.choice([1, 2])):
            i = rnd.randrange(edge - 1)
            text[i : i + 1] = rnd.choice([[], [rnd.choice("aeioustrn")], [text[i], rnd.choice("aeioustrn")]])
        cut["".join(text)] = whole
    found = {r["norm"]: r for r in N.continued(distinct(spark, [*wholes, *cut])).collect()}
    assert len(found.keys() & cut.keys()) >= 0.9 * len(cut) and not found.keys() & set(wholes)
    assert all(N.edits(r["norm"], r["copy"][: len(r["norm"])], 99) <= 0.4 * len(r["norm"]) for r in found.values())


def test_ranges_lose_no_link(spark, monkeypatch):
    """A bucket that is cut into many ranges gives what one task gives."""
    texts = [f"one beginning for all of them {a}{b}{c}" for a, b, c in itertools.product(["", "x", "xy", "z"], ["", "q", "qu"], ["", "r", " rest"])]
    monkeypatch.setattr(N, "TASK_ROWS", 10)
    df = distinct(spark, texts)
    expected = {t for t in texts if any(o.startswith(t) and N.goes_on(t, o[len(t) : len(t) + 2]) == "word" for o in texts)}
    assert {r["norm"] for r in N.continued(df).where("how = 'word'").collect()} >= expected


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(0, 12))
def test_edits_against_brute_force(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    assert N.edits(a, b, most) == min(row[-1], most + 1)


def test_small_differences_and_later_followers(spark):
    whole = "the second take was recorded inside the limestone chapel with two ribbon microphones."
    near = ["the secund take was recorded inside the limestone chapel with two ribb", "second take was recorded inside the limestone chapel with two ribbon micro", "thé second take, was recorded inside the limestone chapel with two ribbon mi"]
    after = ["route 1", "route 12", "route 1 north", "an ox", "an ox-cart", "an ox!", "an oxen", "a", "a lone beginning far shorter than what goes on after it, which shares no bucket with it"]
    other = "the second tale was recorded beside a limestone quarry with two ribb"
    found = {r["norm"]: r["how"] for r in N.continued(distinct(spark, [whole, *near, *after, other, "", "x" * 30_000])).collect()}
    assert {n: found.get(n) for n in near} == dict.fromkeys(near, "word")
    assert found["an ox"] == "word" and found["route 1"] == "space" and found["a"] == "word"
    assert not found.keys() & {whole, other, "an oxen", "route 12"}
    assert N.continued(distinct(spark, [])).count() == 0


def test_one_letter_and_blank_ends(spark):
    extra = [(50_000 + i, 8000 + i, 2, "comment", "comment", "Side B") for i in range(30)]
    extra += [(51_000, 1, 2, "title", "title", "Harbor of the B"), (51_001, 1, 2, "title", "title", "Meadow in Some "), (51_002, 1, 2, "title", "title", "Meadow in Some  ")]
    got = {r["row_id"]: r["why"] for r in T.find_truncated(rows(spark, extra)).where("row_id >= 50000").collect()}
    assert not any(got[i] for i in range(50_000, 50_030)) and got[51_000] and got[51_001] == "closing" and not got[51_002]


def test_every_copy_of_a_source_counts(spark):
    copies = ["Unseen Words Enti", "Unseen Words Entirely", "Quite another and much longer title than those"]
    got = {r["value"]: r["why"] for r in T.find_truncated(rows(spark, [(40_000 + i, 77, 2, "title", "title", v) for i, v in enumerate(copies)])).where("source_id = 77").collect()}
    assert got == {copies[0]: "copy", copies[1]: None, copies[2]: None}


def test_no_pair_within_the_similarity_is_left_out(spark, monkeypatch):
    """Every value has the copy that comparing all pairs gives, wherever the differences before the closing word are, and however keys are spread."""
    rnd = random.Random(7)
    wholes = [f"{a} {c} {b} was {v} {p}" for a, c, b, v, p in itertools.product(["the", "an"], ["quiet", "broken"], ["harbor", "cathedral"], ["stored", "restored"], ["in the old granary", "beside the railway", "at the theatre (twice)"])]
    texts = {*wholes, "an ox", "on oxen", "a longestword", "longestwords and more"}
    for whole in wholes * 3:
        cut = list(whole[: rnd.randrange(6, len(whole))].rstrip())
        for _ in range(rnd.randrange(1, 6)):
            i = rnd.randrange(len(cut))
            cut[i : i + 1] = rnd.choice([[], [rnd.choice("aeiou ")], [cut[i], rnd.choice("aeiou")]])
        texts.add(" ".join("".join(cut).split()))
    expected = {}
    for value in texts - {""}:
        before = value.rfind(" ") + 1
        for text in texts:
            for at in [0] + [i + 1 for i, c in enumerate(text) if c == " "]:
                end = at + len(value) - before
                how = N.goes_on(value, text[end : end + 2]) if text[at:end] == value[before:] else None
                most = int((1 - N.SIMILARITY) * len(value) + 1e-9)
                if how and (d := N.edits(value[:before], text[:at], most)) <= most:
                    expected[value] = max(expected.get(value, ("", -99)), (how, -d))
    monkeypatch.setattr(N, "TASK_VALUES", 10)
    got = {r["norm"]: (r["how"], -r["edits"]) for r in N.all_continued(distinct(spark, sorted(texts - {""}))).collect()}
    assert len(expected) > 50 and expected["an ox"] == ("word", -1) and expected["a longestword"] == ("word", -2)
    assert {v: got.get(v, ("", -99)) for v, best in expected.items() if got.get(v, ("", -99)) < best} == {}


def test_known_closing_words_have_their_copies(spark):
    """A whole word that is known from elsewhere isn't a cut, but the copy with differences is shown."""
    extra = [(60_000, 1, 2, "title", "title", "Harbour of the Silver Meadow"), (60_001, 2, 2, "title", "title", "Harbor of the Silver Meadow Again")]
    got = T.find_truncated(rows(spark, extra)).where("row_id = 60000").first()
    assert (got["copy"], got["how"], got["edits"], got["cut"]) == ("harbor of the silver meadow a", "space", 1, False)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=40), st.lists(st.tuples(st.integers(0, 39), st.sampled_from(["", "a", "xb"])), max_size=5))
def test_marks_rule_out_no_pair_within_the_edits(a, changes):
    """Whatever the edits, neither text lacks more marks of the other than two for each; texts of other words lack more."""
    b = a
    for i, c in changes:
        b = b[:i] + c + b[i + 1 :]
    most = N.edits(a, b, 99)
    one, other = (N._marks_at(x + "end", [len(x)])[0] for x in (a, b))
    assert max(sum((x & ~y & (1 << 64) - 1).bit_count() for x, y in zip(p, q)) for p, q in ((one, other), (other, one))) <= 2 * most
    apart = [N._marks_at(x, [len(x)])[0] for x in ("the second take was recorded inside", "please contact our new librarian at")]
    assert sum((x & ~y & (1 << 64) - 1).bit_count() for x, y in zip(*apart)) > 2 * 7


def test_marks_of_beginnings_are_those_of_the_text_alone():
    text = "the second take was recorded inside the limestone chapel"
    places = [0] + [i + 1 for i, c in enumerate(text) if c == " "]
    assert N._marks_at(text, places) == [N._marks_at(text[:at], [at])[0] for at in places]


def test_distances_of_many_pairs_are_those_of_each():
    """Patterns of one and more words of 64 bits, of none and of very many; few pairs and many at once; letters that only one side has."""
    rnd = random.Random(5)
    patterns = ["".join(rnd.choice("ab c日") for _ in range(n)) for n in [0, 1, 30, 63, 64, 65, 127, 128, 129, 200] * 8 + [2_100]]
    texts = []
    for p in patterns:
        text = list(p)
        for _ in range(rnd.randrange(30)):
            i = rnd.randrange(len(text) + 1)
            text[i : i + 1] = rnd.choice([[], ["a"], ["b", "é"]])
        texts.append("".join(text))
    pairs = [(i, j) for i in range(len(patterns)) for j in [i, *rnd.sample(range(len(texts)), 25)]]
    of, to = np.array(pairs).T
    most = np.array([rnd.choice([0, 3, 12, 60, 500]) for _ in pairs])
    got = N.distances(patterns, texts, of, to, most)
    expected = [N.edits(patterns[i], texts[j], m) for (i, j), m in zip(pairs, most.tolist())]
    assert np.minimum(got, most + 1).tolist() == expected and sum(got <= most) > 200


def test_batches_of_the_join_lose_no_pair():
    """However rows are cut into batches, and pairs into portions, the same pairs are found, also where a key is in many batches."""
    heads = [f"the {a} {b} was moved to the {c} by all" for a, b, c in itertools.product(["old", "odd", "new"], ["harbor", "harbour", "lantern"], ["meadow", "meadows", "hall"])]
    asked = [x[:-9].replace("the ", "te ", 1) for x in heads if "meadow " in x]
    rows = []
    for key, word in enumerate(["meadow", "meadows", "hall"]):
        starts = [(x, x.find(f" {word} ") + 1) for x in heads if f" {word} " in x]
        rows += [(key, "comment", word, x, x.rfind(" ") + 1, int((1 - N.SIMILARITY) * len(x))) for x in asked if word.startswith("meadow")]
        rows += [(key, "comment", word, x[: at + len(word) + 2], at, -1) for x, at in starts]
    table = pd.DataFrame(rows, columns=["key", "kind", "word", "text", "at", "most"])

    def run(size):
        found = pd.concat([x for x in N._near(table.iloc[i : i + size] for i in range(0, len(table), size))])
        return sorted(set(found.itertuples(index=False, name=None)))

    whole, expected = run(len(table)), set()
    for x, y in itertools.product(asked, heads):
        if " meadow" in y:
            most = int((1 - N.SIMILARITY) * len(x))
            if N.edits(x[: x.rfind(" ") + 1], y[: y.find(" meadow") + 1], most) <= most:
                expected.add((x, y[: y.find(" by ") + 2]))
    assert len(whole) >= 9 and {(r[1], r[4]) for r in whole} == expected
    assert run(1) == run(7) == whole


def test_letters_and_marks_are_those_of_each_text_alone():
    """However texts are portioned, and for empty ones; letters differ by one for each edit at most."""
    texts = ["", "a", "the old harbor", "x" * 600_000, "日本", ""] + [f"harbor {i}" for i in range(1_100)]
    assert N.letters_of(texts).tolist() == [N.letters_of([x])[0].tolist() for x in texts]
    assert N.marks_of(texts).T.tolist() == [N.marks_of([x]).T[0].tolist() for x in texts]
    assert N.letters_of(texts).sum(axis=1).tolist() == [len(x) for x in texts] and N.letters_of([]).shape == (0, N.LETTER_CLASSES)
