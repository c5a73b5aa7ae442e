from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitloom.llm import mixing, packing, tokens

item = st.tuples(st.integers(1, 300), st.sampled_from([None, 1, 2, 3]), st.sampled_from("ab"))


@settings(max_examples=200, deadline=None)
@given(st.lists(item, max_size=60), st.integers(20, 150))
def test_packing_holds_its_promises(items, capacity):
    rows = [(i, s, c, o) for i, (s, c, o) in enumerate(items)]
    packed = packing.pack_shard(rows, capacity)
    bins, sizes, members = defaultdict(int), defaultdict(int), defaultdict(list)
    for b, i, piece, size in packed:
        bins[b] += size
        sizes[i] += size
        members[b].append(i)
    assert max(bins.values(), default=0) <= capacity
    assert dict(sizes) == {i: s for i, s, _, _ in rows}
    for i, s, _, _ in rows:
        assert sum(1 for _, j, _, _ in packed if j == i) == (1 if s <= capacity else -(-s // capacity))
    for held in members.values():
        clusters = [rows[i][2] for i in held if rows[i][2] is not None]
        assert len(clusters) == len(set(clusters))


def brute(items, capacity):
    """Best fit, largest first, by comparing every container."""
    bins = []
    for i, size, cluster in sorted(items, key=lambda x: (-x[1], x[0])):
        fits = [b for b in bins if b[0] >= size and cluster not in b[1]]
        b = min(fits, key=lambda b: b[0]) if fits else None
        if b is None:
            b = [capacity, set()]
            bins.append(b)
        b[0] -= size
        b[1].add(cluster)
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 2)), max_size=200))
def test_as_tight_as_brute_force_with_hot_clusters(items):
    rows = [(i, s, c) for i, (s, c) in enumerate(items)]
    packed = packing.pack_shard([(i, s, c, "x") for i, s, c in rows], 50)
    assert len({b for b, *_ in packed}) == brute(rows, 50)


def test_pack_tables(spark):
    rows = [(1, 10, 1, "a"), (2, 25, None, None), (3, 0, 1, "a"), (4, None, 1, "a"), (5, 7, 1, "b")]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, cluster long, source string").fillna(0, ["tokens"])
    got = packing.pack(df, {1: 20, 2: 100}, df.count()).collect()
    assert {(r["pack_id"], r["doc_id"]): 0 for r in got}.keys() == {(p, d) for p in (1, 2) for d in (1, 2, 5)}
    assert packing.pack(df.limit(0), {1: 20}, 0).count() == 0 and packing.pack(df, {}, 5).count() == 0


def test_tokens(spark):
    text = "The pump supports the circuit. " * 100
    assert tokens.count_tokens(None) == 0 and tokens.count_tokens("") == 0 and tokens.count_tokens(text) > 100
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tokens.token_count(F.col("t"))).collect()] == [tokens.count_tokens(text), 0, 0]


def corpus(spark):
    rows = [(i, "big" if i % 3 else "small", 50 + i % 7, 1.0 + i % 2) for i in range(3000)] + [(9000, None, 10, 1.0), (9001, "big", 0, 1.0), (9002, "other", 10, None)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long, weight double")


def test_mix_meets_shares_and_repeats(spark):
    targets = spark.createDataFrame([(1, "big", 0.4, 1), (1, "small", 0.6, 3), (2, "big", 0.5, 2), (2, "small", 0.5, 2), (3, "big", 1.0, 1), (3, "none", 0.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    mixed = mixing.mix(corpus(spark), targets)
    for r in mixing.shares(mixed, targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.005 and r["most_copies"] <= r["max_repeats"], r
    assert mixed.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    held = corpus(spark).where("source = 'small' and tokens > 0").count()
    first = mixed.where("mix_id = 1 and source = 'small'")
    assert first.where("copies = 3").count() == held  # its repeats limit the mix, so all epochs are complete
    assert mixing.mix(corpus(spark).limit(0), targets).count() == 0 and mixing.mix(corpus(spark), targets.limit(0)).count() == 0


def test_selection_is_that_of_a_plain_sort(spark):
    targets = spark.createDataFrame([(1, "big", 0.5, 1), (1, "small", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    got = {r["doc_id"] for r in mixing.mix(corpus(spark), targets).where("source = 'big'").collect()}
    keys = corpus(spark).where("source = 'big' and tokens > 0").select("doc_id", "tokens", mixing.sampling_key(F.concat_ws(":", F.lit(1), "doc_id"), F.col("weight")).alias("key")).orderBy("key", "doc_id").collect()
    budget = corpus(spark).where("source = 'small'").agg(F.sum("tokens")).first()[0]
    expected, used = set(), 0
    for r in keys:
        if used + r["tokens"] / 2 <= budget:
            expected.add(r["doc_id"])
        used += r["tokens"]
    assert got == expected


@pytest.mark.parametrize("weight", [1.0, 4.0])
def test_heavy_documents_come_first(spark, weight):
    df = spark.range(20_000).select(mixing.sampling_key(F.col("id").cast("string"), F.lit(weight)).alias("k"))
    assert abs(df.agg(F.avg("k")).first()[0] - 1 / weight) < 0.03 / weight


def test_pieces_count_as_the_whole_text(monkeypatch):
    """Texts with and without line ends, runs of blanks and no blanks at all: pieces of any size give the same count."""
    from bitloom.llm import tokens

    texts = ["One line.\nAnother  line with   blanks\n\n  and more, 12345 67.\n" * 5, "no line end but words, numbers 123 and signs -- " * 6, "x" * 400, "日本語 テキスト\n" * 20, " \n \t" * 50]
    whole = [tokens.count_tokens(t) for t in texts]
    for size in (7, 16, 50, 99):
        monkeypatch.setattr(tokens, "PIECE", size)
        assert [tokens.count_tokens(t) for t in texts] == whole


def test_targets_without_documents_have_a_reason(spark):
    from bitloom.llm import mixing

    docs = spark.createDataFrame([(i, "a", 10, 1.0) for i in range(20)], "doc_id long, source string, tokens long, weight double")
    targets = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.5, 1), (1, "c", 0.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    got = {r["source"]: r["reason"] for r in mixing.shares(mixing.mix(docs, targets), targets).collect()}
    assert got == {"a": None, "b": "no documents", "c": "no share"}
