from bitloom.operators import fields


def table(spark):
    rows = [(1, "/a", "/", 0, 0, 32, "x"), (1, "/a/b", "/a", 1, 0, 8, "1"), (1, "/a/c", "/a", 2, 8, 24, None), (1, "/d", "/", 3, 40, 8, "")]
    return spark.createDataFrame(rows, "source_id long, path string, parent_path string, ordinal int, address_bits long, size_bits long, value string")


def test_containing_is_innermost(spark):
    probes = spark.createDataFrame([(1, 0), (1, 9), (1, 35), (1, 44), (2, 0)], "source_id long, probe_bits long")
    got = {(r["source_id"], r["probe_bits"]): r["path"] for r in fields.containing(probes, table(spark), page_bits=16).collect()}
    assert got == {(1, 0): "/a/b", (1, 9): "/a/c", (1, 35): None, (1, 44): "/d", (2, 0): None}


def test_gaps_paths_and_lines(spark):
    t = table(spark)
    assert [tuple(r) for r in fields.gaps(t.where("parent_path = '/'"), "source_id", "address_bits", "size_bits", spark.createDataFrame([(1, 0, 48)], "source_id long, start int, length int")).collect()] == [(1, 32, 8)]
    assert fields.by_path(t, "/a/b/../c").first()["path"] == "/a/c"
    docs = spark.createDataFrame([(1, "é\nb"), (2, ""), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in fields.lines(docs).orderBy("doc_id", "ordinal").select("doc_id", "address", "size", "value").collect()] == [(1, 0, 3, "é"), (1, 3, 1, "b"), (2, 0, 0, "")]
    assert fields.grep(t, None).count() == 2


def test_gaps_cover_the_whole_range(spark):
    blocks = spark.createDataFrame([("a", x, n) for x, n in [(15, 3), (6, 2), (6, 2), (1, 2), (2, 3), (11, 2), (9, 5)]] + [("c", None, 3), ("c", 0, 20)], "k string, at int, n int")
    ranges = spark.createDataFrame([("a", 0, 20), ("b", 5, 7), ("c", 0, 20)], "k string, start int, length int")
    got = {tuple(r) for r in fields.gaps(blocks, "k", "at", "n", ranges).collect()}
    assert got == {("a", 0, 1), ("a", 5, 1), ("a", 8, 1), ("a", 14, 1), ("a", 18, 2), ("b", 5, 7)}


def test_depths_of_long_chains_cycles_and_orphans(spark):
    rows = [("s", f"n{i}", f"n{i - 1}" if i else "/") for i in range(1500)] + [("s", "x", "y"), ("s", "y", "x"), ("s", "lost", "nowhere"), ("t", "n0", "/"), ("t", "n0", "/"), ("t", None, "/")]
    got = {(r["k"], r["node"]): r["depth"] for r in fields.depths(spark.createDataFrame(rows, "k string, node string, up string"), ["k"], "node", "up").collect()}
    assert got == {**{("s", f"n{i}"): i + 1 for i in range(1500)}, ("t", "n0"): 1}
