import json

from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.operators import nested as N

NAMES = frozenset(N.REPEATING)


def paths(body):
    return sorted("/" + "/".join(steps) for _, steps, _ in N.walk(body, NAMES))


def test_paths_of_lists_lone_objects_nulls_and_encoded_text():
    body = json.dumps({"page": [{"segments": {"chunk": [{"a": 1}, None, {"b": 2}]}}, None, {"comment": json.dumps({"metadata": {"k": 1}})}], "x": {"descr": 5}})
    assert paths(body) == ["/page[0]", "/page[0]/segments/chunk[0]", "/page[0]/segments/chunk[2]", "/page[2]", "/page[2]/comment/metadata[0]"]
    assert paths(json.dumps({"atom": json.dumps([{"atom": []}, {"descr": {}}])})) == ["/atom[0]", "/atom[1]", "/atom[1]/descr[0]"]


def test_unreadable_bodies_give_nothing():
    for body in (None, "", "not available", '{"page": [{"a": 1}', "[" * 100_000, "null", "5", '"text"'):
        assert paths(body) == []


def brute(value, path, parent, out):
    """A plain recursion as the rule is stated."""
    if isinstance(value, str) and value[:1] in ("{", "["):
        try:
            value = json.loads(value)
        except ValueError:
            return
    if isinstance(value, list):
        for x in value:
            brute(x, path, parent, out)
    if isinstance(value, dict):
        for name, inner in value.items():
            if name in NAMES:
                inner = inner if isinstance(inner, list) else [inner]
                for i, x in enumerate(inner):
                    if isinstance(x, dict):
                        own = f"{path}/{name}[{i}]"
                        out.append((own, parent or "/"))
                        brute(x, own, own, out)
            else:
                brute(inner, f"{path}/{name}", parent, out)


trees = st.recursive(st.none() | st.integers() | st.sampled_from(["a", "b"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["page", "chunk", "atom", "x", "y"]), x, max_size=3), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from(["page", "chunk", "x"]), trees, max_size=3))
def test_against_plain_recursion(tree):
    expected: list = []
    brute(tree, "", "", expected)
    got = [("/" + "/".join(s), "/" + "/".join(s[:-1])) for _, s, _ in N.walk(json.dumps(tree), NAMES)]
    assert sorted(got) == sorted((a, b) for a, b in expected)


def test_flatten_links_and_repeated_deliveries(spark):
    body = json.dumps({"Segment": {"Tracks": [{"TrackEntry": [{"TrackNumber": {"unsigned": 7}}, {}]}]}})
    df = spark.createDataFrame([(1, body, "x"), (1, body, "x"), (2, None, "x"), (3, "", "x"), (None, body, "x")], "record_id long, body string, path string")
    flat = N.flatten(N.label_nodes(df))
    rows = {r["path"]: r for r in flat.collect()}
    assert sorted(rows) == ["/Segment[0]", "/Segment[0]/Tracks[0]", "/Segment[0]/Tracks[0]/TrackEntry[0]", "/Segment[0]/Tracks[0]/TrackEntry[1]"]
    assert rows["/Segment[0]"]["parent_path"] == "/" and rows["/Segment[0]/Tracks[0]/TrackEntry[1]"]["parent_path"] == "/Segment[0]/Tracks[0]"
    labels = {r["label"] for r in rows.values()}
    assert all(r["parent_label"] in labels | {""} for r in rows.values())
    assert N.table_of(flat, "TrackEntry", {"n": "$.TrackNumber.unsigned"}).where("n = 7").count() == 1
    assert N.flatten(N.label_nodes(df.limit(0))).count() == 0


def test_members_of_every_table(spark, tmp_path):
    from bitloom.plans import training_core as C

    page = {"page_no": "7", "lacing": [1, 2], "last_page": True, "segments": {"chunk": [{"size": 3, "vorbis_hdr": {"rate": 8}}], "n": 1}, "x": None, "y": [{"a": 1}, {"a": 2}]}
    atom = {"type": "esds", "descr": [{"tag": 3, "ES_ID": 1, "descr": json.dumps([{"tag": 4, "decConfigDescr": {"b": 5}}])}, None, 5]}
    data = [(1, json.dumps({"page": [page]})), (2, json.dumps({"atom": atom})), (2, json.dumps({"atom": atom}))]
    spark.createDataFrame(data, "record_id long, body string").write.parquet(f"{tmp_path}/container_records.parquet")
    rows = {r["path"]: r for r in C.p3_rows(spark, str(tmp_path)).collect()}
    assert {p: r["members"] for p, r in rows.items()} == {
        "/page[0]": {"page_no": "7", "lacing": "[1, 2]", "last_page": "true", "segments/n": "1", "x": None, "y[0]/a": "1", "y[1]/a": "2"},
        "/page[0]/segments/chunk[0]": {"size": "3", "vorbis_hdr/rate": "8"},
        "/atom[0]": {"type": "esds", "descr[2]": "5"},
        "/atom[0]/descr[0]": {"tag": "3", "ES_ID": "1"},
        "/atom[0]/descr[0]/descr[0]": {"tag": "4", "decConfigDescr/b": "5"},
    }
    assert rows["/atom[0]/descr[0]/descr[0]"]["parent_path"] == "/atom[0]/descr[0]"
    assert [(r["page_no"], r["lacing"]) for r in C.p3_page(spark, str(tmp_path)).collect()] == [("7", "[1, 2]")]
    assert {(r["path"], r["parent_path"], r["tag"]) for r in C.p3_descr(spark, str(tmp_path)).collect()} == {("/atom[0]/descr[0]", "/atom[0]", "3"), ("/atom[0]/descr[0]/descr[0]", "/atom[0]/descr[0]", "4")}
    assert {r["longest_label"] for r in C.p3_tables(spark, str(tmp_path)).collect()} == {"1", "1.1", "1.1.1"}
