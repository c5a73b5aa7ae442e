import pytest

from bitloom.llm import encoding as E

TITLES = ["Forêt égarée", "Théâtre précieuse", "Märchen am großen Fluss", "Canção no chão", "Старый маяк после дождя", "Первый снег весной", "Νύχτα στην πόλη", "遠い灯台の記憶", "青い階段の歌", "Gewölbe der Vögel", "Niño pequeño", "Coração à toa", "Hidden Harbor", "Été précieuse", "Mädchen der Vögel"]
CLEAN = [f"{t}{e}" for t in TITLES for e in ("", " – № 3", "!", " (Reprise)")] + [f"{a} {b}" for a in ("Märchen", "Forêt", "Coração", "Niño", "Gewölbe") for b in ("égarée", "der Vögel", "pequeño", "no chão", "précieuse")]
CHAINS = [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("utf_16_le", "utf_16_be")]


@pytest.mark.parametrize(("right", "wrong"), CHAINS)
def test_chains_round_trip(right, wrong):
    chains, done = E.Chains(), 0
    for word in {w for t in TITLES for w in t.split() if not w.isascii()}:
        try:
            garbled = word.encode(right).decode(wrong)
        except UnicodeError:
            continue
        if garbled != word and " " not in garbled and not garbled.isascii():
            done += 1
            assert word in chains.restore(garbled).values(), (word, garbled)
    assert done


def test_finds_and_restores(spark):
    garbled = {}
    for i, (right, wrong) in enumerate(CHAINS[:6]):
        for t in TITLES:
            try:
                g = t.encode(right).decode(wrong)
            except UnicodeError:
                continue
            if g != t:
                garbled[g] = t
    rows = [(i, v) for i, v in enumerate(CLEAN * 4 + list(garbled) + [None, "", "plain", "Maçã do sert�o", "x" * 100_000])]
    got = E.find_garbled(spark.createDataFrame(rows, "item_id long, value string")).collect()
    assert len(got) == len(rows)
    found = {r["value"]: r for r in got}
    hit = sum(found[g]["garbled"] for g in garbled)
    restored = sum(found[g]["restored"] == t for g, t in garbled.items())
    wrong = [v for v in CLEAN if found[v]["garbled"]]
    assert hit >= 0.9 * len(garbled) and restored >= 0.8 * len(garbled), (hit, restored, len(garbled))
    assert len(wrong) <= 0.05 * len(CLEAN), wrong
    assert not found[None]["garbled"] and not found[""]["garbled"] and found["Maçã do sert�o"]["garbled"]
    assert E.find_garbled(spark.createDataFrame([], "item_id long, value string")).count() == 0


def test_clashing_columns(spark):
    got = E.find_garbled(spark.createDataFrame([(1, "a", "mine")], "item_id long, value string, chain string")).first()
    assert got["chain"] is None and got["restored"] == "a"


def test_short_words_and_signs_count(spark):
    """A value garbled only in a short word or in typographic signs is found by its UTF-8 sequence."""
    garbled = {"Manhã Ã\xa0 toa": "Manhã à toa", "Itâ€™s late": "It’s late", "Hidden Harbor â€“ live": "Hidden Harbor – live", "é›¨": "雨", "20 Â°C": "20 °C", "ΓÇ£Hidden HarborΓÇ¥": "“Hidden Harbor”"}
    signs = [v for n in ("Harbor", "Meadow", "Lantern", "Window") for v in (f"It’s the {n}", f"“Hidden {n}”", f"“Silver {n}”")]
    rows = [(i, v) for i, v in enumerate(CLEAN * 4 + signs + list(garbled))]
    found = {r["value"]: r for r in E.find_garbled(spark.createDataFrame(rows, "item_id long, value string")).collect()}
    assert not any(found[v]["garbled"] for v in signs)
    assert {g: (found[g]["garbled"], found[g]["restored"]) for g in garbled} == {g: (True, t) for g, t in garbled.items()}


@pytest.mark.parametrize("word", ["MANHÃ…", "MAÇÃ”", "Spaß”", "café…”", "ÚŽASNÝ", "Úžasný", "viðátta", "«amanhã»", "MANHÃ\xa0TOA", "AVÓ’S", "AVÓ…", "20°C", "Θάλασσα", "рассвете"])
def test_clean_neighbours_are_not_certain(word):
    assert not E.Chains().certain(word)


def test_rounds_and_words(spark):
    """Words are counted once; a garbled word leaves the model in the rounds, however its value goes on; p4_method's columns are there."""
    garbled = ["M\u00c3\u00a4rchen", "For\u00c3\u00aat", "p\u00e2\u0161r"]
    df = spark.createDataFrame([(v,) for v in CLEAN + [f"{g} {i}" for i, g in enumerate(garbled)]], "value string")
    words = E.count_words(df)
    first = E.count_trigrams(words)
    assert "rch" in first and all(n > 0 for n in first.values()) and not any("\u00c3\u00a4" in g for g in first)
    second = E.count_trigrams(words, spark.sparkContext.broadcast(first))
    assert sum(second.values()) <= sum(first.values())
    got = E.find_garbled(df).where("garbled").collect()
    assert {r["value"].split(" ")[0] for r in got} >= set(garbled[:2]) and all(r["margin"] > 0 for r in got)


def test_the_margin_is_that_of_all_values(spark):
    """Every distinct value counts, however many there are, and so does each of its garblings."""
    clean = sorted({f"{a} {b} {i}" for a in TITLES for b in TITLES for i in range(4)} - {f"Hidden Harbor Hidden Harbor {i}" for i in range(4)})
    assert len(clean) > 600
    df = spark.createDataFrame([(v,) for v in [*clean, "plain", "broken �é"]], "value string")
    counts = E.count_trigrams(E.count_words(df))
    reached, judge = E.margins_reached(df, spark.sparkContext.broadcast(counts)), E.Judge(E.Trigrams(counts))
    gains = [[judge.best(v)[0] for v in clean], [judge.best(g)[0] for v in clean for g in E.garblings(v)]]
    assert reached.sum(axis=1).tolist() == [len(clean), len(gains[1])]
    assert [[sum(g >= m for g in row) for m in E.MARGINS] for row in gains] == [[int(row[i + 1 :].sum()) for i in range(len(E.MARGINS))] for row in reached]
    errors = [sum(g >= m for g in gains[0]) / len(gains[0]) + sum(g < m for g in gains[1]) / len(gains[1]) for m in E.MARGINS]
    best = [m for m, e in zip(E.MARGINS, errors) if e <= min(errors) + 1e-9]
    assert E.validated_margin(reached) == (best[(len(best) - 1) // 2] + best[len(best) // 2]) / 2


def test_no_trigram_is_left_out(spark):
    n = 400_500
    words = spark.range(n).selectExpr("lower(hex(id)) as text", "1L as n", "cast(null as string) as restored", "true as gram", "true as clean")
    assert len(E.count_trigrams(words)) == n


def test_p4_method_accepts_by_the_margin_of_all_values(spark, tmp_path):
    from bitloom.llm import queries_encoding as Q

    values = sorted({f"{a} {b} {i}" for a in TITLES for b in TITLES for i in range(3)}) + ["Frühling am Gebüsch", "Gebüsch im Frühling", "Frⁿhling im Gebⁿsch"]
    rows = [(i, "MpegAudioMetadata", "title", v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "item_id long, meta_class string, meta_key string, value string").write.parquet(f"{tmp_path}/metadata_items.parquet")
    got = Q.p4_method(spark, str(tmp_path)).collect()
    df = spark.createDataFrame([(v,) for v in values], "value string")
    words = E.count_words(df)
    counts = E.count_trigrams(words)
    for _ in range(E.ROUNDS):
        counts = E.count_trigrams(words, spark.sparkContext.broadcast(counts))
    margin = E.validated_margin(E.margins_reached(df, spark.sparkContext.broadcast(counts)))
    assert {r["margin"] for r in got} == {margin} and len(got) == len(values)
    assert all(r["garbled"] == (r["gain"] >= margin) for r in got)
