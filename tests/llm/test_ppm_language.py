import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.llm import language as L
from bitloom.llm.ppm import Ppm

EN = ["The pump supports the circuit and the gear heats the sealing ring at regular intervals.", "In this case the filter closes the valve without additional tools.", "It has been found that the housing protects the spring over the entire length."]
DE = ["Die Pumpe stützt den Kreis und das Getriebe erwärmt die Dichtung in regelmäßigen Abständen.", "In diesem Fall verschließt das Filter das Ventil ohne zusätzliches Werkzeug.", "Es hat sich gezeigt, dass das Gehäuse die Feder über die gesamte Länge schützt."]
FR = ["La pompe soutient le circuit et l'engrenage chauffe la bague à intervalles réguliers.", "Dans ce cas, le filtre ferme la soupape sans outil supplémentaire.", "Il a été constaté que le boîtier protège le ressort sur toute la longueur."]


def plain_bits(training: list[bytes], segment: bytes, order: int) -> float:
    """Method C with frozen counts, byte by byte."""
    counts: dict = defaultdict(lambda: defaultdict(int))
    for t in training:
        padded = b"\n" * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[padded[i - k : i]][padded[i]] += 1
    total, padded = 0.0, b"\n" * order + segment
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            seen = counts.get(padded[i - k : i])
            if seen is None:
                continue
            t, d = sum(seen.values()), len(seen)
            if padded[i] in seen:
                total -= math.log2(seen[padded[i]] / (t + d))
                break
            total -= math.log2(d / (t + d))
        else:
            total += 8
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=6), st.integers(1, 4))
def test_against_byte_by_byte(segments, order):
    training = {"a": [x.encode() for x in EN], "b": [x.encode() for x in DE]}
    got = Ppm(training, order).bits([*segments, EN[0].encode()], block=16)
    for row, s in zip(got, [*segments, EN[0].encode()]):
        assert np.allclose(row, [plain_bits(training[k], s, order) for k in ("a", "b")], rtol=1e-4, atol=1e-3)


def test_no_training_and_no_segments():
    assert Ppm({}).bits([b"abc"]).shape == (1, 0)
    assert Ppm({"a": []}).bits([b"abc", b""]).tolist()[1] == [0.0]
    assert Ppm({"a": [b"x"]}).bits([]).shape == (0, 1)


@pytest.mark.parametrize(("line", "expected"), [(EN[0], True), ("ABSTRACT", False), ("Fe2O3 + 3 CO → 2 Fe + 3 CO2", False), ("\\frac{a_11}{b", False), ("1. Dispositif comprenant la lentille et le ressort.", True), ("Brief description of drawings", False), ("说明书", False), ("例如,所述透镜在关闭位置承载所述薄膜。", True), ("", False), ("DIE PUMPE STÜTZT DEN KREIS UND DAS GETRIEBE.", False)])
def test_running_text(line, expected):
    assert L.is_running(line) is expected


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_faults_segments_and_edges(spark):
    languages = spark.createDataFrame([("en", "eng", "English"), ("de", "ger", "German"), ("fr", "fre", "French")], "lang string, iso639_2 string, english_name string")
    train = [(i, "\n".join(x), lang) for i, (x, lang) in enumerate([(EN, "en"), (DE, " DE"), (FR, "fre"), (EN, "English"), (DE, "de-AT"), (FR, "FR")] * 3)]
    cases = [(100, EN[0], None), (101, EN[0], "de"), (102, EN[1] + "\n" + DE[1], "en"), (103, "ABSTRACT\n" + DE[2] + "\nFe2O3 + 3 CO", "xx"), (104, None, "en"), (105, "", "en"), (106, "CLAIMS", None), (107, EN[0] * 3000, "en")]
    found = L.identify(documents(spark, train + cases), languages)
    faults = {tuple(r) for r in L.label_faults(found).collect()}
    assert faults == {(100, "en"), (101, "en"), (102, "en"), (102, "de"), (103, "de")}
    segments = {r["doc_id"]: r["segments"] for r in found.where("doc_id >= 100").collect()}
    assert segments[104] == [] and segments[105] == [] and 0 < segments[102][0]["confidence"] <= 1
    assert L.label_faults(L.identify(documents(spark, []), languages)).count() == 0
    assert L.label_faults(L.identify(documents(spark, cases[:2]), languages.limit(0))).count() == 0


def test_held_out_accuracy():
    """Trained on half of the sentences and with a wrong label among them, the other half is told right."""
    words = {"en": EN, "de": DE, "fr": FR}
    rows = [(lang, "\n".join(x[:2])) for lang, x in words.items() for _ in range(4)] + [("en", "\n".join(FR[:2]))]
    model = L.train(iter(rows))
    for lang, x in words.items():
        assert model.labels[int(model.bits([x[2].encode()]).argmin())] == lang
