"""Languages of documents and of their passages, with confidences, by prediction by partial matching.

A passage is a paragraph (a line). Its language is the class whose frozen byte model gives it the shortest code. Only
running text decides: headings, formulas and lines with too few letters take part in no language.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.ppm import Ppm

#: Most training documents per language, and their choice by hash: the bounds of the labelled sample.
SAMPLE_PER_LANGUAGE = 200
ORDER = 4
#: Characters of documents that are scored together.
SCORED_AT_ONCE = 100_000

SEGMENTS = "array<struct<start:int,stop:int,lang:string,confidence:double,running:boolean>>"

_WORDS = re.compile(r"(?:[^\W\d_]{3,}[\W\d_]+(?:[^\W\d_]{1,2}[\W\d_]+)*?){3}[^\W\d_]{3}")
_MANY_WORDS = re.compile(r"(?:[^\W\d_]+[\W\d_]+){7}[^\W\d_]")
_CJK = "぀-ヿ㐀-鿿"
_CHARACTERS = re.compile(rf"(?:[{_CJK}][^{_CJK}]*){{8}}")
_MANY_CHARACTERS = re.compile(rf"(?:[{_CJK}][^{_CJK}]*){{20}}")
_SENTENCE_END = re.compile(r"[.!?;:。．!?；：][\"'»”’)\]）」』]*\s*$")


def is_running(line: str) -> bool:
    """Running text: at least four words in a row (eight Chinese or Japanese characters) that end like a sentence, or twice as
    many however they end, not all in capitals; headings, formulas and numbers aren't."""
    ends = _SENTENCE_END.search(line[-20:]) is not None
    if _CHARACTERS.search(line):
        return ends or _MANY_CHARACTERS.search(line) is not None
    return _WORDS.search(line) is not None and (ends or _MANY_WORDS.search(line) is not None) and not line.isupper()


_LINE = re.compile(r"[^\r\n]+")


def split_lines(text: str) -> list[tuple[int, int]]:
    """(start, stop) of every line that isn't blank."""
    return [(m.start(), m.end()) for m in _LINE.finditer(text) if not m.group().isspace()]


def train(rows: Iterator[tuple[str, str]], order: int = ORDER) -> Ppm:
    """A model of labelled texts (language, text).

    Wrong labels are found by the model itself: each half of the texts is scored by the model of the other half, and
    paragraphs that another language codes shorter are left out of the model that is returned.
    """
    halves: list[dict[str, list[bytes]]] = [{}, {}]
    for i, (lang, text) in enumerate(rows):
        for half in halves:
            half.setdefault(lang, [])
        halves[i % 2][lang].extend(line.encode("utf-8", "replace") for a, b in split_lines(text) if is_running(line := text[a:b]))
    kept: dict[str, list[bytes]] = {lang: [] for lang in halves[0]}
    for half, other in (halves, halves[::-1]):
        model = Ppm(other, order)
        for j, lang in enumerate(model.labels):
            best = model.bits(half[lang]).argmin(axis=1) if half[lang] else []
            kept[lang] += [x for x, b in zip(half[lang], best) if b == j]
    return Ppm(kept, order)


def canonical_language(label: Column, languages: DataFrame) -> Column:
    """The code of the table ``languages`` that ``label`` is a notation of (case, spaces, three letters, region, name), or null.

    The table is a fixed list of languages; it becomes a literal map.
    """
    known = {}
    for r in languages.select("lang", "iso639_2", "english_name").collect():
        known |= {str(x).strip().lower(): r["lang"] for x in r if x}
    if not known:
        return F.lit(None).cast("string")
    text = F.lower(F.trim(label))
    at = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.element_at(at, text), F.element_at(at, F.regexp_replace(text, r"[-_].*$", "")))


def fit(documents: DataFrame, code: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Ppm:
    """A model from at most about ``per_language`` labelled documents a language, chosen by a hash of doc_id."""
    labelled = documents.select("doc_id", code.alias("code"), "text").where("code is not null and text is not null")
    counts = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Ppm({})
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, per_language / n))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("code")) * 1_000_000)
    return train((r["code"], r["text"]) for r in chosen.select("code", "text").orderBy("doc_id").limit(2 * per_language * len(counts)).toLocalIterator())


def segmenter(model) -> Callable[[pd.Series], pd.Series]:
    """A function from texts to their passages; ``model`` is a broadcast of :class:`Ppm`."""

    def flush(ppm: Ppm, waiting: list, out: list) -> None:
        lines = [text[a:b] for text, spans in waiting for a, b in spans]
        bits = ppm.bits([x.encode("utf-8", "replace") for x in lines])
        best = bits.argmin(axis=1).tolist() if lines else []
        sure = (1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)).tolist() if lines else []
        i = 0
        for _, spans in waiting:
            out.append([{"start": a, "stop": b, "lang": ppm.labels[best[k]], "confidence": sure[k], "running": is_running(lines[k])} for k, (a, b) in enumerate(spans, i)])
            i += len(spans)
        waiting.clear()

    def run(texts: pd.Series) -> pd.Series:
        ppm: Ppm = model.value
        out, waiting, size = [], [], 0
        for text in texts:
            waiting.append((text, split_lines(text)) if isinstance(text, str) and ppm.labels else ("", []))
            size += len(waiting[-1][0])
            if size >= SCORED_AT_ONCE:
                flush(ppm, waiting, out)
                size = 0
        flush(ppm, waiting, out)
        return pd.Series(out, dtype=object)

    return run


def identify(documents: DataFrame, languages: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``documents`` (doc_id, text, lang) with code (what the label names), segments, text_langs (of running text) and
    main_lang with main_confidence (by length).

    Null and empty texts have no segments and no language. Labels that name none of ``languages`` give a null code.
    """
    code = canonical_language(F.col("lang"), languages)
    model = fit(documents, code, per_language)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    df = documents.withColumn("code", code).withColumn("segments", F.pandas_udf(segmenter(shared), SEGMENTS).asNondeterministic()(F.col("text")))
    running = F.filter("segments", lambda s: s["running"])
    df = df.withColumn("text_langs", F.array_sort(F.array_distinct(F.transform(running, lambda s: s["lang"]))))
    weight = lambda lang: F.aggregate(F.filter(running, lambda s: s["lang"] == lang), F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    ranked = F.transform("text_langs", lambda g: F.struct(weight(g).alias("n"), g.alias("lang")))
    return df.withColumn("main_lang", F.array_max(ranked)["lang"])


def label_faults(found: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of each text whose label is missing, wrong, or names only one of several."""
    right = F.col("code").isNotNull() & F.array_contains("text_langs", F.col("code")) & (F.size("text_langs") == 1)
    return found.where(~F.coalesce(right, F.lit(False))).select("doc_id", F.explode("text_langs").alias("lang"))
