"""Values that were cut off: near-copies whose alignment ends early, and closing words that don't close.

All near-copies are found and aligned (:mod:`bitloom.llm.nearcopies`): a value is cut if a copy goes
on within its closing word, or within its sentence. Values without such a copy are scored by the terminality of their closing
word: how often it closes elsewhere, and whether it is only the beginning of longer words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bitloom.llm.nearcopies import all_continued
from bitloom.sources import checkpoint

#: Base and modulus of the rolling hash of words' beginnings.
BASE, MODULUS = 1_000_003, (1 << 61) - 1
#: A closing word that closes less than this share of its occurrences doesn't close.
LEAST_TERMINALITY = 0.15
#: The same in game titles, whose fields cut many values before a word goes on, if titles agree.
SHORT_FIELD_TERMINALITY = 0.6
#: A word never seen inside counts as a beginning if longer words that start with it are this many times as frequent.
LONGER_TIMES = 0.5

#: Counts held in memory by a task before they are passed on.
COUNTED = 200_000
_EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_END = r"[\s…]+$|\.\.\.+\s*$"


def normal(value: Column) -> Column:
    """Lower case, runs of space as one, without marks of omission at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"\s+", " "), _END, "")


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, bare = ["kind", "prev", "word", "inner", "last", "first"], {}
    counts: dict[tuple, list[int]] = {}

    def flush() -> pd.DataFrame:
        rows = pd.DataFrame([(*k, *v) for k, v in counts.items()], columns=columns)
        counts.clear()
        return rows

    for batch in batches:
        for kind, norm in zip(batch["kind"], batch["norm"]):
            words, prev = norm.split(" "), ""
            for i, written in enumerate(words):
                word = bare.get(written)
                if word is None:
                    if len(bare) > COUNTED:
                        bare.clear()
                    word = bare[written] = _EDGES.sub("", written)
                closed = written[-1:] in (".", "!", "?")
                end = i == len(words) - 1
                if word:
                    n = counts.setdefault((kind, prev, word), [0, 0, 0])
                    n[0] += not closed and not end
                    # comments end in full stops: an open end is no evidence there
                    n[1] += closed or end and kind != "comment"
                    n[2] += i == 0
                prev = word
        if len(counts) > COUNTED:
            yield flush()
    yield flush()


def word_pairs(values: DataFrame) -> DataFrame:
    """(kind, prev, word, inner, last, first) over the distinct ``values``: how often ``word`` stands behind ``prev`` ('' in front) and goes
    on, closes a value or a sentence, or opens a value. Counted in batches before the shuffle."""
    rows = values.select("kind", "norm").mapInPandas(_counted, "kind string, prev string, word string, inner long, last long, first long")
    return rows.groupBy("kind", "prev", "word").agg(*[F.sum(x).alias(x) for x in ("inner", "last", "first")])


def _beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, n, h, times, whole): length and hash of every beginning of a word, and of the word itself."""
    for batch in batches:
        out = []
        for kind, word, times in zip(batch["kind"], batch["word"], batch["n"]):
            h = 0
            for n, c in enumerate(word, 1):
                h = (h * BASE + ord(c)) % MODULUS
                out.append((kind, n, h, times, None) if n < len(word) else (kind, n, h, 0, word))
        yield pd.DataFrame(out, columns=["kind", "n", "h", "times", "whole"])


def longer_counts(counts: DataFrame) -> DataFrame:
    """(kind, word, longer): occurrences of the words that begin with ``word`` and are longer, for words of any length."""
    rows = counts.select("kind", "word", (F.col("inner") + F.col("last")).alias("n")).mapInPandas(_beginnings, "kind string, n int, h long, times long, whole string")
    met = rows.groupBy("kind", "n", "h").agg(F.sum("times").alias("longer"), F.max("whole").alias("word"))
    return met.where("word is not null and longer > 0").select("kind", "word", "longer")


def unsettled(values: DataFrame, counts: DataFrame, longer: DataFrame) -> DataFrame:
    """(kind, norm) of the values that a copy with differences may show to be cut: their closing word is no word known from elsewhere, or the kind
    is one of sentences, which may also end early behind a whole word. A whole word at the end can't be told from a cut
    one by a copy that differs."""
    last = values.select("kind", "norm", _bare(F.element_at(F.split("norm", " "), -1)).alias("word"))
    total = F.col("inner") + F.col("last")
    known = counts.join(longer, ["kind", "word"], "left").where((total > 1) & (F.coalesce("longer", F.lit(0)) < LONGER_TIMES * total) & (F.col("kind") != "comment"))
    return last.join(known, ["kind", "word"], "left_anti").select("kind", "norm")


def closing_words(values: DataFrame, pairs: DataFrame, counts: DataFrame, longer: DataFrame) -> DataFrame:
    """(kind, norm, ends) of the distinct ``values`` whose closing word doesn't close: 'closing' (it goes on elsewhere), 'fragment' (it is
    the beginning of longer words), 'word' (a value of one word that is known from elsewhere).

    Statistics are those of all values. A closing word of one letter is judged by the words behind the same word: if none that is longer
    begins with it, it stands for itself.
    """
    words = F.split("norm", " ")
    last = values.select("kind", "norm", _bare(F.element_at(words, -1)).alias("word"), F.coalesce(_bare(F.try_element_at(words, F.lit(-2))), F.lit("")).alias("prev"))
    # words with other signs in or behind them (wrongly decoded ones, say) tell nothing
    plain = r"^[\"'“«(\[¿¡]*[\p{L}\p{N}][\p{L}\p{M}\p{N}'’.-]*[\"'”»~*]*$"
    last = last.where(~F.col("norm").rlike(r"[.!?)\]]$") & F.element_at(F.split("norm", " "), -1).rlike(plain))
    ends = last.groupBy("kind", "prev", "word").agg(F.count("*").alias("seen"))
    general = counts.where("kind = 'title'").select("word", F.col("inner").alias("title_inner"), F.col("last").alias("title_last"))
    behind = pairs.where(F.length("word") > 1).groupBy("kind", "prev", F.substring("word", 1, 1).alias("word")).agg(F.sum(F.col("inner") + F.col("last")).alias("behind"))
    scored = ends.join(counts, ["kind", "word"], "left").join(general, "word", "left").join(behind, ["kind", "prev", "word"], "left")
    scored = scored.join(longer, ["kind", "word"], "left").join(longer.where("kind = 'title'").select("word", F.col("longer").alias("title_longer")), "word", "left")
    scored = scored.fillna(0, ["inner", "last", "first", "longer", "title_longer", "title_inner", "title_last", "behind"])
    scored = scored.withColumn("longer", F.col("longer") + F.when((F.col("kind") == "game") & (F.col("inner") == 0), F.col("title_longer")).otherwise(0))
    total = F.col("inner") + F.col("last")
    # where a field is too short for a word ever to go on, titles tell whether it closes
    own_inner = F.when(F.col("inner") > 0, F.col("inner")).otherwise(F.col("title_inner"))
    own_last = F.when(F.col("inner") > 0, F.col("last")).otherwise(F.col("title_last"))
    doesnt_close = (own_inner >= 3) & (own_last < LEAST_TERMINALITY * (own_inner + own_last))
    short_field = (F.col("title_inner") >= 3) & (F.col("title_last") < LEAST_TERMINALITY * (F.col("title_inner") + F.col("title_last"))) & (F.col("last") < SHORT_FIELD_TERMINALITY * total)
    doesnt_close = (doesnt_close | (F.col("kind") == "game") & short_field) & (F.col("prev") != "") & ((F.col("kind") != "game") | (F.col("first") == 0))
    settled = (F.length("word") == 1) & (F.col("behind") == 0)
    fragment = (F.col("longer") >= LONGER_TIMES * F.greatest(total, F.lit(1))) & (F.col("inner") * 20 <= F.col("longer")) & F.col("word").rlike(r"^\p{L}+$") & ~settled
    whole = (F.col("kind") == "comment") & (F.col("last") >= 1)
    judged = scored.select("kind", "prev", "word", F.when(doesnt_close, "closing").when(fragment & ~whole, "fragment").alias("ends")).where("ends is not null")
    # one word that goes on elsewhere is a word of its own, whatever is compounded with it
    alone = counts.where("inner > 0").select("kind", F.col("word").alias("norm"), F.lit("word").alias("ends"))
    return last.join(judged, ["kind", "prev", "word"]).select("kind", "norm", "ends").unionByName(alone.join(values, ["kind", "norm"], "left_semi")).groupBy("kind", "norm").agg(F.max("ends").alias("ends"))


def find_truncated(rows: DataFrame) -> DataFrame:
    """``rows`` (row_id, source_id, volume_id, kind, field, value) once per row_id with ``cut`` (boolean), ``why``, and the near-copy's
    ``copy`` (as far as it was aligned), ``edits`` and ``how`` it goes on.

    Every value has its copy, but one with differences is a cut only where :func:`unsettled` says so.
    ``kind`` names the vocabulary (title, comment, game), ``field`` what the values of one source are copies of. Why: 'copy' (a near-copy
    in the same source goes on), 'word' or 'space' (one elsewhere goes on in the same word or sentence), 'closing' (the closing word doesn't
    close, or is a blank), 'fragment' (it is the beginning of longer words). Null, empty and blank values aren't cut.
    """
    rows = rows.groupBy("row_id").agg(F.min(F.struct("source_id", "volume_id", "kind", "field", "value")).alias("r")).select("row_id", "r.*")
    rows = checkpoint(rows.withColumn("norm", normal(F.col("value"))))  # read four times
    # an explicit number of partitions keeps the small but costly rows spread over all cores
    values = rows.where("norm <> ''").select("kind", "norm").distinct()
    values = checkpoint(values.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism))
    pairs = checkpoint(word_pairs(values))
    counts = pairs.groupBy("kind", "word").agg(*[F.sum(x).alias(x) for x in ("inner", "last", "first")])
    longer = checkpoint(longer_counts(counts))
    copies = all_continued(values).join(unsettled(values, counts, longer).withColumn("_open", F.lit(True)), ["kind", "norm"], "left")
    copies = copies.withColumn("_how", F.when(F.col("_open"), F.col("how")).otherwise(F.col("exact"))).drop("_open", "exact")
    found = copies.join(closing_words(values, pairs, counts, longer), ["kind", "norm"], "full")
    # of the values that a copy goes on from: whether one in the same source does. A source's values stand in order, apart by first
    # words; what goes on directly follows
    first = F.substring_index("norm", " ", 1)
    following = F.lead("norm").over(W.partitionBy("source_id", "field", first).orderBy("norm"))
    own = rows.where("norm <> ''").select("source_id", "field", "norm").distinct().withColumn("_next", following)
    own = own.where(F.col("_next").startswith(F.col("norm"))).select("source_id", "field", "norm", F.lit(True).alias("own"))
    # the blank that a value ends with is a closing word like others: it closes if enough values end with one
    open_end = F.col("value").rlike(r"\S $")
    blanks = rows.where("norm <> ''").groupBy("kind").agg(F.sum(F.size(F.split("norm", " ")) - 1).alias("inner"), F.count_if(open_end).alias("last"))
    blanks = blanks.where(F.col("last") < LEAST_TERMINALITY * (F.col("inner") + F.col("last"))).select("kind", F.lit("closing").alias("blank"))
    out = rows.join(found, ["kind", "norm"], "left").join(own, ["source_id", "field", "norm"], "left").join(blanks, "kind", "left")
    how, ends = F.col("_how"), F.col("ends")
    # a space at the end that a copy has too was cut behind, not set
    behind_space = how.isNotNull() & open_end
    goes_on = F.when(how.isNotNull() & F.col("own"), "copy").when((how == "word") & ends.isNotNull() & (ends == "word"), None).when(how == "word", "word").when((how == "space") & (F.col("kind") == "comment") | behind_space, "space")
    why = F.coalesce(goes_on, F.when(ends != "word", ends), F.when(open_end, F.col("blank")))
    return out.select("row_id", "source_id", "volume_id", "kind", "field", "value", why.isNotNull().alias("cut"), why.alias("why"), "how", "edits", "copy")
