"""Near-copies that go on where a value ends: min-hash bands over beginnings, verified by alignment.

:func:`all_continued` finds every pair: exact copies by the first family of bands, and copies with differences before the closing word by a join.
There every value meets every word of a text that its closing word begins, if what stands before the two is of lengths that an alignment
within ``SIMILARITY`` can have. Marks of their pairs of letters rule out what surely has too many edits, for the others the edit distance of
these parts decides, both for many pairs at once. No pair is left out; pairs grow faster than the values.

:func:`continued` is the search by both families of bands, which misses some pairs with differences. In the first family, a value of n characters belongs to level k, 2^k <= n < 2^(k+1); longer values take part in every
level below their own with as much of their beginning as a value of that level can be aligned with, once per distinct beginning.
The min-hash band of the first 2^k characters brings a value to all that continue it exactly, however long the whole is. In the
second, for values that nothing continues exactly, every text is banded at the start of each word over all that stands before, and
the value at its closing word: near-copies with differences anywhere before the closing word meet.

In a bucket the texts stand in order of what follows the band's last shared shingle, or the closing word: those that a value can be the
beginning of follow it directly, and a stack of open values finds all of them in one pass. A pair counts if its parts before agree so far
that the whole alignment has the asked similarity. Buckets are ranges of one total order, cut at sampled places, so a hot bucket
is spread over many tasks; a value that is still open where a range ends is handed to the next ranges too. Nothing is capped.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.sources import checkpoint

#: Characters of a shingle, bands over whole levels and bands before words, and min-hashes of a band; twice as many, where they are
#: taken over this many characters or more, keep long texts apart that share some sentences only.
SHINGLE, BANDS, WORD_BANDS, ROWS, LONG = 4, 1, 6, 2, 40
#: Least similarity of a value and the part of a copy that it is aligned with (1 - edits / characters).
SIMILARITY = 0.8
#: Band rows that a task puts in order, sampled texts per task for the places to cut at, and characters of such a place.
TASK_ROWS, SAMPLED, PLACE = 1_000_000, 50, 64

#: Letters of a word that bring it to the closing words which begin it, the factor between classes of lengths, and distinct values per task of the join.
LETTERS, LENGTHS, TASK_VALUES = 3, 1.5, 2_000
#: Classes of pairs of letters, how many pairs of a class are told apart, words of 64 bits that mark them, and classes of single letters.
CLASSES, TIMES, LETTER_CLASSES = 256, 3, 32
MARK_WORDS = CLASSES * TIMES // 64
#: Pairs whose marks and whose distances are taken at once, fewer than what are compared one by one, words of a pattern beyond which they are too, and
#: entries of a table of patterns' letters.
MARK_PAIRS, COLUMN_PAIRS, FEW, LONG_WORDS, TABLE = 200_000, 16_384, 16, 32, 1 << 21
#: Bits of the array that tells which words may follow a value asked for.
BITS = 1 << 26

_random = np.random.default_rng(1)
_MASKS = _random.integers(0, 1 << 63, 2 * WORD_BANDS * ROWS, dtype=np.uint64)
_ODD = _random.integers(0, 1 << 63, 2 * WORD_BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_BASE, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)

ROW = "kind string, key long, tail string, head string, probe boolean"


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of all ``texts``, the text of each, and its place there. Texts below a shingle's length are one."""
    # NULs fill up short texts, so that each has one whole shingle at least
    codes = np.frombuffer("".join(t.ljust(SHINGLE, "\0") for t in texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    whole = np.maximum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), SHINGLE)
    n = whole - SHINGLE + 1
    h = np.zeros(max(0, len(codes) - SHINGLE + 1), dtype=np.uint64)
    for j in range(SHINGLE):
        h = h * _BASE + codes[j : len(codes) - SHINGLE + 1 + j]
    text = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(text)) - (np.cumsum(n) - n)[text]
    h = h[(np.cumsum(whole) - whole)[text] + place]  # without those that reach into the next text
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ h >> np.uint64(29), text, place


def _mixed(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    keys = (keys ^ more) * _MIX
    return keys ^ keys >> np.uint64(32)


def bands_of(texts: list[str], levels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (int64) and places of the last of their shingles, one row per text and one column per band, over the first 2^level
    characters of each text, all texts at once."""
    h, text, place = _shingles([t[: 1 << k] for t, k in zip(texts, levels)])
    starts = np.flatnonzero(place == 0)
    keys, places = np.zeros((len(texts), BANDS), dtype=np.uint64), np.zeros((len(texts), BANDS), dtype=np.int64)
    keys += (np.array(levels, dtype=np.uint64)[:, None] + np.uint64(1)) + np.arange(BANDS, dtype=np.uint64) * np.uint64(977)
    for i in range(BANDS * ROWS):
        hashed = (h ^ _MASKS[i]) * _ODD[i]
        least = np.minimum.reduceat(hashed, starts)
        at = np.flatnonzero(hashed == least[text])
        first = np.full(len(texts), -1)
        first[text[at][::-1]] = place[at][::-1]
        b = i // ROWS
        keys[:, b] = _mixed(keys[:, b], least)
        places[:, b] = np.maximum(places[:, b], first)
    return keys.astype(np.int64), places


def word_bands_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and keys (int64, a column per band: min-hashes and the word's first letter) of every word start with a shingle
    before it."""
    h, text, place = _shingles(texts)
    joined = np.frombuffer("".join(t.ljust(SHINGLE, "\0") for t in texts).encode("utf-32-le"), dtype=np.uint32)
    whole = np.maximum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), SHINGLE)
    owner = np.repeat(np.arange(len(texts)), whole)
    within = np.arange(len(joined)) - (np.cumsum(whole) - whole)[owner]
    at = np.flatnonzero((within[1:] >= SHINGLE) & (joined[:-1] == 32) & (joined[1:] != 32)) + 1
    first = np.cumsum(whole - SHINGLE + 1) - (whole - SHINGLE + 1)
    last = first[owner[at]] + within[at] - SHINGLE  # the last shingle before each word
    # running minima that start anew with each text: a later text's numbers are always smaller
    order = (np.uint64(len(texts)) - text.astype(np.uint64)) << np.uint64(32)
    # what goes on from a value begins with the letter that its closing word begins with
    keys = joined[at].astype(np.uint64)[:, None] * _BASE + np.arange(WORD_BANDS, dtype=np.uint64) * np.uint64(977)
    for i in range(2 * WORD_BANDS * ROWS):
        least = np.minimum.accumulate(order | (h ^ _MASKS[i]) * _ODD[i] >> np.uint64(32))[last] & np.uint64(0xFFFFFFFF)
        b = i // ROWS % WORD_BANDS
        keys[:, b] = np.where((i < WORD_BANDS * ROWS) | (within[at] >= LONG), _mixed(keys[:, b], least), keys[:, b])
    return owner[at], within[at], keys.astype(np.int64)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance of ``a`` and ``b`` by bit-parallel columns, ``most`` + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for j, c in enumerate(b, 1):
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        if right & last:
            score += 1
        elif left & last:
            score -= 1
        if score - (len(b) - j) > most:
            return most + 1
        right = right << 1 | 1
        up, down = (left << 1 | ~(diagonal | right)) & full, right & diagonal
    return score


def goes_on(text: str, following: str) -> str | None:
    """How a text whose copy continues with ``following`` was ended: within a 'word', before a word ('space'), before a 'sign' after
    a space; None if the end is one that values have."""
    if text[-1:] in (".", "!", "?") or not text or not following:
        return None
    if following[0].isalpha():
        return "word" if text[-1].isalpha() else None
    if following[0] == " " and following[1:2].strip():
        return "space" if following[1].isalpha() else "sign"
    return None


def _open_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, norm, how, edits, copy) of probes that a following text of their bucket goes on from; rows come in order of key and tail."""
    current, levels = None, []
    for batch in batches:
        out = []
        for kind, key, tail, head, probe in zip(batch["kind"], batch["key"], batch["tail"], batch["head"], batch["probe"]):
            if key != current:
                current, levels = key, []
            while levels and not tail.startswith(levels[-1][0]):
                levels.pop()
            for known, opened in levels:
                if len(known) == len(tail) or not opened:
                    continue
                how = goes_on(known, tail[len(known) : len(known) + 2])
                if how is None:
                    continue
                for other in [h for h, had in opened.items() if had < how]:
                    most = int((1 - SIMILARITY) * (len(other) + len(known)) + 1e-9)
                    d = edits(other, head, most)
                    if d <= most:
                        out.append((kind, other + known, how, d, head + tail))
                        opened[other] = how
                        if how == "word":  # nothing says more
                            del opened[other]
            if probe:
                if not levels or levels[-1][0] != tail:
                    levels.append((tail, {}))
                levels[-1][1].setdefault(head, "")
        yield pd.DataFrame(out, columns=["kind", "norm", "how", "edits", "copy"])


def beginnings(values: DataFrame) -> DataFrame:
    """Distinct (kind, level, text, probe): each of ``values`` (kind, norm) at its own level, and its beginnings at those below."""
    n = F.length("norm")
    rows = values.where("norm <> ''").select("kind", "norm", F.explode(F.sequence(F.lit(0), F.length(F.bin(n)) - 1)).alias("level"))
    kept = F.expr("cast(shiftleft(5L, level) div 2 as int) + 2")
    probe = (n < F.expr("shiftleft(2L, level)")) & ~F.col("norm").rlike(r"[.!?]$")
    return rows.select("kind", "level", F.substr("norm", F.lit(1), kept).alias("text"), probe.alias("probe")).distinct()


def open_ends(rows: DataFrame) -> DataFrame:
    """(kind, norm, how, edits, copy): the probes among ``rows`` (kind, key, tail, head, probe; written to disk) with the rows of their key
    that go on from them. Which places the order is cut at, found in a sample, bears on the tasks' sizes only."""
    spark = rows.sparkSession
    n_rows = rows.count()
    tasks = max(2 * spark.sparkContext.defaultParallelism, n_rows // TASK_ROWS)
    share = max(1, n_rows // (SAMPLED * tasks))
    sample = rows.where(F.pmod(F.xxhash64("key", "tail", "head"), F.lit(share)) == 0).select("key", F.substring("tail", 1, PLACE).alias("tail"))
    found = sorted((r["key"], r["tail"].encode()) for r in sample.collect())
    shared = spark.sparkContext.broadcast([found[i * len(found) // tasks] for i in range(1, tasks)] if len(found) >= tasks else [])

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = shared.value
        for batch in batches:
            rows_, parts = [], []
            for i, (key, tail, probe) in enumerate(zip(batch["key"], batch["tail"], batch["probe"])):
                own = tail.encode()
                part = bisect_right(places, (key, own))
                rows_.append(i)
                parts.append(part)
                # texts that may go on from it reach into the ranges that begin with it
                while probe and part < len(places) and places[part][0] == key and places[part][1].startswith(own):
                    part += 1
                    rows_.append(i)
                    parts.append(part)
            yield batch.iloc[rows_].assign(part=parts)

    ordered = rows.mapInPandas(placed, f"{ROW}, part int").repartitionById(tasks, F.col("part")).sortWithinPartitions("key", "tail")
    pairs = ordered.mapInPandas(_open_ends, "kind string, norm string, how string, edits int, copy string")
    best = pairs.groupBy("kind", "norm").agg(F.max(F.struct("how", (-F.col("edits")).alias("less"), "copy")).alias("b"))
    return best.select("kind", "norm", F.col("b.how").alias("how"), (-F.col("b.less")).alias("edits"), F.col("b.copy").alias("copy"))


def _by_levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        if len(batch):
            keys, at = bands_of(batch["text"].tolist(), batch["level"].tolist())
            keys ^= np.array([hash_of_kind(k) for k in batch["kind"]], dtype=np.int64)[:, None]
            for kind, text, probe, some_keys, some_at in zip(batch["kind"], batch["text"], batch["probe"], keys.tolist(), at.tolist()):
                out += [(kind, key, text[i:], text[:i], probe) for key, i in dict(zip(some_keys, some_at)).items()]
        yield pd.DataFrame(out, columns=["kind", "key", "tail", "head", "probe"])


def _closing_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, bits): the bits of the probes' keys in a bit array."""
    for batch in batches:
        bits: dict[int, int] = {}
        if len(batch):
            texts = batch["norm"].tolist()
            owner, at, keys = word_bands_of(texts)
            keys = keys[np.array([t.rfind(" ") + 1 for t in texts])[owner] == at].ravel().view(np.uint64) & np.uint64(BITS - 1)
            for place in np.unique(keys).tolist():
                bits[place >> 5] = bits.get(place >> 5, 0) | 1 << (place & 31)
        yield pd.DataFrame({"word": list(bits), "bits": list(bits.values())}, dtype="int64")


def before_words(values: DataFrame) -> DataFrame:
    """Rows for :func:`open_ends` of ``values`` (kind, norm, probe): the closing word of each probe, and the words of all texts that have a key
    of some probe. A bit array of fixed size tells which; the more probes, the more other words pass, to no effect."""
    asked = values.where("probe").select("norm").mapInPandas(_closing_keys, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(BITS // 32, dtype=np.uint32)
    words[asked["word"].to_numpy(dtype=np.int64)] = asked["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    shared = values.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        for batch in batches:
            out = []
            if len(batch):
                texts, kinds, probes = batch["norm"].tolist(), batch["kind"].tolist(), batch["probe"].tolist()
                owner, at, keys = word_bands_of(texts)
                places = keys.view(np.uint64) & np.uint64(BITS - 1)
                known = (words[(places >> np.uint64(5)).astype(np.int64)] >> (places & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
                for mark, band in np.argwhere(known).tolist():
                    i, start = owner[mark], at[mark]
                    text, end = texts[i], texts[i].find(" ", start)
                    closing = end < 0 and probes[i]
                    out.append((kinds[i], int(keys[mark, band]) ^ hash_of_kind(kinds[i]), text[start:] if end < 0 else text[start : end + 2], text[:start], closing))
            yield pd.DataFrame(out, columns=["kind", "key", "tail", "head", "probe"])

    return values.select("kind", "norm", "probe").mapInPandas(run, ROW)


def continued(values: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(kind, norm, how, edits, copy) of the distinct ``values`` (kind, norm; written to disk) that near-copies go on from, each once.

    The bands miss some copies with differences; :func:`all_continued` misses none. Exact copies are looked up for all values, those with differences for the values ``asked`` (kind, norm; None: all) among all.
    The strongest way to go on counts ('word' over 'space' over 'sign'), with the nearest such copy's beginning. Values that end in
    a full stop, and null or empty ones, give no row; equal values are one. Differences from the closing word on aren't tolerated.
    """
    # an explicit number of partitions keeps the small but costly rows spread over all cores
    tasks = 2 * values.sparkSession.sparkContext.defaultParallelism
    exact = checkpoint(open_ends(checkpoint(beginnings(values).repartition(tasks).mapInPandas(_by_levels, ROW))))
    # values with copies that have differences
    left = values.where("norm <> ''").join(exact.where("how = 'word'").select("kind", "norm", F.lit(True).alias("_done")), ["kind", "norm"], "left")
    if asked is not None:
        left = left.join(asked.select("kind", "norm", F.lit(True).alias("_asked")).distinct(), ["kind", "norm"], "left")
    probe = F.col("_done").isNull() & ~F.col("norm").rlike(r"[.!?]$") & (F.lit(True) if asked is None else F.col("_asked").isNotNull())
    left = checkpoint(left.select("kind", "norm", probe.alias("probe")).repartition(tasks))
    rows = checkpoint(before_words(left))
    both = exact.unionByName(open_ends(rows))
    best = both.groupBy("kind", "norm").agg(F.max(F.struct("how", (-F.col("edits")).alias("less"), "copy")).alias("b"))
    return best.select("kind", "norm", F.col("b.how").alias("how"), (-F.col("b.less")).alias("edits"), F.col("b.copy").alias("copy"))


def _slices(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last of the texts of portions that the processor's cache holds, each letter's text among them, and its code point."""
    start = 0
    while start < len(texts):
        stop, n = start, 0
        while stop < len(texts) and stop < start + 1000 and n < 500_000:
            n += len(texts[stop])
            stop += 1
        some = texts[start:stop]
        yield start, stop, np.repeat(np.arange(len(some)), [len(x) for x in some]), np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32)
        start = stop


def marks_of(texts: list[str]) -> np.ndarray:
    """The marks of each of ``texts``, a column of ``MARK_WORDS`` words of 64 bits: a bit for every class of pairs of neighbouring letters and for 1, 2 ...
    ``TIMES`` pairs of it. An edit takes away two pairs at most, so texts within d edits lack 2 d of each other's marks at most, whatever pairs fall into one class."""
    out = np.zeros((MARK_WORDS, len(texts)), dtype=np.uint64)
    for start, stop, owner, codes in _slices(texts):
        pairs = ((codes[:-1] * np.uint32(1_000_003) + codes[1:]) * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(CLASSES)
        counts = np.bincount((owner[:-1] * CLASSES + pairs)[owner[:-1] == owner[1:]], minlength=(stop - start) * CLASSES).reshape(stop - start, CLASSES)
        out[:, start:stop] = np.concatenate([np.packbits(counts >= n, axis=1).view(np.uint64) for n in range(1, TIMES + 1)], axis=1).T
    return out


def letters_of(texts: list[str]) -> np.ndarray:
    """How many letters of each of ``LETTER_CLASSES`` classes each of ``texts`` has, a row per text. An edit takes away one letter and adds one at most."""
    out = np.zeros((len(texts), LETTER_CLASSES), dtype=np.int32)
    for start, stop, owner, codes in _slices(texts):
        out[start:stop] = np.bincount(owner * LETTER_CLASSES + codes % LETTER_CLASSES, minlength=(stop - start) * LETTER_CLASSES).reshape(stop - start, LETTER_CLASSES)
    return out


def _marks_at(text: str, places: list[int]) -> list[tuple[int, ...]]:
    """For each of ``places``, the marks of what stands before it."""
    return list(zip(*marks_of([text[:at] for at in places]).tolist()))


def distances(patterns: list[str], texts: list[str], of: np.ndarray, to: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Edit distances of pairs: of the pattern number ``of`` and the text number ``to``, a value above ``most`` if it is larger. Bit-parallel columns
    as in :func:`edits`, for many pairs at once."""
    lengths, ends = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (patterns, texts))
    score = most + 1
    score[lengths[of] == 0] = ends[to][lengths[of] == 0]
    words = -(-lengths[of] // 64)
    todo = np.flatnonzero((words > 0) & (np.abs(lengths[of] - ends[to]) <= most))
    todo = todo[np.lexsort((of[todo], words[todo]))]
    for some in np.split(todo, np.flatnonzero(np.diff(words[todo])) + 1):
        parts = [some]
        while parts:
            part = parts.pop()
            if len(part) < FEW or words[part[0]] > LONG_WORDS:
                for i in part.tolist():
                    score[i] = edits(patterns[of[i]], texts[to[i]], int(most[i]))
            elif len(part) > COLUMN_PAIRS or not _columns(patterns, texts, of, to, most, part, int(words[part[0]]), score):
                parts += [part[: len(part) // 2], part[len(part) // 2 :]]
    return score


def _columns(patterns: list[str], texts: list[str], of: np.ndarray, to: np.ndarray, most: np.ndarray, part: np.ndarray, words: int, score: np.ndarray) -> bool:
    """Sets the ``score`` of the pairs ``part``, whose patterns all have so many ``words``; False, and nothing is done, if too large a table is needed."""
    used, own = np.unique(of[part], return_inverse=True)
    some = [patterns[i] for i in used.tolist()]
    codes, long = np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32), np.fromiter(map(len, some), dtype=np.int64, count=len(some))
    # letters by number, 0 for those that no pattern has
    letters = np.zeros(int(codes.max()) + 2, dtype=np.int64)
    letters[codes] = 1
    n = int(letters.sum()) + 1
    if len(used) > 1 and len(used) * n * words > TABLE:
        return False
    letters[letters > 0] = np.arange(1, n)
    # patterns end at the last word's top bit, whose carry is then the step of the distance; rows below the first letter keep the first row's values
    gap = 64 * words - long
    place = np.arange(len(codes)) - np.repeat(np.cumsum(long) - long - gap, long)
    # where each letter stands in each pattern
    table = np.zeros((words, len(used) * n), dtype=np.uint64)
    np.bitwise_or.at(table, (place >> 6, np.repeat(np.arange(len(used)), long) * n + letters[codes]), np.uint64(1) << (place & 63).astype(np.uint64))
    # the texts one after another, the shortest first
    met, text = np.unique(to[part], return_inverse=True)
    some = [texts[i] for i in met.tolist()]
    joined, ends = letters[np.minimum(np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32), len(letters) - 1)], np.fromiter(map(len, some), dtype=np.int64, count=len(some))
    order = np.argsort(ends[text], kind="stable")
    pair, row, begin, end = part[order], own[order] * n, (np.cumsum(ends) - ends)[text][order], ends[text][order]
    limit, value = most[pair], long[own[order]]
    one, top, no, full = np.uint64(1), np.uint64(63), np.uint64(0), ~np.uint64(0)
    up, down = np.full((words, len(pair)), full), np.zeros((words, len(pair)), dtype=np.uint64)
    up[0] = full << gap[own[order]].astype(np.uint64)
    j = done = 0
    while True:
        ready = int(np.searchsorted(end, j, "right"))
        score[pair[done:ready]] = value[done:ready]
        done = ready
        if j % 8 == 0:
            # what is still to come makes up for no more than its letters
            left = np.flatnonzero(value[done:] - (end[done:] - j) <= limit[done:]) + done
            score[pair[done:]] = limit[done:] + 1
            if len(left) < FEW:
                for i in pair[left].tolist():
                    score[i] = edits(patterns[of[i]], texts[to[i]], int(most[i]))
                return True
            if len(left) < 0.9 * (len(pair) - done):
                pair, row, begin, end, limit, value = (x[left] for x in (pair, row, begin, end, limit, value))
                up, down, done = up[:, left], down[:, left], 0
        at = row[done:] + joined[begin[done:] + j]
        more, less = one, no
        for w in range(words):
            match, u, d = table[w][at], up[w, done:], down[w, done:]
            kept = match | d
            match |= less
            diagonal = match & u
            diagonal += u
            diagonal ^= u
            diagonal |= match
            right = diagonal | u
            np.invert(right, out=right)
            right |= d
            diagonal &= u
            high, low = right >> top, diagonal >> top
            right <<= one
            right |= more
            diagonal <<= one
            diagonal |= less
            np.bitwise_and(right, kept, out=d)
            kept |= right
            np.invert(kept, out=kept)
            np.bitwise_or(diagonal, kept, out=u)
            more, less = high, low
        value[done:] += more.view(np.int64)
        value[done:] -= less.view(np.int64)
        j += 1


def _word_starts(reach: dict[str, int]):
    """(kind, word, text, at, most): every word of the texts that begins within its kind's ``reach``, the text as far as what tells how it goes on
    behind the word, and the word's place; -1 for ``most``, which only values asked for have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {}
            for kind, text in zip(batch["kind"], batch["norm"]):
                at, most = 0, reach.get(kind, -1)
                while at <= most and at < len(text):
                    end = text.find(" ", at)
                    end = len(text) if end < 0 else end
                    if end > at:
                        out[kind, text[at:end], text[: end + 2], at] = -1
                    at = end + 1
            rows = pd.DataFrame(list(out), columns=["kind", "word", "text", "at"])
            yield rows.assign(most=-1)

    return run


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, norm, how, edits, copy) of all pairs within the similarity. Rows come in order of key, kind and word, the values asked for (``most`` of 0 or more)
    before the texts they are compared with."""
    kept = None
    for batch in batches:
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        if not len(rows):
            continue
        key, kind, word = (rows[x].to_numpy() for x in ("key", "kind", "word"))
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (word[1:] != word[:-1]))])
        asked = rows["most"].to_numpy() >= 0
        kept = rows[asked & (group == group[-1])]
        both = np.zeros((2, group[-1] + 1), dtype=bool)
        both[asked.astype(int), group] = True
        used = both.all(axis=0)[group]
        yield from _compared(rows[used & asked], group[used & asked], rows[used & ~asked], group[used & ~asked])


def _compared(probes: pd.DataFrame, probe_group: np.ndarray, heads: pd.DataFrame, head_group: np.ndarray) -> Iterator[pd.DataFrame]:
    """:func:`_near` for some rows of both sides, and the group of each."""
    # of the texts that agree up to a word, the one that goes on best stands for all: within the word, and behind it
    found: dict[tuple[int, str], list] = {}
    for g, text, at, word in zip(head_group.tolist(), heads["text"], heads["at"].tolist(), heads["word"]):
        best, how = found.setdefault((g, text[:at]), ["", ("", "")]), goes_on(word, text[at + len(word) :])
        best[0] = max(best[0], text)
        if how:
            best[1] = max(best[1], (how, text))
    order = sorted(found, key=lambda x: (x[0], len(x[1])))
    texts, best = [x[1] for x in order], [found[x] for x in order]
    norms, places = probes["text"].tolist(), probes["at"].to_numpy()
    befores = [norm[:at] for norm, at in zip(norms, places.tolist())]
    whole = np.array([norm[at:] == word for norm, at, word in zip(norms, places.tolist(), probes["word"])], dtype=bool)
    own, most = np.array([bool(b[1][0]) for b in best], dtype=bool), probes["most"].to_numpy().astype(np.int64)
    lengths, groups = np.array([len(x) for x in texts], dtype=np.int64), np.array([x[0] for x in order], dtype=np.int64)
    wide = max(int((places + most).max(initial=0)), int(lengths.max(initial=0))) + 1
    ranks = groups * wide + lengths
    low, high = np.searchsorted(ranks, probe_group * wide + np.maximum(places - most, 0)), np.searchsorted(ranks, probe_group * wide + places + most, "right")
    marks, other = marks_of(befores), marks_of(texts)
    counts, other_counts = letters_of(befores), letters_of(texts)
    sums, other_sums = (np.bitwise_count(x).sum(axis=0, dtype=np.int64) for x in (marks, other))
    kinds, before = probes["kind"].tolist(), np.concatenate([[0], np.cumsum(high - low)])
    start = 0
    while start < len(norms):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + MARK_PAIRS, "right")) - 1)
        n = (high - low)[start:stop]
        of = np.repeat(np.arange(start, stop), n)
        to = np.arange(len(of)) + np.repeat(low[start:stop] - (before[start:stop] - before[start]), n)
        start = stop
        left = ~whole[of] | own[to]
        of, to = of[left], to[left]
        # twice the larger of the numbers of marks that one has and the other lacks
        differ = np.abs(sums[of] - other_sums[to])
        for w in range(MARK_WORDS):
            differ += np.bitwise_count(marks[w][of] ^ other[w][to])
            if w % 2 or w == MARK_WORDS - 1:
                left = np.flatnonzero(differ <= 4 * most[of])
                of, to, differ = of[left], to[left], differ[left]
        letters = np.abs(counts[of] - other_counts[to]).sum(axis=1) + np.abs(places[of] - lengths[to])
        left = np.flatnonzero(letters <= 2 * most[of])
        of, to = of[left], to[left]
        d = distances(befores, texts, of, to, most[of])
        near = np.flatnonzero(d <= most[of])
        out = []
        for i, j, e in zip(of[near].tolist(), to[near].tolist(), d[near].tolist()):
            how, copy = best[j][1] if whole[i] else ("word", best[j][0])
            out.append((kinds[i], norms[i], how, e, copy))
        yield pd.DataFrame(out, columns=["kind", "norm", "how", "edits", "copy"])


def with_differences(values: DataFrame) -> DataFrame:
    """(kind, norm, how, edits, copy): the best copy with differences before the closing word for each probe among ``values`` (kind, norm, probe; written to
    disk). All pairs of a probe and a text's word that its closing word begins are compared, if their lengths allow the asked similarity: by their
    marks, and those that the marks don't rule out by edit distance."""
    parallel = values.sparkSession.sparkContext.defaultParallelism
    probes = values.where("probe").select("kind", F.col("norm").alias("text"), F.substring_index("norm", " ", -1).alias("closing")).where("closing <> ''")
    probes = probes.select("*", (F.length("text") - F.length("closing")).alias("at"), F.floor(F.lit(1 - SIMILARITY) * F.length("text") + 1e-9).cast("int").alias("most"))
    reach = {r["kind"]: r["reach"] for r in probes.groupBy("kind").agg(F.max(F.col("at") + F.col("most")).alias("reach")).collect()}
    # the words that each closing word begins, among all that occur; behind a letter a word goes on with a letter
    known = values.select("kind", F.explode(F.split("norm", " ")).alias("word")).where("word <> ''").distinct()
    known = known.select("kind", "word", F.explode(F.expr(f"transform(sequence(1, least({LETTERS}, length(word))), n -> substring(word, 1, n))")).alias("letters"))
    begun = probes.select("kind", "closing").distinct().withColumn("letters", F.substring("closing", 1, LETTERS)).join(known, ["kind", "letters"]).where(F.col("word").startswith(F.col("closing")))
    begun = begun.where((F.col("word") == F.col("closing")) | F.expr("substring(word, length(closing) + 1, 1)").rlike(r"\p{L}") & F.col("closing").rlike(r"\p{L}$")).select("kind", "closing", "word")

    def length_class(n):
        return F.floor(F.log(n + F.lit(1.0)) / F.lit(float(np.log(LENGTHS))) + 1e-9).cast("int")

    classes = F.sequence(length_class(F.greatest(F.col("at") - F.col("most"), F.lit(0))), length_class(F.col("at") + F.col("most")))
    # explicit partitions, since rows are few for their pairs; as tables grow, a key's texts are spread over more of them
    tasks = max(4 * parallel, values.count() // TASK_VALUES)
    salts = -(-tasks // (4 * parallel))
    texts = values.select("kind", "norm").mapInPandas(_word_starts(reach), "kind string, word string, text string, at int, most int")
    left = texts.select("*", length_class(F.col("at")).alias("length_class"), F.pmod(F.xxhash64(F.expr("substring(text, 1, at)")), F.lit(salts)).cast("int").alias("salt"))
    right = probes.join(begun, ["kind", "closing"]).drop("closing").select("*", F.explode(classes).alias("length_class")).select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = left.unionByName(right).select(F.xxhash64("kind", "word", "length_class", "salt").alias("key"), "kind", "word", "text", "at", "most")
    rows = rows.repartition(tasks, "key").sortWithinPartitions("key", "kind", "word", F.desc("most"))
    return best_of(rows.mapInPandas(_near, "kind string, norm string, how string, edits int, copy string"))


def best_of(pairs: DataFrame) -> DataFrame:
    """Each text's strongest way to go on, with the nearest such copy."""
    best = pairs.groupBy("kind", "norm").agg(F.max(F.struct("how", (-F.col("edits")).alias("less"), "copy")).alias("b"))
    return best.select("kind", "norm", F.col("b.how").alias("how"), (-F.col("b.less")).alias("edits"), F.col("b.copy").alias("copy"))


def all_continued(values: DataFrame) -> DataFrame:
    """(kind, norm, how, edits, copy, exact) of the distinct ``values`` (kind, norm; written to disk) that near-copies go on from, each once.

    All pairs that meet ``SIMILARITY`` count, the copies being all values. The strongest way to go on counts ('word' over 'space' over 'sign'), with
    the nearest such copy's beginning; ``exact`` is how the copies go on that agree from the beginning. Values that end in a full stop, and null or
    empty ones, give no row; equal values are one. Differences from the closing word on aren't tolerated.
    """
    # an explicit number of partitions keeps the small but costly rows spread over all cores
    tasks = 2 * values.sparkSession.sparkContext.defaultParallelism
    exact = checkpoint(open_ends(checkpoint(beginnings(values).repartition(tasks).mapInPandas(_by_levels, ROW))))
    # nothing is stronger or nearer than an exact copy that goes on in the word
    done = exact.where("how = 'word' and edits = 0").select("kind", "norm", F.lit(True).alias("_done"))
    left = values.where("norm <> ''").join(done, ["kind", "norm"], "left")
    probe = F.col("_done").isNull() & ~F.col("norm").rlike(r"[.!?]$")
    left = checkpoint(left.select("kind", "norm", probe.alias("probe")).repartition(tasks))
    best = best_of(exact.unionByName(with_differences(left)))
    return best.join(exact.select("kind", "norm", F.col("how").alias("exact")), ["kind", "norm"], "left")


@lru_cache(1024)
def hash_of_kind(kind: str) -> int:
    """A number below 2^61 for a vocabulary's name, so that texts of two kinds share no bucket."""
    h = 0
    for c in kind or "":
        h = (h * 1_000_003 + ord(c)) % ((1 << 61) - 1)
    return h
