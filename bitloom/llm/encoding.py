"""Text decoded with a wrong character encoding: found and restored by character n-gram models and encode-decode chains.

Every chain (the wrong encoding that was used, the right one) is tried on every word; a chain's gain is the number of bits by which
a smoothed character trigram model, trained on the clean values of the same table, prefers what it restores. The
likeliest chain is accepted beyond a margin that is validated on clean values and on the same values garbled on purpose.
Whatever the gain, a well-formed UTF-8 sequence that clean text doesn't hold by chance is a verdict of its own.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.sources import checkpoint

#: Counts held in memory by a task before they are passed on.
COUNTED = 400_000
#: Margins (bits) that are tried on all values, and the one where none can be tried.
MARGINS, UNTRIED_MARGIN = np.arange(5.0, 30.0, 0.5), 15.0
#: First round: values that some chain improves by this many bits aren't used for training.
SUSPECT_BITS = 5.0
#: What only a word in up to this many values has is no evidence that it is clean; what is more frequent is.
RARE = 2
ROUNDS = 3

# Encodings a text may have been read with, and encodings it may have been written in.
READ_AS = ("cp1252", "latin_1", "cp1251", "cp437", "cp850", "cp852", "mac_roman", "cp866", "koi8_r", "cp1253", "cp1250")
WRITTEN_IN = ("utf_8", "cp1252", "cp1250", "cp1251", "cp1253", "iso8859_7", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "cp932", "euc_jp", "gb18030")

#: Signs of wrong decoding in themselves: replacement characters, C1 controls, private use.
BROKEN = re.compile("[\x80-\x84\x86-\x9f�-]")
#: Readings under which well-formed UTF-8 sequences don't come about by chance in clean text.
LATIN_CHAINS = frozenset(f"{x}>utf_8" for x in ("cp1252", "latin_1", "cp437", "cp850"))
_ONE = rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}"
_UTF8 = re.compile(rb"(?:" + _ONE + rb")+")
_SEQUENCE = re.compile(_ONE)
#: A symbol within a word, as in misread bytes.
_INSIDE = regex.compile(r"\p{L}[^\P{S}\x00-\x7f]+\p{L}")
_PART = re.compile(r"[^\W\d_]{2,}")
_LATIN = regex.compile(r"\p{Latin}+")
#: Signs that follow a clean word directly, and those of them that may also join two words.
JOINING = frozenset("’‘–—·\u00a0\u00ad")
CLOSING = JOINING | frozenset("…“”‹›«»‚„¡¿•†‡§™®©°²³¹ºª")
#: Bits that a word with odd capitals costs more than the model, which knows no case, says.
ODD_CASE_BITS = 12.0
_HIGH = re.compile(r"[^\x00-\x7f]+")


def _reader(name: str) -> dict[str, int]:
    """The byte of each character under ``name``; bytes without a character stand for themselves (C1 controls)."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


class Chains:
    """All encode-decode chains on single words."""

    def __init__(self) -> None:
        self.readers = {name: _reader(name) for name in READ_AS}
        self.names = [f"{w}>{r}" for w in READ_AS for r in WRITTEN_IN if w != r] + ["utf_16_le>utf_16_be"]
        self.latin: dict[str, bool] = {}

    def restore(self, word: str) -> dict[str, str]:
        """Chain name -> the restored word, where the chain applies and changes something."""
        out: dict[str, str] = {}
        high = [m.group() for m in _HIGH.finditer(word)]
        if not high:
            return out
        for wrong, table in self.readers.items():
            raw = [table.get(c, -1) for c in word]
            # UTF-8: only the well-formed sequences, so that a word may be garbled in part
            data = bytes(b if b >= 0 else 0 for b in raw)
            pieces, at = [], 0
            for m in _UTF8.finditer(data):
                if any(b < 0 for b in raw[m.start() : m.end()]):
                    continue
                try:
                    pieces += [word[at : m.start()], m.group().decode("utf-8")]
                except UnicodeDecodeError:
                    continue
                at = m.end()
            if at:
                out[f"{wrong}>utf_8"] = "".join(pieces) + word[at:]
            if min(raw) < 0:
                continue
            for right in WRITTEN_IN[1:]:
                if right != wrong:
                    try:
                        fixed = data.decode(right)
                    except UnicodeDecodeError:
                        continue
                    if fixed != word and not BROKEN.search(fixed):
                        out[f"{wrong}>{right}"] = fixed
        if max(map(ord, word)) > 0xFF:
            try:
                fixed = _HIGH.sub(lambda m: m.group().encode("utf_16_be").decode("utf_16_le"), word)
                if fixed != word:
                    out["utf_16_le>utf_16_be"] = fixed
            except UnicodeError:
                pass
        return out

    def misread(self, word: str) -> bool:
        """Whether ``word`` holds a well-formed UTF-8 sequence under a Latin reading."""
        found = self.latin.get(word)
        if found is None:
            if len(self.latin) > 200_000:
                self.latin.clear()
            found = self.latin[word] = any(name in LATIN_CHAINS for name in self.restore(word))
        return found

    def certain(self, word: str) -> dict[str, str]:
        """Those of :meth:`restore` under a Latin reading that rest on a UTF-8 sequence not there by chance."""
        out: dict[str, str] = {}
        if word.isascii():
            return out
        restored = None
        for chain in LATIN_CHAINS:
            raw = [self.readers[chain.split(">")[0]].get(c, -1) for c in word]
            for m in _SEQUENCE.finditer(bytes(b if b >= 0 else 0 for b in raw)):
                if not by_chance(word, *m.span()):
                    restored = self.restore(word) if restored is None else restored
                    if chain in restored:
                        out[chain] = restored[chain]
                    break
        return out


def by_chance(word: str, start: int, end: int) -> bool:
    """Whether clean text may hold ``word[start:end]``, a UTF-8 sequence read one byte at a time: two letters of a word (ÚŽ, ðá),
    or a letter and the marks after it (MANHÃ…, Spaß”)."""
    lead, rest, before, after = word[start], word[start + 1 : end], word[start - 1 : start] if start else "", word[end : end + 1]
    if not lead.isalpha():
        return lead == "×"
    if _LATIN.fullmatch(rest) and _LATIN.fullmatch(lead) and lead not in "ÃÂ":
        return True
    if not CLOSING.issuperset(rest) or lead in "ÃÂ" and not before.isalpha() or lead.isupper() and before.islower():
        return False
    return not after.isalpha() or rest[-1] in JOINING


class Trigrams:
    """A character trigram model with Witten-Bell back-off."""

    def __init__(self, counts: dict[str, int]):
        self.n = {3: counts, 2: Counter(), 1: Counter()}
        for g, c in counts.items():
            self.n[2][g[1:]] += c
            self.n[1][g[2]] += c
        self.total, self.kinds = {}, {}
        for size in (1, 2, 3):
            total, kinds = Counter(), Counter()
            for g, c in self.n[size].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.total[size], self.kinds[size] = total, kinds
        self.cache: dict[str, float] = {}

    def _p(self, gram: str) -> float:
        size = len(gram)
        if size == 0:
            return 1 / 65536
        context = gram[:-1]
        below = self._p(gram[1:])
        total = self.total[size].get(context, 0)
        if not total:
            return below
        kinds = self.kinds[size][context]
        return (self.n[size].get(gram, 0) + kinds * below) / (total + kinds)

    def bits_of_own(self, word: str, times: int = 1) -> float:
        """:meth:`bits` of a word that took part in training ``times``, without its own share: what occurs no oftener counts as unseen."""
        text, out = f"  {word.lower()} ", 0.0
        for i in range(2, len(text)):
            g = text[i - 2 : i + 1]
            if 1 <= (own := self.n[3].get(g, 0)) <= times:
                below = self._p(g[1:]) if self.n[2][g[1:]] > own else self._p(g[2:]) * 0.5
                total, kinds = self.total[3][g[:-1]] - own, self.kinds[3][g[:-1]] - 1
                out -= math.log2(kinds * below / (total + kinds) if kinds > 0 else below)
            else:
                out += self._bits(g)
        return out

    def _bits(self, g: str) -> float:
        b = self.cache.get(g)
        if b is None:
            b = self.cache[g] = -math.log2(self._p(g))
        return b

    def bits(self, word: str) -> float:
        text, out = f"  {word.lower()} ", 0.0
        for i in range(2, len(text)):
            out += self._bits(text[i - 2 : i + 1])
        return out


def odd_case(word: str) -> bool:
    """Capitals elsewhere than in front or throughout."""
    return any(not (p[1:].islower() or p.isupper() or p.lower() == p.upper()) for p in _PART.findall(word) if p[1:].lower() != p[1:].upper())


def grams_of(value: str) -> Iterator[str]:
    for word in value.split(" "):
        text = f"  {word.lower()} "
        for i in range(2, len(text)):
            yield text[i - 2 : i + 1]


class Judge:
    """Finds the likeliest chain for a value under a model."""

    def __init__(self, model: Trigrams, chains: Chains | None = None):
        self.model, self.chains, self.words = model, chains or Chains(), {}

    def _word(self, word: str) -> dict[str, tuple[float, str]]:
        found = self.words.get(word)
        if found is None:
            own, found = self.model.bits_of_own(word) + ODD_CASE_BITS * odd_case(word), {}
            for chain, fixed in (self.chains.certain(word) or self.chains.restore(word)).items():
                gain = own - self.model.bits(fixed) - ODD_CASE_BITS * odd_case(fixed)
                if gain > 1 and (chain.endswith(">utf_8") or any(c.isalpha() and not c.isascii() for c in fixed)):
                    found[chain] = (gain, fixed)
            if len(self.words) > 200_000:
                self.words.clear()
            self.words[word] = found
        return found

    def best(self, value: str) -> tuple[float, str, str]:
        """(gain in bits, chains, restored value); a chain is applied to every word that it improves, then others follow."""
        gain, used, original = 0.0, [], value
        for _ in range(4):
            words = value.split(" ")
            tried = [self._word(w) for w in words]
            total: Counter = Counter()
            for t in tried:
                for chain, (g, fixed) in t.items():
                    # very short words follow the others, unless several bytes each agree on what they were
                    total[chain] += g if chain.endswith(">utf_8") or sum(map(str.isalpha, fixed)) > 2 else 0.0
            if not total or max(total.values()) <= 0:
                break
            chain, more = max(total.items(), key=lambda x: (x[1], x[0]))
            value = " ".join(t[chain][1] if chain in t else w for w, t in zip(words, tried))
            if value == original:  # chains that undo one another: neither reading is likelier
                return 0.0, "", original
            gain += more
            used.append(chain)
        return gain, "+".join(used), value

    def certain(self, value: str) -> tuple[str, str]:
        """(chains, restored value) from UTF-8 sequences that aren't there by chance, each word by its likeliest chain."""
        used: list[str] = []
        for _ in range(4):
            words = value.split(" ")
            tried = [self.chains.certain(w) for w in words]
            if not any(tried):
                break
            best = [min(t.items(), key=lambda x: (self.model.bits(x[1]), x[0])) if t else ("", w) for w, t in zip(words, tried)]
            value = " ".join(fixed for _, fixed in best)
            used += sorted({chain for chain, _ in best if chain})
        return "+".join(used), value


def structural(value: str, chains: Chains) -> bool:
    """Broken in itself: signs of wrong decoding, a well-formed UTF-8 sequence read one byte at a time, or swapped byte pairs
    (characters spread over many blocks of 256, but at the same few places in them)."""
    far = [ord(c) for c in value if ord(c) > 0xFF]
    if "\u2000" in value or len(far) >= 3 and len({x & 0xFF for x in far}) <= 2 and len({x >> 8 for x in far}) >= 3:
        return True
    return bool(BROKEN.search(value)) or bool(_INSIDE.search(value)) or any(chains.misread(w) for w in value.split(" ") if not w.isascii())


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text, n, restored, clean): trigrams of plain ASCII words with their numbers; other words with theirs, what the chains make of them (JSON), and
    whether they are free of structural signs. Added up by task; a word that goes through several tasks comes out several times."""
    chains, grams, words = Chains(), Counter(), Counter()

    def rows() -> pd.DataFrame:
        out = [(g, n, None, True) for g, n in grams.items()]
        for w, n in words.items():
            fixed = chains.certain(w) or chains.restore(w)
            # very short words are no evidence, unless several bytes each agree on what they were
            kept = [x for c, x in fixed.items() if c.endswith(">utf_8") or sum(map(str.isalpha, x)) > 2 and any(y.isalpha() and not y.isascii() for y in x)]
            out.append((w, n, json.dumps(sorted(set(kept))), not structural(w, chains)))
        grams.clear(), words.clear()
        return pd.DataFrame(out, columns=["text", "n", "restored", "clean"])

    for batch in batches:
        for value in batch.iloc[:, 0]:
            for word in value.split(" "):
                if word.isascii():
                    grams.update(grams_of(word))
                else:
                    words[word] += 1
        if len(grams) + len(words) > COUNTED:
            yield rows()
    yield rows()


def count_words(values: DataFrame) -> DataFrame:
    """:func:`_words` of the distinct ``values`` (one column), each text once and written to disk: rounds of training read this, not the values."""
    rows = values.mapInPandas(_words, "text string, n long, restored string, clean boolean")
    once = rows.groupBy("text", F.col("restored").isNull().alias("gram")).agg(F.sum("n").alias("n"), F.first("restored").alias("restored"), F.bool_and("clean").alias("clean"))
    return checkpoint(once.repartition(2 * values.sparkSession.sparkContext.defaultParallelism))


def count_trigrams(words: DataFrame, counts=None) -> dict[str, int]:
    """Trigram counts of the clean ones of :func:`count_words`, added up before the shuffle.

    ``counts``: the last model's, broadcast; words that it would change by ``SUSPECT_BITS`` aren't clean. Without one, clean means free of
    structural signs. All trigrams come to the driver: their number grows with the letters that occur, hardly with the values.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, model = Counter(), Trigrams(counts.value) if counts is not None else None
        for batch in batches:
            for word, n, restored, clean in zip(batch["text"], batch["n"], batch["restored"], batch["clean"]):
                if not clean:
                    continue
                if model is not None:
                    own = model.bits_of_own(word, min(n, RARE)) + ODD_CASE_BITS * odd_case(word) - SUSPECT_BITS
                    if any(model.bits(x) + ODD_CASE_BITS * odd_case(x) <= own for x in json.loads(restored)):
                        continue
                for g in grams_of(word):
                    out[g] += n
        if out:
            yield pd.DataFrame({"gram": list(out), "n": list(out.values())})

    own = words.where("not gram").select("text", "n", "restored", "clean").mapInPandas(run, "gram string, n long")
    rows = own.unionByName(words.where("gram").select(F.col("text").alias("gram"), "n")).groupBy("gram").agg(F.sum("n").alias("n"))
    got = rows.toPandas()
    return dict(zip(got["gram"], got["n"].astype(int)))


def garblings(value: str) -> Iterator[str]:
    """``value`` garbled on purpose: written in each of four encodings and read with one that its checksum picks."""
    wrong = READ_AS[zlib.crc32(value.encode()) % 7]
    for right in ("utf_8", "cp1252", "cp1251", "cp1250"):
        try:
            garbled = value.encode(right).decode(wrong)
        except UnicodeError:
            continue
        if garbled != value:
            yield garbled


def margins_reached(values: DataFrame, counts) -> np.ndarray:
    """How many of all ``values`` (one column, distinct) without structural signs (row 0), and of their :func:`garblings` (row 1), reach 0, 1, ...
    of ``MARGINS`` under the model of ``counts`` (broadcast). Added up by task, then over tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge, out = Judge(Trigrams(counts.value)), np.zeros((2, len(MARGINS) + 1), dtype=np.int64)
        for batch in batches:
            for value in batch.iloc[:, 0]:
                if not value.isascii() and not structural(value, judge.chains):
                    for garbled, texts in enumerate(([value], garblings(value))):
                        for text in texts:
                            out[garbled, np.searchsorted(MARGINS, judge.best(text)[0], side="right")] += 1
        garbled, reached = np.nonzero(out)
        yield pd.DataFrame({"garbled": garbled, "reached": reached, "n": out[garbled, reached]})

    reached = np.zeros((2, len(MARGINS) + 1), dtype=np.int64)
    for row in values.mapInPandas(run, "garbled int, reached int, n long").groupBy("garbled", "reached").agg(F.sum("n").alias("n")).collect():
        reached[row["garbled"], row["reached"]] = row["n"]
    return reached


def validated_margin(reached: np.ndarray) -> float:
    """The margin with the fewest errors on clean values and on the same values garbled on purpose (the middle one, if several), by :func:`margins_reached`.

    The clean values may hold some garbled ones, which add the same errors to every margin below their gains.
    """
    kept, garbled = reached
    if not kept.sum() or not garbled.sum():
        return UNTRIED_MARGIN
    below = np.cumsum(reached, axis=1)[:, :-1]  # those that don't reach each margin
    errors = (kept.sum() - below[0]) / kept.sum() + below[1] / garbled.sum()
    return float(np.median(MARGINS[errors <= errors.min() + 1e-9]))


def find_garbled(items: DataFrame, value: str = "value") -> DataFrame:
    """``items`` with garbled (boolean), gain (bits), margin (the least gain that is accepted), chain and restored.

    Null and empty values are not garbled and restore to themselves; values broken beyond restoring are garbled with the
    text as far as it could be restored. Rows are kept as they are. The model is trained on all values in rounds:
    without words broken in themselves, then also without those that the last model would change. The margin is validated on all values too.
    """
    spark = items.sparkSession
    # read for the counts and for the margin; an explicit number of partitions keeps the small but costly rows spread over all cores
    values = items.select(F.col(value).alias("value")).where("value is not null and value <> ''").distinct()
    values = checkpoint(values.repartition(2 * spark.sparkContext.defaultParallelism))
    words = count_words(values)
    counts = count_trigrams(words)
    for _ in range(ROUNDS):
        counts = count_trigrams(words, spark.sparkContext.broadcast(counts))
    model = spark.sparkContext.broadcast(counts)
    margin = validated_margin(margins_reached(values, model))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, seen = Judge(Trigrams(model.value)), {}
        for texts in batches:
            out = []
            for v in texts:
                if not isinstance(v, str) or v.isascii():
                    out.append((False, 0.0, None, v))
                    continue
                if v not in seen:
                    gain, chain, fixed = own.best(v)
                    broken = BROKEN.search(v) is not None
                    accepted = gain >= margin
                    sure, text = own.certain(fixed if accepted else v)
                    used = "+".join(x for x in (chain if accepted else "", sure) if x)
                    seen[v] = (broken or bool(used), gain, used or None, text)
                out.append(seen[v])
            if len(seen) > 200_000:  # a memory bound; values are then judged again
                seen.clear()
            yield pd.DataFrame(out, columns=["garbled", "gain", "chain", "restored"])

    judged = F.pandas_udf(run, "garbled boolean, gain double, chain string, restored string").asNondeterministic()
    kept = [c for c in items.columns if c not in ("garbled", "gain", "margin", "chain", "restored")]  # a clashing column gives way
    return items.withColumn("_j", judged(F.col(value))).select(*kept, "_j.garbled", "_j.gain", F.lit(margin).alias("margin"), "_j.chain", "_j.restored")
