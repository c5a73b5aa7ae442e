"""Variant spellings of names, linked to registered persons and organisations by a trie join.

The registry is cut into shards of bounded size; each shard's name words form a trie, which a Levenshtein automaton
(with transpositions) walks for every word of a written name, listing all registered words within its distance. Agents
that such words point to are then checked as a whole: any order of the words, initials, short forms, abbreviations.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Agents per trie, and written names per task beside it.
SHARD_AGENTS, TASK_NAMES = 20_000, 20_000

# Common short and foreign forms of given names.
SHORT_FORMS = {
    "alexander": "alex al sasha sandy xander lex alec", "astrid": "asta", "augustine": "gus augie august", "benjamin": "ben benny benji",
    "boris": "borya", "charles": "chas charlie chuck charley carl karl", "clara": "klara", "dagmar": "dagi dag", "dorothea": "thea dora dorothy dot dottie dorry",
    "elizabeth": "betty eliza liz beth lisa lizzie bess libby betsy elsie", "emil": "emile", "felix": "fex", "francisco": "paco fran pancho frank francis cisco",
    "frederick": "fred fritz freddy freddie rick", "gabriela": "gabi gaby gabriella ella", "giuseppe": "pino beppe peppe joe joseph geppo", "helga": "helge",
    "henrietta": "etta hetty henny hattie harriet", "hugo": "hugh", "ingrid": "inga inge", "irma": "irmi", "isabella": "isa bella izzy isabel belle",
    "johannes": "hans joh jan john hannes jo", "katherine": "kate kathy katie cathy kat kit catherine kath", "leonard": "leo lenny len lennie leon", "lucas": "luke luc lukas luca",
    "marcel": "marc", "margaret": "peggy maggie meg greta marge margo rita daisy", "nadia": "nadya nadja", "nicholas": "nick nico nicolas klaus niko nicky", "olivier": "oli oliver ollie",
    "oscar": "ozzie oskar", "patricia": "pat trish patty tricia patsy", "pavel": "pasha paul pawel", "quentin": "quint quin quinn", "rafael": "rafa raf raphael rafi ralph",
    "robert": "rob bob robt bobby robbie bert", "ruth": "ruthie", "samuel": "sam sammy", "sonia": "sonja sonya", "theodore": "ted teddy theo", "tobias": "toby tobi tobe",
    "ulrich": "uli ulli ulric", "vera": "verochka", "victoria": "vicky vicki tori vic vickie", "william": "wm bill will willy billy willie liam", "yevgenia": "zhenya eugenia genia evgenia jenya",
    "zacharias": "zach zack zachary zak",
    "abigail": "abby gail", "abraham": "abe bram", "albert": "al bert bertie", "alfred": "alf alfie fred", "amanda": "mandy", "andrew": "andy drew andreas", "angela": "angie",
    "anthony": "tony anton antonio", "antonia": "toni tonia", "arthur": "art artie", "barbara": "barb babs", "bartholomew": "bart", "bernard": "bernie", "catharina": "trina karin",
    "christian": "chris", "christina": "chris tina chrissie", "christopher": "chris kit topher", "cornelius": "neil conny", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie",
    "dennis": "denny den", "donald": "don donny", "dmitri": "dima mitya", "douglas": "doug", "edmund": "ed ned", "edward": "ed eddie ned ted", "eleanor": "ellie nell nora", "emma": "em",
    "ernest": "ernie", "eugene": "gene", "florence": "flo", "gerald": "gerry jerry", "gregory": "greg", "harold": "harry hal", "heinrich": "heinz henry", "henry": "harry hank hal", "herbert": "herb bert",
    "ivan": "vanya", "jacob": "jake jack", "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess jessie", "john": "jack johnny jon", "jonathan": "jon", "jose": "pepe",
    "joseph": "joe joey", "joshua": "josh", "judith": "judy", "kenneth": "ken kenny", "lawrence": "larry laurie", "louis": "lou louie", "ludwig": "lutz", "maria": "mary mia mitzi", "martha": "marty",
    "martin": "marty", "matthew": "matt", "maximilian": "max", "michael": "mike mick mickey micha misha", "mikhail": "misha", "nathaniel": "nat nate nathan", "oliver": "ollie", "pamela": "pam", "peter": "pete",
    "philip": "phil pip", "raymond": "ray", "rebecca": "becky", "richard": "rick dick rich richie", "roberto": "beto", "roger": "rog", "ronald": "ron ronnie", "sebastian": "seb basti", "sergei": "seryozha",
    "stephen": "steve stevie stefan", "susanna": "sue susie", "terence": "terry", "thomas": "tom tommy", "timothy": "tim", "valentina": "valya", "vincent": "vince vinnie", "vladimir": "volodya vova",
    "walter": "walt wally", "wolfgang": "wolf", "yuri": "yura",
}
# Words that are no part of a name.
TITLES = frozenset("mr mrs ms miss dr prof professor sir dame by ed eds arr arranger producer prod the of von music words".split())
LEGAL = frozenset("ltd limited inc incorporated gmbh ag llc plc sa srl bv kg corp corporation".split())

_SEPARATOR = re.compile(r"\s*[;/&+|]\s*|\s+(?:feat|ft|featuring|and|with|und|et|vs)\.?\s+", re.IGNORECASE)
_INITIALS_LEGAL = re.compile(r"[,\s]+(?:S\.\s?A\.|S\.\s?r\.\s?l\.|B\.\s?V\.|A\.\s?G\.)\s*$")
_BRACKETS = re.compile(r"[(\[][^)\]]*[)\]]|[©℗]")
_WORD = re.compile(r"[^\W\d_�]*�[\w�]*|[^\W\d_]+(?:['’-][^\W\d_]+)*")


def fold(word: str) -> str:
    """Lower case without marks, with the usual ways to write letters and sounds made one."""
    text = unicodedata.normalize("NFKD", word.lower().replace("ł", "l").replace("ø", "o").replace("ß", "ss").replace("đ", "d").replace("æ", "ae"))
    text = "".join(c for c in text if c.isalpha() and not unicodedata.combining(c) or c == "�")
    return text.replace("kw", "qu").replace("w", "v") if len(text) > 1 else text


def initial(word: str) -> str:
    """The first letter as an initial is written: folded, but v and w stay apart."""
    return fold(word[:1])


def plainer(word: str) -> str:
    """A folded word with ae, oe, ue and aa read as marked vowels."""
    return re.sub(r"(?<!q)(a|o|u)e(?=[^aeiouy]|$)", r"\1", word).replace("aa", "a")


def names_of(short_forms: dict[str, str]) -> dict[str, frozenset[str]]:
    """Folded short form -> folded full names."""
    out: dict[str, frozenset[str]] = {}
    for name, forms in short_forms.items():
        for form in forms.split():
            out[fold(form)] = out.get(fold(form), frozenset()) | {fold(name)}
    return out


class Trie:
    """Words, and all of them within an edit distance (insertion, deletion, replacement, swap of neighbours)."""

    def __init__(self, words: Iterator[str]):
        self.root: dict = {}
        self.cache: dict[str, dict[str, int]] = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word

    def near(self, word: str) -> dict[str, int]:
        """Registered words within the distance that ``word``'s length allows, with their distances."""
        found = self.cache.get(word)
        if found is None:
            most = 0 if len(word) < 3 else 1 if len(word) < 8 else 2
            found = {}
            # the automaton's state after a prefix: edit distances to all prefixes of word, and the state before
            stack = [(self.root, list(range(len(word) + 1)), None, "")]
            while stack:
                node, row, before, last = stack.pop()
                for c, child in node.items():
                    if c == "":
                        if row[-1] <= most:
                            found[child] = min(row[-1], found.get(child, 9))
                        continue
                    new = [row[0] + 1]
                    for j, x in enumerate(word, 1):
                        d = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (x != c))
                        if before is not None and j > 1 and x == last and word[j - 2] == c:
                            d = min(d, before[j - 2] + 1)
                        new.append(d)
                    if min(new) <= most:
                        stack.append((child, new, row, c))
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[word] = found
        return found


def abbreviates(short: str, word: str) -> bool:
    """``short`` is ``word``, its beginning, or its letters with some left out, first one kept."""
    if not short or short[0] != word[0] or len(short) > len(word):
        return False
    rest = iter(word)
    return all(c in rest for c in short) and (len(short) <= 5 or word.startswith(short))


class Registry:
    """One shard of agents as a trie with a way back from words to agents."""

    def __init__(self, agents: list[tuple[int, str, str]], short_forms: dict[str, str] = SHORT_FORMS):
        self.short = names_of(short_forms)
        self.by_word: dict[str, set[int]] = defaultdict(set)
        self.by_other: dict[str, set[int]] = defaultdict(set)  # the further words of organisations
        self.agents: dict[int, tuple[str, list[str]]] = {}
        self.initials: dict[int, list[str]] = {}
        for agent_id, name, kind in agents:
            words = [fold(w) for w in _WORD.findall(name)]
            if not words:
                continue
            self.agents[agent_id] = (kind, words)
            self.initials[agent_id] = [initial(w) for w in _WORD.findall(name)]
            self.by_word[words[0] if kind == "organisation" else words[-1]].add(agent_id)
            if kind == "organisation":
                for word in words[1:]:
                    self.by_other[word].add(agent_id)
        self.trie = Trie(iter(self.by_word))
        self.given = Trie(w[0] for k, w in self.agents.values() if k != "organisation")

    def _given(self, word: str, given: str) -> int | None:
        if word == given:
            return 0
        if given in self.short.get(word, ()) or len(word) >= 3 and given.startswith(word):
            return 0
        return _either(self.given, word).get(given)

    def _person(self, words: list[str], own: list[str], initials: list[str], family_at: int) -> int | None:
        """Distance of the words besides the family name from ``own``'s given name and middle initial; None: someone else."""
        given, middle = own[0], initials[1:-1]
        rest = [w for i, w in enumerate(words) if i != family_at]
        letters, full = [w for w in rest if len(w) == 1], [w for w in rest if len(w) > 1]
        if len(full) > 1:
            return None
        if full:
            d = self._given(full[0], given)
            if d is None:
                return None
            if len(letters) > 1 or letters and middle and letters[0] != middle[0]:
                return None
            return d
        if not letters or len(letters) > 2:
            return None
        if letters[0] == initials[0] and (len(letters) == 1 or not middle or letters[1] == middle[0]):
            return 0
        return None

    def _organisation(self, words: list[str], own: list[str], name_at: int, own_at: int = 0) -> int | None:
        """Distance of the words besides ``words[name_at]``, which stands for ``own[own_at]``; the first of ``own`` must be among them."""
        rest, left, distance = [w for i, w in enumerate(words) if i != name_at], own[:own_at] + own[own_at + 1 :], 0
        head = own_at == 0
        for w in rest:
            w = "v" if w == "w" else w  # as in the folded words
            hit = next((o for o in left if o == w), None) or next((o for o in left if abbreviates(w, o)), None)
            if hit is None:
                hit = next((o for o in left if len(w) > 3 and w in _near(w, o)), None)
                distance += 1
            if hit is None:
                return None
            head = head or hit == own[0] and len(w) > 1
            left = [o for i, o in enumerate(left) if i != left.index(hit)]
        return distance if head and (len(left) < len(own) - 1 or len(own) == 1) else None

    def link(self, name: str) -> list[tuple[int, int]]:
        """(agent, distance) of the nearest agents that one written name fits, several if it fits them equally.

        A single word fits agents of one word only.
        """
        words = [fold(w) for w in _WORD.findall(name)]
        words = [w for w in words if w and w not in TITLES]
        plain = [w for w in words if w not in LEGAL]
        plain = plain if len(plain) > 1 else words
        best: dict[int, int] = {}
        for i, w in enumerate(plain):
            for word, d in _either(self.trie, w).items():
                for agent in self.by_word[word]:
                    kind, own = self.agents[agent]
                    if len(plain) == 1 or len(own) == 1:
                        more = 0 if len(plain) == len(own) else None
                    elif kind == "organisation":
                        more = self._organisation(plain, own, i)
                    else:
                        more = self._person(plain, own, self.initials[agent], i)
                    if more is not None and d + more <= 3:
                        best[agent] = min(d + more, best.get(agent, 9))
        if not best and len(plain) > 1:  # an abbreviated first word: organisations by a further word as it is registered
            for i, w in enumerate(plain):
                for agent in self.by_other.get(w, ()):
                    own = self.agents[agent][1]
                    more = self._organisation(plain, own, i, own.index(w, 1))
                    if more is not None and more <= 3:
                        best[agent] = min(more, best.get(agent, 9))
        least = min(best.values(), default=0)
        return sorted((a, d) for a, d in best.items() if d == least)


def _either(trie: Trie, word: str) -> dict[str, int]:
    """Neighbours of a word as written and with its vowel pairs read as marked vowels."""
    found, other = trie.near(word), plainer(word)
    return found if other == word else {x: min(d for d in (found.get(x), trie.near(other).get(x)) if d is not None) for x in {*found, *trie.near(other)}}


def _near(w: str, o: str) -> tuple[str, ...]:
    return (w,) if Trie(iter([o])).near(w) else ()


def parts(value: str) -> list[str]:
    """The names that a value holds."""
    text = re.sub(r"\s+", " ", _BRACKETS.sub(" ", value.replace("_", " "))).strip()
    return [_INITIALS_LEGAL.sub("", p) for p in _SEPARATOR.split(text) if p.strip()]


def link_names(names: DataFrame, agents: DataFrame, value: str = "value", short_forms: dict[str, str] = SHORT_FORMS) -> DataFrame:
    """(value, part, agent_id, distance): distinct values of ``names`` with the agents they name, best per part.

    Shards meet the values in co-grouped tasks, both sides of bounded size, so neither the registry nor the values are
    gathered anywhere. A shard gives all its nearest agents; which is nearest of all, and whether it is the only one, is
    settled after the shards, so their number doesn't bear on the result. Null and empty values, and names that fit several
    agents equally, give no row. ``short_forms``: full given name -> its short forms.
    """
    shards = max(1, -(-agents.count() // SHARD_AGENTS))
    values = names.select(F.col(value).alias("value")).where("value is not null and trim(value) <> ''").distinct()
    tasks = max(1, -(-values.count() // TASK_NAMES))
    tasks = max(tasks, 4 * names.sparkSession.sparkContext.defaultParallelism)
    left = values.select("value", F.pmod(F.xxhash64("value"), F.lit(tasks)).cast("int").alias("task"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = agents.where("agent_name is not null").select("agent_id", "agent_name", "agent_kind", F.pmod(F.xxhash64("agent_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"))

    def run(written: pd.DataFrame, registered: pd.DataFrame) -> pd.DataFrame:
        registry = Registry(list(zip(registered["agent_id"], registered["agent_name"], registered["agent_kind"])), short_forms)
        out = [(v, i, *hit) for v in written["value"] for i, p in enumerate(parts(v)) for hit in registry.link(p)]
        return pd.DataFrame(out, columns=["value", "part", "agent_id", "distance"])

    # both sides by the same explicit partitions: small but costly groups aren't put together again
    left, right = left.repartition(tasks, "shard", "task"), right.repartition(tasks, "shard", "task")
    found = left.groupBy("shard", "task").cogroup(right.groupBy("shard", "task")).applyInPandas(run, "value string, part int, agent_id long, distance int")
    # the two nearest tell whether one alone is: ties needn't be gathered
    nearest = found.groupBy("value", "part", "distance").agg(F.min("agent_id").alias("agent_id"), F.max("agent_id").alias("other"))
    best = nearest.groupBy("value", "part").agg(F.min(F.struct("distance", "agent_id", "other")).alias("b"))
    return best.where("b.agent_id = b.other").select("value", "part", "b.agent_id", "b.distance")
