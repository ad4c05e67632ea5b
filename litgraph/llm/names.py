"""Variant spellings of people's names: rows that name one person are linked.

1. Names are parsed into family, given name and initials. Roles that the spelling leaves open ("Li Mei", "Mei Li") are
   told by given names, learned over all rows from spellings that leave nothing open. Those with at least ``SHARE`` of
   the evidence, at most 1/SHARE, are a list; all rarer ones stay a table: it decides the order of words that the list
   doesn't (``turned``). Nicknames are learned from names that quote them.
2. Candidates: prefix-filtered set-similarity join on q-grams of the family name. Grams are ordered from rare to common
   over all rows, and only the first few of a name are joined, together with institution and initial: as many as the
   slips can take, and one more. Names without an affiliation are joined by longer grams against all. Grams of many
   names are joined block against block.
3. Verification: soft weighted token similarity over family name, institution and initial. What agrees counts by
   rarity, so rare tokens carry a pair over more of a slip; what doesn't counts alike for all names. Two spellings both
   in wide use are two names, not one misspelt.
4. Each spelling goes to the most frequent one it matches. Given names that are not on the list are compared within a
   family and institution (``called``). Given names make persons, and bare initials go to the one person they fit.

Results for odd input: null and blank names are linked to nothing; a null affiliation matches any, by its family name;
equal rows are linked like others; persons of any size come out in all pairs, block against block of about ``BLOCK``
rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.physical import cut, spread, written
from .blocks import pairs_within

SHARE = 0.002
BLOCK = 256
#: Letters from which a name may have two slips, else one. A slip, of two letters turned at worst, takes one gram more
#: than a gram has letters
LONG, GRAM, WIDE_GRAM = 8, 2, 5
#: A spelling used at COMMON institutions or more, and at one to OFTEN of the other's or more, is a name of its own
COMMON, OFTEN = 3, 5
SIMILAR = 0.85

#: Titles, particles of family names, short forms in affiliations, usual nicknames.
TITLES = re.compile(r"\b(?:dr|prof|mr|mrs|ms)\b\.?\s*", re.I)
PARTICLES = frozenset("van von der den de di du da la le ten ter zu vd v d".split())
GLUED = re.compile(r"\b(?:vander|vanden|van|von|de)(?=[A-ZÀ-Þ][a-zß-ÿ])")
WORKPLACE = {
    "university": "univ", "univ": "univ", "institute": "inst", "inst": "inst", "technology": "tech", "technol": "tech", "medical": "med", "med": "med",
    "school": "sch", "sch": "sch", "hospital": "hosp", "hosp": "hosp", "cancer": "canc", "canc": "canc", "centre": "ctr", "center": "ctr", "ctr": "ctr",
    "general": "gen", "gen": "gen", "research": "res", "res": "res", "foundation": "fdn", "found": "fdn", "fdn": "fdn", "veterinary": "vet", "vet": "vet",
    "college": "coll", "coll": "coll", "childrens": "child", "children": "child", "clinic": "clin", "clin": "clin", "academy": "acad", "acad": "acad",
    "laboratory": "lab", "lab": "lab", "faculty": "fac", "fac": "fac", "national": "natl", "natl": "natl",
}
PLACES_OF_WORK = frozenset("univ inst sch hosp ctr fdn coll clin acad lab".split())
GENERAL = frozenset(WORKPLACE.values())
UNIT = re.compile(r"^\W*(?:dept|department|div|division|sect|section|unit|lab|laboratory)\b", re.I)
NICKNAMES = {
    "bob": "robert", "rob": "robert", "bill": "william", "will": "william", "jim": "james", "joe": "joseph", "tom": "thomas", "mike": "michael",
    "dick": "richard", "rick": "richard", "chuck": "charles", "dan": "daniel", "ned": "edward", "ted": "edward", "ed": "edward", "fred": "frederick",
    "sam": "samuel", "ben": "benjamin", "nick": "nicholas", "andy": "andrew", "chris": "christopher", "sasha": "alexander", "alex": "alexander",
    "peggy": "margaret", "maggie": "margaret", "liz": "elizabeth", "beth": "elizabeth", "kate": "katherine", "kathy": "katherine", "sue": "susan",
    "meg": "margaret", "hans": "johannes", "lizzie": "elizabeth", "pat": "patricia", "trish": "patricia", "vicky": "victoria", "beppe": "giuseppe", "paco": "francisco", "pepe": "jose",
}
LETTERS = re.compile(r"[^\W\d_]+")
QUOTED = re.compile(r"[\"“(]\s*([^\"”()]+?)\s*[\"”)]")
INITIALS = re.compile(r"(?:[^\W\d_]\.-?){1,3}|[^\W\d_]|[A-ZÀ-Þ]{2,3}")
SPECIAL = str.maketrans({"ø": "o", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "a", "œ": "o", "ı": "i"})
DIGRAPHS = re.compile(r"([aou])e")


@lru_cache(1 << 16)
def plain(s: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFKD", s.lower().translate(SPECIAL))
    return "".join(c for c in s if not unicodedata.combining(c))


def squeeze(s: str) -> str:
    """ae, oe and ue as the plain vowel, since umlauts are written either way."""
    return DIGRAPHS.sub(r"\1", s)


def fold(s: str) -> str:
    return squeeze(plain(s))


def given_key(token: str) -> str:
    return "".join(LETTERS.findall(plain(token)))


def family_key(tokens: list[str]) -> str:
    words = [w for t in tokens for w in LETTERS.findall(fold(t.replace("'", "").replace("’", "")))]
    return "".join(w for i, w in enumerate(words) if w not in PARTICLES or i == len(words) - 1)


class Parsed:
    __slots__ = ("family", "given", "initials", "nick", "open", "tokens")

    def __init__(self, family, given, initials, nick, is_open=False, tokens=()):
        self.family, self.given, self.initials, self.nick, self.open, self.tokens = family, given, initials, nick, is_open, tokens


def is_initials(token: str, all_upper: bool) -> bool:
    return bool(INITIALS.fullmatch(token)) and token.lower() not in ("v.d.",) and not (all_upper and len(token) > 1 and "." not in token)


def is_particle(tokens: list[str], k: int, all_upper: bool) -> bool:
    """A particle stands before a family name; in capitals it needs a name in capitals after it, or it is initials."""
    t = tokens[k]
    if k + 1 == len(tokens) or (t.lower() != "v.d." and t.strip(".").lower() not in PARTICLES):
        return False
    return not t.isupper() or all_upper or (tokens[k + 1].isupper() and len(tokens[k + 1]) >= 3)


def letters_of(tokens: list[str]) -> str:
    return "".join(fold(c) for t in tokens for c in t if c.isalpha())


def parse(name: str) -> Parsed | None:
    """Family tokens, given name and initials; ``open`` if the order of the words doesn't tell which is which."""
    nick = QUOTED.search(name)
    s = TITLES.sub("", QUOTED.sub(" ", name)).strip()
    s = GLUED.sub("", s)
    if not LETTERS.search(s):
        return None
    alias = given_key(nick.group(1)) if nick else ""
    all_upper = s.isupper()

    def rest(tokens: list[str]) -> tuple[str, str]:
        full = [t for t in tokens if not is_initials(t, all_upper)]
        short = letters_of([t for t in tokens if is_initials(t, all_upper)])
        given = given_key(full[0]) if full else ""
        return given, (given[:1] + short) if given else short

    if "," in s:
        family, _, other = s.partition(",")
        given, initials = rest(other.split())
        return Parsed(family_key(family.split()), given, initials, alias)
    tokens = s.split()
    if len(tokens) == 1:
        return Parsed(family_key(tokens), "", "", alias)
    initial = [is_initials(t, all_upper) for t in tokens]
    particle = [is_particle(tokens, k, all_upper) for k in range(len(tokens))]
    shout = [not all_upper and t.isupper() and sum(c.isalpha() for c in t) >= 4 for t in tokens]
    if any(shout):
        family = [t for t, loud, p in zip(tokens, shout, particle) if loud or p]
        given, initials = rest([t for t, loud, p in zip(tokens, shout, particle) if not loud and not p])
        return Parsed(family_key(family), given, initials, alias)
    if initial[-1] and not particle[-1]:
        k = len(tokens)
        while k and initial[k - 1]:
            k -= 1
        return Parsed(family_key(tokens[:k]), "", letters_of(tokens[k:]), alias)
    if initial[0] and not particle[0]:
        k = 0
        while k < len(tokens) - 1 and initial[k] and not particle[k]:
            k += 1
        return Parsed(family_key(tokens[k:]), "", letters_of(tokens[:k]), alias)
    if any(i and not p for i, p in zip(initial, particle)):
        k = max(j for j in range(len(tokens)) if initial[j] and not particle[j])
        given, initials = rest(tokens[: k + 1])
        return Parsed(family_key(tokens[k + 1 :]), given, initials, alias)
    if any(particle):
        k = particle.index(True)
        if k > 0:
            given, initials = rest(tokens[:k])
            return Parsed(family_key(tokens[k:]), given, initials, alias)
    return Parsed("", "", "", alias, True, tokens)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or ``most`` + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def cropped(s: str) -> set[str]:
    """``s``, and ``s`` without one of its letters: strings one slip apart have one of these in common."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


class Vocabulary:
    """Given names as spelled (``plain``), and nicknames with the names they stand for. Names are compared squeezed."""

    def __init__(self, given: list[str], nicknames: dict[str, str]):
        self.spelled, self.quoted = sorted(given), nicknames
        self.given = frozenset(map(squeeze, given))
        pairs = {**NICKNAMES, **nicknames}.items()
        self.nicknames = {squeeze(n): squeeze(g) for n, g in pairs if squeeze(n) not in self.given or squeeze(g) in self.given}
        self.known = sorted({*given, *(n for n, g in pairs if squeeze(g) in self.given)})
        #: known names, plain and squeezed, by what is left without one letter or none
        self.cropped: dict[str, set[str]] = {}
        for n in self.known:
            for part in cropped(n) | cropped(squeeze(n)):
                self.cropped.setdefault(part, set()).add(n)
        self.cache: dict[str, tuple[str, int]] = {}
        self.starts: dict[str, set[str]] = {}
        for n, g in self.nicknames.items():
            self.starts.setdefault(g, set()).add(n[:1])

    def canonical(self, token: str) -> tuple[str, int]:
        """(name it stands for, how sure: 3 known, 2 nickname, 1 with a slip, 0 unknown)."""
        key = squeeze(token)
        if key in self.nicknames:
            return self.nicknames[key], 2
        if key in self.given:
            return key, 3
        got = self.cache.get(token)
        if got is None:
            close = set().union(*(self.cropped.get(part, ()) for part in cropped(token) | cropped(key))) if len(token) > 3 else ()
            near = [squeeze(n) for n in close if distance(token, n, 1) == 1 or distance(key, squeeze(n), 1) == 1]
            near.sort(key=lambda n: (n not in self.given, n[:1] != token[:1], n))
            got = (self.nicknames.get(near[0], near[0]), 1) if near else (key, 0)
            if len(self.cache) < 1 << 17:
                self.cache[token] = got
        return got

    def initials(self, given: str) -> set[str]:
        return {given[:1]} | self.starts.get(given, set())

    def resolve(self, p: Parsed) -> Parsed:
        if not p.open:
            return p
        ends = [(self.canonical(given_key(p.tokens[k]))[1], k) for k in (0, -1)]
        k = 0 if ends[0][0] >= ends[1][0] else -1
        given = given_key(p.tokens[k])
        family = p.tokens[1:] if k == 0 else p.tokens[:-1]
        return Parsed(family_key(family), given, given[:1], p.nick)


def workplace(affiliation: str | None) -> str:
    """Institution of an affiliation: its words without the department, short forms alike, in order of the alphabet."""
    if not affiliation or not LETTERS.search(affiliation):
        return ""
    found, other = None, None
    pieces = re.split(r"[,;]", affiliation)
    for k, piece in enumerate(pieces):
        if UNIT.match(piece):
            continue
        words = LETTERS.findall(fold(piece.replace("'", "").replace("’", "")))
        coded = sorted({WORKPLACE.get(w, w) for w in words if w not in ("of", "the", "and", "s")})
        if not coded:
            continue
        if PLACES_OF_WORK.intersection(coded):
            if GENERAL.issuperset(coded):  # only the kind of place: its town follows
                coded = sorted({*coded, *(w for p in pieces[k + 1 : k + 2] for w in LETTERS.findall(fold(p)))})
            found = " ".join(coded)
            break
        other = other or " ".join(coded)
    return found or other or ""


def learn(rows: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Given names and nicknames from spellings that leave no doubt; what reaches the driver is bounded by SHARE.

    Beside it all the evidence (kind, given, nick, n), squeezed: words that are a ``given`` or ``family`` name for sure,
    and those that stand ``first`` or ``last`` where that is open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str, str], int] = {}
            for name in batch.column("name").to_pylist():
                p = parse(name)
                if not p:
                    continue
                found = []
                if not p.open:
                    found.append(("family", p.family, ""))
                    if len(p.given) > 1:
                        found += [("given", p.given, "")] + [("given", p.given, p.nick)] * bool(p.nick)
                elif len(p.tokens) > 1:
                    first = given_key(p.tokens[0])
                    found += [("first", first, ""), ("last", family_key(p.tokens[1:]), "")] + [("given", first, p.nick)] * bool(p.nick)
                for k in found:
                    seen[k] = seen.get(k, 0) + 1
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in seen], pa.string()) for i in range(3)), pa.array(list(seen.values()), pa.int64())], names=["kind", "given", "nick", "n"])

    evidence = cut(rows.mapInArrow(run, "kind string, given string, nick string, n bigint").groupBy("kind", "given", "nick").agg(F.sum("n").alias("n")))
    counts = evidence.where("kind = 'given'")
    totals = {r["is_nick"]: r["n"] for r in counts.groupBy((F.col("nick") != "").alias("is_nick")).agg(F.sum("n").alias("n")).collect()}
    given = [r["given"] for r in counts.where((F.col("nick") == "") & (F.col("n") >= max(2, SHARE * totals.get(False, 0)))).select("given").collect()]
    known = counts.where((F.col("nick") != "") & (F.col("n") >= SHARE * totals.get(True, 0)))
    nicknames: dict[str, tuple[int, str]] = {}
    for r in known.collect():
        if r["given"] in given:
            nicknames[r["nick"]] = max(nicknames.get(r["nick"], (0, "")), (r["n"], r["given"]))
    short = lambda c: F.regexp_replace(c, DIGRAPHS.pattern, "$1").alias(c)
    squeezed = evidence.select("kind", short("given"), short("nick"), "n").groupBy("kind", "given", "nick").agg(F.sum("n").alias("n"))
    return Vocabulary(given, {n: g for n, (_, g) in nicknames.items() if n != g}), squeezed


def parsed(bylines: DataFrame, vocabulary: Vocabulary, key: str) -> DataFrame:
    """(key, inst, family, given, initials, ...): ``given`` is the name it stands for, or "" if there are only initials.

    Where the vocabulary doesn't tell the order of the words, the second reading is in ``other_``; ``word`` is the given
    name as written and ``sure`` how well the vocabulary knows it.
    """
    shared = bylines.sparkSession.sparkContext.broadcast((vocabulary.spelled, vocabulary.quoted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*shared.value)

        def reading(p: Parsed) -> tuple:
            given = vocabulary.canonical(p.given)[0] if len(p.given) > 1 else ""
            return p.family, given, p.initials or given[:1], squeeze(p.given), vocabulary.canonical(p.given)[1]

        for batch in batches:
            at, places, rows = [], [], []
            for i, (name, affiliation) in enumerate(zip(batch.column("name").to_pylist(), batch.column("affiliation").to_pylist())):
                p = parse(name)
                if not p:
                    continue
                one, other = reading(vocabulary.resolve(p)), (None,) * 5
                if p.open:
                    both = [reading(Parsed(family_key(f), g, g[:1], p.nick)) for f, g in ((p.tokens[1:], given_key(p.tokens[0])), (p.tokens[:-1], given_key(p.tokens[-1])))]
                    both = [r for r in both if r[0] and r[3]]
                    if len(both) == 2 and max(r[4] for r in both) < 2:
                        one, other = both
                if not one[0]:
                    continue
                at.append(i)
                places.append(workplace(affiliation))
                rows.append(one + other)
            cols = list(zip(*rows)) or [()] * 10
            kinds = [pa.string()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(places, pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds * 2))], names=[key, "inst", *READING, *(f"other_{c}" for c in READING)])

    kind = bylines.schema["key"].dataType.simpleString()
    types = [(p + c, "int" if c == "sure" else "string") for p in ("", "other_") for c in READING]
    return bylines.mapInArrow(run, f"`{key}` {kind}, inst string, " + ", ".join(f"{c} {t}" for c, t in types))


READING = ("family", "given", "initials", "word", "sure")


def turned(rows: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, inst, family, given, initials) in the order of words that has more evidence for it, else as written.

    First counts where the words are a given and a family name for sure, then the vocabulary, then which of the two
    orders is the usual one among names that leave it open.
    """
    kept = [key, "inst", "family", "given", "initials"]
    form = [p + c for c in ("family", "word", "sure") for p in ("", "other_")]
    asked = rows.where("other_family IS NOT NULL").select(*form).distinct()
    questions = [F.struct(F.lit(o).alias("at"), F.lit(k).alias("kind"), F.col(p + c).alias("token")) for o, p in ((1, ""), (2, "other_")) for k, c in (("given", "word"), ("family", "family"), ("first", "word"), ("last", "family"))]
    known = evidence.where("nick = ''").select("kind", F.col("given").alias("token"), F.log1p("n").alias("weight"))
    votes = asked.withColumn("q", F.explode(F.array(*questions))).select(*form, "q.*").join(known, ["kind", "token"], "left")
    part = lambda at, *kinds: F.sum(F.when((F.col("at") == at) & F.col("kind").isin(*kinds), F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    score = [F.struct(F.round(part(at, "given", "family"), 9).alias("a"), F.first(sure).alias("b"), F.round(part(at, "first", "last"), 9).alias("c")) for at, sure in ((1, "sure"), (2, "other_sure"))]
    told = votes.groupBy(*form).agg((score[1] > score[0]).alias("swap"))
    told = rows.where("other_family IS NOT NULL").join(told, form).select(key, "inst", *(F.when(F.col("swap"), F.col(f"other_{c}")).otherwise(F.col(c)).alias(c) for c in kept[2:]))
    return rows.where("other_family IS NULL").select(*kept).unionByName(told)


def called(placed: DataFrame, evidence: DataFrame, house: list[str]) -> DataFrame:
    """(house, given, called): given names off the list go to the commonest of the house that they match.

    They match if they are one slip apart, or one is quoted as the nickname of the other. As with family names, two
    spellings both in wide use are two names.
    """
    names = cut(placed.where("given <> ''").groupBy(*house, "given").agg(F.sum("n").alias("n"), F.max("listed").alias("listed")))
    rare = names.where("NOT listed").join(names.groupBy("given").agg(F.count("*").alias("uses")), "given")
    size = F.char_length("given")
    less = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring("given", F.lit(1), i - 1), F.substring("given", i + 1, size)))
    cropped = rare.where(size > 3).withColumn("part", F.explode(F.array_distinct(F.concat(F.array("given"), less))))
    a, b = (cropped.select(*house, "part", F.col("given").alias(s), F.col("uses").alias(f"uses_{s}")) for s in "ab")
    near = a.join(b, [*house, "part"]).where(f"a < b AND least(uses_a, uses_b) < greatest({COMMON}, greatest(uses_a, uses_b) / {OFTEN})").select(*house, "a", "b").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([distance(x, y, 1) == 1 for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())], pa.bool_()))

    slips = near.mapInArrow(run, near.schema)
    quoted = evidence.where("kind = 'given' AND nick <> '' AND nick <> given").select(F.col("nick").alias("a"), F.col("given").alias("b"))
    nicks = rare.select(*house, F.col("given").alias("a")).join(quoted, "a").join(names.select(*house, F.col("given").alias("b")), [*house, "b"]).select(*house, "a", "b")
    edges = slips.unionByName(nicks)
    both = edges.unionByName(edges.select(*house, F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(names.select(*house, F.col("given").alias("a"), F.col("given").alias("b")))
    target = names.select(*house, F.col("given").alias("b"), F.struct("listed", "n", "given").alias("to"))
    best = cut(both.join(target, [*house, "b"]).groupBy(*house, "a").agg(F.max("to").alias("to")).select(*house, "a", F.col("to.given").alias("b")))
    step = best.select(*house, F.col("a").alias("given"), F.col("b").alias("a"))
    return step.join(best, [*house, "a"]).select(*house, "given", F.col("b").alias("called"))


def grams(size: int):
    """Padded q-grams of ``family`` as a set."""
    pad = F.concat(F.lit("^"), F.col("family"), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(pad) - (size - 1))), lambda i: F.substring(pad, i, F.lit(size))))


def prefixes(spellings: DataFrame, size: int) -> DataFrame:
    """spellings with the rarest grams of each family, one row per gram: one more than the slips it may have can take.
    Rarity is counted over all spellings."""
    lost = F.when(F.char_length("family") >= LONG, 2 * (size + 1)).otherwise(size + 1)
    families = spellings.select("family").distinct().withColumn("gram", F.explode(grams(size)))
    rarity = families.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = families.join(rarity, "gram").groupBy("family").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "gram"))), F.lit(1), lost + 1).alias("g"))
    return spellings.join(ranked, "family").withColumn("gram", F.explode("g.gram")).drop("g")


def distances(pairs: DataFrame) -> DataFrame:
    """(family_a, family_b, d) of the distinct pairs of family names that are within the slips they may have."""
    # two letters turned are two edits here; the bound spares Python most candidates
    edits = F.levenshtein("family_a", "family_b", 4)
    allowed = F.when(F.least(F.char_length("family_a"), F.char_length("family_b")) >= LONG, 4).otherwise(2)
    some = pairs.where((edits >= 0) & (edits <= allowed)).select("family_a", "family_b").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ds = [], []
            for i, (a, b) in enumerate(zip(batch.column("family_a").to_pylist(), batch.column("family_b").to_pylist())):
                shorter = min(len(a), len(b))
                most = 2 if shorter >= LONG else 1
                d = distance(a, b, most)
                if d <= most and (not d or shorter >= 4):
                    at.append(i)
                    ds.append(d)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in ("family_a", "family_b")), pa.array(ds, pa.int32())], names=["family_a", "family_b", "d"])

    return some.mapInArrow(run, "family_a string, family_b string, d int")


def verified(pairs: DataFrame, total: int) -> DataFrame:
    """(inst_a, family_a, inst_b, family_b) of the pairs, with their distance ``d``, that are similar enough.

    A token weighs ln(1 + total / uses); a family name that of its commoner spelling. ``agreed`` is the weight of
    institution and initial, which agree. Family names agree to the share 1 - edits / length, and the share they
    disagree in counts with the weight of a token used once, however common the name. Two spellings both in wide use
    are two names.
    """
    more, less = F.greatest("uses_a", "uses_b"), F.least("uses_a", "uses_b")
    two = (F.col("d") > 0) & (less >= F.greatest(F.lit(float(COMMON)), more / OFTEN))
    share = 1 - F.col("d") / F.greatest(F.char_length("family_a"), F.char_length("family_b"))
    for_it, against = F.log1p(F.lit(total) / more) * share + F.col("agreed"), F.lit(log1p(total)) * (1 - share)
    return pairs.where(~two & (for_it >= SIMILAR * (for_it + against))).select("inst_a", "family_a", "inst_b", "family_b").distinct()


def persons(bylines: DataFrame, key: str = "byline_id", name: str = "author_name", affiliation: str = "affiliation") -> DataFrame:
    """(key, person): rows with the same ``person`` name one person."""
    base = bylines.select(F.col(key).alias("key"), F.col(name).alias("name"), F.col(affiliation).alias("affiliation")).where("key IS NOT NULL AND trim(name) <> ''")
    base = spread(base, "key")
    vocabulary, evidence = learn(base.select("name"))
    evidence = cut(evidence)
    rows = cut(turned(cut(parsed(base, vocabulary, "key")), evidence, "key"))
    starts = F.create_map(*[F.lit(x) for g, s in sorted(vocabulary.starts.items()) for x in (g, "".join(sorted(s | {g[:1]})))]) if vocabulary.starts else None
    letters = F.when(F.col("given") == "", F.substring("initials", 1, 1)).otherwise(F.coalesce(starts[F.col("given")], F.substring("given", 1, 1)) if starts is not None else F.substring("given", 1, 1))
    forms = rows.groupBy("inst", "family", "given", "initials").agg(F.count("*").alias("n")).withColumn("letters", letters).withColumn("listed", F.col("given").isin(sorted(vocabulary.given)) if vocabulary.given else F.lit(False))
    more = evidence.where("kind = 'given' AND nick <> ''").groupBy("given").agg(F.array_join(F.array_sort(F.collect_set(F.substring("nick", 1, 1))), "").alias("more"))
    forms = cut(forms.join(more, "given", "left").withColumn("letters", F.when(F.col("listed") | F.col("more").isNull(), F.col("letters")).otherwise(F.concat("letters", "more"))).drop("more"))

    # spellings of family names by institution
    spelled = cut(forms.groupBy("inst", "family").agg(F.sum("n").alias("n")))
    uses = spelled.groupBy("family").agg(F.count("*").alias("uses"))
    total = spelled.count()
    weight = lambda uses: F.log1p(F.lit(total) / uses)
    # rarity of an institution: by the names there; where it is unknown, that of all names on average
    homes = spelled.groupBy("inst").agg(weight(F.count("*")).alias("w"))
    usual = log1p(spelled.select("inst").distinct().count())
    homes = homes.select("inst", F.when(F.col("inst") == "", usual).otherwise(F.col("w")).alias("home"))
    spelled = cut(spelled.join(uses, "family").join(homes, "inst"))
    starting = cut(forms.select("inst", "family", F.explode(F.split("letters", "")).alias("letter")).where("letter <> ''").distinct())
    initial = starting.groupBy("letter").agg(weight(F.count("*")).alias("first"))
    keyed = prefixes(starting.where("inst <> ''").join(spelled, ["inst", "family"]).join(initial, "letter"), GRAM)
    keyed = written(keyed.select("inst", "letter", "gram", "family", "uses", (F.col("home") + F.col("first")).alias("agreed")))
    near = pairs_within(keyed, ["inst", "letter", "gram"], "family", BLOCK)
    near = near.select(F.col("inst").alias("inst_a"), F.col("inst").alias("inst_b"), F.col("family_x").alias("family_a"), F.col("family_y").alias("family_b"), F.col("uses_x").alias("uses_a"), F.col("uses_y").alias("uses_b"), F.col("agreed_x").alias("agreed"))
    near = written(near)
    near = near.join(distances(near), ["family_a", "family_b"])
    # without an affiliation: against all family names, a gram's names in blocks; where they are used comes afterwards
    families = spelled.groupBy("family").agg(F.max("uses").alias("uses"), F.max(F.col("inst") == "").alias("open"))
    wide = written(prefixes(families, WIDE_GRAM).select("gram", "family", "open"))
    blocks = wide.groupBy("gram").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"), F.count_if("open").alias("o")).where("o > 0").select("gram", "k")
    placed = wide.join(blocks, "gram")
    u = placed.where("open").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("gram", "blk", F.col("family").alias("family_a"))
    v = placed.withColumn("blk", F.pmod(F.xxhash64("family"), "k").cast("int")).select("gram", "blk", F.col("family").alias("family_b"))
    alike = distances(u.join(v, ["gram", "blk"]))
    there = spelled.select(F.col("family").alias("family_b"), F.col("inst").alias("inst_b"), F.col("uses").alias("uses_b"), F.greatest(F.col("home"), F.lit(usual)).alias("agreed"))
    apart = alike.join(families.select(F.col("family").alias("family_a"), F.col("uses").alias("uses_a")), "family_a").join(there, "family_b").where("inst_b <> '' OR family_a <> family_b").withColumn("inst_a", F.lit(""))
    edges = verified(near.unionByName(apart.select(*near.columns)), total)

    # every spelling goes to the commonest it matches, twice, since a slip of a slip matches only the first
    both = edges.unionByName(edges.select(F.col("inst_b").alias("inst_a"), F.col("family_b").alias("family_a"), F.col("inst_a").alias("inst_b"), F.col("family_a").alias("family_b")))
    target = spelled.select(F.col("inst").alias("inst_b"), F.col("family").alias("family_b"), F.struct((F.col("inst") != "").cast("int").alias("placed"), F.col("n"), F.col("inst"), F.col("family")).alias("to"))
    self_edges = spelled.select(F.col("inst").alias("inst_a"), F.col("family").alias("family_a"), F.col("inst").alias("inst_b"), F.col("family").alias("family_b"))
    best = cut(both.select(*self_edges.columns).unionByName(self_edges).join(target, ["inst_b", "family_b"]).groupBy("inst_a", "family_a").agg(F.max("to").alias("to")))
    step = best.select(F.col("inst_a").alias("i1"), F.col("family_a").alias("f1"), F.col("to.inst").alias("inst_a"), F.col("to.family").alias("family_a"))
    home = step.join(best, ["inst_a", "family_a"]).select(F.col("i1").alias("inst"), F.col("f1").alias("family"), F.col("to.inst").alias("home_inst"), F.col("to.family").alias("home_family"))

    # given names make persons; initials go to the one person they fit
    placed = cut(forms.join(home, ["inst", "family"]))
    house = ["home_inst", "home_family"]
    placed = cut(placed.join(called(placed, evidence, house), [*house, "given"], "left"))
    people = placed.where("given <> ''").groupBy(*house, F.col("called").alias("given")).agg(F.sum("n").alias("n"), F.array_join(F.collect_set("letters"), "").alias("letters"), F.collect_set(F.substring("initials", 2, 1)).alias("middles"))
    bare = placed.where("given = ''").select(*house, "initials").distinct()
    match = bare.join(people, house).where(F.expr("initials = '' OR instr(letters, substring(initials, 1, 1)) > 0"))
    middle = F.substring("initials", 2, 1)
    fits = F.when(middle == "", 1).when(F.array_contains("middles", middle), 2).otherwise(0)
    ranked = match.withColumn("fits", fits).groupBy(*house, "initials").agg(F.max(F.struct("fits", "n", "given")).alias("top"), F.sort_array(F.collect_list("fits"), asc=False).alias("all"))
    chosen = ranked.where("size(all) = 1 OR all[0] > all[1]").select(*house, "initials", F.col("top.given").alias("meant"))
    whole = placed.join(chosen, [*house, "initials"], "left").withColumn("who", F.when(F.col("given") != "", F.col("called")).otherwise(F.coalesce("meant", F.concat(F.substring("initials", 1, 1), F.lit(".")))))
    person = F.sha2(F.concat_ws("\0", *house, "who"), 256)
    return rows.join(whole.select("inst", "family", "given", "initials", person.alias("person")), ["inst", "family", "given", "initials"]).select(F.col("key").alias(key), "person")


def agree(a: str, b: str) -> bool:
    """Whether two spellings share a word of at least three letters, up to two slips."""
    x, y = ([w for w in LETTERS.findall(fold(s)) if len(w) > 2] for s in (a, b))
    return any(distance(v, w, 2) <= min(2, len(v) // 3) for v in x for w in y)


def paper_authors(authors: DataFrame, papers: DataFrame, bylines: DataFrame) -> DataFrame:
    """(rec_id, pos, byline_id, person): authors of packed records and rows of bylines, linked together.

    ``authors`` has (rec_id, pos, item_value). A row of the result has either rec_id and pos, or byline_id. An author
    has the affiliation of the byline at the same place of the paper if the names there agree, else none.
    """
    at = bylines.where("pmid IS NOT NULL AND pos IS NOT NULL").groupBy("pmid", "pos").agg(F.min(F.struct(F.col("author_name").alias("said"), F.col("affiliation").alias("place"))).alias("by"))
    named = authors.select("rec_id", "pos", "item_value").join(papers.select("rec_id", "pmid"), "rec_id").join(at, ["pmid", "pos"], "left").select("rec_id", "pos", "item_value", "by.said", "by.place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, said, places = (batch.column(c).to_pylist() for c in ("item_value", "said", "place"))
            place = [p if p and a and b and agree(a, b) else None for a, b, p in zip(names, said, places)]
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), batch.column("pos"), batch.column("item_value"), pa.array(place, pa.string())], names=["rec_id", "pos", "name", "place"])

    placed = named.mapInArrow(run, "rec_id bigint, pos int, name string, place string")
    key = lambda r, p, b: F.struct(r.cast("bigint").alias("rec_id"), p.cast("int").alias("pos"), b.cast("bigint").alias("byline_id")).alias("row")
    none = F.lit(None)
    both = placed.select(key(F.col("rec_id"), F.col("pos"), none), "name", "place").unionByName(
        bylines.where("byline_id IS NOT NULL").select(key(none, none, F.col("byline_id")), F.col("author_name").alias("name"), F.col("affiliation").alias("place"))
    )
    return persons(both, "row", "name", "place").select("row.rec_id", "row.pos", "row.byline_id", "person")


def same_person(bylines: DataFrame, key: str = "byline_id") -> DataFrame:
    """(byline_a, byline_b) of rows that name one person."""
    rows = cut(persons(bylines, key))
    pairs = pairs_within(rows, ["person"], key, BLOCK)
    return pairs.select(F.least(f"{key}_x", f"{key}_y").alias("byline_a"), F.greatest(f"{key}_x", f"{key}_y").alias("byline_b"))
