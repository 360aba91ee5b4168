"""Applications at the same premises, by a gazetteer built from the addresses themselves.

1. Localities are learnt from addresses with separators and a named county: their
   names, the counties, and the locality each postal routing key stands for.
2. Every address is read into unit, number or house name, street and locality,
   whatever their order; where a reading is open (a type left out, cut or glued
   on, several runs of words) all are kept: the beam, whose first is the likeliest.
3. The gazetteer: street spellings are clustered within each locality, a rare one joining the
   most frequent spelling one edit away. Each cluster is a street with an identifier; a
   spelling without a type stands for the only street of that name, if there is just one.
4. The beam is searched over the gazetteer's entries: every reading is led to the entry
   of its locality and spelling, to one an edit away where it has none, or, without a
   locality, to the only one so named; what it costs is weighed against how well the street is
   known, and the best reading gives the address its street identifier.
5. Addresses with the same street identifier, number or house, and unit are at one place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.bktree import BKTree
from fieldloom.llm.street_names import TYPE_OF, fold, near_type, read, unglued, unread
from fieldloom.runtime import MOST_SENT, materialise, unsent, within_rows

#: A phrase is a locality or county if so many telling addresses name it.
LEAST = 2
#: Localities, misspellings of others folded, that the executors hold (some 100 MB); of more, the rarest stand for themselves.
MOST_TOWNS = 1_000_000
#: Shortened forms of a spelling, about.
FORMS = 10
#: What a reading loses for each that is likelier, and for a spelling the gazetteer only has an edit away; a street gains the logarithm (base 2) of its addresses.
LESS_LIKELY = 2.0
EDITED = 3.0
#: A spelling joins another one edit away if it has at most RARE cases or the other TIMES as many.
RARE = 2
TIMES = 5

# Words for units, houses, openings and numbers.
UNIT = re.compile(r"\b(?:apartment|apt|flat|unit)\b[\s.|]*(\d+[a-z]?)\b")
LEAD = re.compile(r"(?:^|(?<=\|))\s*(?:(?:site|lands|premises|land|plot)(?:\s+at|\s*:|\s+to)?|at)\b\s*:?")
HOUSES = {"cottage": "cott", "house": "hse ho", "lodge": "ldg", "villa": "vlla", "farm": "fm", "depot": "dpt", "hall": "", "manor": "", "mill": "ml"}
HOUSE_OF = {a: h for h, abbrs in HOUSES.items() for a in [h, *abbrs.split()]}
NUMBERS = {w: str(i) for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), 1)}
KEY = re.compile(r"(?:^|(?<=[\s|]))([a-z]\d[\da-z]|[a-z]{2}\d)\s?([\da-z]{4})(?=$|[\s|])")
COUNTY = re.compile(r"^(?:co|county)\b\.?\s+(.+)$")


@dataclass
class Parts:
    key: str  # routing key, or ""
    unit: str
    segments: list[str]  # folded, without the above


def parts(address: str) -> Parts:
    s = re.sub(r"[,;\n|]+", "|", fold(address)).strip(" |.")
    s = LEAD.sub(" ", s)
    key = ""
    for m in [*KEY.finditer(s)]:
        # A postal code stands at either end, and its second half isn't a word of the address.
        if (m.start() <= 2 or m.end() >= len(s) - 1) and (m.group(2) not in TYPE_OF and m.group(2) not in HOUSE_OF):
            key = m.group(1)
            s = s[: m.start()] + "|" + s[m.end() :]
            break
    unit = ""
    if m := UNIT.search(s):
        unit = m.group(1)
        s = s[: m.start()] + "|" + s[m.end() :]
    segs = [re.sub(r"\s+", " ", x).strip(" .:-") for x in LEAD.sub(" ", s).split("|")]
    return Parts(key, unit, [x for x in segs if x])


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side counts of (kind, name, other): counties, localities beside a named county, localities of routing keys."""
    for b in batches:
        c: Counter = Counter()
        for a in b.address:
            p = parts(a)
            s = p.segments
            if len(s) < 3:
                continue
            for here, beside in ((s[-1], s[-2]), (s[0], s[1])):
                m = COUNTY.match(here)
                w = beside.split()
                if m and not any(x in TYPE_OF or x in HOUSE_OF or any(ch.isdigit() for ch in x) for x in w) and len(w) <= 3:
                    c["county", m.group(1), ""] += 1
                    c["town", beside, ""] += 1
                    if p.key:
                        c["key", p.key, beside] += 1
                    break
        yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "name", "other", "n"]).astype({"n": "int64"})


@dataclass
class Places:
    counties: set[str]
    towns: list[str]
    of_key: dict[str, str]


def learn(addresses: DataFrame) -> Places:
    """Counties, localities and what routing keys stand for. Misspellings are folded where the data lie; names proper come to the driver."""
    # Only addresses with two separators that name a county teach anything.
    telling = addresses.select("address").where(F.col("address").rlike(r"(?is)[,;\n].*[,;\n]") & F.col("address").rlike(r"(?i)\bco(unty)?\b"))
    got = telling.mapInPandas(_learn, "kind string, name string, other string, n long").groupBy("kind", "name", "other").agg(F.sum("n").alias("n"))
    got = materialise(got, "places")
    spelt = got.where("kind = 'town'").select(F.lit("").alias("all"), "name", "n")
    roots = materialise(clusters(spelt, ["all"], "name"), "towns")
    known = roots.where("name = root").join(spelt.select("name", "n"), "name").where(F.col("root_n") >= LEAST)
    counts = {r["name"]: r["n"] for r in known.orderBy(F.desc("root_n"), "name").limit(MOST_TOWNS).select("name", "n").toArrow().to_pylist()}
    tree, towns = BKTree(list(counts)), []
    names = sorted(counts, key=lambda t: (-counts[t], t))
    near = tree.search(names, np.array([_slack(t) for t in names], int))
    for t, hits in zip(names, near):
        # A spelling that a far more frequent one lies next to is a misspelling of it.
        if not any(o != t and counts[o] >= TIMES * counts[t] for _, o in hits):
            towns.append(t)
    counties = got.where((F.col("kind") == "county") & (F.col("n") >= LEAST)).select("name").toArrow().column("name").to_pylist()
    places = Places(set(counties), towns, {})
    # There are some 16,000 routing keys at most, by their form.
    keys = got.where((F.col("kind") == "key") & (F.col("n") >= LEAST)).withColumnRenamed("name", "key").join(roots.select(F.col("name").alias("other"), "root"), "other")
    keys = keys.groupBy("key", "root").agg(F.sum("n").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("town"), F.max("n").alias("n"), F.sum("n").alias("all"))
    namer = TownNamer(places)
    for r in keys.where(F.col("n") >= 0.7 * F.col("all")).select("key", "town").toArrow().to_pylist():
        if t := namer.exact_or_near(r["town"]):
            places.of_key[r["key"]] = t
    return places


def _slack(t: str) -> int:
    return 0 if len(t) < 4 else 1 if len(t) < 7 else 2


def _shortened(t: str) -> list[str]:
    """A name, and it without each of its letters: names one edit or one swap apart have one of these in common."""
    return [t, *(t[:i] + t[i + 1 :] for i in range(len(t)))] if len(t) >= 4 else [t]


class TownNamer:
    """Localities by their names as written, with what was found before remembered."""

    def __init__(self, places: Places):
        self.towns = set(places.towns)
        self.short: dict[str, set[str]] = {}
        for t in places.towns:
            for v in _shortened(t):
                self.short.setdefault(v, set()).add(t)
        self.known: dict[str, str | None] = {}

    def exact_or_near(self, phrase: str) -> str | None:
        if phrase in self.towns:
            return phrase
        if phrase not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            hits = {t for v in _shortened(phrase) for t in self.short.get(v, ())}
            self.known[phrase] = hits.pop() if len(hits) == 1 else None
        return self.known[phrase]


def _is_county(s: str, counties: set[str]) -> bool:
    m = COUNTY.match(s)
    return s in counties or bool(m and (m.group(1) in counties or len(m.group(1).split()) <= 2))


def locate(p: Parts, places: Places, namer: TownNamer) -> tuple[str, list[str]]:
    """(locality or "", what remains of the segments)."""
    segs = list(p.segments)
    # Counties: whole segments, else the words at an end of one.
    if len(segs) > 1:
        segs = [s for s in segs if not _is_county(s, places.counties)] or segs
    out = []
    for s in segs:
        w = s.split()
        for k in (3, 2, 1):
            for end in (True, False):
                part = w[-k:] if end else w[:k]
                if len(w) > k and " ".join(part) in places.counties:
                    w = w[:-k] if end else w[k:]
                    if end and w and w[-1].strip(".") in ("co", "county"):
                        w = w[:-1]
                    break
            else:
                continue
            break
        else:
            for k in (2, 1):
                if len(w) > k + 1 and w[0].strip(".") in ("co", "county") and " ".join(w[1 : k + 1]) in places.counties:
                    w = w[k + 1 :]
        if w and w[0].strip(".") in ("co", "county") and len(w) > 1:
            w = w[1:]
        if w:
            out.append(" ".join(w))
    segs = out
    town = ""
    if len(segs) > 1:
        # Outer segments first: the locality stands last, or first where the order is turned round.
        for k in [len(segs) - 1, 0, *range(1, len(segs) - 1)]:
            s = segs[k]
            if not any(c.isdigit() for c in s) and not any(x in HOUSE_OF or (x.strip(".") in TYPE_OF and len(s.split()) > 1) for x in s.split()) and (t := namer.exact_or_near(s)):
                return t, segs[:k] + segs[k + 1 :]
    for k in [len(segs) - 1, *range(len(segs) - 1)]:
        w = segs[k].split()
        for size in (2, 1):
            for at in (len(w) - size, 0, *range(1, len(w) - size)):
                if at < 0 or len(w) <= size:
                    continue
                phrase = " ".join(w[at : at + size]).strip(".")
                if phrase in namer.towns:
                    return phrase, segs[:k] + [x for x in (" ".join(w[:at]), " ".join(w[at + size :])) if x] + segs[k + 1 :]
    for k in [len(segs) - 1, *range(len(segs) - 1)]:
        w = segs[k].split()
        for at in (len(w) - 1, 0):
            word = w[at].strip(".")
            if len(w) > 2 and len(word) > 3 and word not in TYPE_OF and word not in HOUSE_OF and not any(c.isdigit() for c in word) and (t := namer.exact_or_near(word)):
                return t, segs[:k] + [" ".join(w[:at] + w[at + 1 :])] + segs[k + 1 :]
    town = places.of_key.get(p.key, "")
    if not town and len(segs) > 1 and not any(c.isdigit() for c in segs[-1]) and not any(near_type(x.strip(".")) or x in HOUSE_OF for x in segs[-1].split()):
        # A name not learnt stands for itself.
        return segs[-1], segs[:-1]
    return town, segs


def premises(segs: list[str]) -> tuple[str, str, str, list[str]]:
    """(number, house name, house type, words of the street)."""
    w: list[str] = []
    for s in segs:
        w += [*re.findall(r"#|[^\W_]+", s), "|"]
    number = house = kind = ""
    if w and w[0] in ("#", "no", "number") and len(w) > 1:
        w = w[1:]
    k = next((i for i, x in enumerate(w) if re.fullmatch(r"\d+[a-z]?", x)), None)
    if k is None and w and w[0] in NUMBERS and len(w) > 2:
        number, w = NUMBERS[w[0]], w[1:]
    elif k is not None:
        number = w[k].lstrip("0") or "0"
        w = w[: k - 1 if k and w[k - 1] in ("#", "no", "number") else k] + ["|"] + w[k + 1 :]
    if not number:
        h = next((i for i, x in enumerate(w) if x in HOUSE_OF), None)
        if h is None:
            h = next((i for i, x in enumerate(w) if len(x) >= 4 and any(_close(x, y) for y in HOUSES) and x not in TYPE_OF), None)
        if h is not None and h > 0:
            kind = HOUSE_OF.get(w[h]) or next(y for y in HOUSES if _close(w[h], y))
            # Its name is what lies before it, back to a separator or the street's type.
            s = h
            while s > 0 and w[s - 1] != "|" and not (w[s - 1] in TYPE_OF and s - 1 > 0) and h - s < 3:
                s -= 1
            if s < h:
                if s > 0 and w[s - 1] != "|" and h - s > 1:
                    # "... Road Upper Such House": qualifiers behind a type belong to the street.
                    while h - s > 1 and w[s] in ("upper", "lower", "north", "south", "upr", "lwr", "nth", "sth", "n", "s"):
                        s += 1
                house = "".join(unread(x) for x in w[s:h])
                w = w[:s] + ["|"] + w[h + 1 :]
    out: list[str] = []
    for x in w:
        if x != "|" or (out and out[-1] != "|"):
            out.append(x)
    while out and out[-1] == "|":
        out.pop()
    return number, house, kind, out


def _close(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1 or a[0] != b[0]:
        return a == b
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


def beam(words: list[str]) -> list[tuple[str, str, str]]:
    """All readings of a street as (name proper, type, saint/qualifiers), likeliest first."""
    runs = [r.split() for r in " ".join(words).split("|")]
    runs = sorted((r for r in runs if r), key=lambda r: (not any(x in TYPE_OF for x in r[1:]), -len(r)))
    out: list[tuple[str, str, str]] = []
    for r in runs:
        p = read([unread(x) for x in r if x not in ("no", "#")])
        if not p or len(p.base) < 3:
            continue
        for q in [p, *unglued(p)]:
            for t in sorted(q.types) or [""]:
                out.append((q.base, t, f"{'saint' * q.saint}/{' '.join(sorted(q.qualifiers))}"))
    return list(dict.fromkeys(out))


_READ = "app_id string, town string, unit string, number string, house string, house_kind string, rank int, base string, kind string, rest string"


def readings(addresses: DataFrame, places: Places) -> DataFrame:
    """A row for each reading of each address that names a number or a house."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        namer = TownNamer(places)
        for b in batches:
            out, done, read_as = [], {}, {}
            for app, a in zip(b.app_id, b.address):
                if a not in done:
                    p = parts(a)
                    town, segs = locate(p, places, namer)
                    number, house, kind, words = premises(segs)
                    if not number and not house:
                        done[a] = []
                        continue
                    street = " ".join(words)
                    if street not in read_as:
                        read_as[street] = beam(words)
                    done[a] = [(town, p.unit, number, house, kind, k, *reading) for k, reading in enumerate(read_as[street])]
                out += [(app, *r) for r in done[a]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _READ.split(", ")]).astype({"rank": "int32"})

    return addresses.mapInPandas(run, _READ)


def _short_forms(word: str):
    """A spelling and it without each of its letters, as a column; spellings one edit or swap apart have one in common."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(F.col(word), F.lit(1), i - 1), F.substring(F.col(word), i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) >= 4, without).otherwise(F.array().cast("array<string>"))))


def clusters(spellings: DataFrame, group: list[str], word: str) -> DataFrame:
    """(*group, word, root, root_n): each spelling with the one its cluster is named by.

    `spellings` has (*group, word, n), distinct. Spellings that agree when at most one letter
    of each is left out are neighbours; they meet under these shortened forms, so
    no group is ever gathered in one task.
    """
    s = materialise(spellings.select(*group, word, "n"), "spellings")
    rows = s.count()
    posts = s.withColumn("short", F.explode(_short_forms(word)))
    other = posts.select(*group, "short", F.col(word).alias("to"), F.col("n").alias("to_n"))
    better = (F.col("to_n") > F.col("n")) | ((F.col("to_n") == F.col("n")) & (F.col("to") < F.col(word)))
    joins = (F.col("n") <= RARE) | (F.col("to_n") >= TIMES * F.col("n"))
    up = posts.join(unsent(other, rows * FORMS > MOST_SENT), [*group, "short"]).where((F.col("to") != F.col(word)) & better & joins)
    up = up.groupBy(*group, word).agg(F.max_by("to", F.struct("to_n", F.length("to"), "to")).alias("up"))
    link = materialise(s.join(unsent(up, rows > MOST_SENT), [*group, word], "left").select(*group, word, "n", F.coalesce("up", F.col(word)).alias("root")), "links")
    # Each round doubles what is followed; a link always leads to a better spelling, so there is no circle.
    while True:
        step = link.select(*group, F.col(word).alias("root"), F.col("root").alias("next"))
        moved = materialise(link.join(unsent(step, rows > MOST_SENT), [*group, "root"]).select(*group, word, "n", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "links")
        link = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    size = link.groupBy(*group, "root").agg(F.sum("n").alias("root_n"))
    return link.join(unsent(size, rows > MOST_SENT), [*group, "root"]).select(*group, word, "root", "root_n")


_STREET = ["town", "kind", "rest"]


def gazetteer(readings_: DataFrame) -> DataFrame:
    """(town, kind, rest, base, street_id, street, n): every spelling met as a likeliest reading, with its street, written once.

    kind is the street's type, rest its saint and qualifiers, n the addresses on the street.
    """
    spelt = readings_.where("rank = 0 AND town <> ''").groupBy(*_STREET, "base").agg(F.count("*").alias("n"))
    g = clusters(spelt, _STREET, "base").withColumn("street_id", F.xxhash64(*_STREET, "root"))
    g = materialise(g.select(*_STREET, "base", "street_id", "root", F.concat_ws(" ", "root", "kind", "rest").alias("street"), F.col("root_n").alias("n")), "clusters")
    # A spelling without a type: the only street of that name with one, if there is just one.
    typed = g.where("kind <> ''").groupBy("town", "rest", F.col("base").alias("root")).agg(F.min("street_id").alias("t_id"), F.max("street_id").alias("t_other"), F.min("street").alias("t_street"), F.max("n").alias("t_n")).where("t_id = t_other")
    bare = g.where("kind = ''").join(unsent(typed, not within_rows(g, MOST_SENT)), ["town", "rest", "root"], "left")
    bare = bare.select(*_STREET, "base", F.coalesce("t_id", "street_id").alias("street_id"), F.coalesce("t_street", "street").alias("street"), F.coalesce("t_n", "n").alias("n"))
    return materialise(g.where("kind <> ''").select(bare.columns).unionByName(bare), "gazetteer")


def searched(readings_: DataFrame, gaz: DataFrame) -> DataFrame:
    """(app_id, unit, number, house, house_kind, town, street_id, street): the best reading of each address over the gazetteer's entries."""
    here = readings_.where("town <> ''")
    entry = ["street_id", "street", "n"]
    entries = gaz.count()
    many = entries > MOST_SENT
    exact = here.join(unsent(gaz, many), [*_STREET, "base"]).withColumn("cost", F.lit(0.0))
    # Less likely readings may be spelt in ways the gazetteer doesn't have: entries an edit away, the best known of several.
    asked = here.where("rank > 0").select(*_STREET, "base").distinct().join(unsent(gaz, many), [*_STREET, "base"], "left_anti")
    posts = asked.withColumn("short", F.explode(_short_forms("base")))
    forms = gaz.select(*_STREET, F.explode(_short_forms("base")).alias("short"), *entry)
    near = posts.join(unsent(forms, entries * FORMS > MOST_SENT), [*_STREET, "short"])
    near = near.groupBy(*_STREET, "base").agg(F.max(F.struct("n", "street_id", "street")).alias("e")).select(*_STREET, "base", "e.street_id", "e.street", "e.n")
    edited = here.where("rank > 0").join(unsent(near, many), [*_STREET, "base"]).withColumn("cost", F.lit(EDITED))
    # Without a locality: the one that has a street so named, if there is only one.
    only = gaz.groupBy("kind", "rest", "base").agg(F.min("town").alias("t"), F.max("town").alias("u"), *(F.min_by(c, F.struct("town", "street_id")).alias(c) for c in entry)).where("t = u").drop("u")
    lost = readings_.where("town = ''").join(unsent(only, many), ["kind", "rest", "base"]).withColumn("town", F.col("t")).withColumn("cost", F.lit(0.0))
    both = exact.unionByName(edited.select(exact.columns)).unionByName(lost.select(exact.columns))
    score = F.log2(F.col("n").cast("double")) - LESS_LIKELY * F.col("rank") - F.col("cost")
    best = both.groupBy("app_id", "unit", "number", "house", "house_kind").agg(F.max_by(F.struct("town", "street_id", "street"), F.struct(score, -F.col("rank"), "town", "street_id")).alias("b"))
    return best.select("app_id", "unit", "number", "house", "house_kind", "b.town", "b.street_id", "b.street")


def resolved(developments: DataFrame) -> DataFrame:
    """(app_id, place_id, town, street_id, street, number, house, unit): each address that denotes a single place, written once."""
    a = developments.select(F.col("app_id").cast("string").alias("app_id"), "address").where("app_id IS NOT NULL AND trim(address) <> ''").distinct()
    places = learn(a)
    r = materialise(readings(a, places), "readings")
    best = materialise(searched(r, gazetteer(r)), "searched")
    named = best.where("number = ''")
    group = ["street_id", "house_kind"]
    houses = clusters(named.groupBy(*group, "house").agg(F.count("*").alias("n")), group, "house").select(*group, "house", F.col("root").alias("house_root"))
    out = best.where("number <> ''").withColumn("house_root", F.lit("")).unionByName(named.join(unsent(houses, not within_rows(best, MOST_SENT)), [*group, "house"]).select(*best.columns, "house_root"))
    place = F.xxhash64("street_id", "number", "house_root", F.when(F.col("number") == "", F.col("house_kind")).otherwise(""), "unit")
    return materialise(out.select("app_id", place.alias("place_id"), "town", "street_id", "street", "number", F.col("house_root").alias("house"), "unit").distinct(), "resolved")


def pairs(developments: DataFrame) -> DataFrame:
    """(app_id_a, app_id_b): pairs of applications at the same premises, smaller id first.

    Null, blank and placeless addresses pair with nothing; an application delivered
    again, or with two addresses, counts once for each place.
    """
    placed = resolved(developments)
    x = placed.select("app_id", "place_id").distinct()
    y = unsent(x.select(F.col("app_id").alias("app_id_b"), "place_id"), not within_rows(placed, MOST_SENT))
    return x.withColumnRenamed("app_id", "app_id_a").join(y, "place_id").where("app_id_a < app_id_b").select("app_id_a", "app_id_b").distinct()
