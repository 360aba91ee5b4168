"""Reading freely written street names: name proper, type, qualifiers."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Street types and qualifiers with their usual abbreviations.
TYPES = {
    "road": "rd", "street": "st str", "avenue": "av ave avn", "park": "pk", "drive": "dr drv", "lane": "ln la", "grove": "gve grv",
    "close": "cl", "court": "ct crt", "crescent": "cr cres cresc", "place": "pl", "gardens": "gdns gds gdn garden", "terrace": "ter terr tce",
    "heights": "hts hgts", "square": "sq", "green": "grn", "view": "vw", "quay": "qy", "hill": "hl", "walk": "wlk", "parade": "pde prde", "mews": "mws",
}
QUALIFIERS = {"upper": "upr up", "lower": "lwr lr", "north": "nth n", "south": "sth s", "great": "gt grt", "little": "ltl lt"}
SAINT = {"saint", "st", "snt"}
#: Types that are no type of the list: what bears them is another street.
OTHER_TYPES = {"link", "bypass", "boreen", "roundabout", "bridge", "cottages", "way", "rise", "row", "alley"}
#: Notes beside a name; whatever follows one is no part of the name.
NOTES = {"opp", "opposite", "to", "from", "as", "rear", "footpath", "jn", "junction", "both", "near", "section", "part", "private", "at"}

TYPE_OF = {a: t for t, abbrs in TYPES.items() for a in [t, *abbrs.split()]}
QUALIFIER_OF = {a: q for q, abbrs in QUALIFIERS.items() for a in [q, *abbrs.split()]}


class Street(NamedTuple):
    base: str
    saint: bool
    types: frozenset  # empty: none given
    qualifiers: frozenset


def fold(s: str) -> str:
    """Lower case without accents and apostrophes; long s and other compatibility forms are resolved."""
    if s.isascii():
        return s.replace("'", "").replace("`", "").lower()
    if "Ã" in s or "Â" in s:  # UTF-8 read as Latin-1
        try:
            s = s.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    s = unicodedata.normalize("NFKD", s)
    return re.sub(r"['’‘`´ʼ]", "", "".join(c for c in s if not unicodedata.combining(c)).lower())


@lru_cache(maxsize=100_000)
def near_type(w: str) -> frozenset:
    """The types a misspelt or cut word may stand for."""
    if w in TYPE_OF:
        return frozenset({TYPE_OF[w]})
    cut = frozenset(t for t in TYPES if t.startswith(w))
    if cut:
        return cut
    if len(w) < 3:
        return frozenset()
    return frozenset(t for t in TYPES if _one_edit(w, t) or (len(t) >= 7 and _two_edits(w, t)))


def _one_edit(a: str, b: str) -> bool:
    """Whether one letter less, more, changed or swapped with its neighbour makes a of b."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


def _two_edits(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 2 or a[:1] != b[:1]:
        return False
    return any(_one_edit(a[:i] + a[i + 1 :], b) for i in range(len(a))) or any(_one_edit(a, b[:i] + b[i + 1 :]) for i in range(len(b)))


def unread(w: str) -> str:
    """A word with digits misread for letters put right."""
    if w.isdigit() or not any(c.isdigit() for c in w):
        return w
    return w.translate(str.maketrans("01589", "olsbg"))


_NUMBER = re.compile(r"\(?\b[lrn][\s-]?\d{2,5}\b\)?")
_PAREN = re.compile(r"\(([^()]*)\)?")


def _paren(m: re.Match) -> str:
    w = re.findall(r"\w+", m.group(1))
    return f" {m.group(1)} " if w and all(x in QUALIFIER_OF or x in TYPE_OF for x in w) else " | "


def tokens_of(name: str) -> list[str]:
    """Folded words; '|' stands where a note in parentheses was."""
    s = _NUMBER.sub(" ", fold(name))
    s = _PAREN.sub(_paren, s)
    return [unread(w) for w in re.findall(r"[^\W_]+|[|/]", s)]


def parse(name: str) -> Street | None:
    """The parts of a name, in whatever order they are written; None if nothing is left of it."""
    return read(tokens_of(name))


def unglued(p: Street) -> list[Street]:
    """Readings of a name without a type whose last letters are one written without its blank."""
    if p.types:
        return []
    cuts = ((p.base[:k], near_type(p.base[k:])) for k in range(4, len(p.base) - 1))
    return [Street(b, p.saint, t, p.qualifiers) for b, t in cuts if t]


def read(w: list[str]) -> Street | None:
    while w and w[0] in "|/":
        w = w[1:]
    if not w:
        return None
    quals: set[str] = set()
    types: frozenset = frozenset()
    saint = False
    # Qualifiers and "Saint" before the name.
    k = 0
    while k < len(w) - 1 and w[k] in QUALIFIER_OF and (len(w[k]) > 1 or len(w) - k > 2):
        quals.add(QUALIFIER_OF[w[k]])
        k += 1
    if k < len(w) - 1 and w[k] in SAINT and not (k + 1 < len(w) and w[k + 1] in "|/"):
        # "St" opens a saint's name, unless the name comes after its type: "Street, Such".
        saint = w[k] != "st" or any(near_type(x) for x in w[k + 1 :]) or len(w) - k > 2
        k += 1
        if not saint:
            types = frozenset({"street"})
    elif k < len(w) - 1 and w[k] in TYPE_OF:
        types = frozenset({TYPE_OF[w[k]]})
        k += 1
        while k < len(w) - 1 and w[k] in QUALIFIER_OF:
            quals.add(QUALIFIER_OF[w[k]])
            k += 1
        if k < len(w) - 1 and w[k] in SAINT:
            saint = True
            k += 1
    base: list[str] = []
    rest = w[k:]
    j = 0
    while j < len(rest):
        x = rest[j]
        if x in "|/" or (base and x in NOTES):
            break
        if base and not types and x in TYPE_OF:
            types = frozenset({TYPE_OF[x]})
        elif base and x in QUALIFIER_OF and (types or len(x) > 1):
            quals.add(QUALIFIER_OF[x])
        elif base and types and j == len(rest) - 1 and any(q.startswith(x) for q in QUALIFIERS):
            quals.update(q for q in QUALIFIERS if q.startswith(x))
        elif base and types:
            break
        elif base and x in OTHER_TYPES:
            return Street("".join(base), saint, frozenset({x}), frozenset(quals))
        elif base and (near := near_type(x)) and not any(y in TYPE_OF for y in rest[j + 1 : j + 2]):
            types = near
        else:
            base.append(x)
        j += 1
    return Street("".join(base), saint, types, frozenset(quals)) if base else None
