"""Text as Column expressions: ids, street keys, labels, patterns, tables in HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations, qualifiers and types of street names in municipal records.
STREET_WORDS = {
    "RD": "ROAD", "AVE": "AVENUE", "AV": "AVENUE", "SQ": "SQUARE", "PL": "PLACE", "TCE": "TERRACE", "TER": "TERRACE", "UPR": "UPPER", "LR": "LOWER", "LWR": "LOWER",
    "NTH": "NORTH", "STH": "SOUTH", "PDE": "PARADE", "CRES": "CRESCENT", "GDNS": "GARDENS", "PK": "PARK", "LN": "LANE", "QY": "QUAY", "DR": "DRIVE", "CT": "COURT",
    "GRV": "GROVE", "BR": "BRIDGE", "STR": "STREET", "HSE": "HOUSE", "MT": "MOUNT",
}
QUALIFIERS = ["UPPER", "LOWER", "MIDDLE", "NORTH", "SOUTH", "EAST", "WEST", "LITTLE", "GREAT"]
STREET_TYPES = ["STREET", "ROAD", "AVENUE", "QUAY", "LANE", "PLACE", "SQUARE", "TERRACE", "PARADE", "CRESCENT", "GARDENS", "PARK", "DRIVE", "COURT", "GROVE", "WALK", "ROW"]


def initials_id(owner: Column, number: Column) -> Column:
    """Initials of an owner's words (letters only; "X" where there are none), a hyphen, and the trimmed number."""
    heads = F.array_join(F.transform(F.split(F.trim(owner), r"\s+"), lambda w: F.substring(w, 1, 1)), "")
    ini = F.upper(F.regexp_replace(heads, r"[^\p{L}]", ""))
    return F.concat_ws("-", F.coalesce(F.when(ini != "", ini), F.lit("X")), F.trim(number))


def epoch_date(ms: Column) -> Column:
    """Epoch milliseconds to an ISO date in the session's zone."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def tokens(name: Column) -> Column:
    """Upper-case words of Latin letters and figures; full stops part words, other signs fall out. Empty for null and blank."""
    t = F.replace(F.replace(F.upper(F.coalesce(name, F.lit(""))), F.lit("'"), F.lit("")), F.lit("."), F.lit(" "))
    return F.filter(F.split(F.regexp_replace(t, "[^A-Z0-9 ]", ""), " "), lambda w: w != "")


def street_tokens(name: Column) -> Column:
    """Words with abbreviations written out; ST and SAINT open a saint's name, and are a street elsewhere."""
    known = F.create_map(*(F.lit(v) for kv in STREET_WORDS.items() for v in kv))
    saint = lambda i: F.when(i == 0, F.lit("SAINT")).otherwise(F.lit("STREET"))
    return F.transform(tokens(name), lambda w, i: F.when(w.isin("ST", "SAINT"), saint(i)).otherwise(F.coalesce(F.try_element_at(known, w), w)))


def norm_street(name: Column) -> Column:
    return F.nullif(F.array_join(street_tokens(name), " "), F.lit(""))


def street_keys(name: Column) -> Column:
    """Four keys, each less strict than the one before: as written, its words sorted, those without qualifiers, and without the type at their end too.

    The last is empty where the name doesn't end in a type or is nothing else.
    """
    w = street_tokens(name)
    core = F.filter(w, lambda t: ~t.isin(QUALIFIERS))
    bare = F.when((F.size(core) > 1) & F.get(core, F.size(core) - 1).isin(STREET_TYPES), F.array_join(F.array_sort(F.slice(core, F.lit(1), F.greatest(F.size(core) - 1, F.lit(0)))), " "))
    return F.array(F.array_join(w, " "), F.array_join(F.array_sort(w), " "), F.array_join(F.array_sort(core), " "), F.coalesce(bare, F.lit("")))


def qualified(name: Column) -> Column:
    return F.arrays_overlap(street_tokens(name), F.array(*map(F.lit, QUALIFIERS)))


def label(names: Column) -> Column:
    """Distinct non-empty names in their order, joined by " / "; null if there are none."""
    return F.nullif(F.array_join(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != ""))), " / "), F.lit(""))


def leading_capitals(s: Column) -> Column:
    """The words before the first that has a small letter."""
    w = F.split(F.trim(s), r"\s+")
    first = F.coalesce(F.array_min(F.filter(F.transform(w, lambda t, i: F.when(t.rlike(r"\p{Ll}"), i)), lambda i: i.isNotNull())), F.size(w))
    return F.array_join(F.slice(w, F.lit(1), first), " ")


def any_match(s: Column, patterns: list[str]) -> Column:
    """Whether any pattern occurs, whatever the case, in any alphabet; null is the empty text."""
    t = F.coalesce(s, F.lit(""))
    out = F.lit(False)
    for p in patterns:
        out = out | t.rlike("(?iU)" + p)
    return out


def split_list(s: Column, sep: str = "[;,]") -> Column:
    """Trimmed distinct non-empty parts, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")))


def hash01(s: Column) -> Column:
    """The first 32 bits of MD5 as a number from 0 to 1."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("double") / 4294967295.0


def plain(s: Column) -> Column:
    """HTML to text: no tags, the common entities resolved, white space run together."""
    t = F.regexp_replace(s, r"<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_rows(html: Column) -> Column:
    """The first table's rows as arrays of cell texts; rows of empty cells are left out."""
    body = F.regexp_extract(html, r"(?is)<table[^>]*>(.*?)</table>", 1)
    rows = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), plain))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def html_records(html: Column) -> Column:
    """html_rows with the first row as names: array<map<string,string>>."""
    rows = html_rows(html)
    head = F.get(rows, F.lit(0))

    def one(r: Column) -> Column:
        n = F.least(F.size(head), F.size(r))
        return F.map_from_arrays(F.slice(head, F.lit(1), n), F.slice(r, F.lit(1), n))

    return F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), one)


def number(s: Column) -> Column:
    """A double, null for what is none."""
    return s.try_cast("double")


def whole(s: Column) -> Column:
    """An integer, 0 for what is none."""
    return F.coalesce(s.try_cast("int"), F.lit(0))


def edge_id(u: Column, v: Column, key: Column) -> Column:
    """One id for both directions: the smaller end, the larger (compared as what they are), and the key."""
    return F.concat_ws("-", F.least(u, v).cast("string"), F.greatest(u, v).cast("string"), key.cast("string"))


def tag_details(tags: Column, wanted: list[str]) -> Column:
    """Of a map of tags the wanted ones that aren't null; an empty map for null."""
    return F.coalesce(F.map_filter(tags, lambda k, v: k.isin(wanted) & v.isNotNull()), F.create_map().cast("map<string,string>"))


def evidence_note(kind: Column, asset: Column, details: Column) -> Column:
    """"kind:asset", and in parentheses the details as "key=value", if there are any, in the order of keys."""
    parts = F.transform(F.array_sort(F.map_entries(details)), lambda e: F.concat(e.key, F.lit("="), e.value))
    return F.concat(kind, F.lit(":"), asset, F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, ", "), F.lit(")"))).otherwise(F.lit("")))


def own_tags(tags: Column, taken: list[str]) -> Column:
    """A JSON object's tags as a map, without those that are columns already; an empty map where it can't be read."""
    m = F.from_json(F.coalesce(tags, F.lit("{}")), "map<string,string>")
    return F.coalesce(F.map_filter(m, lambda k, v: ~k.isin(taken or [""]) & v.isNotNull()), F.create_map().cast("map<string,string>"))
