"""Column functions that normalise codes, lists, names, times and URLs."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English day names to ISO numbers (fixed values).
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
#: Token prefixes of course kinds (fixed values).
KINDS = (("EA", "eloadas"), ("GY", "gyakorlat"), ("LA", "labor"))


def segment(code: Column, n: int, separator: str = "-", parts: int = 3) -> Column:
    """Part ``n`` (from 0) of a code that splits into exactly ``parts``; null otherwise."""
    split = F.split(code, separator, parts)
    return F.when(F.size(split) == parts, F.get(split, F.lit(n)))


def squash(text: Column) -> Column:
    """Runs of white space (no-break spaces and the like included) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def list_cell(cell: Column, prefix: str = "") -> Column:
    """Entries of a cell separated by comma, semicolon or line end: trimmed, not empty, with the prefix."""
    entries = F.transform(F.split(cell, "[,;\n]"), lambda x: F.trim(x))
    return F.filter(entries, lambda x: (x != "") & x.startswith(prefix))


def week_list(cell: Column) -> Column:
    """Distinct week numbers, ascending; entries that are not digits alone are dropped."""
    digits = F.filter(F.transform(F.split(cell, ","), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]{1,9}$"))
    return F.array_sort(F.array_distinct(F.transform(digits, lambda x: x.cast("int"))))


def weekday(name: Column) -> Column:
    """ISO number of a day name, null for any other."""
    at = F.array_position(F.array(*map(F.lit, DAYS)), name)
    return F.when(at > 0, at.cast("int"))


def classify(code: Column, kinds=KINDS, default: str = "egyeb") -> Column:
    """Kind of the first token (by underscore or space) that starts with a kind's prefix."""
    tokens = F.split(F.upper(code), r"[_\s]+")
    first = F.get(F.filter(tokens, lambda t: t.rlike("^(" + "|".join(p for p, _ in kinds) + ")")), F.lit(0))
    out = F
    for prefix, kind in kinds:
        out = out.when(first.startswith(prefix), kind)
    return out.otherwise(default)


def minutes_of_day(text: Column) -> Column:
    """``HH:MM`` or ``HH:MM:SS`` as minutes; null if it is neither."""
    return F.when(text.rlike("^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"), F.split_part(text, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(text, F.lit(":"), F.lit(2)).try_cast("int"))


def door_number(text: Column, overrides: dict[str, str] | None = None) -> Column:
    """One spelling of a door number: ``F01`` (upper case alone); ``Audmax``; ``d.dd`` with a lower-case letter; null for anything else.

    ``overrides`` replaces spellings by others.
    """
    code = F.trim(text)
    plain = r"^([0-9])\.?([0-9]{2})\s*([a-zA-Z]?)$"
    one = (
        F.when(code.rlike("^F[0-9]{2}$"), code)
        .when(F.upper(code).startswith("AUDMAX"), F.lit("Audmax"))
        .when(code.rlike(plain), F.concat(F.regexp_extract(code, plain, 1), F.lit("."), F.regexp_extract(code, plain, 2), F.lower(F.regexp_extract(code, plain, 3))))
    )
    if not overrides:
        return one
    table = F.create_map(*(F.lit(x) for pair in overrides.items() for x in pair))
    return F.coalesce(table[one], one)


def code_names(code: Column) -> tuple[Column, Column]:
    """Short name and register name of a room code ``X.F.nn``, ``X.AUDMAX`` or ``X.d.dd``."""
    rest = F.regexp_replace(code, r"^[A-Z]+\.", "")
    short = F.when(rest.startswith("F."), F.concat(F.lit("F"), F.split_part(rest, F.lit("."), F.lit(2)))).when(rest == "AUDMAX", "Audmax").otherwise(rest)
    register = F.when(rest.startswith("F."), short).when(rest == "AUDMAX", "AUDMAX").otherwise(F.concat(F.lit("LABOR "), rest))
    return short, register


def unescape(text: Column) -> Column:
    """Named and numbered character references as their characters, each once; names that the standard does not know stay."""
    pattern = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
    names = F.create_map(*(F.lit(x) for name, code in sorted({**name2codepoint, "apos": 39}.items()) for x in (f"&{name};", chr(code))))

    def char(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def one(token: Column) -> Column:
        digits = F.regexp_extract(token, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        number = F.when(token.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(token.startswith("&#"), F.when(valid, char(number)).otherwise("\ufffd")).otherwise(F.coalesce(F.try_element_at(names, token), token))

    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)
    pieces = F.split(text, pattern, -1)
    whole = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.zip_with(found, F.slice(pieces, F.lit(2), F.size(pieces)), lambda c, x: F.concat(c, x)), ""))
    return F.when(text.contains("&"), whole).otherwise(text)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def query_parameter(url: Column, name: str) -> Column:
    """A parameter of the query string, null if it is absent or empty."""
    found = F.regexp_extract(url, r"[?&]" + name + r"=([^&#]*)", 1)
    return F.when(found != "", found)


def url_state(url: Column) -> tuple[Column, Column, Column, Column]:
    """Selected, from, to and via of the fragment of a link: ``#CODE`` or ``#from=A&to=B&via=lift``; what follows a ? in it is left out."""
    state = F.regexp_extract(F.split_part(F.regexp_extract(url, "#(.*)$", 1), F.lit("?"), F.lit(1)), r"^(.*)$", 1)
    parts = [F.regexp_extract(state, f"(?:^|&){name}=([^&]*)", 1) for name in ("from", "to", "via")]
    short = F.when(~state.contains("="), F.split_part(state, F.lit("&"), F.lit(1)))
    return tuple(F.when(x != "", x) for x in (short, *parts))


def icon(name: Column, rules: list[tuple[str, str]]) -> Column:
    """Icon of the first rule (expression, icon) that the name, in lower case, meets; null if none does."""
    low, out = F.lower(name), F
    for pattern, value in rules:
        out = out.when(low.rlike(pattern), value)
    return out.otherwise(None)
