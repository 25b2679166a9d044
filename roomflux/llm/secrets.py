"""Secrets: rules found through a trigram inverted index.

Each rule's expression is parsed, and a Boolean query over trigrams (lower case) is derived from it that every match must
meet: what a match holds in a row is gathered as a set of strings, and each run of them asks for one of its strings whole.
The index holds, for each text, those trigrams that some query names (the dictionary of the index), all found in one pass. A
query is answered from the index alone: postings are put together by text as bit sets, and the query is evaluated on them.
Only candidates are verified with the rule's pattern, once per distinct text; rules without a mandatory trigram scan every
text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomflux.llm.spans import KEY, likely, listed, text_key, with_matches
from roomflux.plans.lineage import materialize


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int  # characters of a match, or of the last group if there is one
    base: bool


#: Base rules come first, in the order that breaks ties.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", 6, True),
    Rule("access", r"AKIA[A-Z0-9]++", 20, True),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, False),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, False),
    Rule("forge", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+", 0, False),
    Rule("bearer", r"(?i:bearer)\x20++([A-Za-z0-9+/_.=-]{20,}+)", 20, False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", 0, False),
)
#: Strings that a run of an expression may stand for, at most; a run of more is taken as unknown.
STRINGS = 64
#: The query that every text meets. Other queries are ("all", queries), ("any", queries) or ("gram", trigram).
EVERY = ("all", ())


def trigrams(literal: str) -> tuple[str, ...]:
    return tuple(sorted({literal[k : k + 3] for k in range(len(literal) - 2)}))


def _all(parts) -> tuple:
    parts = tuple(dict.fromkeys(p for p in parts if p != EVERY))
    return parts[0] if len(parts) == 1 else ("all", parts)


def _any(parts) -> tuple:
    parts = tuple(dict.fromkeys(parts))
    return EVERY if EVERY in parts else parts[0] if len(parts) == 1 else ("any", parts)


def _holds(strings: frozenset) -> tuple:
    """The query of a text that holds one of the strings; those that hold another of them ask for nothing new."""
    least = [x for x in sorted(strings) if not any(y != x and len(y) >= 3 and y in x for y in strings)]
    return _any(_all(("gram", t) for t in trigrams(x)) for x in least)


def _of_class(items) -> frozenset | None:
    found = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            found.add(chr(value).lower())
        elif str(kind) == "RANGE" and value[1] - value[0] < STRINGS:
            found |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= STRINGS else None


def _of_node(kind: str, value) -> tuple[frozenset | None, tuple]:
    """The strings that a node stands for, if they are few and known, and the query that holds anyhow."""
    nothing = frozenset([""])
    if kind == "LITERAL":
        return frozenset([chr(value).lower()]), EVERY
    if kind == "IN":
        return _of_class(value), EVERY
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return nothing, EVERY
    if kind == "SUBPATTERN":
        return _of_run(value[3])
    if kind == "ATOMIC_GROUP":
        return _of_run(value)
    if kind == "BRANCH":
        parts = [_of_run(x) for x in value[1]]
        if all(x is not None for x, _ in parts) and len(known := frozenset().union(*(x for x, _ in parts))) <= STRINGS:
            return known, EVERY
        return None, _any(q if x is None else _holds(x) for x, q in parts)
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = value
        known, query = _of_run(inner)
        if (low, int(high)) == (1, 1):
            return known, query
        if (low, int(high)) == (0, 1) and known is not None:
            return known | nothing, EVERY
        return None, EVERY if not low else query if known is None else _holds(known)
    return None, EVERY


def _of_run(nodes) -> tuple[frozenset | None, tuple]:
    """As ``_of_node``, of nodes one after another."""
    run, met, whole = frozenset([""]), [], True
    for kind, value in nodes:
        known, query = _of_node(str(kind), value)
        met.append(query)
        if known is not None and len(run) * len(known) <= STRINGS:
            run = frozenset(x + y for x in run for y in known)
            continue
        met.append(_holds(run))
        run, whole = known if known is not None else frozenset([""]), False
    if whole:
        return run, _all(met)
    return None, _all([*met, _holds(run)])


def trigram_query(pattern: str) -> tuple:
    """The query that every text with a match of ``pattern`` meets; lower and upper case are one."""
    known, query = _of_run(re._parser.parse(pattern))
    return query if known is None else _all([query, _holds(known)])


def grams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "gram" else set().union(*map(grams_of, query[1]))


def queries(rules: tuple[Rule, ...]) -> dict[str, tuple]:
    """kind: its query; rules that any text meets are left out."""
    found = {r.kind: trigram_query(r.pattern) for r in rules}
    return {k: q for k, q in found.items() if q != EVERY}


def _one_of(words: list[str]) -> str:
    """An expression of the words by their common starts, so that a place is left at the first letter that none has."""
    if words == [""]:
        return ""
    starts = sorted({x[0] for x in words})
    return "(?:" + "|".join(re.escape(c) + _one_of([x[1:] for x in words if x[0] == c]) for c in starts) + ")"


def build_index(texts: DataFrame, dictionary: list[str]) -> DataFrame:
    """Postings: key of the text, doc_id and ``gram``, the trigram's number in the dictionary, once for each row."""
    if not dictionary:
        return texts.select(*text_key(F.col("__text")), "doc_id", F.lit(0).alias("gram")).limit(0)
    found = F.array_distinct(F.regexp_extract_all(F.lower("__text"), F.lit(f"(?=({_one_of(dictionary)}))"), F.lit(1)))
    rows = texts.select(*text_key(F.col("__text")), "doc_id", F.explode(found).alias("gram"))
    return rows.withColumn("gram", F.array_position(F.array(*map(F.lit, dictionary)), F.col("gram")).cast("int") - 1)


def candidates(index: DataFrame, asked: dict[str, tuple], dictionary: list[str]) -> DataFrame:
    """Key of each text that some query may match, ``kinds``, those queries, and ``of``, the least doc_id that has the text. Postings are intersected by text as bit sets."""
    words = max(1, -(-len(dictionary) // 60))
    place = {t: (k // 60, k % 60) for k, t in enumerate(dictionary)}
    sets = [F.bit_or(F.when((F.col("gram") / 60).cast("int") == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") % 60)).otherwise(F.lit(0).cast("long"))).alias(f"s{w}") for w in range(words)]
    met = index.groupBy(*KEY).agg(F.min("doc_id").alias("of"), *sets)

    def holds(query: tuple) -> Column:
        if query[0] == "gram":
            w, bit = place[query[1]]
            return F.col(f"s{w}").bitwiseAND(F.lit(1 << bit)) != 0
        out = F.lit(query[0] == "all")
        for part in query[1]:
            out = out & holds(part) if query[0] == "all" else out | holds(part)
        return out

    kinds = [F.when(holds(query), F.lit(kind)) for kind, query in asked.items()] or [F.lit(None).cast("string")]
    return met.select(*KEY, "of", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def verify(texts: DataFrame, rule: Rule, when: Column) -> DataFrame:
    """Adds ``rule.kind``: the rule's spans in each text for which ``when`` holds."""
    rows = with_matches(texts.withColumn("__scan", F.when(when, F.col("__text")).otherwise("")), "__scan", rule.kind, rule.pattern)
    if not rule.least:
        return rows.drop("__scan")
    value = (lambda s: F.regexp_extract(s["value"], rule.pattern, 1)) if "(" in rule.pattern.replace("(?", "") else (lambda s: s["value"])
    return rows.withColumn(rule.kind, F.filter(rule.kind, lambda s: F.length(value(s)) >= rule.least)).drop("__scan")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _numbered(kind: str, nth: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, key, ``base`` and ``spans``: arrays of (kind, start, end) by start, then order of the rules.

    A null text is an empty one; rows of equal text have equal spans (each distinct text is indexed and verified once);
    repeated rows and null ids are kept; an empty table gives an empty one; columns besides doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    asked = queries(rules)
    dictionary = sorted(set().union(*map(grams_of, asked.values())))
    index = materialize(build_index(rows, dictionary), "postings")
    hits = materialize(candidates(index, asked, dictionary), "candidates")
    indexed = [r for r in rules if r.kind in asked]
    full = [r for r in rules if r.kind not in asked]
    by_key = rows.select("doc_id", *text_key(F.col("__text")), "__text")
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    # Rules without a trigram read every text where it lies; for the others one row of each candidate text meets its key.
    scanned = by_key
    for rule in full:
        scanned = verify(scanned, rule, F.lit(True))
    scanned = materialize(scanned.select("doc_id", *KEY, *(F.col(r.kind) for r in full)), "scanned")
    checked = likely(by_key, "k1", hits.select("k1")).where("likely").join(hits, KEY).where(F.col("doc_id").eqNullSafe(F.col("of"))).dropDuplicates(KEY)
    for rule in indexed:
        checked = verify(checked, rule, F.array_contains("kinds", rule.kind))
    checked = materialize(checked.select(*KEY, *(F.col(r.kind) for r in indexed)), "checked")
    out = scanned.join(checked, KEY, "left")
    order = {r.kind: k for k, r in enumerate(rules)}

    def spans(chosen: tuple[Rule, ...]) -> Column:
        every = F.concat(*(F.transform(F.coalesce(r.kind, none), _numbered(r.kind, order[r.kind])) for r in chosen))
        return F.transform(F.array_sort(every), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return out.select("doc_id", *KEY, spans(tuple(r for r in rules if r.base)).alias("base"), spans(rules).alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's columns of what ``find`` gives."""
    counts = [F.size(F.filter("base", _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
