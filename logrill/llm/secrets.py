"""Secret scans through a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived:
an OR of ANDs of trigrams that every match must contain. The index holds, for
each trigram that some rule asks for, the documents whose lower-case text has
it, as one row per posting; the postings of a document meet in one small group,
where each rule's query is decided. Only these candidates are verified with the rule's expression. A rule without a mandatory
trigram scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An OR of ANDs of trigrams; None: nothing is mandatory.
Query = frozenset[frozenset[str]] | None
MOST = 64  # strings or alternatives that are followed up; beyond, the part counts as unknown


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression, the group that must be long enough, and that length."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    found = frozenset(x | y for x in a for y in b)
    return found if len(found) <= MOST else min(a, b, key=len)


def _of_strings(strings: frozenset[str]) -> Query:
    """What a text must have that contains one of the strings."""
    parts = frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)
    return None if any(not p for p in parts) else parts


def _sequence(items) -> tuple[frozenset[str] | None, Query]:
    """(all strings the items can match, if few; the query) of a parsed expression."""
    exact, query, whole = frozenset([""]), None, True
    for kind, value in items:
        strings, inner = _node(kind, value)
        if strings is not None and len(exact) * len(strings) <= MOST:
            exact = frozenset(a + b for a, b in product(exact, strings))
            continue
        query = _both(query, _both(_of_strings(exact), inner if strings is None else _of_strings(strings)))
        exact, whole = frozenset([""]), False
    if whole:
        return exact, None
    return None, _both(query, _of_strings(exact))


def _node(kind, value) -> tuple[frozenset[str] | None, Query]:
    if kind is op.LITERAL:
        return frozenset([chr(value).lower()]), None
    if kind is op.IN:
        letters = set()
        for what, x in value:
            if what is op.LITERAL:
                letters.add(chr(x).lower())
            elif what is op.RANGE and x[1] - x[0] < 8:
                letters |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (frozenset(letters), None) if len(letters) <= 8 else (None, None)
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST:
            return frozenset().union(*(s for s, _ in parts)), None
        queries = [q if s is None else _of_strings(s) for s, q in parts]
        return None, None if None in queries else frozenset().union(*queries)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, None
        if low == 0:
            return None, None
        if strings is not None and len(strings) ** min(low, 4) <= MOST:
            return None, _of_strings(frozenset("".join(x) for x in product(strings, repeat=min(low, 4))))
        return None, query
    if kind is op.AT:
        return frozenset([""]), None
    return None, None


def trigram_query(regex: str) -> Query:
    """The Boolean query that the lower-case text of every match satisfies, or None if nothing is mandatory."""
    exact, query = _sequence(_parser.parse(regex))
    query = query if exact is None else _of_strings(exact)
    # an alternative that asks for more than another one adds nothing
    return query and frozenset(x for x in query if not any(y < x for y in query))


def postings(docs: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """The inverted index over the named trigrams: a row (trigram, key) per trigram of a document.

    Nulls have no posting; a repeated row repeats its postings.
    """
    low = F.lower(F.col(text))
    there = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams)))
    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), F.explode(there).alias("trigram"))


def candidates(index: DataFrame, key: str, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the documents whose postings satisfy a rule's query, and for which rules.

    A document brings at most the trigrams that the rules ask for, so its group is bounded.
    """
    def satisfied(query):
        return reduce(Column.__or__, (
            F.size(F.array_intersect("have", F.array(*map(F.lit, sorted(x))))) == len(x) for x in sorted(query, key=sorted)))

    kinds = F.array_compact(F.array(*(F.when(satisfied(q), F.lit(kind)) for kind, q in queries.items())))
    there = index.groupBy(key).agg(F.collect_set("trigram").alias("have"))
    return there.select(key, kinds.alias("kinds")).where(F.size("kinds") > 0)


def matches(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points of the leftmost non-overlapping matches that are long enough."""
    regex = F.lit(rule.regex)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    measured = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.regex, -1)
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("found"), measured.alias("part"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["found"]), F.lit(0))
        long = F.coalesce(F.length(x["part"]) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(long, F.concat(state["spans"], F.array(
            F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["spans"]).alias("spans"))

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when(F.size(found) > 0, F.aggregate(parts, zero, step, lambda s: s["spans"])).otherwise(empty)


def _named(n: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("rule"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def scan(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """`row` (a struct of all columns) and `spans` (array of start, rule, end, kind; sorted) of every row.

    A null text has no span; a null key is looked at by every rule, as the
    index cannot name it. Rows of a repeated key are verified each on its own.
    An empty table gives no row.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    base = docs.select(F.struct("*").alias("row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    if indexed:
        trigrams = sorted({t for q in indexed.values() for x in q for t in x})
        found = candidates(postings(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_text", trigrams),
                           "_key", indexed)
        base = base.join(found, "_key", "left")
    spans = []
    for n, rule in enumerate(rules):
        look = F.lit(True) if rule.kind not in indexed else F.col("_key").isNull() | F.coalesce(
            F.array_contains("kinds", rule.kind), F.lit(False))
        kind = F.when(look, F.transform(matches(F.coalesce("_text", F.lit("")), rule), _named(n, rule.kind)))
        spans.append(F.coalesce(kind, F.array().cast("array<struct<start:bigint,rule:int,end:bigint,kind:string>>")))
    return base.select("row", F.array_sort(F.concat(*spans)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with [kind] in place of each span; of spans that overlap the first is named and all are cut out."""
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, s):
        before = text.substr((state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        apart = F.concat(state["parts"], F.array(F.concat(before, F.lit("["), s["kind"], F.lit("]"))))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= state["at"], apart).otherwise(state["parts"]).alias("parts"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, nothing, step, lambda s: F.concat(
        F.array_join(s["parts"], ""), text.substr((s["at"] + 1).cast("int"), F.length(text)))))


def letters(word: str) -> str:
    """An expression for an ASCII word in either case, and no other letter that folds to it."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The kinds every scan looks for, in this order, with the expressions and lengths they are defined by.
KEYWORDS = ["password", "passwd", "secret", "token"]
BASE = [
    Rule("assign", "(" + "|".join(map(letters, KEYWORDS)) + "|" + letters("api") + "_?" + letters("key") + ")"
         r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
]
#: Further kinds by the public formats of their issuers.
MORE = [
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36}", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
]
