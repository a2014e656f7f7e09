"""Secrets by a trigram index; DataFrame and SQL functions only.

Each rule is a regular expression. From its parsed form follows a Boolean query over trigrams: an OR of ANDs of trigrams
that any match must contain, as pieces of the literal runs in it. The index is the table of postings (trigram, text) of
all trigrams that some query names, over texts folded to lower case; a clause's postings are intersected by counting how
many of its trigrams a text has, and clauses are united. Only texts that a rule's query leaves are searched with it. Rules
without mandatory trigrams search every text.

Texts go by a hash in the index: two texts that share one only get each other's candidates, which the search then rules
out. So results are exact, and copies of a text are one entry.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, matches, raw, written


@dataclass(frozen=True)
class Rule:
    """keep: SQL over a match x with its string x.m."""

    kind: str
    pattern: str
    keep: str = "true"


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The base kinds, then those that the method adds: public forms of keys and tokens.
BASE = (
    Rule("assign", _ASSIGN, f"length(regexp_extract(x.m, {raw(_ASSIGN)}, 1)) >= 6"),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("bearer", r"(?i:authorization):\x20*(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{16,}"),
    Rule("login", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._~%-]{1,256}:[^\x00-\x20/@:]{1,256}@[A-Za-z0-9.-]+"),
)
RULES = BASE + ADDED

#: Strings that a literal run may stand for, at most, before it is closed.
STRINGS = 64

Query = frozenset  # of clauses, each a frozenset of trigrams; an empty clause holds everywhere
ALL: Query = frozenset([frozenset()])


def _least(query: Query) -> Query:
    """Without clauses that others imply."""
    return frozenset(c for c in query if not any(o < c for o in query))


def _both(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x in a for y in b))


def _of(strings: frozenset[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _class(items: list) -> frozenset[str] | None:
    """The folded characters of a small class, else None."""
    found = set()
    for op, arg in items:
        if op is K.LITERAL:
            found.add(chr(arg).lower())
        elif op is K.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def _parsed(tree) -> tuple[frozenset[str] | None, Query]:
    """Of a parsed expression: all strings it matches, folded, if they are few, and its query if not."""
    run, query, exact = frozenset([""]), ALL, True
    for op, arg in tree:
        strings, inner = None, ALL
        if op is K.LITERAL:
            strings = frozenset([chr(arg).lower()])
        elif op is K.IN:
            strings = _class(arg)
        elif op is K.SUBPATTERN:
            strings, inner = _parsed(arg[-1])
        elif op is K.BRANCH:
            ways = [_parsed(x) for x in arg[1]]
            if all(s is not None for s, _ in ways):
                strings = frozenset().union(*(s for s, _ in ways))
            else:
                inner = _least(frozenset().union(*(q if s is None else _of(s) for s, q in ways)))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, sub = arg
            own, inside = _parsed(sub)
            if own is not None and (low, high) in ((0, 1), (1, 1)):
                strings = own if low else own | {""}
            elif low:
                inner = inside if own is None else _of(own)
        elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue
        if strings is not None and len(run) * len(strings) <= STRINGS:
            run = frozenset(a + b for a, b in itertools.product(run, strings))
            continue
        # The run ends here; what comes next starts anew.
        query, exact, run = _both(query, _of(run)), False, frozenset([""])
        if strings is not None:
            run = strings
        else:
            query = _both(query, inner)
    return (run, ALL) if exact else (None, _both(query, _of(run)))


def trigrams(pattern: str) -> Query:
    """The clauses of a pattern, over folded texts: a text with a match has all trigrams of one of them. ALL: nothing is mandatory."""
    strings, query = _parsed(_parser.parse(pattern))
    return query if strings is None else _of(strings)


def postings(texts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """h, trigram: which texts (h, text) hold which trigrams of the vocabulary, once each."""
    held = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in vocabulary)
    return texts.select("h", F.lower("text").alias("_folded")).select("h", F.explode(F.expr(f"filter(array({held}), t -> contains(_folded, t))")).alias("trigram")).distinct()


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """h, rules: for each text (h, text) that the query of a rule with mandatory trigrams leaves, the bits of those rules."""
    clauses = [(k, j, t, len(c)) for k, rule in enumerate(rules) if (q := trigrams(rule.pattern)) != ALL for j, c in enumerate(sorted(map(sorted, q))) for t in c]
    if not clauses:
        return texts.select("h", F.lit(0).cast("long").alias("rules")).where("false")
    asked = F.broadcast(texts.sparkSession.createDataFrame(clauses, "rule int, clause int, trigram string, need int"))  # as many rows as the rules have trigrams
    found = postings(texts, sorted({t for *_, t, _ in clauses}))
    met = found.join(asked, "trigram").groupBy("h", "rule", "clause").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need")
    return met.groupBy("h").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE), bound: int = BROADCAST) -> DataFrame:
    """doc_id with base (spans of the first base rules) and spans (of all rules): arrays of (s, k, e, kind), in code points, by start, then rule.

    A null text is empty and has none. Rows are judged one by one, by their texts, whatever their ids; equal texts get
    equal spans. Matches of one rule don't overlap, those of several may. Texts are searched whole. An empty table gives
    none. Other columns of docs are ignored. At most 63 rules.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    left = written(candidates(texts, rules))
    # One row a text with a candidate: broadcast up to a checked number; beyond it a join that Spark can split shuffles.
    told = texts.join(F.broadcast(left) if left.count() <= bound else left, "h", "left")
    kind = "array<struct<s: int, k: int, e: int, kind: string>>"
    columns = []
    for k, rule in enumerate(rules):
        asked = f"text RLIKE {raw(rule.pattern)}" if trigrams(rule.pattern) == ALL else f"coalesce(rules & {1 << k}L, 0L) <> 0"
        spans = f"transform(filter({matches('text', rule.pattern)}, x -> {rule.keep}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'kind', '{rule.kind}'))"
        columns.append(F.expr(f"IF({asked}, {spans}, cast(array() AS {kind}))").alias(f"_{k}"))
    own = told.select("doc_id", *columns)
    return own.select("doc_id", *(F.array_sort(F.concat(*(f"_{k}" for k in range(n)))).alias(name) for n, name in ((base, "base"), (len(rules), "spans"))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
