"""Personal data: base patterns, and a span classifier trained by weak supervision; DataFrame and SQL functions only.

Base spans (email, ip, card, phone) are the stated patterns with their checks. Further spans are found in three steps.
Candidates are tokens with digits or secret-like shapes. Labelers (regexes, gazetteers of cue words and prefixes, the
words around) vote on each one for or against, or abstain. Expectation-maximisation over the counts of vote patterns
(at most 3**labelers rows, whatever the corpus) estimates each labeler's reliability; its posteriors, as soft labels,
then train the final span classifier, a naive Bayes model over binned span features. Both models are a few numbers,
which enter the scoring pass as literals; texts are never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")

# Possessive forms of the stated patterns: they match the same strings in linear time and without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

IP_VALID = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"

#: A token that may be a secret: letters, digits and the marks used in keys, 12 or more of them.
CANDIDATE = r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{12,}+"

#: Gazetteers of the labelers, in lower case.
CUES = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "access_key", "private_key", "auth", "bearer", "credential")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "glpat-", "eyJ")

#: Score from which a candidate becomes a span.
THRESHOLD = 0.9

_SPANS = "array<struct<s: int, k: int, e: int, kind: string>>"


def _lit(pattern: str) -> str:
    return "r'" + pattern + "'"


def _matches(text: str, pattern: str) -> str:
    """SQL: array of (s, e, m), each match's code point range and string. The pieces between matches give the places."""
    p = _lit(pattern)
    return f"""aggregate(zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), (m, before) -> named_struct('m', m, 'before', before)),
        named_struct('at', 0, 'out', cast(array() AS array<struct<s: int, e: int, m: string>>)),
        (a, x) -> IF(x.m IS NULL, a, named_struct('at', a.at + char_length(x.before) + char_length(x.m),
            'out', array_append(a.out, named_struct('s', a.at + char_length(x.before), 'e', a.at + char_length(x.before) + char_length(x.m), 'm', x.m)))),
        a -> a.out)"""


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length(d)), 0, (a, i) -> a + IF((length(d) - i) % 2 = 1,
    element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substr(d, i, 1) AS int) + 1), cast(substr(d, i, 1) AS int))) % 10 = 0"""


def base_spans(text: str) -> str:
    """SQL: the base spans of a text column as an array of (s, k, e, kind), by start, then kind as listed."""

    def kind(k: int, pattern: str, needs: str, keep: str) -> str:
        return f"""IF({needs}, transform(filter({_matches(text, pattern)}, x -> {keep}),
            x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'kind', '{KINDS[k]}')), cast(array() AS {_SPANS}))"""

    digit = f"{text} RLIKE '[0-9]'"
    luhn = f"exists(array({_DIGITS}), d -> length(d) BETWEEN 12 AND 19 AND {_LUHN})"
    return f"""array_sort(concat(
        {kind(0, EMAIL, f"contains({text}, '@')", "true")},
        {kind(1, IP, digit, f"x.m RLIKE {_lit(IP_VALID)}")},
        {kind(2, CARD, digit, luhn)},
        {kind(3, PHONE, f"contains({text}, '+') AND {digit}", f"length({_DIGITS}) BETWEEN 9 AND 15")}))"""


#: Each labeler: a vote for (1), against (-1) or none (0), of a candidate x with its string x.m and the 24 code points before it, b.
LABELERS = {
    "regex_hex": "IF(x.m RLIKE '^(?:.*=)?[0-9a-f]{16,}$' AND x.m RLIKE '[a-f][0-9]', 1, 0)",
    "regex_key": "IF(x.m RLIKE '^[A-Z0-9]{16,}$' AND x.m RLIKE '[0-9A-Z][A-Z]' AND x.m RLIKE '[A-Z]{4}', 1, 0)",
    "gazetteer_prefix": "IF(" + " OR ".join(f"startswith(x.m, '{p}')" for p in PREFIXES) + ", 1, 0)",
    "context_cue": "IF(" + f"lower(concat(x.b, x.m)) RLIKE '(?:{'|'.join(CUES)})[\\\"\\\\x27 ]*[:=]', 1, 0)",
    "numbered_words": "IF(x.m RLIKE '^[A-Za-z]?[a-z]{2,}(?:[-_/=+][A-Za-z]?[a-z]{2,})*[-_/=+]?[0-9]{1,4}$', -1, 0)",
    "plain_number": "IF(x.m RLIKE '^[0-9-]+$' AND NOT x.m RLIKE '[a-f]', -1, 0)",
}

#: Binned features of the final classifier.
FEATURES = {
    "length": "least(int(length(x.m) / 8), 6)",
    "digits": "int(4 * length(regexp_replace(x.m, '[^0-9]', '')) / length(x.m))",
    "upper": "int(4 * length(regexp_replace(x.m, '[^A-Z]', '')) / length(x.m))",
    "mixed": "int(x.m RLIKE '[0-9][A-Za-z]') + int(x.m RLIKE '[A-Za-z][0-9]')",
    "quoted": "int(x.b RLIKE '[\\\"\\\\x27]$')",
    "assigned": "int(x.b RLIKE '[:=] ?[\\\"\\\\x27]?$' OR x.m RLIKE '[A-Za-z]=[^=]')",
}


def _candidates(text: str) -> str:
    """SQL: candidates as (s, e, m, b). Base spans and candidates may overlap; a union of both is what counts."""
    return f"""IF({text} RLIKE '[0-9]', transform(filter({_matches(text, CANDIDATE)}, x -> x.m RLIKE '[0-9]'),
        x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'b', substr({text}, greatest(x.s - 23, 1), least(x.s, 24)))),
        cast(array() AS array<struct<s: int, e: int, m: string, b: string>>))"""


@dataclass
class Model:
    """Labelers' accuracies, the prior, and the classifier's log odds by feature and bin. No candidates: nothing is added."""

    prior: float = 0.0
    accuracy: dict[str, float] = field(default_factory=dict)
    bias: float = -99.0
    weights: dict[str, dict[int, float]] = field(default_factory=dict)

    def score(self) -> str:
        """SQL: the score, 0 to 1, of a candidate x."""
        terms = [f"element_at(map({', '.join(f'{b}, {w!r}D' for b, w in sorted(bins.items()))}), {FEATURES[name]})" for name, bins in self.weights.items()]
        total = " + ".join([f"{self.bias!r}D", *(f"coalesce({t}, 0D)" for t in terms)])
        return f"1 / (1 + exp(-({total})))"


def reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[float, dict, dict]:
    """EM over counts of vote patterns (1 for, -1 against, 0 none): the share of true ones, P(vote | class) as given[labeler, class, vote], and each pattern's posterior. Labelers are taken as independent given the class; it starts from a majority vote."""
    width = len(next(iter(patterns)))
    post = {v: min(0.95, max(0.05, 0.4 + 0.3 * sum(v))) for v in patterns}
    total = sum(patterns.values())
    prior, given = 0.5, {}
    for _ in range(rounds):
        prior = (sum(post[v] * n for v, n in patterns.items()) + 1) / (total + 2)
        for j in range(width):
            for c in (0, 1):
                mass = {x: 1.0 for x in (-1, 0, 1)}
                for v, n in patterns.items():
                    mass[v[j]] += n * (post[v] if c else 1 - post[v])
                s = sum(mass.values())
                for x, y in mass.items():
                    given[j, c, x] = y / s
        for v in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(given[j, 1, x] / given[j, 0, x]) for j, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
    return prior, given, post


def fit(docs: DataFrame, rounds: int = 50) -> Model:
    """EM over vote patterns, then naive Bayes on the posteriors. What comes to the driver is counts of (votes, bins) rows, bounded by their number."""
    seen = docs.select(F.expr(f"explode({_candidates('text')})").alias("x"))
    votes, bins = list(LABELERS), list(FEATURES)
    rows = seen.selectExpr(*(f"{LABELERS[v]} AS v_{v}" for v in votes), *(f"{FEATURES[b]} AS f_{b}" for b in bins)).groupBy(*(f"v_{v}" for v in votes), *(f"f_{b}" for b in bins)).count().collect()
    counted = sorted((tuple(r[f"v_{v}"] for v in votes), tuple(r[f"f_{b}"] for b in bins), r["count"]) for r in rows)
    if not counted:
        return Model()
    patterns: dict[tuple, float] = {}
    for v, _, n in counted:
        patterns[v] = patterns.get(v, 0) + n
    prior, given, post = reliabilities(patterns, rounds)
    total = sum(patterns.values())
    weights: dict[str, dict[int, float]] = {}
    yes = sum(post[v] * n for v, _, n in counted)
    no = total - yes
    for j, name in enumerate(bins):
        mass: dict[int, list[float]] = {}
        for v, f, n in counted:
            m = mass.setdefault(f[j], [1.0, 1.0])
            m[1] += post[v] * n
            m[0] += (1 - post[v]) * n
        weights[name] = {b: round(math.log(m[1] / (yes + len(mass))) - math.log(m[0] / (no + len(mass))), 6) for b, m in mass.items()}
    accuracy = {v: round(given[j, 1, 1] / (given[j, 1, 1] + given[j, 0, 1]), 6) for j, v in enumerate(votes)}
    return Model(prior, accuracy, round(math.log((yes + 1) / (no + 1)), 6), weights)


def spans(text: str, model: Model, threshold: float = THRESHOLD) -> tuple[str, str]:
    """SQL for the base spans and for the added ones of a text column."""
    added = f"""transform(filter({_candidates(text)}, x -> {model.score()} >= {threshold}),
        x -> named_struct('s', x.s, 'k', 4, 'e', x.e, 'kind', '{KINDS[4]}'))"""
    return base_spans(text), added


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with base (base spans) and spans (all, by start, then kind as listed): arrays of (s, k, e, kind), in code points.

    A null text has no spans. Rows are judged one by one, so nulls, repeated rows and ties need no care; other columns
    pass through, those named base or spans are replaced. An empty table stays empty, and trains a model that adds nothing.
    """
    model = model or fit(docs)
    base, added = spans("_text", model)
    out = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    out = out.withColumn("base", F.expr(base)).withColumn("_added", F.expr(added))
    return out.withColumn("spans", F.array_sort(F.concat("base", "_added"))).drop("_text", "_added")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, merged where they overlap, replaced by its first kind in angle brackets."""
    joined = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(x["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substr(text, a["at"] + 1, x["s"] - a["at"]), F.lit("<"), x["kind"], F.lit(">"))).alias("out"),
        ),
    )
    whole = F.concat(joined["out"], F.substr(text, joined["at"] + 1))
    return F.when(F.size(spans) == 0, text).otherwise(whole)
