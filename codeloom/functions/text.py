"""Tokens and relevance scores as Column expressions; the query text is a literal, so its tokens are too."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The weights of the combined score and the score of each graph distance.
WEIGHTS = {"name": 0.4, "graph": 0.3, "recency": 0.2, "docstring": 0.1}
DISTANCE_SCORE = {0: 1.0, 1: 0.7, 2: 0.4, 3: 0.2}
HALF_LIFE_S = 3600.0

_BREAKS = r"(?U)[\s_\-:./]"


def tokenize(text: Column) -> Column:
    """Lower-case pieces between white space and `_ - : . /`, of two bytes or more, repetitions kept."""
    pieces = F.transform(F.split(text, _BREAKS), F.lower)
    return F.filter(pieces, lambda t: F.octet_length(t) >= 2)


def query_tokens(query: str) -> list[str]:
    """The same for a query text on the driver."""
    return [t for t in re.split(r"[\s_\-:./]", query.lower()) if len(t.encode()) >= 2]


def share_contained(text: Column, tokens: list[str]) -> Column:
    """The share of the tokens that the lower-cased text contains; 0 without tokens or text."""
    if not tokens:
        return F.lit(0.0)
    lowered = F.lower(text)
    hits = F.lit(0)
    for t in tokens:
        hits = hits + F.coalesce(F.contains(lowered, F.lit(t)), F.lit(False)).cast("int")
    return hits.cast("double") / F.lit(float(len(tokens)))


def name_score(name: Column, query: str) -> Column:
    return share_contained(name, query_tokens(query))


def docstring_score(docstring: Column, query: str) -> Column:
    return share_contained(docstring, query_tokens(query))


def graph_score(distance: Column) -> Column:
    """1, 0.7, 0.4 and 0.2 for 0 to 3 calls' distance, 0 beyond and for null."""
    out = F.lit(0.0)
    for d, s in DISTANCE_SCORE.items():
        out = F.when(distance == d, F.lit(s)).otherwise(out)
    return out


def recency_score(seconds: Column) -> Column:
    """Halves every hour; 0 for what was never accessed."""
    return F.coalesce(F.pow(F.lit(0.5), seconds.cast("double") / F.lit(HALF_LIFE_S)), F.lit(0.0))


def elapsed_seconds(now_us: Column, then_us: Column) -> Column:
    """Whole seconds, not below 0."""
    return F.greatest(F.lit(0), F.floor((now_us - then_us) / F.lit(1_000_000))).cast("long")


def combined_score(name: Column, path: Column, graph: Column, recency: Column, docstring: Column) -> Column:
    """The weighted sum, added up in this order."""
    return (
        F.lit(WEIGHTS["name"]) * F.greatest(name, path)
        + F.lit(WEIGHTS["graph"]) * graph
        + F.lit(WEIGHTS["recency"]) * recency
        + F.lit(WEIGHTS["docstring"]) * docstring
    )


def mentions(text: Column, query: str) -> Column:
    """Whether the text contains the whole query or one of its words of two bytes or more."""
    lowered = F.lower(text)
    found = F.contains(lowered, F.lit(query.lower()))
    for w in query.lower().split():
        if len(w.encode()) >= 2:
            found = found | F.contains(lowered, F.lit(w))
    return F.coalesce(found, F.lit(False))


#: The reasons given beside a result.
REASONS = {
    "name": "name match: ",
    "path": "file path match: ",
    "direct": "directly connected to query match (1 hop)",
    "graph": "connected via call graph (",
    "hops": " hops)",
    "now": "recently accessed (< 1 minute ago)",
    "recent": "recently accessed (",
    "minutes": " minutes ago)",
    "hours": " hours ago)",
    "docstring": "docstring mentions ",
    "other": "related via code structure",
}


def reason(name: Column, path: Column, docstring: Column, distance: Column, seconds: Column, query: str) -> Column:
    """Why a row was found: name, path, distance, recency, documentation, in this order of preference."""
    minutes, hours = F.floor(seconds / 60).cast("string"), F.floor(seconds / 3600).cast("string")
    whole = F.coalesce(F.contains(F.lower(docstring), F.lit(query.lower())), F.lit(False))
    say = {k: F.lit(v) for k, v in REASONS.items()}
    return (
        F.when(mentions(name, query), F.concat(say["name"], name))
        .when(mentions(path, query), F.concat(say["path"], path))
        .when(distance == 1, say["direct"])
        .when(distance > 1, F.concat(say["graph"], distance.cast("string"), say["hops"]))
        .when(seconds < 60, say["now"])
        .when(seconds < 3600, F.concat(say["recent"], minutes, say["minutes"]))
        .when(seconds.isNotNull(), F.concat(say["recent"], hours, say["hours"]))
        .when(whole, F.concat(say["docstring"], F.lit(f'"{query}"')))
        .otherwise(say["other"])
    )
