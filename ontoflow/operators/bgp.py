"""Basic graph patterns over triples: equi-joins on shared variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(triples: DataFrame, patterns: list[tuple[str, str, str]], select: list[str] | None = None) -> DataFrame:
    """Bindings of the variables (``?name``) in triple patterns (s, p, o), distinct if ``select`` narrows them.

    Patterns are joined in the order in which each shares a variable with those before it, the one
    with the most constants first; patterns that share none can't be joined.
    """
    def scan(pattern):
        df = triples
        columns, seen = [], {}
        for place, term in zip("spo", pattern):
            if not term.startswith("?"):
                df = df.where(F.col(place) == term)
            elif term in seen:
                df = df.where(F.col(place) == F.col(seen[term]))
            else:
                seen[term] = place
                columns.append(F.col(place).alias(term[1:]))
        return df.select(*columns)

    variables = lambda p: {t for t in p if t.startswith("?")}
    rest = sorted(patterns, key=lambda p: len(variables(p)))
    first = rest.pop(0)
    out, bound = scan(first), variables(first)
    while rest:
        nxt = next((p for p in rest if variables(p) & bound), None)
        if nxt is None:
            raise ValueError("the pattern falls apart: no shared variable")
        rest.remove(nxt)
        out = out.join(scan(nxt), sorted(v[1:] for v in variables(nxt) & bound))
        bound |= variables(nxt)
    return out.select(*select).distinct() if select else out
