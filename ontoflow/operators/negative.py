"""Negative evidence: negative types, blockers, assignment status, conflict policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("report_only", "suppress_derived_keep_asserted", "strict_fail_on_conflict")


class Conflict(RuntimeError):
    """A membership is both derived or asserted and blocked, under the strict policy."""


def sign_rules(disjoint: list[tuple[str, str]], complements: list[tuple[str, str]]) -> list[tuple[str, int, str, int]]:
    """(class, sign, class, sign) closed: which memberships and non-memberships follow from which.

    Members of a class are no members of what is disjoint from it; of complements, being no member of
    one is being a member of the other. There is no contraposition through superclasses.
    """
    direct: dict[tuple[str, int], set[tuple[str, int]]] = {}
    for x, y in [*disjoint, *complements]:
        for a, b in ((x, y), (y, x)):
            direct.setdefault((a, 1), set()).add((b, -1))
    for x, y in complements:
        for a, b in ((x, y), (y, x)):
            direct.setdefault((a, -1), set()).add((b, 1))
    out = []
    for start in sorted(direct):
        seen: set[tuple[str, int]] = set()
        todo = [start]
        while todo:
            for x in direct.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out += [(*start, *x) for x in sorted(seen)]
    return out


def negative_types(types: DataFrame, disjoint: list[tuple[str, str]], complements: list[tuple[str, str]], asserted: DataFrame) -> DataFrame:
    """(id, cls, sign) closed under disjoint and complement pairs, from types and denied types (id, cls).

    The rules are closed on the driver, over class names, so that one join makes all facts.
    """
    import pyarrow as pa

    known = types.select("id", "cls", F.lit(1).alias("sign")).unionByName(asserted.select("id", "cls", F.lit(-1).alias("sign")))
    rules = sign_rules(disjoint, complements)
    if not rules:
        return known.distinct()
    names = ["cls", "sign", "then", "then_sign"]
    kinds = [pa.string(), pa.int32()] * 2
    table = types.sparkSession.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(zip(*rules), kinds)], names=names))
    found = known.join(table, ["cls", "sign"]).select("id", F.col("then").alias("cls"), F.col("then_sign").alias("sign"))
    return known.unionByName(found).distinct()


def blocked_by_class(signed: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, cls, blocker): no member of a class that the target (cls, needs) needs, or of itself."""
    no = signed.where("sign = -1").select("id", F.col("cls").alias("needs"))
    return no.join(targets, "needs").select("id", "cls", F.concat(F.lit("not:"), "needs").alias("blocker")).distinct()


def blocked_by_nominal(nominals: DataFrame, different: DataFrame) -> DataFrame:
    """(id, cls, blocker): different from the individual that the class (cls, node) is."""
    both = different.select("a", "b").unionByName(different.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.join(nominals, F.col("b") == F.col("node")).select(F.col("a").alias("id"), "cls", F.concat(F.lit("different:"), F.col("node").cast("string")).alias("blocker")).distinct()


def blocked_by_value(required: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cls, blocker): a functional property has another value than the class (cls, p, value) asks."""
    own = edges.select("p", F.col("src").alias("id"), "dst")
    return own.join(required, "p").where("dst <> value").select("id", "cls", F.concat(F.lit("value:"), "p").alias("blocker")).distinct()


def blocked_by_assertion(required: DataFrame, negative_edges: DataFrame) -> DataFrame:
    """(id, cls, blocker): the edge to the value that the class (cls, p, value) asks is denied."""
    own = negative_edges.select("p", F.col("src").alias("id"), F.col("dst").alias("value"))
    return own.join(required, ["p", "value"]).select("id", "cls", F.concat(F.lit("denied:"), "p").alias("blocker")).distinct()


def assignment_status(asserted: DataFrame, derived: DataFrame, blockers: DataFrame) -> DataFrame:
    """id, cls, asserted, derived, blocked, conflicted, blockers (sorted) of every pair in any of the three."""
    flag = lambda df, name: df.select("id", "cls", *(F.lit(name == n).alias(n) for n in ("asserted", "derived")), F.lit(None).cast("string").alias("blocker"))
    rows = flag(asserted, "asserted").unionByName(flag(derived, "derived")).unionByName(blockers.select("id", "cls", F.lit(False).alias("asserted"), F.lit(False).alias("derived"), "blocker"))
    out = rows.groupBy("id", "cls").agg(F.max("asserted").alias("asserted"), F.max("derived").alias("derived"), F.sort_array(F.collect_set("blocker")).alias("blockers"))
    out = out.withColumn("blocked", F.size("blockers") > 0)
    return out.select("id", "cls", "asserted", "derived", "blocked", (F.col("blocked") & (F.col("asserted") | F.col("derived"))).alias("conflicted"), "blockers")


def emit(status: DataFrame, policy: str = "suppress_derived_keep_asserted") -> DataFrame:
    """(id, cls) of the memberships that a policy lets through.

    ``report_only`` emits all that is asserted or derived; the default drops what is blocked unless it
    is asserted; the strict one raises Conflict if anything is in conflict.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    positive = status.where("asserted OR derived")
    if policy == "strict_fail_on_conflict":
        if first := status.where("conflicted").select("id", "cls").first():
            raise Conflict(f"{first.id} is in conflict about {first.cls}")
    if policy == "suppress_derived_keep_asserted":
        positive = positive.where("asserted OR NOT blocked")
    return positive.select("id", "cls")
