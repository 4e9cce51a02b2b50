"""The constraint graph's meaning in plain Python, node by node: a second opinion on the lowering."""

from __future__ import annotations

from ontoflow.plans.ir import Dag, Kind


def evaluate(dag: Dag, nodes: dict, edges: list[tuple], types: dict, reflexive: frozenset = frozenset()) -> list[dict]:
    """Scores of all graph nodes, for each DAG node. nodes: id -> (dt, num); edges: (p, src, dst); types: (id, cls) -> w."""
    out: list[dict] = []

    def near(prop, direction, v):
        own = [d for p, s, d in edges if p == prop and s == v] if direction == "forward" else [s for p, s, d in edges if p == prop and d == v]
        return list(dict.fromkeys([*own, v])) if prop in reflexive else own

    for n in dag.nodes:
        child = out[n.children[0]] if n.children else None
        score = {}
        for v, (dt, num) in nodes.items():
            if n.kind is Kind.CONST:
                x = 1.0
            elif n.kind is Kind.ATOMIC:
                x = types.get((v, n.cls), 0.0)
            elif n.kind is Kind.NOMINAL:
                x = float(v == n.node)
            elif n.kind is Kind.DATATYPE:
                ok = dt is not None and n.datatype in (None, dt)
                if n.low is not None or n.high is not None:
                    ok = ok and num is not None
                if ok and n.low is not None:
                    ok = num > n.low if n.low_open else num >= n.low
                if ok and n.high is not None:
                    ok = num < n.high if n.high_open else num <= n.high
                x = float(ok)
            elif n.kind is Kind.NEGATION:
                x = 1.0 - child[v]
            elif n.kind is Kind.HAS_SELF:
                x = float(n.prop in reflexive or (n.prop, v, v) in edges)
            elif n.kind is Kind.EXISTS:
                x = max((child[u] for u in near(n.prop, n.direction, v)), default=0.0)
            elif n.kind is Kind.FORALL:
                x = min((child[u] for u in near(n.prop, n.direction, v)), default=1.0)
            elif n.kind is Kind.EXISTS_TRANSITIVE:
                seen, todo = set(), [v]
                while todo:
                    w = todo.pop()
                    for p, d in n.family:
                        for u in near(p, d, w):
                            if u not in seen:
                                seen.add(u)
                                todo.append(u)
                x = max((child[u] for u in seen), default=0.0)
            elif n.kind in (Kind.MIN_CARD, Kind.MAX_CARD, Kind.EXACT_CARD):
                s = sorted((child[u] for u in near(n.prop, n.direction, v)), reverse=True)
                kth = lambda k: 1.0 if k <= 0 else min(1.0, max(0.0, s[k - 1])) if len(s) >= k else 0.0  # noqa: E731, B023
                if n.fuzzy:
                    x = min(1.0, sum(y > 0 for y in s) / n.k)
                else:
                    low, high = kth(n.k), 1.0 - kth(n.k + 1)
                    x = {Kind.MIN_CARD: low, Kind.MAX_CARD: high, Kind.EXACT_CARD: min(low, high)}[n.kind]
            elif n.kind is Kind.INTERSECTION:
                own = [out[c][v] for c in n.children]
                x = sum(own) / len(own) if n.mean else min(own)
            elif n.kind is Kind.UNION:
                x = max(out[c][v] for c in n.children)
            else:
                x = max((types.get((u, n.cls), 0.0) + (child[u] if child else 0.0) for u in near(n.prop, n.direction, v)), default=0.0)
            score[v] = x * (n.scale if n.scale is not None else 1.0)
        out.append(score)
    return out
