"""SQL (DuckDB) formulation of a deterministic single tree for the oracle.

Same semantics as ``allelo.operators.forest`` with one tree, no bootstrap and
every variable tried: per level, class totals per node, zero-dosage rows,
running left counts per (node, variable), weighted impurity, best split per
node (ties to smallest variable, then threshold), then routing.
"""

from __future__ import annotations

from allelo.functions.hashing import below, mixed_sql


def impurity_sql(cols: list[str], n: str, kind: str) -> str:
    n = f"({n})"
    if kind == "gini":
        s2 = " + ".join(f"cast({c} as double) * {c}" for c in cols)
        return f"(case when {n} > 0 then 1.0 - ({s2}) / (cast({n} as double) * {n}) else 0.0 end)"
    sl = " + ".join(f"(case when {c} > 0 then {c} * log2({c}) else 0.0 end)" for c in cols)
    return f"(case when {n} > 0 then log2({n}) - ({sl}) / cast({n} as double) else 0.0 end)"


def level_sql(d: int, L: int, kind: str, max_depth: int, p: str = "") -> list[str]:
    """CTEs for level ``d`` given ``{p}s{d}(si, node, w)``, ``lab(si, label)``, ``x(si, vi, allele)``.

    ``p`` prefixes every CTE name so several trees can be unrolled in one query.
    """
    tl = [f"t{l}" for l in range(L)]
    tot_cols = ", ".join(f"cast(sum(case when label = {l} then w else 0 end) as bigint) t{l}" for l in range(L))
    size = "(" + " + ".join(tl) + ")"
    maj = "case " + " ".join(
        f"when {' and '.join(f't{l} > t{m}' if m > l else f't{l} >= t{m}' for m in range(L) if m != l)} then {l}"
        for l in reversed(range(L))) + " end"
    parts = [f"{p}tot{d} AS (select node, {tot_cols} from {p}s{d} join lab using (si) group by node)",
             f"{p}tt{d} AS (select *, {size} size, {maj} majority, {impurity_sql(tl, size, kind)} imp from {p}tot{d})"]
    if d < max_depth:
        cnt = ", ".join(f"cast(sum(case when label = {l} then s.w else 0 end) as bigint) c{l}" for l in range(L))
        zc = ", ".join(f"t.t{l} - sum(nz.c{l}) c{l}" for l in range(L))
        grp = ", ".join(f"t.t{l}" for l in range(L))
        cum = ", ".join(f"sum(c{l}) over (partition by node, vi order by allele "
                        f"rows between unbounded preceding and current row) l{l}" for l in range(L))
        ll = [f"l{l}" for l in range(L)]
        rr = [f"(t{l} - l{l})" for l in range(L)]
        nl = "(" + " + ".join(ll) + ")"
        nr = f"(size - {nl})"
        weighted = f"(({impurity_sql(ll, nl, kind)}) * {nl} + ({impurity_sql(rr, nr, kind)}) * {nr}) / cast(size as double)"
        parts += [
            f"{p}nz{d} AS (select s.node, x.vi, x.allele, {cnt} from {p}s{d} s join lab using (si) join x using (si) "
            f"group by s.node, x.vi, x.allele)",
            f"{p}zs{d} AS (select nz.node, nz.vi, cast(0.0 as double) allele, {zc} from {p}nz{d} nz join {p}tot{d} t using (node) "
            f"group by nz.node, nz.vi, {grp})",
            f"{p}cu{d} AS (select node, vi, allele, {cum} from (select * from {p}nz{d} union all select * from {p}zs{d}) u)",
            f"{p}sc{d} AS (select node, vi, allele threshold, {weighted} weighted from {p}cu{d} join {p}tt{d} using (node) "
            f"where {nr} > 0)",
            f"{p}bs{d} AS (select node, vi, threshold, weighted from (select *, row_number() over (partition by node "
            f"order by round(weighted, 12), vi, threshold) rn from {p}sc{d}) q where rn = 1)",
            f"{p}nd{d} AS (select cast(tt.node as bigint) node, cast({d} as bigint) depth, case when bs.vi is not null and tt.imp - bs.weighted > 1e-12 "
            f"then bs.vi else -1 end variable, case when bs.vi is not null and tt.imp - bs.weighted > 1e-12 "
            f"then bs.threshold else 0.0 end threshold, cast(tt.majority as bigint) majority, case when bs.vi is not null and "
            f"tt.imp - bs.weighted > 1e-12 then tt.imp - bs.weighted else 0.0 end gain, tt.imp impurity, tt.size "
            f"from {p}tt{d} tt left join {p}bs{d} bs using (node))",
            f"{p}s{d + 1} AS (select s.si, 2 * s.node + case when coalesce(x.allele, 0) > n.threshold then 1 else 0 end "
            f"node, s.w from {p}s{d} s join {p}nd{d} n on n.node = s.node and n.variable >= 0 "
            f"left join x on x.si = s.si and x.vi = n.variable)",
        ]
    else:
        parts.append(f"{p}nd{d} AS (select cast(node as bigint) node, cast({d} as bigint) depth, cast(-1 as bigint) variable, "
                     f"cast(0.0 as double) threshold, cast(majority as bigint) majority, "
                     f"cast(0.0 as double) gain, imp impurity, size from {p}tt{d})")
    return parts


def _splits_sql(source: str, L: int, kind: str, seed: int, fraction: float) -> str:
    """Node listing of every (tree, depth, node) in ``source``: totals, best split, gain."""
    tl = [f"t{l}" for l in range(L)]
    size = "(" + " + ".join(tl) + ")"
    maj = "case " + " ".join(
        f"when {' and '.join(f't{l} > t{m}' if m > l else f't{l} >= t{m}' for m in range(L) if m != l)} then {l}"
        for l in reversed(range(L))) + " end"
    tot = ", ".join(f"cast(sum(case when label = {l} then w else 0 end) as bigint) t{l}" for l in range(L))
    cnt = ", ".join(f"cast(sum(case when label = {l} then s.w else 0 end) as bigint) c{l}" for l in range(L))
    zero = ", ".join(f"any_value(t.t{l}) - sum(nz.c{l}) c{l}" for l in range(L))
    cum = ", ".join(f"sum(c{l}) over (partition by tree, depth, node, vi order by allele "
                    f"rows between unbounded preceding and current row) l{l}" for l in range(L))
    ll, rr = [f"l{l}" for l in range(L)], [f"(t{l} - l{l})" for l in range(L)]
    nl = "(" + " + ".join(ll) + ")"
    nr = f"(size - {nl})"
    weighted = f"(({impurity_sql(ll, nl, kind)}) * {nl} + ({impurity_sql(rr, nr, kind)}) * {nr}) / cast(size as double)"
    split = "bs.vi is not null and tt.imp - bs.weighted > 1e-12"
    pick = f"{mixed_sql(f'({seed} + 7919 * (s.depth + 1))', 's.tree', 's.node', 'x.vi')} < {below(fraction)}" \
        if fraction < 1 else "true"
    return f"""(with tt as (select *, {size} size, {maj} majority, {impurity_sql(tl, size, kind)} imp from
    (select tree, depth, node, parent, side, {tot} from {source} join lab using (si) group by all) q),
  nz as (select s.tree, s.depth, s.node, x.vi, x.allele, {cnt} from {source} s join lab using (si) join x using (si)
    where {pick} group by s.tree, s.depth, s.node, x.vi, x.allele),
  sc as (select tree, depth, node, vi, allele threshold, {weighted} weighted from (
    select tree, depth, node, vi, allele, {cum} from (select * from nz union all
      select nz.tree, nz.depth, nz.node, nz.vi, cast(0.0 as double) allele, {zero}
      from nz join tt t using (tree, depth, node) group by nz.tree, nz.depth, nz.node, nz.vi) u) c
    join tt using (tree, depth, node) where {nr} > 0 and {nl} > 0)
  select tt.tree, tt.depth, tt.node, tt.parent, tt.side, case when {split} then bs.vi else -1 end variable,
    case when {split} then bs.threshold else 0.0 end threshold, cast(tt.majority as bigint) majority,
    case when {split} then tt.imp - bs.weighted else 0.0 end gain, tt.imp impurity, tt.size
  from tt left join (select * from (select *, row_number() over (partition by tree, depth, node
    order by round(weighted, 12), vi, threshold) rn from sc) q where rn = 1) bs using (tree, depth, node))"""


def forest_sql(L: int, kind: str, bag: str, seed: int, fraction: float) -> list[str]:
    """Trees grown until no node gains, by recursion over levels; result CTE ``nodes``.

    ``bag`` gives ``(tree, si, w)``.  A node is named by its smallest sample; ``parent`` and
    ``side`` link it to the level above.  A variable is tried in a node if its hash under the
    level's seed lies below ``fraction``.
    """
    splits = _splits_sql("state", L, kind, seed, fraction)
    return [f"bag AS MATERIALIZED ({bag})",
            f"""state AS (select tree, si, w, cast(0 as bigint) depth, cast(-1 as bigint) parent, cast(0 as bigint) side,
    min(si) over (partition by tree) node from bag
  union all select tree, si, w, depth + 1, node, go, min(si) over (partition by tree, node, go) from (
    select s.*, cast(coalesce(x.allele, 0) > n.threshold as bigint) go from state s join {splits} n
    on n.tree = s.tree and n.node = s.node and n.variable >= 0
    left join x on x.si = s.si and x.vi = n.variable) q)""",
            f"nodes AS MATERIALIZED ({splits})"]


def walk_sql(start: str) -> list[str]:
    """Rows of ``start(tree, si)`` walked down ``nodes``; result CTE ``pred(tree, si, prediction)``."""
    node = "n.depth, n.node, n.variable, n.threshold, n.majority"
    return [f"""walk AS (select p.tree, p.si, {node} from ({start}) p join nodes n on n.tree = p.tree and n.depth = 0
  union all select w.tree, w.si, {node} from walk w left join x on x.si = w.si and x.vi = w.variable
  join nodes n on n.tree = w.tree and n.depth = w.depth + 1 and n.parent = w.node
    and n.side = cast(coalesce(x.allele, 0) > w.threshold as bigint) where w.variable >= 0)""",
            "pred AS MATERIALIZED (select tree, si, majority prediction from walk where variable < 0)"]


def importance_sql() -> str:
    """CTE ``imp(tree, variable, importance, n_splits)`` of every tree."""
    return """imp AS (select p.tree, p.variable, sum((p.size * p.impurity - c.below) / root.size) importance, count(*) n_splits
  from nodes p join (select tree, depth - 1 depth, parent node, sum(size * impurity) below from nodes where depth > 0
    group by 1, 2, 3) c using (tree, depth, node) join nodes root on root.tree = p.tree and root.depth = 0
  where p.variable >= 0 group by p.tree, p.variable)"""


def bootstrap_sql(trees: int, seed: int) -> str:
    """``(tree, si, w)``: as many draws with replacement as there are samples, for every tree."""
    return (f"select tree, {mixed_sql(seed, 'tree', 'draw')} % n si, count(*) w from range({trees}) t(tree), "
            "(select count(*) n from lab) c, range(c.n) d(draw) group by 1, 2")
