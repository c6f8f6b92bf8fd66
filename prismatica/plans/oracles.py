"""SQL fragments for the oracle queries."""

from __future__ import annotations


def partition_ctes(source: str, column: str, integer: bool = False, bounds: tuple[float, float] | None = None, size: int = 20) -> str:
    """CTEs v (values x), r (step and first centre) and p (i, centre, lower, upper, e0, e1)."""
    if bounds:
        limits = f"b AS (SELECT {bounds[0]}::DOUBLE AS lo, {bounds[1]}::DOUBLE AS hi)"
    else:
        limits = """q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v),
b AS (SELECT min(x) FILTER (x >= q1 - 1.5::DOUBLE * (q3 - q1)) AS lo, max(x) FILTER (x <= q3 + 1.5::DOUBLE * (q3 - q1)) AS hi FROM v, q)"""
    step = f"least(pow(10, ceil(log10((hi - lo) / {size - 1}))), pow(10, ceil(log10((hi - lo) / {size - 1} * 2))) / 2, pow(10, ceil(log10((hi - lo) / {size - 1} * 5))) / 5)"
    offset = "floor(step / 2)" if integer else "step / 2"
    return f"""v AS (SELECT {column}::DOUBLE AS x FROM {source} WHERE {column} IS NOT NULL AND NOT isnan({column}::DOUBLE)),
{limits},
s AS (SELECT lo, hi, {f'greatest(1, floor({step}))' if integer else step} AS step FROM b),
r AS (SELECT step, floor((lo + step / 2) / step) * step AS first, ceil((hi - step / 2) / step) * step AS last FROM s),
i AS (SELECT unnest(range(0, round((last - first) / step)::BIGINT + 1)) AS i, step, first FROM r),
p AS (SELECT i::INTEGER AS partition_idx, round(first + i * step, 9) AS centre, round(first + i * step, 9) - {offset} AS lower, round(first + i * step, 9) + (step - {offset}) AS upper,
  first - step / 2 + step * i AS e0, first - step / 2 + step * (i + 1) AS e1 FROM i),
h AS (SELECT partition_idx, count(x) AS frequency FROM p LEFT JOIN v ON x >= e0 AND x < e1 GROUP BY partition_idx)"""


def partition_sql(source: str, column: str, integer: bool = False, bounds=None) -> str:
    kind = "BIGINT" if integer else "DOUBLE"
    return f"""WITH {partition_ctes(source, column, integer, bounds)}
SELECT partition_idx, centre::{kind} AS partition, round(lower, 6) AS lower, round(upper, 6) AS upper, frequency::BIGINT AS frequency FROM p JOIN h USING (partition_idx)"""


def simulate_sql(ctes: str, rows: str, prediction: str, base: str) -> str:
    """Mean and 95 % interval of a prediction over all rows for each partition, less a base."""
    return f"""WITH {ctes},
m AS (SELECT partition_idx, avg(y) AS mean, stddev_samp(y) / sqrt(count(y)) AS sem FROM (SELECT partition_idx, ({prediction})::DOUBLE AS y FROM {rows}) GROUP BY partition_idx)
SELECT partition_idx, centre AS partition, round(mean - {base}, 6) AS mean, round(sem, 6) AS sem, round(mean - {base} - 1.959963984540054::DOUBLE * sem, 6) AS lower_bound, round(mean - {base} + 1.959963984540054::DOUBLE * sem, 6) AS upper_bound, frequency::BIGINT AS frequency
FROM m JOIN p USING (partition_idx) JOIN h USING (partition_idx)"""


#: Observations: id, weight and three features.
OBSERVATIONS = """o AS (SELECT o_orderkey AS id, (1 + o_orderkey % 3)::DOUBLE AS w, o_totalprice / 100000 AS a, month(o_orderdate)::DOUBLE / 12 AS b, (o_custkey % 7)::DOUBLE / 7 AS c FROM orders)"""

#: Background and coalition values v0 .. vabc of the attribution queries.
BACKGROUND = """g AS (SELECT avg(o_totalprice / 100000) AS a, avg(month(o_orderdate)::DOUBLE / 12) AS b, avg((o_custkey % 7)::DOUBLE / 7) AS c FROM orders GROUP BY o_orderpriority, o_orderstatus),
v AS (SELECT id, any_value(w) AS w,
  avg(g.a * g.b + 0.5::DOUBLE * g.c + 0.3::DOUBLE * g.a * g.c + 0.2::DOUBLE * g.b * g.c) AS v0, avg(o.a * g.b + 0.5::DOUBLE * g.c + 0.3::DOUBLE * o.a * g.c + 0.2::DOUBLE * g.b * g.c) AS va,
  avg(g.a * o.b + 0.5::DOUBLE * g.c + 0.3::DOUBLE * g.a * g.c + 0.2::DOUBLE * o.b * g.c) AS vb, avg(g.a * g.b + 0.5::DOUBLE * o.c + 0.3::DOUBLE * g.a * o.c + 0.2::DOUBLE * g.b * o.c) AS vc,
  avg(o.a * o.b + 0.5::DOUBLE * g.c + 0.3::DOUBLE * o.a * g.c + 0.2::DOUBLE * o.b * g.c) AS vab, avg(o.a * g.b + 0.5::DOUBLE * o.c + 0.3::DOUBLE * o.a * o.c + 0.2::DOUBLE * g.b * o.c) AS vac,
  avg(g.a * o.b + 0.5::DOUBLE * o.c + 0.3::DOUBLE * g.a * o.c + 0.2::DOUBLE * o.b * o.c) AS vbc, avg(o.a * o.b + 0.5::DOUBLE * o.c + 0.3::DOUBLE * o.a * o.c + 0.2::DOUBLE * o.b * o.c) AS vabc
  FROM o CROSS JOIN g GROUP BY id)"""

#: Attributions and interactions (s, t, and long: l, k) from coalition values v.
GAMES = """s AS (SELECT id, w,
  (va - v0) / 3 + (vab - vb) / 6 + (vac - vc) / 6 + (vabc - vbc) / 3 AS pa,
  (vb - v0) / 3 + (vab - va) / 6 + (vbc - vc) / 6 + (vabc - vac) / 3 AS pb,
  (vc - v0) / 3 + (vac - va) / 6 + (vbc - vb) / 6 + (vabc - vab) / 3 AS pc,
  ((vab - va - vb + v0) / 2 + (vabc - vac - vbc + vc) / 2) / 2 AS ab,
  ((vac - va - vc + v0) / 2 + (vabc - vab - vbc + vb) / 2) / 2 AS ac,
  ((vbc - vb - vc + v0) / 2 + (vabc - vab - vac + va) / 2) / 2 AS bc FROM v),
t AS (SELECT *, pa - ab - ac AS aa, pb - ab - bc AS bb, pc - ac - bc AS cc FROM s),
l AS (SELECT id, w, unnest(['a', 'b', 'c']) AS feature, unnest([pa, pb, pc]) AS phi, unnest([aa, bb, cc]) AS main FROM t),
k AS (SELECT id, w, unnest(['a','a','a','b','b','b','c','c','c']) AS i, unnest(['a','b','c','a','b','c','a','b','c']) AS j, unnest([aa,ab,ac,ab,bb,bc,ac,bc,cc]) AS phi FROM t)"""

SHAP = f"{OBSERVATIONS}, {BACKGROUND}, {GAMES}"


def tree_games(tree: tuple, output: int) -> str:
    """Coalition values of a decision tree: a split on a feature outside the coalition takes both branches by their training rows."""

    def rows(node: tuple) -> int:
        return node[0] if len(node) == 2 else rows(node[2]) + rows(node[3])

    def value(node: tuple, coalition: str) -> str:
        if len(node) == 2:
            return f"{node[1][output]!r}::DOUBLE"
        feature, threshold, left, right = node
        if feature in coalition:
            return f"CASE WHEN {feature} <= {threshold!r} THEN {value(left, coalition)} ELSE {value(right, coalition)} END"
        return f"({rows(left)} * ({value(left, coalition)}) + {rows(right)} * ({value(right, coalition)})) / {rows(node)}::DOUBLE"

    coalitions = ["", "a", "b", "c", "ab", "ac", "bc", "abc"]
    return "v AS (SELECT id, w, " + ", ".join(f"{value(tree, s)} AS v{s or 0}" for s in coalitions) + " FROM o)"


def affinity_sql(metric: str) -> str:
    """The literal definition: orthogonalised interaction vectors row by row, then their moments."""
    return f"""WITH {SHAP},
x AS (SELECT k.id, k.w, k.i, k.j, li.phi AS pi, lj.phi AS pj, li.main AS ii, lj.main AS jj, k.phi AS ij FROM k JOIN l li ON li.id = k.id AND li.feature = k.i JOIN l lj ON lj.id = k.id AND lj.feature = k.j WHERE k.i <> k.j),
m AS (SELECT i, j, sum(w*ii*jj)/sum(w) AS iijj, sum(w*ii*ij)/sum(w) AS iiij, sum(w*jj*ij)/sum(w) AS jjij, sum(w*ii*ii)/sum(w) AS iiii, sum(w*jj*jj)/sum(w) AS jjjj FROM x GROUP BY i, j),
a AS (SELECT i, j, CASE WHEN iijj*iijj - iiii*jjjj < -1e-12*iiii*jjjj THEN (iijj*jjij - iiij*jjjj)/(iijj*iijj - iiii*jjjj) ELSE 0 END AS a, CASE WHEN iijj*iijj - iiii*jjjj < -1e-12*iiii*jjjj THEN (iijj*iiij - jjij*iiii)/(iijj*iijj - iiii*jjjj) ELSE 0 END AS b FROM m),
y AS (SELECT x.*, ij - a*ii - b*jj AS r FROM x JOIN a USING (i, j)),
n AS (SELECT i, j, sum(w*pi*pj)/sum(w) AS m_ij, sum(w*pi*pi)/sum(w) AS m_ii, sum(w*pj*pj)/sum(w) AS m_jj, sum(w*r*r)/sum(w) AS m_rr, sum(w*pi*r)/sum(w) AS m_ir, sum(w*pj*r)/sum(w) AS m_jr FROM y GROUP BY i, j),
d AS (SELECT *, m_ir*m_ir/(m_ii*m_rr) AS synergy, m_ij*m_ij/(m_ii*m_jj) AS association,
  pow(m_ij - m_ir/m_rr*m_jr, 2) / ((m_ii - m_ir/m_rr*m_ir) * (m_jj - m_jr/m_rr*m_jr)) * (1 - m_ir*m_ir/(m_ii*m_rr)) AS redundancy FROM n),
z AS (SELECT feature, sqrt(sum(w*phi*phi)/sum(w)) AS sd FROM l GROUP BY feature),
e AS (SELECT feature, sd / sum(sd) OVER () AS imp FROM z),
f AS (SELECT d.i, d.j, d.{metric} AS rel, t.{metric} AS back, ei.imp AS wi, ej.imp AS wj FROM d JOIN d t ON t.i = d.j AND t.j = d.i JOIN e ei ON ei.feature = d.i JOIN e ej ON ej.feature = d.j)
SELECT 'score' AS output, i AS feature_i, j AS feature_j, round(rel, 6) AS rel, round(wi*rel, 6) AS abs, round((wi*rel + wj*back)/(wi + wj), 6) AS rel_sym, round((wi*rel + wj*back)/2, 6) AS abs_sym FROM f
UNION ALL SELECT 'score', feature, feature, NULL, NULL, NULL, NULL FROM e"""
