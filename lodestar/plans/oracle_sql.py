"""DuckDB text of the registered queries (the correctness oracle).

Written independently of the Spark plans: plain cross joins, list functions
and window functions over the same parquet views.  Each function returns CTE
text; ``sql(...)`` glues CTEs and a final select.
"""
from __future__ import annotations

from .fixture import duckdb_fixture_ctes


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)::double"


def sql(*ctes: str, select: str) -> str:
    body = ",\n".join(c.strip().strip(",") for c in ctes if c.strip())
    return f"with {body}\n{select}"


FX = duckdb_fixture_ctes()

SPLITS = """
tr as (select q_id, qv from q where split='train'),
dv as (select q_id, qv from q where split='dev'),
te as (select q_id, qv from q where split='test')"""

NORM = "list_transform({v}, lambda x: x/greatest(sqrt(list_dot_product({v},{v})),1e-12))"

DIRS = f"""
tj as (select distinct q_id, record_id from judg where q_id in (select q_id from tr)),
e1 as (select tj.record_id, unnest(tr.qv) x, generate_subscripts(tr.qv, 1) i from tj join tr using (q_id)),
csum as (select record_id, list(s order by i) c from (select record_id, i, sum(x) s from e1 group by all) group by record_id),
docs as (select corpus.record_id, {NORM.format(v='corpus.v')} v, csum.c from corpus left join csum using (record_id)),
st as (select record_id, v, c, coalesce(list_dot_product(v, c), 0)::double vtc,
  coalesce(list_dot_product(c, c), 0)::double ctc from docs)"""


def n_coeffs(gamma_src: str, p: str = "co") -> str:
    """{p}4(record_id, g, gamma, a, b, snap) for the gammas in ``gamma_src`` (g, gamma)."""
    return f"""
{p} as (select st.record_id, gm.g, gm.gamma, vtc, ctc, (ctc - vtc*vtc <= 1e-12 or vtc < 0) nu,
  greatest(sqrt(ctc), 1e-12) cn from st, ({gamma_src}) gm),
{p}2 as (select *, case when gamma = 0 or nu then 0.0::double
  else 0.5*sqrt(gamma*(4.0-gamma)/(ctc-vtc*vtc)) end b0 from {p}),
{p}3 as (select *, case when gamma = 0 or nu then 1.0::double else (1.0 - gamma/2.0) - b0*vtc end a0,
  (gamma > 0 and ctc > 0 and vtc/cn >= 1.0 - gamma/2.0) snap from {p}2),
{p}4 as (select record_id, g, gamma, case when snap then 0.0::double else a0 end a,
  case when snap then 1.0/cn else b0 end b, snap from {p}3)"""


GRID_SRC = "select i::int g, i*(0.02::double) gamma from range(25) t(i)"

NGRID = n_coeffs(GRID_SRC) + """,
qd as (select dv.q_id, st.record_id, list_dot_product(dv.qv, st.v) s,
  coalesce(list_dot_product(dv.qv, st.c), 0) t from dv, st),
sc as (select qd.q_id, co4.g, co4.gamma, qd.record_id, round(co4.a*qd.s + co4.b*qd.t, 12) score
  from qd join co4 using (record_id)),
scr as (select * from (select *, row_number() over (partition by g, q_id order by score desc, record_id) rn from sc) where rn <= 1),
dj as (select distinct q_id, record_id from judg where q_id in (select q_id from dv)),
nans as (select q_id, count(*) n_ans from dj group by q_id),
hq as (select scr.g, scr.gamma, scr.q_id, count(dj.record_id) hits from scr left join dj using (q_id, record_id) group by all),
grid as (select g, gamma, sum(hits * (1 // least(n_ans, 1)))::bigint acc_num, count(*)::bigint n_dev,
  sum(hits * (1 // least(n_ans, 1)))::double / count(*) acc from hq join nans using (q_id) group by g, gamma),
bestn as (select gamma, acc from grid order by acc_num desc, gamma asc limit 1)"""


def n_apply(gamma_src: str, name: str = "nt", p: str = "cf") -> str:
    """name(record_id, emb): N update at the gamma from ``gamma_src`` (one row, column gamma)."""
    return n_coeffs(f"select 0 g, gamma from ({gamma_src})", p) + f""",
{name} as (select st.record_id, case when st.c is null or {p}4.b = 0 then st.v
  else list_transform(range(1, len(st.v)+1), lambda i: {p}4.a*st.v[i] + {p}4.b*st.c[i]) end emb
  from st join {p}4 using (record_id))"""


MDIRS = f"""
mv0 as (select record_id, v, case when c is null then null else {NORM.format(v='c')} end u from docs),
mv as materialized (select *, coalesce(u, list_transform(v, lambda x: 0.0::double)) uz from mv0),
pairs as (select distinct q_id, record_id x from judg where q_id in (select q_id from dv)),
px as (select p.q_id, p.x, dv.qv, round(list_dot_product(dv.qv, m.v), 12) sx,
  round(-list_dot_product(dv.qv, m.uz), 12) gx from pairs p join dv using (q_id) join mv m on m.record_id = p.x),
dd as (select px.q_id, px.x, round(list_dot_product(px.qv, m.v), 12) - px.sx ds,
  round(-list_dot_product(px.qv, m.uz), 12) - px.gx dg from px, mv m where m.record_id <> px.x),
iv as (select q_id, x, greatest(0.0, coalesce(max(case when dg > 0 then ds/(dg+1e-8) end), 0.0)) low,
  least(1e8, coalesce(min(case when dg < 0 then ds/(dg+1e-8) end), 1e8)) high,
  sum(case when dg = 0 and ds > 0 then 1 else 0 end)::bigint bad from dd group by q_id, x),
ivv as (select *, (bad = 0 and high >= low) valid from iv),
ev as (select low value, 1 sgn from ivv where valid union all select high, -1 from ivv where valid),
ne as (select value, sum(sgn)::bigint net from ev group by value),
cu as (select value, net, sum(net) over (order by value rows between unbounded preceding and current row)::bigint total from ne),
bestm0 as (select value, total from cu order by total desc, value asc limit 1),
bestm as (select case when total > 0 then value else 0.0 end gamma, case when total > 0 then total else 0 end overlap from bestm0
  union all select 0.0, 0 where not exists (select 1 from bestm0))"""

MAPPLY = """
mt as (select mv.record_id, case when mv.u is null then mv.v
  else list_transform(range(1, len(mv.v)+1), lambda i: mv.v[i] + bm.gamma*mv.u[i]) end emb from mv, bestm bm)"""


def long_form(src: str, id_col: str = "record_id", vec: str = "emb") -> str:
    return (f"select {id_col}, (i - 1)::bigint dim, {r6('x')} value from "
            f"(select {id_col}, unnest({vec}) x, generate_subscripts({vec}, 1) i from {src})")


def topk(name: str, queries: str, corpus: str, k: int, cos: bool = True, extra: str = "") -> str:
    """name(q_id, rank, record_id, score) over corpus(record_id, emb); ``extra`` is a
    second corpus (record_id, emb) always scored with cosine."""
    cv = NORM.format(v="c.emb") if cos else "c.emb"
    src = f"select q.q_id, c.record_id, round(list_dot_product(q.qv, {cv}), 12) score from {queries} q, {corpus} c"
    if extra:
        src += (f" union all select q.q_id, c.record_id, round(list_dot_product(q.qv, {NORM.format(v='c.emb')}), 12)"
                f" from {queries} q, {extra} c")
    return f"""
{name} as (select q_id, rank, record_id, score from (select *, (row_number() over
  (partition by q_id order by score desc, record_id) - 1)::bigint rank from ({src})) where rank < {k})"""


def metrics_ctes(top: str, queries: str, metrics, name: str = "pq") -> str:
    """name(q_id, <metric>_<k> ...) per judged query."""
    maxk = max(k for _, k in metrics)
    hs, ids, outs = [], [], []
    for t, k in metrics:
        if t == "recall":
            hs.append(f"sum(case when rank < {k} then 1 else 0 end) h_{t}_{k}")
            outs.append(f"(coalesce(h_{t}_{k}, 0) / least(n_true, {k}))::double {t}_{k}")
        else:
            hs.append(f"sum(case when rank < {k} then g/log2(rank+2) else 0 end) h_{t}_{k}")
            ids.append(f"sum(case when rn < {k} then g/log2(rn+2) else 0 end) i_{t}_{k}")
            outs.append(f"(coalesce(h_{t}_{k}, 0) / nullif(i_{t}_{k}, 0))::double {t}_{k}")
    ideal = ""
    join_ideal = ""
    if ids:
        ideal = f""",
{name}_id as (select q_id, {', '.join(ids)} from (select q_id, g, row_number() over
  (partition by q_id order by g desc, record_id) - 1 rn from {name}_j) group by q_id)"""
        join_ideal = f" left join {name}_id using (q_id)"
    return f"""
{name}_g as (select max(rel) > 1 graded from judg where q_id in (select q_id from {queries})),
{name}_j as (select q_id, record_id, case when (select graded from {name}_g) then max(rel)::double else 1.0 end g
  from judg where q_id in (select q_id from {queries}) group by q_id, record_id),
{name}_n as (select q_id, count(*) n_true from {name}_j group by q_id),
{name}_h as (select q_id, {', '.join(hs)} from (select t.q_id, t.rank, j.g from {top} t
  join {name}_j j using (q_id, record_id) where t.rank < {maxk}) group by q_id){ideal},
{name} as (select q_id, {', '.join(outs)} from (select distinct q_id from {name}_j)
  left join {name}_n using (q_id) left join {name}_h using (q_id){join_ideal})"""
