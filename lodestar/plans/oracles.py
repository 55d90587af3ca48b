"""Oracle SQL (DuckDB) for every registered query that has one."""
from __future__ import annotations

import re

from .oracle_sql import (DIRS, FX, MAPPLY, MDIRS, NGRID, NORM, SPLITS, long_form, metrics_ctes,
                         n_apply, n_coeffs, r6, sql, topk)

ORACLES: dict[str, str] = {}
BASE = (FX, SPLITS)
ANS = """
ansid as (select distinct record_id from judg where q_id in (select q_id from tr union all select q_id from dv)),
tuned as (select record_id, v emb from corpus where record_id in (select record_id from ansid)),
untouched as (select record_id, v emb from corpus where record_id not in (select record_id from ansid))"""
CORP = "cemb as (select record_id, v emb from corpus)"

ORACLES["topk_cos"] = sql(*BASE, CORP, topk("t", "te", "cemb", 10),
                          select=f"select q_id, rank, record_id, {r6('score')} score from t")
ORACLES["topk_large_queries"] = ORACLES["topk_cos"]
ORACLES["topk_dot"] = sql(*BASE, "sc3 as (select record_id, list_transform(v, lambda x: x*(1.0 + (record_id % 3))) emb from corpus)",
                          topk("t", "te", "sc3", 10, cos=False),
                          select=f"select q_id, rank, record_id, {r6('score')} score from t")
ORACLES["topk_two_corpora"] = sql(*BASE, ANS, "tsc as (select record_id, list_transform(emb, lambda x: x*0.9) emb from tuned)",
                                  topk("t", "dv", "tsc", 10, cos=False, extra="untouched"),
                                  select=f"select q_id, rank, record_id, {r6('score')} score from t")
ORACLES["topk_scores"] = sql(*BASE, CORP, topk("t", "te", "cemb", 5),
                             select=f"select q_id, rank, {r6('score')} score from t")
ORACLES["top1"] = sql(*BASE, CORP, topk("t", "dv", "cemb", 1),
                      select=f"select q_id, record_id, {r6('score')} score from t")
ORACLES["candidate_narrowing"] = sql(*BASE, ANS, CORP, topk("t", "dv", "cemb", 15), select="""
select record_id from tuned union all
select distinct record_id from t where record_id in (select record_id from untouched)""")
ORACLES["l2_normalize"] = sql(*BASE, "qq as (select q_id record_id, qv emb from q where split='test')",
                              select=long_form("qq"))
ORACLES["vector_sum"] = sql(*BASE, DIRS, "cc as (select record_id, c emb from docs where c is not null)",
                            select=long_form("cc"))
ORACLES["n_stats"] = sql(*BASE, DIRS, select=f"""
select record_id, {r6('vtc')} vtc, {r6('ctc')} ctc, (ctc - vtc*vtc <= 1e-12 or vtc < 0) no_update from st""")
ORACLES["n_closed_form"] = sql(*BASE, DIRS, n_apply("select 0.2::double gamma", p="co"), select=long_form("nt"))
ORACLES["n_snap"] = sql(*BASE, DIRS, n_coeffs("select 0 g, 0.3::double gamma"),
                        select=f"select record_id, {r6('a')} a, {r6('b')} b, snap from co4")
ORACLES["n_accuracy_grid"] = sql(*BASE, DIRS, NGRID,
                                 select=f"select g::bigint g, {r6('gamma')} gamma, acc_num, n_dev, {r6('acc')} acc from grid")
ORACLES["n_best_gamma"] = sql(*BASE, DIRS, NGRID, select=f"select {r6('gamma')} gamma, {r6('acc')} acc from bestn")
ORACLES["tune_n"] = sql(*BASE, DIRS, NGRID, n_apply("select gamma from bestn"), select=long_form("nt"))
ORACLES["tune_equivalence"] = sql(*BASE, ANS, DIRS, NGRID, n_apply("select gamma from bestn"),
                                  "ntt as (select * from nt where record_id in (select record_id from tuned))",
                                  select=long_form("ntt"))
ORACLES["m_direction"] = sql(*BASE, DIRS, MDIRS, "uu as (select record_id, u emb from mv where u is not null)",
                             select=long_form("uu"))
ORACLES["m_intervals"] = sql(*BASE, DIRS, MDIRS, select=f"""
select q_id, x, {r6('low')} low, {r6('high')} high, bad, valid from ivv""")
ORACLES["m_sweep"] = sql(*BASE, DIRS, MDIRS, select=f"select {r6('value')} value, net, total from cu")
ORACLES["m_apply"] = sql(*BASE, DIRS, MDIRS, """
ma as (select record_id, case when u is null then v else list_transform(range(1, len(v)+1), lambda i: v[i] + 1.0*u[i]) end emb from mv)""",
                         select=long_form("ma"))
ORACLES["tune_m"] = sql(*BASE, DIRS, MDIRS, MAPPLY, select=long_form("mt"))
ORACLES["m_best_gamma"] = sql(*BASE, DIRS, MDIRS, select=f"select {r6('gamma')} gamma, overlap::bigint overlap from bestm")
ORACLES["recall_at_k"] = sql(*BASE, CORP, topk("t", "te", "cemb", 10),
                             metrics_ctes("t", "te", [("recall", 1), ("recall", 10)]),
                             select=f"select q_id, {r6('recall_1')} recall_1, {r6('recall_10')} recall_10 from pq")
ORACLES["ndcg_at_k"] = sql(*BASE, CORP, topk("t", "te", "cemb", 10),
                           metrics_ctes("t", "te", [("ndcg", 1), ("ndcg", 5), ("ndcg", 10)]),
                           select=f"select q_id, {r6('ndcg_1')} ndcg_1, {r6('ndcg_5')} ndcg_5, {r6('ndcg_10')} ndcg_10 from pq")
_SUITE = [(t, k) for t in ("recall", "ndcg") for k in (1, 5, 10, 20, 40)]
ORACLES["metric_suite"] = sql(*BASE, CORP, topk("t", "te", "cemb", 40), metrics_ctes("t", "te", _SUITE),
                              select="select " + ", ".join(f"{r6(f'avg({t}_{k})')} {t}_{k}" for t, k in _SUITE)
                              + ", count(*)::bigint n_queries from pq")
ORACLES["hit_at_1"] = sql(*BASE, CORP, topk("t", "dv", "cemb", 1), """
dj1 as (select distinct q_id, record_id from judg where q_id in (select q_id from dv))""", select=f"""
select {r6('avg(case when dj1.record_id is not null then 1.0 else 0.0 end)')} hit_at_1, count(*)::bigint n_queries
from (select distinct q_id from dj1) qq left join t using (q_id) left join dj1 using (q_id, record_id)""")

# ---------------------------------------------------------------- datasets
KILT = """
np_ as (select count(*) n from pages),
kq as (select conv_id, text input from conversations where turn = 0),
flat as (select distinct c.conv_id::varchar id, ((c.conv_id*31 + c.turn*7) % (select n from np_))::varchar wikipedia_id,
  (c.turn % 4)::bigint start_paragraph_id from conversations c
  where c.turn > 0 and c.role = 'assistant' and c.conv_id in (select conv_id from kq))"""
CQ = """
cq as (select b.item_id q_id, d.doc_id, coalesce(l.quality + 1, 1)::int rel from documents d
  join benchmark b on contains(d.text, b.text) left join labels l on l.doc_id = d.doc_id)"""
ORACLES["provenance_flatten"] = sql(KILT, select="select id, wikipedia_id, start_paragraph_id from flat")
ORACLES["queries_without_provenance"] = sql(KILT, select="""
select conv_id::varchar id, input from kq where conv_id::varchar in (select id from flat)""")
ORACLES["referenced_pages"] = sql(KILT, select="select distinct wikipedia_id from flat")
ORACLES["passage_explode"] = sql(KILT, select=r"""
select page_id::varchar doc_id, (i - 1)::varchar passage_id, regexp_replace(t, '\s+$', '') text
from (select page_id, unnest(string_split(html, '<p>')) t, generate_subscripts(string_split(html, '<p>'), 1) i from pages)
where page_id::varchar in (select wikipedia_id from flat)""")
ORACLES["doc_dedup_first"] = sql("""
u as (select doc_id, text, 0 src from documents where lang = 'en'
  union all select doc_id, case when n_chars < 500 then null else text end, 1 from documents
  union all select doc_id, text || ' [c]', 2 from documents)""",
                                 select="select doc_id, md5(arg_min(text, src)) text_md5 from u where text is not null group by doc_id")
ORACLES["query_dedup_text"] = sql("""
qf as (select doc_id q_id, text input, doc_id pos, coalesce(least(floor(try_cast(substr(source, 4) as int) / 7), 2), 2) file from documents)""",
                                  select="""select md5(input) input_md5, first(q_id order by file, pos) q_id
from qf group by input""")
ORACLES["judgment_sets"] = sql(CQ, select="""
select q_id, 0::bigint part, string_agg(doc_id::varchar, ',' order by doc_id) answers,
  string_agg(doc_id::varchar || ':' || rel::varchar, ',' order by doc_id) rels
from (select q_id, doc_id, max(rel) rel from cq group by q_id, doc_id) group by q_id""")
ORACLES["referential_check"] = sql(CQ, select="select item_id q_id from benchmark where item_id not in (select q_id from cq)")
ORACLES["referential_repair"] = sql(CQ, select="""
select item_id q_id from benchmark where item_id not in
  (select q_id from cq where doc_id not in (select doc_id from labels))""")
ORACLES["passage_ids"] = sql("x as (select 1)", select="select doc_id, '0' passage_id from documents")
ORACLES["pool_splits"] = sql("""
gr as (select d.lang, max(l.quality + 1 > 1) g from documents d join labels l using (doc_id) group by d.lang),
al as (select bool_and(coalesce(gr.g, false)) w from (select distinct lang from documents) s left join gr on gr.lang is not distinct from s.lang)""",
                             select="select doc_id q_id, lang pre_split, (select w from al) with_rels from documents")
ORACLES["random_split"] = sql(*BASE, """
n as (select count(*) n from q),
sz as (select n, n - least(10000, floor(0.1::double * n)) - least(10000, floor(0.2::double * n)) ntr,
  least(10000, floor(0.1::double * n)) ndev from n),
pm as (select q_id, row_number() over (order by md5('0:' || q_id::varchar), q_id) - 1 perm from q)""", select="""
select q_id, case when perm < ntr then 'train' when perm < ntr + ndev then 'dev' else 'test' end split from pm, sz""")
ORACLES["record_ids"] = sql("x as (select 1)", select="select doc_id, (row_number() over (order by doc_id) - 1)::bigint record_id from documents")
ORACLES["judged_queries"] = sql(CQ, select="select distinct q_id from cq")
TFO = """
tdq as (select q_id from q where split in ('train', 'dev')),
ta as (select distinct record_id from judg where q_id in (select q_id from tdq)),
tfo as (select record_id, (row_number() over (order by case when record_id in (select record_id from ta) then 0 else 1 end,
  record_id) - 1)::bigint new_id from corpus)"""
ORACLES["train_first_reorder"] = sql(*BASE, TFO, select="select record_id, new_id from tfo")
ORACLES["answerable_cut"] = sql(*BASE, TFO, """
mm as (select max(t.new_id) + 1 m from judg j join tfo t using (record_id) where j.q_id in (select q_id from tdq))""",
                                select="select new_id record_id, case when new_id < (select m from mm) then 'answerable' else 'nontrain' end part from tfo")
ORACLES["with_rels"] = sql(*BASE, select="select split, max(rel) > 1 with_rels from judg join q using (q_id) group by split")
ORACLES["key_resolution"] = sql(CQ, """
rec as (select doc_id, (row_number() over (order by doc_id) - 1)::bigint record_id from documents)""",
                                select="select q_id, record_id, max(rel)::bigint rel from cq join rec using (doc_id) group by q_id, record_id")
ORACLES["judgment_long"] = sql(CQ, select="select q_id, doc_id record_id, max(rel)::bigint rel from cq group by q_id, doc_id")
ORACLES["caption_explode"] = sql("x as (select 1)", select="""
select (row_number() over (order by conv_id, turn) - 1)::bigint q_id, conv_id doc_id, turn pos
from conversations where role = 'user'""")
ORACLES["rekey_per_split"] = sql(*BASE, select="""
select q_id old_q_id, split, (row_number() over (partition by split order by q_id) - 1)::bigint q_id from q""")
# each part is computed once and the two joins are by key: no plan may join vectors with vectors first
ORACLES["training_pairs"] = re.sub(r"(?m)(^|with )(\w+) as \(", r"\1\2 as materialized (", sql(*BASE, """
tj as (select distinct q_id, record_id from judg where q_id in (select q_id from tr)),
tq as (select tj.q_id, tj.record_id, tr.qv from tj join tr on tr.q_id = tj.q_id)""", select=f"""
select tq.q_id, tq.record_id, {r6('list_dot_product(tq.qv, corpus.v)')} score from tq join corpus on corpus.record_id = tq.record_id"""))

# ---------------------------------------------------------------- text
ORACLES["clean_text"] = sql("x as (select 1)", select="""
select doc_id, md5(case when coalesce(replace(text, chr(10), ' '), '') = '' then '.'
  else coalesce(replace(text, chr(10), ' '), '') end) text_md5 from documents""")
ORACLES["truncate_tokens"] = sql("x as (select 1)", select="""
select doc_id, md5(array_to_string(string_split(text, ' ')[1:8191], ' ')) text_md5,
  least(len(string_split(text, ' ')), 8191)::bigint n_tokens from documents""")
ORACLES["query_prefix"] = sql("x as (select 1)", select="select item_id q_id, md5('query: ' || text) input_md5 from benchmark")
ORACLES["length_order"] = sql("x as (select 1)", select="""
select doc_id, length(text)::bigint len, (row_number() over (order by length(text) desc, doc_id) - 1)::bigint pos from documents""")
ORACLES["resume_todo"] = sql("x as (select 1)", select="select doc_id record_id from documents where doc_id not in (select doc_id from labels)")

# ---------------------------------------------------------------- sources
ORACLES["read_records"] = sql("x as (select 1)", select="select doc_id, lang, length(text)::bigint len from documents")
ORACLES["shard_plan"] = sql(*BASE, TFO, """
mm as (select max(t.new_id) + 1 m from judg j join tfo t using (record_id) where j.q_id in (select q_id from tdq)),
nt as (select new_id record_id from tfo where new_id >= (select m from mm)),
lay as (select count(*) n, ceil(count(*) / ((1.0::double / 65536) * 268435456 / 64)) shards from nt),
per as (select ceil(n / shards) per from lay)""", select="""
select record_id, floor((record_id - (select m from mm)) / (select per from per))::bigint shard from nt""")
ORACLES["published_roundtrip"] = sql(*BASE, select="""
select q.split, (row_number() over (partition by q.split order by q.q_id) - 1)::bigint q_id, 0 x, q.q_id old from q""").replace(
    "select q.split", "select q.split", 1)
ORACLES["published_roundtrip"] = sql(*BASE, """
rk as (select split, q_id old, (row_number() over (partition by split order by q_id) - 1)::bigint q_id from q)""",
                                     select="select rk.split, rk.q_id, judg.record_id, judg.rel::bigint rel from judg join rk on rk.old = judg.q_id")

# ---------------------------------------------------------------- adapter
PAIRS = """
tj as (select distinct q_id, record_id from judg where q_id in (select q_id from tr)),
tp as (select tj.q_id, tj.record_id, tr.qv, corpus.v dv from tj join tr using (q_id) join corpus using (record_id)),
bt as (select *, (row_number() over (order by q_id, record_id) - 1) // 32 batch_id from tp),
nb as (select batch_id, q_id, record_id,
  list_transform(qv, lambda x: x/greatest(sqrt(list_dot_product(qv,qv)),1e-12)) yh,
  list_transform(dv, lambda x: x/greatest(sqrt(list_dot_product(dv,dv)),1e-12)) dh from bt)"""
ORACLES["ranking_loss"] = sql(*BASE, PAIRS, """
zz as (select a.batch_id, a.q_id, a.record_id, (a.q_id = b.q_id and a.record_id = b.record_id) diag,
  20.0 * list_dot_product(a.yh, b.dh) * (case when list_dot_product(a.yh, b.dh) >= -1.0 then 1.0 else 0.0 end) z
  from nb a join nb b using (batch_id)),
li as (select batch_id, q_id, record_id, ln(sum(exp(z))) - max(case when diag then z end) l from zz group by all)""",
                              select=f"select batch_id::bigint batch_id, count(*)::bigint n, {r6('avg(l)')} loss from li group by batch_id")
WPAT = """
wq as (select q_id, i, sum(((case when i = j then 1.0 else 0.0 end) + (((i*7 + j*3) % 11) - 5) / 100.0) * x) y
  from (select q_id, unnest(qv) x, generate_subscripts(qv, 1) - 1 j from dv) e, range(64) r(i) group by q_id, i),
aq as (select q_id, list(y order by i) qv from wq group by q_id)"""
ORACLES["adapter_apply"] = sql(*BASE, WPAT, "aqe as (select q_id record_id, qv emb from aq)", select=long_form("aqe"))
ORACLES["adapter_accuracy"] = sql(*BASE, WPAT, CORP, topk("t", "aq", "cemb", 1), """
dj1 as (select distinct q_id, record_id from judg where q_id in (select q_id from dv)),
na as (select q_id, count(*) n from dj1 group by q_id),
hq as (select t.q_id, count(dj1.record_id) hits from t left join dj1 using (q_id, record_id) group by t.q_id)""",
                                  select=f"""select {r6('avg(coalesce(hits, 0) / least(n, 1))')} acc, count(*)::bigint n_queries
from na left join hq using (q_id)""")


# ---------------------------------------------------------------- reports
def _report_sql(summary: bool = False) -> str:
    sel = []
    for i, (name, cor, cos, gam) in enumerate([("no_ft", "cemb", True, "null::double"),
                                               ("n", "nt", True, "(select gamma from bestn)"),
                                               ("m", "mt", False, "(select gamma from bestm)")]):
        sel.append(f"select '{name}' finetuner, 'fixture' q_set, "
                   + ", ".join(f"avg({t}_{k}) {t}_{k}" for t, k in _SUITE)
                   + f", {gam} gamma from pq{i}")
    ctes = [*BASE, CORP, DIRS, NGRID, n_apply("select gamma from bestn"), MDIRS, MAPPLY]
    for i, (cor, cos) in enumerate([("cemb", True), ("nt", True), ("mt", False)]):
        ctes.append(topk(f"tk{i}", "te", cor, 40, cos=cos))
        ctes.append(metrics_ctes(f"tk{i}", "te", _SUITE, name=f"pq{i}"))
    ctes.append("rows_ as (" + " union all ".join(sel) + ")")
    if summary:
        return sql(*ctes, select=f"select finetuner, {r6('avg(recall_1)')} recall_1, {r6('avg(recall_10)')} recall_10, "
                                 f"{r6('avg(ndcg_10)')} ndcg_10 from rows_ group by finetuner")
    return sql(*ctes, select="select finetuner, q_set, " + ", ".join(f"{r6(f'{t}_{k}')} {t}_{k}" for t, k in _SUITE)
               + f", {r6('gamma')} gamma from rows_")


ORACLES["method_report"] = _report_sql()
ORACLES["method_summary"] = _report_sql(True)

# ---------------------------------------------------------------- streaming
ORACLES["embed_stream"] = sql("x as (select 1)", select="select doc_id, 64::bigint dim from documents")

# ---------------------------------------------------------------- more R/F rows
ORACLES["topk_shards"] = ORACLES["topk_cos"]
ORACLES["untouched_competitors"] = sql(*BASE, """
tra as (select distinct record_id from judg where q_id in (select q_id from tr)),
rest as (select record_id, v emb from corpus where record_id not in (select record_id from tra))""",
                                       topk("t", "dv", "rest", 2),
                                       select=f"select q_id, rank, record_id, {r6('score')} score from t")
ORACLES["tune_n_fixed"] = sql(*BASE, DIRS, n_apply("select 0.1::double gamma"), select=long_form("nt"))
ORACLES["axpy"] = sql(*BASE, DIRS, """
ax as (select record_id, list_transform(range(1, len(v)+1), lambda i: 0.25*v[i] + 0.75*c[i]) emb from docs where c is not null)""",
                      select=long_form("ax"))
ORACLES["topk_prefiltered"] = ORACLES["topk_cos"]
ORACLES["read_query_csv"] = """
select doc_id q_id, lang, length(text)::bigint n_chars, sha256(text) input_sha256 from documents"""
ORACLES["embed_batches"] = """
with t as (select doc_id, case when coalesce(text, '') = '' then '.' else replace(text, chr(10), ' ') end x from documents)
select doc_id, len(string_split(x, ' '))::bigint tokens, true fits, """ + ", ".join(
    f"round((('0x' || substr(md5(x), {8 * i + 1}, 8))::bigint / 4294967296.0)::float::double, 6) + 0.0 v{i}" for i in range(4)) + " from t"
ORACLES["published_sets"] = sql(*BASE, """
rk as (select split, q_id old, (row_number() over (partition by split order by q_id) - 1)::bigint q_id from q),
jr as (select rk.split, rk.q_id, judg.record_id, max(judg.rel) rel from judg join rk on rk.old = judg.q_id group by all),
flags as (select split, max(rel) > 1 graded from jr group by split)""",
                                select="select split, q_id, record_id, case when graded then rel::bigint end grade from jr join flags using (split)")
ORACLES["pool_judgments"] = sql(*BASE, """
pooled as (select q_id old, split, (row_number() over (order by case split when 'test' then 0 when 'train' then 1 else 2 end, q_id) - 1)::bigint q_id from q),
jr as (select split, pooled.q_id, judg.record_id, max(judg.rel) rel from judg join pooled on pooled.old = judg.q_id group by all),
flags as (select bool_and(m > 1) and count(*) = 3 graded from (select max(rel) m from jr group by split))""",
                                select="select q_id, record_id, case when graded then rel::bigint end grade from jr, flags")

CITED = """
pages_ as (select page_id::varchar doc_id, unnest(string_split(html, '<p>')) t, generate_subscripts(string_split(html, '<p>'), 1) i from pages),
rec as (select doc_id, (i - 1)::varchar passage_id, (row_number() over (order by doc_id, (i - 1)::varchar) - 1)::bigint record_id from pages_),
cit as (select c.conv_id::varchar q_id, ((c.conv_id*31 + c.turn*7) % (select n from np_))::varchar doc_id, (c.turn % 4)::varchar passage_id,
  max(length(c.text) % 2 + 1)::bigint rel from conversations c
  where c.turn > 0 and c.role = 'assistant' and c.conv_id in (select conv_id from kq) group by all),
lost as (select distinct q_id from cit where not exists (select 1 from rec where rec.doc_id = cit.doc_id and rec.passage_id = cit.passage_id)),
kept as (select conv_id::varchar q_id from kq where conv_id::varchar not in (select q_id from lost)),
res as (select q_id, record_id, max(rel) rel from cit join rec using (doc_id, passage_id) where q_id in (select q_id from kept) group by all)"""
ORACLES["cited_check"] = sql(KILT, CITED, select="select conv_id::varchar q_id from kq where conv_id::varchar not in (select q_id from cit)")
ORACLES["cited_repair"] = sql(KILT, CITED, select="select q_id from kept")
ORACLES["cited_keys"] = sql(KILT, CITED, select="select q_id, record_id, rel from res")
ORACLES["cited_queries"] = sql(KILT, CITED, select="select q_id from kept where q_id in (select q_id from res)")
ORACLES["cited_sets"] = sql(KILT, CITED, select="""
select q_id, 0::bigint part, string_agg(record_id::varchar, ',' order by record_id) answers,
  string_agg(record_id::varchar || ':' || rel::varchar, ',' order by record_id) rels from res group by q_id""")
ORACLES["cited_long"] = sql(KILT, CITED, select="select q_id, record_id, rel from res")

EMB = "e as (select vec_id record_id, embedding::double[] v from embeddings)"
ORACLES["normalize_scaled"] = sql(EMB, """
s as (select record_id, list_transform(v, lambda x: x * (record_id % 5)) v from e),
n as (select record_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) emb from s)""",
                                  select=long_form("n"))
ORACLES["scrub_and_select"] = sql(EMB, """
n as (select record_id, list_transform(v, lambda x, i: case when record_id % 2 = 1 or (record_id % 3 = 0 and i - 1 = record_id % len(v))
  then 0.0::double else x::float::double end) emb from e)""", select=long_form("n"))
ORACLES["truncate_words"] = """
with t as (select doc_id, string_split(case when coalesce(text, '') = '' then '.' else replace(text, chr(10), ' ') end, ' ')[1:77] w from documents)
select doc_id, md5(array_to_string(w, ' ')) text_md5, len(w)::bigint n_tokens from t"""
