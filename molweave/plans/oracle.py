"""The same results in ANSI SQL, as text for a second engine."""

from __future__ import annotations

from molweave.operators.sketches import PRIME, permutations
from molweave.plans.queries import BITS, MINHASHES, PLAIN, SAMPLES, SIGNS


def _token(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 15) as bigint)"


N = "n as (select distinct graph_id, node_id, element, aromatic, charge, hcount from nodes where graph_id is not null and node_id is not null)"
E = "e as (select distinct graph_id, least(u, v) as u, greatest(u, v) as v, bond_order from edges where graph_id is not null and u is not null and v is not null)"
WAYS = "w as (select graph_id, u as src, v as dst from e union all select graph_id, v, u from e)"
DEGREE = "d as (select n.graph_id, n.node_id, count(w.src) as degree from n left join w on n.graph_id = w.graph_id and n.node_id = w.src group by all)"
INNER = "i as (select e.* from e semi join n on e.graph_id = n.graph_id and e.u = n.node_id), j as (select i.* from i semi join n on i.graph_id = n.graph_id and i.v = n.node_id)"
BOND = "coalesce(cast(cast(round(bond_order * 10) as bigint) as varchar), '~')"
ATOMS = "a as (select graph_id, node_id, concat_ws('|', coalesce(element, '~'), coalesce(cast(aromatic as varchar), '~'), coalesce(cast(charge as varchar), '~'), coalesce(cast(hcount as varchar), '~'), cast(degree as varchar)) as label from n join d using (graph_id, node_id))"
BASE = f"with {N}, {E}, {WAYS}, {DEGREE}, {INNER}, {ATOMS}"
SIDE = "try_cast(split_part(graph_id, ':', 1) as bigint) as reaction_id, split_part(graph_id, ':', 2) as side"

T = """t as (
  select reaction_id, side, token, cast(sum(cnt) as bigint) as cnt
  from (select distinct reaction_id, side, token, chunk, cnt, loaded_at from tokens where reaction_id is not null and side in ('R', 'P') and token is not null and cnt > 0) group by all)"""
D = "delta as (select reaction_id, token, cast(sum(case when side = 'P' then cnt else -cnt end) as bigint) as delta from t group by all having sum(case when side = 'P' then cnt else -cnt end) <> 0)"
U = "uni as (select reaction_id, token, cast(sum(cnt) as bigint) as cnt from t group by all)"
S = "s as (select reaction_id, token * 2 + case when delta < 0 then 1 else 0 end as enc from delta)"


def _refined(radius: int, tags: tuple[str, str, str] = ("a0", "b", "wl"), atoms: str = ATOMS, bond: str = BOND) -> str:
    first, b, step = tags
    parts = [f"with {N}, {E}, {WAYS}, {DEGREE}, {INNER}, {atoms}", f"l0 as (select graph_id, node_id, {_token(f"'{first}|' || label")} as token from a)"]
    parts.append(
        f"x as (select graph_id, u as src, v as dst, lpad(cast({_token(f"'{b}|' || {bond}")} as varchar), 19, '0') as b from j "
        f"union all select graph_id, v, u, lpad(cast({_token(f"'{b}|' || {bond}")} as varchar), 19, '0') from j)"
    )
    for k in range(1, radius + 1):
        parts.append(
            f"r{k} as (select x.graph_id, x.src as node_id, string_agg(x.b || ':' || lpad(cast(l.token as varchar), 19, '0'), ',' order by x.b || ':' || lpad(cast(l.token as varchar), 19, '0')) as around "
            f"from x join l{k - 1} l on x.graph_id = l.graph_id and x.dst = l.node_id group by all)"
        )
        parts.append(f"l{k} as (select l.graph_id, l.node_id, {_token(f"'{step}|{k}|' || cast(l.token as varchar) || '|' || coalesce(around, '')")} as token from l{k - 1} l left join r{k} r using (graph_id, node_id))")
    every = " union all ".join(f"select graph_id, token from l{k}" for k in range(radius + 1))
    parts.append(f"tok as (select graph_id, token, count(*) as cnt from ({every}) group by all)")
    return ",\n".join(parts)


def _paths(longest: int, least: int) -> str:
    parts = [BASE, f"y as (select j.graph_id, u as src, v as dst, {BOND} as bond from j where u <> v union all select graph_id, v, u, {BOND} from j where u <> v)"]
    parts.append("z as (select y.*, a.label as next from y join a on y.graph_id = a.graph_id and y.dst = a.node_id)")
    parts.append("p0 as (select graph_id, node_id as last, [node_id] as seen, [label] as labels from a)")
    for k in range(1, longest + 1):
        parts.append(f"p{k} as (select p.graph_id, z.dst as last, list_append(seen, z.dst) as seen, list_concat(labels, [bond, next]) as labels from p{k - 1} p join z on p.graph_id = z.graph_id and p.last = z.src where not list_contains(seen, z.dst))")
    every = " union all ".join(f"select graph_id, {_token(f"'path|{k}|' || least(array_to_string(labels, '>'), array_to_string(list_reverse(labels), '>'))")} as token from p{k}" for k in range(least, longest + 1))
    parts.append(f"tok as (select graph_id, token, count(*) as cnt from ({every}) group by all)")
    return ",\n".join(parts)


def _perms(m: int, seed: int = 1) -> str:
    rows = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(permutations(m, seed)))
    return f"perm(i, a, b) as (values {rows})"


def _min_of(hashes: str, m: int) -> str:
    return f"h as ({hashes}), {_perms(m)}, sig as (select reaction_id, perm.i as i, min((cast(perm.a as bigint) * h + perm.b) % {PRIME}) as value from h cross join perm group by all)"


MINHASH = f"with {T}, {D}, {S}, " + _min_of(f"select distinct reaction_id, {_token("'mh|' || cast(enc as varchar)")} % {PRIME} as h from s", MINHASHES)
def _uniform(j: int) -> str:
    return f"((cast('0x' || substr(h, {1 + 6 * j}, 6) as bigint) + cast(0.5 as double)) / cast(16777216.0 as double))"


def _cws(m: int, before: str, seed: int = 1) -> str:
    return f"""{before},
 own as (select reaction_id, case when delta > 0 then '+' else '-' end || '|' || cast(token as varchar) as t, ln(cast(abs(delta) as double) / cast(sum(abs(delta)) over (partition by reaction_id) as double)) as lw from delta),
 drawn as (select *, md5('cws|{seed}|' || cast(i as varchar) || '|' || t) as h from (select *, unnest(range({m})) as i from own)),
 shaped as (select reaction_id, i, t, lw, -(ln({_uniform(0)}) + ln({_uniform(1)})) as r, -(ln({_uniform(2)}) + ln({_uniform(3)})) as c, {_uniform(4)} as b from drawn),
 stepped as (select *, floor(lw / r + b) as step from shaped),
 picked as (select reaction_id, i, arg_min(t || '|' || cast(cast(step as bigint) as varchar), ln(c) - r * (step - b) - r) as v from stepped group by all),
 sig as (select reaction_id, cast(i as int) as i, {_token("'cwv|' || v")} as value from picked)"""


CWS = _cws(SAMPLES, f"with {T}, {D}")
SRP = f"""with {T}, {D},
 coord as (select reaction_id, i, delta * (1 - 2 * (({_token("'srp' || cast(i // 60 as varchar) || '|0|' || cast(token as varchar)")} >> cast(i % 60 as integer)) & 1)) as x from (select *, unnest(range({SIGNS})) as i from delta)),
 sig as (select reaction_id, cast(i as int) as i, case when sum(x) >= 0 then 1 else -1 end as value from coord group by all)"""


def _parity(support: str) -> str:
    return f"bits as (select reaction_id, bit from (select reaction_id, cast({_token("'pf|1|' || cast(enc as varchar)")} % {BITS} as int) as bit, count(*) as n from {support} group by all) where n % 2 = 1)"


def _search(pairs: str, score: str) -> str:
    return f"select query_id, reaction_id, {score}, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by {score} desc, reaction_id) as rank from ({pairs})) where rank <= 5"


SIDE_TOKENS = f"t as (select {SIDE}, token, cast(sum(cnt) as bigint) as cnt from tok group by all)"


def _summary() -> str:
    return f"""with {N}, {E}, nn as (select graph_id, count(*) as n_nodes from n group by all), ee as (select graph_id, count(*) as n_edges from e group by all),
 g as (select coalesce(nn.graph_id, ee.graph_id) as graph_id, n_nodes, n_edges from nn full join ee on nn.graph_id = ee.graph_id),
 k as (select {SIDE}, n_nodes, n_edges from g), r as (select distinct reaction_id from k),
 sm as (select r.reaction_id, q.side, coalesce(k.n_nodes, 0) as n_nodes, coalesce(k.n_edges, 0) as n_edges from r cross join (values ('R'), ('P')) q(side) left join k on k.reaction_id is not distinct from r.reaction_id and k.side = q.side)"""


def _signature_bits(tok: str, combine: str, support: str) -> str:
    return f"{tok}, {SIDE_TOKENS}, {combine}, {support}"


PLAIN_ATOMS = "a as (select graph_id, node_id, concat_ws('|', coalesce(element, '~'), coalesce(cast(aromatic as varchar), '~'), coalesce(cast(charge as varchar), '~'), coalesce(cast(hcount as varchar), '~')) as label from n)"


def _ego_round(k: int) -> str:
    return f"""r{k} as (select w.graph_id, w.center, w.k, w.src as node_id, string_agg(w.bond || ':' || l.t, ',' order by w.bond || ':' || l.t) as around
  from w join l{k - 1} l on w.graph_id = l.graph_id and w.center = l.center and w.k = l.k and w.dst = l.node_id group by all),
 l{k} as (select l.graph_id, l.center, l.k, l.node_id, md5(l.t || '|' || coalesce(around, '')) as t from l{k - 1} l left join r{k} r using (graph_id, center, k, node_id))"""


# Egos are small: two rounds of refinement inside them tell their classes apart.
EGO_CLASSES = f"""with {N}, {E}, {INNER}, {PLAIN_ATOMS},
 y as (select graph_id, u as src, v as dst, {BOND} as bond from j union all select graph_id, v, u, {BOND} from j),
 m as (select graph_id, node_id as center, node_id, 0 as k from n union all select distinct * from (select graph_id, node_id, node_id, 1 from n union all select graph_id, src, dst, 1 from y)),
 l0 as (select m.graph_id, center, k, node_id, label as t from m join a using (graph_id, node_id)),
 w as (select p.graph_id, p.center, p.k, y.src, y.dst, y.bond from m p join y on p.graph_id = y.graph_id and p.node_id = y.src join m q on p.graph_id = q.graph_id and p.center = q.center and p.k = q.k and q.node_id = y.dst),
 {_ego_round(1)}, {_ego_round(2)},
 cls as (select graph_id, center, k, string_agg(t, ',' order by t) as c from l2 group by all),
 tok as (select graph_id, c, count(*) as cnt from cls group by all)
 select graph_id, cnt, cast(sum(cnt) over (partition by c) as bigint) as everywhere, count(*) over (partition by c) as graphs from tok"""


def _rsmi_counts() -> str:
    """Bonds are atoms less molecules plus ring closures, each of which is two digits outside brackets."""
    bare = r"regexp_replace({0}, '\[[^\]]*\]', 'X', 'g')"
    atoms = f"len(regexp_extract_all({bare}, 'Cl|Br|[BCNOPSFIX]|[bcnops]'))"
    bonds = f"{atoms} - len(regexp_extract_all({bare}, '[^.]+')) + len(regexp_extract_all({bare}, '[1-9]')) // 2"
    cells = ", ".join(f"cast({x.replace('{0}', s)} as int) as {n}_{s}" for s in "rp" for x, n in ((atoms, "nodes"), (bonds, "edges")))
    return f"with plain as (select record_id as reaction_id, string_split(rsmi, '>>')[1] as r, string_split(rsmi, '>>')[2] as p from reactions where regexp_full_match(rsmi, '{PLAIN}>>{PLAIN}')) select reaction_id, {cells} from plain"


def oracle_sql() -> dict[str, str]:
    ego = f"{BASE}, y as (select graph_id, u as src, v as dst from j union all select graph_id, v, u from j), h0 as (select graph_id, node_id as center, node_id, 0 as hop from n)"
    for k in (1, 2):
        ego += f", h{k} as (select h.graph_id, center, y.dst as node_id, {k} as hop from h{k - 1} h join y on h.graph_id = y.graph_id and h.node_id = y.src)"
    ego += ", ego as (select graph_id, center, node_id, min(hop) as hop from (select * from h0 union all select * from h1 union all select * from h2) group by all)"
    wl1, wl2 = _refined(1), _refined(2)
    flagship = f"{wl2}, {SIDE_TOKENS}, {D}, {S}, {_parity('s')}"
    union_support = "s as (select reaction_id, token as enc from uni)"
    element = "a as (select graph_id, node_id, concat_ws('|', coalesce(element, '~'), cast(degree as varchar)) as label from n join d using (graph_id, node_id))"
    on = f"{wl1}, {SIDE_TOKENS}, {D}, {S}, bits as (select reaction_id, bit from (select reaction_id, cast({_token("'pf|1|' || cast(enc as varchar)")} % 16 as int) as bit, count(*) as n from s group by all) where n % 2 = 1)"
    path_minhash = f"{_paths(2, 1)}, {SIDE_TOKENS}, {D}, {S}, " + _min_of(f"select distinct reaction_id, {_token("'mh|' || cast(enc as varchar)")} % {PRIME} as h from s", 16)
    wl_srp = f"{wl1}, {SIDE_TOKENS}, {D}, " + SRP.split(D + ",")[1].replace("'|0|'", "'|1|'")
    found = "met as (select q.reaction_id as query_id, x.reaction_id, count(*) as both_bits from bits q join bits x on q.bit = x.bit where q.reaction_id % 100 = 0 and q.reaction_id <> x.reaction_id group by all), ones as (select reaction_id, count(*) as c from bits group by all)"
    return {
        "fingerprint_wl_parity": flagship + " select * from bits",
        "graph_nodes": f"with {N} select * from n",
        "graph_edges_norm": f"with {E} select * from e",
        "graph_adjacency": f"with {E}, f as (select distinct graph_id, u, v from e), w as (select graph_id, u as src, v as dst from f union all select graph_id, v, u from f) select graph_id, src as node_id, string_agg(cast(dst as varchar), ',' order by dst) as neighbours from w group by all",
        "graph_degree": f"with {N}, {E}, {WAYS}, {DEGREE} select * from d",
        "edge_lookup": f"with {E} select graph_id, q.v as a, q.u as b, bond_order from (select distinct graph_id, u, v from edges) q join e using (graph_id) where least(q.u, q.v) = e.u and greatest(q.u, q.v) = e.v",
        "reaction_summary": _summary() + " select * from sm",
        "product_side": _summary() + " select * from sm where side = 'P'",
        "atom_labels": BASE + " select * from a",
        "bond_labels": f"with {E} select graph_id, u, v, {BOND} as label from e",
        "wl_tokens_r0": _refined(0) + " select * from tok",
        "wl_tokens_r1": wl1 + " select * from tok",
        "wl_tokens_r2": wl2 + " select * from tok",
        "wl_tokens_element": _refined(1, atoms=element, bond="''") + " select * from tok",
        "wl_tokens_joined": wl2 + " select * from tok",
        "wl_label_tokens_r1": f"{_refined(1, ('n0', 'nb', 'nw'))}, again as (select graph_id, {_token("'nxwl|0|' || cast(token as varchar)")} as token from l0 union all select graph_id, {_token("'nxwl|1|' || cast(token as varchar)")} from l1) select graph_id, token, count(*) as cnt from again group by all",
        "wl_label_tokens_unbonded": f"{_refined(0, ('n0', 'nb', 'nw'))}, m1 as (select graph_id, {_token("'nw|1|' || cast(token as varchar) || '|'")} as token from l0), again as (select graph_id, {_token("'nxwl|0|' || cast(token as varchar)")} as token from l0 union all select graph_id, {_token("'nxwl|1|' || cast(token as varchar)")} from m1) select graph_id, token, count(*) as cnt from again group by all",
        "morgan_tokens_r2": _refined(2, ("m0", "mb", "morgan")) + " select * from tok",
        "tokens_side": f"{wl1}, {SIDE_TOKENS} select * from t",
        "path_tokens_l1_3": _paths(3, 1) + " select * from tok",
        "path_tokens_minpath2": _paths(2, 2) + " select * from tok",
        "ego_nodes_r2": ego + " select * from ego",
        "ego_edges_r2": ego + " select j.graph_id, p.center, j.u, j.v from j join ego p on j.graph_id = p.graph_id and j.u = p.node_id join ego q on j.graph_id = q.graph_id and j.v = q.node_id and p.center = q.center",
        "ego_tokens_blind_r0": f"{BASE}, loops as (select distinct graph_id, u from j where u = v) select n.graph_id, {_token("'ego|' || case when loops.u is null then '||' else '||0,0,' end")} as token, count(*) as cnt from n left join loops on n.graph_id = loops.graph_id and n.node_id = loops.u group by all",
        "clean_tokens": f"with {T} select * from t",
        "delta_tokens": f"with {T}, {D} select * from delta",
        "union_tokens": f"with {T}, {U} select * from uni",
        "signed_support": f"with {T}, {D}, {S} select * from s",
        "pos_neg_maps": f"with {T}, {D} select reaction_id, token, greatest(delta, 0) as pos, greatest(-delta, 0) as neg from delta",
        "l1_weights": f"with {T}, {D} select reaction_id, token, cast(delta as double) / sum(abs(delta)) over (partition by reaction_id) as w from delta",
        "vocab_rank": f"with {T}, {D} select reaction_id, token, cast(row_number() over (partition by reaction_id order by token) - 1 as int) as rank from delta",
        "dense_vectors": f"with {T}, {D}, ranked as (select reaction_id, delta, row_number() over (partition by reaction_id order by token) - 1 as r, count(*) over (partition by reaction_id) as n from delta) select reaction_id, cast(r as int) as i, cast(greatest(delta, 0) as double) as value from ranked union all select reaction_id, cast(n + r as int), cast(greatest(-delta, 0) as double) from ranked",
        "odd_tokens": f"with {T}, {U} select reaction_id, token from uni where cnt % 2 = 1",
        "parity_bits_delta": f"with {T}, {D}, {S}, {_parity('s')} select * from bits",
        "parity_bits_union": f"with {T}, {U}, {union_support}, {_parity('s')} select * from bits",
        "minhash_signature": MINHASH + " select * from sig",
        "minhash_bits": MINHASH + f" select distinct reaction_id, cast(value % {BITS} as int) as bit from sig",
        "cws_samples": CWS + " select * from sig",
        "srp_signs": SRP + " select * from sig",
        "srp_bits": SRP + " select reaction_id, i as bit from sig where value > 0",
        "tanimoto_search": f"with {T}, {D}, {S}, {_parity('s')}, {found} "
        + _search("select query_id, met.reaction_id, cast(both_bits as double) / (qo.c + o.c - both_bits) as tanimoto from met join ones qo on qo.reaction_id = query_id join ones o on o.reaction_id = met.reaction_id", "tanimoto"),
        "weighted_search": f"""with {T}, {D}, norms as (select reaction_id, sum(abs(delta)) as l1, sum(delta * delta) as l2 from delta group by all),
 met as (select q.reaction_id as query_id, x.reaction_id, sum(case when sign(q.delta) = sign(x.delta) then least(abs(q.delta), abs(x.delta)) else 0 end) as low, sum(q.delta * x.delta) as dot
  from delta q join delta x on q.token = x.token where q.reaction_id % 100 = 0 and q.reaction_id <> x.reaction_id group by all)
 select query_id, met.reaction_id, cast(low as double) / cast(qn.l1 + xn.l1 - low as double) as weighted_jaccard, cast(dot as double) / sqrt(cast(qn.l2 * xn.l2 as double)) as cosine
 from met join norms qn on qn.reaction_id = query_id join norms xn on xn.reaction_id = met.reaction_id""",
        "weighted_search_normalized": f"""with {T}, {D}, norms as (select reaction_id, sum(abs(delta)) as l1, sum(delta * delta) as l2 from delta group by all),
 met as (select q.reaction_id as query_id, x.reaction_id, sum(case when sign(q.delta) = sign(x.delta) then least(abs(q.delta) * xn.l1, abs(x.delta) * qn.l1) else 0 end) as low, sum(q.delta * x.delta) as dot
  from delta q join delta x on q.token = x.token join norms qn on qn.reaction_id = q.reaction_id join norms xn on xn.reaction_id = x.reaction_id where q.reaction_id % 100 = 0 and q.reaction_id <> x.reaction_id group by all)
 select query_id, met.reaction_id, cast(low as double) / cast(2 * qn.l1 * xn.l1 - low as double) as weighted_jaccard, cast(dot as double) / sqrt(cast(qn.l2 * xn.l2 as double)) as cosine
 from met join norms qn on qn.reaction_id = query_id join norms xn on xn.reaction_id = met.reaction_id""",
        "minhash_search": MINHASH + " " + _search(f"select q.reaction_id as query_id, x.reaction_id, sum(case when q.value = x.value then 1 else 0 end) / cast({MINHASHES} as double) as jaccard from sig q join sig x on q.i = x.i where q.reaction_id % 100 = 0 and q.reaction_id <> x.reaction_id group by all", "jaccard"),
        "srp_cosine_search": SRP + " " + _search(f"select q.reaction_id as query_id, x.reaction_id, sum(case when q.value = x.value then 1 else 0 end) / cast({SIGNS} as double) * 2 - 1 as cosine from sig q join sig x on q.i = x.i where q.reaction_id % 100 = 0 and q.reaction_id <> x.reaction_id group by all", "cosine"),
        "fingerprint_morgan_union": f"{_refined(1, ('m0', 'mb', 'morgan'))}, {SIDE_TOKENS}, {U}, {union_support}, {_parity('s')} select * from bits",
        "fingerprint_path_minhash": path_minhash + f" select distinct reaction_id, cast(value % {BITS} as int) as bit from sig",
        "fingerprint_wl_srp": wl_srp + " select reaction_id, i as bit from sig where value > 0",
        "fingerprint_matrix_wide": f"{on}, r as (select distinct {SIDE} from nodes), rr as (select distinct reaction_id from r) select rr.reaction_id, "
        + ", ".join(f"max(case when bit = {i} then 1 else 0 end) as b_{i}" for i in range(16))
        + " from rr left join bits on rr.reaction_id = bits.reaction_id group by rr.reaction_id",
        "fingerprint_results": f"{wl1}, {SIDE_TOKENS}, {D}, {S}, stages as (select reaction_id, lower(side) as stage, token, cnt from t union all select reaction_id, 'delta', token, delta from delta union all select reaction_id, 'support', enc, 1 from s) select reaction_id, 'delta' as mode, stage, token, cnt from stages",
        "signature_classes": f"{_refined(4, atoms=PLAIN_ATOMS)}, whole as (select graph_id, string_agg(cast(token as varchar) || 'x' || cast(cnt as varchar), ',' order by token) as c from tok group by all) select graph_id, count(*) over (partition by c) as alike from whole",
        "ego_classes_r1": EGO_CLASSES,
        "rsmi_counts": _rsmi_counts(),
        "stream_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all",
    }
