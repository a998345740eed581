"""Brute-force SQL oracles (DuckDB) of the neighbour family, keyed like queries_knn.QUERIES."""

from __future__ import annotations

from .oracles import quota_ctes, r6

E = """e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, CAST(label = 0 AS INTEGER) AS label
          FROM embeddings),
minl AS (SELECT label AS lbl FROM e GROUP BY label ORDER BY count(*), label LIMIT 1),
cnt AS (SELECT count(*) FILTER (WHERE label = (SELECT lbl FROM minl)) AS n_min,
               count(*) FILTER (WHERE label <> (SELECT lbl FROM minl)) AS n_maj FROM e),
m AS (SELECT * FROM e WHERE label = (SELECT lbl FROM minl))"""


def d2(a: str, b: str, metric: str = "euclidean") -> str:
    term = "(x[1] - x[2]) * (x[1] - x[2])" if metric == "euclidean" else "abs(x[1] - x[2])"
    return f"list_sum(list_transform(list_zip({a}.f, {b}.f), lambda x: {term}))"


def knn(name: str, q: str, r: str, k: int, metric: str = "euclidean", exclude_self: bool = True) -> str:
    """'{name}': (qid, rank, rid, d) with d squared for euclidean."""
    cond = "WHERE a.id <> b.id" if exclude_self else ""
    return f"""{name} AS (SELECT qid, rid, d, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rank
   FROM (SELECT a.id AS qid, b.id AS rid, {d2('a', 'b', metric)} AS d FROM {q} a, {r} b {cond})
   QUALIFY rank <= {k})"""


def u(base: str, j: str, seed: int, tag: str) -> str:
    s = f"CAST({base} AS VARCHAR) || '|' || CAST({j} AS VARCHAR) || '|{seed}|{tag}'"
    return f"(('0x' || substr(md5({s}), 1, 8))::BIGINT / CAST(4294967296.0 AS DOUBLE))"


def synth(copies: str, nn: str, k: int, seed: int, out: str) -> str:
    """'{out}': synthetic rows (id, f, label, is_synthetic, base_id, neighbor_id, gap)."""
    return f"""{out}_m AS (SELECT max(g) + 1 AS mult FROM {copies}),
{out}_s AS (SELECT c.id AS base_id, c.r, t.j FROM {copies} c, generate_series(1, CAST(c.g AS BIGINT)) t(j) WHERE c.g > 0),
{out}_d AS (SELECT base_id, r, j, CAST(floor({u('base_id', 'j', seed, 'nn')} * {k}) + 1 AS BIGINT) AS nn_rank,
                   {u('base_id', 'j', seed, 'gap')} AS gap FROM {out}_s),
{out} AS (SELECT -(d.r * mm.mult + d.j) AS id,
                 list_transform(list_zip(b.f, n.f), lambda x: x[1] + d.gap * (x[2] - x[1])) AS f,
                 b.label, 1 AS is_synthetic, d.base_id, nn.rid AS neighbor_id, d.gap
          FROM {out}_d d JOIN {nn} nn ON nn.qid = d.base_id AND nn.rank = d.nn_rank
          JOIN m b ON b.id = d.base_id JOIN m n ON n.id = nn.rid, {out}_m mm)"""


ORIG = "SELECT id, f, label, 0 AS is_synthetic, CAST(NULL AS BIGINT) AS base_id, CAST(NULL AS BIGINT) AS neighbor_id, " \
       "CAST(NULL AS DOUBLE) AS gap FROM e"


def smote_ctes(ratio: float = 1.0, seed: int = 42, out: str = "bal") -> str:
    return E + ",\n" + knn("nnm", "m", "m", 5) + f""",
par AS (SELECT n_min, CAST(floor(CAST({ratio} AS DOUBLE) * n_maj - n_min) AS BIGINT) AS n_new FROM cnt),
rk AS (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '|{seed}'), id) AS r FROM m),
cp AS (SELECT id, r, n_new // n_min + CASE WHEN r <= n_new % n_min THEN 1 ELSE 0 END AS g FROM rk, par),
""" + synth("cp", "nnm", 5, seed, "syn") + f""",
{out} AS ({ORIG} UNION ALL SELECT * FROM syn)"""


def adasyn_ctes(seed: int = 42, out: str = "bal") -> str:
    return E + ",\n" + knn("nna", "m", "e", 5) + ",\n" + knn("nnm", "m", "m", 5) + f""",
hard AS (SELECT qid, count(*) FILTER (WHERE x.label <> (SELECT lbl FROM minl)) AS cnt
         FROM nna JOIN e x ON x.id = nna.rid GROUP BY qid),
tot AS (SELECT sum(cnt) AS s, (SELECT n_maj - n_min FROM cnt) AS gg FROM hard),
rk AS (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '|{seed}'), id) AS r FROM m),
gq AS (SELECT qid, (cnt * gg) // s AS q, (cnt * gg) % s AS rem, s FROM hard, tot),
cp AS (SELECT rk.id, rk.r, q + CASE WHEN 2 * rem > s OR (2 * rem = s AND q % 2 = 1) THEN 1 ELSE 0 END AS g
       FROM rk JOIN gq ON gq.qid = rk.id),
""" + synth("cp", "nnm", 5, seed, "syn") + f""",
{out} AS ({ORIG} UNION ALL SELECT * FROM syn)"""


def summary(src: str) -> str:
    return (f"SELECT id, label, is_synthetic, base_id, neighbor_id, {r6('gap')} AS gap, "
            f"{r6('list_sum(f)')} AS f_sum, {r6('list_sum(list_transform(f, lambda x: x * x))')} AS f_sq FROM {src}")


def tomek_ctes(src: str, out: str) -> str:
    return knn(f"{out}_nn", src, src, 1) + f""",
{out} AS (SELECT a.qid AS id_a, a.rid AS id_b, la.label AS label_a, lb.label AS label_b
          FROM {out}_nn a JOIN {out}_nn b ON a.qid = b.rid AND a.rid = b.qid
          JOIN {src} la ON la.id = a.qid JOIN {src} lb ON lb.id = a.rid
          WHERE la.label <> lb.label AND a.qid < a.rid)"""


def _w(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _knn_cls(weights: str) -> str:
    split = quota_ctes("e", "label", "t", "ceil(CAST(0.3 AS DOUBLE) * sum(c))") + """,
rk AS (SELECT e.*, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) AS r FROM e),
sp AS (SELECT rk.*, CASE WHEN r <= q THEN 'test' ELSE 'train' END AS split FROM rk JOIN t_q ON rk.label = t_q.lbl),
trn AS (SELECT id, f, label FROM sp WHERE split = 'train'), tst AS (SELECT id, f, label FROM sp WHERE split = 'test')"""
    if weights == "uniform":
        w = "1.0"
    else:
        w = "CASE WHEN zero THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / sqrt(d) END"
    return _w(E + "," + split + ",\n" + knn("nn", "tst", "trn", 5, exclude_self=False) + f""",
v AS (SELECT nn.qid, nn.d, x.label AS rl, bool_or(nn.d = 0) OVER (PARTITION BY nn.qid) AS zero
      FROM nn JOIN trn x ON x.id = nn.rid),
agg AS (SELECT qid, sum(CASE WHEN rl = 1 THEN {w} ELSE 0 END) AS w1, sum({w}) AS wa FROM v GROUP BY qid)""",
              f"""SELECT t.id, t.label, CAST(w1 > wa - w1 AS INTEGER) AS prediction, {r6('w1 / wa')} AS score
              FROM tst t JOIN agg ON agg.qid = t.id""")


ORACLES = {
    "knn_join_euclidean": _w(E + ",\n" + knn("nn", "e", "e", 5),
                             f"SELECT qid, CAST(rank AS BIGINT) AS rank, rid, {r6('sqrt(d)')} AS distance FROM nn"),
    "knn_join_manhattan": _w(E + ",\n" + knn("nn", "e", "e", 5, "manhattan"),
                             f"SELECT qid, CAST(rank AS BIGINT) AS rank, rid, {r6('d')} AS distance FROM nn"),
    "smote": _w(smote_ctes(1.0), summary("bal")),
    "smote_partial": _w(smote_ctes(0.75), summary("bal")),
    "adasyn": _w(adasyn_ctes(), summary("bal")),
    "tomek_links": _w(E + ",\n" + tomek_ctes("e", "tl"), "SELECT * FROM tl"),
    "smote_tomek": _w(smote_ctes(1.0) + ",\n" + tomek_ctes("bal", "tl") + """,
ends AS (SELECT id_a AS id FROM tl UNION SELECT id_b FROM tl)""",
                      "SELECT id, label, is_synthetic FROM bal WHERE id NOT IN (SELECT id FROM ends)"),
    "near_miss": _w(E + ",\n" + knn("nn", "(SELECT * FROM e WHERE label <> (SELECT lbl FROM minl))", "m", 3,
                                    exclude_self=False) + """,
av AS (SELECT qid, list_reduce(list_sort(list(sqrt(d))), lambda a, b: a + b) / 3 AS avg_d FROM nn GROUP BY qid),
keep AS (SELECT qid FROM av ORDER BY avg_d, qid LIMIT (SELECT n_min FROM cnt))""",
                    "SELECT id, label FROM m UNION ALL SELECT e.id, e.label FROM e JOIN keep ON keep.qid = e.id"),
    "balance_fallback_report": _w(adasyn_ctes(), """SELECT CASE WHEN (SELECT s FROM tot) > 0 THEN 'B3_ADASYN'
        ELSE 'B2_SMOTE' END AS balancer, label, count(*) AS n_rows FROM bal GROUP BY label"""),
    "knn_classifier_uniform": _knn_cls("uniform"),
    "knn_classifier_distance": _knn_cls("distance"),
}
ORACLES |= {name + tail: ORACLES[name + tail.replace("_blocks", "")] for name, tail in (
    ("knn_join", "_blocks_euclidean"), ("knn_join", "_blocks_manhattan"), ("adasyn", "_blocks"), ("tomek_links", "_blocks"), ("near_miss", "_blocks"))}
