"""SQL (DuckDB) for the registered queries."""

CHAIN = """
an AS (SELECT user_id AS graph_id, event_id AS node_id, event_type AS label FROM events),
ae AS (SELECT DISTINCT graph_id, least(a, b) AS u, greatest(a, b) AS v FROM (SELECT user_id AS graph_id, event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL AND a <> b),
aa AS (SELECT graph_id, u, v FROM ae UNION ALL SELECT graph_id, v, u FROM ae),
ap AS (SELECT x.graph_id, x.u AS c, x.v AS a, y.v AS b FROM aa x JOIN aa y ON x.graph_id = y.graph_id AND x.u = y.u AND x.v < y.v),
al AS (SELECT ap.graph_id, c, a, b, least(na.label, nb.label) || '-' || nc.label || '-' || greatest(na.label, nb.label) AS pattern
  FROM ap JOIN an na ON na.graph_id = ap.graph_id AND na.node_id = a JOIN an nb ON nb.graph_id = ap.graph_id AND nb.node_id = b JOIN an nc ON nc.graph_id = ap.graph_id AND nc.node_id = c)"""

FLOW = """
kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)),
ev AS (SELECT user_id AS graph_id, event_id, ts, event_type, id FROM events JOIN kinds USING (event_type)),
bn AS (SELECT DISTINCT graph_id, id AS node_id, event_type AS label FROM ev),
be AS (SELECT DISTINCT graph_id, least(a, b) AS u, greatest(a, b) AS v FROM (SELECT graph_id, id AS a, lead(id) OVER (PARTITION BY graph_id ORDER BY ts, event_id) AS b FROM ev) WHERE b IS NOT NULL AND a <> b),
ba AS (SELECT graph_id, u, v FROM be UNION ALL SELECT graph_id, v, u FROM be),
bd AS (SELECT n.graph_id, n.node_id, count(a.u) AS degree FROM bn n LEFT JOIN ba a ON a.graph_id = n.graph_id AND a.u = n.node_id GROUP BY 1, 2)"""

SUPPLY = """
lines AS (SELECT o_custkey AS graph_id, o_orderkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
cn AS (SELECT o_custkey AS graph_id, o_orderkey * 2 AS node_id, o_orderpriority AS label FROM orders UNION ALL SELECT DISTINCT graph_id, b, 'S' FROM lines),
ce AS (SELECT DISTINCT graph_id, least(a, b) AS u, greatest(a, b) AS v FROM lines),
ca AS (SELECT graph_id, u, v FROM ce UNION ALL SELECT graph_id, v, u FROM ce),
cd AS (SELECT n.graph_id, n.node_id, count(a.u) AS degree FROM cn n LEFT JOIN ca a ON a.graph_id = n.graph_id AND a.u = n.node_id GROUP BY 1, 2),
cs AS (SELECT graph_id, count(*) AS nodes, CAST(sum(degree) // 2 AS BIGINT) AS edges, max(degree) AS max_degree, CAST(sum(degree * (degree - 1) // 2) AS BIGINT) AS wedges FROM cd GROUP BY 1)"""

PARTS = """
lp AS (SELECT DISTINCT o_custkey AS graph_id, o_orderkey, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
dn AS (SELECT DISTINCT graph_id, part AS node_id, p_type AS label FROM lp JOIN part ON p_partkey = part),
de AS (SELECT DISTINCT x.graph_id, x.part AS u, y.part AS v FROM lp x JOIN lp y ON x.o_orderkey = y.o_orderkey AND x.part < y.part),
da AS (SELECT graph_id, u, v FROM de UNION ALL SELECT graph_id, v, u FROM de),
dd AS (SELECT n.graph_id, n.node_id, count(a.u) AS degree FROM dn n LEFT JOIN da a ON a.graph_id = n.graph_id AND a.u = n.node_id GROUP BY 1, 2),
dw AS (SELECT x.graph_id, x.u AS c, x.v AS a, y.v AS b FROM da x JOIN da y ON x.graph_id = y.graph_id AND x.u = y.u AND x.v < y.v),
dt AS (SELECT dw.*, de.u IS NOT NULL AS closed FROM dw LEFT JOIN de ON de.graph_id = dw.graph_id AND de.u = a AND de.v = b),
d3 AS (SELECT * FROM dt WHERE NOT closed OR c < a)"""

# three-node paths of the chains, packed greedily: fewest edges that leave first, then the ends, then the centre
PACK = CHAIN + """,
deg AS (SELECT n.graph_id, n.node_id, count(a.u) AS d FROM an n LEFT JOIN aa a ON a.graph_id = n.graph_id AND a.u = n.node_id GROUP BY 1, 2),
cand AS (SELECT p.graph_id, a, b, c, row_number() OVER (PARTITION BY p.graph_id ORDER BY x.d + y.d + z.d - 4, a, b, c) AS r
  FROM ap p JOIN deg x ON x.graph_id = p.graph_id AND x.node_id = a JOIN deg y ON y.graph_id = p.graph_id AND y.node_id = b JOIN deg z ON z.graph_id = p.graph_id AND z.node_id = c),
fold AS (
  SELECT graph_id, r, [a, b, c] AS used, [c] AS kept FROM cand WHERE r = 1
  UNION ALL
  SELECT f.graph_id, k.r, CASE WHEN list_has_any(f.used, [k.a, k.b, k.c]) THEN f.used ELSE f.used || [k.a, k.b, k.c] END, CASE WHEN list_has_any(f.used, [k.a, k.b, k.c]) THEN f.kept ELSE f.kept || [k.c] END
  FROM fold f JOIN cand k ON k.graph_id = f.graph_id AND k.r = f.r + 1),
packed AS (SELECT graph_id, unnest(kept) AS centre FROM (SELECT graph_id, arg_max(kept, r) AS kept FROM fold GROUP BY 1)),
k AS (SELECT graph_id, count(*) AS k FROM packed GROUP BY 1),
sz AS (SELECT graph_id, count(*) AS n FROM an GROUP BY 1),
pk AS (SELECT graph_id, n, k FROM sz JOIN k USING (graph_id))"""

LF = "lgamma(({0}) + 1) / ln(2)"


def lf(x: str) -> str:
    """log2 of a factorial."""
    return f"(lgamma(CAST({x} AS DOUBLE) + 1) / ln(2))"


def dm_total(n: str, a: str) -> str:
    return f"((lgamma({a} / 2.0 + {n}) - lgamma({a} / 2.0)) / ln(2))"


def dm_each(c: str) -> str:
    return f"((lgamma({c} + 0.5) - lgamma(0.5)) / ln(2))"


def L(n: str) -> str:
    return f"(log2(greatest({n}, 1)) + log2(greatest({n}, 1) + 1))"


GAINS = """
per AS (SELECT c_nationkey % 3 AS eval_id, c_custkey AS graph_id, round(c_acctbal / 100 - 20, 4) AS gain FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
total AS (SELECT c_nationkey % 3 AS eval_id, count(*) AS n_graphs, 12.5 * (c_nationkey % 3 + 1) AS dictionary FROM customer GROUP BY 1, c_nationkey % 3),
ranked AS (SELECT eval_id, graph_id, gain, row_number() OVER (PARTITION BY eval_id ORDER BY gain DESC, graph_id) AS k, sum(gain) OVER (PARTITION BY eval_id ORDER BY gain DESC, graph_id ROWS UNBOUNDED PRECEDING) AS gain_sum FROM per),
curve AS (SELECT eval_id, k, gain_sum, gain_sum - dictionary - """ + L("k") + " - (" + lf("n_graphs") + " - " + lf("k") + " - " + lf("n_graphs - k") + """) - 1 AS net FROM ranked JOIN total USING (eval_id)
  UNION ALL SELECT eval_id, 0, 0, -1 FROM total)"""

PRED = "pred AS (SELECT o_orderpriority AS actual, CASE WHEN o_totalprice > 200000 THEN '1-URGENT' WHEN o_orderkey % 3 = 0 THEN '3-MEDIUM' ELSE o_orderpriority END AS predicted FROM orders)"
MATRIX = PRED + """,
cls AS (SELECT actual AS c FROM pred UNION SELECT predicted FROM pred),
mat AS (SELECT x.c AS actual, y.c AS predicted, count(p.actual) AS n FROM cls x CROSS JOIN cls y LEFT JOIN pred p ON p.actual = x.c AND p.predicted = y.c GROUP BY 1, 2),
per AS (SELECT c, (SELECT coalesce(sum(n), 0) FROM mat WHERE actual = c) AS support, (SELECT coalesce(sum(n), 0) FROM mat WHERE predicted = c) AS n_predicted, (SELECT coalesce(sum(n), 0) FROM mat WHERE actual = c AND predicted = c) AS hits FROM cls),
pr AS (SELECT *, CASE WHEN n_predicted > 0 THEN hits / n_predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM per),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)"""

SQL = {
    "graph_complexity": f"WITH {SUPPLY} SELECT * FROM cs",
    "degree_histogram": f"WITH {PARTS} SELECT degree, count(*) AS n FROM dd GROUP BY 1",
    "complexity_caps": f"WITH {SUPPLY} SELECT * FROM cs WHERE nodes <= 40 AND edges <= 60 AND max_degree <= 8 AND wedges <= 120",
    "size_bins": f"WITH {SUPPLY} SELECT graph_id, position, CAST(position * 3 // (SELECT count(*) FROM cs) AS BIGINT) AS bin FROM (SELECT graph_id, row_number() OVER (ORDER BY nodes, edges, max_degree, wedges, graph_id) - 1 AS position FROM cs)",
    "stratified_sample": f"""WITH {SUPPLY}, b AS (SELECT graph_id, CAST(position * 3 // (SELECT count(*) FROM cs) AS BIGINT) AS bin, md5('7:' || graph_id) AS h FROM (SELECT graph_id, row_number() OVER (ORDER BY nodes, edges, max_degree, wedges, graph_id) - 1 AS position FROM cs)),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h, graph_id) > 16 + CASE WHEN bin < 2 THEN 1 ELSE 0 END AS spare FROM b)
SELECT graph_id, bin FROM r ORDER BY spare, h, graph_id LIMIT 50""",
    "graph_violations": f"""WITH {SUPPLY}, loops AS (SELECT l_orderkey AS graph_id, l_suppkey AS u FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT graph_id FROM cn)),
twice AS (SELECT graph_id, u, count(*) AS n FROM loops GROUP BY 1, 2 HAVING count(*) > 1)
SELECT graph_id, 'self-loop' AS problem, count(*) AS n FROM loops GROUP BY 1
UNION ALL SELECT graph_id, 'unknown end', 2 * count(*) FROM loops l WHERE NOT EXISTS (SELECT 1 FROM cn WHERE cn.graph_id = l.graph_id AND cn.node_id = l.u) GROUP BY 1
UNION ALL SELECT graph_id, 'repeated edge', count(*) FROM twice GROUP BY 1""",
    "label_alphabet": f"WITH {PARTS} SELECT label, count(*) AS n FROM dn GROUP BY 1",
    "normalize_ids": f"""WITH {SUPPLY}, i AS MATERIALIZED (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS r FROM cn)
SELECT e.graph_id, least(x.r, y.r) AS u, greatest(x.r, y.r) AS v FROM (SELECT * FROM ce) e JOIN i x ON x.graph_id = e.graph_id AND x.node_id = e.u JOIN i y ON y.graph_id = e.graph_id AND y.node_id = e.v""",
    "collapse_parallel": """WITH e AS (SELECT o_custkey AS graph_id, least(l_orderkey * 2, l_suppkey * 2 + 1) AS u, greatest(l_orderkey * 2, l_suppkey * 2 + 1) AS v, l_returnflag AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT graph_id, u, v, string_agg(label, '+' ORDER BY label) AS label FROM e GROUP BY 1, 2, 3""",
    "topology_metrics": f"""WITH {FLOW}, t AS (SELECT x.graph_id, x.u AS c, count(*) AS t FROM ba x JOIN ba y ON x.graph_id = y.graph_id AND x.u = y.u AND x.v < y.v JOIN be e ON e.graph_id = x.graph_id AND e.u = x.v AND e.v = y.v GROUP BY 1, 2),
n AS (SELECT bd.graph_id, degree, coalesce(t, 0) AS t, degree * (degree - 1) / 2 AS w FROM bd LEFT JOIN t ON t.graph_id = bd.graph_id AND t.c = bd.node_id)
SELECT graph_id, count(*) AS nodes, CAST(sum(degree) // 2 AS BIGINT) AS edges, round(CASE WHEN count(*) > 1 THEN sum(degree) / (count(*) * (count(*) - 1)) ELSE 0 END, 6) AS density, round(avg(degree), 6) AS mean_degree, round(stddev_pop(degree), 6) AS std_degree,
  max(degree) AS max_degree, CAST(sum(t) // 3 AS BIGINT) AS triangles, round(CASE WHEN sum(w) > 0 THEN sum(t) / sum(w) ELSE 0 END, 6) AS transitivity, round(avg(CASE WHEN w > 0 THEN t / w ELSE 0 END), 6) AS clustering FROM n GROUP BY 1""",
    "connected_components": f"""WITH RECURSIVE {SUPPLY}, r AS (SELECT graph_id, node_id, node_id AS c FROM cn UNION SELECT r.graph_id, r.node_id, ca.v FROM r JOIN ca ON ca.graph_id = r.graph_id AND ca.u = r.c),
m AS (SELECT graph_id, node_id, min(c) AS c FROM r GROUP BY 1, 2) SELECT graph_id, count(DISTINCT c) AS components, CAST(sum(c) AS BIGINT) AS labels FROM m GROUP BY 1""",
    "structural_features": f"WITH {FLOW} SELECT graph_id, node_id, CAST(1 AS DOUBLE) AS one, round(ln(1 + degree), 6) AS log_degree, round(degree / greatest(max(degree) OVER (PARTITION BY graph_id), 1), 6) AS degree_share, CAST(0 AS DOUBLE) AS is_motif, CAST(0 AS DOUBLE) AS log_rank FROM bd",
    "message_edges": f"WITH {FLOW}, m AS (SELECT * FROM ba UNION ALL SELECT graph_id, node_id, node_id FROM bn) SELECT graph_id, count(*) AS n, CAST(sum(u * 10 + v) AS BIGINT) AS key FROM m GROUP BY 1",
    "gcn_layer": f"""WITH {FLOW}, m AS (SELECT * FROM ba UNION ALL SELECT graph_id, node_id, node_id FROM bn)
SELECT m.graph_id, m.u AS node_id, round(sum(y.degree / sqrt((x.degree + 1) * (y.degree + 1))), 6) AS x FROM m JOIN bd x ON x.graph_id = m.graph_id AND x.node_id = m.u JOIN bd y ON y.graph_id = m.graph_id AND y.node_id = m.v GROUP BY 1, 2""",
    "dependency_trees": """WITH l AS (SELECT l_orderkey AS graph_id, l_returnflag AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 AS i FROM lineitem)
SELECT graph_id, CAST(i // 2 AS BIGINT) AS u, i AS v, label FROM l WHERE i > 0""",
    "tu_round_trip": f"WITH {SUPPLY}, s AS (SELECT graph_id, count(*) FILTER (label = 'S') AS suppliers FROM cn GROUP BY 1) SELECT nodes, suppliers, edges, CAST(graph_id % 2 AS INT) AS label FROM cs JOIN s USING (graph_id)",
    "enum_size2": f"WITH {PARTS} SELECT graph_id, count(*) AS n FROM de GROUP BY 1",
    "enum_size3": f"WITH {PARTS} SELECT graph_id, count(*) AS n FROM d3 GROUP BY 1",
    "enum_size3_triangles": f"""WITH {FLOW} SELECT x.graph_id, x.u AS a, x.v AS b, y.v AS c, da.degree + db.degree + dc.degree - 6 AS ext
FROM be x JOIN be y ON x.graph_id = y.graph_id AND x.u = y.u AND x.v < y.v JOIN be z ON z.graph_id = x.graph_id AND z.u = x.v AND z.v = y.v
JOIN bd da ON da.graph_id = x.graph_id AND da.node_id = x.u JOIN bd db ON db.graph_id = x.graph_id AND db.node_id = x.v JOIN bd dc ON dc.graph_id = x.graph_id AND dc.node_id = y.v""",
    "enum_size4": f"""WITH RECURSIVE {FLOW}, q AS (SELECT a.graph_id, a.node_id AS a, b.node_id AS b, c.node_id AS c, d.node_id AS d FROM bn a JOIN bn b ON a.graph_id = b.graph_id AND a.node_id < b.node_id JOIN bn c ON c.graph_id = a.graph_id AND b.node_id < c.node_id JOIN bn d ON d.graph_id = a.graph_id AND c.node_id < d.node_id),
r AS (SELECT graph_id, a, b, c, d, a AS x FROM q UNION SELECT r.graph_id, a, b, c, d, ba.v FROM r JOIN ba ON ba.graph_id = r.graph_id AND ba.u = r.x WHERE ba.v IN (a, b, c, d))
SELECT graph_id, a || '-' || b || '-' || c || '-' || d AS nodes FROM r GROUP BY graph_id, a, b, c, d HAVING count(*) = 4""",
    "enum_size5": f"""WITH RECURSIVE {FLOW}, r AS (SELECT graph_id, min(node_id) AS x FROM bn GROUP BY 1 HAVING count(*) = 5 UNION SELECT r.graph_id, ba.v FROM r JOIN ba ON ba.graph_id = r.graph_id AND ba.u = r.x)
SELECT graph_id, CAST(1 AS BIGINT) AS n FROM r GROUP BY 1 HAVING count(*) = 5""",
    "enum_whitelist": f"""WITH {FLOW}, w AS (SELECT graph_id, node_id FROM bn WHERE label <> 'view'), e AS (SELECT ba.* FROM ba JOIN w x ON x.graph_id = ba.graph_id AND x.node_id = u JOIN w y ON y.graph_id = ba.graph_id AND y.node_id = v),
t AS (SELECT DISTINCT x.graph_id, list_sort([x.u, x.v, y.v]) AS s FROM e x JOIN e y ON x.graph_id = y.graph_id AND x.u = y.u AND x.v < y.v) SELECT graph_id, count(*) AS n FROM t WHERE s[1] <= 1 GROUP BY 1""",
    "fingerprint_counts": f"WITH {CHAIN} SELECT graph_id, pattern, count(*) AS n FROM al GROUP BY 1, 2",
    "nodewise_fingerprint": f"""WITH {FLOW}, w AS (SELECT x.graph_id, x.u AS c, x.v AS a, y.v AS b FROM ba x JOIN ba y ON x.graph_id = y.graph_id AND x.u = y.u AND x.v < y.v),
t AS (SELECT w.*, be.u IS NOT NULL AS closed FROM w LEFT JOIN be ON be.graph_id = w.graph_id AND be.u = a AND be.v = b), s AS (SELECT graph_id, unnest([a, b, c]) AS node_id FROM t WHERE NOT closed OR c < a)
SELECT graph_id, node_id, count(*) AS n, count(*) AS patterns FROM s GROUP BY 1, 2""",
    "motif_support": f"WITH {CHAIN} SELECT pattern, count(DISTINCT graph_id) AS graph_support, count(*) AS occurrences FROM al GROUP BY 1",
    "motif_topk": f"WITH {CHAIN} SELECT pattern, count(DISTINCT graph_id) AS graph_support, count(*) AS occurrences FROM al GROUP BY 1 HAVING count(DISTINCT graph_id) >= 2 AND count(*) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20",
    "canonical_classes_k4": f"""WITH RECURSIVE {FLOW}, q AS (SELECT a.graph_id, a.node_id AS a, b.node_id AS b, c.node_id AS c, d.node_id AS d FROM bn a JOIN bn b ON a.graph_id = b.graph_id AND a.node_id < b.node_id JOIN bn c ON c.graph_id = a.graph_id AND b.node_id < c.node_id JOIN bn d ON d.graph_id = a.graph_id AND c.node_id < d.node_id),
r AS (SELECT graph_id, a, b, c, d, a AS x FROM q UNION SELECT r.graph_id, a, b, c, d, ba.v FROM r JOIN ba ON ba.graph_id = r.graph_id AND ba.u = r.x WHERE ba.v IN (a, b, c, d)),
s AS (SELECT graph_id, a, b, c, d FROM r GROUP BY graph_id, a, b, c, d HAVING count(*) = 4),
p AS (SELECT s.graph_id, a, b, c, d, string_agg(least(x.event_type, y.event_type) || '-' || greatest(x.event_type, y.event_type), ',' ORDER BY least(x.event_type, y.event_type) || '-' || greatest(x.event_type, y.event_type)) AS pattern
  FROM s JOIN be ON be.graph_id = s.graph_id AND be.u IN (a, b, c, d) AND be.v IN (a, b, c, d) JOIN kinds x ON x.id = be.u JOIN kinds y ON y.id = be.v GROUP BY 1, 2, 3, 4, 5)
SELECT pattern, count(*) AS n, count(DISTINCT graph_id) AS graphs FROM p GROUP BY 1""",
    "seen_unseen_split": f"""WITH {CHAIN}, v AS (SELECT DISTINCT pattern FROM al WHERE graph_id % 10 = 0)
SELECT graph_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (v.pattern IS NULL) AS BIGINT) AS unseen, round(count(*) FILTER (v.pattern IS NULL) / count(*), 6) AS share FROM al LEFT JOIN v USING (pattern) WHERE graph_id % 10 <> 0 GROUP BY 1""",
    "feature_matrix": f"WITH {CHAIN}, f AS (SELECT graph_id, pattern, count(*) AS n FROM al GROUP BY 1, 2) SELECT graph_id, count(*) AS columns, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM f GROUP BY 1",
    "external_degree": f"""WITH {PARTS} SELECT d3.graph_id, CASE WHEN closed THEN 3 ELSE 2 END AS edges, count(*) AS n, CAST(sum(x.degree + y.degree + z.degree - CASE WHEN closed THEN 6 ELSE 4 END) AS BIGINT) AS ext
FROM d3 JOIN dd x ON x.graph_id = d3.graph_id AND x.node_id = a JOIN dd y ON y.graph_id = d3.graph_id AND y.node_id = b JOIN dd z ON z.graph_id = d3.graph_id AND z.node_id = c GROUP BY 1, 2""",
    "greedy_packing": f"WITH RECURSIVE {PACK} SELECT graph_id, centre FROM packed",
    "carrier_sizes": f"WITH RECURSIVE {PACK} SELECT graph_id, n - 2 * k AS nodes, k AS motifs, n - 1 - 2 * k AS edges FROM pk",
    "boundary_sizes": f"""WITH RECURSIVE {PACK} SELECT p.graph_id, CAST(x.d + y.d - 2 AS INT) AS b, count(*) AS n FROM packed p JOIN ap ON ap.graph_id = p.graph_id AND ap.c = p.centre
JOIN deg x ON x.graph_id = p.graph_id AND x.node_id = a JOIN deg y ON y.graph_id = p.graph_id AND y.node_id = b GROUP BY 1, 2""",
    "decode_mismatch_count": "SELECT CAST(0 AS BIGINT) AS n",
    "port_histogram": f"WITH RECURSIVE {PACK} SELECT CAST(sum(x.d + y.d - 2) AS BIGINT) AS n FROM packed p JOIN ap ON ap.graph_id = p.graph_id AND ap.c = p.centre JOIN deg x ON x.graph_id = p.graph_id AND x.node_id = a JOIN deg y ON y.graph_id = p.graph_id AND y.node_id = b",
    "size_comparison": f"WITH RECURSIVE {PACK} SELECT graph_id, n AS nodes, n - 2 * k AS token_nodes, n - 1 AS edges, n - 1 - 2 * k AS token_edges, round(CASE WHEN n > 0 THEN 2 * k / n ELSE 0 END, 6) AS node_reduction, round(CASE WHEN n > 1 THEN 2 * k / (n - 1) ELSE 0 END, 6) AS edge_reduction FROM pk",
    "base_bits": f"""WITH {SUPPLY}, t AS (SELECT graph_id, sum({lf('degree')}) AS s FROM cd GROUP BY 1), l AS (SELECT graph_id, sum({dm_each('n')}) AS s FROM (SELECT graph_id, label, count(*) AS n FROM cn GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT graph_id, sum({dm_each('n')}) AS s FROM (SELECT graph_id, degree, count(*) AS n FROM cd GROUP BY 1, 2) GROUP BY 1)
SELECT graph_id, nodes, edges, round(CASE WHEN edges = 0 THEN 0 ELSE {lf('2 * edges')} - {lf('edges')} - edges - t.s END + {dm_total('nodes', '6')} - l.s + {L('nodes')} + {L('max_degree')} + {dm_total('nodes', '(max_degree + 1)')} - d.s, 6) AS bits
FROM cs JOIN t USING (graph_id) JOIN l USING (graph_id) JOIN d USING (graph_id)""",
    "template_bits": f"""WITH RECURSIVE {PACK}, x AS (SELECT graph_id, n - 2 * k AS c, n - 1 - 2 * k AS e, n - 3 * k AS plain, k, 2 * (n - 2 * k) - 1 AS i FROM pk)
SELECT graph_id, c AS carrier_nodes, e AS carrier_edges, round(CASE WHEN i = 1 THEN 0 ELSE {lf('2 * (i - 1)')} - {lf('i - 1')} - (i - 1) - (i - 2) * {lf('2')} END
  + {dm_total('i', '3')} - {dm_each('plain')} - {dm_each('k')} - {dm_each('e')} + {L('i')} + CASE WHEN i = 1 THEN {L('1')} ELSE {L('2')} END
  + CASE WHEN i = 1 THEN {dm_total('1', '1')} - {dm_each('1')} ELSE {dm_total('i', '3')} - {dm_each('2')} - {dm_each('(i - 2)')} END, 6) AS template FROM x""",
    "label_bits": f"WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, round({dm_total('sum(n)', '5')} - sum({dm_each('n')}), 6) AS bits FROM c GROUP BY 1",
    "dictionary_bits": f"""WITH {CHAIN}, s AS (SELECT pattern, count(DISTINCT graph_id) AS g FROM al GROUP BY 1 HAVING count(DISTINCT graph_id) >= 2),
p AS (SELECT pattern, len(list_distinct(string_split(pattern, '-'))) AS kinds FROM s),
b AS (SELECT {lf('4')} - {lf('2')} - 2 - {lf('2')} + {dm_total('3', '5')} - CASE kinds WHEN 1 THEN {dm_each('3')} WHEN 2 THEN {dm_each('2')} + {dm_each('1')} ELSE 3 * {dm_each('1')} END + {L('3')} + {L('2')} + {dm_total('3', '3')} - {dm_each('2')} - {dm_each('1')} AS bits FROM p)
SELECT CAST(count(*) AS INT) AS n_rules, round({L('count(*)')} + sum(bits), 4) AS bits FROM b""",
    "integer_codes": """WITH n AS (SELECT p_partkey, length(bin(p_partkey)) AS l, length(bin(p_partkey + 1)) AS l1, CASE WHEN p_partkey <= 1 THEN 0 ELSE length(bin(p_partkey - 1)) END AS c FROM part WHERE p_partkey > 0)
SELECT p_partkey, l + 2 * length(bin(l)) - 2 AS delta, l1 + 2 * length(bin(l1)) - 2 AS delta0, CAST(c AS BIGINT) AS width, CAST(c AS BIGINT) AS ceil_log2, round(log2(p_partkey) + log2(p_partkey + 1), 6) AS analytic FROM n""",
    "integer_graph_bits": f"""WITH {SUPPLY}, u AS (SELECT graph_id, nodes, edges, nodes * (nodes - 1) // 2 AS u, length(bin(nodes + 1)) AS ln, length(bin(edges + 1)) AS le FROM cs),
b AS (SELECT graph_id, nodes, edges, ln + 2 * length(bin(ln)) - 2 + le + 2 * length(bin(le)) - 2 AS header, CAST(ceil({lf('u')} - {lf('edges')} - {lf('u - edges')} - 1e-7) AS BIGINT) AS topology, nodes * 3 AS node_labels, CAST(0 AS BIGINT) AS edge_labels FROM u)
SELECT graph_id, nodes, edges, header, topology, node_labels, edge_labels, header + topology + node_labels + edge_labels AS bits FROM b""",
    "multigrain_costs": """WITH g AS (SELECT coalesce(o_orderstatus, 'all') AS scope, CAST(sum(o_orderkey) AS BIGINT) AS raw, CAST(sum(o_orderkey % 1000) AS BIGINT) AS c FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ()))
SELECT scope, 'frozen reuse' AS policy, raw, c AS compressed, raw - c AS saved FROM g UNION ALL SELECT scope, 'standalone', raw, c + 500, raw - c - 500 FROM g""",
    "selector_curve_sparse": f"WITH {GAINS} SELECT eval_id, k, round(gain_sum, 6) AS gain_sum, round(net, 6) AS net FROM curve",
    "selector_sparse": f"WITH {GAINS} SELECT eval_id, n_selected, net FROM (SELECT eval_id, k AS n_selected, round(net, 6) AS net, row_number() OVER (PARTITION BY eval_id ORDER BY round(net, 9) DESC, k) AS r FROM curve) WHERE r = 1",
    "selector_per_graph": f"WITH {GAINS} SELECT eval_id, count(*) AS n_selected, round(sum(gain) - any_value(dictionary) - any_value(n_graphs) - 1, 6) AS net FROM per JOIN total USING (eval_id) WHERE gain > 0 GROUP BY 1",
    "selector_all_eligible": f"WITH {GAINS} SELECT eval_id, count(*) AS n_selected, round(sum(gain) - any_value(dictionary) - 1, 6) AS net FROM per JOIN total USING (eval_id) GROUP BY 1",
    "candidate_ranking": f"WITH {CHAIN}, s AS (SELECT pattern, count(DISTINCT graph_id) AS graph_support, count(*) AS occurrences FROM al GROUP BY 1) SELECT row_number() OVER (ORDER BY graph_support DESC, occurrences DESC, pattern) AS rank, printf('M%03d', row_number() OVER (ORDER BY graph_support DESC, occurrences DESC, pattern)) AS motif_id, * FROM s",
    "cost_decomposition": """WITH g AS (SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS template, CAST(count(*) AS DOUBLE) AS boundary, CAST(sum(l_linenumber) AS DOUBLE) AS dictionary FROM lineitem GROUP BY 1),
u AS (UNPIVOT g ON template, boundary, dictionary INTO NAME component VALUE bits) SELECT l_returnflag, component, bits, round(bits / sum(bits) OVER (PARTITION BY l_returnflag), 6) AS fraction FROM u""",
    "confusion_matrix": f"WITH {MATRIX} SELECT * FROM mat",
    "class_metrics": f"WITH {MATRIX} SELECT c, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support, CAST(n_predicted AS BIGINT) AS n_predicted FROM f",
    "macro_f1": f"WITH {MATRIX} SELECT round(avg(f1), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS n FROM f",
    "majority_baseline": f"WITH {PRED} SELECT round(max(n) / sum(n), 6) AS accuracy FROM (SELECT actual, count(*) AS n FROM pred GROUP BY 1)",
    "class_codes": "SELECT p_type, p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part",
    "run_summary": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(min(value), 6) AS least, round(max(value), 6) AS most, count(*) AS n FROM events WHERE isfinite(value) GROUP BY 1",
    "fold_mean_sem": "WITH m AS (SELECT c_mktsegment, c_custkey % 5 AS f, avg(c_acctbal) AS m FROM customer GROUP BY 1, 2) SELECT c_mktsegment, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS sem, count(*) AS folds FROM m GROUP BY 1",
    "paired_speedup": """WITH c AS (SELECT c_custkey // 2 AS pair, c_custkey % 2 AS side, c_acctbal + 2000 AS s FROM customer),
p AS (SELECT x.s - y.s AS saved, x.s / y.s AS speedup FROM c x JOIN c y ON x.pair = y.pair AND x.side = 1 AND y.side = 0) SELECT round(median(speedup), 6) AS median_speedup, round(median(saved), 6) AS median_saved, count(*) FILTER (saved > 0) AS faster, count(*) AS n FROM p""",
    "tradeoff": "SELECT p_partkey, round(p_size / 25.0, 6) AS speedup, round(CAST(p_size - 25.0 AS DOUBLE), 6) AS seconds_saved, round(CASE WHEN p_size > 25 THEN 45.0 / (p_size - 25.0) END, 6) AS break_even FROM part WHERE p_size > 0",
    "pareto_frontier": "SELECT r.p_partkey, NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size >= r.p_size AND o.p_retailprice >= r.p_retailprice AND (o.p_size > r.p_size OR o.p_retailprice > r.p_retailprice)) AS on_frontier FROM part r",
    "sign_test": f"""WITH c AS (SELECT c_nationkey, count(*) FILTER (c_acctbal > 4500) AS s, count(*) AS n FROM customer GROUP BY 1), k AS (SELECT *, unnest(range(s, n + 1)) AS k FROM c)
SELECT c_nationkey, s, n, round(sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))), 6) AS p FROM k GROUP BY 1, 2, 3""",
    "bootstrap_ci": """WITH v AS (SELECT s_suppkey - 1 AS pos, s_acctbal AS value FROM supplier), n AS (SELECT count(*) AS n FROM v), d AS (SELECT r, CAST('0x' || substr(md5('3:' || r || ':' || j), 1, 8) AS BIGINT) % n AS pos FROM n, range(200) AS a(r), range(n) AS b(j)),
m AS (SELECT r, avg(value) AS m FROM d JOIN v USING (pos) GROUP BY 1) SELECT round((SELECT avg(value) FROM v), 4) AS estimate, round(quantile_cont(m, 0.025), 4) AS lower, round(quantile_cont(m, 0.975), 4) AS upper FROM m""",
    "task_manifest": """WITH t AS (SELECT r AS repeat, c AS rule_count, CASE WHEN r % 2 = 0 THEN c ELSE 3 - c END AS o FROM range(2) AS a(r), range(4) AS b(c))
SELECT repeat * 4 + o AS task_id, repeat, CAST(rule_count AS INT) AS rule_count, CASE WHEN rule_count = 0 THEN 'original' ELSE 'tokenized' END AS representation, CAST(o AS INT) AS order_position, 10 + repeat AS seed FROM t""",
    "manifest_faults": "SELECT CAST(t AS BIGINT) AS task_id, CASE WHEN t < 3 THEN 'missing' WHEN t = 5 THEN 'duplicate' ELSE 'unexpected' END AS fault FROM range(10) AS a(t) WHERE t < 3 OR t = 5 OR t > 7",
    "gain_histogram": """WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, greatest(5, least(30, CAST(floor(sqrt(count(*))) AS INT))) AS b FROM customer), w AS (SELECT lo, b, (hi - lo) / b AS w FROM s)
SELECT CAST(least(floor((c_acctbal - lo) / w), b - 1) AS BIGINT) AS bin, round(lo + least(floor((c_acctbal - lo) / w), b - 1) * w, 4) AS low, round(lo + (least(floor((c_acctbal - lo) / w), b - 1) + 1) * w, 4) AS high, count(*) AS n FROM customer, w GROUP BY 1, 2, 3""",
    "split_graphs": """WITH h AS (SELECT c_custkey AS graph_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('1:' || c_custkey), 1, 12) AS BIGINT), c_custkey) - 1 AS p FROM customer)
SELECT graph_id, CASE WHEN p < 80 THEN 'fit' WHEN p < 120 THEN 'eval' END AS split FROM h""",
    "stratified_holdout": """WITH r AS (SELECT c_custkey AS graph_id, c_mktsegment AS label, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('3:' || c_custkey), c_custkey) AS k FROM customer)
SELECT graph_id, label, k <= CASE WHEN n > 1 THEN least(greatest(round(n * 0.2), 1), n - 1) ELSE 0 END AS held_out FROM r""",
    "ladder_features": f"""WITH {CHAIN}, d AS (SELECT n.graph_id, n.node_id, count(a.u) AS degree FROM an n LEFT JOIN aa a ON a.graph_id = n.graph_id AND a.u = n.node_id GROUP BY 1, 2),
s AS (SELECT graph_id, count(*) AS nodes, CAST(sum(degree) // 2 AS BIGINT) AS edges, max(degree) AS max_degree, CAST(sum(degree * (degree - 1) // 2) AS BIGINT) AS wedges FROM d GROUP BY 1)
SELECT s.*, (SELECT count(*) FROM al WHERE al.graph_id = s.graph_id AND pattern = 'click-click-click') AS clicks, (SELECT count(*) FROM al WHERE al.graph_id = s.graph_id AND pattern = 'view-view-view') AS views FROM s""",
    "alias_columns": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 1.5 END AS gain FROM customer",
    "hash_classes": f"WITH {CHAIN} SELECT count(DISTINCT graph_id) AS graph_support, count(*) AS occurrences FROM al GROUP BY pattern",
    "enum_exhaustive": f"WITH {FLOW}, t AS (SELECT DISTINCT x.graph_id, list_sort([x.u, x.v, y.v]) AS s FROM ba x JOIN ba y ON x.graph_id = y.graph_id AND x.u = y.u AND x.v < y.v) SELECT graph_id, count(*) AS n FROM t GROUP BY 1",
    "enumeration_totals": f"WITH {CHAIN}, g AS (SELECT graph_id, count(*) AS n FROM al GROUP BY 1) SELECT CAST(3 AS INT) AS size, CAST(sum(n) AS BIGINT) AS occurrences, max(n) AS most, count(*) AS graphs, (SELECT count(DISTINCT pattern) FROM al) AS classes FROM g",
    "sample_manifest": f"""WITH {SUPPLY}, el AS (SELECT * FROM cs WHERE nodes <= 40 AND edges <= 60 AND max_degree <= 8 AND wedges <= 120),
b AS (SELECT *, CAST((row_number() OVER (ORDER BY nodes, edges, max_degree, wedges, graph_id) - 1) * 3 // (SELECT count(*) FROM el) AS BIGINT) AS bin, md5('5:' || graph_id) AS h FROM el),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h, graph_id) > 6 + CASE WHEN bin < 2 THEN 1 ELSE 0 END AS spare FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY spare, h, graph_id) - 1 AS a FROM r)
SELECT 'orders' AS dataset, 5 AS seed, CASE WHEN a < 12 THEN 'fit' ELSE 'eval' END AS split, CASE WHEN a < 12 THEN a ELSE a - 12 END AS sample_position, graph_id, bin AS size_bin, nodes, edges, max_degree, wedges, (SELECT count(*) FROM el) AS eligible_graphs, (SELECT count(*) FROM cs) AS all_graphs FROM p WHERE a < 20""",
    "fresh_decode": f"WITH RECURSIVE {PACK} SELECT graph_id, n AS nodes, n - 1 AS edges, CAST(2 AS BIGINT) AS leaves FROM pk",
    "port_counts": f"""WITH RECURSIVE {PACK}, e AS (SELECT unnest([CASE WHEN x.d > 1 THEN 0 END, CASE WHEN y.d > 1 THEN 1 END]) AS port FROM packed p JOIN ap ON ap.graph_id = p.graph_id AND ap.c = p.centre
JOIN deg x ON x.graph_id = p.graph_id AND x.node_id = a JOIN deg y ON y.graph_id = p.graph_id AND y.node_id = b) SELECT 0 AS rank, CAST(port AS INT) AS port, count(*) AS n FROM e WHERE port IS NOT NULL GROUP BY 2""",
    "null_aware_deltas": """WITH c AS (SELECT c_nationkey, c_custkey % 2 AS side, CASE WHEN c_custkey % 50 <> 0 THEN c_acctbal END AS a, c_acctbal AS b FROM customer),
s AS (SELECT c_nationkey, side, CASE WHEN count(a) = count(*) THEN avg(a) END AS a, avg(b) AS b FROM c GROUP BY 1, 2),
j AS (SELECT coalesce(x.c_nationkey, y.c_nationkey) AS c_nationkey, x.a AS a0, y.a AS a1, x.b AS b0, y.b AS b1 FROM (SELECT * FROM s WHERE side = 0) x FULL JOIN (SELECT * FROM s WHERE side = 1) y ON x.c_nationkey = y.c_nationkey)
SELECT c_nationkey, round(a0, 6) AS a_before, round(a1, 6) AS a_after, round(a1 - a0, 6) AS a_delta, round(b0, 6) AS b_before, round(b1, 6) AS b_after, round(b1 - b0, 6) AS b_delta FROM j""",
    "tradeoff_points": """WITH o AS (SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) AS x, 100000.0::DOUBLE + (o_orderkey % 7) * 10000 AS y, o_custkey % 3 - o_orderkey % 3 AS g FROM orders)
SELECT o_orderpriority, round(median(x), 6) AS median_before, round(median(y), 6) AS median_after, round(median(x) / median(y), 6) AS ratio_of_medians, round(median(x / y), 6) AS median_speedup, round(min(x / y), 6) AS least_speedup, round(max(x / y), 6) AS most_speedup,
  count(*) FILTER (x / y > 1) AS faster, count(*) FILTER (x / y < 1) AS slower, count(*) FILTER (g > 0) AS better, count(*) FILTER (g = 0) AS equal, count(*) FILTER (g < 0) AS worse, count(*) AS n FROM o GROUP BY 1""",
    "preservation": """WITH m AS (SELECT c_mktsegment, c_custkey % 5 AS f, avg(c_acctbal) AS m FROM customer GROUP BY 1, 2), s AS (SELECT c_mktsegment, median((c_acctbal + 2000) / 1000) AS s FROM customer GROUP BY 1)
SELECT c_mktsegment, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS sem, count(*) AS folds, round(any_value(s), 6) AS median_speedup FROM m JOIN s USING (c_mktsegment) GROUP BY 1""",
    "merged_metrics": """WITH c AS (SELECT c_nationkey, c_custkey % 2 AS side, count(*) AS n, max(c_acctbal) AS best FROM customer GROUP BY 1, 2)
SELECT x.c_nationkey, x.n, y.n AS original_n, round(x.n / y.n, 6) AS n_kept, round(CASE WHEN y.best <> 0 THEN x.best / y.best END, 6) AS best_kept FROM c x JOIN c y ON x.c_nationkey = y.c_nationkey AND x.side = 1 AND y.side = 0""",
    "top_by_value": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
    "accountant_comparison": f"""WITH d AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS n FROM part WHERE p_size > 0), u AS (SELECT n, n * (n + 1) // 2 AS u, length(bin(n)) AS l FROM d), t AS (SELECT *, {lf('u')} - {lf('n')} - {lf('u - n')} AS t FROM u)
SELECT n, round(log2(n) + log2(n + 1), 6) AS analytic, l + 2 * length(bin(l)) - 2 AS integer, round(t, 6) AS analytic_topology, CAST(greatest(ceil(t - 1e-7), 0) AS BIGINT) AS integer_topology FROM t""",
    "broken_rules": """SELECT * FROM (SELECT 'few lines' AS rule, count(*) FILTER (NOT coalesce(l_linenumber <= 3, false)) AS n FROM lineitem UNION ALL SELECT 'known flag', count(*) FILTER (NOT coalesce(l_returnflag IN ('A', 'N'), false)) FROM lineitem
UNION ALL SELECT 'quantity is positive', count(*) FILTER (NOT coalesce(l_quantity > 0, false)) FROM lineitem) WHERE n > 0""",
    "motif_shapes": f"""WITH RECURSIVE {FLOW}, q AS (SELECT a.graph_id, a.node_id AS a, b.node_id AS b, c.node_id AS c, d.node_id AS d FROM bn a JOIN bn b ON a.graph_id = b.graph_id AND a.node_id < b.node_id JOIN bn c ON c.graph_id = a.graph_id AND b.node_id < c.node_id JOIN bn d ON d.graph_id = a.graph_id AND c.node_id < d.node_id),
r AS (SELECT graph_id, a, b, c, d, a AS x FROM q UNION SELECT r.graph_id, a, b, c, d, ba.v FROM r JOIN ba ON ba.graph_id = r.graph_id AND ba.u = r.x WHERE ba.v IN (a, b, c, d)),
s AS (SELECT graph_id, a, b, c, d FROM r GROUP BY graph_id, a, b, c, d HAVING count(*) = 4),
g AS (SELECT z.graph_id, a, b, c, d, x, count(ba.v) AS k FROM (SELECT *, unnest([a, b, c, d]) AS x FROM s) z JOIN ba ON ba.graph_id = z.graph_id AND ba.u = x AND ba.v IN (a, b, c, d) GROUP BY ALL),
f AS (SELECT list_sort(list(k)) AS k FROM g GROUP BY graph_id, a, b, c, d),
known(k, m, shape, automorphisms) AS (VALUES ([1, 1, 1, 3], 3, 'star-S3', 6), ([1, 1, 2, 2], 3, 'path-P4', 2), ([2, 2, 2, 2], 4, 'cycle-C4', 8), ([1, 2, 2, 3], 4, 'connected', 2), ([2, 2, 3, 3], 5, 'connected', 4), ([3, 3, 3, 3], 6, 'clique-K4', 24)),
w AS (SELECT DISTINCT x.graph_id, list_sort([x.u, x.v, y.v]) AS s, be.u IS NOT NULL AS closed FROM ba x JOIN ba y ON x.graph_id = y.graph_id AND x.u = y.u AND x.v < y.v LEFT JOIN be ON be.graph_id = x.graph_id AND be.u = x.v AND be.v = y.v)
SELECT CAST(size AS INT) AS size, CAST(m AS INT) AS n_edges, shape, CAST(automorphisms AS INT) AS automorphisms, n FROM (
SELECT 4 AS size, m, shape, automorphisms, count(*) AS n FROM f JOIN known USING (k) GROUP BY ALL
UNION ALL SELECT 3, CASE WHEN closed THEN 3 ELSE 2 END, CASE WHEN closed THEN 'triangle' ELSE 'path-P3' END, CASE WHEN closed THEN 6 ELSE 2 END, count(*) FROM w GROUP BY closed
UNION ALL SELECT 2, 1, 'edge', 2, count(*) FROM be) WHERE n > 0""",
    "selector_sparse_forced": f"WITH {GAINS} SELECT eval_id, n_selected, net FROM (SELECT eval_id, k AS n_selected, round(net, 6) AS net, row_number() OVER (PARTITION BY eval_id ORDER BY round(net, 9) DESC, k) AS r FROM curve WHERE k > 0) WHERE r = 1",
    "selector_per_graph_forced": f"""WITH {GAINS}, n AS (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY gain DESC, graph_id) AS r FROM per WHERE gain < 0)
SELECT eval_id, CAST(1 AS BIGINT) AS n_selected, graph_id AS last_graph, round(gain - dictionary - n_graphs - 1, 6) AS net FROM n JOIN total USING (eval_id) WHERE r = 1""",
}
