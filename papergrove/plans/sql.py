"""The registered queries in SQL for DuckDB."""

from __future__ import annotations

import re

SEED = 7


def _h(ident: str, *tags: str) -> str:
    tag = ", ".join(tags)
    return f"(('0x' || substr(md5(concat('{SEED}', ':', {ident}, ':', {tag})), 1, 8))::BIGINT)"


def _p(ident: str, *tags: str) -> str:
    """The same draw of 60 bits, for picks."""
    return _h(ident, *tags).replace(", 1, 8))", ", 1, 15))")


def _u(ident: str, *tags: str) -> str:
    return f"(({_h(ident, *tags)} + 1)::DOUBLE / 4294967296::DOUBLE)"


NODES = "nodes AS (SELECT o_orderkey AS id, year(o_orderdate)::INT AS year FROM orders)"
EDGES = """cites AS (SELECT l_orderkey AS src, lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey) AS dst
  FROM (SELECT DISTINCT l_orderkey, l_partkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
edges AS (SELECT DISTINCT src, dst FROM cites WHERE dst IS NOT NULL AND src <> dst)"""
UND = "und AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges)"
DEG = """deg AS (SELECT n.id, coalesce(i.c, 0)::BIGINT AS in_degree, coalesce(o.c, 0)::BIGINT AS out_degree FROM nodes n
  LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) o ON o.src = n.id)"""
GRAPH = f"{NODES}, {EDGES}, {UND}, {DEG}"
RECENCY = "recency AS (SELECT DISTINCT 2002 - year AS age, 1::DOUBLE / (2002 - year + 1)::DOUBLE AS prob FROM nodes WHERE 2002 - year <> 3)"
REC = """age_n AS (SELECT 2002 - year AS age, count(*) AS n FROM nodes GROUP BY 1),
rec_age AS (SELECT a.age, coalesce(prob, 0)::DOUBLE / (n * sum(coalesce(prob, 0)) OVER ()) AS rec FROM age_n a LEFT JOIN recency r ON r.age = a.age),
rec AS (SELECT id, rec FROM nodes JOIN rec_age ON age = 2002 - year)"""
BAG = "bag AS (SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS pos, (5 + p_size % 16)::INT AS out_degree FROM part)"
SIZE = "size AS (SELECT count(*) AS n, ceil(count(*) * 0.03::DOUBLE)::BIGINT AS delta FROM orders)"
AGENTS = f"""{BAG}, {SIZE},
raw_agents AS (SELECT g AS growth_idx, n + g AS id, n, delta FROM size, (SELECT unnest(range((SELECT delta FROM size))) AS g)),
agents AS (SELECT growth_idx, a.id, n, delta, {_p("a.id", "'generator'")} % n AS generator, b.out_degree, 0.33::DOUBLE / (0.33::DOUBLE + 0.33::DOUBLE + 0.33::DOUBLE) AS pa_weight, 0.33::DOUBLE / (0.33::DOUBLE + 0.33::DOUBLE + 0.33::DOUBLE) AS rec_weight, 0.33::DOUBLE / (0.33::DOUBLE + 0.33::DOUBLE + 0.33::DOUBLE) AS fit_weight, 0.5::DOUBLE AS alpha,
  row_number() OVER (ORDER BY {_h("a.id", "'sameyear'")}, a.id) <= floor(delta * 0.12::DOUBLE) AS same_year
  FROM raw_agents a JOIN bag b ON b.pos = {_p("a.id", "'outdegree'")} % (SELECT count(*) FROM bag))"""
CDF = "cdf AS (SELECT k, (sum(pow(k, -1.634)) OVER (ORDER BY k) - pow(k, -1.634)) / sum(pow(k, -1.634)) OVER () AS lo, sum(pow(k, -1.634)) OVER (ORDER BY k) / sum(pow(k, -1.634)) OVER () AS hi FROM (SELECT unnest(range(1, 1001))::INT AS k))"
FIT_U = f"drawn AS (SELECT id, year, {_u('id', chr(39) + 'fitness' + chr(39))} AS u FROM nodes), peaks AS (SELECT id, year, k AS fitness_peak FROM drawn JOIN cdf ON u > lo AND (u <= hi OR k = 1000))"
HOPS = "first AS (SELECT g, v AS n FROM starts JOIN und ON u = g), second AS (SELECT g, v AS n FROM first JOIN und ON u = n), hops AS (SELECT g, n, min(hop) AS hop FROM (SELECT g, n, 1 AS hop FROM first UNION ALL SELECT g, n, 2 FROM second) WHERE n <> g GROUP BY g, n)"
STARTS = f"{AGENTS}, starts AS (SELECT DISTINCT generator AS g FROM agents)"
QUOTA = """starts AS (SELECT DISTINCT generator AS g FROM agents), %s,
cand AS (SELECT a.id, h.n AS node, h.hop FROM agents a JOIN hops h ON h.g = a.generator),
sizes AS (SELECT id, count(*) FILTER (hop = 1) AS h1, count(*) FILTER (hop = 2) AS h2 FROM cand GROUP BY id),
free AS (SELECT a.*, coalesce(h1, 0) AS h1, coalesce(h2, 0) AS h2, floor((out_degree * 0.05::DOUBLE)::FLOAT)::INT AS reserved, same_year::INT AS sy FROM agents a LEFT JOIN sizes s ON s.id = a.id),
part1 AS (SELECT *, least(ceil(((out_degree - 1 - sy - reserved) * alpha)::FLOAT)::INT, h1::INT) AS inside FROM free),
part2 AS (SELECT *, least(out_degree - 1 - sy - reserved - inside, h2::INT) AS outside FROM part1),
quota AS (SELECT *, out_degree - 1 - sy - inside - outside AS random FROM part2)""" % HOPS
FILL = f"""draws AS (SELECT id, random, unnest(range(random + 32)) AS j FROM need WHERE random > 0),
drawn_nodes AS (SELECT id, random, {_p("id", "'fill:'", "j")} %% %s AS node, j FROM draws),
firsts AS (SELECT id, random, node, min(j) AS j FROM drawn_nodes GROUP BY id, random, node),
ranked AS (SELECT f.id, f.random, f.node, row_number() OVER (PARTITION BY f.id ORDER BY j) AS r FROM firsts f ANTI JOIN taken t ON t.id = f.id AND t.node = f.node),
fill AS (SELECT id, node FROM ranked WHERE r <= random)"""
EPOCH = f"""{GRAPH}, {RECENCY}, {REC}, {AGENTS}, {CDF}, {FIT_U}, {QUOTA},
pa AS (SELECT id, (in_degree::DOUBLE ^ 3 + 1) / sum(in_degree::DOUBLE ^ 3 + 1) OVER () AS pa FROM deg),
fit AS (SELECT id, (fitness_peak::DOUBLE ^ 3 + 1) / sum(fitness_peak::DOUBLE ^ 3 + 1) OVER () AS fit FROM peaks),
keyed AS (SELECT c.id, c.node, c.hop, CASE WHEN c.hop = 1 THEN inside ELSE outside END AS most,
  ln({_u("c.id", "'cand:'", "c.node")}) / (pa.pa * pa_weight + rec.rec * rec_weight + fit.fit * fit_weight) AS key
  FROM cand c JOIN quota q ON q.id = c.id JOIN pa ON pa.id = c.node JOIN rec ON rec.id = c.node JOIN fit ON fit.id = c.node),
near AS (SELECT id, node, hop FROM (SELECT *, row_number() OVER (PARTITION BY id, hop ORDER BY key DESC, node) AS r FROM keyed WHERE most > 0) WHERE r <= most),
taken AS (SELECT id, node FROM near UNION ALL SELECT id, generator FROM quota),
need AS (SELECT id, random FROM quota), {FILL % "((SELECT n FROM size) - 1)"},
epoch AS (SELECT id AS src, generator AS dst, 'generator' AS kind FROM quota
  UNION ALL SELECT id, n + {_p("id", "'own'")} % delta, 'same_year' FROM quota WHERE same_year
  UNION ALL SELECT id, node, CASE hop WHEN 1 THEN 'one_hop' ELSE 'two_hop' END FROM near
  UNION ALL SELECT id, node, 'random' FROM fill)"""
STRINGS = "strings AS (SELECT row_number() OVER (ORDER BY event_type) AS id, concat('void ns::', event_type, '<int>(int*)') AS value FROM (SELECT DISTINCT event_type FROM events))"
KERNEL = f"""{STRINGS}, kernel AS (SELECT event_id::BIGINT AS event_id, s.id AS name_id, s.value AS name, (event_id * 1000)::BIGINT AS start, event_id * 1000 + floor(abs(e.value) * 100)::BIGINT AS fin, (16 + event_id % 100)::INT AS regs,
  [64, 128, 256, 512][event_id % 4 + 1] AS block, (1 + user_id)::BIGINT AS grid, CASE WHEN event_id % 5 = 0 THEN 4096 ELSE 0 END AS shmem
  FROM events e JOIN strings s ON s.value = concat('void ns::', event_type, '<int>(int*)'))"""
COPY = "copy AS (SELECT l_linenumber::INT AS kind, floor(l_extendedprice)::BIGINT AS bytes, floor(l_quantity)::BIGINT AS dur, l_returnflag AS run, l_orderkey * 8 + l_linenumber AS pos FROM lineitem)"
METRIC = "metric AS (SELECT l_returnflag AS kernel, l_linestatus AS scenario, concat('m', l_linenumber) AS metric, l_quantity::DOUBLE AS value, CASE WHEN l_returnflag = 'N' AND l_linenumber = 3 AND l_orderkey % 50 = 0 THEN NULL WHEN l_returnflag = 'R' AND l_linenumber = 4 AND l_orderkey % 50 = 1 THEN 0 ELSE l_extendedprice::DOUBLE END AS weight FROM lineitem)"
PHASE = f"{COPY}, phases AS (SELECT concat('phase', kind) AS phase, dur::DOUBLE AS seconds, bytes FROM copy)"
SIGNATURE = """signature(k, name, short, kept, by_part) AS (VALUES
  (0, 'void kernelCallStage1_warped<int>(int*)', 'Stage1', 'Stage1', 'kernelCallStage1'),
  (1, 'kernelCallStage2(int)', 'Stage2', 'Stage2', 'kernelCallStage2'),
  (2, 'void ABMKernelStage4<4>(int)', 'ABMStage4', 'ABMKernel', 'void ABMKernelStage4<4>(int)'),
  (3, 'GetOneAndTwoHopNeighborhood_Warp(a)', '2HopWarp', 'GetOneAndTwoHopNeighborhood_Warp', 'GetOneAndTwoHopNeighborhood_Warp(a)'),
  (4, 'void cuco::static_map::insert_if<int>(x)', 'cuco::insert_if', 'cuco::static_map', 'void cuco::static_map::insert_if<int>(x)'),
  (5, 'cub::DeviceRadixSortKernel<1>(k)', 'cub::RadixSort', 'cub::DeviceRadixSortKernel', 'cub::DeviceRadixSortKernel<1>(k)'),
  (6, 'void ns::plain_kernel<int>(int*)', 'plain_kernel', 'plain_kernel', 'void ns::plain_kernel<int>(int*)'),
  (7, 'a_plain_name_of_more_than_thirty_letters', 'a_plain_name_of_more_than_thir', 'a_plain_name_of_more_than_thirty_letters', 'a_plain_name_of_more_than_thirty_letters'),
  (8, 'thrust::cuda_cub::copy<a>(b)', 'thrust::copy', 'cub::copy', 'thrust::cuda_cub::copy<a>(b)'),
  (9, 'void cub::detail::for_each::static_kernel<initialize_functor>()', 'cub::ForEach', 'cub::detail', 'cub::static_kernel(init)'))"""
LAUNCH = f"""{SIGNATURE}, launch AS (SELECT event_id::BIGINT AS event_id, s.name, short, kept, (event_id * 1000)::BIGINT AS start, event_id * 1000 + floor(abs(value) * 100)::BIGINT AS fin, (event_id % 100)::INT AS regs,
  [64, 65, 128, 256, 512, 0, 1024, 33][(event_id // 10) % 8 + 1] AS block_x, (1 + event_id % 2)::INT AS block_y, (1 + user_id % 50)::INT AS grid_x, (1 + event_id % 3)::INT AS grid_y,
  CASE WHEN event_id % 5 = 0 THEN 4096 ELSE 0 END AS shared_static, CASE WHEN event_id % 7 = 0 THEN 1000 ELSE 0 END AS shared_dynamic, CASE WHEN event_id % 4 > 0 THEN (16 * (event_id % 4))::INT END AS local
  FROM events JOIN signature s ON s.k = event_id % 10)"""


def _blocks(regs: str, block: str, shared: str, threads: int, blocks: int, memory: int, unit: int) -> dict[str, str]:
    """What each limit leaves, by its name; whole blocks."""
    warps = f"greatest(({block} + 31) // 32, 1)"
    return {
        "reg": f"(CASE WHEN {regs} > 0 THEN 65536 // (({regs} * 32 + 255) // 256 * 256 * {warps}) ELSE {blocks} END)",
        "thr": f"({threads} // greatest({block}, 1))",
        "shmem": f"(CASE WHEN {shared} > 0 THEN {memory} // (({shared} + {unit - 1}) // {unit} * {unit}) ELSE {blocks} END)",
        "blk": f"({blocks})",
    }


def _percent(regs: str, block: str, shared: str, warps: int, *limits: int) -> str:
    least = ", ".join(_blocks(regs, block, shared, *limits).values())
    return f"round_even(least(least({least}) * greatest(({block} + 31) // 32, 1) / {warps}::DOUBLE, 1) * 100, 1)"


def _limiter(regs: str, block: str, shared: str, *limits: int) -> str:
    parts = _blocks(regs, block, shared, *limits)
    return "CASE " + " ".join(f"WHEN {v} = least({', '.join(parts.values())}) THEN '{n}'" for n, v in parts.items()) + " END"


H100, DEVICE_ROW, RTX, H100_LIMITS = (2048, 32, 65536, 256), (1536, 32, 102400, 256), (1536, 24, 102400, 128), (2048, 32, 233472, 128)
MEMORY, THREADS = "(shared_static + shared_dynamic)", "(block_x * block_y)"
_KIND = "CASE kind WHEN 0 THEN 'Unknown' WHEN 1 THEN 'H2D' WHEN 2 THEN 'D2H' WHEN 3 THEN 'H2A' WHEN 4 THEN 'A2H' WHEN 5 THEN 'A2A' WHEN 6 THEN 'A2D' WHEN 7 THEN 'D2A' WHEN 8 THEN 'D2D' WHEN 9 THEN 'H2H' WHEN 10 THEN 'P2P' WHEN 11 THEN 'UVM_H2D' WHEN 12 THEN 'UVM_D2H' WHEN 13 THEN 'UVM_D2D' ELSE concat('kind', kind) END"
_WMEAN = "CASE WHEN count(*) FILTER ({v} IS NOT NULL AND coalesce({w}, 0) = 0) = 0 THEN sum({v} * {w}) / sum({w}) FILTER ({v} IS NOT NULL) ELSE avg({v}) END"
METRIC_NAMES = "['achieved_occ_pct', 'dram_bw_pct', 'fp32_insts', 'fp64_insts', 'dram_bytes', 'duration_ns']"
FILES = f"""files AS (SELECT CASE l_linestatus WHEN 'F' THEN 'run-3y-1p-details.csv' ELSE 'run-10y-5p-details.csv' END AS source, CASE l_linestatus WHEN 'F' THEN 3 ELSE 10 END AS years, CASE l_linestatus WHEN 'F' THEN 1 ELSE 5 END AS agents,
  concat('k<', l_returnflag, ', 1>') AS kernel, {METRIC_NAMES}[l_linenumber] AS metric, sum(l_quantity::DOUBLE) AS value FROM lineitem WHERE l_linenumber < 7 GROUP BY l_linestatus, l_returnflag, l_linenumber)"""
_STAT = "SELECT 'nodes' AS metric, count(*)::DOUBLE AS value FROM deg UNION ALL SELECT 'edges', count(*) FROM edges"
for _c in ("in_degree", "out_degree"):
    for _name, _f in (("min", "min"), ("max", "max"), ("avg", "avg"), ("std", "stddev_pop")):
        _STAT += f" UNION ALL SELECT '{_name}_{_c}', {_f}({_c}) FROM deg"
_CC = """cc(id, comp) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT e.v, min(c.comp) FROM cc c JOIN und e ON c.id = e.u JOIN recurring.cc r ON r.id = e.v WHERE c.comp < r.comp GROUP BY e.v)"""
_GIANT = "sizes_c AS (SELECT comp, count(*) AS s FROM cc GROUP BY comp)"



def _gaps(p: str) -> str:
    """Uniform growth by geometric gaps; the draws of a node are more than any needs."""
    return f"""WITH size AS (SELECT count(*) AS n, ceil(count(*) * 0.03::DOUBLE)::BIGINT AS delta FROM orders), agents AS (SELECT n + a AS src, n, {p} AS p FROM size, (SELECT unnest(range((SELECT delta FROM size))) AS a)),
    draws AS (SELECT src, n, p, unnest(range(400)) AS j FROM agents), gaps AS (SELECT src, n, sum(floor(ln({_u('src', chr(39) + 'gap:' + chr(39), 'j')}) / ln(1 - p)) + 1) OVER (PARTITION BY src ORDER BY j) - 1 AS dst FROM draws)
    SELECT src, dst::BIGINT AS dst FROM gaps WHERE dst < n"""


def _year(k: int, last: int, peaks: dict[int, str] | None = None) -> str:
    """The tables of the k-th simulated year, which follow from those of the year before; all but the last year's names
    get the year's number. `peaks` has what fitness is in a year where it is not the drawn peak."""
    text = EPOCH
    if k > 1:
        was, year = str(k - 1), 2001 + k
        text = text.replace(NODES, f"nodes AS (SELECT id, year FROM nodes{was} UNION ALL SELECT id, {year - 1} FROM agents{was})").replace(EDGES, f"edges AS (SELECT src, dst FROM edges{was} UNION SELECT src, dst FROM epoch{was})")
        text = text.replace(RECENCY + ", ", "").replace("recency r ON", "recency1 r ON").replace("2002 - year", f"{year} - year").replace(SIZE, SIZE.replace("FROM orders", "FROM nodes"))
    text = text.replace("k AS fitness_peak", f"{(peaks or {}).get(k, 'k')} AS fitness_peak")
    if k == last:
        return text
    names = [*re.findall(r"([a-z_][a-z_0-9]*)(?:\([a-z, ]+\))? AS \(", EPOCH), "first", "second"]
    known = re.compile(r"'[^']*'|\b(?:" + "|".join(sorted(set(names), key=len, reverse=True)) + r")\b")
    return known.sub(lambda m: m[0] if m[0].startswith("'") else f"{m[0]}{k}", text)


def _second_year() -> str:
    return f"WITH {_year(1, 2)}, {_year(2, 2)} SELECT src, dst, kind FROM epoch"


def _three_years() -> str:
    """With the fixture's planted nodes: what a line sets is 1 before its lag."""
    first = "WHEN year = 2002 AND id - (SELECT n FROM size1) < 3 THEN 900 WHEN year = 2002 AND id - (SELECT n FROM size1) < 5 THEN"
    peaks = {2: f"CASE {first} 1 ELSE k END", 3: f"CASE {first} 500 WHEN year = 2003 AND id - (SELECT n FROM size2) < 4 THEN 1000 ELSE k END"}
    parts = " UNION ALL ".join(f"SELECT {k} AS cycle, kind, count(*) AS edges FROM epoch{k if k < 3 else ''} GROUP BY kind" for k in (1, 2, 3))
    return f"WITH {', '.join(_year(k, 3, peaks) for k in (1, 2, 3))} SELECT 0 AS cycle, 'seed' AS kind, count(*) AS edges FROM edges1 UNION ALL {parts}"


SQL: dict[str, str] = {
    "scan_nodelist": f"WITH {NODES} SELECT * FROM nodes",
    "scan_edgelist": f"WITH {EDGES} SELECT src, dst FROM edges",
    "scan_delimited": f"WITH {EDGES} SELECT ['comma', 'tab', 'blank'][src % 3 + 1] AS file, src AS source, dst AS target FROM edges WHERE dst % 50 NOT IN (1, 2)",
    "scan_bag": f"WITH {BAG} SELECT pos, out_degree FROM bag",
    "scan_recency": f"WITH {NODES} SELECT (2002 - year)::INT AS age, arg_max(1::DOUBLE / (id % 97 + 1)::DOUBLE, id) AS prob FROM nodes GROUP BY 1",
    "scan_planted": """SELECT (1 + s_suppkey % 3)::INT AS year, row_number() OVER (ORDER BY s_suppkey)::INT AS line_no, (s_suppkey % 4)::INT AS lag, (1 + s_suppkey * 37 % 1000)::INT AS peak, (1 + s_suppkey % 6)::INT AS dur,
  CASE WHEN s_suppkey % 5 > 0 THEN 1 + s_suppkey % 4 ELSE 0 END::INT AS count FROM supplier""",
    "scan_wide_metrics": """SELECT concat('k<', l_returnflag, ', ', l_linestatus, '>') AS kernel, l_orderkey::DOUBLE AS key, l_quantity::DOUBLE * 1000 + 0.5::DOUBLE AS time, l_linenumber::DOUBLE AS lines, NULL::DOUBLE AS none
  FROM lineitem WHERE l_linenumber < 7""",
    "dense_ids": "SELECT c_custkey * 3 AS orig_id, row_number() OVER (ORDER BY c_custkey) - 1 AS seq_id FROM customer",
    "edge_encode_join": f"WITH {EDGES} SELECT DISTINCT src * 2 AS src, dst * 2 AS dst FROM edges JOIN orders s ON s.o_orderkey = src JOIN orders d ON d.o_orderkey = dst WHERE s.o_orderstatus <> 'P' AND d.o_orderstatus <> 'P'",
    "node_type_decode": f"WITH {NODES} SELECT id, CASE id % 3 WHEN 0 THEN 'seed' WHEN 1 THEN 'agent' ELSE 'undefined' END AS type FROM nodes",
    "dict_decode": f"WITH {KERNEL} SELECT event_id, name_id + event_id % 2 * 100 AS name_id, CASE WHEN event_id % 2 = 0 THEN name ELSE (name_id + 100)::VARCHAR END AS name FROM kernel",
    "multi_file_union": f"WITH {FILES} SELECT kernel, metric, value, years, agents, source FROM files",
    "metric_files_pivot": f"WITH {FILES} SELECT source, years, agents, kernel, " + ", ".join(f"round(avg(value) FILTER (metric = '{m}'), 6)::DOUBLE AS {m}" for m in ("achieved_occ_pct", "dram_bw_pct", "fp32_insts", "fp64_insts", "dram_bytes", "duration_ns", "l2_hit_pct", "sm_throughput_pct", "regs", "shmem_B", "shmem_dyn_B", "th_occ_pct", "waves_sm", "block_size", "grid_size", "thread_count")) + " FROM files GROUP BY ALL",
    "scenario_names": "SELECT DISTINCT l_returnflag AS kernel FROM lineitem",
    "undirected_edges": f"WITH {EDGES}, {UND} SELECT u, v FROM und",
    "edge_merge": f"WITH {EDGES} SELECT src, dst FROM edges UNION SELECT src, dst + 1 FROM edges",
    "adjacency_lists": f"WITH {EDGES}, {UND} SELECT u, string_agg(v::VARCHAR, ',' ORDER BY v) AS neighbours FROM und GROUP BY u",
    "degrees": f"WITH {GRAPH} SELECT * FROM deg",
    "degree_refresh": f"WITH {GRAPH} SELECT * FROM deg",
    "csr_offsets": f"WITH {GRAPH} SELECT id, (sum(out_degree) OVER (ORDER BY id) - out_degree)::BIGINT AS \"offset\", out_degree AS degree FROM deg",
    "degree_stats": f"WITH {GRAPH} SELECT " + ", ".join(f"round({f}({c})::DOUBLE, 9) AS {n}_{c}" for c in ("in_degree", "out_degree") for n, f in (("min", "min"), ("max", "max"), ("avg", "avg"), ("std", "stddev_pop"))) + " FROM deg",
    "graph_density": f"WITH {GRAPH} SELECT count(*) AS nodes, sum(out_degree)::BIGINT AS edges, round(sum(out_degree)::DOUBLE / (count(*)::DOUBLE * (count(*) - 1)), 12) AS density FROM deg",
    "isolated_nodes": f"WITH {GRAPH} SELECT count(*) FILTER (in_degree + out_degree = 0) AS isolated FROM deg",
    "degree_histogram": f"WITH {GRAPH} SELECT in_degree + out_degree AS degree, count(*) AS nodes FROM deg GROUP BY 1",
    "powerlaw_alpha": f"WITH {GRAPH} SELECT round(1 + count(*) / sum(ln(in_degree + out_degree)), 9) AS alpha FROM deg WHERE in_degree + out_degree > 0",
    "graph_statistics": f"WITH RECURSIVE {GRAPH}, {_CC}, {_GIANT}, stat AS ({_STAT} UNION ALL SELECT 'density', (SELECT count(*) FROM edges)::DOUBLE / (count(*)::DOUBLE * (count(*) - 1)) FROM deg UNION ALL SELECT 'isolated', count(*) FILTER (in_degree + out_degree = 0) FROM deg UNION ALL SELECT 'powerlaw_alpha', 1 + count(*) / sum(ln(in_degree + out_degree)) FROM deg WHERE in_degree + out_degree > 0 UNION ALL SELECT 'giant_size', max(s) FROM sizes_c UNION ALL SELECT 'giant_share', max(s) / sum(s) FROM sizes_c) SELECT metric, round(value, 9) AS value FROM stat",
    "giant_component": f"WITH RECURSIVE {GRAPH}, {_CC}, {_GIANT} SELECT max(s) AS giant_size, count(*) AS components, round((max(s) / sum(s))::DOUBLE, 9) AS giant_share FROM sizes_c",
    "age_histogram": f"WITH {NODES} SELECT 2002 - year AS age, count(*) AS nodes FROM nodes GROUP BY 1",
    "pa_scores": f"WITH {GRAPH} SELECT id, round((in_degree::DOUBLE ^ 3 + 1) / sum(in_degree::DOUBLE ^ 3 + 1) OVER (), 14) AS pa FROM deg",
    "recency_scores": f"WITH {NODES}, {RECENCY}, {REC} SELECT id, round(rec, 14) AS rec FROM rec",
    "fitness_decay": "WITH p AS (SELECT p_partkey, p_size::INT AS age, (p_partkey % 5)::INT AS lag, (1 + p_partkey % 1000)::INT AS peak, (p_partkey % 7)::INT AS dur FROM part) SELECT p_partkey, CASE WHEN age < lag THEN 1 WHEN age <= lag + dur THEN peak ELSE floor(peak::DOUBLE / (age - lag - dur + 1)::DOUBLE ^ 3)::INT END AS fitness FROM p",
    "candidate_score": f"WITH {GRAPH}, {RECENCY}, {REC} SELECT d.id, round((d.in_degree::DOUBLE ^ 3 + 1) / sum(d.in_degree::DOUBLE ^ 3 + 1) OVER () * 0.33::DOUBLE + rec.rec * 0.33::DOUBLE + 0.001::DOUBLE * 0.33::DOUBLE, 14) AS score FROM deg d JOIN rec ON rec.id = d.id",
    "generator_pick": f"WITH {AGENTS} SELECT id, generator FROM agents",
    "outdegree_draw": f"WITH {AGENTS} SELECT id, out_degree FROM agents",
    "agent_weights": f"WITH {AGENTS}, w AS (SELECT id, {_u('id', chr(39) + 'pa_weight' + chr(39))} AS a, {_u('id', chr(39) + 'rec_weight' + chr(39))} AS b, {_u('id', chr(39) + 'fit_weight' + chr(39))} AS c, {_u('id', chr(39) + 'alpha' + chr(39))} AS alpha FROM agents) SELECT id, round(a / (a + b + c), 12) AS pa_weight, round(b / (a + b + c), 12) AS rec_weight, round(c / (a + b + c), 12) AS fit_weight, round(alpha, 12) AS alpha FROM w",
    "same_year_flag": f"WITH {AGENTS} SELECT id, same_year FROM agents",
    "same_year_citation": f"WITH {AGENTS} SELECT id, n + {_p('id', chr(39) + 'own' + chr(39))} % delta AS cited FROM agents WHERE same_year",
    "agent_params": f"WITH {AGENTS} SELECT growth_idx, id, generator, same_year, out_degree, pa_weight, rec_weight, fit_weight, alpha FROM agents",
    "fitness_cdf": f"WITH {NODES}, {CDF}, {FIT_U}, hit AS (SELECT fitness_peak, count(*) AS n FROM peaks GROUP BY fitness_peak) SELECT k, round(hi, 10) AS hi, coalesce(n, 0) AS nodes FROM cdf LEFT JOIN hit ON fitness_peak = k",
    "fitness_draw": f"WITH {NODES}, {CDF}, {FIT_U} SELECT id, fitness_peak FROM peaks",
    "planted_nodes": """WITH size AS (SELECT count(*) AS n FROM orders), lines AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS line_no, s_suppkey % 4 AS lag, 1 + s_suppkey * 37 % 1000 AS peak, 1 + s_suppkey % 6 AS dur, 1 + s_suppkey % 3 + s_suppkey % 2 AS c FROM supplier WHERE s_suppkey % 3 = 0),
      plan AS (SELECT *, sum(c) OVER (ORDER BY line_no) - c AS lo, sum(c) OVER (ORDER BY line_no) AS hi FROM lines)
      SELECT n + g AS id, line_no, lag, peak, dur FROM size, (SELECT unnest(range((SELECT max(hi) FROM plan)::BIGINT)) AS g) JOIN plan ON g >= lo AND g < hi""",
    "events_in_ranges": f"""WITH {KERNEL}, span AS (SELECT event_id AS span, event_id * 1000 + user_id * 7 AS lo, event_id * 1000 + user_id * 7 + CASE WHEN event_id % 100 = 1 THEN 20000 ELSE user_id % 40 * 50 END AS hi FROM events WHERE event_id % 3 > 0)
      SELECT event_id, span FROM (SELECT event_id, start + event_id % 17 * 90 AS p FROM kernel) k JOIN span ON p >= lo AND p < hi""",
    "one_hop": f"WITH {GRAPH}, {STARTS}, {HOPS} SELECT g, n FROM hops WHERE hop = 1",
    "two_hop": f"WITH {GRAPH}, {STARTS}, {HOPS} SELECT g, n FROM hops WHERE hop = 2",
    "hop_sizes": f"WITH {GRAPH}, {STARTS}, {HOPS} SELECT g, count(*) FILTER (hop = 1) AS h1, count(*) FILTER (hop = 2) AS h2 FROM hops GROUP BY g",
    "citation_quota": f"WITH {GRAPH}, {AGENTS}, {QUOTA} SELECT id, reserved, inside, outside, random FROM quota",
    "weighted_topk": f"WITH {GRAPH}, {AGENTS}, {QUOTA}, s AS (SELECT id AS node, (in_degree::DOUBLE ^ 3 + 1) / sum(in_degree::DOUBLE ^ 3 + 1) OVER () AS score FROM deg) SELECT c.id, c.node FROM cand c JOIN agents a ON a.id = c.id JOIN s ON s.node = c.node QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY ln({_u('c.id', chr(39) + 'cand:' + chr(39), 'c.node')}) / score DESC, c.node) <= a.out_degree",
    "uniform_fill": f"WITH {GRAPH}, {AGENTS}, {QUOTA}, need AS (SELECT id, random FROM quota), taken AS (SELECT id, generator AS node FROM quota), {FILL % '((SELECT n FROM size) - 1)'} SELECT id, node FROM fill",
    "simulate_one_year": f"WITH {EPOCH} SELECT src, dst, kind FROM epoch",
    "epoch_edges": f"WITH {EPOCH} SELECT kind, count(*) AS edges FROM epoch GROUP BY kind",
    "final_graph_size": "WITH RECURSIVE g(c, n) AS (SELECT 0, count(*) FROM orders UNION ALL SELECT c + 1, n + ceil(n * 0.03::DOUBLE)::BIGINT FROM g WHERE c < 30) SELECT c AS cycles, n AS nodes FROM g WHERE c IN (3, 10, 30)",
    "er_gnp_edges": _gaps("0.001::DOUBLE"),
    "er_edges_per_node": _gaps("4::DOUBLE / n"),
    "batched_year": f"WITH {EPOCH} SELECT src, dst, kind FROM epoch",
    "program_year": f"WITH {EPOCH} SELECT src::BIGINT AS source, dst::BIGINT AS target FROM edges UNION ALL SELECT src, dst FROM epoch",
    "simulate_second_year": _second_year(),
    "simulate_three_years": _three_years(),
    "simulated_attributes": f"""WITH {EPOCH}, born AS (SELECT id, {_u('id', chr(39) + 'fitness' + chr(39))} AS u FROM agents), total AS (SELECT src, count(*) AS c FROM epoch GROUP BY src)
      SELECT a.id * 2 AS node_id, 2002 AS year, '0.3333333333' AS pa_weight, k AS fit_peak_value, '0.5' AS alpha, t.c AS out_degree, a.out_degree AS assigned_out_degree, 0 AS planted_nodes_line_number, (a.generator * 2)::VARCHAR AS generator_node_string
      FROM agents a JOIN born b ON b.id = a.id JOIN cdf ON u > lo AND (u <= hi OR k = 1000) JOIN total t ON t.src = a.id""",
    "sink_edges": f"WITH {EDGES} SELECT concat(src * 10 + 3, ',', dst * 10 + 3) AS line FROM edges",
    "sink_edge_file": f"WITH {EDGES} SELECT 0::BIGINT AS line_no, '#source,target' AS line UNION ALL SELECT row_number() OVER (ORDER BY src, dst), concat(src, ',', dst) FROM edges",
    "paper_table": r"""WITH found AS (SELECT concat(l_returnflag, '\_', l_linestatus) AS name, count(*) AS lines, sum(l_quantity::DOUBLE) AS quantity, max(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) AS most FROM lineitem GROUP BY 1),
cells AS (SELECT 2 AS part, row_number() OVER (ORDER BY name) AS k, concat(name, ' & ', format('{:,}', lines), ' & ', format('{:,.2f}', quantity), ' & ', coalesce(format('{:,}', most), '-'), ' \\') AS line FROM found),
parts AS (SELECT 1 AS part, unnest(range(8)) AS k, unnest(['\begin{table}[t]', '\centering', '\caption{Lines by flag}', '\label{tab:flags}', '\begin{tabular}{lrrr}', '\hline', 'flag\_status & lines & quantity & most \\', '\hline']) AS line
  UNION ALL SELECT * FROM cells UNION ALL SELECT 3, unnest(range(3)), unnest(['\hline', '\end{tabular}', '\end{table}']))
SELECT row_number() OVER (ORDER BY part, k) - 1 AS line_no, line FROM parts""",
    "sink_attributes": f"""WITH {GRAPH}, {CDF}, {FIT_U} SELECT d.id AS node_id, CASE WHEN s THEN 'seed' ELSE 'agent' END AS type, year, CASE WHEN s THEN '-1' ELSE printf('%.10g', 1 / (d.id::DOUBLE + 1)) END AS pa_weight, CASE WHEN s THEN '-1' ELSE printf('%.10g', d.id::DOUBLE / 1e9) END AS rec_weight, CASE WHEN s THEN '-1' ELSE '0.25' END AS fit_weight,
      0 AS fit_lag_duration, fitness_peak AS fit_peak_value, 1000 AS fit_peak_duration, CASE WHEN s THEN '-1' ELSE ['0', '0.5', '1'][d.id % 3 + 1] END AS alpha, in_degree, out_degree, CASE WHEN s THEN -1 ELSE 7 END AS assigned_out_degree, CASE WHEN s THEN -1 WHEN d.id % 10 = 1 THEN 2 ELSE 0 END AS planted_nodes_line_number, CASE WHEN s THEN 'no_generators' ELSE (d.id + 1)::VARCHAR END AS generator_node_string
      FROM (SELECT *, id % 2 = 0 AS s FROM deg) d JOIN peaks p ON p.id = d.id""",
    "general_format": "SELECT l_orderkey, l_linenumber, printf('%.10g', round_even(l_extendedprice::DOUBLE * pow(10::DOUBLE, l_linenumber * 5 - 20) * CASE WHEN l_orderkey % 2 = 0 THEN -1 ELSE 1 END, 12)) AS text FROM lineitem",
    "trace_string_join": f"WITH {KERNEL} SELECT event_id, name, fin - start AS ns FROM kernel",
    "kernel_summary": f"WITH {KERNEL}, k AS (SELECT *, (fin - start)::DOUBLE AS d FROM kernel) SELECT name, count(*) AS calls, round(sum(d), 6) AS total_ns, round(avg(d), 6) AS avg_ns, round(min(d), 6) AS min_ns, round(max(d), 6) AS max_ns, round(avg(regs), 6) AS avg_regs, round(avg(block), 6) AS avg_block, round(avg(grid), 6) AS avg_grid FROM k GROUP BY name",
    "profiler_reports": f"""WITH {LAUNCH}, k AS (SELECT name, any_value(short) AS short, count(*) AS n, sum(fin - start)::BIGINT AS ns, avg(fin - start) AS mean, floor(avg(regs))::BIGINT AS regs, floor(avg(block_x))::BIGINT AS block, floor(avg(shared_static))::BIGINT + floor(avg(shared_dynamic))::BIGINT AS shared FROM launch GROUP BY name),
      kp AS (SELECT *, row_number() OVER (ORDER BY ns DESC, name) AS place, sum(ns) OVER () AS total FROM k), c AS (SELECT (event_id % 16)::INT AS kind, count(*) AS ops, sum(floor(abs(value) * 1000))::BIGINT AS bytes, sum(user_id % 50)::BIGINT AS ns FROM events GROUP BY 1),
      one AS (SELECT (SELECT max(event_id) * 2000 FROM events)::DOUBLE AS session, (SELECT sum(ns) FROM k)::DOUBLE AS kernel, (SELECT sum(n) FROM k) AS launches, (SELECT sum(ns) FROM c)::DOUBLE AS copies, (SELECT sum(event_id % 7) FROM events)::DOUBLE AS sync)
      SELECT 'kernels' AS report, place::INT AS place, short AS name, n, round(ns / 1e6::DOUBLE, 6) AS ms, round(round_even(100 * ns / total::DOUBLE, 2), 6) AS share FROM kp
      UNION ALL SELECT 'occupancy', place, CASE WHEN regs > 40 THEN 'reg' WHEN shared > 0 THEN 'shmem' WHEN block < 64 THEN 'block' ELSE 'thr' END, regs, round(mean / 1e6::DOUBLE, 6), CASE WHEN block = 0 THEN 0 ELSE {_percent('regs', 'block', 'shared', 48, *DEVICE_ROW)} END FROM kp
      UNION ALL SELECT 'memcpy', row_number() OVER (ORDER BY bytes DESC, kind), ['Unknown', 'H2D', 'D2H', 'H2A', 'A2H', 'A2A', 'A2D', 'D2A', 'D2D', 'H2H', 'P2P', 'UVM_H2D', 'UVM_D2H', 'UVM_D2D', 'kind14', 'kind15'][kind + 1], ops, round(ns / 1e6::DOUBLE, 6), round(CASE WHEN ns > 0 THEN bytes / ns::DOUBLE ELSE 0 END, 6) FROM c
      UNION ALL SELECT 'summary', 1, 'session', launches, round(session / 1e6::DOUBLE, 6), round_even(kernel / (0.8::DOUBLE * session) * 100, 2) FROM one UNION ALL SELECT 'summary', 2, 'copies', NULL, round(sync / 1e6::DOUBLE, 6), round_even(copies / kernel * 100, 2) FROM one
      UNION ALL SELECT 'gpu_util', 1, '3y/6%', NULL, NULL, round_even(kernel / session * 100, 2) FROM one
      UNION ALL (SELECT 'ranges', NULL, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN concat('nvtx_', 900 + user_id % 3) ELSE concat('own', user_id % 2) END AS name, count(*), round(sum(user_id) / 1e6::DOUBLE, 6) AS ms, NULL FROM events WHERE event_id % 11 > 0 AND event_id % 9 > 0 GROUP BY 3 ORDER BY ms DESC, name LIMIT 20)
      UNION ALL SELECT 'capture', NULL, 'grow --a b@node7', NULL, NULL, NULL""",
    "memcpy_summary": f"WITH {COPY} SELECT kind, {_KIND} AS name, count(*) AS ops, sum(bytes)::BIGINT AS bytes, sum(dur)::BIGINT AS total, round(avg(bytes), 6) AS mean, max(bytes) AS largest, round(CASE WHEN sum(dur) > 0 THEN sum(bytes)::DOUBLE / sum(dur)::DOUBLE ELSE 0 END, 6) AS bandwidth FROM copy GROUP BY kind",
    "memset_total": f"WITH {COPY} SELECT count(*) AS ops, coalesce(sum(bytes), 0)::BIGINT AS bytes, coalesce(sum(dur), 0)::BIGINT AS total FROM copy WHERE kind = 7",
    "api_summary": f"WITH {STRINGS}, calls AS (SELECT 1 + event_id % 9 AS name_id, event_id % 37 AS ns FROM events) SELECT coalesce(value, concat('api_', name_id)) AS name, count(*) AS calls, sum(ns)::BIGINT AS total_ns, round(avg(ns), 6) AS avg_ns FROM calls LEFT JOIN strings ON id = name_id GROUP BY name_id, value",
    "sync_summary": f"WITH {KERNEL} SELECT CASE event_id % 4 WHEN 0 THEN 'event' WHEN 1 THEN 'stream wait' WHEN 2 THEN 'stream' ELSE '3' END AS label, count(*) AS n, sum(fin - start)::BIGINT AS total_ns FROM kernel GROUP BY 1",
    "range_topk": "SELECT coalesce(CASE WHEN user_id % 2 = 0 THEN event_type END, concat('user', user_id)) AS text, count(*) AS n, sum(user_id)::BIGINT AS total_ns FROM events WHERE event_id % 9 > 0 AND event_id % 11 > 0 GROUP BY 1 ORDER BY total_ns DESC, text LIMIT 20",
    "positive_rows": f"WITH {KERNEL} SELECT name_id, block, round(sum(CASE WHEN regs > 60 THEN fin - start ELSE 0 END) / 1e6::DOUBLE, 6) AS \"Total_ms\", count(*) AS \"Launches\" FROM kernel WHERE block < 512 GROUP BY ALL HAVING sum(CASE WHEN regs > 60 THEN fin - start ELSE 0 END) > 0",
    "busy_ratio": f"WITH {KERNEL} SELECT round(sum(fin - start)::DOUBLE / (max(fin) - min(start))::DOUBLE, 9) AS ratio FROM kernel",
    "time_decomposition": f"WITH {KERNEL}, {COPY}, a AS (SELECT sum(fin - start)::DOUBLE AS kernel, (max(fin) - min(start))::DOUBLE AS wall FROM kernel), b AS (SELECT sum(dur) FILTER (kind < 7)::DOUBLE AS copy, sum(dur) FILTER (kind = 7)::DOUBLE AS set_ FROM copy) SELECT round(wall, 3) AS wall, round(kernel, 3) AS kernel, round(copy, 3) AS copy, round(set_, 3) AS \"set\", round(greatest(wall - kernel - copy - set_, 0), 3) AS other, round(kernel / wall, 9) AS kernel_share FROM a, b",
    "launch_signature": f"""WITH {LAUNCH}, g AS (SELECT kept AS kernel, {THREADS} AS block, grid_x * grid_y AS grid, regs, shared_static, shared_dynamic, coalesce(local, 0) AS local, count(*) AS launches, sum(fin - start)::BIGINT AS ns FROM launch GROUP BY ALL)
      SELECT kernel, block, grid, regs, shared_static, shared_dynamic, local, launches, ns / 1e6::DOUBLE AS total_ms, ns / 1e6::DOUBLE / launches AS avg_ms, {_percent('regs', 'block', MEMORY, 64, *H100_LIMITS)} AS occupancy, {_limiter('regs', 'block', MEMORY, *H100_LIMITS)} AS limiter, round(100 * ns::DOUBLE / sum(ns::DOUBLE) OVER (), 6) AS share FROM g""",
    "kernel_share": f"WITH {LAUNCH}, g AS (SELECT short AS kernel, count(*) AS launches, sum(fin - start)::DOUBLE AS ns, avg(grid_x * grid_y) AS grid, avg({THREADS}) AS block FROM launch GROUP BY short) SELECT kernel, launches, round(ns / 1e9::DOUBLE, 9) AS total_s, round(100 * ns / sum(ns) OVER (), 6) AS share, round(grid, 6) AS grid, round(block, 6) AS block FROM g",
    "kernel_first_seen": f"WITH {LAUNCH}, g AS (SELECT name, count(*) AS count, sum(fin - start)::BIGINT AS total_ns, min(fin - start) AS min_ns, max(fin - start) AS max_ns, min(event_id) AS e FROM launch GROUP BY name) SELECT g.name, count, total_ns, min_ns, max_ns, regs, block_x, shared_static, local, CASE WHEN block_x = 0 THEN 0 ELSE {_percent('regs', 'block_x', 'shared_static', 64, *H100)} END AS occupancy FROM g JOIN launch l ON l.event_id = g.e",
    "gpu_utilisation": f"WITH {KERNEL}, busy AS (SELECT round(100 * sum(fin - start)::DOUBLE / (max(fin) - min(start)), 9) AS b FROM kernel) SELECT 0 AS \"case\", round(avg(value::DOUBLE), 9) AS percent, false AS approximate FROM events WHERE event_id % 5 = 2 UNION ALL SELECT c, b, true FROM busy, (VALUES (1), (2), (3)) v(c) UNION ALL SELECT 4, NULL, true",
    "session_metrics": f"WITH {KERNEL}, {COPY}, a AS (SELECT sum(fin - start)::DOUBLE AS kernel, (max(fin) - min(start))::DOUBLE AS session FROM kernel), b AS (SELECT sum(bytes)::DOUBLE AS bytes, sum(dur)::DOUBLE AS copy FROM copy) SELECT round(100 * (kernel / (0.8::DOUBLE * session)), 9) AS util_scaled, round(100 * (kernel / session), 9) AS util, round(100 * (copy / kernel), 9) AS copy_over_kernel, round(100 * (copy / (copy + kernel)), 9) AS copy_share, round(bytes / copy, 6) AS bandwidth, round(100 * (bytes / copy / 3350::DOUBLE), 6) AS peak_percent FROM a, b",
    "topn_per_group": f"WITH {COPY}, s AS (SELECT run, kind, sum(bytes)::BIGINT AS bytes FROM copy GROUP BY run, kind) SELECT run, kind, bytes, row_number() OVER (PARTITION BY run ORDER BY bytes DESC, kind) AS rank FROM s QUALIFY rank <= 3",
    "custom_order": "SELECT event_type, count(*) AS n, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 99 END AS place FROM events GROUP BY event_type",
    "cmdline_join": "SELECT l_orderkey, string_agg(concat('--p', l_partkey), ' ' ORDER BY l_linenumber, concat('--p', l_partkey)) AS command FROM lineitem GROUP BY l_orderkey",
    "memcpy_by_code": f"WITH coded AS (SELECT CASE WHEN l_orderkey % 10 = 1 THEN 0 ELSE l_linenumber + l_orderkey % 2 * 7 END::INT AS kind, floor(l_extendedprice)::BIGINT AS bytes FROM lineitem) SELECT kind, {_KIND} AS name, count(*) AS ops, sum(bytes)::BIGINT AS bytes FROM coded GROUP BY kind",
    "memcpy_kind_decode": f"WITH {COPY} SELECT DISTINCT kind, {_KIND} AS name FROM copy",
    "metric_pivot": f"WITH {METRIC} SELECT kernel, " + ", ".join(f"round(avg(value) FILTER (metric = 'm{k}'), 9) AS m{k}" for k in range(1, 8)) + " FROM metric GROUP BY kernel",
    "memcpy_pivot": f"WITH {COPY}, c AS (SELECT * FROM copy WHERE kind <> 3 OR run <> 'R') SELECT run, row_number() OVER (ORDER BY min(pos)) AS place, " + ", ".join(f"coalesce(sum(bytes) FILTER (kind = {k}), 0)::BIGINT AS k{k}" for k in (1, 2, 3)) + " FROM c GROUP BY run",
    "weighted_mean": f"WITH {METRIC} SELECT kernel, metric, round({_WMEAN.format(v='value', w='weight')}, 9) AS mean FROM metric GROUP BY kernel, metric",
    "divergence_summary": f"""WITH b AS (SELECT concat(l_returnflag, l_linestatus) AS kernel, l_quantity::DOUBLE AS q, l_linenumber AS n, l_extendedprice::DOUBLE AS x FROM lineitem),
      r AS (SELECT kernel, CASE WHEN n <> 7 THEN q % 33 END AS active, CASE WHEN kernel <> 'AF' THEN q % 32 END AS pred_on, CASE WHEN kernel <> 'NO' THEN 50 + q END AS uniform, q + n AS targets, CASE WHEN n > 1 THEN floor(q / 3) END AS divergent, CASE WHEN kernel = 'RF' AND n = 2 THEN 0 WHEN kernel = 'NF' AND n = 2 THEN 0 ELSE x END AS w FROM b),
      g AS (SELECT kernel, count(*) AS launches, {_WMEAN.format(v='active', w='w')} AS a, {_WMEAN.format(v='pred_on', w='w')} AS p, {_WMEAN.format(v='uniform', w='w')} AS u, sum(coalesce(divergent, 0)) / sum(targets) * 100 AS d FROM r GROUP BY kernel)
      SELECT kernel, launches, round_even(a, 2) AS active_threads_per_warp, round_even(a / 32 * 100, 1) AS thread_util_pct, round_even(p, 2) AS pred_on_threads_per_warp, round_even(p / 32 * 100, 1) AS pred_util_pct, round_even(u, 1) AS branch_uniform_pct, round_even(coalesce(100 - u, d), 1) AS divergence_pct, round_even(d, 1) AS divergence_pct_recomputed FROM g""",
    "report_cells": "WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size END AS size, CASE WHEN p_size % 5 > 0 THEN p_retailprice::DOUBLE END AS price, p_partkey % 3 AS kind, CASE p_partkey % 3 WHEN 0 THEN p_partkey * 12345 WHEN 1 THEN p_partkey * 2 + 0.5 ELSE (p_partkey % 997) / 8 END::DOUBLE AS big, p_partkey * 97 AS s FROM part) SELECT p_partkey, coalesce(size, -9999)::INT AS size, coalesce(price, -9999.9::DOUBLE) AS price, coalesce(size::VARCHAR, '-') AS cell, CASE WHEN max(abs(big)) OVER same > 1e6 THEN concat(printf('%.2f', big / 1e6::DOUBLE), 'M') WHEN max(abs(big)) OVER same > 1e3 THEN printf('%.0f', big) ELSE printf('%.2f', big) END AS count, concat(s // 86400, '-', s // 3600 % 24, ':', s // 60 % 60, ':', s % 60) AS elapsed FROM p WINDOW same AS (PARTITION BY kind)",
    "baseline_delta": f"WITH {METRIC}, m AS (SELECT kernel, scenario, avg(value) AS mean FROM metric GROUP BY ALL) SELECT m.kernel, m.scenario, round(m.mean, 9) AS mean, round(m.mean - b.mean, 9) AS delta FROM m LEFT JOIN m b ON b.kernel = m.kernel AND b.scenario = 'F'",
    "health_flags": f"WITH {KERNEL} SELECT event_id, {_percent('regs', 'block', 'shmem', 64, *H100)} < 25 AS low_occupancy, event_id % 20 < 10 AS low_bandwidth, grid / 132::DOUBLE < 1 AS few_waves, regs > 64 AS many_registers, event_id % 100 < 50 AS low_l2 FROM kernel",
    "clean_numeric": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN (1000 + o_orderkey % 1000)::DOUBLE + 0.5::DOUBLE END AS value FROM orders",
    "lenient_cast": "SELECT o_orderkey, (CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN -o_orderkey WHEN 2 THEN 0 ELSE o_orderkey END)::INT AS value FROM orders",
    "normalize_name": f"WITH {LAUNCH} SELECT s.name, count(*) AS launches, s.short, s.kept, s.by_part FROM launch l JOIN signature s ON s.name = l.name GROUP BY ALL",
    "infer_label": "WITH n AS (SELECT n_nationkey, n_nationkey % 4 AS c, n_nationkey + 1 AS y, n_nationkey % 6 + 1 AS g FROM nation) SELECT n_nationkey, CASE WHEN c < 2 THEN concat(y, 'y/', g, '%') WHEN c = 2 THEN concat('run_', y, 'y', g, 'p') ELSE 'base.one' END AS label, CASE WHEN c = 0 THEN y::INT END AS years, CASE WHEN c = 0 THEN g::INT END AS agents FROM n",
    "scenario_grid": "SELECT DISTINCT [3, 10, 30][n_nationkey % 3 + 1]::INT AS years, (n_nationkey % 6 + 1)::INT AS growth FROM nation WHERE n_nationkey % 6 + 1 IN (1, 3, 5, 6)",
    "occupancy": f"WITH {LAUNCH} SELECT event_id, CASE WHEN block_x = 0 THEN 0 ELSE {_percent('regs', 'block_x', MEMORY, 64, *H100)} END AS h100, CASE WHEN block_x = 0 THEN 0 ELSE {_percent('regs', 'block_x', MEMORY, 48, *DEVICE_ROW)} END AS by_row FROM launch",
    "occupancy_limiter": f"WITH {LAUNCH} SELECT event_id, {_percent('regs', THREADS, MEMORY, 48, *RTX)} AS percent, {_limiter('regs', THREADS, MEMORY, *RTX)} AS limiter, CASE WHEN regs > 40 THEN 'reg' WHEN {MEMORY} > 0 THEN 'shmem' WHEN {THREADS} < 64 THEN 'block' ELSE 'thr' END AS by_threshold FROM launch",
    "roofline": """WITH m AS (SELECT l_orderkey, l_linenumber, 2 * (CASE WHEN l_linenumber > 1 THEN l_quantity::DOUBLE * 100 ELSE 0 END + CASE WHEN l_linenumber < 6 THEN l_quantity::DOUBLE * 7 ELSE 0 END) AS flops, CASE WHEN l_linenumber < 7 THEN l_extendedprice::DOUBLE / 100 END AS bytes, l_partkey AS ns FROM lineitem),
      k AS (SELECT *, CASE WHEN bytes > 0 AND ns > 0 AND flops > 0 THEN flops / bytes END AS ai FROM m)
      SELECT l_orderkey, l_linenumber, round(ai, 9) AS ai, round(CASE WHEN ai IS NOT NULL THEN flops / (ns::DOUBLE * 1e-9::DOUBLE) / 1e9::DOUBLE END, 9) AS gflops, round(CASE WHEN ai IS NOT NULL THEN least(ai * 3350::DOUBLE, 67000::DOUBLE) END, 6) AS ceiling, CASE WHEN ai >= 67000::DOUBLE / 3350::DOUBLE THEN 'compute' WHEN ai IS NOT NULL THEN 'memory' END AS bound FROM k""",
    "epoch_stats": f"WITH {PHASE} SELECT phase, round(sum(seconds), 9) AS total, round(avg(seconds), 9) AS mean, round(min(seconds), 9) AS least, round(max(seconds), 9) AS largest, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(seconds) END, 9) AS std FROM phases GROUP BY phase",
    "time_distribution": f"WITH {PHASE} SELECT phase, round(sum(seconds), 6) AS seconds, round(100 * sum(seconds) / sum(sum(seconds)) OVER (), 9) AS percent FROM phases GROUP BY phase",
    "pipeline_breakdown": f"WITH {PHASE}, p AS (SELECT sum(seconds) AS total, " + ", ".join(f"sum(seconds) FILTER (phase = 'phase{k}') AS p{k}" for k in (1, 2, 3)) + ", sum(bytes)::DOUBLE AS edges FROM phases) SELECT total, p1, p2, p3, greatest(total - p1 - p2 - p3, 0) AS unaccounted, round(coalesce(edges / total, 0), 6) AS rate FROM p",
}
SQL["statistics_by_year"] = SQL["graph_statistics"]
SQL["metric_report"] = f"""WITH {FILES}, wide AS (SELECT source, years, agents, kernel, avg(value) FILTER (metric = 'fp32_insts') AS a, avg(value) FILTER (metric = 'fp64_insts') AS b, avg(value) FILTER (metric = 'dram_bw_pct') AS c, avg(value) FILTER (metric = 'dram_bytes') AS d, avg(value) FILTER (metric = 'duration_ns') AS e FROM files GROUP BY ALL),
  long AS (SELECT source, years, agents, kernel, unnest(['FP32 Pred-ON Insts', 'FP64 Pred-ON Insts', 'Total Pred-ON Insts (Divergence Proxy)', 'DRAM BW Util (% peak)', 'DRAM Bytes Transferred', 'Kernel Duration (ns)']) AS label, unnest([a, b, coalesce(a, 0) + coalesce(b, 0), c, d, e]) AS x FROM wide)
  SELECT source, years, agents, kernel, label, CASE WHEN x IS NULL THEN '' WHEN max(abs(x)) OVER same > 1e6 THEN concat(printf('%.2f', x / 1e6::DOUBLE), 'M') WHEN max(abs(x)) OVER same > 1e3 THEN printf('%.0f', x) ELSE printf('%.2f', x) END AS cell FROM long WINDOW same AS (PARTITION BY label)"""
