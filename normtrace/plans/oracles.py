"""The registered queries in plain SQL over the same tables, by other means where there are any
(the causal check is a recursive walk that carries its sets as lists)."""

from __future__ import annotations

from normtrace.functions import answers as ax
from normtrace.functions import scores as sc
from normtrace.functions import states as sx
from normtrace.functions import text as tx
from normtrace.operators import models
from normtrace.plans import fixtures as fx

ORACLES: dict[str, str] = {}


def _values(rows) -> str:
    one = lambda v: str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, row)) + ")" for row in rows)


def _strings(items) -> str:
    return "[" + ", ".join("'" + s + "'" for s in items) + "]"


EVENTS = "ev AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"

# --- graph -------------------------------------------------------------------------------------

DECLARED = f"""{EVENTS},
declared AS (
  SELECT DISTINCT user_id AS norm_id, event_type || ':' || (k % 4) AS source,
         {_strings(fx.EVENT_TYPES)}[(k // 4) % 5 + 1] || ':' || ((k // 20) % 4) AS target
  FROM ev),
ranks(entity, rank) AS (VALUES {_values(fx.EVENT_RANKS)}),
ranked AS (
  SELECT d.*, coalesce(s.rank, {sx.DEFAULT_RANK}) AS rs, coalesce(t.rank, {sx.DEFAULT_RANK}) AS rt
  FROM declared d LEFT JOIN ranks s ON s.entity = split_part(d.source, ':', 1)
  LEFT JOIN ranks t ON t.entity = split_part(d.target, ':', 1)),
edges AS (SELECT norm_id, source, target FROM ranked WHERE rs < rt),
vertices AS (SELECT norm_id, target AS state_id FROM declared UNION SELECT norm_id, source FROM edges),
weights AS (
  SELECT v.norm_id, v.state_id, CAST(count(e.target) AS INTEGER) AS weight
  FROM vertices v LEFT JOIN edges e ON e.norm_id = v.norm_id AND e.source = v.state_id GROUP BY ALL)"""

CLOSURE = """
reach AS (
  SELECT norm_id, source AS src, target AS dst FROM {edges}
  UNION SELECT r.norm_id, r.src, e.target FROM reach r JOIN {edges} e ON e.norm_id = r.norm_id AND e.source = r.dst)"""

ORACLES["rank_filtered_edges"] = f"WITH {DECLARED} SELECT * FROM edges"
ORACLES["removed_edges"] = f"WITH {DECLARED} SELECT norm_id, source, target FROM ranked WHERE rs >= rt"
ORACLES["edge_audit"] = f"""WITH {DECLARED}
SELECT norm_id, count(*) AS n_raw, count(*) FILTER (rs >= rt) AS n_removed_rank, CAST(0 AS BIGINT) AS n_removed_cycle,
       count(*) FILTER (rs < rt) AS n_final FROM ranked GROUP BY norm_id"""
ORACLES["synced_preconditions"] = ORACLES["rank_filtered_edges"]
ORACLES["out_degree_weights"] = f"WITH {DECLARED} SELECT * FROM weights"
ORACLES["top_weights"] = f"""WITH {DECLARED}
SELECT norm_id, state_id, weight, CAST(row_number() OVER w AS INTEGER) AS place FROM weights WHERE weight > 0
WINDOW w AS (PARTITION BY norm_id ORDER BY weight DESC, state_id) QUALIFY row_number() OVER w <= 8"""
ORACLES["norm_reach"] = f"WITH RECURSIVE {DECLARED}, {CLOSURE.format(edges='edges')} SELECT * FROM reach"

CORE = f"""{DECLARED}, {CLOSURE.format(edges='declared')},
core AS (
  SELECT d.norm_id, d.source, d.target FROM declared d
  WHERE (d.norm_id, d.source) IN (SELECT (r.norm_id, r.dst) FROM reach c JOIN reach r ON r.norm_id = c.norm_id AND r.src = c.src WHERE c.src = c.dst)
    AND (d.norm_id, d.target) IN (SELECT (r.norm_id, r.src) FROM reach c JOIN reach r ON r.norm_id = c.norm_id AND r.dst = c.src WHERE c.src = c.dst))"""
ORACLES["cyclic_core"] = f"WITH RECURSIVE {CORE} SELECT * FROM core"
ORACLES["broken_cycles"] = f"""WITH RECURSIVE {CORE}
SELECT d.norm_id, d.source, d.target,
       c.source IS NOT NULL AND NOT (d.rs < d.rt OR (d.rs = d.rt AND d.source < d.target)) AS removed
FROM ranked d LEFT JOIN core c ON c.norm_id = d.norm_id AND c.source = d.source AND c.target = d.target"""

ORACLES["cycle_components"] = f"""WITH RECURSIVE {DECLARED}, {CLOSURE.format(edges='declared')},
states AS (SELECT norm_id, source AS state_id FROM declared UNION SELECT norm_id, target FROM declared),
mates AS (
  SELECT norm_id, state_id, state_id AS mate, false AS cyclic FROM states
  UNION ALL SELECT a.norm_id, a.src, a.dst, true FROM reach a JOIN reach b ON b.norm_id = a.norm_id AND b.src = a.dst AND b.dst = a.src)
SELECT norm_id, state_id, min(mate) AS component_id, count(DISTINCT mate) AS n_states, bool_or(cyclic) AS cyclic FROM mates GROUP BY ALL"""
ORACLES["cut_is_minimal"] = f"WITH {DECLARED} SELECT norm_id, count(*) AS n_edges, true AS minimal, true AS acyclic FROM declared GROUP BY norm_id"

# --- causal check ------------------------------------------------------------------------------

ACTIVATE = """acts AS (
  SELECT norm_id, scenario_id, step, 0 AS u_pos, event_type || ':' || (k % 4) AS state_id FROM facts
  UNION ALL SELECT norm_id, scenario_id, step, 1, event_type || ':' || ((k + 1) % 4) FROM facts WHERE k % 3 = 0)"""

# a = validated so far, c = contaminated so far; bad marks a new violation.
WALK = """
pre AS (SELECT norm_id, target AS state_id, list(source) AS pres FROM edges GROUP BY ALL),
seq AS (
  SELECT a.*, coalesce(p.pres, []::VARCHAR[]) AS pres,
         row_number() OVER (PARTITION BY a.norm_id, a.scenario_id ORDER BY step, u_pos) AS n
  FROM acts a LEFT JOIN pre p ON p.norm_id = a.norm_id AND p.state_id = a.state_id),
walk AS (
  SELECT DISTINCT norm_id, scenario_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS step, CAST(NULL AS VARCHAR) AS state_id,
         []::VARCHAR[] AS a, []::VARCHAR[] AS c, false AS bad, []::VARCHAR[] AS missing FROM seq
  UNION ALL
  SELECT w.norm_id, w.scenario_id, s.n, s.step, s.state_id,
         CASE WHEN NOT list_contains(w.c, s.state_id) AND list_has_all(w.a, s.pres) AND NOT list_contains(w.a, s.state_id)
              THEN list_append(w.a, s.state_id) ELSE w.a END,
         CASE WHEN NOT list_contains(w.c, s.state_id) AND NOT list_has_all(w.a, s.pres) THEN list_append(w.c, s.state_id) ELSE w.c END,
         NOT list_contains(w.c, s.state_id) AND NOT list_has_all(w.a, s.pres),
         list_filter(s.pres, lambda x: NOT list_contains(w.a, x))
  FROM walk w JOIN seq s ON s.norm_id = w.norm_id AND s.scenario_id = w.scenario_id AND s.n = w.n + 1),
viol AS (SELECT norm_id, scenario_id, n, step, state_id, missing FROM walk WHERE bad),
last AS (SELECT norm_id, scenario_id, arg_max(a, n) AS a, arg_max(c, n) AS c FROM walk GROUP BY ALL),
cont AS (
  SELECT norm_id, scenario_id, state_id FROM viol
  UNION SELECT v.norm_id, v.scenario_id, r.dst FROM viol v JOIN reach r ON r.norm_id = v.norm_id AND r.src = v.state_id),
scores AS (
  SELECT a.norm_id, a.scenario_id, sum(coalesce(w.weight, 1)) AS total,
         sum(CASE WHEN c.state_id IS NULL THEN coalesce(w.weight, 1) ELSE 0 END) AS sound
  FROM acts a LEFT JOIN weights w ON w.norm_id = a.norm_id AND w.state_id = a.state_id
  LEFT JOIN cont c ON c.norm_id = a.norm_id AND c.scenario_id = a.scenario_id AND c.state_id = a.state_id GROUP BY ALL),
scored AS (SELECT *, CASE WHEN total = 0 THEN 1.0 ELSE round_even(sound::DOUBLE / total, 4) END AS score FROM scores)"""

USER = f"""{EVENTS},
facts AS (
  SELECT CAST(0 AS BIGINT) AS norm_id, user_id AS scenario_id, event_type, k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM ev),
{ACTIVATE},
edges(norm_id, target, source) AS (VALUES {_values([(0, *rule) for rule in fx.EVENT_RULES])}),
vertices(norm_id, state_id) AS (VALUES {_values([(0, f"{t}:{i}") for t in fx.EVENT_TYPES for i in range(4)])}),
weights AS (
  SELECT v.norm_id, v.state_id, count(e.target) AS weight
  FROM vertices v LEFT JOIN edges e ON e.source = v.state_id GROUP BY ALL),
{CLOSURE.format(edges='edges')}, {WALK}"""



def _mean(where: str = "true") -> str:
    """Mean of 4-decimal scores, rounded to 4 decimals with ties to even, in whole numbers."""
    total = f"CAST(sum(CAST(round(score * 10000) AS BIGINT)) FILTER ({where}) AS BIGINT)"
    n = f"nullif(count(*) FILTER ({where}), 0)"
    up = f"(2 * ({total} % {n}) > {n} OR (2 * ({total} % {n}) = {n} AND ({total} // {n}) % 2 = 1))"
    return f"({total} // {n} + CASE WHEN {up} THEN 1 ELSE 0 END) / 10000.0::DOUBLE"


DAILY = f"""{DECLARED},
facts AS (
  SELECT user_id AS norm_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS scenario_id, event_type, k,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS step FROM ev),
{ACTIVATE}, {CLOSURE.format(edges='edges')}, {WALK},
results AS (
  SELECT s.norm_id, s.scenario_id, s.score, CASE WHEN s.score >= 0.8 THEN 'ok' WHEN s.score >= 0.5 THEN 'warn' ELSE 'fail' END AS verdict,
         len(l.a) AS n_validated,
         (SELECT count(*) FROM viol v WHERE v.norm_id = s.norm_id AND v.scenario_id = s.scenario_id) AS n_violations,
         (SELECT count(*) FROM cont c WHERE c.norm_id = s.norm_id AND c.scenario_id = s.scenario_id) AS n_contaminated
  FROM scored s JOIN last l ON l.norm_id = s.norm_id AND l.scenario_id = s.scenario_id)"""

LINES = f"""lines AS (
  SELECT norm_id, scenario_id,
         string_agg('- At index ' || step || ', tried to activate ''' || state_id || ''' but missing prerequisites: ['
                    || array_to_string(list_sort(missing), ', ') || ']', chr(10) ORDER BY n) AS violations_text
  FROM viol GROUP BY ALL)"""

ORACLES["causal_violations"] = f"""WITH RECURSIVE {USER}
SELECT scenario_id, CAST(step AS INTEGER) AS transition_index, state_id AS attempted_state,
       array_to_string(list_sort(missing), '|') AS missing_preconditions FROM viol"""
ORACLES["validated_states"] = f"""WITH RECURSIVE {USER}
SELECT l.scenario_id, l.state_id, CAST(min(a.step) AS INTEGER) AS first_step
FROM (SELECT scenario_id, unnest(a) AS state_id FROM last) l JOIN acts a ON a.scenario_id = l.scenario_id AND a.state_id = l.state_id
GROUP BY ALL"""
ORACLES["contaminated_states"] = f"""WITH RECURSIVE {USER}
SELECT c.scenario_id, c.state_id, EXISTS (SELECT 1 FROM acts a WHERE a.scenario_id = c.scenario_id AND a.state_id = c.state_id) AS attempted
FROM cont c"""
ORACLES["step_trace"] = f"""WITH RECURSIVE {USER},
ends AS (SELECT scenario_id, step, max(n) AS n, count(*) FILTER (bad) AS new_v FROM walk WHERE step IS NOT NULL GROUP BY ALL)
SELECT w.scenario_id, CAST(w.step AS INTEGER) AS step, CAST(len(w.a) AS INTEGER) AS n_validated,
       CAST(len(w.c) AS INTEGER) AS n_violations, CAST(e.new_v AS INTEGER) AS n_new_violations
FROM walk w JOIN ends e ON e.scenario_id = w.scenario_id AND e.n = w.n"""
ORACLES["activation_trace"] = f"""WITH RECURSIVE {USER},
ends AS (SELECT scenario_id, step, arg_max(a, n) AS a FROM walk WHERE step IS NOT NULL GROUP BY ALL)
SELECT s.scenario_id, CAST(s.step AS INTEGER) AS step, s.u_pos, s.state_id,
       array_to_string(list_sort(list_filter(s.pres, lambda x: NOT list_contains(e.a, x))), '|') AS missing_after_step
FROM seq s JOIN ends e ON e.scenario_id = s.scenario_id AND e.step = s.step"""
ORACLES["conformance_score"] = f"""WITH RECURSIVE {USER}
SELECT scenario_id, CAST(total AS BIGINT) AS total_weight, CAST(sound AS BIGINT) AS compliant_weight, score, true AS evaluated FROM scored"""
ORACLES["verdicts"] = f"""WITH RECURSIVE {USER}
SELECT scenario_id, score, CASE WHEN score >= 0.8 THEN 'ok' WHEN score >= 0.5 THEN 'warn' ELSE 'fail' END AS verdict FROM scored"""
ORACLES["violation_lines"] = f"""WITH RECURSIVE {USER}, {LINES}
SELECT s.scenario_id, coalesce(l.violations_text, '{sc.NO_VIOLATIONS}') AS violations_text
FROM scored s LEFT JOIN lines l ON l.scenario_id = s.scenario_id"""
ORACLES["explanations"] = f"""WITH RECURSIVE {USER}, {LINES}
SELECT s.scenario_id, trim(replace('Norm events / facts events: ' || format('{{:.4f}}', s.score) || chr(10)
       || coalesce(l.violations_text, '{sc.NO_VIOLATIONS}'), ' ', '-')) AS explanation
FROM scored s LEFT JOIN lines l ON l.scenario_id = s.scenario_id"""
ORACLES["stream_causal"] = f"""WITH RECURSIVE {USER},
firsts AS (SELECT scenario_id, state_id, min(n) AS n FROM seq GROUP BY ALL)
SELECT w.scenario_id, w.state_id, CAST(w.step AS INTEGER) AS step, NOT w.bad AS valid,
       array_to_string(list_sort(w.missing), '|') AS missing
FROM walk w JOIN firsts f ON f.scenario_id = w.scenario_id AND f.n = w.n"""

ORACLES["stream_contamination"] = f"""WITH RECURSIVE {USER} SELECT scenario_id, state_id FROM cont"""
# a scenario is closed six hours after its last event, by a watermark one hour behind the last event of all
ORACLES["stream_closed"] = f"""WITH RECURSIVE {DAILY},
ended AS (SELECT user_id AS norm_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS scenario_id, max(ts) AS ts FROM events GROUP BY ALL)
SELECT r.norm_id, r.scenario_id, r.n_validated, r.n_violations, r.n_contaminated,
       e.ts + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS closed
FROM results r JOIN ended e ON e.norm_id = r.norm_id AND e.scenario_id = r.scenario_id"""
ORACLES["corpus_violations"] = f"""WITH RECURSIVE {DAILY}
SELECT norm_id, scenario_id, CAST(step AS INTEGER) AS transition_index, state_id AS attempted_state,
       array_to_string(list_sort(missing), '|') AS missing_preconditions FROM viol"""
ORACLES["corpus_scores"] = f"""WITH RECURSIVE {DAILY}
SELECT norm_id, scenario_id, score, verdict, n_validated, n_violations, n_contaminated FROM results"""
ORACLES["average_score"] = f"""WITH RECURSIVE {DAILY}
SELECT norm_id, count(*) AS n_scenarios, count(*) AS n_valid, {_mean()} AS average_score
FROM results GROUP BY norm_id"""
NORM_SIZES = f"""sizes AS (
  SELECT d.norm_id, count(DISTINCT d.target) AS nb_states, (SELECT count(*) FROM edges e WHERE e.norm_id = d.norm_id) AS nb_edges
  FROM declared d GROUP BY d.norm_id),
means AS (SELECT norm_id, {_mean()} AS average_score FROM results GROUP BY norm_id)"""
ORACLES["audit_report"] = f"""WITH RECURSIVE {DAILY}, {LINES}, {NORM_SIZES},
tainted AS (SELECT norm_id, scenario_id, string_agg(state_id, '|' ORDER BY state_id) AS contaminated_states FROM cont GROUP BY ALL)
SELECT r.norm_id, r.scenario_id, z.nb_states, z.nb_edges, m.average_score, r.score,
       coalesce(l.violations_text, '{sc.NO_VIOLATIONS}') AS violations_text, coalesce(t.contaminated_states, '') AS contaminated_states
FROM results r JOIN sizes z USING (norm_id) JOIN means m USING (norm_id)
LEFT JOIN lines l ON l.norm_id = r.norm_id AND l.scenario_id = r.scenario_id
LEFT JOIN tainted t ON t.norm_id = r.norm_id AND t.scenario_id = r.scenario_id"""
ORACLES["report_json"] = f"""WITH RECURSIVE {DAILY}, {NORM_SIZES}
SELECT norm_id, CAST(scenario_id AS VARCHAR) AS scenario, average_score, nb_edges, score,
       CAST(n_violations AS INTEGER) AS n_violations, CAST(n_contaminated AS INTEGER) AS n_contaminated
FROM results JOIN sizes USING (norm_id) JOIN means USING (norm_id)"""
ORACLES["report_folders"] = ORACLES["report_json"]
ORACLES["error_isolation"] = f"""WITH RECURSIVE {DAILY},
failed AS (SELECT DISTINCT norm_id, scenario_id FROM facts WHERE event_type = 'error')
SELECT r.norm_id, count(*) AS n_scenarios, count(*) FILTER (f.norm_id IS NULL) AS n_valid,
       {_mean('f.norm_id IS NULL')} AS average_score
FROM results r LEFT JOIN failed f ON f.norm_id = r.norm_id AND f.scenario_id = r.scenario_id GROUP BY r.norm_id"""
# Order:O before Order:P before Order:F; weights 1, 1 and 0.
ORACLES["unevaluated_scenarios"] = """WITH o AS (
  SELECT o_custkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
f AS (SELECT o_custkey, min(n) FILTER (s = 'O') AS o, min(n) FILTER (s = 'P') AS p, min(n) FILTER (s = 'F') AS f,
             count(*) FILTER (s = 'O') AS n_o, count(*) FILTER (s = 'P') AS n_p, count(*) FILTER (s = 'F') AS n_f
      FROM o GROUP BY o_custkey),
g AS (SELECT *, coalesce(o < p, p IS NULL) AND NOT (p IS NOT NULL AND o IS NULL) AS p_ok FROM f)
SELECT c.c_custkey AS scenario_id, CAST(coalesce(n_o + n_p, 0) AS BIGINT) AS total_weight,
       CAST(coalesce(n_o + CASE WHEN p_ok THEN n_p ELSE 0 END, 0) AS BIGINT) AS compliant_weight,
       CASE WHEN coalesce(n_o + n_p, 0) = 0 THEN 1.0 ELSE round_even((n_o + CASE WHEN p_ok THEN n_p ELSE 0 END)::DOUBLE / (n_o + n_p), 4) END AS score,
       g.o_custkey IS NOT NULL AS evaluated
FROM customer c LEFT JOIN g ON g.o_custkey = c.c_custkey"""
ORACLES["macro_gate"] = """SELECT conv_id, turn,
       CASE WHEN role = 'system' THEN 'abort_to_explanation' ELSE 'proceed_to_extraction' END AS branch FROM conversations"""

# --- similarity ---------------------------------------------------------------------------------

LABELS = _strings(fx.LABEL_STATES)


def _label_means(norm: str) -> str:
    return f"""elements AS (
  SELECT {norm} AS norm_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
means AS (SELECT norm_id, label, i, avg(x) AS x FROM elements GROUP BY ALL),
states AS (SELECT norm_id, label AS u_pos, {LABELS}[label + 1] AS state_id, list(x ORDER BY i) AS vector FROM means GROUP BY ALL)"""


SIMS = """sims AS (
  SELECT f.* EXCLUDE (vector), s.u_pos, s.state_id,
         CASE WHEN list_sum(list_transform(f.vector, lambda x: x * x)) = 0 THEN 0.0
              ELSE list_cosine_similarity(f.vector, s.vector) END AS sim
  FROM facts f JOIN states s ON s.norm_id = f.norm_id)"""


def _project(facts: str, key: str, lam: float, floor: float) -> str:
    return f"""facts AS ({facts}), {SIMS},
spread AS (SELECT *, avg(sim) OVER w AS mu, stddev_pop(sim) OVER w AS sigma FROM sims WINDOW w AS (PARTITION BY {key})),
chosen AS (SELECT * FROM spread WHERE sim >= mu + {lam} * sigma AND sim >= {floor})"""


FACTS = "SELECT vec_id % 4 AS norm_id, vec_id, label, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings"
ORACLES["zscore_projection"] = f"""WITH {_label_means('vec_id % 4')}, {_project(FACTS, 'vec_id', 0.5, 0.2)}
SELECT vec_id, u_pos, state_id, round(sim, 4) AS sim FROM chosen"""
ORACLES["zscore_projection_batched"] = ORACLES["zscore_projection"]
ORACLES["zscore_projection_floor0"] = f"""WITH {_label_means('vec_id % 4')}, {_project(FACTS, 'vec_id', 0.8, 0.0)}
SELECT vec_id, u_pos, state_id, round(sim, 4) AS sim FROM chosen"""
ORACLES["zscore_pruned"] = f"""WITH states AS (
  SELECT vec_id % 4 AS norm_id, CAST(vec_id AS INTEGER) AS u_pos, 'v' || vec_id AS state_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
{_project(FACTS, 'vec_id', 2.0, 0.2)}
SELECT vec_id, u_pos, state_id, round(sim, 4) AS sim FROM chosen"""
ORACLES["projection_coverage"] = f"""WITH {_label_means('vec_id % 4')}, {_project(FACTS, 'vec_id', 0.5, 0.5)}
SELECT vec_id % 4 AS norm_id, CAST(e.label AS BIGINT) AS scenario_id, count(*) AS n_facts,
       count(*) FILTER (e.vec_id IN (SELECT vec_id FROM chosen)) AS n_active FROM embeddings e GROUP BY ALL"""
ORACLES["zscore_degenerate"] = f"""WITH elements AS (
  SELECT vec_id % 4 AS norm_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
overall AS (SELECT norm_id, list(x ORDER BY i) AS v FROM (SELECT norm_id, i, avg(x) AS x FROM elements GROUP BY ALL) GROUP BY norm_id),
sims AS (SELECT vec_id, CASE WHEN label = 0 THEN 0.0 ELSE list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) END AS sim
         FROM embeddings JOIN overall ON norm_id = vec_id % 4)
SELECT vec_id, CAST(0 AS INTEGER) AS u_pos, '{fx.LABEL_STATES[0]}' AS state_id, round(sim, 4) AS sim FROM sims WHERE sim >= 0"""


def _ends(column: str, endings) -> str:
    return "(" + " OR ".join(f"ends_with({column}, '{e}')" for e in endings) + ")"


EXCLUDE = f"""marked AS (
  SELECT DISTINCT norm_id, target, source, split_part(source, ':', 1) AS entity,
         {_ends("split_part(source, ':', 2)", sx.POSITIVE_ENDINGS)} AS pos,
         {_ends("split_part(source, ':', 2)", sx.NEGATIVE_ENDINGS)} AS neg
  FROM candidates WHERE source <> target)
SELECT norm_id, target, source FROM marked m
WHERE NOT (neg AND EXISTS (SELECT 1 FROM marked o WHERE o.norm_id = m.norm_id AND o.target = m.target AND o.entity = m.entity AND o.pos))"""

PRES = f"""SELECT vec_id // 20 AS norm_id, vec_id, {LABELS}[(label + 3) % 10 + 1] AS target,
       CAST(embedding AS DOUBLE[]) AS vector FROM embeddings"""
ORACLES["precondition_mapping"] = f"""WITH {_label_means('vec_id // 20')}, {_project(PRES, 'vec_id', 0.8, 0.2)},
candidates AS (SELECT norm_id, target, state_id AS source FROM chosen), {EXCLUDE}"""

ENDINGS = _strings(sx.NEGATIVE_ENDINGS + sx.POSITIVE_ENDINGS + ["Pending", "Accepted:Late", ""])
N_ENDINGS = len(sx.NEGATIVE_ENDINGS) + len(sx.POSITIVE_ENDINGS) + 3
NAMED = f"""named AS (
  SELECT *, p_brand || CASE WHEN ending = '' THEN '' ELSE ':' || ending END AS state_id
  FROM (SELECT *, {ENDINGS}[p_partkey % {N_ENDINGS} + 1] AS ending FROM part))"""
ORACLES["state_polarity"] = f"""WITH {NAMED}
SELECT p_partkey, state_id, split_part(state_id, ':', 1) AS entity, split_part(state_id, ':', 2) AS suffix,
       {_ends("split_part(state_id, ':', 2)", sx.NEGATIVE_ENDINGS)} AS is_negative,
       {_ends("split_part(state_id, ':', 2)", sx.POSITIVE_ENDINGS)} AS is_positive FROM named"""
ORACLES["mutual_exclusion"] = f"""WITH {NAMED}, candidates AS (
  SELECT CAST(p_size AS BIGINT) AS norm_id, CASE WHEN p_partkey % 7 = 0 THEN state_id ELSE p_type END AS target,
         state_id AS source FROM named), {EXCLUDE}"""

# --- texts --------------------------------------------------------------------------------------

ORACLES["parse_scenarios"] = """WITH o AS (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders)
SELECT o_orderkey AS norm_id, 1 AS scenario_pos, 'Scenario 1: ' || o_orderpriority AS label, 0 AS step,
       'Customer ' || o_custkey AS subject, 'places' AS relation, 'order ' || o_orderkey AS object FROM o
UNION ALL SELECT o_orderkey, 1, 'Scenario 1: ' || o_orderpriority, 1, 'Order ' || o_orderkey, 'has status', o_orderstatus FROM o
UNION ALL SELECT o_orderkey, 2, 'Scenario 2 : total', 0, 'Order ' || o_orderkey, 'costs', price || ', rounded' FROM o"""
ORACLES["scenario_sizes"] = """SELECT 'Scenario 1: ' || o_orderpriority AS label, count(*) AS n_scenarios,
       CAST(2 * count(*) AS BIGINT) AS n_facts, CAST(0 AS BIGINT) AS n_empty FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'Scenario 2 : total', count(*), CAST(count(*) AS BIGINT), 0 FROM orders
UNION ALL SELECT 'Scenario 3: nothing follows', count(*), 0, count(*) FROM orders"""
ORACLES["duplicate_labels"] = """WITH blocks AS (
  SELECT o_orderkey AS norm_id, 'Scenario 1: ' || o_orderstatus AS label, 1 AS pos, 'first' AS relation FROM orders
  UNION ALL SELECT o_orderkey, 'Scenario 1: P', 2, 'second' FROM orders
  UNION ALL SELECT o_orderkey, 'Scenario 1: O', 3, 'third' FROM orders),
kept AS (SELECT norm_id, label, min(pos) AS pos, arg_max(relation, pos) AS relation FROM blocks GROUP BY ALL)
SELECT norm_id, CAST(row_number() OVER (PARTITION BY norm_id ORDER BY pos) AS INTEGER) AS scenario_pos, label, 0 AS step,
       'order' AS subject, relation, CAST(norm_id AS VARCHAR) AS object FROM kept"""
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
ORACLES["parse_fallback"] = r"""WITH t AS (
  SELECT doc_id, '(' || replace(replace(text, ' ', ', '), '.', ')(') || ')' AS text FROM documents),
m AS (SELECT doc_id, '\(([^,]+),\s*([^,]+),\s*([^)]+)\)' AS p, text FROM t),
g AS (SELECT doc_id, unnest(regexp_extract_all(text, p, 1)) AS a, unnest(regexp_extract_all(text, p, 2)) AS b,
             unnest(regexp_extract_all(text, p, 3)) AS c, generate_subscripts(regexp_extract_all(text, p, 0), 1) - 1 AS step FROM m)
SELECT doc_id AS norm_id, 1 AS scenario_pos, 'Scenario 1: Default' AS label, CAST(step AS INTEGER) AS step,
       %s AS subject, %s AS relation, %s AS object FROM g""" % (STRIP.format("a"), STRIP.format("b"), STRIP.format("c"))
ORACLES["serialize_facts"] = """SELECT o_orderkey, trim(coalesce(nullif(o_orderstatus, 'P'), '') || ' ' || o_orderpriority || ' '
       || CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END) AS fact FROM orders"""

# --- model answers --------------------------------------------------------------------------------

ORACLES["clean_json_answers"] = """SELECT event_id,
       CASE WHEN event_id % 6 = 4 THEN 'Here it is: ' || props ELSE props END AS cleaned,
       CASE WHEN event_id % 6 <> 4 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events"""
ORACLES["intent_defaults"] = f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN '{ax.UNKNOWN}'
       WHEN 2 THEN '{ax.EXTRACTION_FAILED}' WHEN 4 THEN 'é ' || event_type END AS intent FROM events"""
UNIVERSE = f"""{EVENTS},
universe AS (
  SELECT event_id AS norm_id, 'z:last' AS state_id, 0 AS u_pos, 'first in order' AS description FROM ev WHERE event_id % 5 IN (0, 4)
  UNION ALL SELECT event_id, event_type || ':' || (k % 4), 1, 'reached at ' || k FROM ev WHERE event_id % 5 IN (0, 4)
  UNION ALL SELECT event_id, 'a:0', 2, 'é' FROM ev WHERE event_id % 5 = 4)"""
ORACLES["validate_universe"] = f"WITH {UNIVERSE} SELECT * FROM universe"
ORACLES["complete_rules"] = f"""WITH {UNIVERSE}
SELECT u.norm_id, u.state_id, CASE WHEN u.u_pos = 1 AND e.k % 4 < 2 THEN 2 ELSE 0 END AS n_pres,
       CASE WHEN u.u_pos = 1 AND e.k % 4 < 2 THEN 'needs ' || e.k || '| kept as is ' ELSE '' END AS pres
FROM universe u JOIN ev e ON e.event_id = u.norm_id WHERE e.k % 4 <> 2"""
ORACLES["prompt_assembly"] = """SELECT doc_id,
       CASE WHEN lang <> 'en' THEN '# CONTEXTE' || chr(10) || 'language: ' || lang || chr(10) || chr(10) ELSE '' END
       || 'Find the intent.' || chr(10) || chr(10) || '# DONNÉES (JSON):' || chr(10)
       || '{' || chr(10) || '  "T": ' || CAST(to_json(text) AS VARCHAR) || ',' || chr(10) || '  "tags": [' || chr(10)
       || '    "' || lang || '",' || chr(10) || '    "' || source || '"' || chr(10) || '  ]' || chr(10) || '}' AS prompt
FROM documents"""
ORACLES["answer_content"] = """SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN text WHEN 1 THEN text || '!'
       WHEN 2 THEN text || ' end' ELSE 'response#' || role END AS content FROM conversations"""

# --- model calls ----------------------------------------------------------------------------------

PY_STRIP = r"regexp_replace({}, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"
ANSWER = PY_STRIP.format("replace(text, ' ', '-')")
STATUS = f"""CASE WHEN contains(text, 'ß') THEN '{models.FAILURE_PREFIX}429 Too Many Requests'
       WHEN contains(text, 'ñ') THEN '{models.FAILURE_PREFIX}bad letter' ELSE '{models.SUCCESS}' END"""
ORACLES["generate_metrics"] = f"""WITH d AS (
  SELECT doc_id, text, length(text) AS c, length(text) - length(replace(text, ' ', '')) + 1 AS w, {STATUS} AS status FROM documents)
SELECT doc_id, CASE WHEN status = '{models.SUCCESS}' THEN {ANSWER} END AS text,
       CASE WHEN status = '{models.SUCCESS}' THEN true ELSE true END AS timed,
       CAST(CASE WHEN status = '{models.SUCCESS}' THEN c END AS INTEGER) AS prompt_tokens,
       CAST(CASE WHEN status = '{models.SUCCESS}' THEN w END AS INTEGER) AS completion_tokens,
       CAST(CASE WHEN status = '{models.SUCCESS}' THEN c + w END AS INTEGER) AS total_tokens,
       CASE WHEN status <> '{models.SUCCESS}' THEN NULL WHEN w > 1024 THEN 'length' ELSE 'stop' END AS finish_reason, status
FROM d"""
ORACLES["triplet_extraction"] = f"""WITH l AS (
  SELECT doc_id, 'a' AS model, text FROM documents
  UNION ALL SELECT doc_id, 'b', CASE WHEN lang = 'en' THEN ' ' WHEN lang <> 'fr' THEN text END FROM documents)
SELECT doc_id, model, CASE WHEN text IS NULL OR {PY_STRIP.format('text')} = '' THEN '{tx.NO_TEXT}'
       WHEN contains(text, 'ß') THEN '{models.EXTRACTION_FAILURE_PREFIX.replace("'", "''")}429 Too Many Requests'
       WHEN contains(text, 'ñ') THEN '{models.EXTRACTION_FAILURE_PREFIX.replace("'", "''")}bad letter'
       ELSE {ANSWER} END AS extraction FROM l"""
ORACLES["embed_text"] = r"""WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 32 AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT d.doc_id, CAST(i.bucket AS INTEGER) AS bucket, CAST(coalesce(b.n, 0) AS INTEGER) AS n
FROM documents d CROSS JOIN range(32) AS i(bucket) LEFT JOIN b ON b.doc_id = d.doc_id AND b.bucket = i.bucket"""

ORACLES["embed_batches"] = """SELECT doc_id, CAST(i.dim AS INTEGER) AS dim, CAST(CASE i.dim WHEN 0 THEN length(text)
       WHEN 1 THEN length(text) - length(replace(text, ' ', '')) ELSE length(text) - length(replace(text, 'e', '')) END AS INTEGER) AS x
FROM documents CROSS JOIN range(3) AS i(dim)"""
# request before country before account, with weights 1, 1 and 0
ORACLES["whole_audit"] = """WITH s AS (
  SELECT o_orderkey AS norm_id, 'Scenario 1: main' AS scenario, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 3 END AS n_facts,
         CASE WHEN o_orderstatus = 'O' THEN 0.5 ELSE 1.0 END AS score, CASE WHEN o_orderstatus = 'O' THEN 'warn' ELSE 'ok' END AS verdict,
         CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 ELSE 0 END AS n_validated,
         CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 ELSE 1 END AS n_violations FROM orders
  UNION ALL SELECT o_orderkey, 'Scenario 2: other', 3, 1.0, 'ok', 2, 0 FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT norm_id, scenario, n_facts, 'open an account' AS intent_T, 'open an account' AS intent_F, score::DOUBLE AS score, verdict,
       true AS evaluated, CAST(n_validated AS BIGINT) AS n_validated, n_violations, n_violations || ' problems' AS explanation FROM s"""

FINAL = f"""final AS (
  SELECT o_orderkey AS doc_id, o_orderpriority AS model,
         CASE WHEN o_orderstatus = 'F' THEN 'text ' || o_orderkey WHEN o_custkey % 3 = 0 THEN 'again ' || o_orderkey END AS text,
         CASE WHEN o_orderstatus = 'F' OR o_custkey % 3 = 0 THEN '{models.SUCCESS}'
              WHEN o_custkey % 3 = 2 THEN 'Erreur: refused' WHEN o_orderstatus = 'P' THEN 'Erreur: timeout' END AS status
  FROM orders)"""
ORACLES["retry_upsert"] = f"WITH {FINAL} SELECT * FROM final"
ORACLES["success_ratio"] = f"""WITH {FINAL}
SELECT model, count(*) AS n_total, count(*) FILTER (status = '{models.SUCCESS}') AS n_success,
       count(*) - count(*) FILTER (status = '{models.SUCCESS}') AS n_failure,
       round(count(*) FILTER (status = '{models.SUCCESS}')::DOUBLE / count(*), 6) AS ratio FROM final GROUP BY model"""

ORACLES["resumed_calls"] = f"""WITH d AS (
  SELECT doc_id, text, length(text) - length(replace(text, ' ', '')) + 1 AS w, {STATUS} AS status FROM documents)
SELECT doc_id, CASE WHEN status = '{models.SUCCESS}' THEN {ANSWER} END AS text, CAST(CASE WHEN status = '{models.SUCCESS}' THEN w END AS INTEGER) AS completion_tokens,
       CASE WHEN text IS NOT NULL THEN status END AS status, CASE WHEN text IS NULL THEN NULL WHEN status = '{models.SUCCESS}' THEN 1 ELSE 2 END::INTEGER AS attempts
FROM d"""
ORACLES["retried_keys"] = f"""WITH l AS (
  SELECT l_orderkey, concat_ws('/', l_linenumber, l_partkey, l_suppkey) AS text,
         CASE WHEN l_linestatus = 'F' THEN '{models.SUCCESS}' WHEN l_linenumber < 3 THEN 'Erreur: 429' ELSE 'Erreur: timeout' END AS status,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n
  FROM lineitem WHERE l_linestatus = 'F' OR l_linenumber >= 3)
SELECT o_orderkey, coalesce(l.text, 'before') AS text, coalesce(l.status, 'none') AS status FROM orders LEFT JOIN l ON l_orderkey = o_orderkey AND n = 1"""

# --- comparison of models ------------------------------------------------------------------------

GENERATIONS = f"""gen AS (
  SELECT l_returnflag AS model, l_tax AS latency_s, CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS INTEGER) END AS completion_tokens,
         CASE WHEN l_linestatus = 'F' THEN '{models.SUCCESS}' WHEN l_linenumber < 3 THEN 'Erreur: 429'
              WHEN l_linenumber < 6 THEN 'Erreur: timeout' END AS status FROM lineitem)"""


def _summary(table: str) -> str:
    ok = f"count(*) FILTER (status = '{models.SUCCESS}')"
    return f"""SELECT model, count(*) AS n_total, {ok} AS n_success, count(*) - {ok} AS n_failure,
       round_even(100.0::DOUBLE * {ok} / count(*), 2) AS success_pct, round_even(avg(latency_s)::DOUBLE, 2) AS mean_latency_s,
       round_even(avg(completion_tokens)::DOUBLE, 1) AS mean_tokens FROM {table} GROUP BY model"""


ORACLES["corpus_stats"] = f"""WITH {GENERATIONS} SELECT count(*) AS n_rows, round(avg(latency_s)::DOUBLE, 6) AS mean_latency_s,
       round(avg(completion_tokens)::DOUBLE, 6) AS mean_tokens FROM gen"""
ORACLES["model_summary"] = f"WITH {GENERATIONS} {_summary('gen')}"
ORACLES["leaderboard"] = f"""WITH {GENERATIONS}, s AS ({_summary('gen')})
SELECT model, success_pct, mean_latency_s FROM s ORDER BY success_pct DESC, mean_latency_s"""
ORACLES["status_distribution"] = f"""WITH {GENERATIONS},
c AS (SELECT model, status, count(*) AS n FROM gen WHERE status IS NOT NULL GROUP BY ALL)
SELECT model, status, n, round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY model), 2) AS pct FROM c"""
ORACLES["wide_model_summary"] = f"""WITH gen AS (
  SELECT 'one' AS model, CASE WHEN o_orderstatus = 'F' THEN '{models.SUCCESS}' ELSE 'Erreur: x' END AS status,
         CAST(o_custkey % 10 AS DOUBLE) AS latency_s, o_orderkey % 100 AS completion_tokens FROM orders
  UNION ALL SELECT 'two-x', CASE WHEN o_orderstatus = 'O' THEN '{models.SUCCESS}' END, o_custkey % 7, NULL FROM orders
  UNION ALL SELECT 'three', NULL, NULL, NULL FROM orders)
{_summary('gen')}"""

# --- sources and sinks ----------------------------------------------------------------------------

ORACLES["text_corpus_scan"] = f"SELECT 'source=' || source AS folder, {PY_STRIP.format('text')} AS text FROM documents"
ORACLES["csv_round_trip"] = """SELECT doc_id, text, 'say "' || lang || '",' || chr(10) || ' ' || source AS note, n_chars FROM documents"""
ORACLES["process_graph_nodes"] = """SELECT o_orderkey AS file_index, CAST(i AS INTEGER) AS node_pos, o_orderkey || '-' || i AS resource_id,
       CASE i WHEN 1 THEN o_orderpriority WHEN 2 THEN 'Check "status"' ELSE '' END AS node_text,
       CASE WHEN i < 2 THEN 'Customer ' || o_custkey ELSE 'Shop' END AS agent,
       ['StartNode', 'Activity', 'XOR', 'EndNode'][i + 1] AS type
FROM orders CROSS JOIN range(4) AS r(i)"""
ORACLES["process_graph_flows"] = """SELECT o_orderkey AS file_index, CAST(i AS INTEGER) AS flow_pos, o_orderkey || '-' || i AS src,
       o_orderkey || '-' || (i + 1) AS tgt,
       CASE WHEN i < 2 THEN '' WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS condition
FROM orders CROSS JOIN range(3) AS r(i)"""
MESSAGES = """SELECT o_orderkey AS file_index, 'MessageFlow' AS section, 0 AS link_pos, o_orderkey || '-1' AS src,
       o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '-pool' ELSE '-2' END AS tgt, CAST(NULL AS VARCHAR) AS condition, CAST(NULL AS VARCHAR) AS item FROM orders"""
NOTES = """SELECT o_orderkey AS file_index, 'Association' AS section, 0 AS link_pos, CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS tgt,
       CAST(NULL AS VARCHAR) AS condition, '"note"' AS item FROM orders"""
ORACLES["process_graph_links"] = f"""WITH flows AS ({ORACLES["process_graph_flows"]})
SELECT file_index, 'SequenceFlow' AS section, flow_pos AS link_pos, src, tgt, condition, CAST(NULL AS VARCHAR) AS item FROM flows
UNION ALL {MESSAGES} UNION ALL {NOTES}"""
ORACLES["process_graph_dangling"] = f"""SELECT file_index, section, link_pos, 'tgt' AS side, tgt AS "end" FROM ({MESSAGES}) WHERE file_index % 3 = 0
UNION ALL SELECT file_index, section, link_pos, side, CAST(NULL AS VARCHAR) FROM ({NOTES}), (VALUES ('src'), ('tgt')) AS s(side)"""
# Fails on MACHINERY; request before country in BUILDING, else country is tried first and contaminated.
ORACLES["csv_audit_report"] = """SELECT c_custkey || '#m' AS norm_id, CASE WHEN fails THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.5 END::DOUBLE AS average_score,
       CASE WHEN NOT fails THEN 'open' ELSE 'EXTRACTION_FAILED' END AS intent_T, 2::BIGINT AS nb_edges, 'Scenario 1: main' AS scenario,
       CASE WHEN fails THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.5 END::DOUBLE AS score, CASE WHEN NOT fails THEN 'open' END AS intent_F,
       CASE WHEN fails OR c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS n_violations, CASE WHEN fails OR c_mktsegment = 'BUILDING' THEN 0 ELSE 2 END AS n_contaminated,
       CASE WHEN fails THEN '' WHEN c_mktsegment = 'BUILDING' THEN '0 problems' ELSE '1 problems' END AS explanation
FROM (SELECT *, c_mktsegment = 'MACHINERY' AS fails FROM customer)"""
ORACLES["batched_generations"] = r"""SELECT min(doc_id) AS doc_id, 'Succès' AS status, length(text) || ':' || regexp_replace(left(text, 3), '\s+$', '') AS answer FROM documents GROUP BY text"""
ORACLES["timed_calls"] = """SELECT page_id, url AS answer, true AS timed FROM pages"""
ORACLES["corpus_file_status"] = """SELECT 'lang=' || lang AS folder, CASE WHEN doc_id % 10 = 0 THEN 'not UTF-8' ELSE 'read' END AS status, count(*) AS n_files
FROM documents GROUP BY ALL"""
ORACLES["corpus_files_once"] = f"""SELECT 'lang=' || lang AS folder, CASE WHEN doc_id % 10 <> 0 THEN {PY_STRIP.format('text')} END AS text,
       CASE WHEN doc_id % 10 = 0 THEN 'not UTF-8' END AS reason FROM documents"""
