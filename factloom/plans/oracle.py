"""DuckDB SQL for the named queries, from the raw ``events`` table."""

from __future__ import annotations

LOG = """
ev AS (SELECT event_id, ts, user_id, event_type AS et, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS n FROM events),
log0 AS (SELECT 'tenant-' || (user_id % 3) AS tenant_id, 'eng-' || n AS engagement_id, 'stream-' || (user_id % 3) || '-' || n AS source_stream_id,
  row_number() OVER (PARTITION BY user_id % 3, n ORDER BY ts, event_id) AS source_sequence, 'evt-' || event_id AS source_event_id,
  CASE et WHEN 'signup' THEN 'asset_observation' WHEN 'error' THEN 'finding_observation' ELSE 'test_attempt' END AS event_type,
  ts, event_id, k, 'deploy-' || user_id AS resource_uid, 'check-' || (k % 4) AS verification_key, 'vuln-' || (k % 4) AS vuln_class, 'loc-' || (k % 4) AS location,
  CASE WHEN et <> 'error' AND k % 10 = 0 THEN '2.0.0' ELSE '1.0.0' END AS check_version, 'cluster-' || (user_id % 2) AS cluster_id, 'Deployment' AS resource_kind,
  CASE WHEN et <> 'error' AND k % 10 = 1 THEN 8443 ELSE 443 END AS port, CASE WHEN et <> 'error' AND k % 25 = 3 THEN 2 ELSE 1 END AS compatibility_policy_version,
  CASE WHEN et = 'view' THEN 'partial' WHEN et IN ('click', 'purchase') THEN 'completed' END AS execution_status,
  CASE et WHEN 'click' THEN 'not_detected' WHEN 'purchase' THEN 'detected' END AS result FROM ev),
log AS (SELECT *, sha256('{"protocol":"https","port":' || port || ',"normalized_route":"/' || location || '","parameters":{},"is_address_bound":false}') AS relevant_context_hash FROM log0),
pos AS (SELECT tenant_id, source_stream_id, CAST(max(source_sequence) - max(source_sequence) // 10 AS BIGINT) AS lim FROM log GROUP BY ALL),
facts AS (SELECT *, CASE event_type WHEN 'finding_observation' THEN 'finding_occurrence' ELSE 'test_attempt' END AS fact_kind FROM log JOIN pos USING (tenant_id, source_stream_id) WHERE event_type <> 'asset_observation' AND source_sequence <= lim),
fnd AS (SELECT DISTINCT tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location, verification_key, check_version, relevant_context_hash, compatibility_policy_version FROM facts WHERE fact_kind = 'finding_occurrence'),
pairs AS (SELECT f.vuln_class AS f_vuln, f.location AS f_loc, a.* FROM facts a JOIN fnd f USING (tenant_id, cluster_id, resource_kind, resource_uid, verification_key, check_version, relevant_context_hash, compatibility_policy_version) WHERE a.fact_kind = 'test_attempt' AND a.compatibility_policy_version = 1)"""


def fold(source: str, current: str, name: str) -> str:
    return f"""
{name}_e AS (SELECT tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location, verification_key, engagement_id, source_event_id, source_stream_id, source_sequence, ts, 'O' AS kind FROM facts WHERE fact_kind = 'finding_occurrence' AND {source}
  UNION ALL SELECT a.tenant_id, a.cluster_id, a.resource_kind, a.resource_uid, f.vuln_class, f.location, a.verification_key, engagement_id, source_event_id, source_stream_id, source_sequence, ts,
    CASE WHEN execution_status <> 'completed' THEN 'I' WHEN result = 'not_detected' THEN 'N' ELSE 'D' END FROM facts a
    JOIN (SELECT DISTINCT tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location, verification_key, check_version, relevant_context_hash, compatibility_policy_version FROM facts WHERE fact_kind = 'finding_occurrence' AND {source}) f USING (tenant_id, cluster_id, resource_kind, resource_uid, verification_key, check_version, relevant_context_hash, compatibility_policy_version) WHERE a.fact_kind = 'test_attempt' AND a.compatibility_policy_version = 1 AND {source}),
{name}_w AS (SELECT *, engagement_id = '{current}' AS c, coalesce(bool_or(kind = 'O') OVER w, false) AS seen, last_value(CASE WHEN kind IN ('O', 'N') THEN kind END IGNORE NULLS) OVER w AS prev,
  row_number() OVER (PARTITION BY tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location ORDER BY ts, source_stream_id, source_sequence, source_event_id) AS rn
  FROM {name}_e WINDOW w AS (PARTITION BY tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location ORDER BY ts, source_stream_id, source_sequence, source_event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_f AS (SELECT tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location, min(verification_key) FILTER (kind = 'O') AS verification_key,
  coalesce(bool_or(kind = 'O' AND c AND NOT seen), false) AS f_new, coalesce(bool_or(kind = 'O' AND c AND seen AND prev = 'N'), false) AS f_reg, coalesce(bool_or(kind = 'N' AND c AND seen), false) AS f_res,
  coalesce(bool_or(kind = 'O' AND c AND seen AND prev = 'O'), false) AS f_open, coalesce(bool_or(kind = 'I' AND c), false) AS f_inc,
  max_by(kind, rn) FILTER (kind IN ('O', 'N') AND c) AS lc, max_by(kind, rn) FILTER (kind IN ('O', 'N')) AS la FROM {name}_w GROUP BY ALL),
{name} AS (SELECT tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location, verification_key,
  CASE WHEN f_new THEN 'NEW' WHEN f_reg THEN 'REGRESSED' WHEN f_res THEN 'VERIFIED_RESOLVED' WHEN f_open THEN 'STILL_OPEN' WHEN f_inc THEN 'INCONCLUSIVE' ELSE 'NOT_RETESTED' END AS classification,
  CASE WHEN lc = 'O' THEN 'DETECTED' WHEN lc = 'N' THEN 'NOT_DETECTED' WHEN f_inc THEN 'INCONCLUSIVE' ELSE 'NOT_RETESTED' END AS assessment,
  CASE WHEN la = 'O' THEN 'OPEN' ELSE 'VERIFIED_RESOLVED' END AS exposure FROM {name}_f)"""


DELIVERIES = """
b AS (SELECT tenant_id, engagement_id, source_stream_id, source_sequence, source_event_id, event_id AS arrival, event_type || '|' || resource_uid || '|' || k AS content, event_id FROM log),
del AS (SELECT * FROM b UNION ALL SELECT * REPLACE (arrival + 1000000000 AS arrival) FROM b WHERE event_id % 20 = 0
  UNION ALL SELECT * REPLACE (arrival + 1000000000 AS arrival, content || '|changed' AS content) FROM b WHERE event_id % 50 = 1
  UNION ALL SELECT * REPLACE (arrival + 1000000000 AS arrival, 'dup-' || event_id AS source_event_id) FROM b WHERE event_id % 70 = 2
  UNION ALL SELECT * REPLACE (arrival + 2000000000 AS arrival, 'tenant-x' AS tenant_id, 'eng-x' AS engagement_id) FROM b WHERE event_id % 90 = 3 AND tenant_id = 'tenant-0')"""


def decided(source: str) -> str:
    return f"""
own AS (SELECT source_stream_id, min_by(tenant_id || '|' || engagement_id, arrival) AS owner FROM {source} GROUP BY ALL),
eng AS (SELECT tenant_id, engagement_id, min_by(source_stream_id, arrival) AS bound FROM {source} JOIN own USING (source_stream_id) WHERE owner = tenant_id || '|' || engagement_id GROUP BY ALL),
bnd AS (SELECT d.*, CASE WHEN bound <> source_stream_id THEN 'ENGAGEMENT_BINDING' WHEN owner <> tenant_id || '|' || engagement_id THEN 'STREAM_OWNERSHIP' END AS be FROM {source} d LEFT JOIN eng USING (tenant_id, engagement_id) JOIN own USING (source_stream_id)),
h1 AS (SELECT *, concat_ws('|', engagement_id, source_stream_id, source_sequence, content) AS h, row_number() OVER w AS n FROM bnd WINDOW w AS (PARTITION BY tenant_id, source_event_id ORDER BY be IS NOT NULL, arrival)),
h2 AS (SELECT *, first_value(h) OVER (PARTITION BY tenant_id, source_event_id ORDER BY n) AS h0, row_number() OVER (PARTITION BY tenant_id, source_stream_id, source_sequence ORDER BY be IS NOT NULL OR n > 1, arrival) AS p FROM h1),
h3 AS (SELECT *, CASE WHEN be IS NOT NULL THEN be WHEN n > 1 AND h <> h0 THEN 'EVENT_CONTENT' WHEN n = 1 AND p > 1 THEN 'STREAM_POSITION' END AS reject_reason FROM h2),
dec AS (SELECT *, CASE WHEN reject_reason IS NOT NULL THEN 'REJECTED' WHEN n > 1 THEN 'NO_OP' ELSE 'ACCEPTED' END AS decision FROM h3)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


def oracle_sql() -> dict[str, str]:
    log = _with(LOG)
    keyed = lambda *names: "sha256(concat_ws('|', " + ", ".join(f"length({n}) || ':' || {n}" for n in names) + "))"
    asset_id = keyed("tenant_id", "cluster_id", "resource_kind", "resource_uid")
    finding_id = keyed("tenant_id", "cluster_id", "resource_kind", "resource_uid", "vuln_class", "location")
    post = _with(LOG, fold("true", "eng-3", "post"))
    prior = fold("engagement_id <> 'eng-3'", "eng-2", "prior")
    cand = "cand AS (SELECT DISTINCT tenant_id, cluster_id, resource_kind, resource_uid, verification_key, resource_uid || ':' || verification_key AS candidate_id FROM log WHERE event_type <> 'asset_observation')"
    feat = "feat AS (SELECT c.*, EXISTS (SELECT 1 FROM prior p WHERE p.exposure = 'VERIFIED_RESOLVED' AND p.tenant_id = c.tenant_id AND p.cluster_id = c.cluster_id AND p.resource_uid = c.resource_uid AND p.verification_key = c.verification_key) AS has_prior_verified_resolution FROM cand c)"
    featured = _with(LOG, prior, cand, feat)
    observed = "obs AS (SELECT tenant_id, cluster_id, source_event_id, event_id AS arrival, CASE WHEN k % 5 <> 0 THEN resource_uid END AS resource_uid, 'svc-' || right(resource_uid, 1) AS dns, k % 7 AS app, event_id % 11 AS zone FROM log WHERE event_type = 'asset_observation'),\nseen AS (SELECT *, CASE outcome WHEN 'RESOLVED' THEN 'AUTHORITATIVE_DEPLOYMENT_KEY' WHEN 'AMBIGUOUS' THEN 'WEAK_SIGNAL_COLLISION' END AS basis FROM (SELECT o.*, CASE WHEN resource_uid IS NOT NULL THEN 'RESOLVED' WHEN EXISTS (SELECT 1 FROM obs r WHERE r.resource_uid IS NOT NULL AND r.tenant_id = o.tenant_id AND r.cluster_id = o.cluster_id AND r.dns = o.dns AND r.arrival < o.arrival) OR EXISTS (SELECT 1 FROM obs r WHERE r.resource_uid IS NOT NULL AND r.tenant_id = o.tenant_id AND r.cluster_id = o.cluster_id AND r.app = o.app AND r.arrival < o.arrival) OR EXISTS (SELECT 1 FROM obs r WHERE r.resource_uid IS NOT NULL AND r.tenant_id = o.tenant_id AND r.cluster_id = o.cluster_id AND r.zone = o.zone AND r.arrival < o.arrival) THEN 'AMBIGUOUS' ELSE 'REJECTED' END AS outcome FROM obs o))"
    occ = "occ AS (SELECT tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location, verification_key, CASE WHEN event_id % 11 = 0 THEN '2.0.0' ELSE check_version END AS check_version, relevant_context_hash, compatibility_policy_version, source_event_id, event_id FROM log WHERE event_type = 'finding_observation')"
    done = "data AS (SELECT * FROM log WHERE NOT (source_stream_id = 'stream-0-2' AND source_sequence = 3)), mk AS (SELECT tenant_id, engagement_id, source_stream_id, max(source_sequence) - max(source_sequence) // 10 AS named FROM data WHERE source_stream_id <> 'stream-2-1' GROUP BY ALL)"
    ranked = "rk AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY candidate_id) AS p0, row_number() OVER (PARTITION BY tenant_id ORDER BY has_prior_verified_resolution DESC, candidate_id) AS p1 FROM feat)"
    iso = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || 'Z'"
    q = lambda name, value: f"'\"{name}\":\"' || {value} || '\"'"
    common = " || ',' || ".join([q("fact_kind", "fact_kind"), q("source_event_id", "source_event_id"), q("source_stream_id", "source_stream_id"), "'\"source_sequence\":' || source_sequence", q("occurred_at", f"({iso})"), q("cluster_id", "cluster_id"), q("resource_kind", "'Deployment'"), q("resource_uid", "resource_uid")])
    finding = " || ',' || ".join([q("vuln_class", "vuln_class"), q("normalized_location_signature", "location"), "'\"match_key_version\":1'"])
    shared = " || ',' || ".join([q("verification_key", "verification_key"), q("check_version", "check_version"), q("relevant_context_hash", "relevant_context_hash"), "'\"compatibility_policy_version\":' || compatibility_policy_version"])
    tail = q("execution_status", "execution_status") + " || CASE WHEN result IS NULL THEN '' ELSE ',' || " + q("result", "result") + " END"
    fact_json = f"'{{' || {common} || ',' || CASE WHEN fact_kind = 'finding_occurrence' THEN {finding} || ',' || {shared} ELSE {shared} || ',' || {tail} END || '}}'"
    asked = "ask AS (SELECT tenant_id, source_stream_id, CASE WHEN source_stream_id = 'stream-1-2' THEN lim - 1 ELSE lim END AS last_data_sequence FROM pos UNION ALL SELECT tenant_id, 'stream-none', lim FROM pos WHERE source_stream_id = 'stream-0-1')"
    mark = """
lims AS (SELECT tenant_id, engagement_id, source_stream_id, max(source_sequence) - max(source_sequence) // 10 AS lim FROM log GROUP BY ALL),
base AS (SELECT tenant_id, engagement_id, source_stream_id, source_sequence, source_event_id, 2 * source_sequence + CASE WHEN event_id % 40 = 7 THEN 1000000000 ELSE 0 END AS arrival FROM log),
arr AS (SELECT *, 0 AS kind FROM base UNION ALL SELECT * REPLACE (arrival + 2000000000 AS arrival), 1 FROM base WHERE source_sequence % 30 = 4
  UNION ALL SELECT tenant_id, engagement_id, source_stream_id, lim + 1, 'mark-' || source_stream_id, 2 * lim + 1, 2 FROM lims),
got AS (SELECT a.*, CASE WHEN kind = 2 OR source_sequence <= lim THEN NULL WHEN source_sequence = lim + 1 THEN 'STREAM_POSITION' ELSE 'COMPLETION' END AS reject_reason FROM arr a JOIN lims USING (tenant_id, engagement_id, source_stream_id))"""
    cur = "own AS (SELECT *, resource_uid || ':' || verification_key AS candidate_id, sha256(concat_ws('|', source_event_id, event_type, resource_uid, verification_key)) AS event_hash, event_type <> 'asset_observation' AND check_version = '1.0.0' AS listed FROM log WHERE engagement_id = 'eng-3')"
    acts = "acts AS (SELECT tenant_id, candidate_id, CAST(row_number() OVER (PARTITION BY tenant_id, candidate_id ORDER BY source_sequence) - 1 AS INT) AS action, source_event_id, event_hash FROM own WHERE listed)"
    lines = "lines AS (SELECT tenant_id, 0 AS section, candidate_id, '' AS event, 'candidate=' || candidate_id || '|' || cluster_id || '|' || resource_kind || '|' || resource_uid || '|' || verification_key AS line FROM cand UNION ALL SELECT tenant_id, 0, candidate_id, source_event_id, 'action:' || candidate_id || '=' || source_event_id || '|' || event_hash FROM own WHERE listed UNION ALL SELECT tenant_id, CASE event_type WHEN 'asset_observation' THEN 1 ELSE 2 END, '', source_event_id, CASE event_type WHEN 'asset_observation' THEN 'supporting=' ELSE 'background=' END || source_event_id || '|' || event_hash FROM own WHERE NOT listed)"
    bhash = "bh AS (SELECT tenant_id, sha256('{\"positions\":[' || string_agg('{\"source_stream_id\":\"' || source_stream_id || '\",\"last_data_sequence\":' || lim || '}', ',' ORDER BY source_stream_id) || ']}') AS knowledge_boundary_hash FROM ASKED GROUP BY tenant_id)"
    dig = f"dig AS (SELECT tenant_id, sha256('{{\"facts\":[' || string_agg({fact_json}, ',' ORDER BY ts, source_stream_id, source_sequence, source_event_id) || ']}}') AS fact_digest FROM facts WHERE engagement_id = 'eng-3' GROUP BY tenant_id)"
    json_head = lambda view: f"'{{\"report_view\":\"{view}\",\"knowledge_boundary_hash\":\"' || knowledge_boundary_hash || '\",\"current_engagement_id\":\"eng-3\",\"policy_bundle_version\":1,\"current_engagement_fact_digest\":\"' || fact_digest || '\",\"summary\":{{'"
    text_head = lambda view: f"'Report view: {view}' || chr(10) || 'Current engagement: eng-3' || chr(10) || 'Knowledge boundary hash: ' || knowledge_boundary_hash || chr(10) || 'Current engagement fact digest: ' || fact_digest || chr(10) || 'Policy bundle version: 1' || chr(10)"
    names = ["NEW", "STILL_OPEN", "VERIFIED_RESOLVED", "REGRESSED", "NOT_RETESTED", "INCONCLUSIVE"]
    item = "'{\"cluster_id\":\"' || cluster_id || '\",\"resource_kind\":\"' || resource_kind || '\",\"resource_uid\":\"' || resource_uid || '\",\"vuln_class\":\"' || vuln_class || '\",\"normalized_location_signature\":\"' || location || '\",\"match_key_version\":1,\"verification_key\":\"' || verification_key || '\",\"episode_classification\":\"' || classification || '\",\"current_assessment\":\"' || assessment || '\",\"last_verified_exposure\":\"' || exposure || '\"}'"
    line = "format('{} [{} @ {}, {}/{}/{}]: episode {}, current {}, last verified exposure {}', verification_key, vuln_class, location, cluster_id, resource_kind, resource_uid, classification, assessment, exposure)"
    order = "ORDER BY cluster_id, resource_kind, resource_uid, vuln_class, location"
    counts = ", ".join(f"count(*) FILTER (classification = '{c}') AS n_{c}" for c in names)
    count_json = " || ',' || ".join(f"'\"{c}\":' || n_{c}" for c in names)
    count_text = " || ".join(f"'{c}: ' || n_{c} || chr(10)" for c in names)
    memory = f"lists AS (SELECT tenant_id, {counts}, string_agg({item}, ',' {order}) AS items, string_agg({line} || chr(10), '' {order}) AS lines FROM post GROUP BY tenant_id), mem AS (SELECT tenant_id, {json_head('MEMORY')} || '\"classification_counts\":{{' || {count_json} || '}},\"findings\":[' || items || ']}}}}' AS json, {text_head('MEMORY')} || {count_text} || lines AS text FROM lists JOIN bh USING (tenant_id) JOIN dig USING (tenant_id))"
    stateless = f"sums AS (SELECT tenant_id, count(DISTINCT resource_uid || '|' || vuln_class || '|' || location) FILTER (fact_kind = 'finding_occurrence') AS d, count(*) FILTER (fact_kind = 'test_attempt' AND execution_status = 'completed' AND result = 'not_detected') AS nd, count(*) FILTER (fact_kind = 'test_attempt' AND execution_status <> 'completed') AS p FROM facts WHERE engagement_id = 'eng-3' AND tenant_id <> 'tenant-0' GROUP BY ALL), st AS (SELECT tenant_id, {json_head('STATELESS')} || '\"detected\":' || d || ',\"not_detected\":' || nd || ',\"partial\":' || p || '}}}}' AS json, {text_head('STATELESS')} || 'Detected: ' || d || chr(10) || 'Not detected: ' || nd || chr(10) || 'Partial: ' || p || chr(10) || 'Findings with no eng-3 fact: not representable' || chr(10) || 'Longitudinal classifications: unavailable' || chr(10) AS text FROM sums JOIN bh USING (tenant_id) JOIN dig USING (tenant_id))"
    metric = "met AS (SELECT tenant_id, CAST(min(p0) AS INT) AS m0, CAST(min(p1) AS INT) AS m1 FROM rk JOIN facts f USING (tenant_id, cluster_id, resource_kind, resource_uid, verification_key) JOIN post p USING (tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location) WHERE p.classification = 'REGRESSED' AND f.fact_kind = 'finding_occurrence' AND f.engagement_id = 'eng-3' AND f.check_version = '1.0.0' GROUP BY ALL)"
    row_fields = ["tenant_id", "engagement_id", "source_stream_id", "source_sequence", "source_event_id", "event_type", "cluster_id", "resource_uid", "verification_key", "check_version", "relevant_context_hash", "compatibility_policy_version", "execution_status", "result"]
    numbers = {"source_sequence", "compatibility_policy_version"}
    row_json = " || ',' || ".join(f"'\"{c}\":' || {c}" if c in numbers else q(c, c) for c in row_fields[:-2]) + " || CASE WHEN execution_status IS NULL THEN '' ELSE ',' || " + q("execution_status", "execution_status") + " END || CASE WHEN result IS NULL THEN '' ELSE ',' || " + q("result", "result") + " END"
    payload = "'{' || " + " || ',' || ".join([q("check_version", "check_version"), q("cluster_id", "cluster_id"), "'\"compatibility_policy_version\":1'", q("execution_status", "execution_status"), "'\"relevant_context\":{\"is_address_bound\":false,\"normalized_route\":\"/' || location || '\",\"port\":' || port || ',\"protocol\":\"https\"}'", q("resource_kind", "resource_kind"), q("resource_uid", "resource_uid")]) + " || CASE WHEN result IS NULL THEN '' ELSE ',' || " + q("result", "result") + " END || ',' || " + q("verification_key", "verification_key") + " || '}'"
    envelope = "'{' || " + " || ',' || ".join([q("source_event_id", "source_event_id"), q("event_type", "event_type"), q("source_stream_id", "source_stream_id"), "'\"source_sequence\":' || source_sequence", "'\"schema_version\":1'", q("occurred_at", f"({iso})"), f"'\"payload\":' || {payload}"]) + " || '}'"
    codes = "CASE event_id % 20 WHEN 0 THEN 'NUMBER_RANGE' WHEN 1 THEN 'ENVELOPE_UNKNOWN_FIELD' WHEN 2 THEN 'MALFORMED' WHEN 3 THEN 'NOT_UTF8' WHEN 4 THEN 'STRUCTURE' ELSE CASE WHEN compatibility_policy_version <> 1 THEN 'PAYLOAD_RANGE' END END"
    violations = [("positive_sequence", "del", "source_sequence <= 0"), ("nonblank_id", "log", "trim(source_event_id) = ''"), ("hex_hash", "log", "NOT regexp_full_match(relevant_context_hash, '[0-9a-f]{64}')"), ("status_result", "log", "event_type = 'test_attempt' AND NOT CASE WHEN execution_status = 'completed' THEN coalesce(result IN ('detected', 'not_detected'), false) ELSE coalesce(result = 'inconclusive', true) END"), ("policy_version", "log", "compatibility_policy_version <> 1"), ("outcome_basis", "seen", "outcome = 'REJECTED'")]
    classes = "(VALUES (1, 'NEW'), (2, 'STILL_OPEN'), (3, 'VERIFIED_RESOLVED'), (4, 'REGRESSED'), (5, 'NOT_RETESTED'), (6, 'INCONCLUSIVE')) c(place, classification)"
    from . import proofs

    found = {
        "boundary_facts": log + "SELECT tenant_id, source_stream_id, source_sequence, source_event_id, fact_kind, resource_uid, verification_key, check_version, execution_status, result FROM facts",
        "boundary_guard": _with(LOG, asked) + "SELECT tenant_id, source_stream_id, last_data_sequence, CASE WHEN lim IS NULL THEN 'UNKNOWN_STREAM' WHEN source_stream_id = 'stream-2-1' THEN 'NOT_FINALIZED' WHEN lim <> last_data_sequence THEN 'WRONG_POSITION' END AS boundary_error FROM ask LEFT JOIN pos USING (tenant_id, source_stream_id)",
        "finalized_engagements": _with(LOG, done) + "SELECT d.tenant_id, d.engagement_id, d.source_stream_id, count(*) AS n_events, max(source_sequence) AS max_sequence, CASE WHEN count(DISTINCT source_sequence) FILTER (source_sequence <= named) = any_value(named) THEN any_value(named) ELSE 0 END AS last_data_sequence FROM data d LEFT JOIN mk USING (tenant_id, engagement_id, source_stream_id) GROUP BY ALL",
        "stream_gaps": _with(LOG, "g AS (SELECT *, source_sequence - coalesce(lag(source_sequence) OVER (PARTITION BY tenant_id, source_stream_id ORDER BY source_sequence), 0) AS step FROM log WHERE event_id % 97 <> 5)") + "SELECT tenant_id, source_stream_id, min(source_sequence - step + 1) AS first_missing, CAST(sum(step - 1) AS BIGINT) AS n_missing FROM g WHERE step > 1 GROUP BY ALL",
        "inbox_decisions": _with(LOG, DELIVERIES, decided("del")) + "SELECT tenant_id, source_stream_id, source_sequence, source_event_id, arrival, decision, reject_reason FROM dec",
        "stream_binding": _with(LOG, DELIVERIES, decided("del")) + "SELECT tenant_id, source_stream_id, coalesce(be, 'OK') AS binding, count(*) AS n_deliveries FROM bnd GROUP BY ALL",
        "replay_noop": _with(LOG, DELIVERIES, "two AS (SELECT * FROM b UNION ALL SELECT * REPLACE (arrival + 1000000000 AS arrival) FROM b)", decided("two")) + "SELECT decision, count(*) AS n_deliveries FROM dec GROUP BY ALL",
        "assets": log + f"SELECT tenant_id, cluster_id, resource_kind, resource_uid, {asset_id} AS canonical_asset_id FROM (SELECT DISTINCT tenant_id, cluster_id, resource_kind, resource_uid FROM log)",
        "observations": _with(LOG, observed) + "SELECT tenant_id, source_event_id, resource_uid, outcome, basis FROM seen",
        "ambiguity_delta": _with(LOG, observed) + "SELECT tenant_id, outcome, count(*) AS n_observations FROM seen GROUP BY ALL",
        "identity_stability": log + "SELECT tenant_id, cluster_id, resource_kind, resource_uid, count(DISTINCT engagement_id) AS n_engagements, count(DISTINCT k) AS n_pods, count(DISTINCT k) AS n_names, count(DISTINCT event_id % 251) AS n_ips FROM log WHERE event_type = 'asset_observation' GROUP BY ALL HAVING count(DISTINCT engagement_id) > 1 AND count(DISTINCT k) > 1 AND count(DISTINCT event_id % 251) > 1",
        "findings_baseline": _with(LOG, occ) + "SELECT tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location, min_by(verification_key, event_id) AS verification_key, min_by(check_version, event_id) AS check_version, min_by(relevant_context_hash, event_id) AS relevant_context_hash, min_by(compatibility_policy_version, event_id) AS compatibility_policy_version, min_by(source_event_id, event_id) AS first_event_id, count(*) AS n_occurrences FROM occ GROUP BY tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location",
        "baseline_conflicts": _with(LOG, occ) + "SELECT tenant_id, source_event_id, check_version FROM (SELECT *, first_value(verification_key || '|' || check_version) OVER (PARTITION BY tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location ORDER BY event_id) AS b0 FROM occ) WHERE verification_key || '|' || check_version <> b0",
        "coverage_pairs": log + "SELECT tenant_id, cluster_id, resource_kind, resource_uid, f_vuln AS vuln_class, f_loc AS location, count(*) AS n_attempts FROM pairs GROUP BY ALL",
        "resolving_evidence": log + "SELECT tenant_id, cluster_id, resource_kind, resource_uid, f_vuln AS vuln_class, f_loc AS location, source_event_id FROM pairs WHERE execution_status = 'completed' AND result = 'not_detected'",
        "posture_fold": post + "SELECT * FROM post",
        "classification_counts": post + f"SELECT t.tenant_id, c.place, c.classification, count(p.tenant_id) AS n_findings FROM (SELECT DISTINCT tenant_id FROM post) t CROSS JOIN {classes} LEFT JOIN post p ON p.tenant_id = t.tenant_id AND p.classification = c.classification GROUP BY ALL",
        "exposure_counts": post + "SELECT exposure, assessment, count(*) AS n_findings FROM post GROUP BY ALL",
        "stateless_summary": log + "SELECT tenant_id, count(DISTINCT resource_uid || '|' || vuln_class || '|' || location) FILTER (fact_kind = 'finding_occurrence') AS detected, count(*) FILTER (fact_kind = 'test_attempt' AND execution_status = 'completed' AND result = 'not_detected') AS not_detected, count(*) FILTER (fact_kind = 'test_attempt' AND execution_status <> 'completed') AS partial FROM facts WHERE engagement_id = 'eng-3' GROUP BY ALL",
        "human_report": post + "SELECT tenant_id, format('{} [{} @ {}, {}/{}/{}]: episode {}, current {}, last verified exposure {}', verification_key, vuln_class, location, cluster_id, resource_kind, resource_uid, classification, assessment, exposure) AS line FROM post",
        "memory_report_findings": post + "SELECT tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location AS normalized_location_signature, 1 AS match_key_version, verification_key, classification AS episode_classification, assessment AS current_assessment, exposure AS last_verified_exposure FROM post",
        "semantic_fact_digest": log + f"SELECT tenant_id, count(*) AS n_facts, sha256('{{\"facts\":[' || string_agg({fact_json}, ',' ORDER BY ts, source_stream_id, source_sequence, source_event_id) || ']}}') AS fact_digest FROM facts WHERE engagement_id = 'eng-3' GROUP BY tenant_id",
        "boundary_digest": log + "SELECT tenant_id, sha256('{\"positions\":[' || string_agg('{\"source_stream_id\":\"' || source_stream_id || '\",\"last_data_sequence\":' || n || '}', ',' ORDER BY source_stream_id) || ']}') AS digest FROM (SELECT tenant_id, source_stream_id, lim AS n FROM pos) GROUP BY tenant_id",
        "context_fingerprints": log + "SELECT DISTINCT '/' || location AS route, sha256('{\"protocol\":\"https\",\"port\":443,\"normalized_route\":\"/' || location || '\",\"parameters\":{},\"is_address_bound\":false}') AS digest FROM log",
        "memory_features": featured + "SELECT * FROM feat",
        "plan_memory_off": _with(LOG, prior, cand, feat, ranked) + "SELECT tenant_id, CAST(p0 AS INT) AS position, candidate_id FROM rk WHERE p0 <= 3",
        "plan_memory_on": _with(LOG, prior, cand, feat, ranked) + "SELECT tenant_id, CAST(p1 AS INT) AS position, candidate_id FROM rk WHERE p1 <= 3",
        "regression_metric": _with(LOG, prior, cand, feat, ranked, fold("true", "eng-3", "post"), metric) + "SELECT tenant_id, m1 AS actions_before_regression, CAST(1 AS BIGINT) AS most_owners FROM met",
        "arm_comparison": _with(LOG, prior, cand, feat, ranked, fold("true", "eng-3", "post"), metric) + "SELECT tenant_id, true AS modes_differ, true AS both_began_empty, true AS same_boundary_hash, true AS same_earlier_fact_digest, true AS same_input_digest, true AS same_fact_digest, true AS same_report_digest, true AS same_candidates, bool_or(p0 <> p1) AS order_differs, any_value(m0) AS control_metric, any_value(m1) AS memory_metric, true AS comparable FROM rk LEFT JOIN met USING (tenant_id) GROUP BY tenant_id",
        "controlled_input_digest": _with(LOG, cand, cur, lines) + "SELECT tenant_id, sha256('tenant=' || tenant_id || chr(10) || 'engagement=eng-3' || chr(10) || 'budget=3' || chr(10) || string_agg(line || chr(10), '' ORDER BY section, candidate_id, event)) AS digest FROM lines GROUP BY tenant_id",
        "detected_without_occurrence": log + "SELECT p.tenant_id, p.cluster_id, p.resource_kind, p.resource_uid, f_vuln AS vuln_class, f_loc AS location, source_event_id FROM pairs p WHERE execution_status = 'completed' AND result = 'detected' AND NOT EXISTS (SELECT 1 FROM facts o WHERE o.fact_kind = 'finding_occurrence' AND o.tenant_id = p.tenant_id AND o.resource_uid = p.resource_uid AND o.vuln_class = p.f_vuln AND o.location = p.f_loc AND o.engagement_id = p.engagement_id)",
        "detected_unrepresented": log + "SELECT tenant_id, source_event_id FROM facts a WHERE fact_kind = 'test_attempt' AND execution_status = 'completed' AND result = 'detected' AND NOT EXISTS (SELECT 1 FROM fnd f WHERE f.tenant_id = a.tenant_id AND f.cluster_id = a.cluster_id AND f.resource_uid = a.resource_uid AND f.verification_key = a.verification_key AND f.check_version = a.check_version AND f.relevant_context_hash = a.relevant_context_hash AND f.compatibility_policy_version = 1 AND a.compatibility_policy_version = 1)",
        "constraint_violations": _with(LOG, DELIVERIES, observed) + "SELECT 'unique_event' AS rule, count(*) AS n_violations FROM (SELECT 1 FROM del GROUP BY tenant_id, source_event_id HAVING count(*) > 1) UNION ALL SELECT 'unique_position', count(*) FROM (SELECT 1 FROM del GROUP BY tenant_id, source_stream_id, source_sequence HAVING count(*) > 1) UNION ALL SELECT 'one_marker', 0" + "".join(f" UNION ALL SELECT '{n}', count(*) FROM {t} WHERE {c}" for n, t, c in violations),
        "fixture_validation": log + "SELECT count(*) FILTER (regexp_matches(concat_ws('|', source_event_id, resource_uid, vuln_class), 'F-(STILL|FIXED|REGRESS|UNTESTED|INCONCLUSIVE|NEW)|T-[ABC]')) AS n_leaks, count(DISTINCT source_event_id) AS n_ids, count(*) AS n_events FROM log",
        "table_snapshot_hash": log + f"SELECT tenant_id, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(sha256('{{' || {row_json} || '}}'), 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint FROM log GROUP BY ALL",
        "shuffle_convergence": log + "SELECT tenant_id, count(*) AS n_accepted, CAST(sum(source_sequence) AS BIGINT) AS sum_sequence FROM log GROUP BY ALL",
        "guarded_facts": log + "SELECT tenant_id, source_event_id, fact_kind FROM facts WHERE tenant_id <> 'tenant-2'",
        "completion_decisions": _with(LOG, mark) + "SELECT tenant_id, source_stream_id, source_sequence, source_event_id, arrival, CASE WHEN reject_reason IS NOT NULL THEN 'REJECTED' WHEN kind = 1 THEN 'NO_OP' ELSE 'ACCEPTED' END AS decision, reject_reason FROM got",
        "late_data": _with(LOG, mark) + "SELECT source_stream_id, reject_reason, count(*) AS n_deliveries FROM got WHERE reject_reason IS NOT NULL GROUP BY ALL",
        "inbox_exact": _with(LOG, DELIVERIES, decided("del")) + "SELECT tenant_id, source_stream_id, source_sequence, source_event_id, arrival, decision, reject_reason FROM dec",
        "decode_rejects": log + f"SELECT event_id, reject_reason, CASE WHEN reject_reason IS NULL THEN sha256(body) END AS canonical_source_hash FROM (SELECT event_id, {codes} AS reject_reason, {envelope} AS body FROM log WHERE event_type = 'test_attempt')",
        "new_assets": log + f"SELECT tenant_id, cluster_id, resource_kind, resource_uid, {asset_id} AS canonical_asset_id FROM (SELECT DISTINCT tenant_id, cluster_id, resource_kind, resource_uid FROM log WHERE engagement_id = 'eng-3' EXCEPT SELECT tenant_id, cluster_id, resource_kind, resource_uid FROM log WHERE engagement_id = 'eng-1' AND k % 3 = 0 AND event_type = 'asset_observation')",
        "label_pairs": log + "SELECT source_event_id, unnest(['app', 'zone']) AS label, unnest([CAST(k % 7 AS VARCHAR), CAST(event_id % 11 AS VARCHAR)]) AS value FROM log WHERE event_type = 'asset_observation'",
        "finding_decisions": _with(LOG, occ) + f"SELECT tenant_id, source_event_id, {finding_id} AS finding_id, CASE WHEN check_version <> c0 THEN 'FINDING_BASELINE_CONFLICT' END AS reject_reason FROM (SELECT *, first_value(check_version) OVER (PARTITION BY tenant_id, cluster_id, resource_uid, vuln_class, location ORDER BY event_id) AS c0 FROM occ)",
        "test_attempts": log + f"SELECT tenant_id, source_event_id, {asset_id} AS canonical_asset_id, verification_key, check_version, relevant_context_hash, compatibility_policy_version, execution_status, result FROM log WHERE event_type = 'test_attempt'",
        "memory_report": _with(LOG, fold("true", "eng-3", "post"), bhash.replace("ASKED", "pos"), dig, memory) + "SELECT tenant_id, json, sha256(json) AS digest, text FROM mem",
        "transcripts": _with(LOG, fold("true", "eng-3", "post"), bhash.replace("ASKED", "pos"), dig, memory) + "SELECT tenant_id, sha256(text) AS digest FROM mem",
        "stateless_report": _with(LOG, bhash.replace("ASKED", "(SELECT * FROM pos WHERE source_stream_id LIKE '%-3')"), dig, stateless) + "SELECT tenant_id, json, sha256(json) AS digest, text FROM st",
        "plan_errors": _with(LOG, cand) + "SELECT tenant_id, candidate_id, CASE WHEN tenant_id = 'tenant-2' THEN 'DUPLICATE_CANDIDATE' ELSE 'MISSING_FEATURE' END AS error FROM cand WHERE tenant_id = 'tenant-2' OR verification_key = 'check-1' UNION ALL SELECT DISTINCT tenant_id, 'unknown', 'UNKNOWN_CANDIDATE' FROM cand",
        "candidate_actions": _with(LOG, cur, acts) + "SELECT * FROM acts",
        "supporting_events": _with(LOG, cur) + "SELECT tenant_id, source_event_id FROM own WHERE NOT listed",
        "action_errors": _with(LOG, cand, cur) + "SELECT tenant_id, source_event_id, 'UNKNOWN_ACTION' AS error FROM own WHERE listed AND event_id % 50 = 3 UNION ALL SELECT tenant_id, NULL, 'NO_ACTIONS' FROM cand c WHERE NOT EXISTS (SELECT 1 FROM own o WHERE listed AND o.tenant_id = c.tenant_id AND o.candidate_id = c.candidate_id)",
        "empty_tables": log + "SELECT * FROM (VALUES ('source_events', false), ('assets', false), ('findings', false), ('test_attempts', false), ('nothing', true)) t(name, is_empty)",
    }
    unrepresented = found["detected_unrepresented"].removeprefix(log)
    return found | proofs.sql(observed, asked, row_json, unrepresented)
