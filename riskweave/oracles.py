"""DuckDB SQL that states each query's result independently of the Spark code.

Built from named table expressions; each statement pulls in the ones it needs."""

from __future__ import annotations

PAGERANK_ROUNDS = 10
PAGERANK_SEARCH = 20

HIGH_RISK = "('IR','KP','MM','NG','KY','VE','RU')"

TABLES: dict[str, str] = {}

TABLES["labelled"] = """
  SELECT 'TXN-' || lpad(CAST(ok AS VARCHAR), 12, '0') AS transaction_id,
         TIMESTAMP '2026-01-01 00:00:00' + to_seconds((ok * 7919) % 2592000) AS "timestamp",
         'USR-' || lpad(CAST(s AS VARCHAR), 8, '0') AS sender_id,
         'USR-' || lpad(CAST(r AS VARCHAR), 8, '0') AS receiver_id,
         CAST(cents AS DOUBLE) / 100 AS amount,
         (['US','CA','GB','DE','SG','KY','PA','CH','AE','HK','FR','JP','AU','BR','IN','ZA','NG','RU','KE',
           'IT','ES','NL','SE','NO','MX'])[CAST((r * 7) % 25 + 1 AS BIGINT)] AS receiver_country,
         CASE s % 10 WHEN 1 THEN ln || ' ' || fn WHEN 2 THEN left(fn || ' ' || ln, 14) ELSE fn || ' ' || ln END AS sender_name,
         CAST(([5411,5812,5944,6011,6211,7995])[CAST(ok % 6 + 1 AS BIGINT)] AS INTEGER) AS mcc_code,
         lpad(CAST(s - CASE WHEN s % 25 = 1 THEN 1 ELSE 0 END AS VARCHAR), 9, '0') AS sender_national_id,
         (['Software Engineer','Business Owner','Unemployed','Student','Chief Executive','Consultant',
           'Art Dealer'])[CAST(s % 7 + 1 AS BIGINT)] AS sender_occupation,
         CAST(age AS INTEGER) AS account_age_days,
         CAST(1 + (s * 53) % 100 AS INTEGER) AS user_risk_score,
         peer_group,
         CAST(av * 8 AS DOUBLE) AS expected_monthly_vol,
         CAST(av AS DOUBLE) AS historical_avg_txn,
         CAST(CASE peer_group WHEN 'STUDENT' THEN 25 WHEN 'RETAIL' THEN 90 WHEN 'SME' THEN 1200 WHEN 'HNI' THEN 3500
              WHEN 'CORPORATE' THEN 20000 END AS DOUBLE) AS historical_std_dev,
         CAST((s * 29) % 51 AS INTEGER) AS known_counterparties,
         CAST(CASE WHEN (ok % 120 = 0 AND (ok // 120) % 10 < 7) OR (ok % 70 = 0 AND age < 30) THEN 1 ELSE 0 END AS INTEGER)
           AS is_sar_filed
  FROM (SELECT *,
               CASE WHEN r0 = s THEN (r0 + 1) % nc ELSE r0 END AS r,
               CASE WHEN ok % 120 = 0 THEN 980000 + (ok * 7919) % 19950
                    WHEN ok % 70 = 0 THEN 5000000 + (ok * 7919) % 10000000
                    ELSE av * (20 + (ok * 7919) % 161) END AS cents,
               substr(h, 1, 6) AS fn, substr(h, 7, 8) AS ln
        FROM (SELECT *,
                     CASE WHEN ok % 10 = 0 THEN 0 WHEN ok % 7 = 3 THEN nc - 1 - s
                          WHEN ok % 11 = 5 THEN (s + nc // 3) % nc ELSE (s * 31 + ok * 17) % nc END AS r0,
                     1 + (s * 37) % 3650 AS age,
                     CASE peer_group WHEN 'STUDENT' THEN 40 WHEN 'RETAIL' THEN 150 WHEN 'SME' THEN 2500 WHEN 'HNI' THEN 8000
                          WHEN 'CORPORATE' THEN 45000 END AS av,
                     translate(md5(CAST(CASE WHEN s % 10 IN (1, 2) THEN s - s % 10 ELSE s END AS VARCHAR)),
                               '0123456789', 'ghijklmnop') AS h
              FROM (SELECT o_orderkey AS ok, o_custkey AS s, (SELECT count(*) FROM customer) AS nc,
                           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'STUDENT' WHEN 'BUILDING' THEN 'RETAIL'
                                WHEN 'FURNITURE' THEN 'SME' WHEN 'HOUSEHOLD' THEN 'HNI'
                                WHEN 'MACHINERY' THEN 'CORPORATE' END AS peer_group
                    FROM orders LEFT JOIN customer ON o_custkey = c_custkey)))
"""
TABLES["txn"] = "SELECT * EXCLUDE (is_sar_filed) FROM labelled"

# ---- network
TABLES["edges"] = "SELECT sender_id AS src, receiver_id AS dst, sum(amount) AS amount FROM txn WHERE amount >= 10000 GROUP BY ALL"
TABLES["degrees"] = """
  SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree
  FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node"""
TABLES["ranked"] = """
  SELECT node, in_degree, ((rank() OVER (ORDER BY in_degree) - 1)
         + (count(*) OVER (PARTITION BY in_degree) + 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS pct_rank FROM degrees"""
TABLES["two_hop"] = """
  SELECT DISTINCT e.src AS node FROM edges e JOIN edges b ON e.src = b.dst AND e.dst = b.src"""
TABLES["triples"] = """
  SELECT a.src AS a, a.dst AS b, b.dst AS c FROM edges a JOIN edges b ON a.dst = b.src
  JOIN edges c ON b.dst = c.src AND c.dst = a.src WHERE a.src <> a.dst AND b.src <> b.dst AND c.src <> c.dst"""
TABLES["top_nodes"] = "SELECT node, degree FROM degrees ORDER BY degree DESC, node LIMIT 1000"
TABLES["cycles"] = "SELECT node FROM two_hop UNION SELECT a FROM triples"
TABLES["network"] = """
  SELECT node, in_degree AS network_centrality, CAST(CASE WHEN c.node IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_in_cycle,
         round_even(least(greatest(pct_rank * 70 + CASE WHEN c.node IS NULL THEN 0 ELSE 30 END, 0), 100) * 100, 0) / 100
           AS network_raw
  FROM ranked LEFT JOIN (SELECT node, node AS mark FROM cycles) c USING (node)"""
TABLES["links"] = """
  SELECT src, dst, amount / sum(amount) OVER (PARTITION BY src) AS share FROM edges"""
TABLES["nodes"] = "SELECT node, out_degree = 0 AS dangling, count(*) OVER () AS n FROM degrees"


def _ranks(upto: int) -> dict[str, str]:
    steps = {"pr0": "SELECT node, CAST(1 AS DOUBLE) / n AS score FROM nodes"}
    for k in range(1, upto + 1):
        steps[f"pr{k}"] = f"""
  SELECT node, (CAST(15 AS DOUBLE) / 100) / n
         + 0.85 * (SELECT coalesce(sum(score), 0) FROM pr{k - 1} JOIN nodes USING (node) WHERE dangling) / n
         + 0.85 * coalesce(got, 0) AS score
  FROM nodes LEFT JOIN (SELECT dst AS node, sum(score * share) AS got FROM links JOIN pr{k - 1} ON src = node GROUP BY dst)
       USING (node)"""
    return steps


TABLES.update(_ranks(PAGERANK_SEARCH))
TABLES["pagerank_stop"] = (
    "SELECT min(k) AS k FROM ("
    + " UNION ALL ".join(
        f"SELECT {k} AS k, sum(abs(a.score - b.score)) AS change, count(*) AS n FROM pr{k} a JOIN pr{k - 1} b USING (node)"
        for k in range(1, PAGERANK_SEARCH + 1)
    )
    + ") WHERE change < n * 1e-6"
)
TABLES["pagerank_end"] = " UNION ALL ".join(
    f"SELECT node, score FROM pr{k} WHERE (SELECT k FROM pagerank_stop) = {k}" for k in range(1, PAGERANK_SEARCH + 1)
)

# ---- rules and scenarios
TABLES["rules"] = f"""
  SELECT *, CAST(CASE WHEN amount >= 9000 AND amount < 10000 THEN 100 ELSE 0 END AS DOUBLE) AS structuring_raw,
         CASE WHEN ratio >= 2 THEN least(greatest(ratio / CAST(2 AS DOUBLE) * 50, 0), 100) ELSE CAST(0 AS DOUBLE) END AS velocity_raw,
         CAST(CASE WHEN receiver_country IN {HIGH_RISK} THEN 100 ELSE 0 END AS DOUBLE) AS geo_raw
  FROM (SELECT *, amount / CASE WHEN expected_monthly_vol = 0 THEN 1 ELSE expected_monthly_vol END AS ratio FROM txn)"""
TABLES["ins"] = "SELECT receiver_id, count(DISTINCT sender_id) AS unique_senders, sum(amount) AS total_in_amt FROM txn GROUP BY 1"
TABLES["outs"] = "SELECT sender_id, sum(amount) AS total_out_amt FROM txn GROUP BY 1"
TABLES["hubs"] = """
  SELECT receiver_id AS account_id, unique_senders, total_in_amt, total_out_amt FROM ins JOIN outs ON receiver_id = sender_id
  WHERE unique_senders >= 10 AND total_out_amt >= total_in_amt * CAST(0.8 AS DOUBLE)"""
TABLES["turns"] = """
  SELECT DISTINCT a.sender_id FROM txn a JOIN txn b ON a.sender_id = b.receiver_id AND a.receiver_id = b.sender_id
  WHERE b."timestamp" > a."timestamp" AND b."timestamp" < a."timestamp" + INTERVAL 24 HOUR"""
MISMATCH = "mcc_code IN (5944, 6211) AND sender_occupation IN ('Student', 'Unemployed') AND amount >= 2000"
TABLES["scenarios"] = f"""
  SELECT * REPLACE (CASE WHEN sender_id IN (SELECT account_id FROM hubs) OR receiver_id IN (SELECT account_id FROM hubs)
                         THEN CAST(100 AS DOUBLE) ELSE structuring_raw END AS structuring_raw),
         CAST(CASE WHEN {MISMATCH} THEN 90 WHEN sender_id IN (SELECT sender_id FROM turns) THEN 80 ELSE 0 END AS DOUBLE)
           AS scenario_raw
  FROM rules"""


TABLES["behavior"] = """
  SELECT transaction_id, CAST(CASE WHEN n < 3 THEN 0 WHEN z >= 3 THEN 100 WHEN z >= 1.5 THEN z / 3 * 100 ELSE 0 END AS DOUBLE)
         AS behavioral_raw
  FROM (SELECT transaction_id, n, (amount - mu) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END AS z
        FROM txn JOIN (SELECT sender_id, count(amount) AS n, avg(amount) AS mu, stddev_samp(amount) AS sd FROM txn GROUP BY 1)
        USING (sender_id))"""
TABLES["signals"] = "SELECT s.*, b.behavioral_raw FROM scenarios s JOIN behavior b USING (transaction_id)"
RULE_MAX = "greatest(structuring_raw, velocity_raw, geo_raw, behavioral_raw)"
BAND = "CASE WHEN {s} >= 85 THEN 'CRITICAL' WHEN {s} >= {high} THEN 'HIGH' WHEN {s} >= 35 THEN 'MEDIUM' ELSE 'LOW' END"


def _final(rule: str, extra: str = "") -> str:
    return f"least(greatest(round_even(({rule} * CAST(0.45 AS DOUBLE){extra}) * 100, 0) / 100, 0), 100)"


TABLES["scored"] = f"SELECT *, {_final(RULE_MAX)} AS final_risk_score FROM signals"
TABLES["banded"] = f"SELECT *, {BAND.format(s='final_risk_score', high=65)} AS risk_band FROM scored"

# ---- identity
TABLES["national"] = """
  SELECT sender_id, arg_max(primary_id, sender_national_id) AS primary_id
  FROM (SELECT DISTINCT sender_id, sender_national_id FROM txn)
  JOIN (SELECT sender_national_id, min(sender_id) AS primary_id FROM txn GROUP BY 1 HAVING count(DISTINCT sender_id) > 1)
  USING (sender_national_id) GROUP BY 1"""
TABLES["profiles"] = """
  SELECT *, row_number() OVER (ORDER BY first_seen, sender_id, sender_name) AS i,
         array_to_string(list_sort(string_split(sender_name, ' ')), ' ') AS t
  FROM (SELECT sender_id, sender_name, min("timestamp") AS first_seen FROM txn GROUP BY ALL)"""
# an insert/delete distance is never below levenshtein, so this loses no pair
TABLES["candidates"] = """
  SELECT a.i AS i, b.i AS j, a.t AS a, b.t AS b, CAST(floor((length(a.t) + length(b.t)) * 0.15 + 1e-9) AS BIGINT) AS budget
  FROM profiles a JOIN profiles b ON b.i > a.i
  WHERE abs(length(a.t) - length(b.t)) <= floor((length(a.t) + length(b.t)) * 0.15 + 1e-9)
    AND levenshtein(a.t, b.t) <= floor((length(a.t) + length(b.t)) * 0.15 + 1e-9)"""
# longest common subsequence, one letter of ``a`` per step: a row of the usual table is the
# running maximum of what its letter adds
TABLES["lcs"] = """
  SELECT a, b, 0 AS k, list_transform(range(1, length(b) + 1), lambda x: CAST(0 AS BIGINT)) AS r FROM
    (SELECT DISTINCT a, b FROM candidates)
  UNION ALL
  SELECT a, b, k + 1,
         list_transform(range(1, length(b) + 1), lambda x: list_max(list_transform(range(1, x + 1),
           lambda y: greatest(r[y], CASE WHEN substr(b, y, 1) = substr(a, k + 1, 1)
                                        THEN CASE WHEN y = 1 THEN 0 ELSE r[y - 1] END + 1 ELSE 0 END))))
  FROM lcs WHERE k < length(a)"""
TABLES["matches"] = """
  SELECT i, j, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS place
  FROM (SELECT i, j, 100 * (1 - CAST(length(a) + length(b) - 2 * list_max(r) AS DOUBLE) / (length(a) + length(b))) AS score
        FROM candidates JOIN (SELECT * FROM lcs WHERE k = length(a)) USING (a, b)
        WHERE length(a) + length(b) - 2 * list_max(r) <= budget)
  QUALIFY place <= 5"""
TABLES["claims"] = "SELECT i, list(j ORDER BY place) AS js FROM matches GROUP BY i"
TABLES["walk"] = """
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS done, false AS anchor
  UNION ALL
  SELECT w.i + 1, CASE WHEN list_contains(w.done, w.i + 1) THEN w.done ELSE list_concat(w.done, coalesce(c.js, [])) END,
         NOT list_contains(w.done, w.i + 1)
  FROM walk w LEFT JOIN claims c ON c.i = w.i + 1 WHERE w.i < (SELECT count(*) FROM profiles)"""
TABLES["name_map"] = """
  SELECT pj.sender_id AS sender_id, arg_max(pi.sender_id, pi.i) AS parent_id
  FROM walk w JOIN matches m ON m.i = w.i JOIN profiles pi ON pi.i = m.i JOIN profiles pj ON pj.i = m.j
  WHERE w.anchor GROUP BY 1"""
# the same without a limit
TABLES["free_matches"] = TABLES["matches"].replace("QUALIFY place <= 5", "")
for _name in ("claims", "walk", "name_map"):
    _sql = TABLES[_name]
    for _part in ("matches", "claims", "walk"):
        _sql = _sql.replace(f"FROM {_part} ", f"FROM free_{_part} ").replace(f"JOIN {_part} ", f"JOIN free_{_part} ")
    TABLES[f"free_{_name}"] = _sql
TABLES["entity_of"] = """
  SELECT s.sender_id, coalesce(m.parent_id, n.primary_id, s.sender_id) AS global_entity_id
  FROM (SELECT DISTINCT sender_id FROM txn) s LEFT JOIN national n ON n.sender_id = s.sender_id
  LEFT JOIN name_map m ON m.sender_id = coalesce(n.primary_id, s.sender_id)"""

# ---- the whole batch
TABLES["e_edges"] = """
  SELECT global_entity_id AS src, receiver_id AS dst, sum(amount) AS amount FROM txn JOIN entity_of USING (sender_id)
  WHERE amount >= 10000 GROUP BY ALL"""
for _name in ("degrees", "ranked", "two_hop", "triples", "cycles", "network"):
    _sql = TABLES[_name]
    for _part in ("edges", "degrees", "ranked", "two_hop", "triples", "cycles"):
        _sql = _sql.replace(f"FROM {_part}", f"FROM e_{_part}").replace(f"JOIN {_part}", f"JOIN e_{_part}")
    TABLES[f"e_{_name}"] = _sql
TABLES["e_behavior"] = """
  SELECT transaction_id, CAST(CASE WHEN n < 3 THEN 0 WHEN z >= 3 THEN 100 WHEN z >= 1.5 THEN z / 3 * 100 ELSE 0 END AS DOUBLE)
         AS behavioral_raw
  FROM (SELECT transaction_id, n, (amount - mu) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END AS z
        FROM e_txn JOIN (SELECT global_entity_id, count(amount) AS n, avg(amount) AS mu, stddev_samp(amount) AS sd
                         FROM e_txn GROUP BY 1) USING (global_entity_id))"""
TABLES["e_txn"] = "SELECT * FROM txn JOIN entity_of USING (sender_id)"
TABLES["e_signals"] = """
  SELECT s.transaction_id, e.global_entity_id, n.network_raw, s.structuring_raw, s.velocity_raw, s.geo_raw, b.behavioral_raw
  FROM scenarios s JOIN entity_of e USING (sender_id) JOIN e_behavior b USING (transaction_id)
  LEFT JOIN e_network n ON n.node = e.global_entity_id"""

# ---- windows
TABLES["moments"] = """
  SELECT sender_id, "timestamp", count(*) AS n, sum(CAST(round(amount * 10000) AS BIGINT)) AS units,
         sum(CAST(round(amount * 10000) AS HUGEINT) * CAST(round(amount * 10000) AS HUGEINT)) AS squares FROM txn GROUP BY ALL"""
TABLES["flows"] = """
  SELECT account_id, "timestamp", sum(i) AS i, sum(o) AS o, sum(p) AS p
  FROM (SELECT sender_id AS account_id, "timestamp", 0 AS i, CAST(round(amount * 10000) AS BIGINT) AS o, 1 AS p FROM txn
        UNION ALL SELECT receiver_id, "timestamp", CAST(round(amount * 10000) AS BIGINT), 0, 0 FROM txn) GROUP BY ALL"""


STATEMENTS: dict[str, str] = {
    "scan_transactions": "SELECT * FROM txn",
    "scan_training": "SELECT * FROM labelled",
    "delta_gate": """SELECT transaction_id, "timestamp" FROM txn WHERE "timestamp" > TIMESTAMP '2026-01-16 00:00:00'""",
    "watermark_advance": """SELECT max("timestamp") AS max_timestamp, count(*) AS n_rows FROM txn
        WHERE "timestamp" > TIMESTAMP '2026-01-16 00:00:00'""",
    "baseline_merge": """SELECT sender_id, round(avg(amount), 6) AS user_mean,
        round(coalesce(stddev_samp(amount), 0), 6) AS user_std, count(amount) AS txn_count FROM txn GROUP BY 1""",
    "night_flag": """SELECT transaction_id, CAST(CASE WHEN hour("timestamp") BETWEEN 1 AND 4 THEN 1 ELSE 0 END AS INTEGER)
        AS is_night_txn FROM txn""",
    "temporal_features": """SELECT transaction_id, CAST(hour("timestamp") AS INTEGER) AS hour,
        CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
        CAST(CASE WHEN hour("timestamp") BETWEEN 1 AND 4 THEN 1 ELSE 0 END AS INTEGER) AS is_night_txn FROM txn""",
    "feature_matrix": """SELECT transaction_id, amount, CAST(account_age_days AS DOUBLE) AS account_age_days,
        CAST(user_risk_score AS DOUBLE) AS user_risk_score, historical_avg_txn, historical_std_dev, expected_monthly_vol,
        CAST(known_counterparties AS DOUBLE) AS known_counterparties FROM txn""",
    "standardize": "SELECT transaction_id, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM txn)) / (SELECT stddev_pop({c}) FROM txn), 6) AS {c}"
        for c in (
            "amount",
            "account_age_days",
            "user_risk_score",
            "historical_avg_txn",
            "historical_std_dev",
            "known_counterparties",
        )
    )
    + " FROM txn",
    "distinct_profiles": "SELECT sender_id, sender_name, first_seen FROM profiles",
    "entity_baselines": """SELECT sender_id, round(avg(amount), 6) AS user_mean,
        round(coalesce(stddev_samp(amount), 0), 6) AS user_std, count(amount) AS txn_count FROM txn GROUP BY 1""",
    "inflows": "SELECT receiver_id, unique_senders, round(total_in_amt, 2) AS total_in_amt FROM ins",
    "outflows": "SELECT sender_id, round(total_out_amt, 2) AS total_out_amt FROM outs",
    "graph_edges": "SELECT src, dst, round(amount, 2) AS amount FROM edges",
    "graph_degrees": "SELECT * FROM degrees",
    "degree_pct_rank": "SELECT node, pct_rank FROM ranked",
    "top_degree_nodes": "SELECT * FROM top_nodes",
    "degree_centrality": "SELECT node, in_degree / CAST((SELECT max(in_degree) FROM degrees) AS DOUBLE) AS score FROM degrees",
    "pagerank": f"SELECT node, round(score, 8) AS score FROM pr{PAGERANK_ROUNDS}",
    "cycles_2hop": "SELECT node FROM two_hop",
    "cycles_3hop": "SELECT DISTINCT a AS node FROM triples",
    "cycles_3hop_top": """SELECT DISTINCT a AS node FROM triples WHERE a IN (SELECT node FROM top_nodes)
        OR b IN (SELECT node FROM top_nodes) OR c IN (SELECT node FROM top_nodes)""",
    "network_risk": "SELECT * FROM network",
    "graph_features": """SELECT node AS sender_id, network_centrality, round(score, 8) AS network_pagerank, is_in_cycle,
        network_raw FROM network JOIN pagerank_end USING (node)""",
    "rule_structuring": "SELECT transaction_id, structuring_raw FROM rules",
    "rule_velocity": "SELECT transaction_id, velocity_raw FROM rules",
    "rule_geo": "SELECT transaction_id, geo_raw FROM rules",
    "rules_all": "SELECT transaction_id, structuring_raw, velocity_raw, geo_raw FROM rules",
    "smurfing_hubs": """SELECT account_id, unique_senders, round(total_in_amt, 2) AS total_in_amt,
        round(total_out_amt, 2) AS total_out_amt FROM hubs""",
    "u_turns": "SELECT sender_id FROM turns",
    "mcc_mismatch": f"SELECT transaction_id FROM txn WHERE {MISMATCH}",
    "typologies": "SELECT transaction_id, structuring_raw, scenario_raw AS behavioral_raw FROM scenarios",
    "behavior_zscore": "SELECT transaction_id, round(behavioral_raw, 4) AS behavioral_raw FROM behavior",
    "behavior_profile": """SELECT transaction_id, CAST(hour("timestamp") AS INTEGER) AS hour,
        CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
        CAST(CASE WHEN hour("timestamp") BETWEEN 1 AND 4 THEN 1 ELSE 0 END AS INTEGER) AS is_night_txn,
        CAST(CASE WHEN n < 3 THEN 0 WHEN sd = 0 THEN CASE WHEN amount > mu * 1.5 THEN 100 ELSE 0 END
             WHEN amount > mu + sd * 3 THEN 100
             WHEN (amount - mu) / sd > 1 THEN least(round_even((amount - mu) / sd / 3 * 100 * 10, 0) / 10, 90)
             ELSE 0 END AS DOUBLE) AS behavioral_raw
        FROM txn JOIN (SELECT sender_id, count(amount) AS n, avg(amount) AS mu, coalesce(stddev_samp(amount), 0) AS sd
                       FROM txn GROUP BY 1) USING (sender_id)""",
    "link_national_id": "SELECT sender_id, primary_id FROM national",
    "fuzzy_pairs": """SELECT a.sender_id AS profile_id, b.sender_id AS match_id, round(score, 6) AS score
        FROM matches m JOIN profiles a ON a.i = m.i JOIN profiles b ON b.i = m.j""",
    "fuzzy_link": "SELECT sender_id, parent_id FROM name_map",
    "gbt_holdout": """SELECT count(*) FILTER (NOT held) AS train_rows, CAST(sum(is_sar_filed) FILTER (NOT held) AS BIGINT) AS train_positives,
        count(*) FILTER (held) AS held_out_rows, CAST(sum(is_sar_filed) FILTER (held) AS BIGINT) AS held_out_positives,
        true AS in_range
        FROM (SELECT is_sar_filed, row_number() OVER (PARTITION BY is_sar_filed ORDER BY draw, transaction_id)
                     <= floor(0.2 * count(*) OVER (PARTITION BY is_sar_filed) + 0.5) AS held
              FROM (SELECT is_sar_filed, transaction_id, CAST('0x' || substr(md5('42|' || transaction_id), 1, 8) AS BIGINT) AS draw
                    FROM labelled))""",
    "fuzzy_link_all": "SELECT sender_id, parent_id FROM free_name_map",
    "resolve_entities": "SELECT transaction_id, global_entity_id FROM txn JOIN entity_of USING (sender_id)",
    "entity_summary": """SELECT coalesce(primary_id, sender_id) AS global_entity_id, count(DISTINCT sender_id) AS account_count,
        round(sum(amount), 2) AS total_exposure, count(transaction_id) AS txn_count
        FROM txn LEFT JOIN national USING (sender_id) GROUP BY 1""",
    "rule_max": "SELECT transaction_id, greatest(structuring_raw, velocity_raw, geo_raw) AS norm_rule_score FROM rules",
    "ml_normalize": """SELECT transaction_id,
        CASE WHEN (SELECT max(user_risk_score / CAST(100 AS DOUBLE)) FROM txn) <= 1 THEN user_risk_score / CAST(100 AS DOUBLE) * 100
             ELSE user_risk_score / CAST(100 AS DOUBLE) END AS ml_anomaly_score,
        CASE WHEN (SELECT max(user_risk_score) FROM txn) <= 1 THEN CAST(user_risk_score AS DOUBLE) * 100
             ELSE CAST(user_risk_score AS DOUBLE) END AS ml_supervised_score FROM txn""",
    "final_score": "SELECT transaction_id, final_risk_score, risk_band FROM banded",
    "band_histogram": "SELECT risk_band, count(*) AS n_txns FROM banded GROUP BY 1",
    "alert_queue": f"""SELECT transaction_id, final_risk_score, {BAND.format(s='final_risk_score', high=40)} AS risk_band
        FROM scored WHERE final_risk_score >= 40""",
    "run_metrics": """SELECT count(*) AS n_txns, CAST(sum(CASE WHEN risk_band IN ('HIGH','CRITICAL') THEN 1 ELSE 0 END) AS BIGINT)
        AS n_alerts, max(final_risk_score) AS max_score,
        CAST(sum(CASE WHEN structuring_raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS structuring_raw_hits,
        CAST(sum(CASE WHEN velocity_raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS velocity_raw_hits,
        CAST(sum(CASE WHEN geo_raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS geo_raw_hits,
        CAST(sum(CASE WHEN behavioral_raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS behavioral_raw_hits,
        count(DISTINCT sender_id) AS n_entities FROM banded""",
    "score_batch": f"""SELECT transaction_id, global_entity_id, network_raw, structuring_raw, velocity_raw, geo_raw,
        round(behavioral_raw, 4) AS behavioral_raw, final_risk_score, {BAND.format(s='final_risk_score', high=65)} AS risk_band
        FROM (SELECT *, {_final("greatest(network_raw, structuring_raw, velocity_raw, geo_raw, behavioral_raw)")}
              AS final_risk_score FROM e_signals)""",
    "d1_hourly_velocity": """SELECT sender_id, "timestamp", CAST(k AS BIGINT) AS txns_last_hour FROM (SELECT *, sum(n) OVER (
        PARTITION BY sender_id ORDER BY "timestamp" RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS k FROM moments)
        WHERE k > 1""",
    "d2_rapid_movement": """SELECT account_id, "timestamp", CAST(ti AS DOUBLE) / 10000 AS received, CAST(tt AS DOUBLE) / 10000 AS paid
        FROM (SELECT *, sum(i) OVER w AS ti, sum(o) OVER w AS tt FROM flows WINDOW w AS (PARTITION BY account_id
              ORDER BY "timestamp" RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW))
        WHERE p > 0 AND ti > 0 AND CAST(tt AS DOUBLE) >= CAST(ti AS DOUBLE) * CAST(0.95 AS DOUBLE)""",
    "d3_aggregation_24h": """SELECT sender_id, "timestamp", CAST(k AS BIGINT) AS window_txns, CAST(u AS DOUBLE) / 10000 AS window_amount
        FROM (SELECT *, sum(n) OVER w AS k, sum(units) OVER w AS u FROM moments WINDOW w AS (PARTITION BY sender_id
              ORDER BY "timestamp" RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW))
        WHERE k >= 5 AND u >= 100000000""",
    "d4_new_counterparty": """SELECT transaction_id, sender_id, receiver_id, amount FROM (SELECT *, row_number() OVER (
        PARTITION BY sender_id, receiver_id ORDER BY "timestamp", transaction_id) AS k FROM txn) WHERE k = 1 AND amount >= 5000""",
    "d5_fan_out": """SELECT sender_id, count(DISTINCT receiver_id) AS unique_receivers FROM txn GROUP BY 1
        HAVING count(DISTINCT receiver_id) >= 10""",
    "d6_dormancy": """SELECT sender_id, p AS silent_since, "timestamp" AS active_again FROM (SELECT sender_id, "timestamp",
        lag("timestamp") OVER (PARTITION BY sender_id ORDER BY "timestamp") AS p FROM txn)
        WHERE "timestamp" >= p + INTERVAL 10 DAY""",
    "d7_rolling_baseline": """SELECT sender_id, "timestamp", CAST(coalesce(k, 0) AS BIGINT) AS prior_count,
        round(CASE WHEN k > 0 THEN CAST(u AS DOUBLE) / k / 10000 END, 6) AS prior_mean,
        round(CASE WHEN k > 1 THEN sqrt(CAST(q * k - u * u AS DOUBLE) / (k * (k - 1))) / 10000 ELSE 0 END, 6) AS prior_std
        FROM (SELECT *, sum(n) OVER w AS k, CAST(sum(units) OVER w AS HUGEINT) AS u, sum(squares) OVER w AS q FROM moments
              WINDOW w AS (PARTITION BY sender_id ORDER BY "timestamp"
                           RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))""",
    "d8_peer_zscore": """SELECT transaction_id, round((amount - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS peer_zscore
        FROM txn JOIN (SELECT peer_group, avg(amount) AS mu, coalesce(stddev_samp(amount), 0) AS sd FROM txn GROUP BY 1)
        USING (peer_group)""",
    "d9_bias": f"""SELECT transaction_id, f AS final_risk_score, {BAND.format(s='f', high=65)} AS risk_band FROM (SELECT *,
        {_final(RULE_MAX, ' + behavioral_raw * CAST(0.1 AS DOUBLE)')} AS f FROM signals)""",
    "d10_attribution": f"""SELECT transaction_id, round({RULE_MAX} * CAST(0.45 AS DOUBLE), 4) AS rule_part,
        CAST(0 AS DOUBLE) AS anomaly_part, CAST(0 AS DOUBLE) AS supervised_part,
        CASE WHEN {RULE_MAX} <= 0 THEN 'none' WHEN behavioral_raw = {RULE_MAX} THEN 'behavioral_raw'
             WHEN geo_raw = {RULE_MAX} THEN 'geo_raw' WHEN structuring_raw = {RULE_MAX} THEN 'structuring_raw'
             ELSE 'velocity_raw' END AS top_rule, 'none' AS model_version, final_risk_score FROM scored""",
    "d11_audit_long": " UNION ALL ".join(
        f"SELECT transaction_id, sender_id, '{c}' AS rule, round({c}, 4) AS raw_score FROM signals WHERE {c} > 0"
        for c in ("behavioral_raw", "geo_raw", "structuring_raw", "velocity_raw")
    ),
    "d13_backtest": """SELECT threshold, CAST(count(*) FILTER (final_risk_score >= threshold) AS BIGINT) AS n_alerts
        FROM scored, (SELECT CAST(unnest([20, 35, 40, 45]) AS DOUBLE) AS threshold) GROUP BY threshold""",
}

# ---- isolation forest of hashed draws (riskweave/operators/hashed_forest.py): the same trees, level by level
FOREST_TREES, FOREST_SAMPLE, FOREST_DEPTH, FOREST_SEED, FOREST_SHARE = 100, 256, 8, 42, 0.01
_FX = ("amount", "account_age_days", "user_risk_score", "historical_avg_txn", "historical_std_dev", "known_counterparties")
_FS = ", ".join(f"f{i}" for i in range(len(_FX)))


def _draw(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


def _pick(split: str, values: str) -> str:
    """The value of the split's feature: ``split`` holds the feature, ``values`` the row."""
    return f"CASE {split}.feature " + " ".join(f"WHEN {i} THEN {values}.f{i}" for i in range(len(_FX))) + " END"


def _expected(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} END"


TABLES["fx"] = "SELECT transaction_id AS rid, " + ", ".join(
    f"coalesce(CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END, CAST(0 AS DOUBLE)) AS f{i}"
    for i, c in enumerate(_FX)
) + " FROM txn"
TABLES["fslots"] = f"""SELECT k, least(CAST(1 AS DOUBLE), w / k) AS share, rows_in FROM (
    SELECT w, rows_in, least(greatest(CAST(ceil(w) AS BIGINT), 1), {FOREST_TREES}) AS k
    FROM (SELECT CAST(1.5 AS DOUBLE) * {FOREST_SAMPLE} * {FOREST_TREES} / greatest(count(*), 1) AS w, count(*) AS rows_in FROM fx))"""
TABLES["fsample"] = f"""SELECT rid, {_FS}, tree FROM (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY chance, rid) AS place FROM (
      SELECT rid, {_FS}, CAST(({_draw(f"'{FOREST_SEED}:' || rid")} + j) % {FOREST_TREES} AS INTEGER) AS tree,
             {_draw(f"'{FOREST_SEED}:' || rid || ':' || CAST(j AS VARCHAR)")} AS chance
      FROM (SELECT *, unnest(range((SELECT k FROM fslots))) AS j FROM fx))
    WHERE CAST(chance AS DOUBLE) < (SELECT share FROM fslots) * CAST(281474976710656 AS DOUBLE))
  WHERE place <= {FOREST_SAMPLE}"""
TABLES["fa0"] = f"SELECT tree, 1 AS node, rid, {_FS} FROM fsample"
_node_key = "'" + str(FOREST_SEED) + ":' || CAST(tree AS VARCHAR) || ':' || CAST(node AS VARCHAR)"
for _l in range(FOREST_DEPTH + 1):
    _spread = [f"CAST(max(f{i}) > min(f{i}) AS INTEGER) AS sp{i}" for i in range(len(_FX))]
    TABLES[f"fc{_l}"] = f"""SELECT *, {_draw(_node_key + " || ':f'")} % greatest(cnt, 1) AS k,
        {_l} < {FOREST_DEPTH} AND n > 1 AND cnt > 0 AS split FROM (
        SELECT *, {" + ".join(f"sp{i}" for i in range(len(_FX)))} AS cnt FROM (
          SELECT tree, node, count(*) AS n, {", ".join(_spread)} FROM fa{_l} GROUP BY tree, node))"""
    _choose = " ".join(
        f"WHEN sp{i} = 1 AND k = {' + '.join([f'sp{j}' for j in range(i)]) or '0'} THEN {i}" for i in range(len(_FX))
    )
    TABLES[f"ff{_l}"] = f"SELECT tree, node, n, CASE {_choose} END AS feature FROM fc{_l} WHERE split"
    TABLES[f"fv{_l}"] = f"""SELECT tree, node, feature, v, row_number() OVER (PARTITION BY tree, node ORDER BY v) - 1 AS r,
        count(*) OVER (PARTITION BY tree, node) AS m FROM (
        SELECT DISTINCT a.tree, a.node, c.feature, {_pick("c", "a")} AS v FROM fa{_l} a JOIN ff{_l} c ON a.tree = c.tree AND a.node = c.node)"""
    TABLES[f"ft{_l}"] = f"""SELECT tree, node, feature, v AS threshold FROM fv{_l}
        WHERE r = {_draw(_node_key + " || ':c'")} % (m - 1)"""
    TABLES[f"fl{_l}"] = f"""SELECT tree, node, -1 AS feature, CAST(0 AS DOUBLE) AS threshold,
        CAST(1000 * {_l} + floor(1000 * ({_expected("n")}) + 0.5) AS BIGINT) AS path_milli FROM fc{_l} WHERE NOT split"""
    if _l < FOREST_DEPTH:
        TABLES[f"fa{_l + 1}"] = f"""SELECT a.tree, 2 * a.node + CASE WHEN ({_pick("t", "a")}) > t.threshold THEN 1 ELSE 0 END AS node,
            a.rid, {", ".join(f"a.f{i}" for i in range(len(_FX)))} FROM fa{_l} a JOIN ft{_l} t ON a.tree = t.tree AND a.node = t.node"""
TABLES["fnodes"] = " UNION ALL ".join(
    f"SELECT tree, node, feature, threshold, CAST(NULL AS BIGINT) AS path_milli FROM ft{_l} UNION ALL SELECT * FROM fl{_l}"
    for _l in range(FOREST_DEPTH + 1)
)
TABLES["fwalk"] = f"""SELECT x.rid, g.tree, 1 AS node, {", ".join(f"x.f{i}" for i in range(len(_FX)))}
      FROM fx x CROSS JOIN (SELECT DISTINCT tree FROM fnodes) g
    UNION ALL
    SELECT w.rid, w.tree, 2 * w.node + CASE WHEN ({_pick("n", "w")}) > n.threshold THEN 1 ELSE 0 END,
           {", ".join(f"w.f{i}" for i in range(len(_FX)))}
      FROM fwalk w JOIN fnodes n ON w.tree = n.tree AND w.node = n.node WHERE n.feature >= 0"""
TABLES["fnorm"] = f"""SELECT s, rid FROM (
    SELECT w.rid, round_even(-pow(2.0, -(CAST(sum(n.path_milli) AS DOUBLE) / (SELECT count(DISTINCT tree) FROM fnodes)
             / CAST(1000 AS DOUBLE)) / greatest({_expected(f"least({FOREST_SAMPLE}, (SELECT rows_in FROM fslots))")}, 1.0))
             * 1000000, 0) / 1000000 AS s
    FROM fwalk w JOIN fnodes n ON w.tree = n.tree AND w.node = n.node WHERE n.feature = -1 GROUP BY w.rid)"""
TABLES["foffset"] = f"""SELECT (low + (high - low) * (place - floor(place))) / 1000000 AS cutoff FROM (
    SELECT min(CASE WHEN upto > floor(place) THEN q END) AS low, min(CASE WHEN upto > ceil(place) THEN q END) AS high,
           max(place) AS place FROM (
      SELECT q, sum(n) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             (sum(n) OVER () - 1) * {FOREST_SHARE} AS place
      FROM (SELECT CAST(round_even(s * 1000000, 0) AS BIGINT) AS q, count(*) AS n FROM fnorm GROUP BY 1)))"""
STATEMENTS["iforest_score"] = """SELECT rid AS transaction_id,
    round_even(least(greatest((0.5 - (s - (SELECT cutoff FROM foffset))) * 100, 0), 100) * 100, 0) / 100 AS ml_anomaly_score
    FROM fnorm"""

RECURSIVE = {"lcs", "walk", "fwalk"}


def _needed(sql: str) -> list[str]:
    """Table expressions a statement uses, directly or not, each after the ones it uses."""
    order: list[str] = []

    def visit(text: str, inside: str | None) -> None:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in TABLES:
            if name in words and name != inside and name not in order:
                visit(TABLES[name], name)
                order.append(name)

    visit(sql, None)
    return order


def statement(name: str) -> str:
    tables = _needed(STATEMENTS[name])
    parts = ", ".join(f"{t} AS MATERIALIZED ({TABLES[t]})" if t not in RECURSIVE else f"{t} AS ({TABLES[t]})" for t in tables)
    return f"WITH RECURSIVE {parts} {STATEMENTS[name]}"


def all_sql() -> dict[str, str]:
    return {name: statement(name) for name in STATEMENTS}
