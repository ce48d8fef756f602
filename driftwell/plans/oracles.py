"""SQL for DuckDB that returns the rows of each query, written from the definitions and not from the DataFrame code."""

from __future__ import annotations

import hashlib

_EVENTS = """s AS (SELECT event_id AS seq, ts, region || '-D' || user_id AS sensor_id, region, reading, confidence FROM (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'R3' WHEN 'purchase' THEN 'R2' WHEN 'view' THEN 'R4' WHEN 'signup' THEN 'R1' ELSE 'R5' END AS region, user_id,
        CASE WHEN event_id % 33 <> 0 THEN value END AS reading, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 100.0 AS confidence FROM events))"""
_PREPARED = """
r AS (SELECT *, COALESCE(reading, CASE region WHEN 'R3' THEN 151.0 WHEN 'R2' THEN 95.0 ELSE 50.0 END::DOUBLE) AS reading_hat,
        CASE region WHEN 'R2' THEN 1.2 WHEN 'R3' THEN 1.3 ELSE 1.0 END::DOUBLE AS risk FROM s),
p AS (SELECT *, CAST(floor(reading_hat / 5.0) AS BIGINT) AS bucket, reading_hat * confidence * risk AS score FROM r),
h AS (SELECT region, bucket, CAST(count(*) AS BIGINT) AS f FROM p GROUP BY ALL),
dev AS (SELECT * FROM p WHERE reading_hat > 145 AND confidence >= 0.6),
sus AS (SELECT * FROM p WHERE confidence <= 0.5 AND reading_hat >= 145)"""
_W = f"WITH RECURSIVE {_EVENTS}, {_PREPARED}"
_TOTALS = """tot AS (SELECT region, CAST(COALESCE(sum(f) FILTER (bucket BETWEEN 0 AND 40), 0) AS BIGINT) AS cms_total, CAST(COALESCE(sum(f) FILTER (bucket BETWEEN 0 AND 40 AND bucket * 5.0 >= 145), 0) AS BIGINT) AS cms_abnormal FROM h WHERE region IN ('R2','R3','R4') GROUP BY 1)"""
_HEAVY = """hv AS (SELECT region, COALESCE(string_agg(CAST(bucket AS VARCHAR), ',' ORDER BY bucket) FILTER (f / t >= 0.05), '') AS heavy_buckets, count(*) FILTER (f / t >= 0.05) / 41.0 AS heavy_bucket_ratio
        FROM (SELECT *, sum(f) OVER (PARTITION BY region) AS t FROM h WHERE bucket BETWEEN 0 AND 40 AND region IN ('R2','R3','R4')) GROUP BY 1)"""


def _u(key: str) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) / 4503599627370496.0)"


def _open_u(key: str) -> str:
    return f"((CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _gauss(key: str) -> str:
    a, b = _open_u(f"{key} || '|a'"), _open_u(f"{key} || '|b'")
    return f"(sqrt(-2.0 * ln({a})) * cos(2.0 * pi() * {b}))"


def _wilson(z: float, k: str = "cms_abnormal", n: str = "cms_total") -> tuple[str, str, str]:
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    scale, p = f"(1 + {z * z} / {n})", f"({k} / {n})"
    centre, half = f"({p} + {z * z} / (2 * {n}))", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4 * {n} * {n})))"
    case = lambda x: f"CASE WHEN {n} > 0 THEN {x} ELSE 0.0 END"
    return case(p), case(f"greatest(0.0, ({centre} - {half}) / {scale})"), case(f"least(1.0, ({centre} + {half}) / {scale})")


def _rounded_wilson(z: float, digits: int = 10) -> str:
    return ", ".join(f"round({x}, {digits}) AS {name}" for x, name in zip(_wilson(z), ("p_hat", "ci_low", "ci_high")))


_KEYED = f"keyed AS (SELECT *, ln({_open_u("'0|reservoir|' || seq")}) / score AS key FROM p WHERE score > 0)"
_SAMPLE = f"{_KEYED}, sample AS (SELECT * FROM keyed ORDER BY key DESC, seq LIMIT 50000)"
_PER_REGION = f"{_KEYED}, sample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY key DESC, seq) AS place FROM keyed) WHERE place <= 50)"
_EXPECT = "ex AS (SELECT region, count(*) AS n, CASE WHEN sum(score) > 0 THEN COALESCE(sum(score) FILTER (reading_hat >= 145), 0) / sum(score) ELSE 0.0 END AS p FROM sample GROUP BY 1)"
_BOOT = f"""rep AS (SELECT region, n, b, sum(CASE WHEN {_u("'2024|' || region || '|' || b || '|' || i")} <= p THEN 1 ELSE 0 END) / n AS share FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM ex), generate_series(1, 500) AS g(b) GROUP BY 1, 2, 3),
boot AS (SELECT region, n, avg(share) AS p_hat, quantile_cont(share, 0.025) AS ci_low, quantile_cont(share, 0.975) AS ci_high FROM rep GROUP BY 1, 2)"""


def _ams(sketches: int) -> str:
    sign = "1 - 2 * (CAST('0x' || substr(md5('2026:' || j || ':' || region || ':' || bucket), 32, 1) AS BIGINT) % 2)"
    return f"z AS (SELECT region, CAST(j AS INTEGER) AS j, CAST(sum(({sign}) * f) AS BIGINT) AS z FROM h, generate_series(0, {sketches - 1}) AS g(j) GROUP BY 1, 2)"


_MOM = f"{_ams(256)}, mm AS (SELECT region, least(j // 32, 7) AS g, avg(CAST(z * z AS DOUBLE)) AS m FROM z GROUP BY 1, 2), mom AS (SELECT region, median(m) AS ams_f2 FROM mm GROUP BY 1)"
_CMS = "ca AS (SELECT region, bucket, f, i, CAST('0x' || substr(md5('cms|' || i || '|' || region || '|' || bucket), 1, 13) AS BIGINT) % 2719 AS col FROM h, generate_series(0, 4) AS g(i)), cell AS (SELECT i, col, sum(f) AS cnt FROM ca GROUP BY 1, 2)"
_H1 = "CAST('0x' || substr(x, 13, 4) AS BIGINT) % 8192"
_H2 = "CAST('0x' || substr(x, 29, 4) AS BIGINT) % 8192"
_POS = f"item AS (SELECT DISTINCT sensor_id FROM sus), hx AS (SELECT sensor_id, sha256(from_hex('3905000000000000') || encode('/' || sensor_id)) AS x FROM item), pos AS (SELECT sensor_id, CAST(i AS INTEGER) AS i, ({_H1} + i * ({_H2})) % 8192 AS pos FROM hx, generate_series(0, 3) AS g(i))"


def _planes(tables: int, bits: int, dims: int) -> str:
    return f"pl AS (SELECT t, b, d, {_gauss("'42|' || t || '|' || b || '|' || d")} AS w FROM generate_series(0, {tables - 1}) AS a(t), generate_series(0, {bits - 1}) AS c(b), generate_series(0, {dims - 1}) AS e(d))"


_SIGNED = f"""{_planes(5, 16, 4)}, fv AS (SELECT seq, sensor_id, reading_hat, confidence, unnest([0, 1, 2, 3]) AS d, unnest([reading_hat, confidence, risk, 0.0::DOUBLE]) AS x FROM p),
bit AS (SELECT seq, t, b, CASE WHEN sum(x * w) >= 0 THEN '1' ELSE '0' END AS bit FROM fv JOIN pl USING (d) GROUP BY 1, 2, 3),
sg AS (SELECT seq, CAST(t AS INTEGER) AS table_idx, string_agg(bit, '' ORDER BY b) AS signature FROM bit GROUP BY 1, 2)"""
_REGIONS = "reg AS (SELECT unnest(['R2', 'R3', 'R4']) AS region)"
_STATS = f"{_TOTALS}, {_HEAVY}, {_REGIONS}, st AS (SELECT reg.region, COALESCE(cms_total, 0) AS cms_total, COALESCE(cms_abnormal, 0) AS cms_abnormal, COALESCE(heavy_buckets, '') AS heavy_buckets, COALESCE(heavy_bucket_ratio, 0.0) AS heavy_bucket_ratio FROM reg LEFT JOIN tot USING (region) LEFT JOIN hv USING (region))"
_DEV = "(SELECT count(DISTINCT sensor_id) FROM dev)"
_WINDOW = f"""{_W}, {_STATS}, {_MOM} SELECT st.region, {_rounded_wilson(1.959964)}, round(heavy_bucket_ratio, 10) AS heavy_bucket_ratio, heavy_buckets, cms_total, cms_abnormal, {_DEV} AS hll_estimate, COALESCE(ams_f2, 0.0) AS ams_f2 FROM st LEFT JOIN mom USING (region)"""
_P, _L, _H = _wilson(1.959964)
_FUSED = f"""{_STATS}, {_SAMPLE}, {_EXPECT}, {_BOOT}, {_POS},
sat AS (SELECT count(DISTINCT pos) / 8192.0 AS sat FROM pos),
fu AS (SELECT st.region, COALESCE(n, 0) AS sample_size, CASE WHEN COALESCE(n, 0) >= 30 THEN boot.p_hat ELSE {_P} END AS p_hat, CASE WHEN COALESCE(n, 0) >= 30 THEN boot.ci_low ELSE {_L} END AS ci_low, CASE WHEN COALESCE(n, 0) >= 30 THEN boot.ci_high ELSE {_H} END AS ci_high,
  sat AS sbf_saturation, cms_total, cms_abnormal, heavy_buckets, heavy_bucket_ratio, {_DEV} AS hll_estimate FROM st LEFT JOIN boot USING (region), sat),
ev AS (SELECT *, 0.4 * p_hat + 0.25 * CASE WHEN cms_total > 0 THEN cms_abnormal / cms_total ELSE 0.0 END + 0.2 * least(1.0, hll_estimate / greatest(1, cms_total)) + 0.15 * sbf_saturation AS evidence_score,
  CASE WHEN heavy_buckets = '' THEN 0 ELSE len(string_split(heavy_buckets, ',')) END AS n_heavy FROM fu)"""


def _tumbling(width: str) -> str:
    return f"""hw AS (SELECT CAST(epoch(time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, region, bucket, count(*) AS f FROM p WHERE region IN ('R2','R3','R4') GROUP BY 1, 2, 3),
tw AS (SELECT start, region, CAST(COALESCE(sum(f) FILTER (bucket BETWEEN 0 AND 40), 0) AS BIGINT) AS cms_total, CAST(COALESCE(sum(f) FILTER (bucket BETWEEN 0 AND 40 AND bucket * 5.0 >= 145), 0) AS BIGINT) AS cms_abnormal FROM hw GROUP BY 1, 2)"""


_HOURLY = f"{_W}, {_tumbling('1 hour')} SELECT start, region, cms_total, cms_abnormal, {_rounded_wilson(1.959964)} FROM tw"
_GEN = lambda purpose: _u(f"'2026|' || region || '|' || i || '|{purpose}'")
_Z = _gauss("'2026|' || region || '|' || i || '|normal'")
_SPECS = "(VALUES ('R2', 300, 0.25, 100.0::DOUBLE, 15.0::DOUBLE, [28, 29], 0.15), ('R3', 400, 0.70, 115.0, 12.0, [30], 0.40), ('R4', 250, 0.05, 80.0, 10.0, []::INTEGER[], 0.0)) AS v(region, n, anomaly_rate, normal_mean, normal_std, heavy, heavy_share)"
_SYNTHETIC = f"""WITH g AS (SELECT *, {_GEN('anomaly')} < anomaly_rate AS an FROM (SELECT v.*, CAST(unnest(generate_series(0, n - 1)) AS INTEGER) AS i FROM {_SPECS})),
q AS (SELECT *, CASE WHEN an THEN CASE WHEN {_GEN('confident')} < 0.7 THEN 0.7 + {_GEN('conf')} * 0.25 ELSE 0.1 + {_GEN('conf')} * 0.45 END ELSE 0.6 + {_GEN('conf')} * 0.37 END AS conf, {_GEN('low')} < 0.1 AS forced, {_GEN('missing')} < 0.03 AS gone, {_GEN('corrupted')} < 0.02 AS bad,
  CASE WHEN len(heavy) > 0 AND {_GEN('heavy')} < CASE WHEN an THEN heavy_share ELSE 0.2 * heavy_share END THEN heavy[CAST(floor({_GEN('pick')} * len(heavy)) AS INTEGER) + 1] * 5.0 + {_GEN('inside')} * 5.0 + ({_GEN('jitter')} - 0.5)
       WHEN an THEN 145.0 + abs(5.0 + 8.0 * {_Z}) ELSE normal_mean + normal_std * {_Z} END AS x FROM g)
SELECT i, region, region || '-D' || CAST(CAST(floor({_GEN('device')} * 300) AS BIGINT) + 1 AS VARCHAR) AS sensor_id,
  round(CASE WHEN gone THEN NULL WHEN bad THEN CASE WHEN {_GEN('spoilt')} >= 0.5 THEN {_GEN('garbage')} * 188.5 END ELSE greatest(0.0, least(290.0, x)) END, 6) AS reading,
  round(CASE WHEN forced THEN least(conf, 0.05 + {_GEN('lowered')} * 0.35) ELSE conf END, 6) AS confidence,
  CASE WHEN forced THEN 'forced_low_conf' ELSE '' END || CASE WHEN gone THEN '|missing' WHEN bad THEN '|corrupted' ELSE '' END AS note FROM q"""
_WHOLE = f"""{_STATS}, {_MOM}, all_t AS (SELECT region, CAST(sum(f) AS BIGINT) AS cms_total, CAST(COALESCE(sum(f) FILTER (bucket * 5.0 >= 145), 0) AS BIGINT) AS cms_abnormal, CAST(sum(f * f) AS BIGINT) AS exact_f2 FROM h WHERE region IN ('R2','R3','R4') GROUP BY 1),
hw AS (SELECT region, count(*) FILTER (f / t >= 0.05) / 41.0 AS hr FROM (SELECT *, sum(f) OVER (PARTITION BY region) AS t FROM h) WHERE bucket BETWEEN 0 AND 40 GROUP BY 1),
a AS (SELECT region, COALESCE(hr, 0.0) AS hr, cms_total, cms_abnormal, exact_f2, {_P} AS p, {_L} AS l, {_H} AS u FROM all_t LEFT JOIN hw USING (region)), o AS (SELECT st.region, heavy_bucket_ratio AS hr2, cms_total AS t, cms_abnormal AS x, {_P} AS p2, {_L} AS l2, {_H} AS u2, ams_f2 FROM st LEFT JOIN mom USING (region))"""

_SYNTHETIC_W = f"WITH RECURSIVE syn AS ({_SYNTHETIC.replace('round(CASE', '(CASE').replace('END, 6)', 'END)')}), s AS (SELECT i + 1000 * CAST(substr(region, 2, 1) AS BIGINT) AS seq, sensor_id, region, reading, confidence FROM syn), {_PREPARED}"
_SEVERE = "sv AS (SELECT *, CASE WHEN evidence_score >= 0.75 THEN 'critical' WHEN evidence_score >= 0.60 THEN 'high' WHEN evidence_score >= 0.45 THEN 'medium' END AS severity FROM ev)"
_HIT = "(ci_low >= 0.05 OR (p_hat >= 0.08 AND n_heavy >= 1) OR (evidence_score >= 0.45 AND hll_estimate >= 5))"
_REASON = "concat_ws('；', CASE WHEN ci_low >= 0.05 THEN printf('CI下界 %.3f≥0.050', ci_low) END, CASE WHEN p_hat >= 0.08 THEN printf('比例 p̂=%.3f≥0.080', p_hat) END, CASE WHEN n_heavy >= 1 THEN '重频桶 ' || n_heavy || ' 个' END, CASE WHEN hll_estimate >= 5 THEN 'HLL异常设备数 ' || hll_estimate || '≥5' END, CASE WHEN evidence_score >= 0.45 THEN printf('综合分数 %.3f≥0.450', evidence_score) END)"
_WEEK = "CAST(epoch(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01')) AS BIGINT)"


def _blake_signs() -> str:
    """A letter for each sketch's sign, + or -, for each region and bucket that readings below 750 can fall into."""
    sign = lambda j, r, b: "+-"[hashlib.blake2s(f"2026:{j}:{r}:{b}".encode(), digest_size=8).digest()[-1] & 1]
    return ", ".join(f"('{r}', {b}, '{''.join(sign(j, r, b) for j in range(256))}')" for r in ("R1", "R2", "R3", "R4", "R5") for b in range(150))


ORACLE_SQL: dict[str, str] = {
    "impute": f"{_W} SELECT seq, region, sensor_id, reading, reading_hat, confidence FROM p",
    "bucketize": f"{_W} SELECT seq, bucket FROM p",
    "bucketize_tenth": "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 1000 / 0.5) AS BIGINT) AS bucket FROM lineitem",
    "risk_score": f"{_W} SELECT seq, risk, round(score, 6) AS score FROM p",
    "features_a": f"{_W} SELECT seq, printf('%.4f,%.4f,%.4f,%.4f', reading_hat, confidence, 0.0::DOUBLE, risk) AS features FROM p",
    "features_b": f"{_W} SELECT seq, printf('%.4f,%.4f,%.4f,%.4f', reading_hat, confidence, risk, 0.0::DOUBLE) AS features FROM p",
    "anomaly_predicates": f"{_W} SELECT seq, bucket * 5.0 >= 145 AS by_bucket, reading_hat > 145 AND confidence >= 0.6 AS by_device, reading_hat >= 145 AS by_sample, reading_hat >= 145 AND confidence >= 0.5 AS by_sample_confident FROM p",
    "suspects": f"{_W} SELECT seq, sensor_id, reading_hat, confidence FROM sus",
    "histogram": f"{_W} SELECT * FROM h",
    "histogram_lineitem": "SELECT CASE l_returnflag WHEN 'A' THEN 'R2' WHEN 'N' THEN 'R3' ELSE 'R4' END AS region, CAST(floor(l_extendedprice / 500 / 5.0) AS BIGINT) AS bucket, count(*) AS f FROM lineitem GROUP BY 1, 2",
    "region_totals": f"{_W}, {_TOTALS} SELECT * FROM tot",
    "zero_regions": f"{_W}, {_TOTALS} SELECT region, COALESCE(cms_total, 0) AS cms_total, COALESCE(cms_abnormal, 0) AS cms_abnormal FROM (SELECT unnest(['R2','R3','R4','R9']) AS region) LEFT JOIN tot USING (region)",
    "heavy_buckets": f"{_W}, {_HEAVY} SELECT * FROM hv",
    "wilson_05": f"{_W}, {_TOTALS} SELECT region, {_rounded_wilson(1.959964)} FROM tot",
    "wilson_10": f"{_W}, {_TOTALS} SELECT region, {_rounded_wilson(1.644854)} FROM tot",
    "wilson_goldens": "SELECT * FROM (VALUES ('R2', 0.22::DOUBLE, 0.17682744565907954::DOUBLE, 0.2702526183369473::DOUBLE), ('R3', 0.6975::DOUBLE, 0.6507820074415556::DOUBLE, 0.7404606362376861::DOUBLE), ('R4', 0.052::DOUBLE, 0.030637655038217734::DOUBLE, 0.08692178152037365::DOUBLE), ('none', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE)) AS v(region, p_hat, ci_low, ci_high)",
    "distinct_global": f"{_W} SELECT count(DISTINCT sensor_id) AS hll_estimate FROM dev",
    "distinct_grouping_sets": f"{_W} SELECT COALESCE(region, 'all') AS region, count(DISTINCT sensor_id) AS n FROM dev GROUP BY GROUPING SETS ((region), ())",
    "hll_flag": f"{_W} SELECT count(DISTINCT sensor_id) AS hll_estimate, true AS within FROM dev",
    "cms_standard": f"{_W}, {_CMS} SELECT region, bucket, f, CAST(min(cnt) AS BIGINT) AS estimate FROM ca JOIN cell USING (i, col) GROUP BY 1, 2, 3",
    "cms_conservative_flag": f"{_W} SELECT region, bucket, f, true AS within FROM h",
    "cms_builtin": "SELECT true AS made",
    "ams_z": f"{_W}, {_ams(256)} SELECT * FROM z",
    "ams_mom": f"{_W}, {_MOM} SELECT * FROM mom",
    "ams_mean": f"{_W}, {_ams(5)} SELECT region, avg(CAST(z * z AS DOUBLE)) AS ams_f2 FROM z GROUP BY 1",
    "f2_exact": f"{_W} SELECT region, CAST(sum(f * f) AS BIGINT) AS exact_f2 FROM h GROUP BY 1",
    "lsh_signatures": f"{_W}, {_SIGNED} SELECT * FROM sg",
    "lsh_embeddings": f"WITH {_planes(5, 16, 64)}, fv AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), bit AS (SELECT vec_id, t, b, CASE WHEN sum(x * w) >= 0 THEN '1' ELSE '0' END AS bit FROM fv JOIN pl USING (d) GROUP BY 1, 2, 3) SELECT vec_id, CAST(t AS INTEGER) AS table_idx, string_agg(bit, '' ORDER BY b) AS signature FROM bit GROUP BY 1, 2",
    "lsh_candidates": f"{_W}, {_SIGNED}, met AS (SELECT a.seq AS probe, b.seq, min(b.table_idx) AS t FROM sg a JOIN sg b USING (table_idx, signature) WHERE a.seq % 50 = 0 GROUP BY 1, 2) SELECT probe, seq, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY t, seq) AS place FROM met) WHERE place <= 100",
    "lsh_bucket_stats": f"{_W}, {_SIGNED} SELECT table_idx, signature, size, round(mr, 6) AS mean_reading, round(mc, 6) AS mean_confidence, example AS example_ids FROM (SELECT table_idx, signature, count(*) AS size, avg(reading_hat) AS mr, avg(confidence) AS mc, arg_min(sensor_id, seq) AS example, min(seq) AS first FROM sg JOIN p USING (seq) GROUP BY 1, 2) WHERE size >= 3 ORDER BY size DESC, table_idx, first LIMIT 10",
    "reservoir_global": f"{_W}, {_SAMPLE} SELECT seq, round(key, 9) AS key FROM sample",
    "reservoir_by_region": f"{_W}, {_PER_REGION} SELECT region, seq, CAST(place AS INTEGER) AS place FROM sample",
    "weighted_choice": f"{_W}, {_PER_REGION}, cum AS (SELECT region, seq, sum(score) OVER w / sum(score) OVER (PARTITION BY region) AS upto, lead(seq) OVER (PARTITION BY region ORDER BY place) IS NULL AS last FROM sample WINDOW w AS (PARTITION BY region ORDER BY place)), lim AS (SELECT *, COALESCE(lag(upto) OVER (PARTITION BY region ORDER BY upto), -1.0) AS lo FROM cum), dr AS (SELECT region, CAST(d AS INTEGER) AS draw, {_u("'2024|choice|' || region || '|' || d")} AS u FROM (SELECT DISTINCT region FROM sample), generate_series(1, 20) AS g(d)) SELECT dr.region, draw, seq FROM dr JOIN lim ON dr.region = lim.region AND u > lo AND (u <= upto OR last)",
    "bootstrap_expectation": f"{_W}, {_SAMPLE}, {_EXPECT} SELECT region, n, round(p, 9) AS p FROM ex",
    "bootstrap_ci": f"{_W}, {_SAMPLE}, {_EXPECT}, {_BOOT} SELECT region, n, round(p_hat, 9) AS p_hat, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM boot",
    "sbf_positions": f"{_W}, {_POS} SELECT * FROM pos",
    "sbf_semi": f"{_W} SELECT seq, sensor_id FROM p WHERE sensor_id IN (SELECT sensor_id FROM sus)",
    "sbf_anti": f"{_W} SELECT seq, sensor_id FROM p WHERE sensor_id NOT IN (SELECT sensor_id FROM sus)",
    "sbf_flag": f"{_W} SELECT DISTINCT sensor_id, true AS found FROM sus",
    "sbf_saturation": f"{_W}, {_POS} SELECT count(DISTINCT pos) / 8192.0::DOUBLE AS sbf_saturation FROM pos",
    "window_stats": _WINDOW,
    "window_stats_lsh": f"{_W}, {_STATS}, {_ams(5)}, m5 AS (SELECT region, avg(CAST(z * z AS DOUBLE)) AS ams_f2 FROM z GROUP BY 1), {_SIGNED}, big AS (SELECT table_idx, signature, count(*) AS size, arg_min(sensor_id, seq) AS example, min(seq) AS first FROM sg JOIN p USING (seq) GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY size DESC, table_idx, first LIMIT 10) SELECT st.region, {_rounded_wilson(1.959964)}, round(heavy_bucket_ratio, 10) AS heavy_bucket_ratio, heavy_buckets, cms_total, cms_abnormal, {_DEV} AS hll_estimate, COALESCE(ams_f2, 0.0) AS ams_f2, (SELECT string_agg(table_idx || ':' || signature || ':' || size || ':' || example, ';' ORDER BY size DESC, table_idx, first) FROM big) AS lsh_big_buckets FROM st LEFT JOIN m5 USING (region)",
    "evidence_fusion": f"{_W}, {_FUSED} SELECT region, sample_size, round(p_hat, 9) AS p_hat, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(sbf_saturation, 9) AS sbf_saturation, round(evidence_score, 9) AS evidence_score, cms_total, cms_abnormal, hll_estimate FROM ev",
    "alerts": f"""{_SYNTHETIC_W}, {_FUSED}, {_SEVERE}
      SELECT region, 'w' AS window_id, severity, round(evidence_score, 9) AS score, {_REASON} AS reason, round(p_hat, 9) AS p_hat, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(heavy_bucket_ratio, 9) AS heavy_bucket_ratio, round(sbf_saturation, 9) AS sbf_saturation, cms_total, cms_abnormal, hll_estimate, heavy_buckets,
      '{{"min_cms_total":200,"min_sample_size_for_alert":30,"min_ci_lower":0.05,"min_p_hat":0.08,"min_evidence_score":0.45,"min_heavy_buckets":1,"min_hll_estimate":5,"severity_thresholds":{{"critical":0.75,"high":0.6,"medium":0.45}}}}' AS thresholds, 1700000000.0::DOUBLE AS timestamp FROM sv WHERE severity IS NOT NULL AND {_HIT}""",
    "alerts_after_alerts": f"""{_SYNTHETIC_W}, {_FUSED}, {_SEVERE} SELECT region, COALESCE(CASE WHEN severity <> 'medium' THEN severity END, 'medium') AS severity FROM sv WHERE region <> 'R3' AND {_HIT}""",
    "alerts_cooldown": f"""{_W}, {_tumbling('1 hour')}, hot AS MATERIALIZED (SELECT region, start AS ts_seconds FROM tw WHERE cms_total > 0 AND cms_abnormal / cms_total >= 0.08),
      k AS (SELECT region, min(ts_seconds) AS ts_seconds FROM hot GROUP BY 1 UNION ALL SELECT region, nxt FROM (SELECT k.region, (SELECT min(hot.ts_seconds) FROM hot WHERE hot.region = k.region AND hot.ts_seconds >= k.ts_seconds + 21600) AS nxt FROM k) WHERE nxt IS NOT NULL) SELECT region, ts_seconds FROM k""",
    "window_stats_tumbling": _HOURLY,
    "landmark_stats": f"""{_W}, {_tumbling('1 day')}, fs AS (SELECT sensor_id, min(CAST(epoch(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')) AS BIGINT)) AS start FROM dev GROUP BY 1)
      SELECT start, region, CAST(sum(cms_total) OVER w AS BIGINT) AS cms_total, CAST(sum(cms_abnormal) OVER w AS BIGINT) AS cms_abnormal, (SELECT count(*) FROM fs WHERE fs.start <= tw.start) AS devices FROM tw WINDOW w AS (PARTITION BY region ORDER BY start)""",
    "latest_stats": f"{_W}, {_tumbling('1 day')} SELECT region, start, cms_total, cms_abnormal FROM tw QUALIFY row_number() OVER (PARTITION BY region ORDER BY start DESC) = 1",
    "compare_report": f"""{_W}, {_WHOLE} SELECT a.region, cms_total, cms_abnormal, exact_f2, cms_total - t AS cms_total_diff, cms_abnormal - x AS cms_abnormal_diff, round(p - p2, 10) AS p_hat_diff, round(l - l2, 10) AS ci_low_diff, round(u - u2, 10) AS ci_high_diff, CAST(0 AS BIGINT) AS hll_estimate_diff, round(hr - hr2, 10) AS heavy_bucket_ratio_diff, 0.0::DOUBLE AS hll_rel_err, abs(hr - hr2) <= 1e-9 AS heavy_ratio_ok, t AS reported_total, round(p2, 10) AS reported_p_hat, {_DEV} AS reported_devices, round(abs(exact_f2 - ams_f2) / exact_f2, 10) AS ams_f2_rel_err,
      cms_total = t AND cms_abnormal = x AS counts_ok, abs(p - p2) <= 1e-9 AS p_hat_ok, abs(l - l2) <= 1e-6 AND abs(u - u2) <= 1e-6 AS ci_ok, abs(exact_f2 - ams_f2) / exact_f2 <= 0.15 AS ams_f2_ok, true AS hll_ok FROM a JOIN o USING (region)""",
    "synthetic_stream": _SYNTHETIC,
    "region_specs": f"SELECT region, n, CAST(anomaly_rate AS DOUBLE) AS anomaly_rate, normal_mean, normal_std, array_to_string(heavy, ',') AS heavy_buckets, CAST(heavy_share AS DOUBLE) AS heavy_share FROM {_SPECS}",
    "sink_jsonl": _WINDOW,
    "sink_csv": f"SELECT 'window_id,region,p_hat,ci_low,ci_high,sample_size,cms_total,cms_abnormal,heavy_bucket_ratio,hll_estimate,sbf_saturation,evidence_score,heavy_buckets,ams_f2' AS header, 'w' AS window_id, * REPLACE ('[' || replace(heavy_buckets, ',', ', ') || ']' AS heavy_buckets, round(ams_f2, 10) AS ams_f2), '' AS sample_size, '' AS sbf_saturation, '' AS evidence_score FROM ({_WINDOW})",
    "sensor_json_roundtrip": f"{_W} SELECT seq, sensor_id, region, reading, confidence FROM p",
    "stream_equals_batch": _HOURLY,
    "ams_blake": f"{_W}, sg(region, bucket, signs) AS (VALUES {_blake_signs()}), z AS (SELECT region, j, CAST(sum(CASE WHEN substr(signs, CAST(j AS INTEGER) + 1, 1) = '+' THEN f ELSE -f END) AS BIGINT) AS z FROM h JOIN sg USING (region, bucket), generate_series(0, 255) AS g(j) GROUP BY 1, 2), mm AS (SELECT region, least(j // 32, 7) AS g, avg(CAST(z * z AS DOUBLE)) AS m FROM z GROUP BY 1, 2) SELECT region, median(m) AS ams_f2 FROM mm GROUP BY 1",
    "sbf_stream": f"{_W} SELECT region, seq, sensor_id, true AS filled FROM sus",
    "cooldown_stream": f"""{_W}, hot AS MATERIALIZED (SELECT region, epoch(ts) AS ts_seconds FROM dev),
      k AS (SELECT region, min(ts_seconds) AS ts_seconds FROM hot GROUP BY 1 UNION ALL SELECT region, nxt FROM (SELECT k.region, (SELECT min(hot.ts_seconds) FROM hot WHERE hot.region = k.region AND hot.ts_seconds >= k.ts_seconds + 21600) AS nxt FROM k) WHERE nxt IS NOT NULL) SELECT region, ts_seconds FROM k""",
    "sliding_stream": f"{_W}, e AS (SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01')) AS BIGINT) - 3600 * CAST(unnest([0, 1]) AS BIGINT) AS start, region, bucket FROM p) SELECT start, region, bucket, count(*) AS f FROM e GROUP BY ALL",
    "session_stream": f"{_W}, e AS (SELECT sensor_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY sensor_id ORDER BY ts) <= INTERVAL '2 days' THEN 0 ELSE 1 END AS new FROM dev), g AS (SELECT *, sum(new) OVER (PARTITION BY sensor_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT sensor_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM g GROUP BY sensor_id, s",
    "device_sketch_stream": f"{_W} SELECT {_WEEK} AS start, count(DISTINCT sensor_id) AS n, true AS within FROM dev GROUP BY 1",
    "ams_by_window": f"{_W}, hw AS (SELECT {_WEEK} AS start, region, bucket, count(*) AS f FROM p GROUP BY ALL), z AS (SELECT start, region, j, CAST(sum((1 - 2 * (CAST('0x' || substr(md5('2026:' || j || ':' || region || ':' || bucket), 32, 1) AS BIGINT) % 2)) * f) AS BIGINT) AS z FROM hw, generate_series(0, 255) AS g(j) GROUP BY 1, 2, 3), mm AS (SELECT start, region, least(j // 32, 7) AS g, avg(CAST(z * z AS DOUBLE)) AS m FROM z GROUP BY 1, 2, 3) SELECT start, region, median(m) AS ams_f2 FROM mm GROUP BY 1, 2",
    "row_counter": "SELECT count(*) AS window_count FROM events",
}
