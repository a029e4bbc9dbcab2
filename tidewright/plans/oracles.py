"""DuckDB forms of the registered queries, written against the tables and not against the Spark plans."""

from __future__ import annotations


def r(x: str, name: str | None = None, digits: int = 7) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


STEP = "21600"
#: Steps of the build on the stand-in series; each reads the ones before it.
CHAIN = {
    "raw": """SELECT user_id AS caseid, epoch_us(ts) // 1000000 AS t, event_id, event_type, value AS mbp,
        min(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id) AS t0 FROM events""",
    "cells": f"""SELECT caseid, any_value(t0) AS t0, (t - t0) // {STEP} AS pos, arg_max(mbp, t * 10000000 + event_id) AS mbp
        FROM raw GROUP BY caseid, (t - t0) // {STEP}""",
    "ends": "SELECT caseid, any_value(t0) AS t0, max(pos) AS last FROM cells GROUP BY caseid",
    "grid": f"""SELECT e.caseid, g.pos, e.t0 + g.pos * {STEP} AS t, c.mbp
        FROM ends e, LATERAL (SELECT unnest(generate_series(0, e.last)) AS pos) g
        LEFT JOIN cells c ON c.caseid = e.caseid AND c.pos = g.pos""",
    "masked": "SELECT caseid, pos, t, CASE WHEN mbp BETWEEN 5 AND 150 THEN mbp END AS mbp FROM grid",
    "bounds": "SELECT caseid, min(pos) AS a, max(pos) AS b FROM masked WHERE mbp IS NOT NULL GROUP BY caseid",
    "trimmed": "SELECT caseid, pos - a AS pos, t, mbp FROM masked JOIN bounds USING (caseid) WHERE pos BETWEEN a AND b",
    "smooth": """SELECT caseid, pos, t, avg(mbp) OVER (PARTITION BY caseid ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mbp
        FROM trimmed""",
    "filled": """SELECT s.caseid, s.pos, s.t, coalesce(s.mbp, a.mbp + (b.mbp - a.mbp) * (s.pos - a.pos) / (b.pos - a.pos), a.mbp, 0) AS mbp
        FROM smooth s
        ASOF LEFT JOIN (SELECT * FROM smooth WHERE mbp IS NOT NULL) a ON s.caseid = a.caseid AND s.pos >= a.pos
        ASOF LEFT JOIN (SELECT * FROM smooth WHERE mbp IS NOT NULL) b ON s.caseid = b.caseid AND s.pos <= b.pos""",
    "runs": """SELECT *, coalesce(max(mbp) OVER (PARTITION BY caseid ORDER BY pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) < 45, false)::int AS low_run,
        count(*) OVER (PARTITION BY caseid) AS n FROM filled""",
    "lab": """SELECT *, CASE WHEN pos <= n - 2 THEN max(low_run) OVER (PARTITION BY caseid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)
        ELSE 0 END AS label FROM runs""",
    "edges": "SELECT *, label = 1 AND lag(label) OVER (PARTITION BY caseid ORDER BY pos) = 0 AS begins FROM lab",
    "num": """SELECT *, CASE WHEN label = 1 THEN coalesce(sum(begins::int) OVER (PARTITION BY caseid ORDER BY pos), 0)::int END AS event_no FROM edges""",
    "starts": "SELECT caseid, pos, t FROM num WHERE pos < n - 13",
    "seg": """SELECT s.caseid, s.pos, max(x.label) FILTER (x.pos BETWEEN s.pos + 9 AND s.pos + 12) AS seg_label,
        min(x.pos) FILTER (x.label = 1 AND x.pos BETWEEN s.pos + 9 AND s.pos + 12) AS first_pos,
        min(x.event_no) FILTER (x.label = 1 AND x.pos BETWEEN s.pos + 9 AND s.pos + 12) AS seg_event_no,
        max(x.t) FILTER (x.pos = s.pos + 7) AS time, max(x.mbp) FILTER (x.pos = s.pos + 7) AS last_map_value,
        coalesce(max(x.label) FILTER (x.pos BETWEEN s.pos AND s.pos + 8), 0) AS before,
        coalesce(max(x.label) FILTER (x.pos BETWEEN s.pos - 2 AND s.pos - 1), 0) AS recent,
        min(x.mbp) FILTER (x.pos >= s.pos) AS lowest, max(x.mbp) FILTER (x.pos >= s.pos) AS highest
        FROM starts s JOIN num x ON x.caseid = s.caseid AND x.pos BETWEEN s.pos - 2 AND s.pos + 12 GROUP BY s.caseid, s.pos""",
    "valid": "SELECT *, (first_pos - pos - 7) * 21600 AS time_before_event FROM seg WHERE before = 0 AND recent = 0 AND lowest >= 5 AND highest <= 150",
    "ols": "SELECT s.caseid, s.pos, "
    + ", ".join(
        f"{f} AS mbp_{kind}_{sec}"
        for h, sec in ((2, 43200), (4, 86400), (8, 172800))
        for kind, f in (
            ("constant", f"regr_intercept(x.mbp, x.pos - s.pos - 8) FILTER (x.pos >= s.pos + {8 - h})"),
            ("slope", f"regr_slope(x.mbp, x.pos - s.pos - 8) FILTER (x.pos >= s.pos + {8 - h})"),
            (
                "std",
                f"sqrt(greatest(0, regr_syy(x.mbp, x.pos) FILTER (x.pos >= s.pos + {8 - h}) - (regr_sxy(x.mbp, x.pos) FILTER (x.pos >= s.pos + {8 - h})) ** 2"
                f" / regr_sxx(x.mbp, x.pos) FILTER (x.pos >= s.pos + {8 - h})) / {h - 1})",
            ),
        )
    )
    + " FROM starts s JOIN num x ON x.caseid = s.caseid AND x.pos BETWEEN s.pos AND s.pos + 7 GROUP BY s.caseid, s.pos",
    "stats": "SELECT caseid, count(*) AS segment_count, sum(seg_label)::bigint AS label_count FROM valid GROUP BY caseid",
    "split": """SELECT *, CASE WHEN row_number() OVER (ORDER BY caseid) <= floor(0.7 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM stats""",
}


def chain(select: str, last: str) -> str:
    """A query over the steps up to last."""
    names = list(CHAIN)
    steps = ",\n".join(f"{k} AS ({CHAIN[k]})" for k in names[: names.index(last) + 1])
    return f"WITH {steps}\n{select}"


FEATURES = [f"mbp_{kind}_{sec}" for sec in (43200, 86400, 172800) for kind in ("constant", "slope", "std")]
_FEATURES = ", ".join(r(x, digits=4 if "_std_" in x else 7) for x in FEATURES)

SCORES = """s AS (SELECT event_id, (event_type = 'error')::int AS y, floor(value) / 500.0::double AS score, user_id AS label_id FROM events)"""


def curve(rows: str = "s", by: str = "") -> str:
    """Steps c (per score) and k (the curve) from rows(y, score, label_id)."""
    comma, part = (f"{by},", f"PARTITION BY {by}") if by else ("", "")
    using = f"({by}, score)" if by else "(score)"
    return f"""g AS (SELECT {comma} score, sum(y) AS tp, sum(1 - y) AS fp FROM {rows} GROUP BY {comma} score),
    f AS (SELECT {comma} score, count(*) AS hits FROM (SELECT {comma} label_id, max(score) AS score FROM {rows} WHERE y = 1 GROUP BY {comma} label_id) GROUP BY {comma} score),
    c AS (SELECT {comma} score, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, sum(coalesce(hits, 0)) OVER w AS hits FROM g LEFT JOIN f USING {using}
          WINDOW w AS ({part} ORDER BY score DESC)),
    z AS (SELECT *, max(tp) OVER ({part}) AS n_pos, max(fp) OVER ({part}) AS n_neg, max(hits) OVER ({part}) AS n_events FROM c),
    k AS (SELECT {comma} score AS threshold, tp::double / (tp + fp) AS precision, tp::double / n_pos AS recall, hits::double / n_events AS event_recall,
          fp::double / n_neg AS fpr, n_neg, n_events FROM z)"""


def areas(by: str = "") -> str:
    """Step a: the areas of step k."""
    comma, part, group = (f"{by},", f"PARTITION BY {by}", f"GROUP BY {by}") if by else ("", "", "")
    return f"""l AS (SELECT *, coalesce(lag(recall) OVER v, 0) AS r0, coalesce(lag(fpr) OVER v, 0) AS f0, coalesce(lag(event_recall) OVER v, 0) AS e0,
          coalesce(lag(precision) OVER v, 1) AS p0 FROM k WINDOW v AS ({part} ORDER BY threshold DESC)),
    a AS (SELECT {comma} sum((recall - r0) * precision) AS average_precision, sum((fpr - f0) * (recall + r0) / 2) AS auroc,
          sum((event_recall - e0) * (precision + p0) / 2) AS auprc FROM l {group})"""


_CURVE = f"WITH {SCORES}, {curve()}"
_AREAS = f"{_CURVE}, {areas()}"


def _pick(order: str, where: str = "") -> str:
    return f"""{_CURVE} SELECT {r('threshold', digits=6)}, {r('precision', digits=6)}, {r('event_recall', digits=6)}
    FROM k {where} ORDER BY {order}, threshold DESC LIMIT 1"""


_BOOT = f"""WITH {SCORES}, numbered AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS row_no FROM s),
    size AS (SELECT count(*) AS n FROM numbered),
    d AS (SELECT b.b AS boot_id, ('0x' || substr(md5(b.b::varchar || ':' || i.i::varchar), 1, 8))::bigint % n AS row_no
          FROM size, range(20) b(b), range((SELECT n FROM size)) i(i)),
    q AS (SELECT boot_id, y, score, label_id FROM d JOIN numbered USING (row_no)),
    ok AS (SELECT * FROM q WHERE boot_id IN (SELECT boot_id FROM q GROUP BY boot_id HAVING min(y) < max(y))),
    {curve('ok', 'boot_id')}, {areas('boot_id')}"""



def _replicated(replicates: int, order: str, where: str = "") -> str:
    """Steps up to e: all metrics of replicates in which each row has a Poisson number of copies, at the point first in order."""
    cuts = (24109, 48219, 60273, 64291, 65296, 65497, 65531, 65535)
    copies = " + ".join(f"(u >= {x})::int" for x in cuts)
    return f"""WITH {SCORES}, u AS (SELECT b.b AS boot_id, y, score, label_id,
      ('0x' || substr(md5(event_id::varchar || ':' || (b.b // 8)::varchar), (1 + 4 * (b.b % 8))::int, 4))::int AS u FROM s, range({replicates}) b(b)),
    q AS (SELECT boot_id, y, score, label_id, unnest(range({copies})) FROM u),
    ok AS (SELECT * FROM q WHERE boot_id IN (SELECT boot_id FROM q GROUP BY boot_id HAVING min(y) < max(y))),
    {curve('ok', 'boot_id')}, {areas('boot_id')},
    t AS (SELECT * FROM k {where} QUALIFY row_number() OVER (PARTITION BY boot_id ORDER BY {order}, threshold DESC) = 1),
    v AS (SELECT *, n_events::double / (n_events + n_neg) AS v, event_recall AS r FROM t),
    w AS (SELECT *, 1 - (r * v * (1 - precision) / precision) / (1 - v) AS specificity FROM v),
    e AS (SELECT a.boot_id, auroc, average_precision, auprc, threshold, precision, event_recall, specificity,
      specificity * (1 - v) / (specificity * (1 - v) + (1 - r) * v) AS npv, 2 * precision * r / (precision + r) AS f1 FROM a LEFT JOIN w USING (boot_id))"""



def _lead_gain() -> str:
    cuts = (24109, 48219, 60273, 64291, 65296, 65497, 65531, 65535)
    copies = " + ".join(f"(u >= {x})::int" for x in cuts)
    by = "lead, name, boot_id"
    return f"""{chain('', 'ols')},
    scored AS (SELECT v.caseid::varchar || ':' || v.time::varchar AS segment, seg_label AS y, seg_event_no::varchar || '_' || v.caseid::varchar AS label_id, time_before_event,
      1 - floor(last_map_value) / 128.0::double AS last, 1 - floor(last_map_value + mbp_slope_86400) / 128.0::double AS trend
      FROM valid v JOIN ols USING (caseid, pos)),
    named AS (SELECT segment, y, label_id, time_before_event, 'baseline' AS name, last AS score FROM scored
      UNION ALL SELECT segment, y, label_id, time_before_event, 'model', coalesce(trend, last) FROM scored),
    led AS (SELECT * FROM named, (VALUES (43200), (86400)) l(lead) WHERE time_before_event IS NULL OR time_before_event >= lead),
    u AS (SELECT *, ('0x' || substr(md5(segment || ':' || (b.b // 8)::varchar), (1 + 4 * (b.b % 8))::int, 4))::int AS u, b.b AS boot_id FROM led, range(20) b(b)),
    q AS (SELECT {by}, y, score, label_id, unnest(range({copies})) FROM u),
    ok AS (SELECT * FROM q WHERE ({by}) IN (SELECT ({by}) FROM q GROUP BY {by} HAVING min(y) < max(y))),
    {curve('ok', by)}, {areas(by)},
    m AS (SELECT lead, name, avg(auprc) AS mean, stddev_pop(auprc) AS sd FROM a GROUP BY lead, name)
    SELECT b.lead::bigint AS lead, {r('b.mean', 'baseline_mean', 4)}, {r('b.sd', 'baseline_sd', 4)}, {r('o.mean', 'model_mean', 4)}, {r('o.sd', 'model_sd', 4)},
      {r('100 * (o.mean - b.mean) / nullif(b.mean, 0)', 'gain_percent', 4)} FROM m b JOIN m o ON b.lead = o.lead AND b.name = 'baseline' AND o.name = 'model'"""


METRICS = ("auroc", "average_precision", "auprc", "threshold", "precision", "event_recall", "specificity", "npv", "f1")
_SPREAD = (("mean", "avg"), ("sd", "stddev_pop"), ("median", "median"))

SQL: dict[str, str] = {
    "bucket_first_nonnull": chain(
        """SELECT caseid, round_even(t / 3600.0::double, 0)::bigint AS second,
        arg_min(mbp, t * 10000000 + event_id) FILTER (event_type = 'view') AS "view",
        arg_min(mbp, t * 10000000 + event_id) FILTER (event_type = 'signup') AS signup FROM raw GROUP BY 1, 2""",
        "raw",
    ),
    "tracks_long_to_wide": chain(
        "SELECT caseid, t, event_id, "
        + ", ".join(f"CASE WHEN event_type = '{x}' THEN mbp END AS track_{x}" for x in ("view", "signup", "click", "error", "purchase"))
        + " FROM raw",
        "raw",
    ),
    "union_by_name_sparse": chain(
        """SELECT caseid, t, mbp AS "view", NULL::double AS signup, NULL::double AS click FROM raw WHERE event_type = 'view'
        UNION ALL SELECT caseid, t, NULL, mbp, NULL FROM raw WHERE event_type = 'signup'
        UNION ALL SELECT caseid, t, NULL, NULL, mbp FROM raw WHERE event_type = 'click'""",
        "raw",
    ),
    "resample_last": chain("SELECT caseid, pos, t, mbp FROM grid", "grid"),
    "resample_median_right": chain(
        f"""SELECT e.caseid, g.pos, e.t0 + g.pos * {STEP} AS t, {r('m.mbp', 'mbp')}
        FROM (SELECT caseid, min(t0) AS t0, max(ceil((t - t0) / {STEP}.0)::bigint) AS last FROM raw GROUP BY caseid) e,
             LATERAL (SELECT unnest(generate_series(0, e.last)) AS pos) g
        LEFT JOIN (SELECT caseid, ceil((t - t0) / {STEP}.0)::bigint AS pos, median(mbp) AS mbp FROM raw GROUP BY 1, 2) m
          ON m.caseid = e.caseid AND m.pos = g.pos""",
        "raw",
    ),
    "stride_decimate": chain("SELECT caseid, pos, t, mbp FROM grid WHERE pos % 5 = 0", "grid"),
    "time_slice": chain("SELECT caseid, t - t0 - 86400 AS t, event_id, mbp FROM raw WHERE t - t0 BETWEEN 86400 AND 864000", "raw"),
    "mask_range": "SELECT event_id, CASE WHEN value BETWEEN 5 AND 150 THEN value END AS mbp FROM events",
    "trim_edges": chain("SELECT caseid, pos, t, mbp FROM trimmed", "trimmed"),
    "rolling_before_resample": f"""WITH every AS ({CHAIN['raw']}),
        raw AS (SELECT * REPLACE (avg(mbp) OVER (PARTITION BY caseid ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mbp) FROM every),
        cells AS ({CHAIN['cells']}), ends AS ({CHAIN['ends']}), grid AS ({CHAIN['grid']}) SELECT caseid, pos, t, {r('mbp')} FROM grid""",
    "first_of_each_name": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    "key_batches": "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS batch FROM customer",
    "rolling_mean": chain(f"SELECT caseid, pos, {r('mbp')} FROM smooth", "smooth"),
    "interpolate_linear": chain(
        f"""SELECT s.caseid, s.pos, {r('coalesce(s.mbp, a.mbp + (b.mbp - a.mbp) * (s.pos - a.pos) / (b.pos - a.pos))', 'mbp')} FROM trimmed s
        ASOF LEFT JOIN (SELECT * FROM trimmed WHERE mbp IS NOT NULL) a ON s.caseid = a.caseid AND s.pos >= a.pos
        ASOF LEFT JOIN (SELECT * FROM trimmed WHERE mbp IS NOT NULL) b ON s.caseid = b.caseid AND s.pos <= b.pos""",
        "trimmed",
    ),
    "fill_zero": chain("SELECT caseid, pos, t, coalesce(mbp, 0) AS mbp FROM grid", "grid"),
    "preprocess_chain": chain(f"SELECT caseid, pos, t, {r('mbp')} FROM filled", "filled"),
    "peak_reject_centered": chain(
        """SELECT caseid, pos, CASE WHEN abs(mbp - avg(mbp) OVER (PARTITION BY caseid ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) <= 40 THEN mbp END AS mbp
        FROM trimmed""",
        "trimmed",
    ),
    "ewm_mean_std": chain(
        f"""SELECT caseid, pos, {r('wv / w', 'mbp_ewm_mean')},
          {r('sqrt(greatest(0, (wvv / w - (wv / w) ** 2) * w * w / nullif(w * w - ww, 0)))', 'mbp_ewm_std')}
        FROM (SELECT s.caseid, s.pos, sum(g) AS w, sum(g * g) AS ww, sum(g * v) AS wv, sum(g * v * v) AS wvv
          FROM trimmed s LEFT JOIN (SELECT caseid, pos AS p, mbp AS v FROM trimmed WHERE mbp IS NOT NULL) x
            ON x.caseid = s.caseid AND x.p BETWEEN s.pos - 15 AND s.pos, LATERAL (SELECT 0.5::double ** ((s.pos - p) / 4.0::double) AS g)
          GROUP BY s.caseid, s.pos)""",
        "trimmed",
    ),
    "label_raw": chain("SELECT caseid, pos, low_run FROM runs", "runs"),
    "label_dilated": chain("SELECT caseid, pos, label FROM lab", "lab"),
    "event_ids": chain("SELECT caseid, pos, coalesce(event_no, -1) AS event_no, event_no || '_' || caseid AS label_id FROM num", "num"),
    "event_summary": chain(
        f"SELECT caseid, event_no, min(t) AS begins, max(t) AS ends, count(*) AS n_rows, {r('min(mbp)', 'lowest')} FROM num WHERE label = 1 GROUP BY 1, 2",
        "num",
    ),
    "segment_windows": chain("SELECT caseid, pos, t FROM starts", "starts"),
    "segment_validity": chain(
        "SELECT caseid, pos, lowest >= 5 AND highest <= 150 AS in_bounds, before = 0 AS no_event_before, recent = 0 AS recovered, true AS enough_data FROM seg",
        "seg",
    ),
    "segment_validity_unfilled": chain(
        """SELECT s.caseid, s.pos, true AS in_bounds, count(*) - count(x.mbp) <= 0.2 * 13 AS enough_data
        FROM (SELECT caseid, pos FROM (SELECT *, count(*) OVER (PARTITION BY caseid) AS n FROM trimmed) WHERE pos < n - 13) s
        JOIN trimmed x ON x.caseid = s.caseid AND x.pos BETWEEN s.pos AND s.pos + 12 GROUP BY 1, 2""",
        "trimmed",
    ),
    "segment_labels": chain("SELECT caseid, pos, seg_label FROM seg", "seg"),
    "time_before_event": chain(
        "SELECT caseid, pos, time, (first_pos - pos - 7) * 21600 AS time_before_event, seg_event_no FROM seg WHERE seg_label = 1", "seg"
    ),
    "ols_features": chain(f"SELECT caseid, pos, {_FEATURES} FROM ols", "ols"),
    "last_value": chain(f"SELECT caseid, pos, {r('last_map_value')} FROM seg", "seg"),
    "raw_signal_flatten": chain(
        "SELECT v.caseid, v.time, v.seg_label AS label, "
        + ", ".join(r(f"max(x.mbp) FILTER (x.pos = v.pos + {k})", f"mbp_{k}") for k in range(8))
        + " FROM valid v JOIN num x ON x.caseid = v.caseid AND x.pos BETWEEN v.pos AND v.pos + 7 GROUP BY v.caseid, v.pos, v.time, v.seg_label",
        "valid",
    ),
    "segments_features": chain(
        f"SELECT caseid, time, seg_label AS label, coalesce(time_before_event, -1) AS time_before_event, coalesce(seg_event_no, -1) AS event_no, {r('last_map_value')}, {_FEATURES} FROM valid JOIN ols USING (caseid, pos)",
        "ols",
    ),
    "lead_time_filter": chain(
        "SELECT caseid, time, seg_label AS label, coalesce(time_before_event, -1) AS time_before_event FROM valid WHERE time_before_event IS NULL OR time_before_event >= 64800", "valid"
    ),
    "single_case": chain(f"SELECT caseid, pos, t, {r('mbp')}, label, coalesce(event_no, -1) AS event_no FROM num WHERE caseid = 3", "num"),
    "cohort_filter": """SELECT o_orderkey AS caseid, c_mktsegment AS opname, o_custkey % 90 AS age FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_custkey % 90 > 18 AND o_totalprice > 3600 AND c_mktsegment <> 'MACHINERY' AND o_orderstatus <> 'P' AND (c_acctbal / 10 < 400 OR c_acctbal <= 0)""",
    "semi_join_cases": "SELECT event_id, user_id AS caseid FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "anti_join_cases": "SELECT event_id, user_id AS caseid FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "join_segments_static": chain(
        "SELECT caseid, time, seg_label AS label, c_mktsegment, c_acctbal FROM valid JOIN customer ON caseid = c_custkey", "valid"
    ),
    "key_sets_agree": """SELECT (SELECT count(DISTINCT user_id) FROM events) AS n_left, (SELECT count(DISTINCT c_custkey) FROM customer) AS n_right,
        (SELECT count(DISTINCT user_id) FROM events WHERE user_id IN (SELECT c_custkey FROM customer)) AS n_both""",
    "null_count_filter": "SELECT user_id AS caseid, "
    + ", ".join(f"max(value) FILTER (event_type = '{x}') AS \"{x}\"" for x in ("view", "signup", "click", "error", "purchase"))
    + """ FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'signup') > 0
        AND count(*) FILTER (event_type = 'click') > 0""",
    "in_list_and_prefix": """SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, p_partkey || '_' || p_size AS name_id FROM part
        WHERE p_type IN ('ECONOMY', 'SMALL') AND p_name NOT ILIKE '%ring%'""",
    "case_label_stats": chain("SELECT * FROM stats", "stats"),
    "split_70_30": chain("SELECT caseid, split FROM split", "split"),
    "split_shuffled": chain(
        """SELECT caseid, CASE WHEN row_number() OVER (ORDER BY md5('42:' || caseid), caseid) <= floor(0.7 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
        FROM stats""",
        "stats",
    ),
    "split_ratios": chain(
        f"""SELECT split, count(*) AS n_cases, sum(segment_count)::bigint AS segments, {r('sum(label_count) / sum(segment_count)::double', 'label_ratio')},
        {r('sum(segment_count)::double / (SELECT sum(segment_count) FROM split)', 'segment_ratio')} FROM split GROUP BY split""",
        "split",
    ),
    "split_balanced": chain(
        """, t AS (SELECT s.*, seed::int AS seed, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || caseid), caseid) <= floor(0.7 * count(*) OVER (PARTITION BY seed)) AS train
             FROM stats s, range(1, 51) q(seed)),
        c AS (SELECT seed, abs(sum(segment_count) FILTER (train)::double / sum(segment_count) - 0.7) AS a,
               abs(sum(label_count) FILTER (train)::double / sum(segment_count) FILTER (train) - sum(label_count) FILTER (NOT train)::double / sum(segment_count) FILTER (NOT train)) AS b
             FROM t GROUP BY seed),
        stop AS (SELECT min(seed) AS s FROM c WHERE a / 1e-9 < 1 OR b / 1e-9 < 1),
        best AS (SELECT seed FROM c, stop WHERE s IS NULL OR seed <= s ORDER BY a / 1e-9 + b / 1e-9, seed LIMIT 1)
        SELECT caseid, seed, CASE WHEN train THEN 'train' ELSE 'test' END AS split FROM t JOIN best USING (seed)""",
        "stats",
    ),
    "cv_folds": chain(
        """, p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('7:' || caseid), caseid) - 1 AS place, count(*) OVER (PARTITION BY split) AS n FROM split)
        SELECT caseid, split, CASE WHEN split = 'test' THEN 'test' ELSE 'cv_' || CASE WHEN place < (n % 3) * (n // 3 + 1) THEN place // (n // 3 + 1)
          ELSE n % 3 + (place - (n % 3) * (n // 3 + 1)) // greatest(n // 3, 1) END END AS cv_split FROM p""",
        "split",
    ),
    "fold_search": chain(
        """, t AS (SELECT caseid, segment_count, label_count, seed::int AS seed,
               row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || caseid), caseid) - 1 AS place, count(*) OVER (PARTITION BY seed) AS n
             FROM split, range(1, 21) q(seed) WHERE split = 'train'),
        f AS (SELECT *, (CASE WHEN place < (n % 3) * (n // 3 + 1) THEN place // (n // 3 + 1)
               ELSE n % 3 + (place - (n % 3) * (n // 3 + 1)) // greatest(n // 3, 1) END)::int AS fold FROM t),
        g AS (SELECT seed, fold, sum(segment_count)::double AS s, sum(label_count)::double AS l FROM f GROUP BY seed, fold),
        h AS (SELECT seed, abs(s / sum(s) OVER (PARTITION BY seed) - 1.0::double / 3) / 0.01 AS a,
               abs(l / s - sum(l) OVER (PARTITION BY seed) / sum(s) OVER (PARTITION BY seed)) / 0.005 AS b FROM g),
        c AS (SELECT seed, round(sum(a) + sum(b), 9) AS cost, max(a) < 1 OR max(b) < 1 AS meets FROM h GROUP BY seed),
        stop AS (SELECT min(seed) AS s FROM c WHERE meets),
        best AS (SELECT seed FROM c, stop WHERE s IS NULL OR seed <= s ORDER BY cost, seed LIMIT 1)
        SELECT caseid, seed, fold FROM f JOIN best USING (seed)""",
        "split",
    ),
    "pr_event_curve": f"{_CURVE} SELECT {r('threshold', digits=6)}, {r('precision', digits=6)}, {r('event_recall', digits=6)} FROM k",
    "roc_curve": f"{_CURVE} SELECT {r('threshold', digits=6)}, {r('fpr', digits=6)}, {r('recall', digits=6)} FROM k",
    "average_precision": f"{_AREAS} SELECT {r('average_precision', digits=6)} FROM a",
    "auroc": f"{_AREAS} SELECT {r('auroc', digits=6)} FROM a",
    "auprc_event": f"{_AREAS} SELECT {r('auprc', digits=6)} FROM a",
    "threshold_max_precision": _pick("precision DESC", "WHERE event_recall > 0.02"),
    "threshold_target_recall": _pick("abs(event_recall - 0.5)"),
    "threshold_target_precision": _pick("abs(precision - 0.25)"),
    "threshold_fixed": _pick("abs(threshold - 0.1)"),
    "derived_specificity_npv_f1": f"""{_CURVE}, p AS (SELECT *, n_events::double / (n_events + n_neg) AS v, event_recall AS r FROM k ORDER BY abs(event_recall - 0.5), threshold DESC LIMIT 1),
        q AS (SELECT *, 1 - (r * v * (1 - precision) / precision) / (1 - v) AS sp FROM p)
        SELECT {r('v', 'prevalence', 6)}, {r('sp', 'specificity', 6)}, {r('sp * (1 - v) / (sp * (1 - v) + (1 - r) * v)', 'npv', 6)},
          {r('2 * precision * r / (precision + r)', 'f1', 6)} FROM q""",
    "score_at_baseline_recall": f"""WITH {SCORES.replace('s AS', 'm AS', 1)}, s AS (SELECT y, (label_id % 97) / 97.0::double AS score, label_id FROM m), {curve()},
        b AS (SELECT event_recall AS v FROM k WHERE event_recall > 0.02 ORDER BY precision DESC, threshold DESC LIMIT 1),
        j AS (SELECT score, (SELECT count(*) FROM m WHERE score >= u.score) AS n, (SELECT sum(y) FROM m WHERE score >= u.score) AS tp,
          (SELECT count(DISTINCT label_id) FROM m WHERE y = 1 AND score >= u.score) AS hits FROM (SELECT DISTINCT score FROM m) u),
        e AS (SELECT score AS threshold, tp::double / n AS precision, hits::double / max(hits) OVER () AS event_recall FROM j)
        SELECT {r('v', 'baseline_recall', 6)}, {r('threshold', digits=6)}, {r('precision', digits=6)}, {r('event_recall', digits=6)}
        FROM e, b ORDER BY abs(event_recall - v), threshold DESC LIMIT 1""",
    "thresholds_of_curves": f"WITH {SCORES} SELECT DISTINCT {r('score', 'threshold', 6)} FROM s",
    "curve_interp_grid": f"""{_CURVE}, knots AS (SELECT fpr AS x, max(recall) AS y FROM k GROUP BY fpr), steps AS (SELECT i::int AS step, i / 100.0::double AS x FROM range(101) t(i))
        SELECT step, {r('coalesce(a.y + (b.y - a.y) * (s.x - a.x) / nullif(b.x - a.x, 0), a.y, b.y)', 'tpr', 5)}
        FROM steps s ASOF LEFT JOIN knots a ON s.x >= a.x ASOF LEFT JOIN knots b ON s.x <= b.x""",
    "ece": f"""WITH {SCORES}, b AS (SELECT abs(score - 0.5) + 0.5 AS c, ((score > 0.5)::int = y)::int AS ok FROM s),
        g AS (SELECT ceil(c * 5) AS bin, avg(c) AS c, avg(ok) AS ok, count(*) AS n FROM b GROUP BY 1) SELECT {r('sum(abs(c - ok) * n) / sum(n)', 'ece', 6)} FROM g""",
    "calibration_curve": f"""WITH {SCORES} SELECT greatest(ceil(score * 10), 1)::int AS bin, {r('avg(score)', 'mean_score', 6)}, {r('avg(y)', 'positive_share', 6)},
        count(*) AS n FROM s GROUP BY 1""",
    "score_to_value": "SELECT value FROM events ORDER BY abs((1 - value / 120) - 0.6), event_id LIMIT 1",
    "score_to_value_curve": f"""WITH {SCORES}, m AS (SELECT 1 - floor(value) / 128.0::double AS score, min(event_id) AS id, arg_min(value, event_id) AS value FROM events GROUP BY 1),
        p AS (SELECT DISTINCT score AS threshold FROM s),
        j AS (SELECT threshold, a.score AS sa, a.id AS ia, a.value AS va, b.score AS sb, b.id AS ib, b.value AS vb FROM p
          ASOF LEFT JOIN m a ON threshold >= a.score ASOF LEFT JOIN m b ON threshold <= b.score)
        SELECT {r('threshold', digits=6)}, {r('CASE WHEN sb IS NULL OR threshold - sa < sb - threshold OR (threshold - sa = sb - threshold AND ia <= ib) THEN va ELSE vb END', 'nearest_value', 6)} FROM j""",
    "curve_thinned": f"""{_CURVE}, w AS (SELECT *, abs(precision - lag(precision) OVER (ORDER BY threshold DESC)) AS w,
          (('0x' || substr(md5('0:' || round(threshold * 1e9)::bigint::varchar), 1, 12))::bigint + 0.5::double) / 281474976710656::double AS u FROM k),
        x AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN w > 0 THEN -ln(u) / w ELSE 'infinity'::double END, threshold DESC) AS place,
          max(threshold) OVER () AS high, min(threshold) OVER () AS low FROM w),
        y AS (SELECT * FROM x WHERE place <= 20 OR threshold IN (high, low))
        SELECT {r('threshold', digits=6)}, {r('precision', digits=6)}, {r('event_recall', digits=6)},
          {r('lag(precision) OVER (ORDER BY threshold DESC)', 'above_precision', 6)} FROM y""",
    "bootstrap_auc": f"{_BOOT} SELECT boot_id, {r('average_precision', digits=6)}, {r('auroc', digits=6)}, {r('auprc', digits=6)} FROM a",
    "bootstrap_spread": f"{_BOOT} SELECT {r('avg(auroc)', 'auroc_mean', 5)}, {r('stddev_pop(auroc)', 'auroc_sd', 5)}, {r('median(auroc)', 'auroc_median', 5)} FROM a",
    "bootstrap_metrics": f"""{_replicated(20, 'precision DESC', 'WHERE event_recall > 0.02')}
        SELECT boot_id, {', '.join(r(c, digits=6) for c in METRICS)} FROM e""",
    "bootstrap_metrics_at_recall": f"""{_replicated(200, 'abs(event_recall - 0.5)')}
        SELECT {', '.join(r(f'{f}({c})', f'{c}_{name}', 5) for c in METRICS for name, f in _SPREAD)} FROM e""",
    "lead_time_gain": _lead_gain(),
    "pr_bands": f"""{_BOOT}, knots AS (SELECT boot_id, event_recall AS x, max(precision) AS y FROM k GROUP BY 1, 2),
        places AS (SELECT boot_id, i::int AS step, i / 100.0::double AS x FROM (SELECT DISTINCT boot_id FROM knots), range(101) t(i)),
        at_place AS (SELECT p.step, coalesce(a.y + (b.y - a.y) * (p.x - a.x) / nullif(b.x - a.x, 0), a.y, b.y) AS y FROM places p
          ASOF LEFT JOIN knots a ON p.boot_id = a.boot_id AND p.x >= a.x ASOF LEFT JOIN knots b ON p.boot_id = b.boot_id AND p.x <= b.x)
        SELECT step, {r('avg(y)', 'mean', 5)}, {r('avg(y) - 2 * stddev_pop(y)', 'low', 5)}, {r('avg(y) + 2 * stddev_pop(y)', 'high', 5)} FROM at_place GROUP BY step""",
    "lead_time_study": chain(
        f""", s AS (SELECT lead_seconds::int AS lead_seconds, seg_label AS y, 1 - round(last_map_value, 3) / 120 AS score, seg_event_no || '_' || caseid AS label_id
          FROM valid, (VALUES (43200), (64800), (86400), (108000)) q(lead_seconds) WHERE time_before_event IS NULL OR time_before_event >= lead_seconds),
        {curve('s', 'lead_seconds')}, {areas('lead_seconds')} SELECT lead_seconds, {r('auprc', digits=5)} FROM a""",
        "valid",
    ),
    "describe_numeric": "WITH u AS ("
    + " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS \"column\", {c} AS v FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount"))
    + f""") SELECT l_returnflag, "column", count(v) AS n, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'sd')}, {r('min(v)', 'min')}, {r('quantile_cont(v, 0.25)', 'p25')},
        {r('quantile_cont(v, 0.5)', 'p50')}, {r('quantile_cont(v, 0.75)', 'p75')}, {r('max(v)', 'max')} FROM u GROUP BY 1, 2""",
    "duration_quantiles": chain(
        f"""SELECT {r('quantile_cont(e, 0.25)', 'q1')}, {r('quantile_cont(e, 0.5)', 'median')}, {r('quantile_cont(e, 0.75)', 'q3')}
        FROM (SELECT caseid, max(t - t0)::double AS e FROM raw GROUP BY caseid)""",
        "raw",
    ),
    "value_counts": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "histogram_density": f"""SELECT least(floor(value / 5.0::double), 29)::int AS bin, count(*) AS n,
        {r('count(*) / (5.0::double * sum(count(*)) OVER ())', 'density', 6)} FROM events WHERE value BETWEEN 0 AND 150 GROUP BY 1""",
    "shared_bounds": "SELECT min(value) AS low, max(value) AS high FROM events WHERE event_type IN ('error', 'click')",
    "prevalence_by_split": chain(
        f"SELECT split, count(*) AS n, sum(seg_label)::bigint AS n_positive, {r('avg(seg_label)', 'prevalence')} FROM valid JOIN split USING (caseid) GROUP BY split",
        "split",
    ),
    "null_counts": chain("SELECT count(*) - count(mbp) AS null_mbp FROM grid", "grid"),
    "mean_sd_or_median_iqr": f"""SELECT c_mktsegment, {r('avg(c_acctbal)', 'mean', 5)}, {r('stddev_samp(c_acctbal)', 'sd', 5)}, {r('quantile_cont(c_acctbal, 0.25)', 'q1', 5)},
        {r('quantile_cont(c_acctbal, 0.5)', 'q2', 5)}, {r('quantile_cont(c_acctbal, 0.75)', 'q3', 5)} FROM customer GROUP BY 1""",
    "conditional_shares": f"""SELECT count(*) FILTER (c_acctbal < 0) AS n_debt, {r('avg((c_acctbal < 0)::int)', 'share_debt', 6)}, count(DISTINCT c_nationkey) AS n_nations FROM customer""",
    "grouped_contributions": f"SELECT l_orderkey * 10 + l_linenumber AS row_id, {r('l_extendedprice', 'price')}, {r('l_quantity + l_tax + l_discount', 'other')} FROM lineitem",
    "covariance_matrix": "SELECT "
    + ", ".join(r(f"avg({c})", f"mean_{c}", 6) for c in ("l_quantity", "l_discount", "l_tax"))
    + ", "
    + ", ".join(
        r(f"covar_samp({a}, {b})", f"cov_{a}_{b}", 6)
        for a, b in (
            ("l_quantity", "l_quantity"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_discount"), ("l_discount", "l_tax"), ("l_tax", "l_tax"))
    )
    + " FROM lineitem",
    "mahalanobis_3d": f"""WITH m AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_tax) AS mc, covar_samp(l_quantity, l_quantity) AS aa,
          covar_samp(l_quantity, l_discount) AS ab, covar_samp(l_quantity, l_tax) AS ac, covar_samp(l_discount, l_discount) AS bb,
          covar_samp(l_discount, l_tax) AS bc, covar_samp(l_tax, l_tax) AS cc FROM lineitem WHERE l_returnflag = 'N'),
        d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
        x AS (SELECT l_orderkey, l_linenumber, l_quantity, l_quantity - ma AS a, l_discount - mb AS b, l_tax - mc AS c, d.* FROM lineitem, d WHERE l_returnflag = 'R')
        SELECT l_orderkey, l_linenumber, l_quantity, {r('''sqrt(greatest(0, (a * a * (bb * cc - bc * bc) + b * b * (aa * cc - ac * ac) + c * c * (aa * bb - ab * ab)
          + 2 * a * b * (ac * bc - ab * cc) + 2 * a * c * (ab * bc - ac * bb) + 2 * b * c * (ab * ac - aa * bc)) / det))''', 'distance')} FROM x""",
    "ood_fraction_curve": f"""WITH a AS (SELECT quantile_cont(l_extendedprice, [{', '.join(f'{q / 100}::double' for q in range(50, 100))}]) AS lims FROM lineitem WHERE l_returnflag = 'N'),
        q AS (SELECT level::int AS level, lims[level - 49] AS lim FROM a, range(50, 100) t(level))
        SELECT level, {r('lim', '"limit"')}, {r('avg((l_extendedprice > lim)::int)', 'share_above', 6)} FROM q, lineitem WHERE l_returnflag = 'R' GROUP BY level, lim""",
    "confidence_score": f"""WITH b AS (SELECT min(l_extendedprice) FILTER (l_extendedprice <= 50000) AS i0, max(l_extendedprice) FILTER (l_extendedprice <= 50000) AS i1,
          min(l_extendedprice) FILTER (l_extendedprice > 50000) AS o0, max(l_extendedprice) FILTER (l_extendedprice > 50000) AS o1 FROM lineitem)
        SELECT l_orderkey, l_linenumber, {r('''CASE WHEN l_extendedprice <= 50000 THEN 90 + 10 * ((i1 - l_extendedprice) / (i1 - i0)) ELSE 90 * ((o1 - l_extendedprice) / (o1 - o0)) END''', 'confidence')}
        FROM lineitem, b""",
    "fixed_sample": "SELECT c_custkey, c_name FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 50",
}
