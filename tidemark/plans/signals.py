"""Queries of position flows, extremes, transitions, the index pattern and event paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import windows
from tidemark.operators import flows, index_pattern, knn, observations, paths
from tidemark.plans.positioning import NETS, R8, SHARES, observed, priced
from tidemark.plans.shape import shaped, sql, sql_counted, sql_greedy, sql_nearest, sql_wilson
from tidemark.session import materialized

FLOW = "market:s weeks:l date:t price_change long_change short_change long_z short_z signal:s state:s strength:s score dominant_flow:s dominance long_building:b short_building:b"
SPLIT = "market:s signal:s confirmed:l score strength:s"


def sql_flows(move: float, z: float, dom: float, source: str = "obs") -> str:
    """``fl``: classified horizons of the newest complete report."""
    steps = " UNION ALL ".join(
        f"SELECT market, date, {k} AS weeks, close / nullif(lag(close, {k}) OVER w, 0) - 1 AS p, noncomm_long - lag(noncomm_long, {k}) OVER w AS l, noncomm_short - lag(noncomm_short, {k}) OVER w AS s FROM fc WINDOW w AS (PARTITION BY market ORDER BY date)"
        for k in flows.FLOW_HORIZONS
    )
    zed = lambda c: f"CASE WHEN count({c}) FILTER (NOT is_last) >= 52 THEN CASE WHEN stddev_pop({c}) FILTER (NOT is_last) = 0 THEN 0.0 ELSE (max({c}) FILTER (is_last) - avg({c}) FILTER (NOT is_last)) / stddev_pop({c}) FILTER (NOT is_last) END END"
    return f"""fq AS (SELECT *, count(*) OVER (PARTITION BY market) AS n_rows FROM {source} WHERE close IS NOT NULL AND noncomm_long IS NOT NULL AND noncomm_short IS NOT NULL),
fc AS (SELECT * FROM fq WHERE n_rows >= 61),
fs AS ({steps}),
ft AS (SELECT *, date = max(date) OVER (PARTITION BY market) AS is_last FROM fs),
fa AS (SELECT market, weeks, max(date) AS date, max(p) FILTER (is_last) AS price_change, max(l) FILTER (is_last) AS long_change, max(s) FILTER (is_last) AS short_change, {zed('l')} AS long_z, {zed('s')} AS short_z FROM ft GROUP BY 1, 2),
fb AS (SELECT *, CASE WHEN long_change > 0 THEN coalesce(abs(long_change) / nullif(abs(long_change) + abs(short_change), 0), 0) ELSE 0 END AS ld, CASE WHEN short_change > 0 THEN coalesce(abs(short_change) / nullif(abs(long_change) + abs(short_change), 0), 0) ELSE 0 END AS sd,
  coalesce(long_change > 0 AND long_z >= {z}, false) AS la, coalesce(short_change > 0 AND short_z >= {z}, false) AS sa FROM fa),
fd AS (SELECT *, la AND ld >= {dom} AS long_building, sa AND sd >= {dom} AS short_building, price_change <= -{move} AS dn, price_change >= {move} AS up FROM fb),
fe AS (SELECT *, dn AND long_building AND NOT sa AS bull, up AND short_building AND NOT la AS bear, long_change > 0 AND short_change > 0 AS both_up, greatest(ld, sd) AS dominance FROM fd),
ff AS (SELECT *, CASE WHEN bull THEN 'bullish' WHEN bear THEN 'bearish' ELSE 'none' END AS signal,
  CASE WHEN bull THEN 'bullish_divergence' WHEN bear THEN 'bearish_divergence' WHEN dn AND both_up THEN 'bullish_accumulation_mixed' WHEN up AND both_up THEN 'bearish_distribution_mixed'
    WHEN dn AND long_change > 0 THEN 'bullish_accumulation' WHEN up AND short_change > 0 THEN 'bearish_distribution' WHEN dn AND short_change > 0 THEN 'bearish_trend_confirmation' WHEN up AND long_change > 0 THEN 'bullish_trend_confirmation'
    WHEN long_change < 0 AND short_change < 0 THEN 'position_reduction' ELSE 'neutral' END AS state,
  CASE WHEN bull THEN 2 + greatest(0.0, long_z - {z}) + 4 * greatest(0.0, ld - {dom}) WHEN bear THEN 2 + greatest(0.0, short_z - {z}) + 4 * greatest(0.0, sd - {dom}) ELSE 0.0 END AS score,
  CASE WHEN both_up THEN CASE WHEN long_change > short_change THEN 'long_building' ELSE 'short_building' END WHEN long_change > 0 THEN 'long_building' WHEN short_change > 0 THEN 'short_building'
    WHEN long_change < 0 AND short_change < 0 THEN 'position_reduction' WHEN long_change < 0 THEN 'long_liquidation' WHEN short_change < 0 THEN 'short_covering' ELSE 'none' END AS dominant_flow FROM fe),
fl AS (SELECT *, CASE WHEN signal = 'none' THEN CASE WHEN state IN ('neutral', 'position_reduction') THEN 'none' ELSE 'hint' END WHEN score >= 4 THEN 'strong' WHEN score >= 2.8 THEN 'medium' ELSE 'early' END AS strength FROM ff)"""


SQL_SPLIT = """sb AS (SELECT market, sum(CASE WHEN signal = 'bullish' THEN score ELSE 0 END) AS up, sum(CASE WHEN signal = 'bearish' THEN score ELSE 0 END) AS down, count(*) FILTER (signal = 'bullish') AS ups, count(*) FILTER (signal = 'bearish') AS downs FROM fl GROUP BY 1),
sc AS (SELECT *, CASE WHEN up > down AND ups > 0 THEN 'bullish' WHEN down > up AND downs > 0 THEN 'bearish' ELSE 'none' END AS signal FROM sb),
sd AS (SELECT market, signal, CASE signal WHEN 'bullish' THEN ups WHEN 'bearish' THEN downs ELSE 0 END AS confirmed, CASE signal WHEN 'bullish' THEN up WHEN 'bearish' THEN down ELSE 0 END AS score FROM sc),
split AS (SELECT *, CASE WHEN confirmed >= 3 AND score >= 8 THEN 'strong' WHEN confirmed >= 2 OR score >= 3.5 THEN 'medium' WHEN confirmed = 1 THEN 'early' ELSE 'none' END AS strength FROM sd)"""


def divergence_query(loose: bool):
    limits = (0.0, -1.0, 0.5) if loose else (0.02, 1.0, 0.7)
    return lambda spark, sf_dir: shaped(flows.divergence(flows.horizons(observed(spark, sf_dir), flows.FLOW_HORIZONS, *limits)), SPLIT)


EXTREME = "market:s date:t history:l " + " ".join(f"{n} {n}_pct {n}_oi_pct {n}_combined {n}_state:s" for n in NETS) + " absolute_signal:s share_signal:s signal:s confirmed:b retail_support:s strength"


def sql_extremes(cutoff: float, source: str = "obs") -> str:
    low = 100 - cutoff
    ranks = ", ".join(f"max({c}) FILTER (is_last) AS {c}, 100 * (count(*) FILTER (NOT is_last AND {c} < now_{c}) + 0.5 * count(*) FILTER (NOT is_last AND {c} = now_{c})) / (count(*) - 1) AS {c}_pct" for c in NETS + SHARES)
    both = ", ".join(f"({n}_pct + {n}_oi_pct) / 2 AS {n}_combined" for n in NETS)
    states = ", ".join(f"CASE WHEN {n}_combined >= {cutoff} THEN 'extreme_high' WHEN {n}_combined <= {low} THEN 'extreme_low' WHEN {n}_combined >= 80 THEN 'high' WHEN {n}_combined <= 20 THEN 'low' ELSE 'normal' END AS {n}_state" for n in NETS)
    opposed = lambda x, name: f"CASE WHEN commercial_net{x}_pct >= {cutoff} AND noncommercial_net{x}_pct <= {low} THEN 'bullish' WHEN commercial_net{x}_pct <= {low} AND noncommercial_net{x}_pct >= {cutoff} THEN 'bearish' ELSE 'neutral' END AS {name}"
    return f"""xa AS (SELECT *, date = max(date) OVER (PARTITION BY market) AS is_last, count(*) OVER (PARTITION BY market) AS n_rows FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in NETS + SHARES)}),
xb AS (SELECT *, {', '.join(f'max({c}) FILTER (is_last) OVER (PARTITION BY market) AS now_{c}' for c in NETS + SHARES)} FROM xa WHERE n_rows >= 105),
xc AS (SELECT market, max(date) AS date, count(*) - 1 AS history, {ranks} FROM xb GROUP BY 1),
xd AS (SELECT *, {both} FROM xc),
xe AS (SELECT *, {states}, {opposed('', 'absolute_signal')}, {opposed('_oi', 'share_signal')} FROM xd),
xx AS (SELECT *, CASE WHEN 'bullish' IN (absolute_signal, share_signal) THEN 'bullish_reversal_zone' WHEN 'bearish' IN (absolute_signal, share_signal) THEN 'bearish_reversal_zone' ELSE 'no_joint_extreme' END AS signal,
  absolute_signal <> 'neutral' AND absolute_signal = share_signal AS confirmed, CASE WHEN nonreportable_net_combined <= {low} THEN 'bullish' WHEN nonreportable_net_combined >= {cutoff} THEN 'bearish' ELSE 'neutral' END AS retail_support,
  greatest({', '.join(f'abs({n}_combined - 50) * 2' for n in NETS)}) AS strength FROM xe)"""


TURN = "market:s date:t direction:s flow_direction:s flow:s phase:l score convergence:b sustained:b price_confirmed:b split_aligned:b retail_aligned:b confirmed:b price_change"


def sql_transition(cutoff: float) -> str:
    need = " AND ".join(f"{c} IS NOT NULL" for c in ["close", "oi", *NETS, "noncomm_long", "noncomm_short", "comm_long", "comm_short", "nonrep_long", "nonrep_short"])
    zed = lambda c: f"CASE WHEN count({c}) FILTER (NOT l) >= 52 THEN CASE WHEN stddev_pop({c}) FILTER (NOT l) = 0 THEN 0.0 ELSE (max({c}) FILTER (l) - avg({c}) FILTER (NOT l)) / stddev_pop({c}) FILTER (NOT l) END END"
    return f"""ta AS (SELECT *, count(*) OVER (PARTITION BY market) AS nn FROM obs WHERE {need}), tb AS (SELECT * EXCLUDE (nn) FROM ta WHERE nn >= 105),
{sql_extremes(cutoff, 'tb')}, {sql_flows(0.02, 1.0, 0.7, 'tb')}, {SQL_SPLIT},
tc AS (SELECT market, date, noncomm_long - lag(noncomm_long, 4) OVER w AS dl, noncomm_short - lag(noncomm_short, 4) OVER w AS ds, noncommercial_net - lag(noncommercial_net, 4) OVER w AS dn, close / nullif(lag(close, 4) OVER w, 0) - 1 AS dc,
  row_number() OVER (PARTITION BY market ORDER BY date DESC) AS k FROM tb WINDOW w AS (PARTITION BY market ORDER BY date)),
td AS (SELECT *, k = 1 AS l FROM tc),
te AS (SELECT market, max(dl) FILTER (l) AS lc, max(ds) FILTER (l) AS sc, {zed('dl')} AS lz, {zed('ds')} AS sz, max(dc) FILTER (l) AS price_change, count(*) FILTER (k <= 3 AND dn > 0) AS rises, count(*) FILTER (k <= 3 AND dn < 0) AS falls FROM td GROUP BY 1),
tf AS (SELECT xx.market, xx.date, xx.signal, xx.confirmed, xx.retail_support, te.* EXCLUDE (market), split.signal AS ss, split.strength AS st, CASE xx.signal WHEN 'bullish_reversal_zone' THEN 'bullish' WHEN 'bearish_reversal_zone' THEN 'bearish' ELSE 'neutral' END AS direction
  FROM xx JOIN te ON xx.market = te.market LEFT JOIN split ON split.market = xx.market),
tg AS (SELECT *, CASE WHEN lc > 0 AND sc <= 0 THEN 'bullish' WHEN lc <= 0 AND sc > 0 THEN 'bearish' WHEN lc > 0 AND sc > 0 THEN CASE WHEN coalesce(abs(lz), 0) >= coalesce(abs(sz), 0) THEN 'bullish' ELSE 'bearish' END
  WHEN lc < 0 AND sc < 0 THEN CASE WHEN coalesce(abs(sz), 0) >= coalesce(abs(lz), 0) THEN 'bullish' ELSE 'bearish' END ELSE 'neutral' END AS flow_direction FROM tf),
th AS (SELECT *, CASE WHEN flow_direction = 'neutral' THEN 'unclear' ELSE CASE WHEN greatest(coalesce(abs(lz), 0), coalesce(abs(sz), 0)) >= 1.5 THEN 'strong_' ELSE '' END || flow_direction || '_flow' || CASE WHEN lc > 0 AND sc > 0 THEN '_both_growing' WHEN lc < 0 AND sc < 0 THEN '_both_shrinking' ELSE '' END END AS flow,
  direction <> 'neutral' AND flow_direction = direction AS convergence, direction <> 'neutral' AND CASE direction WHEN 'bullish' THEN rises ELSE falls END >= 2 AS sustained,
  direction <> 'neutral' AND CASE direction WHEN 'bullish' THEN price_change > 0.01 ELSE price_change < -0.01 END AS price_confirmed, direction <> 'neutral' AND coalesce(ss = direction, false) AS split_aligned, direction <> 'neutral' AND retail_support = direction AS retail_aligned FROM tg),
ti AS (SELECT *, least(100, CASE WHEN direction <> 'neutral' THEN 35 ELSE 0 END + CASE WHEN confirmed THEN 5 ELSE 0 END + CASE WHEN retail_support = direction THEN 10 ELSE 0 END
  + CASE WHEN convergence THEN 20 + least(10, floor(greatest(0.0, greatest(abs(lz), abs(sz)) - 1) * 10)) ELSE 0 END + CASE WHEN sustained THEN 10 ELSE 0 END
  + CASE WHEN split_aligned THEN CASE st WHEN 'early' THEN 8 WHEN 'medium' THEN 12 ELSE 15 END ELSE 0 END + CASE WHEN price_confirmed THEN 10 ELSE 0 END) AS score,
  CASE WHEN direction = 'neutral' THEN 0 WHEN NOT convergence THEN 1 WHEN NOT sustained THEN 2 WHEN NOT price_confirmed THEN 3 ELSE 4 END AS phase FROM th)"""


#: The index pattern asks for a double extreme, which the test tables seldom have; a wide cutoff makes it meet some.
WIDE = 55.0
INDEX = "market:s date:t commercial_index retail_index commercial_net_percentile retail_net_percentile commercial_confirmed:b retail_confirmed:b reason:s n:l up down direction:s hit_rate wilson_low wilson_high median q25 q75 best worst quality"


def sql_index_pattern(cutoff: float, n: int = 30) -> str:
    p = ["commercial_index", "retail_index", "commercial_net_percentile", "retail_net_percentile"]
    low = 100 - cutoff
    stats = ", ".join(f"coalesce(nullif(stddev_pop({f}) FILTER (NOT is_last), 0), 1) AS sd_{f}, max({f}) FILTER (is_last) AS now_{f}" for f in p)
    side = lambda c: f"CASE WHEN {c} >= {cutoff} THEN 1 WHEN {c} <= {low} THEN -1 END"
    same = " AND ".join(f"{side('c.' + c)} = {side('s.now_' + ('commercial_index' if c.startswith('commercial') else 'retail_index'))}" for c in p)
    return f"""ia AS (SELECT *, {observations.sql_index('commercial_net')} AS commercial_index, 100 * {observations.sql_rank('commercial_net')} AS commercial_net_percentile, {observations.sql_index('nonreportable_net')} AS retail_index, 100 * {observations.sql_rank('nonreportable_net')} AS retail_net_percentile FROM obs),
ib AS (SELECT *, date = max(date) OVER (PARTITION BY market) AS is_last, count(*) OVER (PARTITION BY market) AS n_rows FROM ia WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*p, R8])}),
ic AS (SELECT market, max(n_rows) AS n_rows, max(date) AS date, {stats} FROM ib GROUP BY 1),
id AS (SELECT *, n_rows >= 105 AS enough, coalesce({side('now_commercial_index')} = {side('now_commercial_net_percentile')}, false) AS commercial_confirmed, coalesce({side('now_retail_index')} = {side('now_retail_net_percentile')}, false) AS retail_confirmed FROM ic),
ie AS (SELECT c.market, c.date, c.{R8}, round(sqrt({' + '.join(f'pow((c.{f} - s.now_{f}) / s.sd_{f}, 2)' for f in p)}), 9) AS distance FROM ib c JOIN id s ON c.market = s.market WHERE NOT c.is_last AND s.enough AND s.commercial_confirmed AND s.retail_confirmed AND {same}),
ig AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY distance, date) AS place FROM ie) WHERE place <= {4 * n}),
{sql_greedy('ig', 'distance, date', 56, n, 'im')},
ij AS (SELECT im.*, obs.{R8} FROM im JOIN obs ON im.market = obs.market AND im.date = obs.date),
ik AS ({sql_counted('ij', R8, more=', quantile_cont(distance, 0.5) AS md')}),
il AS (SELECT *, CASE WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END AS direction, CASE WHEN down > up THEN down ELSE up END AS hits FROM ik),
iq AS (SELECT *, hits / n AS hit_rate, {sql_wilson('hits', 'n', False)} AS wilson_low, {sql_wilson('hits', 'n', True)} AS wilson_high FROM il),
result AS (SELECT id.market, id.date, {', '.join(f'now_{c} AS {c}' for c in p)}, commercial_confirmed, retail_confirmed, CASE WHEN NOT enough THEN 'too_few_rows' WHEN NOT (commercial_confirmed AND retail_confirmed) THEN 'not_confirmed' WHEN n IS NULL THEN 'never_before' ELSE '' END AS reason,
  coalesce(n, 0) AS n, up, down, direction, hit_rate, wilson_low, wilson_high, median, all_25 AS q25, all_75 AS q75, best, worst,
  100 * (0.55 * wilson_low + 0.25 * least(1.0, ln(1 + n) / ln(51)) + 0.20 * least(1.0, greatest(0.0, 1 - md / 3.5))) * abs(up / n - down / n) AS quality FROM id LEFT JOIN iq ON iq.market = id.market)"""


def events_and_prices(spark, sf_dir):
    prices = priced(spark, sf_dir)
    return materialized(knn.net_similar(observed(spark, sf_dir, prices=prices))), prices


SQL_MOVES = """np AS (SELECT market, date, close, row_number() OVER (PARTITION BY market ORDER BY date) AS place FROM prices),
ev AS (SELECT m.market, m.date, np.place AS p0, np.close AS c0 FROM m ASOF JOIN np ON m.market = np.market AND m.date <= np.date),
mv AS (SELECT ev.market, ev.date, np.place - ev.p0 AS day, np.close / nullif(ev.c0, 0) - 1 AS move FROM ev JOIN np ON np.market = ev.market AND np.place BETWEEN ev.p0 AND ev.p0 + 40),
mw AS (SELECT *, count(*) OVER (PARTITION BY market, date) AS n, max(move) FILTER (day = 40) OVER (PARTITION BY market, date) AS final FROM mv),
mf AS (SELECT * FROM mw WHERE n = 41)"""
PATHS = "market:s day:l n:l mean median"
TIMING = "market:s n:l up:l down:l bias:s n_onsets:l window_start window_end median_onset"
SQL_TIMING = """a AS (SELECT market, count(*) AS n, count(*) FILTER (final > 0) AS up, count(*) FILTER (final < 0) AS down FROM mf WHERE day = 40 GROUP BY 1),
b AS (SELECT *, CASE WHEN up / n >= 0.6 THEN 'bullish' WHEN down / n >= 0.6 THEN 'bearish' ELSE 'neutral' END AS bias FROM a), c AS (SELECT *, CASE bias WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS sgn FROM b),
d AS (SELECT mf.market, mf.date, min(day) AS onset FROM mf JOIN c USING (market) WHERE sgn <> 0 AND final * sgn > 0 AND move * sgn >= 0.01 GROUP BY 1, 2),
e AS (SELECT market, count(*) AS n_onsets, greatest(1, floor(quantile_cont(onset, 0.25))) AS window_start, ceil(quantile_cont(onset, 0.75)) AS w2, round_even(quantile_cont(onset, 0.5), 0) AS median_onset FROM d GROUP BY 1),
result AS (SELECT c.*, coalesce(n_onsets, 0) AS n_onsets, window_start, greatest(window_start, w2) AS window_end, median_onset FROM c LEFT JOIN e USING (market))"""

CLUSTER_TIMING = "market:s n_paths:l onset_day window_start window_end peak_day:l peak_return terminal_return current_day:l status:s"


def cluster_timing_query(spark, sf_dir):
    prices = priced(spark, sf_dir)
    obs = observed(spark, sf_dir, prices=prices)
    reports = windows.with_place(obs).where("is_last").select("market", F.date_sub("date", 110).alias("report_date"))
    biases = reports.select("market", F.when(F.col("market") < "B", "bearish").otherwise("bullish").alias("bias"))
    return shaped(paths.cluster_timing(knn.net_similar(obs), prices, biases, reports), CLUSTER_TIMING)


SQL_CLUSTER_TIMING = """rd AS (SELECT market, max(date) - 110 AS report_date, CASE WHEN market < 'B' THEN -1.0 ELSE 1.0 END AS sgn FROM obs GROUP BY 1),
ca AS (SELECT mf.*, move * sgn AS t, final * sgn AS ft, sgn FROM mf JOIN rd USING (market)),
cb AS (SELECT *, count(*) FILTER (t > 0) OVER w AS pos, count(*) OVER w AS w5 FROM ca WHERE ft > 0 WINDOW w AS (PARTITION BY market, date ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
cc AS (SELECT market, date, min(day) AS onset FROM cb WHERE t >= greatest(0.005, 0.25 * ft) AND pos >= least(3, w5) GROUP BY 1, 2),
cd AS (SELECT market, greatest(1, floor(quantile_cont(onset, 0.25))) AS ws, ceil(quantile_cont(onset, 0.75)) AS we FROM cc GROUP BY 1),
ce AS (SELECT market, day, count(*) AS n_paths, any_value(sgn) AS sgn, quantile_cont(move, 0.5) AS median FROM ca GROUP BY 1, 2 HAVING count(*) >= 5),
cf AS (SELECT *, median * sgn AS t, max(median * sgn) FILTER (day = 40) OVER (PARTITION BY market) AS term FROM ce),
cg AS (SELECT *, count(*) FILTER (t > 0) OVER w AS pos, count(*) OVER w AS w5 FROM cf WINDOW w AS (PARTITION BY market ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
ch AS (SELECT market, min(day) AS onset_day FROM cg WHERE t >= greatest(0.005, 0.25 * greatest(term, 0)) AND pos >= least(3, w5) GROUP BY 1),
ck AS (SELECT market, arg_max(struct_pack(d := day, m := median), struct_pack(a := t, b := -day)) AS pk, max(median) FILTER (day = 40) AS terminal_return, max(n_paths) AS n_paths FROM cf GROUP BY 1),
cp AS (SELECT prices.market, count(*) AS since FROM prices JOIN rd USING (market) WHERE date >= report_date GROUP BY 1),
cr AS (SELECT market, n_paths, onset_day, coalesce(ws, onset_day) AS window_start, coalesce(greatest(ws, we), onset_day) AS window_end, pk.d AS peak_day, pk.m AS peak_return, terminal_return, greatest(0, coalesce(since, 0) - 1) AS current_day
  FROM ck LEFT JOIN ch USING (market) LEFT JOIN cd USING (market) LEFT JOIN cp USING (market)),
result AS (SELECT *, CASE WHEN onset_day IS NULL THEN 'unclear' WHEN current_day < coalesce(nullif(window_start, 0), onset_day) THEN 'before' WHEN current_day <= coalesce(nullif(window_end, 0), onset_day) THEN 'onset' WHEN current_day <= peak_day THEN 'active' ELSE 'late' END AS status FROM cr)"""


def entries() -> dict[str, tuple]:
    near = sql_nearest(NETS, [], "rms", 30, 56)
    return {
        "flow_horizons": (lambda spark, sf_dir: shaped(flows.horizons(observed(spark, sf_dir)), FLOW), sql(sql_flows(0.02, 1.0, 0.7) + ", result AS (SELECT * FROM fl)", FLOW)),
        "flow_divergence": (divergence_query(False), sql(sql_flows(0.02, 1.0, 0.7) + "," + SQL_SPLIT + ", result AS (SELECT * FROM split)", SPLIT)),
        "flow_divergence_loose": (divergence_query(True), sql(sql_flows(0.0, -1.0, 0.5) + "," + SQL_SPLIT + ", result AS (SELECT * FROM split)", SPLIT)),
        "position_extremes": (lambda spark, sf_dir: shaped(flows.extremes(observed(spark, sf_dir)), EXTREME), sql(sql_extremes(90) + ", result AS (SELECT * FROM xx)", EXTREME)),
        "position_extremes_wide": (lambda spark, sf_dir: shaped(flows.extremes(observed(spark, sf_dir), 60.0), EXTREME), sql(sql_extremes(60) + ", result AS (SELECT * FROM xx)", EXTREME)),
        "trend_transition": (lambda spark, sf_dir: shaped(flows.transition(observed(spark, sf_dir)), TURN), sql(sql_transition(90) + ", result AS (SELECT * FROM ti)", TURN)),
        "trend_transition_wide": (lambda spark, sf_dir: shaped(flows.transition(observed(spark, sf_dir), 4, 55.0), TURN), sql(sql_transition(55) + ", result AS (SELECT * FROM ti)", TURN)),
        "index_pattern": (lambda spark, sf_dir: shaped(index_pattern.analyze(observed(spark, sf_dir)), INDEX), sql(sql_index_pattern(80), INDEX)),
        "index_pattern_wide": (lambda spark, sf_dir: shaped(index_pattern.analyze(observed(spark, sf_dir), cutoff=WIDE), INDEX), sql(sql_index_pattern(WIDE), INDEX)),
        "event_paths": (lambda spark, sf_dir: shaped(paths.event_paths(*events_and_prices(spark, sf_dir), 8), PATHS), sql(near + "," + SQL_MOVES + ", result AS (SELECT market, day, count(*) AS n, avg(move) AS mean, quantile_cont(move, 0.5) AS median FROM mw WHERE n >= 2 GROUP BY 1, 2)", PATHS)),
        "event_timing": (lambda spark, sf_dir: shaped(paths.timing(*events_and_prices(spark, sf_dir)), TIMING), sql(near + "," + SQL_MOVES + "," + SQL_TIMING, TIMING)),
        "cluster_timing": (cluster_timing_query, sql(near + "," + SQL_MOVES + "," + SQL_CLUSTER_TIMING, CLUSTER_TIMING)),
    }
