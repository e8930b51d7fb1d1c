"""All registered queries of the engine proper, with their SQL twins. Results are rounded alike in both."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushgrad.functions import coins
from hushgrad.functions.coins import sql_coin, sql_gaussian, sql_laplace
from hushgrad.operators import accounting, metrics, order, prep, sampling, stages, training, updates
from hushgrad.sources import loaders, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = "key"

P_LINES = "1.0 / (1.0 + exp(-(0.4::double * (l_quantity / 50.0::double) + -3.0::double * l_discount + 2.5::double * l_tax + 0.5::double * (l_extendedprice / 100000.0::double) + -1.0::double)))"
LINES = f"lines as (select l_quantity / 50.0::double x1, l_discount x2, l_tax x3, l_extendedprice / 100000.0::double x4, (l_returnflag = 'R')::int y, {P_LINES} p from lineitem)"
CLICKS = """raw_clicks as (select event_id row_id, user_id, event_type, value, hour(ts)::double as hour, (props->>'$.k')::double k, (event_type = 'click')::int y from events),
clicks as (select *, ln(1.0::double + value) / 6.0::double x1, hour / 24.0::double x2, k / 100.0::double x3, 1.0 / (1.0 + exp(-(0.6::double * (ln(1.0::double + value) / 6.0::double) + -0.4::double * (hour / 24.0::double) + 0.3::double * (k / 100.0::double) + -1.4::double))) p from raw_clicks)"""
LOSS = "-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))"
ENT = "(-{r} * ln({r}) - (1 - {r}) * ln(1 - {r}))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as bigint."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # Adding zero turns -0.0 into 0.0.
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = 6):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0::double as {name}"


# --- scans and scores -------------------------------------------------------------------------------------------------


@query("scan_project", "select l_quantity, l_discount, l_tax, l_extendedprice, l_returnflag from lineitem")
def _(spark, d):
    return tables.scan(spark, f"{d}/lineitem.parquet", ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag"])


SCORES = f"""count(*) n, {r('avg(y::double)', 'base_rate')}, {r(f'avg({LOSS})', 'log_loss')}, {r('avg((p - y) * (p - y))', 'brier_score')},
{r(f"avg({LOSS}) / {ENT.format(r='avg(y::double)')}", 'normalized_entropy')}, {r('sum(y::double) / sum(p)', 'calibration_ratio')}"""


@query("scores_lines", f"with {LINES} select {SCORES} from lines")
def _(spark, d):
    return metrics.scores(tables.scored_lines(spark, d))


@query("scores_clicks", f"with {CLICKS} select {SCORES} from clicks")
def _(spark, d):
    return metrics.scores(tables.scored_clicks(spark, d))


for _name in ("log_loss", "brier_score", "normalized_entropy", "calibration_ratio"):
    SQL[_name] = f"with {LINES}, s as (select {SCORES} from lines) select {_name} from s"
    QUERIES[_name] = lambda spark, d, n=_name: rounded(metrics.scores(tables.scored_lines(spark, d)).select(n))


@query("base_rate_entropy", f"with {LINES} select {r('avg(y::double)', 'base_rate')}, {r(ENT.format(r='avg(y::double)'), 'entropy')} from lines")
def _(spark, d):
    return metrics.base_rate_entropy(tables.scored_lines(spark, d))


@query("validate_scored", f"with {LINES} select count(*) n, sum((p is null or isnan(p) or isinf(p))::bigint)::bigint bad_p, {r('min(p)', 'low')}, {r('max(p)', 'high')}, sum((y is null or y not in (0, 1))::bigint)::bigint bad_y from lines")
def _(spark, d):
    return metrics.validation(tables.scored_lines(spark, d))


@query("sigmoid_scores", f"with {CLICKS} select row_id, {r('p', 'p')} from clicks")
def _(spark, d):
    return tables.scored_clicks(spark, d).select("row_id", "p")


# --- calibration ------------------------------------------------------------------------------------------------------


def bins_sql(source: str, strategy: str, n: int = 15) -> str:
    if strategy == "equal_mass":
        cuts = f"select quantile_cont(p, [{', '.join(f'{i}/{n}::double' for i in range(n + 1))}]) q from {source}"
        edge = f"raw as ({cuts}), u as (select distinct unnest(q) e from raw)"
    else:
        edge = f"u as (select i / {n}::double e from range({n + 1}) t(i))"
    return f"""{edge}, ed as (select e, row_number() over (order by e) - 1 i, lead(e) over (order by e) nx, count(*) over () k from u),
binned as (select s.p, s.y, least((select max(i) from ed where e <= s.p), (select max(k) - 2 from ed)) b from {source} s),
bins0 as (select b, count(*) n, avg(p) mp, avg(y::double) mo from binned group by b),
bins as (select (dense_rank() over (order by b) - 1)::bigint bin, n, mp, mo, e lower, nx upper from bins0 join ed on ed.i = b)"""


BINS = f"bin, n, {r('mp', 'mean_predicted')}, {r('mo', 'mean_observed')}, {r('lower', 'lower')}, {r('upper', 'upper')}"
for _s in metrics.STRATEGIES:

    @query(f"bins_{_s}", f"with {CLICKS}, {bins_sql('clicks', _s)} select {BINS} from bins")
    def _(spark, d, s=_s):
        return metrics.bin_summary(tables.scored_clicks(spark, d), 15, s)


@query("bin_summary", f"with {LINES}, {bins_sql('lines', 'equal_mass', 10)} select {BINS} from bins")
def _(spark, d):
    return metrics.bin_summary(tables.scored_lines(spark, d), 10)


@query("bin_assign", f"with {CLICKS} select row_id, least(14, floor(p * 15)::bigint) as bin from clicks")
def _(spark, d):
    s = tables.scored_clicks(spark, d)
    return metrics.assigned(s, metrics.edges(s, 15, "equal_width")).select("row_id", "bin")


@query("reliability_curve", f"with {LINES}, {bins_sql('lines', 'equal_mass')} select {BINS}, {r('mp - mo', 'gap')} from bins")
def _(spark, d):
    return metrics.reliability_curve(tables.scored_lines(spark, d))


@query("ece", f"with {LINES}, {bins_sql('lines', 'equal_mass')} select {r('sum(n * abs(mp - mo)) / sum(n)', 'ece')} from bins")
def _(spark, d):
    return metrics.ece(tables.scored_lines(spark, d))


@query("brier_decomposition", f"""with {CLICKS}, {bins_sql('clicks', 'equal_mass')}, s as (select avg(y::double) pi, avg((p - y) * (p - y)) score, count(*) total from clicks),
t as (select score, sum(n / total::double * (mp - mo) * (mp - mo)) c, sum(n / total::double * (mo - pi) * (mo - pi)) rs, pi * (1 - pi) u from bins, s group by score, pi)
select {r('score', 'score')}, {r('c', 'calibration')}, {r('rs', 'resolution')}, {r('u', 'uncertainty')}, {r('score - c + rs - u', 'residual')} from t""")
def _(spark, d):
    return metrics.brier_decomposition(tables.scored_clicks(spark, d))


_KL = "(case when {a} > 0 then {a} * ln({a} / {b}) else 0 end + case when 1 - {a} > 0 then (1 - {a}) * ln((1 - {a}) / (1 - {b})) else 0 end)"


@query("log_loss_decomposition", f"""with {CLICKS}, {bins_sql('clicks', 'equal_mass')}, s as (select avg(y::double) pi, avg({LOSS}) score, count(*) total from clicks),
t as (select score, sum(n / total::double * {_KL.format(a='mo', b='mp')}) c, sum(n / total::double * {_KL.format(a='mo', b='pi')}) rs, {ENT.format(r='pi')} u from bins, s group by score, pi)
select {r('score', 'score')}, {r('c', 'calibration')}, {r('rs', 'resolution')}, {r('u', 'uncertainty')}, {r('score - c + rs - u', 'residual')} from t""")
def _(spark, d):
    return metrics.log_loss_decomposition(tables.scored_clicks(spark, d))


@query("headline", f"with {LINES}, {bins_sql('lines', 'equal_mass')}, s as (select {SCORES.replace(' n,', ' n_rows,', 1)} from lines) select {BINS}, {r('mp - mo', 'gap')}, s.* from bins, s")
def _(spark, d):
    scored = tables.scored_lines(spark, d)
    return metrics.reliability_curve(scored).crossJoin(metrics.scores(scored).withColumnRenamed("n", "n_rows"))  # one row


# --- rankings ---------------------------------------------------------------------------------------------------------

WALK = f"""walk as (select row_number() over o k, row_id, p score, y hit, (sum(y) over (o rows unbounded preceding))::bigint found, (sum(y) over ())::double pos from clicks window o as (order by p desc, row_id)),
w as (select *, found / k::double pr, found / pos re from walk)"""


@query("ranked_walk", f"with {CLICKS}, {WALK} select k, row_id, {r('score', 'score')}, hit::bigint hit, found, {r('pr', 'precision')}, {r('re', 'recall')} from w")
def _(spark, d):
    return metrics.ranked_walk(tables.ranked_clicks(spark, d))


@query("pr_curve", f"with {CLICKS}, {WALK} select k, {r('score', 'score')}, {r('pr', 'precision')}, {r('re', 'recall')} from w")
def _(spark, d):
    return metrics.pr_curve(tables.ranked_clicks(spark, d))


@query("curve_stride", f"with {CLICKS}, {WALK} select k, {r('score', 'score')}, {r('pr', 'precision')}, {r('re', 'recall')} from w where k % 50 = 0")
def _(spark, d):
    return metrics.pr_curve(tables.ranked_clicks(spark, d)).where(F.pmod("k", F.lit(50)) == 0)


@query("average_precision", f"with {CLICKS}, {WALK} select {r('sum(pr * hit) / sum(hit)', 'average_precision')} from w")
def _(spark, d):
    return metrics.average_precision(tables.ranked_clicks(spark, d))


@query("best_f1", f"with {CLICKS}, {WALK} select {r('score', 'threshold')}, {r('2 * pr * re / greatest(pr + re, 1e-12)', 'f1')}, {r('pr', 'precision')}, {r('re', 'recall')} from w order by 2 * pr * re / greatest(pr + re, 1e-12) desc, k limit 1")
def _(spark, d):
    return metrics.best_f1(tables.ranked_clicks(spark, d))


LINE_WALK = """walk as (select row_number() over o k, p score, y hit, (sum(y) over (o rows unbounded preceding))::bigint found, (sum(y) over ())::double pos from (select l_orderkey * 8 + l_linenumber row_id, p, y from lineitem, lateral (select %s p, (l_returnflag = 'R')::int y)) window o as (order by p desc, row_id)),
w as (select *, found / k::double pr, found / pos re from walk)""" % P_LINES


@query("best_f1_lines", f"with {LINE_WALK} select {r('score', 'threshold')}, {r('2 * pr * re / greatest(pr + re, 1e-12)', 'f1')}, {r('pr', 'precision')}, {r('re', 'recall')} from w order by 2 * pr * re / greatest(pr + re, 1e-12) desc, k limit 1")
def _(spark, d):
    return metrics.best_f1(tables.scored_lines(spark, d, row=True))


@query("tie_collapsed", f"with {LINES} select {r('round(p, 2)', 'p')}, count(*) n, sum(y)::bigint hits from lines group by round(p, 2)")
def _(spark, d):
    return metrics.tie_collapsed(tables.scored_lines(spark, d).withColumn("p", F.round("p", 2)))


THRESHOLDS = [0.0, 0.25, 0.3, 0.35, 0.4, 1.0]


@query("confusion_at", f"with {LINES} select t::double as threshold, count(*) filter (y = 0 and p < t) tn, count(*) filter (y = 0 and p >= t) fp, count(*) filter (y = 1 and p < t) fn, count(*) filter (y = 1 and p >= t) tp from lines, (select unnest({THRESHOLDS}::double[]) t) group by t")
def _(spark, d):
    return metrics.confusion_at(tables.scored_lines(spark, d), THRESHOLDS)


@query("constant_predictor", f"with {LINES}, c as (select avg(y::double) m from lines) select {r('max(m)', 'p')}, {r('avg(' + LOSS.replace('p,', 'm,') + ')', 'log_loss')} from lines, c")
def _(spark, d):
    scored = tables.scored_lines(spark, d)
    rate = scored.agg(F.avg(F.col("y").cast("double")).alias("p"))
    return scored.select("y").crossJoin(rate).agg(F.max("p").alias("p"), F.avg(metrics.log_loss_of(F.col("p"), F.col("y").cast("double"))).alias("log_loss"))  # one row


# --- preparation ------------------------------------------------------------------------------------------------------

SPLIT = f"split_rows as (select *, case when row_number() over (order by {sql_coin(KEY, 'split', '0', 'row_id')}, row_id) <= round_even((select count(*) from clicks) * 0.2::double, 0) then 'test' else 'train' end split from clicks)"
#: Missing, negative and unseen values, planted alike in both engines.
PLANTED = f"{CLICKS}, {SPLIT}, planted as (select row_id, split, y, user_id, case when row_id % 97 = 0 then null when row_id % 89 = 0 then -value else value end v, hour, k, case when row_id % 31 = 0 and split = 'test' then -1 else user_id end code from split_rows)"


def split_clicks(spark, d):
    return prep.exact_split(tables.clicks(spark, d), KEY)


def planted(spark, d):
    nan = F.when(F.col("row_id") % 97 == 0, F.lit(float("nan"))).when(F.col("row_id") % 89 == 0, -F.col("value")).otherwise(F.col("value"))
    code = F.when((F.col("row_id") % 31 == 0) & (F.col("split") == "test"), F.lit(-1)).otherwise(F.col("user_id"))
    return split_clicks(spark, d).select("row_id", "split", "y", "user_id", nan.alias("v"), "hour", "k", code.alias("code"))


@query("exact_split", f"with {CLICKS}, {SPLIT} select row_id, split from split_rows")
def _(spark, d):
    return split_clicks(spark, d).select("row_id", "split")


@query("three_way_split", f"""with {CLICKS}, {SPLIT}, v as (select row_id, case when split = 'test' then 'test' when row_number() over (partition by split order by {sql_coin(KEY, 'validation', '0', 'row_id')}, row_id) <= 500 then 'validation' else 'train' end split from split_rows) select row_id, split from v""")
def _(spark, d):
    return prep.three_way_split(tables.clicks(spark, d), KEY, n_validation=500).select("row_id", "split")


MED = "(select median(v) from planted where split = 'train')"


@query("median_fill", f"with {PLANTED} select row_id, split, {r(f'coalesce(v, {MED})', 'v')} from planted")
def _(spark, d):
    return prep.filled(planted(spark, d), ["v"]).select("row_id", "split", "v")


CHAIN = f"{PLANTED}, chain as (select *, ln(1 + greatest(coalesce(v, {MED}), 0)) c from planted)"


@query("clip_log1p", f"with {CHAIN} select row_id, {r('c', 'v')} from chain")
def _(spark, d):
    return prep.integer_chain(planted(spark, d), ["v"]).select("row_id", "v")


@query("standardize", f"with {CHAIN}, s as (select avg(c) m, case when stddev_pop(c) < 1e-8 then 1 else stddev_pop(c) end s from chain where split = 'train') select row_id, {r('(c - m) / s.s', 'v')} from chain, s")
def _(spark, d):
    return prep.standardized(prep.integer_chain(planted(spark, d), ["v"]), ["v"]).select("row_id", "v")


FREQ = "freq as (select code, count(*) / (select count(*) from planted where split = 'train')::double f from planted where split = 'train' group by code)"


@query("frequency_encode", f"with {PLANTED}, {FREQ} select row_id, {r('coalesce(f, 0)', 'f')} from planted left join freq using (code)")
def _(spark, d):
    return prep.frequency_encoded(planted(spark, d), "code", "f").select("row_id", "f")


VOCAB = "vocab as (select code, row_number() over (order by code) - 1 i from (select distinct code from planted where split = 'train')), hours as (select hour, row_number() over (order by hour) - 1 i from (select distinct hour from planted where split = 'train'))"
SIZES = "(select count(*) from vocab)"


@query("vocab_index", f"with {PLANTED}, {VOCAB} select row_id, i::bigint as \"index\", i is not null seen from planted left join vocab using (code)")
def _(spark, d):
    return prep.vocab_index(planted(spark, d), "code").select("row_id", "index", "seen")


INDEXED = f"{CHAIN}, {VOCAB}, indexed as (select row_id, split, y, c, k, (3 + coalesce(vocab.i, {SIZES}))::bigint code_idx, (3 + {SIZES} + 1 + coalesce(hours.i, (select count(*) from hours)))::bigint hour_idx from chain left join vocab using (code) left join hours on hours.hour = chain.hour)"


def indexed(spark, d):
    return prep.one_hot_index(prep.integer_chain(planted(spark, d), ["v"]), ["code", "hour"], 3)


@query("one_hot_index", f"with {INDEXED} select row_id, code_idx, hour_idx from indexed")
def _(spark, d):
    return indexed(spark, d)[0].select("row_id", "code_idx", "hour_idx")


@query("one_hot_offsets", f"with {PLANTED}, {VOCAB} select 'code' as column_name, 3::bigint as first_index, {SIZES} as n_codes union all select 'hour', 3 + {SIZES} + 1, (select count(*) from hours)")
def _(spark, d):
    return spark.createDataFrame([(c, a, n) for c, (a, n) in indexed(spark, d)[1].items()], "column_name string, first_index long, n_codes long")


@query("sparse_rows", f"with {INDEXED}, long as (select row_id, unnest([0, 1, 2, code_idx, hour_idx]) idx, unnest([c, k, 1.0::double, 1.0::double, 1.0::double]) val from indexed) select row_id, idx, {r('val', 'val')} from long")
def _(spark, d):
    rows = prep.sparse_rows(indexed(spark, d)[0].withColumn("one", F.lit(1.0)), ["v", "k", "one"], ["code", "hour"])
    return rows.select("row_id", F.inline(F.arrays_zip("idx", "val")))


@query("one_hot_distinct", f"with {INDEXED} select count(*) n, count(*) filter (code_idx < hour_idx and code_idx >= 3) fine from indexed")
def _(spark, d):
    rows = prep.sparse_rows(indexed(spark, d)[0].withColumn("one", F.lit(1.0)), ["v", "k", "one"], ["code", "hour"])
    return rows.agg(F.count("*").alias("n"), F.count_if(F.size(F.array_distinct("idx")) == 5).alias("fine"))


CAP = f"{CHAIN}, capped as (select row_id, split, y, c, hour / 24.0::double h, k / 100.0::double kk, greatest(1.0::double, sqrt(c * c + (hour / 24.0::double) * (hour / 24.0::double) + (k / 100.0::double) * (k / 100.0::double)) / 2.0::double) s from chain)"


@query("norm_cap", f"with {CAP} select row_id, {r('c / s', 'x0')}, {r('h / s', 'x1')}, {r('kk / s', 'x2')} from capped")
def _(spark, d):
    x = prep.integer_chain(planted(spark, d), ["v"]).withColumn("x", F.array("v", F.col("hour") / 24.0, F.col("k") / 100.0))
    return prep.norm_capped(x, 2.0).select("row_id", *[F.col("x")[i].alias(f"x{i}") for i in range(3)])


@query("dense_split", f"with {CHAIN} select row_id, split, {r('c', 'v')}, {r('hour', 'hour')}, {r('k', 'k')}, y::bigint y from chain")
def _(spark, d):
    return prep.integer_chain(planted(spark, d), ["v"]).select("row_id", "split", "v", "hour", "k", "y")


@query("unseen_categories", f"with {PLANTED} select distinct code from planted where split = 'test' and code not in (select code from planted where split = 'train')")
def _(spark, d):
    return prep.unseen_categories(planted(spark, d), "code")


def load(spark, d, features: str = "all", prepared: bool = True, standard: bool = False, bound: float | None = None) -> DataFrame:
    return loaders.load(planted(spark, d), ["v", "hour", "k"], ["code"], features=features, prepared=prepared, standard=standard, bound=bound).rows.withColumnsRenamed({"f_code": "f"})


def load_sql(features: str, prepared: bool, standard: bool, bound: float | None) -> str:
    cols = ["v", "hour", "k"] + ["f"] * (features == "all")
    med = lambda c: f"ln(1 + greatest(coalesce({c}, (select median({c}) from planted where split = 'train')), 0)) as {c}"
    base = ", ".join(med(c) if prepared else c for c in cols[:3]) + (", " + ("coalesce(f, 0) f" if prepared else "code::double f") if features == "all" else "")
    sql = f"with {PLANTED}, {FREQ}, l0 as (select row_id, split, y, {base} from planted left join freq using (code))"
    sql += f", l1 as (select row_id, split, y, {', '.join(f'({c} - m_{c}) / s_{c} as {c}' if standard else c for c in cols)} from l0" + (f", (select {', '.join(f'avg({c}) m_{c}, case when stddev_pop({c}) < 1e-8 then 1 else stddev_pop({c}) end s_{c}' for c in cols)} from l0 where split = 'train')" if standard else "") + ")"
    scale = f"greatest(1.0::double, sqrt({' + '.join(f'{c} * {c}' for c in cols)}) / {bound}::double)" if bound else "1.0::double"
    return sql + f" select row_id, split, y::bigint y, {', '.join(r(f'{c} / {scale}', c) for c in cols)} from l1"


for _f in ("numeric", "all"):
    for _label, _args in {"raw": (False, False, None), "prepared": (True, False, None), "standard": (True, True, None), "capped": (True, True, 1.5)}.items():
        SQL[f"load_{_f}_{_label}"] = load_sql(_f, *_args)
        QUERIES[f"load_{_f}_{_label}"] = lambda spark, d, f=_f, a=_args: rounded(load(spark, d, f, *a))


# --- models, gradients, clipping, aggregation --------------------------------------------------------------------------

XS = tables.CLICK_FEATURES
W = stages.Linear((0.3, -0.7, 0.9), -0.2)
Z = "(0.3::double * x1 + -0.7::double * x2 + 0.9::double * x3 + -0.2::double)"
RES = f"(1.0 / (1.0 + exp(-{Z})) - y)"
NORM = "sqrt(x1 * x1 + x2 * x2 + x3 * x3 + 1.0)"
CLIPPED = "least(1.0, 0.5::double / (abs(r) * nx + 1e-12))"
GRADS = f"{CLICKS}, g0 as (select *, {Z} z, {RES} r, {NORM} nx from clicks), grads as (select *, abs(r) * nx norm, r * {CLIPPED} kk from g0)"
LOGISTIC = stages.Logistic()


def sums_sql(k: str = "kk", where: str = "", prefix: str = "g", after: str = "") -> str:
    f = f" filter (where {where})" if where else ""
    return ", ".join(r(f"coalesce(sum({k} * {x}){f}, 0){after}", f"{prefix}_{x}") for x in XS) + ", " + r(f"coalesce(sum({k}){f}, 0){after}", f"{prefix}_b")


def click_rows(spark, d):
    return tables.click_features(spark, d)


def click_grads(spark, d, clip=0.5, loss=LOGISTIC):
    return stages.gradients(click_rows(spark, d), loss, W, XS, clip)


@query("logit_dense", f"with {GRADS} select row_id, {r('z', 'z')} from grads")
def _(spark, d):
    return click_rows(spark, d).select("row_id", stages.logit(W, XS).alias("z"))


@query("logit_sparse", f"with {INDEXED} select row_id, {r('0.01 * c + 0.02 * k + 0.03 + 0.01 * (code_idx + 1) + 0.01 * (hour_idx + 1) - 1.0', 'z')} from indexed")
def _(spark, d):
    rows, layout = indexed(spark, d)
    width = sum(n + 1 for _, n in layout.values()) + 3
    rows = prep.sparse_rows(rows.withColumn("one", F.lit(1.0)), ["v", "k", "one"], ["code", "hour"])
    return stages.sparse_logits(rows.select("row_id", "idx", "val"), stages.SparseLinear(0.01 * (np.arange(width) + 1), -1.0)).select("row_id", "z")


BCE = "greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))"


@query("bce_stable", f"with {GRADS} select row_id, {r(BCE, 'loss')} from grads")
def _(spark, d):
    return click_rows(spark, d).select("row_id", LOGISTIC.value(stages.logit(W, XS), F.col("y")).alias("loss"))


@query("batch_bce", f"with {GRADS} select {r(f'avg({BCE})', 'loss')} from grads")
def _(spark, d):
    return click_rows(spark, d).agg(F.avg(LOGISTIC.value(stages.logit(W, XS), F.col("y"))).alias("loss"))


@query("grad_squared_error", f"with {GRADS} select row_id, {r('z - y', 'g_b')}, {r('(z - y) * x1', 'g_x1')}, {r('0.5 * (z - y) * (z - y)', 'loss')} from grads")
def _(spark, d):
    s = stages.Squared()
    return click_grads(spark, d, None, s).select("row_id", F.col("r").alias("g_b"), (F.col("r") * F.col("x1")).alias("g_x1"), s.value(stages.logit(W, XS), F.col("y")).alias("loss"))


@query("per_sample_grads", f"with {GRADS} select row_id, {', '.join(r(f'r * {x}', f'g_{x}') for x in XS)}, {r('r', 'g_b')} from grads")
def _(spark, d):
    return click_grads(spark, d).select("row_id", *[(F.col("r") * F.col(x)).alias(f"g_{x}") for x in XS], F.col("r").alias("g_b"))


@query("per_sample_norms", f"with {GRADS} select row_id, {r('norm', 'norm')} from grads")
def _(spark, d):
    return click_grads(spark, d).select("row_id", "norm")


@query("per_sample_clip", f"with {GRADS} select row_id, {', '.join(r(f'kk * {x}', f'g_{x}') for x in XS)}, {r('kk', 'g_b')} from grads")
def _(spark, d):
    return click_grads(spark, d).select("row_id", *[(F.col("k") * F.col(x)).alias(f"g_{x}") for x in XS], F.col("k").alias("g_b"))


@query("batch_grad", f"with {GRADS} select {sums_sql('r', after=' / count(*)')} from grads")
def _(spark, d):
    g = click_grads(spark, d, None)
    return g.agg(*stages.summed(g, XS), F.count("*").alias("n")).select(*[(F.col(f"g_{c}") / F.col("n")).alias(f"g_{c}") for c in (*XS, "b")])


LINE_Z = "(0.4::double * x1 + -3.0::double * x2 + 2.5::double * x3 + 0.5::double * x4 + -1.0::double)"
LINE_GRADS = f"{LINES}, lg as (select *, 1.0 / (1.0 + exp(-{LINE_Z})) - y r, sqrt(x1 * x1 + x2 * x2 + x3 * x3 + x4 * x4 + 1.0) nx from lines), lk as (select *, r * least(1.0, 0.5::double / (abs(r) * nx + 1e-12)) kk from lg)"


@query("batch_grad_lines", f"with {LINE_GRADS} select " + ", ".join(r(f"sum(kk * {c}) / count(*)", f"g_{c}") for c in ("x1", "x2", "x3", "x4")) + f", {r('sum(kk) / count(*)', 'g_b')} from lk")
def _(spark, d):
    g = stages.gradients(tables.lines(spark, d), LOGISTIC, tables.LINE_MODEL, tables.LINE_FEATURES, 0.5)
    names = (*tables.LINE_FEATURES, "b")
    return g.agg(*stages.summed(g, tables.LINE_FEATURES), F.count("*").alias("n")).select(*[(F.col(f"g_{c}") / F.col("n")).alias(f"g_{c}") for c in names])


@query("masked_sum", f"with {GRADS} select {sums_sql(where='row_id % 3 = 0')} from grads")
def _(spark, d):
    g = click_grads(spark, d)
    return g.agg(*stages.summed(g, XS, where=F.col("row_id") % 3 == 0))


@query("fixed_divisor_mean", f"with {GRADS} select {sums_sql(where='row_id % 3 = 0', after=' / 1000.0::double')} from grads")
def _(spark, d):
    g = click_grads(spark, d)
    return g.agg(*stages.summed(g, XS, where=F.col("row_id") % 3 == 0)).select(*[(F.col(f"g_{c}") / 1000.0).alias(f"g_{c}") for c in (*XS, "b")])


@query("sparse_gradient", f"with {INDEXED}, rr as (select *, 1.0 / (1.0 + exp(-(c - 1.0))) - y k1 from indexed), long as (select k1, unnest([0, 1, 2, code_idx, hour_idx]) idx, unnest([c, k, 1.0::double, 1.0::double, 1.0::double]) val from rr) select idx, {r('sum(k1 * val)', 'g')} from long group by idx")
def _(spark, d):
    rows = prep.sparse_rows(indexed(spark, d)[0].withColumn("one", F.lit(1.0)), ["v", "k", "one"], ["code", "hour"])
    return stages.sparse_sums(rows.withColumn("r1", stages.sigmoid(F.col("v") - 1.0) - F.col("y")), "r1")


#: Rows of load_one_hot: numbers v and k prepared, ones for code and hour, capped at norm 1.2; fixed weights by index.
ONE_HOT = f"{INDEXED}, kmed as (select median(k) m from planted where split = 'train'), oh as (select row_id, split, y, c, ln(1 + greatest(coalesce(k, m), 0)) lk, code_idx - 1 code_idx, hour_idx - 1 hour_idx from indexed, kmed)"
CAPPED = f"{ONE_HOT}, sp as (select *, greatest(1.0::double, sqrt(c * c + lk * lk + 2.0) / 1.2::double) cap from oh)"
SPARSE_Z = "((0.05::double * cos(0.0::double) * c + 0.05::double * cos(1.0::double) * lk + 0.05::double * cos(code_idx::double) + 0.05::double * cos(hour_idx::double)) / cap - 0.3::double)"
SPARSE_G = f"{CAPPED}, sz as (select *, {SPARSE_Z} z, sqrt((c * c + lk * lk + 2.0) / (cap * cap) + 1.0) nx from sp where split = 'train'), sg as (select *, 1.0 / (1.0 + exp(-z)) - y r from sz), sn as (select *, abs(r) * nx norm, r * least(1.0, 0.5::double / (abs(r) * nx + 1e-12)) kk from sg)"
SPARSE_DRAWN = f"row_id in (select row_id from clicks where {sql_coin(KEY, 'poisson', '1', 'row_id')} < 0.1)"
SPARSE_LONG = f"lg as (select kk, unnest([0, 1, code_idx, hour_idx, -1]) idx, unnest([c / cap, lk / cap, 1.0::double / cap, 1.0::double / cap, 1.0::double]) val from sn where {SPARSE_DRAWN}), tot as (select idx, sum(kk * val) g from lg group by idx)"


def one_hot(spark, d, bound: float | None = 1.2) -> loaders.SparseSplit:
    return loaders.load_one_hot(planted(spark, d), ["v", "k"], ["code", "hour"], bound=bound)


def sparse_model(split: loaders.SparseSplit) -> stages.SparseLinear:
    return stages.SparseLinear(0.05 * np.cos(np.arange(split.width)), -0.3)


@query("load_one_hot_capped", f"with {CAPPED}, long as (select row_id, split, y, unnest([0, 1, code_idx, hour_idx]) idx, unnest([c, lk, 1.0::double, 1.0::double]) / cap val from sp) select row_id, split, y::bigint y, idx::bigint idx, {r('val', 'val')} from long")
def _(spark, d):
    return one_hot(spark, d).rows.select("row_id", "split", "y", F.inline(F.arrays_zip("idx", "val")))


@query("load_one_hot_raw", f"with {ONE_HOT}, raw as (select oh.row_id, v, planted.k, code_idx, hour_idx from oh join planted using (row_id)), long as (select row_id, unnest([0, 1, code_idx, hour_idx]) idx, unnest([v, k, 1.0::double, 1.0::double]) val from raw) select row_id, idx::bigint idx, {r('val', 'val')} from long")
def _(spark, d):
    return loaders.load_one_hot(planted(spark, d), ["v", "k"], ["code", "hour"], prepared=False).rows.select("row_id", F.inline(F.arrays_zip("idx", "val")))


@query("sparse_norms", f"with {SPARSE_G} select row_id, {r('norm', 'norm')}, {r('kk', 'k')} from sn")
def _(spark, d):
    split = one_hot(spark, d)
    return stages.sparse_gradients(split.train, LOGISTIC, sparse_model(split), 0.5).select("row_id", "norm", "k")


def sparse_released(spark, d) -> tuple[loaders.SparseSplit, DataFrame]:
    """(idx, g) of one private release: noise for every index, drawn or not; the bias is at -1."""
    split = one_hot(spark, d)
    g = stages.sparse_gradients(sampling.poisson_batch(split.train, 0.1, KEY, 1), LOGISTIC, sparse_model(split), 0.5)
    sums = stages.sparse_sums(g.withColumns({"idx": F.concat("idx", F.array(F.lit(-1))), "val": F.concat("val", F.array(F.lit(1.0)))}))
    every = spark.range(-1, split.width).select(F.col("id").cast("int").alias("idx"))
    noise = F.lit(0.55) * coins.gaussian(KEY, "noise", 1, F.col("idx"))
    return split, every.join(sums, "idx", "left").select("idx", ((F.coalesce("g", F.lit(0.0)) + noise) / 1000.0).alias("g"))


EVERY = "every as (select i::bigint idx from range(-1, (select 2 + (select count(*) from vocab) + 1 + (select count(*) from hours) + 1)) t(i))"
SPARSE_REL = f"{EVERY}, rel as (select idx, (coalesce(g, 0) + 0.55::double * {sql_gaussian(KEY, 'noise', '1', 'idx')}) / 1000.0::double g from every left join tot using (idx))"


@query("sparse_release", f"with {SPARSE_G}, {SPARSE_LONG}, {SPARSE_REL} select idx, {r('g', 'g')} from rel")
def _(spark, d):
    return sparse_released(spark, d)[1]


@query("sparse_dp_sgd_step", f"with {SPARSE_G}, {SPARSE_LONG}, {SPARSE_REL} select idx, {r('case when idx < 0 then -0.3::double else 0.05::double * cos(idx::double) end - 0.5 * g', 'value')} from rel")
def _(spark, d):
    split, g = sparse_released(spark, d)
    model, o = sparse_model(split), updates.Sgd(0.5)
    got = g.toArrow()  # one row for each index
    estimate = np.zeros(split.width + 1)
    estimate[got.column("idx").to_numpy()] = got.column("g").to_numpy()
    inc, _ = o.update(estimate, o.init(model.vector))
    v = model.vector + inc
    return spark.createDataFrame([(i if i < split.width else -1, float(x)) for i, x in enumerate(v)], "idx long, value double")


@query("grad_norm_probe", f"with {GRADS} select {r('quantile_cont(norm, 0.5)', 'median')}, {r('quantile_cont(norm, 0.99)', 'p99')}, {r('max(norm)', 'largest')} from grads")
def _(spark, d):
    at = order.quantiles(click_grads(spark, d), "norm", [0.5, 0.99, 1.0])
    return spark.createDataFrame([tuple(at)], "median double, p99 double, largest double")


@query("norms_docs", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))), 5) + 0.0::double as norm from embeddings")
def _(spark, d):
    return rounded(tables.scan(spark, f"{d}/embeddings.parquet", ["vec_id", "embedding"]).select("vec_id", prep.l2(F.col("embedding").cast("array<double>")).alias("norm")), 5)


# --- sampling ---------------------------------------------------------------------------------------------------------

ORDERS = "o as (select o_orderkey row_id from orders)"


def order_rows(spark, d):
    return tables.scan(spark, f"{d}/orders.parquet", ["o_orderkey"]).select(F.col("o_orderkey").alias("row_id"))


@query("poisson_batch", f"with {ORDERS} select row_id from o where {sql_coin(KEY, 'poisson', '3', 'row_id')} < 0.1")
def _(spark, d):
    rows = order_rows(spark, d)
    n = rows.count()
    return sampling.poisson_batch(rows, 0.1, KEY, 3, cap=sampling.poisson_cap(0.1 * n, n))


@query("poisson_truncated_batch", f"with {ORDERS} select row_id from o where {sql_coin(KEY, 'poisson', '3', 'row_id')} < 0.1 order by {sql_coin(KEY, 'truncate', '3', 'row_id')}, row_id limit 100")
def _(spark, d):
    return sampling.poisson_truncated_batch(order_rows(spark, d), 0.1, 100, KEY, 3)


@query("dyadic_pmf", f"select i::bigint as scale, {r('1 / (2 * (1 - pow(2.0, -11))) / pow(2.0, i)', 'probability')} from range(11) t(i)")
def _(spark, d):
    return sampling.dyadic_pmf(spark.range(0), 10)


@query("dyadic_scale_draw", f"with {ORDERS}, pmf as (select i, 1 / (2 * (1 - pow(2.0, -11))) / pow(2.0, i) p from range(11) t(i)), cum as (select i, sum(p) over (order by i) hi, sum(p) over (order by i) - p lo from pmf), u as (select row_id, {sql_coin(KEY, 'scale', '0', 'row_id')} u from o) select row_id, coalesce(i, 10)::bigint as scale from u left join cum on u >= lo and u < hi")
def _(spark, d):
    top, steps, total = 10, [], 0.0
    for p in sampling.dyadic_probabilities(top):
        total += p
        steps.append(total)
    u = coins.coin(KEY, "scale", 0, F.col("row_id"))
    return order_rows(spark, d).select("row_id", F.least(F.lit(top), F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda e: e <= u))).alias("scale"))


@query("dyadic_batch", f"""with {ORDERS}, c as (select row_id, row_number() over (order by {sql_coin(KEY, 'dyadic', '0', 'row_id')}, row_id) n from o)
select row_id, case when n <= 32 then 'odd' else 'even' end half from c where n <= 64 union all select * from (select row_id, 'single' from o order by {sql_coin(KEY, 'single', '0', 'row_id')}, row_id limit 1)""")
def _(spark, d):
    return sampling.dyadic_batch(order_rows(spark, d), 5, KEY, 0)


@query("epoch_batches", f"with {ORDERS}, c as (select row_id, (row_number() over (order by {sql_coin(KEY, 'epoch', '2', 'row_id')}, row_id) - 1) // 64 b from o) select row_id, b::bigint batch_id from c where b < (select count(*) from o) // 64")
def _(spark, d):
    return sampling.epoch_batches(order_rows(spark, d), 64, KEY, 2)


@query("ladder_mean_batch", f"select {r('sum(1 / (2 * (1 - pow(2.0, -11))) / pow(2.0, i) * pow(2.0, i + 1))', 'mean_batch')} from range(11) t(i)")
def _(spark, d):
    return sampling.dyadic_pmf(spark.range(0), 10).agg(F.sum(F.col("probability") * F.pow(F.lit(2.0), F.col("scale") + 1)).alias("mean_batch"))


LEAVES = "leaves as (select 'w' leaf, i, sin(i + 1.0)::double as value from range(40) t(i) union all select 'b', 0, 0.25::double)"


def leaves(spark):
    w = spark.range(40).select(F.lit("w").alias("leaf"), F.col("id").alias("i"), F.sin(F.col("id") + 1.0).alias("value"))
    return w.unionByName(spark.range(1).select(F.lit("b").alias("leaf"), F.lit(0).cast("long").alias("i"), F.lit(0.25).alias("value")))


@query("gaussian_noise", f"""with {LEAVES} select leaf, i, {r(f"value + 0.7::double * {sql_gaussian(KEY, 'gaussian', '1', "concat_ws('/', leaf, i)")}", 'value')} from leaves""")
def _(spark, d):
    return stages.noised(leaves(spark), KEY, 1, 0.7)


@query("laplace_noise", f"""with {LEAVES} select leaf, i, {r(f"value + 0.7::double * {sql_laplace(KEY, 'laplace', '1', "concat_ws('/', leaf, i)")}", 'value')} from leaves""")
def _(spark, d):
    return stages.noised(leaves(spark), KEY, 1, 0.7, "laplace")


# --- vectors, projections, updates --------------------------------------------------------------------------------------


@query("global_norm", f"with {LEAVES} select {r('sqrt(sum(value * value))', 'norm')} from leaves")
def _(spark, d):
    return leaves(spark).agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"))


@query("param_norms", f"with {LEAVES} select {r('sum(abs(value))', 'l1')}, count(*) filter (value <> 0) nonzero from leaves")
def _(spark, d):
    return leaves(spark).agg(F.sum(F.abs("value")).alias("l1"), F.count_if(F.col("value") != 0).alias("nonzero"))


def projection_sql(source: str, by: str, radius: str) -> str:
    p = f"partition by {by} " if by else ""
    return f"""pk as (select *, row_number() over ({p}order by abs(value) desc, i) k, sum(abs(value)) over ({p}order by abs(value) desc, i rows unbounded preceding) - {radius} ex, sum(abs(value)) over ({p}) l1 from {source}),
pr as (select *, greatest(1, sum((abs(value) * k > ex)::int) over ({p})) rho from pk), pt as (select *, max(case when k = rho then greatest(ex / rho, 0) end) over ({p}) theta from pr),
projected as (select *, case when l1 <= {radius} then value else sign(value) * greatest(abs(value) - theta, 0) end v from pt)"""




@query("l1_projection", f"with emb as (select vec_id, generate_subscripts(embedding, 1) - 1 i, unnest(embedding)::double as value from embeddings), {projection_sql('emb', 'vec_id', '2.0::double')} select vec_id, i::bigint i, round(v, 5) + 0.0::double as value from projected")
def _(spark, d):
    long = tables.scan(spark, f"{d}/embeddings.parquet", ["vec_id", "embedding"]).select("vec_id", F.posexplode("embedding").alias("i", "value")).withColumn("value", F.col("value").cast("double"))
    return rounded(updates.l1_projected(long, 2.0, ["vec_id"]), 5)


@query("l1_projection_global", f"with {LEAVES}, {projection_sql('leaves', '', '3.0::double')} select leaf, i, {r('v', 'value')} from projected")
def _(spark, d):
    return updates.l1_projected(leaves(spark), 3.0)


MEAN_G = "mg as (select avg(r * x1) g1, avg(r * x2) g2, avg(r * x3) g3, avg(r) gb from grads)"
PLAIN = [("x1", 0.3, "g1"), ("x2", -0.7, "g2"), ("x3", 0.9, "g3"), ("b", -0.2, "gb")]
NAMES = (*XS, "b")


def as_rows(spark, v):
    return spark.createDataFrame([(n, float(x)) for n, x in zip(NAMES, v, strict=True)], "name string, value double")


def stepped(spark, d, optimizer, clip=None):
    g = stages.gradient_sum(rows := click_rows(spark, d), LOGISTIC, W, XS, clip) / rows.count()
    inc, _ = optimizer.update(g, optimizer.init(W.vector), W.vector)
    return as_rows(spark, W.vector + inc)


@query("sgd_step", f"with {GRADS}, {MEAN_G} " + " union all ".join(f"select '{n}' as name, {r(f'{w}::double - 0.5 * {g}', 'value')} from mg" for n, w, g in PLAIN))
def _(spark, d):
    return stepped(spark, d, updates.Sgd(0.5))


@query("l1_projected_step", f"with {GRADS}, {MEAN_G}, vs as (" + " union all ".join(f"select '{n}' as name, {i} i, {w}::double - 0.5 * {g} as value from mg" for i, (n, w, g) in enumerate(PLAIN)) + f"), {projection_sql('vs', '', '1.5::double')} select name, {r('v', 'value')} from projected")
def _(spark, d):
    return stepped(spark, d, updates.L1Projected(updates.Sgd(0.5), 1.5))


@query("l1_estimate_step", f"with {GRADS}, {MEAN_G}, vs as (" + " union all ".join(f"select '{n}' as name, {i} i, {w}::double as w, {g} as value from mg" for i, (n, w, g) in enumerate(PLAIN)) + f"), {projection_sql('vs', '', '0.3::double')} select name, {r('w - 0.5 * v', 'value')} from projected")
def _(spark, d):
    return stepped(spark, d, updates.L1ProjectedEstimate(updates.Sgd(0.5), 0.3))


# --- releases and steps --------------------------------------------------------------------------------------------------

DRAWN = f"row_id in (select row_id from clicks where {sql_coin(KEY, 'poisson', '1', 'row_id')} < 0.1)"


def coin_noise(c: str) -> str:
    return sql_gaussian(KEY, "noise", "1", f"'{c}'")


def released(spark, d, clip=0.5, multiplier=1.1, divisor=1000.0) -> DataFrame:
    g = stages.gradients(sampling.poisson_batch(click_rows(spark, d), 0.1, KEY, 1), LOGISTIC, W, XS, clip)
    one = g.agg(*stages.summed(g, XS))
    return one.select(*[((F.coalesce(f"g_{c}", F.lit(0.0)) + F.lit(multiplier * clip) * coins.gaussian(KEY, "noise", 1, F.lit(c))) / divisor).alias(f"g_{c}") for c in NAMES])


RELEASE = ", ".join(f"(coalesce(sum(kk * {c}), 0) + 0.55::double * {coin_noise(c)}) / 1000.0::double as g_{c}" for c in XS) + f", (coalesce(sum(kk), 0) + 0.55::double * {coin_noise('b')}) / 1000.0::double as g_b"


@query("dp_sgd_release", f"with {GRADS}, rel as (select {RELEASE} from grads where {DRAWN}) select {', '.join(r(f'g_{c}', f'g_{c}') for c in NAMES)} from rel")
def _(spark, d):
    return released(spark, d)


@query("dp_sgd_step", f"with {GRADS}, rel as (select {RELEASE} from grads where {DRAWN}) " + " union all ".join(f"select '{n}' as name, {r(f'{w}::double - 0.5 * g_{n}', 'value')} from rel" for n, w, _ in PLAIN))
def _(spark, d):
    o = updates.Sgd(0.5)
    inc, _ = o.update(stages.vector(released(spark, d)), o.init(W.vector))
    return as_rows(spark, W.vector + inc)


ANCHOR = ", ".join(f"coalesce(sum(r * {c}), 0) / 1000.0::double + 0.01::double * {coin_noise(c)} as g_{c}" for c in XS) + f", coalesce(sum(r), 0) / 1000.0::double + 0.01::double * {coin_noise('b')} as g_b"


def anchored(spark, d) -> DataFrame:
    g = stages.gradients(sampling.poisson_batch(click_rows(spark, d), 0.1, KEY, 1), LOGISTIC, W, XS)
    return g.agg(*stages.summed(g, XS)).select(*[(F.coalesce(f"g_{c}", F.lit(0.0)) / 1000.0 + 0.01 * coins.gaussian(KEY, "noise", 1, F.lit(c))).alias(f"g_{c}") for c in NAMES])


@query("spider_anchor", f"with {GRADS}, rel as (select {ANCHOR} from grads where {DRAWN}) select {', '.join(r(f'g_{c}', f'g_{c}') for c in NAMES)} from rel")
def _(spark, d):
    return anchored(spark, d)


NEXT = stages.Linear((0.25, -0.65, 0.8), -0.15)
Z2 = "(0.25::double * x1 + -0.65::double * x2 + 0.8::double * x3 + -0.15::double)"
DIFF = f"(1.0 / (1.0 + exp(-{Z2})) - 1.0 / (1.0 + exp(-z)))"
MOVED = "sqrt(0.05::double * 0.05 + 0.05::double * 0.05 + 0.1::double * 0.1 + 0.05::double * 0.05)"
STD = f"least(0.1::double * {MOVED}, 0.5)"


def varied(spark, d, now=NEXT, before=W) -> DataFrame:
    drawn = sampling.poisson_batch(click_rows(spark, d), 0.1, KEY, 1)
    std = min(0.1 * float(np.linalg.norm(now.vector - before.vector)), 0.5)
    return drawn.agg(*stages.two_point_sums(drawn, LOGISTIC, now, before, XS)).select(*[(F.coalesce(f"g_{c}", F.lit(0.0)) / 1000.0 + F.lit(std) * coins.gaussian(KEY, "noise", 1, F.lit(c))).alias(f"g_{c}") for c in NAMES])


@query("spider_variation", f"with {GRADS}, df as (select *, {DIFF} dr from grads where {DRAWN}) select {', '.join(r(f'coalesce(sum(dr * {c}), 0) / 1000.0::double + {STD} * {coin_noise(c)}', f'g_{c}') for c in XS)}, {r(f'coalesce(sum(dr), 0) / 1000.0::double + {STD} * {coin_noise(chr(98))}', 'g_b')} from df")
def _(spark, d):
    return varied(spark, d)


_W1 = {n: f"({w}::double - 0.5 * g_{n})" for n, w, _ in PLAIN}
_Z1 = f"({_W1['x1']} * x1 + {_W1['x2']} * x2 + {_W1['x3']} * x3 + {_W1['b']})"


@query("spider_two_steps", f"""with {GRADS}, rel as (select {ANCHOR} from grads where {DRAWN}), mv as (select sqrt({' + '.join(f'0.25 * g_{n} * g_{n}' for n in NAMES)}) dist from rel),
dd as (select x1, x2, x3, 1.0 / (1.0 + exp(-{_Z1})) - 1.0 / (1.0 + exp(-z)) dr from grads, rel where {DRAWN}), vr as (select {', '.join(f'coalesce(sum(dr * {c}), 0) / 1000.0::double as v_{c}' for c in XS)}, coalesce(sum(dr), 0) / 1000.0::double v_b from dd) """ + " union all ".join(f"select '{n}' as name, {r(f'{_W1[n]} - 0.5 * (g_{n} + v_{n} + least(0.1::double * dist, 0.5) * {coin_noise(n)})', 'value')} from rel, mv, vr" for n in NAMES))
def _(spark, d):
    o, v = updates.Sgd(0.5), W.vector
    g = stages.vector(anchored(spark, d))
    inc, state = o.update(g, o.init(v))
    w1 = v + inc
    e = g + stages.vector(varied(spark, d, stages.Linear.of(w1), W))
    inc, _ = o.update(e, state)
    return as_rows(spark, w1 + inc)


DY = f"dy as (select row_id, n from (select row_id, row_number() over (order by {sql_coin(KEY, 'dyadic', '0', 'row_id')}, row_id) n from clicks) where n <= 64), sg as (select row_id from clicks order by {sql_coin(KEY, 'single', '0', 'row_id')}, row_id limit 1)"
TRIPLE = ", ".join([sums_sql(where="n <= 64", prefix="whole"), sums_sql(where="n <= 32", prefix="odd"), sums_sql(where="n > 32", prefix="even")])


def dyadic_sums(spark, d):
    return training.dyadic_sums(sampling.dyadic_batch(click_rows(spark, d), 5, KEY, 0), LOGISTIC, W, XS, 0.5)


@query("dyadic_triplet", f"with {GRADS}, {DY} select {TRIPLE} from grads join dy using (row_id)")
def _(spark, d):
    s = dyadic_sums(spark, d)
    return s.select(*[c for c in s.columns if not c.startswith("single")])


@query("dyadic_single", f"with {GRADS}, {DY} select {sums_sql(prefix='single')} from grads join sg using (row_id)")
def _(spark, d):
    s = dyadic_sums(spark, d)
    return s.select(*[c for c in s.columns if c.startswith("single")])


_P5 = "(1 / (2 * (1 - pow(2.0, -11))) / 32)"


@query("debiased_gradient", f"with {GRADS}, {DY}, a as (select " + ", ".join(f"sum(kk{x}) / 64 w_{c}, sum(kk{x}) filter (where n <= 32) / 32 o_{c}, sum(kk{x}) filter (where n > 32) / 32 e_{c}" for c, x in [*((c, f" * {c}") for c in XS), ("b", "")]) + " from grads join dy using (row_id)), s as (select " + ", ".join(f"sum(kk{x}) s_{c}" for c, x in [*((c, f" * {c}") for c in XS), ("b", "")]) + " from grads join sg using (row_id)) " + " union all ".join(f"select '{c}' as name, {r(f'(w_{c} - (o_{c} + e_{c}) / 2) / {_P5} + s_{c}', 'value', 5)} from a, s" for c in NAMES))
def _(spark, d):
    s = stages.vector(dyadic_sums(spark, d)).reshape(4, -1)
    v = training.debiased(s[0] / 64, s[1] / 32, s[2] / 32, s[3], sampling.dyadic_probabilities(10)[5])
    return rounded(as_rows(spark, v), 5)


# Whole training runs: in SQL each step is a link of a chain, p0, p1, ... holding the parameters.

PAIRS = [*((f"w_{c}", c) for c in XS), ("w_b", "")]
START = "p0 as (select 0.3::double w_x1, -0.7::double w_x2, 0.9::double w_x3, -0.2::double w_b)"
N_ROWS = "(select count(*) from clicks)"


def residual_sql(p: str = "") -> str:
    return f"(1.0 / (1.0 + exp(-({p}w_x1 * x1 + {p}w_x2 * x2 + {p}w_x3 * x3 + {p}w_b))) - y)"


def sums_of(k: str, suffix: str = "", where: str = "") -> str:
    f = f" filter (where {where})" if where else ""
    return ", ".join(f"coalesce(sum({k}{' * ' + x if x else ''}){f}, 0) g{suffix}_{w[2:]}" for w, x in PAIRS)


def moved(t: int, estimate, rate: float, source: str) -> str:
    return f"p{t + 1} as (select {', '.join(f'{w} - {rate}::double * ({estimate(w[2:])}) as {w}' for w, _ in PAIRS)} from p{t}, {source})"


def final_sql(p: str) -> str:
    return " union all ".join(f"select '{w[2:]}' as name, {r(w, 'value')} from {p}" for w, _ in PAIRS)


def noise_sql(draw: int, c: str) -> str:
    return sql_gaussian(KEY, "noise", str(draw), str(NAMES.index(c)))


def epoch_sql(steps: int) -> str:
    """Four batches an epoch, which holds from 16 rows on."""
    out = [CLICKS, START, f"size as (select {N_ROWS} // 4 q)"]
    for e in range(-(-steps // 4)):
        out.append(f"e{e} as (select row_id, y, x1, x2, x3, (row_number() over (order by {sql_coin(KEY, 'epoch', str(e), 'row_id')}, row_id) - 1) // q b from clicks, size)")
    for t in range(steps):
        out.append(f"s{t} as (select {sums_of('r')} from (select *, {residual_sql()} r from e{t // 4}, p{t} where b = {t % 4}))")
        out.append(moved(t, lambda c: f"g_{c} / q", 0.5, f"s{t}, size"))
    return f"with {', '.join(out)} {final_sql(f'p{steps}')}"


@query("sgd_epoch", epoch_sql(6))
def _(spark, d):
    rows = click_rows(spark, d)
    # Four batches an epoch, so the second one begins at any size of the table.
    return as_rows(spark, training.sgd_train(LOGISTIC, W, updates.Sgd(0.5), rows, XS, steps=6, batch=max(1, rows.count() // 4), key=KEY).vector)


def dp_sgd_sql(steps: int, expected: int, clip: float, multiplier: float) -> str:
    out = [CLICKS, START]
    for t in range(steps):
        drawn = f"{sql_coin(KEY, 'poisson', str(t), 'row_id')} < {expected}.0::double / {N_ROWS}"
        out.append(f"r{t} as (select *, {residual_sql()} r from clicks, p{t} where {drawn})")
        out.append(f"s{t} as (select {sums_of('kk')} from (select *, r * least(1.0, {clip}::double / (abs(r) * {NORM} + 1e-12)) kk from r{t}))")
        out.append(moved(t, lambda c, t=t: f"(g_{c} + {multiplier * clip!r}::double * {noise_sql(t, c)}) / {expected}.0::double", 0.5, f"s{t}"))
    return f"with {', '.join(out)} {final_sql(f'p{steps}')}"


@query("dp_sgd_train", dp_sgd_sql(4, 200, 0.5, 1.1))
def _(spark, d):
    return as_rows(spark, training.dp_sgd_train(LOGISTIC, W, updates.Sgd(0.5), click_rows(spark, d), XS, steps=4, expected=200, clip=0.5, multiplier=1.1, key=KEY, noise=stages.CoinNoise(KEY)).vector)


def spider_sql(steps: int, anchor: int, variation: int) -> str:
    """Anchors at even steps, variations at odd ones; q holds the estimate."""
    out = [CLICKS, START]
    for t in range(steps):
        size = variation if t % 2 else anchor
        drawn = f"{sql_coin(KEY, 'poisson', str(t), 'row_id')} < {size}.0::double / {N_ROWS}"
        if t % 2 == 0:
            out.append(f"s{t} as (select {sums_of('r')} from (select *, {residual_sql()} r from clicks, p{t} where {drawn}))")
            out.append(f"q{t} as (select {', '.join(f'g_{c} / {size}.0::double + 0.01::double * {noise_sql(t, c)} as e_{c}' for c in NAMES)} from s{t})")
        else:
            dist = " + ".join(f"(a.{w} - b.{w}) * (a.{w} - b.{w})" for w, _ in PAIRS)
            out.append(f"d{t} as (select least(0.1::double * sqrt({dist}), 0.5) std from p{t} a, p{t - 1} b)")
            out.append(f"s{t} as (select {sums_of('r')} from (select x1, x2, x3, {residual_sql('a.')} - {residual_sql('b.')} r from clicks, p{t} a, p{t - 1} b where {drawn}))")
            out.append(f"q{t} as (select {', '.join(f'e_{c} + g_{c} / {size}.0::double + std * {noise_sql(t, c)} as e_{c}' for c in NAMES)} from q{t - 1}, s{t}, d{t})")
        out.append(moved(t, lambda c: f"e_{c}", 0.5, f"q{t}"))
    return f"with {', '.join(out)} {final_sql(f'p{training.spider_choice(steps, 0)}')}"


@query("spider_train", spider_sql(4, 400, 200))
def _(spark, d):
    out, _ = training.spider_train(LOGISTIC, W, updates.Sgd(0.5), click_rows(spark, d), XS, steps=4, interval=2, anchor=400, variation=200, scales=accounting.NoiseScales(0.01, 0.1, 0.5), key=KEY, noise=stages.CoinNoise(KEY))
    return as_rows(spark, out.vector)


def bias_reduced_sql(steps: int, top: int, clip: float, radius: float, epsilon: float, delta: float, rate: float) -> str:
    """Steps of scales that the run's seed draws; every one of them is permitted."""
    rng, chances, z = np.random.default_rng(0), sampling.dyadic_probabilities(top), accounting.inner_multiplier(epsilon, delta)
    out = [CLICKS, START]
    for t in range(steps):
        scale = sampling.dyadic_scale(top, rng.random())
        rng.random()  # the reservoir's draw
        size = 2 ** (scale + 1)
        out.append(f"c{t} as (select *, r * least(1.0, {clip}::double / (abs(r) * {NORM} + 1e-12)) kk from (select *, {residual_sql()} r from clicks, p{t}))")
        out.append(f"n{t} as (select *, row_number() over (order by {sql_coin(KEY, 'dyadic', str(t), 'row_id')}, row_id) n, row_number() over (order by {sql_coin(KEY, 'single', str(t), 'row_id')}, row_id) o from c{t})")
        parts = [("whole", f"n <= {size}", size), ("odd", f"n <= {size // 2}", size // 2), ("even", f"n > {size // 2} and n <= {size}", size // 2), ("single", "o = 1", 1)]
        rows = [f"select '{p}' part, {i} i, sum(kk{' * ' + x if x else ''}) filter (where {where}) / {k}.0::double + {z * 2 * clip / k!r}::double * {noise_sql(4 * t + j, w[2:])} as value from n{t}" for j, (p, where, k) in enumerate(parts) for i, (w, x) in enumerate(PAIRS)]
        out.append(f"m{t} as ({' union all '.join(rows)})")
        project = projection_sql(f"m{t}", "part", f"{radius}::double")
        for name in ("projected", "pk", "pr", "pt"):
            project = project.replace(f"{name} as", f"{name}{t} as").replace(f"from {name}", f"from {name}{t}")
        out.append(project)
        one = lambda p, c: f"max(v) filter (where part = '{p}' and i = {NAMES.index(c)})"
        out.append(f"s{t} as (select {', '.join(f'({one("whole", c)} - ({one("odd", c)} + {one("even", c)}) / 2) / {chances[scale]!r}::double + {one("single", c)} as g_{c}' for c in NAMES)} from projected{t})")
        out.append(moved(t, lambda c: f"g_{c}", rate, f"s{t}"))
    mean = ", ".join(f"({' + '.join(f'p{t}.{w}' for t in range(steps + 1))}) / {steps + 1}.0::double as {w}" for w, _ in PAIRS)
    out.append(f"average as (select {mean} from {', '.join(f'p{t}' for t in range(steps + 1))})")
    return f"with {', '.join(out)} {final_sql('average')}"


@query("bias_reduced_train", bias_reduced_sql(3, 6, 0.5, 1.0, 1.0, 1e-3, 0.01))
def _(spark, d):
    return as_rows(spark, training.bias_reduced_train(LOGISTIC, W, updates.Sgd(0.01), click_rows(spark, d), XS, max_steps=3, epsilon=1.0, delta=1e-3, clip=0.5, radius=1.0, key=KEY, noise=stages.CoinNoise(KEY), top=6).average.vector)


# --- accounting as queries -----------------------------------------------------------------------------------------------


@query("release_counts", "select sum((i % 20 = 0)::int)::bigint anchors, sum((i % 20 <> 0)::int)::bigint variations from range(2000) t(i)")
def _(spark, d):
    return spark.createDataFrame([accounting.release_counts(2000, 20)], "anchors long, variations long")


COST = "cost as (select i::bigint as scale, (3 * pow(2.0, i + 1) + 1) / (16 * 10000.0) share from range(11) t(i))"


@query("step_cost", f"with {COST} select scale, {r('share * 1.0', 'epsilon')}, {r('share * 0.001', 'delta')} from cost")
def _(spark, d):
    return spark.createDataFrame([(k, *accounting.step_cost(k, 10_000, 1.0, 1e-3)) for k in range(11)], "scale long, epsilon double, delta double")


@query("filter_trace", f"""with steps as (select i, {sql_coin(KEY, 'trace', 'i', '0')} u from range(4000) t(i)), pmf as (select i k, 1 / (2 * (1 - pow(2.0, -11))) / pow(2.0, i) p from range(11) t(i)), cum as (select k, sum(p) over (order by k) hi, sum(p) over (order by k) - p lo from pmf),
c as (select steps.i t, coalesce(k, 10) as scale, (3 * pow(2.0, coalesce(k, 10) + 1) + 1) / (16 * 10000.0) share from steps left join cum on u >= lo and u < hi),
s as (select t, scale, sum(share * share) over (order by t rows unbounded preceding) sq, sum(share * 0.001) over (order by t rows unbounded preceding) dl from c),
e as (select *, sqrt(2 * ln(4 / 0.001) * sq) + sq / 2 ep from s), f as (select *, sum((not (ep <= 0.5 and dl <= 0.00025))::int) over (order by t rows unbounded preceding) refused from e)
select t::bigint as step, scale::bigint as scale, {r('ep', 'epsilon')}, {r('dl', 'delta', 12)} from f where refused = 0""", 12)
def _(spark, d):
    steps, total = [], 0.0
    for p in sampling.dyadic_probabilities(10):
        total += p
        steps.append(total)
    u = coins.coin(KEY, "trace", F.col("step"), F.lit(0))
    rows = spark.range(4000).withColumnRenamed("id", "step").withColumn("scale", F.least(F.lit(10), F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda e: e <= u))))
    share = (3 * F.pow(F.lit(2.0), F.col("scale") + 1) + 1) / (16 * 10000.0)
    run = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one run's ledger, in order
    sq = F.sum(share * share).over(run)
    out = rows.withColumn("epsilon", F.sqrt(2 * F.log(F.lit(4 / 0.001)) * sq) + sq / 2).withColumn("delta", F.sum(share * 0.001).over(run))
    return out.withColumn("refused", F.sum((~((F.col("epsilon") <= 0.5) & (F.col("delta") <= 0.00025))).cast("int")).over(run)).where("refused = 0").select("step", "scale", F.round("epsilon", 6).alias("epsilon"), "delta")


# --- sweeps ---------------------------------------------------------------------------------------------------------------

SWEEP = """sweep as (select i config_id, case when i % 3 = 0 then 'plain' when i % 3 = 1 then 'private' else 'capped' end arm, (i // 3) % 4 rate, (i // 12) % 5 seed, case when i % 17 = 5 then null else 0.5::double + ((i * 7919) % 101) / 1000.0::double end loss from range(120) t(i))"""


def sweep_rows(spark):
    i = F.col("id")
    arm = F.when(i % 3 == 0, "plain").when(i % 3 == 1, "private").otherwise("capped")
    loss = F.when(i % 17 == 5, F.lit(float("nan"))).otherwise(0.5 + ((i * 7919) % 101) / 1000.0)
    return spark.range(120).select(i.alias("config_id"), arm.alias("arm"), (F.floor(i / 3) % 4).alias("rate"), (F.floor(i / 12) % 5).alias("seed"), loss.alias("loss"))


def best_of(rows):
    fine = rows.where(~F.isnan("loss"))
    return fine.withColumn("n", F.row_number().over(Window.partitionBy("arm").orderBy("loss", "config_id"))).where("n = 1").drop("n")


BEST = "best as (select * from sweep where loss is not null qualify row_number() over (partition by arm order by loss, config_id) = 1)"


@query("sweep_best", f"with {SWEEP}, {BEST} select config_id, arm, {r('loss', 'loss')} from best")
def _(spark, d):
    return best_of(sweep_rows(spark)).select("config_id", "arm", "loss")


@query("sweep_top_k", f"with {SWEEP} select config_id, {r('loss', 'loss')} from sweep where loss is not null order by loss, config_id limit 7")
def _(spark, d):
    return sweep_rows(spark).where(~F.isnan("loss")).orderBy("loss", "config_id").limit(7).select("config_id", "loss")


@query("sweep_profile", f"with {SWEEP}, {BEST} select s.arm, s.rate::bigint rate, {r('s.loss', 'loss')} from sweep s join best b on s.arm = b.arm and s.seed = b.seed where s.loss is not null")
def _(spark, d):
    s = sweep_rows(spark)
    return s.where(~F.isnan("loss")).join(best_of(s).select("arm", "seed"), ["arm", "seed"], "left_semi").select("arm", "rate", "loss")


SPREAD = f"{SWEEP}, spread as (select arm, avg(loss) m, min(loss) lo, max(loss) hi from sweep where loss is not null group by arm)"


@query("seed_spread", f"with {SPREAD} select arm, {r('m', 'mean')}, {r('lo', 'least')}, {r('hi', 'most')} from spread")
def _(spark, d):
    return sweep_rows(spark).where(~F.isnan("loss")).groupBy("arm").agg(F.avg("loss").alias("mean"), F.min("loss").alias("least"), F.max("loss").alias("most"))


@query("arm_gap", f"with {SPREAD} select a.arm, b.arm as other, {r('a.m - b.m', 'mean_gap')}, {r('a.hi - b.lo', 'worst_gap')}, {r('a.lo - b.hi', 'best_gap')} from spread a join spread b on a.arm < b.arm")
def _(spark, d):
    s = sweep_rows(spark).where(~F.isnan("loss")).groupBy("arm").agg(F.avg("loss").alias("m"), F.min("loss").alias("lo"), F.max("loss").alias("hi"))
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, F.col("a.arm") < F.col("b.arm")).select(F.col("a.arm").alias("arm"), F.col("b.arm").alias("other"), (F.col("a.m") - F.col("b.m")).alias("mean_gap"), (F.col("a.hi") - F.col("b.lo")).alias("worst_gap"), (F.col("a.lo") - F.col("b.hi")).alias("best_gap"))


@query("sweep_cube", f"with {SWEEP} select arm, rate::bigint rate, count(*) n, {r('avg(loss)', 'mean')} from sweep where loss is not null group by cube (arm, rate)")
def _(spark, d):
    return sweep_rows(spark).where(~F.isnan("loss")).cube("arm", "rate").agg(F.count("*").alias("n"), F.avg("loss").alias("mean"))
