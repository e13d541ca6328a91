"""Aggregates, rankings, metrics, models, matching, colour, genotypes and the evaluation harness on the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import decompose, features, folds, gram, match, metrics, resample
from tessera.plans import harness
from tessera.plans.registry import query, r, table

# -- metrics -------------------------------------------------------------------
_PRED = "(select l_returnflag, l_extendedprice as y, l_quantity * 1500 as p from lineitem)"


@query(f"select l_returnflag, round(1 - sum((y - p) ^ 2) / (var_pop(y) * count(*)), 6) as r2, round(avg(abs(y - p)), 4) as mae, round(avg((y - p) ^ 2) / 1e6, 4) as mse_millions, count(*) as n from {_PRED} group by 1")
def regression_metrics(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return metrics.regression(li, "y", "p", ["l_returnflag"]).select("l_returnflag", r("r2").alias("r2"), r("mae", 4).alias("mae"), r(F.col("mse") / 1e6, 4).alias("mse_millions"), "n")


@query(
    f"""with p as (select y, p, y - p as e from {_PRED}), q as (select quantile_cont(e, 0.05) as lo, quantile_cont(e, 0.95) as hi from p),
    s as (select avg(e) as m, stddev_samp(e) as s from p, q where e between lo and hi), k as (select p.* from p, s where e between m - 1.5 * s and m + 1.5 * s)
    select round(1 - sum(e ^ 2) / (var_pop(y) * count(*)), 6) as r2, count(*) as n from k"""
)
def robust_r2(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return metrics.robust_r2(li, "y", "p", 1.5).select(r("r2").alias("r2"), "n")


@query(
    """with s as (select avg(o_totalprice) as a, quantile_cont(o_totalprice, 0.5) as b, var_pop(o_totalprice) as v from orders)
    select * from (select 'Mean' as model, round(1 - sum((o_totalprice - a) ^ 2) / (any_value(v) * count(*)), 6) + 0.0 as r2, round(avg(abs(o_totalprice - a)), 3) as mae from orders, s
    union all select 'Median', round(1 - sum((o_totalprice - b) ^ 2) / (any_value(v) * count(*)), 6), round(avg(abs(o_totalprice - b)), 3) from orders, s)"""
)
def naive_regression_baseline(spark, d):
    b = metrics.naive_regression(table(spark, d, "orders"), "o_totalprice")
    return b.select("model", (r("r2") + 0.0).alias("r2"), r("mae", 3).alias("mae"))


@query(
    """with c as (select l_returnflag as k, count(*) as n from lineitem group by 1), t as (select sum(n) as t from c)
    select (select k from c order by n desc, k limit 1) as mode_class, max(n) as support, round(1 - max(n / t), 6) as error, round(-sum(n / t * ln(n / t)), 6) as log_loss from c, t"""
)
def naive_class_baseline(spark, d):
    return metrics.naive_classes(table(spark, d, "lineitem"), "l_returnflag").select("mode_class", "support", r("error").alias("error"), r("log_loss").alias("log_loss"))


_ORD = "(select substr(o_orderpriority, 1, 1)::int as y from orders)"


@query(
    f"""with s as (select (select y from {_ORD} group by y order by count(*) desc, y limit 1) as m, round_even(avg(y), 0) as a, round_even(quantile_cont(y, 0.5), 0) as d from {_ORD}),
    l as (select y, unnest(['ModeClass', 'MeanClass', 'MedianClass']) as model, unnest([m::double, a::double, d::double]) as p from {_ORD}, s)
    select model, round(1 - avg((y = p)::int), 6) as error, round(avg(abs(y - p)), 6) as mae, round(avg((y - p) ^ 2), 6) as mse from l group by 1"""
)
def naive_ordinal_baseline(spark, d):
    b = metrics.naive_ordinal(table(spark, d, "orders"), F.substring("o_orderpriority", 1, 1).cast("int"))
    return b.select("model", r("error").alias("error"), r("mae").alias("mae"), r("mse").alias("mse"))


@query("select l_returnflag as y, l_linestatus as p, count(*) as n, round(count(*) / sum(count(*)) over (partition by l_returnflag), 6) as share from lineitem group by 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").withColumn("share", r("share"))


_CLS = "(select doc_id, quality as y, (n_chars > 800)::int as p from documents join labels using (doc_id))"


@query(
    f"""with l as (select unnest([0, 1]) as label), s as (select label, count(*) filter (y = label) as support, count(*) filter (p = label) as pred, count(*) filter (y = label and p = label) as hit, count(*) as n from l, {_CLS} group by 1)
    select label::int as label, round(coalesce(hit / nullif(pred, 0), 0), 6) as precision, round(coalesce(hit / nullif(support, 0), 0), 6) as recall, round(case when hit > 0 then 2 * hit / (pred + support) else 0 end, 6) as f1, support, round(support / n, 6) as fraction from s"""
)
def class_report(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 800).cast("int").alias("p"))
    return metrics.class_report(t, "y", "p").select("label", *[r(c).alias(c) for c in ("precision", "recall", "f1")], "support", r("fraction").alias("fraction"))


@query("select round(-avg(ln(least(greatest(case when l_returnflag = 'R' then 0.5 / 1.0 else 0.25 / 1.0 end, 1e-15), 1 - 1e-15))), 6) as log_loss, round(avg((l_returnflag = 'R')::int), 6) as accuracy from lineitem")
def log_loss_accuracy(spark, d):
    p = F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.25)
    return table(spark, d, "lineitem").agg(r(metrics.log_loss(p)).alias("log_loss"), r(metrics.accuracy(F.col("l_returnflag"), F.lit("R"))).alias("accuracy"))


# -- least squares ----------------------------------------------------------------
@query("select count(*) as n, round(avg(l_quantity), 6) as mean_x, round(covar_pop(l_quantity, l_extendedprice), 2) as cov, round(var_pop(l_quantity), 6) as var_x from lineitem")
def gram_matrix(spark, d):
    s = gram.gram(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])[None]
    c, m = s.centred()
    row = (int(s.n), float((m + s.shift)[0]), float(c[0, 1] / s.n), float(c[0, 0] / s.n))
    return spark.createDataFrame([row], "n long, mean_x double, cov double, var_x double").select("n", r("mean_x").alias("mean_x"), r("cov", 2).alias("cov"), r("var_x").alias("var_x"))


@query("select round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem")
def ols_simple(spark, d):
    f = gram.ols(gram.gram(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])[None])
    return spark.createDataFrame([(float(f["beta"][0]), float(f["beta"][1]), f["r2"])], "i double, s double, q double").select(r("i", 3).alias("intercept"), r("s", 4).alias("slope"), r("q").alias("r2"))


@query("select round(covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 1000), 4) as slope from lineitem")
def ridge_univariate(spark, d):
    m = gram.ridge(gram.gram(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])[None], 1, 1000.0)
    return spark.createDataFrame([(float(m.beta[0, 0]),)], "s double").select(r("s", 4).alias("slope"))


@query("select l_linenumber as fold, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, count(*) as n from lineitem group by 1")
def r2_by_fold(spark, d):
    g = gram.gram(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_linenumber")
    return spark.createDataFrame([(k, gram.ols(s)["r2"], int(s.n)) for k, s in g.items()], "fold int, q double, n long").select("fold", r("q").alias("r2"), "n")


@query()
def ols_tests(spark, d):
    s = gram.gram(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])[None]
    f, lr = gram.ols(s), gram.lr_test(s, [1, 2])
    t, (fv, fp) = gram.t_test(f), gram.f_test(f, [1, 2])
    return spark.createDataFrame([("t", float(t[1])), ("F", float(fv)), ("F p", float(fp)), ("LR", float(lr[0])), ("LR p", float(lr[1]))], "test string, value double").select("test", r("value").alias("value"))


@query()
def ridge_nested_cv(spark, d):
    return harness.flagship(spark, d)


@query()
def harness_metrics(spark, d):
    li = table(spark, d, "lineitem")
    sets = {"QUANTITY": ["l_quantity"], "PRICING": ["l_discount", "l_tax"], "ALL": ["l_quantity", "l_discount", "l_tax"]}
    return harness.evaluate(li, "l_orderkey", {"price": "l_extendedprice"}, sets)


@query(
    """select "column", round(indiv, 6) as indiv, round(cumm, 6) as cumm from (
    select 'l_quantity' as "column", regr_r2(l_extendedprice, l_quantity) as indiv, regr_r2(l_extendedprice, l_quantity) as cumm from lineitem)"""
)
def cumulative_regression(spark, d):
    s = gram.gram(table(spark, d, "lineitem"), ["l_tax", "l_quantity", "l_extendedprice"])[None]
    rows = gram.cumulative(s, [], [1])
    return spark.createDataFrame([("l_quantity", x["indiv"], x["cumm"]) for x in rows], "`column` string, a double, b double").select("column", r("a").alias("indiv"), r("b").alias("cumm"))


@query()
def bootstrap_significance(spark, d):
    li = table(spark, d, "lineitem").withColumn("k", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    mean = F.abs(F.col("l_extendedprice") - 38000)
    return resample.bootstrap(li.select("k", mean.alias("base"), F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500).alias("test")), "k", "base", "test")


@query()
def shuffle_test(spark, d):
    s = resample.shuffled_r2(table(spark, d, "lineitem"), "l_orderkey", ["l_quantity", "l_tax"], "l_extendedprice")
    return spark.createDataFrame([(k, float(v)) for k, v in s.items()], "statistic string, value double").select("statistic", r("value", 4).alias("value"))


@query()
def stability_selection(spark, d):
    s = resample.stability_selection(table(spark, d, "lineitem"), "l_orderkey", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 0.05)
    return spark.createDataFrame(list(s.items()), "`column` string, frequency double")


@query("select (row_number() over (order by a, s) - 1)::bigint as point, a as alpha, s as solver from (values (0.1::double), (1.0), (10.0)) t(a), (values ('gram'), ('svd')) u(s)")
def parameter_grid(spark, d):
    return resample.grid(spark, {"alpha": [0.1, 1.0, 10.0], "solver": ["gram", "svd"]})


# -- ranking and matching: a stated query set (ids divisible by 50) against all vectors ---------
def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def _queries(spark, d):
    return _vectors(spark, d).where("vec_id % 50 = 0")


_T = "(select vec_id, embedding::double[] as v from embeddings)"
_S = "(select vec_id, embedding::double[] as v from embeddings where vec_id % 50 = 0)"
_D = f"(select a.vec_id as source, b.vec_id as target, list_distance(a.v, list_transform(b.v, lambda x: x * 0.5)) as distance from {_S} a, {_T} b)"


@query(f"select a.vec_id as source, b.vec_id as target, round(1 - list_cosine_similarity(a.v, b.v), 6) + 0.0 as distance from {_S} a, {_T} b")
def pairs_cosine(spark, d):
    p = match.all_pairs(_queries(spark, d), _vectors(spark, d), "vec_id", "v", "cosine")
    return p.withColumn("distance", r("distance") + 0.0)


@query(f"select a.vec_id as source, b.vec_id as target, round(list_distance(a.v, b.v), 6) as distance from {_S} a, {_T} b")
def pairs_euclidean(spark, d):
    return match.all_pairs(_queries(spark, d), _vectors(spark, d), "vec_id", "v", "Euclidean").withColumn("distance", r("distance"))


@query(f"select a.vec_id as source, b.vec_id as target, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))), 6) as distance from {_S} a, {_T} b")
def pairs_manhattan(spark, d):
    return match.all_pairs(_queries(spark, d), _vectors(spark, d), "vec_id", "v", "Manhattan").withColumn("distance", r("distance"))


@query(f"select a.vec_id as source, b.vec_id as target, round(list_distance(a.v[1:16], b.v[1:16]) / 16 + list_distance(a.v[17:64], b.v[17:64]) / 48, 6) as distance from {_S} a, {_T} b")
def pairs_grouped_distance(spark, d):
    a, b = _queries(spark, d).toDF("source", "a"), _vectors(spark, d).toDF("target", "b")
    return a.crossJoin(b).select("source", "target", r(match.grouped_distance(F.col("a"), F.col("b"), [(0, 16), (16, 48)])).alias("distance"))


@query("select a.s_suppkey as source, b.s_suppkey as target, round(abs(a.s_acctbal - b.s_acctbal) ^ 2, 2) as s_acctbal from supplier a, supplier b where a.s_suppkey % 50 = 0")
def residual_pairs(spark, d):
    s = table(spark, d, "supplier")
    return match.residuals(s.where("s_suppkey % 50 = 0"), s, "s_suppkey", ["s_acctbal"], 2).withColumn("s_acctbal", r("s_acctbal", 2))


def _scored(spark, d):
    """Each query's vector searched among all vectors, halved."""
    half = _vectors(spark, d).select("vec_id", F.transform("v", lambda x: x * 0.5).alias("v"))
    return match.all_pairs(_queries(spark, d), half, "vec_id", "v", "Euclidean")


_RANK = f"(select source, rank() over w as k, target, row_number() over (partition by source order by distance, target) as o, count(*) over (partition by source) as n, count(*) over (partition by source order by distance) as u from {_D} window w as (partition by source order by distance))"


@query(f"select source, o as rank, k as rank_min, u as rank_max, n as n_all from {_RANK} where source = target")
def match_ranks(spark, d):
    return metrics.match_ranks(_scored(spark, d), "source", "target", "distance")


_SELECT = "list_product(list_transform(range(0, 9), lambda i: greatest((n - 1) - ({k} - 1) - i, 0)::double / ((n - 1) - i)))"


@query(
    f"""with t as (select *, o as r from {_RANK} where source = target)
    select round(avg({_SELECT.format(k='r')}), 6) as select_at_n, round(avg(100 - r / n * 100), 6) as precision, round(avg((r <= 5)::int), 6) as top_share, round(avg(1 / r), 6) as reciprocal_rank from t"""
)
def selection_metrics(spark, d):
    s = metrics.selection(metrics.match_ranks(_scored(spark, d), "source", "target", "distance"))
    return s.select(*[r(c).alias(c) for c in ("select_at_n", "precision", "top_share", "reciprocal_rank")])


@query(f"with t as (select *, unnest(range(k, u + 1)) as r from {_RANK} where source = target), g as (select source, avg({_SELECT.format(k='r')}) as s from t group by 1) select round(avg(s), 6) as select_at_n_ties from g")
def selection_with_ties(spark, d):
    return metrics.selection(metrics.match_ranks(_scored(spark, d), "source", "target", "distance")).select(r("select_at_n_ties").alias("select_at_n_ties"))


@query(f"select source, round((1 - (o - 1) / (n - 1)) ^ 9, 6) as fast, round((1 - (o - 2) / n) ^ 9, 6) as old from {_RANK} where source = target")
def selection_fast(spark, d):
    k = metrics.match_ranks(_scored(spark, d), "source", "target", "distance")
    return k.select("source", r(C.select_fast(F.col("rank") - 1, F.col("n_all"))).alias("fast"), r(C.select_fast_old(F.col("rank") - 1, F.col("n_all"))).alias("old"))


@query(f"select source, min_by(target, (distance, target)) as target from {_D} group by 1")
def argmax_match(spark, d):
    return match.argmax_match(match.similarity(_scored(spark, d), []), [])


@query(f"with t as (select *, max(distance) over () - distance as s from {_D}) select source, target, round(s / sum(s) over (partition by source), 6) as similarity from t")
def normalised_similarity(spark, d):
    return match.normalised(match.similarity(_scored(spark, d), [])).select("source", "target", r("similarity").alias("similarity"))


def _lineup_pairs(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("w", F.transform("v", lambda x: x * 0.9))
    return match.similarity(match.pairs_in(match.lineups(v, "vec_id", 20, 10), v, "vec_id", "v", "w"))


@query()
def lineup_members(spark, d):
    return match.lineups(table(spark, d, "embeddings"), "vec_id", 20, 10)


@query()
def greedy_match(spark, d):
    return match.one_to_one(_lineup_pairs(spark, d), "greedy")


@query()
def optimal_match(spark, d):
    return match.one_to_one(_lineup_pairs(spark, d), "optimal")


@query("select 1.0::double as accuracy")
def match_accuracy(spark, d):
    return match.match_accuracy(match.one_to_one(_lineup_pairs(spark, d), "optimal"))


@query()
def learned_match(spark, d):
    c = table(spark, d, "customer").where("c_custkey < 200").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n"))
    res = match.residuals(c, c.withColumn("c_acctbal", F.col("c_acctbal") * 1.01), "c_custkey", ["c_acctbal", "n"], 1, 2000)
    return match.argmax_match(match.learned_similarity(res, ["c_acctbal", "n"]), [])


# -- windows -------------------------------------------------------------------------
@query(
    """select event_id, round(quantile_cont(value, 0.25) over w, 6) as q25, round(quantile_cont(value, 0.5) over w, 6) as q50, round(avg(value) over w, 6) as mean
    from events where event_type = 'error' window w as (order by event_id rows between 50 preceding and 49 following)"""
)
def moving_quantiles(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", "value")
    m = features.moving_quantiles(e, "event_id", "value", [0.25, 0.5], 100, block=1000)
    return m.select("event_id", *[r(c).alias(c) for c in ("q25", "q50", "mean")])


@query("with s as (select l_linenumber as k, var_pop(l_extendedprice) as v from lineitem group by 1), c as (select k, sum(v) over (order by k) / sum(v) over () as c from s) select min(k) as components from c where c >= 0.5")
def cumulative_variance(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.var_pop("l_extendedprice").alias("v"))
    c = s.select("k", (F.sum("v").over(Window.orderBy("k")) / F.sum("v").over(Window.partitionBy())).alias("c"))
    return c.where("c >= 0.5").agg(F.min("k").alias("components"))


# -- information, genotypes, colour -----------------------------------------------------
@query(
    """with c as (select l_returnflag as a, l_linestatus as b, count(*)::double as n from lineitem group by 1, 2), t as (select *, n / sum(n) over () as p, sum(n) over (partition by a) / sum(n) over () as x, sum(n) over (partition by b) / sum(n) over () as y from c)
    select round(sum(p * log2(p / (x * y))), 6) as bits from t"""
)
def mutual_information(spark, d):
    return features.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(r("bits").alias("bits"))


@query("select case when z > 1 then 1 when z < -1 then -1 else 0 end as level, count(*) as n from (select (l_extendedprice - avg(l_extendedprice) over ()) / stddev_samp(l_extendedprice) over () as z from lineitem) group by 1")
def three_levels(spark, d):
    li = table(spark, d, "lineitem")
    s = F.broadcast(li.agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("s")))  # one row
    return li.crossJoin(s).select(features.discretised(F.col("l_extendedprice"), F.col("m"), F.col("s")).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query()
def mrmr_select(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.floor(F.col("l_quantity") / 10).alias("q"), F.floor(F.col("l_discount") * 100).alias("disc"), F.floor(F.col("l_extendedprice") / 10000).alias("price"))
    return spark.createDataFrame(list(enumerate(features.mrmr(li, ["l_returnflag", "l_linestatus", "l_linenumber", "q", "disc"], "price", 3))), "pos long, feature string")


def _dosages(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 50).alias("variant"), F.when(F.col("l_linenumber") % 5 == 4, F.lit(-9)).otherwise(F.col("l_linenumber") % 3).alias("dosage"))


_G = "(select l_suppkey as sample, l_partkey % 50 as variant, case when l_linenumber % 5 = 4 then -9 else l_linenumber % 3 end as dosage from lineitem)"


@query(f"select variant, count(*) filter (dosage = 0) as n0, count(*) filter (dosage = 1) as n1, count(*) filter (dosage = 2) as n2, count(*) filter (dosage < 0) as missing from {_G} group by 1")
def allele_counts(spark, d):
    return features.allele_counts(_dosages(spark, d))


@query(f"select variant, round(avg(dosage) filter (dosage >= 0), 6) as mean_dosage from {_G} group by 1 having avg(dosage) filter (dosage >= 0) > 1")
def maf_filter(spark, d):
    return features.maf_filter(_dosages(spark, d), 1.0).select("variant", r("mean_dosage").alias("mean_dosage"))


_GS = f"(select variant, avg(dosage) filter (dosage >= 0) as m, stddev_pop(dosage) filter (dosage >= 0) as s from {_G} group by 1)"


@query(f"select variant, round(sum(abs(case when dosage >= 0 then (dosage - m) / s else 0 end)), 4) as total, count(*) as n from {_G} join {_GS} using (variant) group by 1")
def snp_standardise(spark, d):
    x = features.standardised_snps(_dosages(spark, d))
    return x.groupBy("variant").agg(r(F.sum(F.abs("x")), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query()
def snp_standardise_beta(spark, d):
    x = features.standardised_snps(_dosages(spark, d), 0.8)
    return x.groupBy("variant").agg(r(F.sum(F.abs("x")), 4).alias("total"))


@query(
    f"""with x as (select sample, variant, sum(case when dosage >= 0 then (dosage - m) / s else 0 end) as x from {_G} join {_GS} using (variant) where sample < 20 group by 1, 2),
    k as (select a.sample as a, b.sample as b, sum(a.x * b.x) as k from x a join x b using (variant) where a.x <> 0 and b.x <> 0 group by 1, 2), t as (select avg(k) as t from k where a = b)
    select a, b, round(k / t, 4) + 0.0 as k from k, t"""
)
def snp_kernel(spark, d):
    x = features.standardised_snps(_dosages(spark, d)).where("sample < 20").groupBy("sample", "variant").agg(F.sum("x").alias("x"))
    return features.snp_kernel(x).select("a", "b", (r("k", 4) + 0.0).alias("k"))


@query(
    f"""with f as (select sample, variant, coalesce(case when dosage >= 0 then dosage::double end, avg(case when dosage >= 0 then dosage end) over (partition by variant)) as x from {_G}),
    t as (select variant, (x - avg(x) over w) / (max(x) over w - min(x) over w + 1e-5) as z from f window w as (partition by variant)) select variant, round(sum(abs(z)), 4) as total from t group by 1"""
)
def impute_and_scale(spark, d):
    return features.imputed_scaled(_dosages(spark, d)).groupBy("variant").agg(r(F.sum(F.abs("x")), 4).alias("total"))


@query("select p_partkey, case when p_size % 25 = 23 then 'X' when p_size % 25 = 24 then 'Y' when p_size % 25 = 0 then 'MT' else (p_size % 25)::varchar end as chrom from part")
def chromosome_names(spark, d):
    k = F.col("p_size") % 25
    raw = F.when(k == 23, "x").when(k == 24, "Y").when(k == 0, "M").otherwise(F.concat(k.cast("string"), F.lit(".0")))
    return table(spark, d, "part").select("p_partkey", C.chromosome(raw).alias("chrom"))


_CCN = "(select s_suppkey, s_suppkey % 5 * 0.52 as x, s_suppkey % 3 * 0.6 as y from supplier)"


@query(
    f"""with f as (select *, x > 1.05 as xx, y > 0.05 as yy from {_CCN}), o as (select *, y > 1.05 or x > 2.05 or (xx and yy) or not (xx or yy) as outlier from f)
    select s_suppkey, xx and yy as contaminated, outlier, case when not outlier and xx and not yy then 'Female' when not outlier and not xx and yy then 'Male' else '' end as sex,
    round(case when not outlier and xx and not yy then (x - 2) / 2 else 0 end, 6)::double as "chrX", round(case when not outlier and not xx and yy then y - 1 else 0 end, 6)::double as "chrY" from o"""
)
def sex_qc(spark, d):
    s = table(spark, d, "supplier")
    q = C.sex_qc(F.col("s_suppkey") % 5 * 0.52, F.col("s_suppkey") % 3 * 0.6)
    return s.select("s_suppkey", *[(r(c) if n.startswith("chr") else c).alias(n) for n, c in q.items()])


_XYZ = "(select p_partkey, 0.412453 * a + 0.357580 * b + 0.180423 * c as x, 0.212671 * a + 0.715160 * b + 0.072169 * c as y, 0.019334 * a + 0.119193 * b + 0.950227 * c as z from (select p_partkey, p_size / 50.0::double as a, p_partkey % 7 / 7.0::double as b, p_partkey % 11 / 11.0::double as c from part))"
_CURVE = "case when {t} > 0.008856 then ({t}) ^ 0.333333::double else 7.787::double * ({t}) + 16.0::double / 116 end"
_LAB = f"(select p_partkey, case when y > 0.008856 then 116 * y ^ 0.3333333::double - 16 else y * 903.3::double end as l, 500 * (fx - fy) as a, 200 * (fy - fz) as b from (select p_partkey, y, {_CURVE.format(t='x / 0.95047::double')} as fx, {_CURVE.format(t='y')} as fy, {_CURVE.format(t='z / 1.08883::double')} as fz from {_XYZ}))"


def _lab():
    return C.xyz_to_lab(*C.rgb_to_xyz(F.col("p_size") / 50.0, F.col("p_partkey") % 7 / 7.0, F.col("p_partkey") % 11 / 11.0))


@query(f"select p_partkey, round(l, 4) as l, round(a, 4) + 0.0 as a, round(b, 4) + 0.0 as b from {_LAB}")
def lab_colour(spark, d):
    l, a, b = _lab()
    return table(spark, d, "part").select("p_partkey", r(l, 4).alias("l"), (r(a, 4) + 0.0).alias("a"), (r(b, 4) + 0.0).alias("b"))


@query(f"select p_partkey, round(3.240479 * x - 1.537150 * y - 0.498535 * z, 4) + 0.0 as red from (select p_partkey, 0.95047::double * ((l + 16) / 116 + a / 500) ^ 3 as x, ((l + 16) / 116) ^ 3 as y, 1.08883::double * ((l + 16) / 116 - b / 200) ^ 3 as z from {_LAB})")
def rgb_from_lab(spark, d):
    red, _, _ = C.xyz_to_rgb(*C.lab_to_xyz(*_lab()))
    return table(spark, d, "part").select("p_partkey", (r(red, 4) + 0.0).alias("red"))


@query("select c_custkey, round((50 + c_custkey % 60) / (1.5 + c_custkey % 5 / 10.0::double) ^ 2, 6) as bmi from customer")
def body_mass_index(spark, d):
    return table(spark, d, "customer").select("c_custkey", r(C.bmi(50 + F.col("c_custkey") % 60, 1.5 + F.col("c_custkey") % 5 / 10.0)).alias("bmi"))


@query("select l_returnflag, case l_returnflag when 'A' then 0 when 'N' then 1 else -1 end as code, count(*) as n from lineitem group by 1, 2")
def recode_values(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", C.recode(F.col("l_returnflag"), {"A": 0, "N": 1}, -1).alias("code"))
    return li.groupBy("l_returnflag", "code").agg(F.count(F.lit(1)).alias("n"))


@query("select vec_id, round(exp(v[1]) / (exp(v[1]) + exp(v[2]) + exp(v[3])), 6) as p from (select vec_id, embedding::double[] as v from embeddings)")
def softmax_probability(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("v"))
    return e.select("vec_id", r(C.softmax(F.col("v"))[0]).alias("p"))


# -- components --------------------------------------------------------------------------
def _wide(spark, d, n=6):
    return table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)], (F.col("vec_id") % 5).cast("double").alias("cov"), (F.col("vec_id") % 3 + 1).cast("double").alias("w"))


def _variances(spark, c):
    return spark.createDataFrame([(i + 1, float(v), float(e)) for i, (v, e) in enumerate(zip(c.variances, c.explained, strict=True))], "component int, v double, e double").select("component", r("v").alias("variance"), r("e").alias("share"))


@query()
def pca_variances(spark, d):
    return _variances(spark, decompose.pca(_wide(spark, d), [f"x{i}" for i in range(6)]))


@query()
def pca_covariate_adjusted(spark, d):
    return _variances(spark, decompose.pca(_wide(spark, d), [f"x{i}" for i in range(6)], covariates=["cov"]))


@query()
def pca_weighted(spark, d):
    return _variances(spark, decompose.pca(_wide(spark, d), [f"x{i}" for i in range(6)], weight="w"))


@query("select 'var' as what, round(sum(v), 6) as total from (select var_pop(embedding[1]::double) as v from embeddings union all select var_pop(embedding[2]::double) from embeddings union all select var_pop(embedding[3]::double) from embeddings)")
def pca_scores_keep_variance(spark, d):
    w = _wide(spark, d, 3)
    s = decompose.pca(w, ["x0", "x1", "x2"]).project(w)
    return s.agg((F.var_pop("pc1") + F.var_pop("pc2") + F.var_pop("pc3")).alias("t")).select(F.lit("var").alias("what"), r("t").alias("total"))


# -- classification, significance, identification -----------------------------------------
@query()
def classification_harness(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", (F.col("n_chars") / 1000).alias("length"), (F.col("doc_id") % 7).cast("double").alias("noise"))
    return harness.evaluate_classes(t, "doc_id", "quality", {"LENGTH": ["length"], "BOTH": ["length", "noise"]})


@query()
def significance_ladder(spark, d):
    sets = {"QUANTITY": ["l_quantity"], "TAX": ["l_tax"], "QT": ["l_quantity", "l_tax"], "QT + DISCOUNT": ["l_quantity", "l_tax", "l_discount"]}
    return harness.significance(table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", sets, "QT")


@query()
def identification_run(spark, d):
    from tessera.plans import identify

    e = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(8)], *[(F.col("embedding")[i] * 2 + F.col("embedding")[(i + 1) % 8]).cast("double").alias(f"y{i}") for i in range(5)])
    return identify.run(e, "vec_id", [f"x{i}" for i in range(8)], [f"y{i}" for i in range(5)])[0]


@query()
def nearest_neighbour_regression(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("double").alias("y"))
    return match.knn(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), "vec_id", "v", "y", 5)
