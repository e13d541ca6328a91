"""Folds, selection, filters, preparation and joins on the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import folds, prep, relate
from tessera.plans.registry import query, r, table

_MD5 = "(('0x' || md5({k}::varchar || '{s}'))::uhugeint % {n})::int"


def _md5(k: str, n: int, s: str = "") -> str:
    return _MD5.format(k=k, n=n, s=s)


# -- folds ----------------------------------------------------------------------
@query(f"select c_custkey, {_md5('c_custkey', 12)} as fold from customer")
def hashed_folds(spark, d):
    return folds.hashed_folds(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query(f"select c_custkey, {_md5('c_custkey', 12, 'pepper')} as fold from customer")
def hashed_folds_salted(spark, d):
    return folds.hashed_folds(table(spark, d, "customer").select("c_custkey"), "c_custkey", salt="pepper")


@query(f"select {_md5('c_custkey', 12)} as fold, count(*) as n, round(avg(c_acctbal), 4) as balance from customer group by 1")
def fold_sizes(spark, d):
    return folds.hashed_folds(table(spark, d, "customer"), "c_custkey").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r(F.avg("c_acctbal"), 4).alias("balance"))


@query(f"select c_custkey, case when c_mktsegment = 'BUILDING' then {_md5('c_custkey', 10)} else {_md5('c_custkey', 12)} end as fold from customer")
def folds_keep_in_training(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("keep"))
    return folds.hashed_folds(c, "c_custkey", keep_in_training=["keep"]).drop("keep")


@query(f"select c_custkey, case when c_mktsegment = 'BUILDING' then 10 + {_md5('c_custkey', 2)} else {_md5('c_custkey', 12)} end as fold from customer")
def folds_keep_in_holdout(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("keep"))
    return folds.hashed_folds(c, "c_custkey", keep_in_holdout=["keep"]).drop("keep")


@query(f"select c_custkey, case when c_mktsegment = 'BUILDING' then -1 else {_md5('c_custkey', 10)} end as fold from customer")
def folds_zero_holdout(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("keep"))
    return folds.hashed_folds(c, "c_custkey", n_holdout=0, keep_in_holdout=["keep"]).drop("keep")


@query(f"with f as (select s_suppkey, min(s_suppkey::varchar) over (partition by s_nationkey) as k from supplier) select s_suppkey, {_md5('k', 12)} as fold from f")
def folds_keep_together(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    families = s.groupBy("s_nationkey").agg(F.collect_list(F.col("s_suppkey").cast("string")).alias("relatives"))
    return folds.hashed_folds(s, "s_suppkey", keep_together=["relatives"], families=families, on="s_nationkey").select("s_suppkey", "fold")


@query("select s_suppkey::varchar as key, t.k as relative from supplier, (values ('0'), ('1')) t(k) where false")
def folds_together_violations(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    families = s.groupBy("s_nationkey").agg(F.collect_list(F.col("s_suppkey").cast("string")).alias("relatives"))
    return folds.check_together(s, "s_suppkey", ["relatives"], families, "s_nationkey")


@query(
    f"""with f as (select s_suppkey, s_nationkey, min(s_suppkey::varchar) over (partition by s_nationkey) as k,
    bool_or(s_suppkey % 37 = 0) over (partition by s_nationkey) as keep from supplier)
    select s_suppkey, case when keep then {_md5('k', 10)} else {_md5('k', 12)} end as fold from f"""
)
def folds_family_training_mask(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 37 == 0).alias("keep"))
    families = s.groupBy("s_nationkey").agg(F.collect_list(F.col("s_suppkey").cast("string")).alias("relatives"))
    return folds.hashed_folds(s, "s_suppkey", keep_in_training=["keep"], keep_together=["relatives"], families=families, on="s_nationkey").select("s_suppkey", "fold")


@query("select c_custkey, (dense_rank() over (order by c_mktsegment) - 1)::int as fold from customer")
def prelabelled_folds(spark, d):
    return folds.labelled_folds(table(spark, d, "customer"), "c_mktsegment").select("c_custkey", "fold")


@query("select c_custkey, (dense_rank() over (order by c_mktsegment) - 1)::int as fold from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def prelabelled_folds_filtered(spark, d):
    return folds.labelled_folds(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "fold")


@query("select o_orderkey, (ntile(7) over (order by o_orderkey) - 1)::int as fold from orders")
def contiguous_kfold(spark, d):
    return folds.contiguous_folds(table(spark, d, "orders").select("o_orderkey"), 7, "o_orderkey")


@query("select o_orderkey, row_number() over (order by o_orderkey) > floor(count(*) over () * 0.93) as is_test from orders")
def head_split(spark, d):
    return folds.head_split(table(spark, d, "orders").select("o_orderkey"), 0.93, "o_orderkey")


@query(f"select split::int as split, ({_md5('c_custkey', 12)} = split) as is_test, count(*) as n from customer, range(10) t(split) where {_md5('c_custkey', 12)} < 10 group by all")
def leave_one_fold_out(spark, d):
    f = folds.hashed_folds(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return folds.leave_one_out(f).groupBy("split", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query("select split_part(c_name, '#', 2) as subject, count(*) as n from customer group by 1")
def subject_from_key(spark, d):
    return table(spark, d, "customer").select(folds.subject_of(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


# -- selection and filters ----------------------------------------------------------
@query("select o_orderkey, o_totalprice from orders where o_orderstatus in ('F', 'O') and o_orderpriority <> '5-LOW' and o_custkey is not null and o_totalprice > 1000")
def select_by_filter(spark, d):
    rules = {"o_orderstatus": (["F", "O"], "in"), "o_orderpriority": ("5-LOW", "!="), "o_custkey": (None, "!="), "o_totalprice": [(1000, ">")]}
    return prep.query(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"], rules, with_nulls=False)


@query("select o_orderkey from orders where o_orderstatus is not null and o_orderstatus not in ('P')")
def exclude_values(spark, d):
    return prep.query(table(spark, d, "orders"), ["o_orderkey"], {"o_orderstatus": [(None, "!="), (["P"], "!in")]})


@query("select l_quantity, l_discount, l_tax from lineitem")
def select_columns_by_pattern(spark, d):
    li = table(spark, d, "lineitem")
    cols = prep.columns_like(li.columns, prep.any_of(["quantity$", "^l_(discount|tax)"]), ["ship"])
    return li.select(*cols)


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def anti_membership(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def semi_membership(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query(
    """with t as (select l_quantity > 10 as a, l_discount < 0.05 as b, l_returnflag <> 'R' as c from lineitem)
    select * from (select 0::int as step, 'quantity' as reason, count(*) filter (not a) as lost from t
    union all select 1, 'discount', count(*) filter (a and not b) from t
    union all select 2, 'flag', count(*) filter (a and b and not c) from t)"""
)
def filter_ledger(spark, d):
    return prep.filter_ledger(table(spark, d, "lineitem"), [("quantity", F.col("l_quantity") > 10), ("discount", F.col("l_discount") < 0.05), ("flag", F.col("l_returnflag") != "R")])


_LABELLED = "(select d.doc_id, d.n_chars, l.quality, l.toxic from documents d left join labels l using (doc_id))"


@query(f"select * from (select 'n_chars' as col, round(avg((n_chars is null)::int), 6) as missing from {_LABELLED} union all select 'quality', round(avg((quality is null)::int), 6) from {_LABELLED} union all select 'toxic', round(avg((toxic is null)::int), 6) from {_LABELLED})")
def missing_profile(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    one = t.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in ("n_chars", "quality", "toxic")])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), r(c).alias("missing")) for c in ("n_chars", "quality", "toxic")])))


@query(
    f"""select * from (select 'quality' as "column", count(*) filter (quality is null) as lost from {_LABELLED}
    union all select 'toxic', count(*) filter (quality is not null and toxic is null) from {_LABELLED}
    union all select 'n_chars', count(*) filter (quality is not null and toxic is not null and n_chars is null) from {_LABELLED})"""
)
def tally_missing(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return prep.tally_missing(t, ["n_chars", "toxic", "quality"])


@query(f"select quality, count(*) as n from {_LABELLED} where quality is not null and n_chars is not null group by 1")
def prune_then_dropna(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return prep.complete(t, ["n_chars", "quality"]).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, try_cast(substr(c_name, 10, case when c_custkey % 50 = 0 then 1 else 99 end) || case when c_custkey % 50 = 0 then 'x' else '' end as double) as code from customer")
def salvage_numeric(spark, d):
    junk = F.concat(F.substring("c_name", 10, 1), F.lit("x"))
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 50 == 0, junk).otherwise(F.substring("c_name", 10, 99)).alias("code"))
    return prep.salvage(c, ["code"])[0]


@query("select c_custkey, (c_mktsegment = 'BUILDING')::double as c_mktsegment_BUILDING, (c_mktsegment = 'FURNITURE')::double as c_mktsegment_FURNITURE, (c_mktsegment = 'HOUSEHOLD')::double as c_mktsegment_HOUSEHOLD, (c_mktsegment = 'MACHINERY')::double as c_mktsegment_MACHINERY from customer")
def categorical_coding(spark, d):
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return prep.treatment_coding(c, "c_mktsegment", levels=levels).drop("c_mktsegment")


@query("select l_orderkey, l_linenumber, (l_returnflag = 'N')::double as l_returnflag_N, (l_returnflag = 'R')::double as l_returnflag_R, (l_returnflag = 'N')::double * l_tax as l_returnflag_N__l_tax, (l_returnflag = 'R')::double * l_tax as l_returnflag_R__l_tax from lineitem")
def categorical_interactions(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_tax")
    return prep.treatment_coding(li, "l_returnflag", ["l_tax"], ["A", "N", "R"]).drop("l_returnflag", "l_tax")


# -- outliers and scaling --------------------------------------------------------------
_LIM = "(select quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from events)"
_MS = f"(select avg(value) as m, stddev_samp(value) as s from events, {_LIM} where value between lo and hi)"


@query(f"select round(m - 6 * s, 6) as value_low, round(m + 6 * s, 6) as value_high from {_MS}")
def outlier_limits(spark, d):
    return prep.outlier_limits(table(spark, d, "events").select("value"), ["value"], 6).select(r("value_low").alias("value_low"), r("value_high").alias("value_high"))


@query(f"select event_id, round(least(greatest(value, m - 2 * s), m + 2 * s), 6) as value from events, {_MS}")
def outlier_trim(spark, d):
    t = prep.trim_outliers(table(spark, d, "events").select("event_id", "value"), ["value"], 2)
    return t.select("event_id", r("value").alias("value"))


@query(f"select (value < m - 2 * s or value > m + 2 * s) as value_outlier, count(*) as n from events, {_MS} group by 1")
def outlier_flags(spark, d):
    t = prep.trim_outliers(table(spark, d, "events").select("event_id", "value"), ["value"], 2, trim=False)
    return t.groupBy("value_outlier").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with q as (select event_type, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from events group by 1),
    s as (select event_type, avg(value) as m, stddev_samp(value) as s from events join q using (event_type) where value between lo and hi group by 1)
    select event_type, round(m - 4 * s, 6) as value_low, round(m + 4 * s, 6) as value_high from s"""
)
def outlier_limits_by_class(spark, d):
    lim = prep.outlier_limits(table(spark, d, "events").select("event_type", "value"), ["value"], 4, ["event_type"])
    return lim.select("event_type", r("value_low").alias("value_low"), r("value_high").alias("value_high"))


@query(
    """with q as (select quantile_cont(l_extendedprice, 0.1) as a, quantile_cont(l_extendedprice, 0.9) as b, quantile_cont(l_extendedprice, 0.0) as c, quantile_cont(l_extendedprice, 1.0) as e from lineitem)
    select * from (select 0.1::double as low, 0.9::double as high, round(corr(l_quantity, least(greatest(l_extendedprice, a), b)) ^ 2, 6) as r2 from lineitem, q
    union all select 0.0, 1.0, round(corr(l_quantity, least(greatest(l_extendedprice, c), e)) ^ 2, 6) from lineitem, q)"""
)
def winsorise_grid(spark, d):
    g = prep.winsorised_fit(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", [(0.1, 0.9), (0.0, 1.0), (0.4, 0.6)])
    return g.select("low", "high", r("r2").alias("r2"))


@query("select event_id, round((value - avg(value) over ()) / stddev_pop(value) over (), 6) as value from events")
def standardise_population(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    p = prep.Prepared({"value": prep.Spec(clip=0)}, e)
    return p.apply(e).select("event_id", r("value").alias("value"))


@query("with t as (select c_custkey, case when c_custkey % 9 = 0 then null else c_acctbal end as x from customer) select c_custkey, round(coalesce(x, avg(x) over ()), 6) as x from t")
def impute_mean(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("x"))
    return prep.Prepared({"x": prep.Spec("mean", False, 0)}, c).apply(c).select("c_custkey", r("x").alias("x"))


@query(
    """with t as (select p_partkey, case when p_partkey % 9 = 0 then null else p_size end as x from part),
    m as (select x as m from t where x is not null group by x order by count(*) desc, x limit 1) select p_partkey, coalesce(x, m) as x from t, m"""
)
def impute_mode(spark, d):
    c = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("x"))
    return prep.Prepared({"x": prep.Spec("mode", False, 0)}, c).apply(c)


@query("with t as (select event_id, value, rank() over (order by value) as k, count(*) over (partition by value) as c, count(*) over () as n from events) select event_id, round((k + (c - 1) / 2.0 - 0.5) / n - 1, 6) as q from t")
def quantile_uniform(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return prep.quantile_normal(e, "value", "event_id", "q", "uniform").select("event_id", r("q").alias("q"))


@query()
def quantile_normal(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return prep.quantile_normal(e, "value", "event_id", "z").select("event_id", r("z").alias("z"))


# -- packed vectors and reshaping ---------------------------------------------------------
@query("select vec_id, round(embedding[1]::double, 6) as v_1, round(embedding[2]::double, 6) as v_2, round(embedding[3]::double, 6) as v_3 from embeddings")
def unpack_leftmost(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.to_json(F.col("embedding").cast("array<double>")).alias("v"))
    u = prep.unpack_columns(e, prep.packed_columns(e), {"v": 3})
    return u.select("vec_id", *[r(f"v_{i}").alias(f"v_{i}") for i in (1, 2, 3)])


@query("select p_partkey, '[' || p_size || ',' || p_partkey || ']' as packed from part")
def pack_columns(spark, d):
    return table(spark, d, "part").select("p_partkey", C.pack(F.col("p_size").cast("long"), F.col("p_partkey")).alias("packed"))


@query("select event_type, sum((props->>'k')::int)::bigint as total, count(*) as n from events group by 1")
def json_extract(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("int")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, l_linenumber, name, round(value, 6) as value from (unpivot (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name name value value)")
def unpivot_columns(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return li.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value").withColumn("value", r("value"))


@query("select l_returnflag, count(*) filter (l_linestatus = 'F') as \"F\", count(*) filter (l_linestatus = 'O') as \"O\" from lineitem group by 1")
def pivot_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).fillna(0)


@query("select vec_id, round((embedding[1]::double + embedding[64]::double) / 2, 6) as first, round((embedding[32]::double + embedding[33]::double) / 2, 6) as middle from embeddings")
def mirror_average(spark, d):
    e = prep.symmetrised(table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding")
    return e.select("vec_id", r(F.col("embedding")[0]).alias("first"), r(F.col("embedding")[31]).alias("middle"))


# -- joins ----------------------------------------------------------------------------
@query("select o_orderkey, o_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def add_new_columns(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return relate.add_columns(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")


@query("select c_custkey, n from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey")
def force_rows(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return relate.force_rows(table(spark, d, "customer").select("c_custkey"), o, "c_custkey")


@query("select coalesce(a.k, b.k) as k, a.x, b.y from (select c_custkey as k, c_acctbal as x from customer where c_custkey % 2 = 0) a full join (select c_custkey as k, c_nationkey as y from customer where c_custkey % 3 = 0) b on a.k = b.k")
def full_outer_concat(spark, d):
    c = table(spark, d, "customer")
    a = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.lit(-1).alias("y"))
    return relate.outer_concat(a, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("y")), "k").select("k", "x", "y")


@query("select a.l_orderkey, a.l_linenumber, b.l_tax from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber")
def composite_key_join(spark, d):
    li = table(spark, d, "lineitem")
    return relate.composite(li.select("l_orderkey", "l_linenumber"), li.select("l_orderkey", "l_linenumber", "l_tax"), ["l_orderkey", "l_linenumber"])


_RANGES = "(select p_brand as chrom, min(p_partkey) as s, min(p_partkey) + 40 as e from part group by 1)"


@query(f"select p_partkey, p_brand, s, e from part join {_RANGES} on p_brand = chrom and p_partkey between s and e")
def interval_join(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    g = p.groupBy("p_brand").agg(F.min("p_partkey").alias("s"), (F.min("p_partkey") + 40).alias("e"))
    return relate.interval_join(p, g, "p_brand", "p_partkey", "s", "e", 1000)


@query(f"select p_partkey, p_brand, s - 1 - 5 as s, e - 1 + 7 as e from part join {_RANGES} on p_brand = chrom and p_partkey between s - 6 and e + 6")
def interval_join_padded(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    g = p.groupBy("p_brand").agg(F.min("p_partkey").alias("s"), (F.min("p_partkey") + 40).alias("e"))
    return relate.interval_join(p, g, "p_brand", "p_partkey", "s", "e", 16, before=5, after=7, base=1, broadcast_rows=0)


@query("select event_id, (select min(p_retailprice) from part where p_retailprice >= value * 10) as next_price from events")
def next_value_lookup(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") * 10).alias("v"))
    ref = table(spark, d, "part").select(F.col("p_retailprice").alias("v"))
    return relate.next_value(e, ref, "v", "next_price").select("event_id", "next_price")


@query("select o_orderkey, (select min(s_acctbal) from supplier where s_nationkey = c_nationkey and s_acctbal >= c_acctbal) as next_balance from orders join customer on o_custkey = c_custkey")
def next_value_by_group(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("v"))
    ref = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("v"))
    return relate.next_value(o, ref, "v", "next_balance", ["g"]).select("o_orderkey", "next_balance")


@query("select a.s_suppkey as source, b.s_suppkey as target, case when a.s_nationkey <> b.s_nationkey then -1.0 else round(abs(a.s_acctbal - b.s_acctbal), 4) end as distance from supplier a join supplier b on a.s_suppkey // 10 = b.s_suppkey // 10")
def mismatch_fill(spark, d):
    s = table(spark, d, "supplier").withColumn("g", F.floor(F.col("s_suppkey") / 10))
    p = s.select("g", F.col("s_suppkey").alias("source"), F.col("s_acctbal").alias("x")).join(s.select("g", F.col("s_suppkey").alias("target"), F.col("s_acctbal").alias("y")), "g")
    p = p.select("source", "target", r(F.abs(F.col("x") - F.col("y")), 4).alias("distance"))
    return relate.masked_where_different(p, s, "s_suppkey", "s_nationkey", "distance", -1.0)


@query("select r_name as \"group\", n_name as source, n_name as target, 100.0::double as score from nation join region on n_regionkey = r_regionkey")
def fuzzy_names(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("group"), F.col("n_name").alias("name"))
    return relate.best_names(n, n.withColumn("name", F.when(F.length("name") > 8, F.col("name")).otherwise(F.col("name"))), "group", "name")


@query("select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1")
def dedupe_keep_last(spark, d):
    return relate.first_per(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], F.desc("o_orderkey"))


@query("select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1")
def first_per_group(spark, d):
    return relate.first_per(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], F.asc("o_orderkey"))


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("select c_custkey from customer except select o_custkey from orders")
def except_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey"))


@query("select c_custkey from customer intersect select o_custkey from orders")
def intersect_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey").intersect(table(spark, d, "orders").select("o_custkey"))


@query("select 'a' as side, c_custkey as k, c_acctbal as x from customer union all select 'b', s_suppkey, null from supplier")
def union_all_by_name(spark, d):
    a = table(spark, d, "customer").select(F.lit("a").alias("side"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    return a.unionByName(table(spark, d, "supplier").select(F.lit("b").alias("side"), F.col("s_suppkey").alias("k")), allowMissingColumns=True)


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def top_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("select n_name, any_value(r_name) as r_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def lookup_chain(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.first("r_name").alias("r_name"), F.count(F.lit(1)).alias("customers"))


@query("select l_orderkey, l_linenumber from (select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem) where (k - 1) % 5 = 0")
def every_kth_row(spark, d):
    li = table(spark, d, "lineitem")
    p = folds.positions(li, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return p.where("position % 5 = 0").select("l_orderkey", "l_linenumber")


@query("select c_mktsegment, max_by(c_custkey, (c_acctbal, -c_custkey)) as best, round(max(c_acctbal), 4) as balance from customer group by 1")
def group_argmax(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", (-F.col("c_custkey")).alias("k"))).alias("best"), r(F.max("c_acctbal"), 4).alias("balance"))


@query("select l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) as weighted from lineitem group by 1")
def weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity"), 4).alias("weighted"))


@query("select s_suppkey, round(s_acctbal / sum(s_acctbal) over (partition by s_nationkey), 6) as share from supplier")
def group_normalise(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", r(F.col("s_acctbal") / F.sum("s_acctbal").over(Window.partitionBy("s_nationkey"))).alias("share"))


# -- aggregates and scalar functions ---------------------------------------------------------
@query("select l_returnflag, count(*) as support, round(count(*) / sum(count(*)) over (), 6) as share from lineitem group by 1")
def value_counts(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("support"))
    return c.withColumn("share", r(F.col("support") / F.sum("support").over(Window.partitionBy())))


@query("select event_type, round(quantile_cont(value, 0.05), 6) as q5, round(median(value), 6) as q50, round(quantile_cont(value, 0.95), 6) as q95, round(stddev_pop(value), 6) as sd_pop, round(stddev_samp(value), 6) as sd_samp from events group by 1")
def quantiles_and_deviations(spark, d):
    q = lambda p: r(F.percentile("value", p))
    return table(spark, d, "events").groupBy("event_type").agg(q(0.05).alias("q5"), q(0.5).alias("q50"), q(0.95).alias("q95"), r(F.stddev_pop("value")).alias("sd_pop"), r(F.stddev_samp("value")).alias("sd_samp"))


@query("select doc_id, coalesce(n_chars, 0)::double + coalesce(quality, 0) + coalesce(toxic, 0) as total, coalesce(quality = 1, false) or coalesce(toxic = 1, false) as any_flag, coalesce(quality = 1, false) and coalesce(toxic = 1, false) as all_flags from documents left join labels using (doc_id)")
def row_sums_and_flags(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    flags = F.col("quality") == 1, F.col("toxic") == 1
    return t.select("doc_id", C.row_sum(*[F.col(c).cast("double") for c in ("n_chars", "quality", "toxic")]).alias("total"), C.any_true(*flags).alias("any_flag"), C.all_true(*flags).alias("all_flags"))


@query("with f as (select l_linenumber as fold, avg(l_tax) as score, count(*) as n from lineitem group by 1) select round(sum(score * n) / sum(n), 6) as weighted, round(avg(score), 6) as plain from f")
def weighted_fold_score(spark, d):
    f = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.avg("l_tax").alias("score"), F.count(F.lit(1)).alias("n"))
    return f.agg(r(F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("weighted"), r(F.avg("score")).alias("plain"))


@query("select s_suppkey, round((s_acctbal - avg(s_acctbal) over ()) / (max(s_acctbal) over () - min(s_acctbal) over () + 1e-5), 6) as z from supplier")
def range_normalise(spark, d):
    s = table(spark, d, "supplier")
    one = F.broadcast(s.agg(F.avg("s_acctbal").alias("m"), (F.max("s_acctbal") - F.min("s_acctbal") + 1e-5).alias("w")))  # one row
    return s.crossJoin(one).select("s_suppkey", r((F.col("s_acctbal") - F.col("m")) / F.col("w")).alias("z"))


@query("select p_partkey, upper(p_name) as upper_name, split_part(p_name, ' ', 1) as first_word, replace(p_brand, '#', '_') as brand, starts_with(p_type, 'E') as starts, contains(p_name, 'ring') as has, regexp_extract(p_brand, '([0-9]+)', 1) as number from part")
def string_functions(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.upper("p_name").alias("upper_name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"), F.startswith("p_type", F.lit("E")).alias("starts"), F.contains("p_name", F.lit("ring")).alias("has"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("number"))


@query("select p_partkey, round(ln(p_retailprice), 6) as l, round(sqrt(p_retailprice), 6) as s, round(exp(-p_size / 10.0::double), 6) as e, round_even(p_retailprice, 0) as h, round(abs(p_size - 25) ^ 1.5, 6) as w from part")
def math_functions(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", r(F.ln("p_retailprice")).alias("l"), r(F.sqrt("p_retailprice")).alias("s"), r(F.exp(-F.col("p_size") / 10.0)).alias("e"), C.half_even(F.col("p_retailprice")).alias("h"), r(F.pow(F.abs(F.col("p_size") - 25), F.lit(1.5))).alias("w"))


@query("select round(corr(l_quantity, l_extendedprice) ^ 2, 6) as r2, round(covar_samp(l_quantity, l_tax), 6) as cov from lineitem")
def pearson_r2(spark, d):
    return table(spark, d, "lineitem").agg(r(F.pow(F.corr("l_quantity", "l_extendedprice"), F.lit(2.0))).alias("r2"), r(F.covar_samp("l_quantity", "l_tax")).alias("cov"))


@query("select event_type, min_by(event_id, (value, event_id)) as lowest, max_by(event_id, (value, -event_id)) as highest from events group by 1")
def arg_extremes(spark, d):
    e = table(spark, d, "events").groupBy("event_type")
    return e.agg(F.min_by("event_id", F.struct("value", "event_id")).alias("lowest"), F.max_by("event_id", F.struct("value", (-F.col("event_id")).alias("k"))).alias("highest"))


@query("select coalesce(event_type, 'all') as event_type, count(*) as n, round(avg(value), 6) as mean from events group by grouping sets ((event_type), ())")
def grouping_sets(spark, d):
    return table(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean")).withColumn("event_type", F.coalesce("event_type", F.lit("all")))
