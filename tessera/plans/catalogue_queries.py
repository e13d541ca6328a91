"""Sources and sinks, names and frames, splits, searches, matchings, components and settings on the shared tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera import memo
from tessera.functions import columns as C
from tessera.functions import special
from tessera.operators import decompose, features, folds, gram, match, metrics, prep, relate, resample
from tessera.plans import harness, identify
from tessera.plans.registry import query, r, table
from tessera.scratch import new_path
from tessera.sources import frames

_NATION = "n_nationkey int, n_name string, n_regionkey int"


def _names(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos long, name string")


def _listed(*names):
    return "select pos, name from (values " + ", ".join(f"({i}::bigint, '{n}')" for i, n in enumerate(names)) + ") t(pos, name)"


# -- sources and sinks ----------------------------------------------------------
@query("select n_nationkey, n_name, n_regionkey from nation")
def csv_round_trip(spark, d):
    path = new_path(spark, "csv")
    frames.write_csv(table(spark, d, "nation"), path)
    return frames.csv(spark, path, _NATION)


@query("select s_suppkey, s_name, s_acctbal from supplier")
def tsv_round_trip(spark, d):
    path = new_path(spark, "tsv")
    frames.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, sep="\t")
    return frames.tsv(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("select n_nationkey, n_name, n_regionkey from nation where n_regionkey < 3 union all select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 1")
def csv_append(spark, d):
    path, n = new_path(spark, "appended"), table(spark, d, "nation")
    frames.write_csv(n.where("n_regionkey < 3"), path)
    frames.write_csv(n.where("n_regionkey = 1"), path, append=True)
    return frames.csv(spark, path, _NATION)


@query("select p_partkey, p_brand, case when p_size % 2 = 0 then p_retailprice end as price from part")
def annotation_lookup(spark, d):
    """A tab-separated dimension whose NaN becomes null at the scan, joined to its facts."""
    path = new_path(spark, "annotation")
    p = table(spark, d, "part")
    frames.write_csv(p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).otherwise(F.lit(float("nan"))).alias("price")), path, sep="\t")
    return p.select("p_partkey", "p_brand").join(frames.tsv(spark, path, "p_partkey long, price double"), "p_partkey", "left")


@query("select r_regionkey, r_name from region")
def compute_once(spark, d):
    path = new_path(spark, "once")

    def again():
        raise AssertionError("made twice")

    frames.compute_once(spark, path, lambda: table(spark, d, "region"))
    return frames.compute_once(spark, path, again)


@query("select c_custkey, c_acctbal + 1 as c_acctbal from customer")
def snapshot_version(spark, d):
    """The second of two versions of a namespace."""
    root, c = new_path(spark, "store"), table(spark, d, "customer").select("c_custkey", "c_acctbal")
    c.write.parquet(f"{root}/people/v1")
    c.withColumn("c_acctbal", F.col("c_acctbal") + 1).write.parquet(f"{root}/people/v2")
    return frames.snapshot(spark, root, "people", "v2")


@query("select 1::bigint as place, 'b' as run, 84.5::double as precision union all select 2, 'c', 71.25 union all select 3, 'a', 60.0")
def run_catalogue(spark, d):
    root = new_path(spark, "runs")
    for name, p in (("a", 60.0), ("b", 84.5), ("c", 71.25)):
        frames.write_run(spark, f"{root}/{name}", {"precision": p, "model": name})
    rows = [(i + 1, x["run"], x["precision"]) for i, x in enumerate(frames.runs(spark, root).collect())]
    return spark.createDataFrame(rows, "place long, run string, precision double")


@query("select 'alpha' as name, 2.5::double as value union all select 'beta[0]', 1.0 union all select 'beta[1]', -3.0 union all select 'nested.kind', 7.0")
def model_table(spark, d):
    path = new_path(spark, "model")
    frames.save_model(spark, path, {"alpha": 2.5, "beta": np.array([1.0, -3.0]), "nested": {"kind": 7}})
    m = frames.load_model(spark, path)
    rows = [("alpha", m["alpha"]), *[(f"beta[{i}]", float(b)) for i, b in enumerate(m["beta"])], ("nested.kind", float(m["nested"]["kind"]))]
    return spark.createDataFrame(rows, "name string, value double")


@query("select n_name as \"id\", n_nationkey::double as height, (n_regionkey * 2)::double as age from nation")
def two_header_table(spark, d):
    """A table whose first line gives roles and whose second names."""
    path = new_path(spark, "roles")
    lines = [",Y,X", "id,height,age"] + [f"{x.n_name},{x.n_nationkey},{x.n_regionkey * 2}" for x in table(spark, d, "nation").orderBy("n_nationkey").collect()]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    df, by = frames.two_header_csv(spark, path)
    assert by == {"index": ["id"], "Y": ["height"], "X": ["age"]}
    return df


@query("select p_partkey, chrom, pos from (select p_partkey, (p_size % 5)::varchar as chrom, p_partkey as pos from part) where (chrom = '1' and pos between 10 and 400) or (chrom = '3' and pos between 100 and 120)")
def variant_ranges(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).cast("string").alias("chrom"), F.col("p_partkey").alias("pos"))
    return frames.variants_in(spark, p, ["chr1_10-400", "3_100-120"]).select("p_partkey", p["chrom"], "pos")


@query(
    """with g as (select l_suppkey as sample, l_partkey % 50 as variant, min(l_linenumber % 3) as dosage from lineitem group by 1, 2)
    select sample, max(dosage) filter (variant = 3) as "3", max(dosage) filter (variant = 7) as "7" from g where variant in (3, 7) group by 1"""
)
def wide_genotypes(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 50).alias("variant")).agg(F.min(F.col("l_linenumber") % 3).alias("dosage"))
    return frames.wide_genotypes(g.withColumn("variant", F.col("variant").cast("string")), ["3", "7"])


@query("select 'v' || p_partkey as variant, (p_size % 22 + 1)::varchar as chrom, p_partkey * 100 as pos, round(p_retailprice / 1000, 4) as beta, 1.0::double / (1 + p_size) as p from part where 1.0 / (1 + p_size) < 0.05")
def association_results(spark, d):
    path = new_path(spark, "associations")
    rows = table(spark, d, "part").select(
        F.concat(F.lit("v"), "p_partkey").alias("variant"), (F.col("p_size") % 22 + 1).cast("string").alias("chrom"), (F.col("p_partkey") * 100).alias("pos"),
        F.round(F.col("p_retailprice") / 1000, 4).alias("beta"), (1 / (1 + F.col("p_size"))).alias("p"),
    )
    frames.write_csv(rows, path)
    return frames.associations(spark, path).where("p < 0.05")


@query("select s_suppkey, unnest([s_suppkey, s_suppkey + 20]) as \"start\", unnest([s_suppkey + 5, s_suppkey + 29]) as \"end\" from supplier")
def exon_intervals(spark, d):
    k = F.col("s_suppkey")
    cell = F.format_string("[%d-%d, %d-%d]", k, k + 5, k + 20, k + 29)
    return frames.exon_ranges(table(spark, d, "supplier").select("s_suppkey", cell.alias("cds")), "cds").select("s_suppkey", "start", "end")


# -- names and frames ------------------------------------------------------------
@query(_listed("c_custkey", "c_nationkey", "c_acctbal"))
def any_pattern(spark, d):
    return _names(spark, prep.columns_like(table(spark, d, "customer").columns, prep.any_of(["key$", "^c_acct"])))


@query(_listed("c_name", "c_acctbal"))
def anchored_names(spark, d):
    return _names(spark, prep.columns_like(table(spark, d, "customer").columns, prep.exactly(["c_acctbal", "c_name", "c_nam"])))


@query(_listed("c_custkey", "c_nationkey", "age", "age_squared"))
def covariate_names(spark, d):
    """A covariate by pattern in the frame, others among the source's keys."""
    df, source = table(spark, d, "customer"), ["age", "age_squared", "weight"]
    return _names(spark, frames.expand(df, "key$", source) + frames.expand(df, "age.*", source) + frames.expand(df, "absent", source))


@query("select c_custkey, x, y from (select c_custkey, case when c_custkey % 3 > 0 then c_acctbal end as x, case when c_custkey % 2 > 0 then c_mktsegment end as y from customer) where x is not null or y is not null")
def drop_empty_rows(spark, d):
    k = F.col("c_custkey")
    df = table(spark, d, "customer").select("c_custkey", F.when(k % 3 > 0, F.col("c_acctbal")).alias("x"), F.when(k % 2 > 0, F.col("c_mktsegment")).alias("y"))
    return prep.drop_empty(df, ["x", "y"])


@query("select r_regionkey as id, r_name as dim_r_name from region")
def rename_columns(spark, d):
    return prep.renamed(table(spark, d, "region"), {"r_regionkey": "id"}, "dim_")


@query("select n_nationkey as a_b_c, n_name as name_en_, n_regionkey as plain from nation")
def sanitised_names(spark, d):
    df, back = prep.sanitised(table(spark, d, "nation").toDF("a.b-c", "name en*", "plain"))
    assert back["a_b_c"] == "a.b-c"
    return df


@query("select c_custkey, case when c_custkey % 4 = 0 then c_custkey * 2 end as c_acctbal from customer")
def set_feature(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return relate.set_feature(c, c.where("c_custkey % 4 = 0").select("c_custkey", (F.col("c_custkey") * 2).alias("c_acctbal")), "c_custkey", "c_acctbal")


@query("select o_orderkey, o_orderstatus from orders")
def drop_by_name_part(spark, d):
    return prep.without(table(spark, d, "orders"), ["cust", "price", "date", "priority"])


@query(_listed("r_name", "r_regionkey"))
def sorted_columns(spark, d):
    return _names(spark, prep.sorted_columns(table(spark, d, "region")).columns)


@query("select least(100, count(*)) as n, count(*) filter (c_custkey in (5, 9, 700)) as forced from customer")
def limited_samples(spark, d):
    few = prep.limited(table(spark, d, "customer").select("c_custkey"), "c_custkey", 100, [5, 9, 700])
    return few.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_custkey").isin(5, 9, 700)).alias("forced"))


@query("select c_custkey from customer where c_custkey % 10 = 0 and c_custkey % 15 = 0")
def overlapping_flags(spark, d):
    """Keys that are bound to training and to hold-out at once; the folds' check names them in its error."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", (k % 10 == 0).alias("train"), (k % 15 == 0).alias("hold"))
    try:
        folds.hashed_folds(c, "c_custkey", keep_in_training=["train"], keep_in_holdout=["hold"])
    except ValueError:
        return c.where("train and hold").select("c_custkey")
    return c.limit(0).select("c_custkey")


@query(_listed("vector"))
def packed_detection(spark, d):
    v = F.to_json(F.array(F.col("c_acctbal"), F.lit(1.0)))
    df = table(spark, d, "customer").select("c_name", "c_mktsegment", F.when(F.col("c_custkey") > 10, v).alias("vector"))
    return _names(spark, prep.packed_columns(df))


@query("select vec_id, embedding[1]::double as v_1, embedding[2]::double as v_2, embedding[3]::double as v_3 from embeddings")
def unpacked_vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.to_json(F.slice("embedding", 1, 5).cast("array<double>")).alias("v"))
    return prep.unpack_columns(e, ["v"], {"v": 3})


@query("select kind, \"column\" from (values ('a', 'pc_1'), ('a', 'pc_2'), ('a', 'pc_3'), ('b', 'age'), ('c', 'rgb_1'), ('c', 'rgb_2')) t(kind, \"column\")")
def expanded_names(spark, d):
    names = spark.createDataFrame([("a", "pc"), ("b", "age"), ("c", "rgb")], "kind string, `column` string")
    return prep.expanded_names(names, "column", {"pc": 3, "rgb": 2})


@query("select vec_id, [embedding[1]::double, embedding[2]::double, label::double, vec_id::double] as v from embeddings")
def stacked_blocks(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.concat(F.slice("embedding", 1, 2).cast("array<double>"), F.array(F.col("label").cast("double"), F.col("vec_id").cast("double"))).alias("v"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'rs2' when c_custkey % 3 = 1 then 'rs9' end as rsid from customer")
def first_wanted_id(spark, d):
    k = F.col("c_custkey") % 3
    cell = F.when(k == 0, "rs1,rs2,rs9").when(k == 1, "rs7,rs9").otherwise("rs5")
    return table(spark, d, "customer").select("c_custkey", C.first_wanted(cell, ["rs2", "rs9"]).alias("rsid"))


@query("select l_orderkey, l_linenumber, coalesce(case when l_linenumber % 2 = 0 then l_tax end, 0) + l_discount as pooled from lineitem")
def pooled_classes(spark, d):
    rare = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.row_sum(rare, F.col("l_discount")).alias("pooled"))


@query("select i as \"start\", least(i + 400, n) as \"end\" from (select count(*) as n from part), unnest(range(0, n, 400)) t(i)")
def block_intervals(spark, d):
    return spark.createDataFrame(prep.blocks(table(spark, d, "part").count(), 400), "`start` long, `end` long")


@query("select p_partkey, round(1 - b - c, 6) as a, round(b, 6) as b, round(c, 6) as c from (select p_partkey, x - y / 0.8660254037844386 / 2 as b, y / 0.8660254037844386 as c from (select p_partkey, p_size / 50.0::double as x, p_partkey % 7 / 10.0::double as y from part))")
def barycentric_weights(spark, d):
    w = special.barycentric(F.col("p_size") / 50.0, F.col("p_partkey") % 7 / 10.0)
    return table(spark, d, "part").select("p_partkey", *[r(x).alias(n) for x, n in zip(w, "abc", strict=True)])


@query("select p_partkey, round(-ln(u), 6) as pdf, round(u * (1 - ln(u)), 6) as cdf, round(ln(u) ^ 2 / 2, 6) as pdf3 from (select p_partkey, p_size / 51.0::double as u from part)")
def product_of_uniforms(spark, d):
    u = F.col("p_size") / 51.0
    return table(spark, d, "part").select("p_partkey", r(special.uniform_product_pdf(u)).alias("pdf"), r(special.uniform_product_cdf(u)).alias("cdf"), r(special.uniform_product_pdf(u, 3)).alias("pdf3"))


@query("select step, reason, lost from (select 1 as step, 'cheap' as reason, count(*) filter (l_quantity < 40 and l_extendedprice < 5000) as lost from lineitem)")
def ledger_of_changes(spark, d):
    """Only the rules that removed rows."""
    li = table(spark, d, "lineitem")
    led = prep.filter_ledger(li, [("any", F.col("l_quantity") > 0), ("cheap", ~((F.col("l_quantity") < 40) & (F.col("l_extendedprice") < 5000))), ("none", F.col("l_tax") >= 0)])
    return led.where("lost > 0")


# -- splits, searches, preparation -----------------------------------------------
@query("select c_custkey, c_custkey % 7 = 0 or (c_custkey % 7 <> 0 and k >= floor(0.8::double * n)) as is_test from (select *, row_number() over (partition by c_custkey % 7 = 0 order by c_custkey) - 1 as k, count(*) over (partition by c_custkey % 7 = 0) as n from customer where c_custkey % 11 <> 0 and c_custkey <= 700)")
def train_test_lists(spark, d):
    """Removed and held-out samples by list, the rest by ratio."""
    c = table(spark, d, "customer").select("c_custkey").where("c_custkey <= 700")
    ids = [x.c_custkey for x in c.collect()]  # lists are a caller's
    return folds.train_test(c, "c_custkey", 0.8, held_out=[i for i in ids if i % 7 == 0 and i % 11], removed=[i for i in ids if i % 11 == 0])


@query(
    """with s as (select l_linenumber as k, count(*)::double as n, sum(l_quantity) as sx, sum(l_extendedprice) as sy, sum(l_quantity * l_quantity) as sxx, sum(l_quantity * l_extendedprice) as sxy, sum(l_extendedprice ^ 2) as syy from lineitem group by 1),
    t as (select s.*, tn - n as n2, (tsx - sx) / (tn - n) as mx, (tsy - sy) / (tn - n) as my, (tsxx - sxx) as xx, (tsxy - sxy) as xy from s, (select sum(n) tn, sum(sx) tsx, sum(sy) tsy, sum(sxx) tsxx, sum(sxy) tsxy from s)),
    m as (select *, (xy - n2 * mx * my) / (xx - n2 * mx * mx + a) as b from t, (values (0.01), (100000.0), (1000000.0)) g(a)),
    e as (select a, k, n, syy - 2 * (my - b * mx) * sy - 2 * b * sxy + n * (my - b * mx) ^ 2 + 2 * (my - b * mx) * b * sx + b * b * sxx as sse from m)
    select a::double as alpha, round(sum(sse) / sum(n) / 1e6::double, 3) as mean_mse_millions from e group by a"""
)
def basic_cross_validation(spark, d):
    sums = gram.gram(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_linenumber")
    found = gram.basic_search(sums, [0.01, 100000.0, 1000000.0], lambda s, a: gram.ridge(s, 1, a))
    return spark.createDataFrame([(float(a), float(m) / 1e6) for a, m in found["ranked"]], "alpha double, m double").select("alpha", r("m", 3).alias("mean_mse_millions"))


@query()
def holdout_predictions(spark, d):
    """Out-of-fold predictions, and of hold-out rows those of all folds' models."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice")
    own = folds.hashed_folds(li, "l_orderkey", check=False)
    columns = ["l_quantity", "l_tax"]
    res = gram.search(gram.cells(own, [*columns, "l_extendedprice"], "l_orderkey", "fold"), list(gram.ALPHAS), lambda s, a: gram.ridge(s, 1, a))
    return harness.with_holdout(own, res, columns, 10).select("l_orderkey", "l_linenumber", "fold", r("predicted", 2).alias("predicted"))


@query()
def harness_with_extras(spark, d):
    li = table(spark, d, "lineitem")
    return harness.evaluate(li, "l_orderkey", {"price": "l_extendedprice"}, {"Q": ["l_quantity"], "QT": ["l_quantity", "l_tax"]}, extra=("std", "holdout"))


@query("select * from (values ('l_discount', 'drop', 0.0::double, false), ('l_quantity', 'mean', 4.0, true), ('l_tax', 'mode', 2.0, true)) t(\"column\", missing, clip, standard)")
def resolved_specs(spark, d):
    """Later rules override earlier ones; a rule names columns by pattern or by list."""
    s = prep.resolve([("^l_", prep.STANDARD), (["l_tax"], prep.Spec("mode", True, 2.0)), ("disc", prep.DROP_ONLY)], ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(c, x.missing, float(x.clip), x.standard) for c, x in s.items()], "`column` string, missing string, clip double, standard boolean")


@query(
    """with t as (select avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem where l_linenumber <= 2)
    select l_orderkey, l_linenumber, round((greatest(least(case when l_linenumber = 7 then m else l_quantity end, m + 1.2 * s), m - 1.2 * s) - m) / s, 6) as l_quantity from lineitem, t"""
)
def prepared_on_training(spark, d):
    """Fitted on the training rows, applied to all; missing values become the training mean."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("l_quantity"))
    p = prep.Prepared({"l_quantity": prep.Spec("mean", True, 1.2)}, li.where("l_linenumber <= 2"))
    return p.apply(li).select("l_orderkey", "l_linenumber", r("l_quantity").alias("l_quantity"))


@query("select l_orderkey, l_linenumber, round(regr_intercept(l_extendedprice, l_quantity) over () + regr_slope(l_extendedprice, l_quantity) over () * l_quantity, 2) as predicted from lineitem")
def wrapped_model(spark, d):
    """Preparation travels with the model; predictions come back on the target's scale."""
    li, spec = table(spark, d, "lineitem"), prep.Spec("mean", True, 0)
    m = harness.Wrapped(li, ["l_quantity"], "l_extendedprice", {"l_quantity": spec, "l_extendedprice": spec}, 1e-8)
    return m.predict(li.select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", "l_linenumber", r("predicted", 2).alias("predicted"))


@query("select p_partkey, p_retailprice, p_size::double as size, (p_partkey % 3 = 1)::int::double as kind_b, (p_partkey % 3 = 2)::int::double as kind_c from part where p_size > 5 and p_partkey % 13 <> 0")
def clean_pipeline(spark, d):
    """All steps of preparation in their order."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(
        "p_partkey", "p_retailprice", F.when(k % 13 > 0, F.col("p_size").cast("string")).alias("size"), F.element_at(F.array(*map(F.lit, "abc")), (k % 3 + 1).cast("int")).alias("kind"),
        F.lit(None).cast("double").alias("empty"), "p_name",
    )
    df, names, _ = prep.cleaned_for_models(p.withColumn("p_size", F.col("size").cast("int")), "p_retailprice", ["p_partkey", "size", "kind", "empty", "p_name"], {"p_size": (5, ">")}, ["kind"], trim=None)
    return df.select("p_partkey", "p_retailprice", "size", "kind_b", "kind_c")


@query("select '' as stars, 0.5::double as better, 0.5::double as worse")
def bootstrap_invalid(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_tax", "l_discount", "l_quantity")
    return resample.bootstrap_of(li, "l_orderkey", "l_tax", ["l_discount", "l_quantity"])


@query()
def permutation_set_test(spark, d):
    li = table(spark, d, "lineitem")
    rows = [(n, *resample.permuted_r2(li, "l_orderkey", ["l_tax"], [c], "l_extendedprice").values()) for n, c in (("quantity", "l_quantity"), ("discount", "l_discount"))]
    return spark.createDataFrame(rows, "name string, gain double, p double").select("name", r("gain").alias("gain"), r("p", 3).alias("p"))


# -- metrics -----------------------------------------------------------------------
_OUT = "(select l_extendedprice as y0, l_quantity * 1500 as p0, l_tax as y1, l_discount as p1 from lineitem)"


@query(
    f"""with c as (select '0' as component, sum((y0 - p0) ^ 2) as sse, sum(abs(y0 - p0)) as sae, var_pop(y0) * count(*) as sst, count(*) as n from {_OUT}
    union all select '1', sum((y1 - p1) ^ 2), sum(abs(y1 - p1)), var_pop(y1) * count(*), count(*) from {_OUT}), a as (select * from c union all select 'weighted', sum(sse), sum(sae), sum(sst), sum(n)::bigint from c)
    select component, round(1 - sse / sst, 6) as r2, round(sae / n, 4) as mae, n from a"""
)
def component_metrics(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y0"), (F.col("l_quantity") * 1500).alias("p0"), F.col("l_tax").alias("y1"), F.col("l_discount").alias("p1"))
    return metrics.by_component(li, ["y0", "y1"], ["p0", "p1"]).select("component", r("r2").alias("r2"), r("mae", 4).alias("mae"), "n")


@query("select round(avg(ln(greatest(least(case when quality = 1 then p else 1 - p end, 1 - 1e-15), 1e-15))), 6) as with_probability, round(avg((quality = (p >= 0.5)::int)::int), 6) as with_labels from (select quality, (doc_id % 97 + 1) / 99.0::double as p from labels)")
def hybrid_scores(spark, d):
    t = table(spark, d, "labels").select("quality", ((F.col("doc_id") % 97 + 1) / 99.0).alias("p"))
    y, p = F.col("quality"), F.col("p")
    return t.agg(r(metrics.hybrid_score(y, None, p)).alias("with_probability"), r(metrics.hybrid_score(y, (p >= 0.5).cast("int"))).alias("with_labels"))


@query("select round(sum(l * n) / sum(n), 6) as log_loss, sum(n)::bigint as n from (select l_linenumber, -avg(ln((l_quantity + 1) / 52)) as l, count(*) as n from lineitem group by 1)")
def weighted_log_loss(spark, d):
    li = table(spark, d, "lineitem").select("l_linenumber", ((F.col("l_quantity") + 1) / 52).alias("p"))
    return metrics.weighted_log_loss(li, "p", "l_linenumber").select(r("log_loss").alias("log_loss"), "n")


# -- matching --------------------------------------------------------------------------
@query("select c_custkey as source, c_custkey as target_a, case when c_custkey % 5 > 0 then c_custkey + (c_custkey % 2) end as target_b, c_custkey % 5 > 0 and c_custkey % 2 = 0 as agree from customer")
def compared_matchings(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    return match.compared(c.select(k.alias("source"), k.alias("target")), c.where(k % 5 > 0).select(k.alias("source"), (k + k % 2).alias("target")))


@query("select l_orderkey as source, l_linenumber as target, round((l_tax + l_discount) / 2, 6) as rates, case when l_linenumber > 3 then l_quantity end as amount from lineitem")
def group_mean_residuals(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("target"), "l_tax", "l_discount", F.when(F.col("l_linenumber") > 3, F.col("l_quantity")).alias("l_quantity"))
    m = match.group_means(li, {"rates": ["l_tax", "l_discount"], "amount": ["l_quantity"]})
    return m.select("source", "target", r("rates").alias("rates"), "amount")


@query("select 'match' as method, 1.0::double as accuracy union all select 'select', 1.0 union all select 'select_unique', 1.0 union all select 'match_query', 1.0 union all select 'select_query', 1.0")
def lineup_accuracies(spark, d):
    """A positive control: vectors that are found again among their line-up by a scaled copy."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("w", F.transform("v", lambda x: x * 0.9))
    return match.lineup_accuracies(match.similarity(match.pairs_in(match.lineups(v, "vec_id", 20, 10), v, "vec_id", "v", "w", "cosine")))


@query("select s_suppkey as source, s_nationkey as target, round(case when s_suppkey % 4 = 0 then m else s_acctbal end, 4) as distance from supplier, (select avg(s_acctbal) as m from supplier where s_suppkey % 4 <> 0)")
def null_rows_mean(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("target"), F.col("s_acctbal").alias("distance"))
    return match.null_rows_mean(s, F.col("source") % 4 == 0).withColumn("distance", r("distance", 4))


@query()
def matching_panel(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)], *[(F.col("embedding")[i] * 1.01).cast("double").alias(f"y{i}") for i in range(4)])
    sets = {"two": (["x0", "x1"], ["y0", "y1"]), "four": ([f"x{i}" for i in range(4)], [f"y{i}" for i in range(4)])}
    return match.panel(e, "vec_id", sets, ["cosine", "Euclidean"], 10, 8).withColumn("accuracy", r("accuracy"))


@query("select a.s_suppkey as source, b.s_suppkey as target, round(1 / (1 + abs(a.s_acctbal - b.s_acctbal)), 8) as p from supplier a join supplier b on a.s_nationkey = b.s_nationkey")
def probability_pairs(spark, d):
    """Long probabilities of all pairs within groups: the table is the square matrix's own form."""
    s = table(spark, d, "supplier")
    a, b = (s.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias(n), F.col("s_acctbal").alias(f"_{n}")) for n in ("source", "target"))
    return a.join(b, "g").select("source", "target", r(1 / (1 + F.abs(F.col("_source") - F.col("_target"))), 8).alias("p"))


# -- components and small learners --------------------------------------------------------
def _wide(spark, d, n):
    return table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)])


@query(
    "select 'first' as block, round(var_pop(embedding[1]::double) + var_pop(embedding[2]::double), 6) as total from embeddings "
    "union all select 'second', round(var_pop(embedding[3]::double) + var_pop(embedding[4]::double) + var_pop(embedding[5]::double), 6) from embeddings"
)
def pca_by_block(spark, d):
    """All components of a block together have its columns' variance."""
    got = decompose.pca_by_block(_wide(spark, d, 5), {"first": ["x0", "x1"], "second": ["x2", "x3", "x4"]}, 3)
    return spark.createDataFrame([(n, float(np.sum(c.variances))) for n, c in got.items()], "block string, total double").select("block", r("total").alias("total"))


def _matrix(spark, d, n=8, rows=200):
    """A caller's small matrix: the operators below solve on one machine by definition."""
    got = _wide(spark, d, n).orderBy("vec_id").limit(rows).toArrow()
    return np.column_stack([got.column(f"x{i}").to_numpy() for i in range(n)])


@query()
def snp_pca(spark, d):
    _, var = decompose.snp_pca(_matrix(spark, d) - _matrix(spark, d).mean(0), 3)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(var)], "component int, v double").select("component", r("v").alias("variance"))


@query()
def kernel_pca(spark, d):
    x = _matrix(spark, d)
    _, var, noise = decompose.kernel_pca(x @ x.T, 3)
    return spark.createDataFrame([(i + 1, float(v), noise) for i, v in enumerate(var)], "component int, v double, n double").select("component", r("v", 5).alias("variance"), r("n", 5).alias("noise"))


@query()
def mixed_model(spark, d):
    x = _matrix(spark, d)
    m = decompose.mixed_model(x @ np.arange(1, 9) + np.sin(np.arange(len(x))), np.ones((len(x), 1)), x @ x.T / 8)
    return spark.createDataFrame([(m["h2"], m["nll"])], "h double, l double").select(r("h", 4).alias("h2"), r("l", 3).alias("nll"))


@query()
def lmm_lasso(spark, d):
    x = _matrix(spark, d)
    m = decompose.lmm_lasso(x, x[:, 0] * 3 - x[:, 5] * 2 + 0.01 * np.sin(np.arange(len(x))), x[:, 6:] @ x[:, 6:].T, 0.05)
    return spark.createDataFrame([(f"x{i}", float(b)) for i, b in enumerate(m["beta"])], "`column` string, b double").select("column", r("b", 4).alias("beta"))


@query()
def maxent_choice(spark, d):
    x = _matrix(spark, d)[:, :6].reshape(-1, 3, 2)
    w = decompose.maxent(x, (x @ np.array([2.0, -1.0])).argmax(1), 1.0)
    return spark.createDataFrame([(f"x{i}", float(b)) for i, b in enumerate(w)], "`column` string, w double").select("column", r("w", 4).alias("weight"))


@query()
def group_lasso(spark, d):
    x = _matrix(spark, d)
    b = decompose.group_lasso(x, np.column_stack([x[:, 0], x[:, 0] - x[:, 3]]), 0.002)
    return spark.createDataFrame([(f"x{i}", bool(np.any(v != 0))) for i, v in enumerate(b)], "`column` string, chosen boolean")


@query()
def gwas_power(spark, d):
    return spark.createDataFrame([(e, float(special.gwas_power(e, 0.3, 5000))) for e in (0.05, 0.1, 0.2)], "effect double, p double").select("effect", r("p").alias("power"))


@query("select 'quadratic' as name, true as right")
def gradient_check(spark, d):
    gap = special.gradient_gap(lambda x: sum((v - i) ** 2 for i, v in enumerate(x)), lambda x: [2 * (v - i) for i, v in enumerate(x)], [0.3, -2.0, 5.0])
    return spark.createDataFrame([("quadratic", gap < 1e-6)], "name string, right boolean")


@query()
def percentile_smoother(spark, d):
    """Moving quantiles, smoothed by a ridge on powers of x."""
    m = features.moving_quantiles(table(spark, d, "events").select("event_id", "value"), "event_id", "value", [0.25, 0.75], 200)
    top = F.broadcast(m.agg(F.max("event_id").alias("_top")))  # one row
    z = m.crossJoin(top).withColumns({f"z{k}": F.pow(F.col("event_id") / F.col("_top"), F.lit(float(k))) for k in (1, 2, 3)})
    sums, names = gram.gram(z, ["z1", "z2", "z3", "q25", "q75"])[None], ["z1", "z2", "z3"]
    fit = gram.ridge(sums, 2, 1e-3)
    return z.select("event_id", *[r(fit.column(names, t), 4).alias(n) for t, n in enumerate(("q25", "q75"))])


# -- settings ---------------------------------------------------------------------------------
@query("select label, features from (values ('AGE', 'age'), ('GENDER', 'sex'), ('SNP', 's1,s2'), ('AG', 'age,sex'), ('AG + SNP', 'age,sex,s1,s2')) t(label, features)")
def covariate_sets(spark, d):
    """Standard sets, own ones, the aggregate by its initials, and what adds to it; the target is in none."""
    sets = harness.covariate_sets({"AGE": ["age"], "GENDER": ["sex"]}, {"SNP": ["s1", "s2", "height"]}, "height")
    return spark.createDataFrame([(k, ",".join(v)) for k, v in sets.items()], "label string, features string")


@query("select count(*) as n, count(distinct (covariates, size, version)) as kinds from (values ('a'), ('b'), ('c')) c(covariates), (values (10), (100)) s(size), (values ('v1'), ('v2')) v(version)")
def run_sweep(spark, d):
    s = identify.sweep({"a": ["x"], "b": ["y"], "c": ["x", "y"]}, [10, 100], ["v1", "v2"])
    t = spark.createDataFrame([(x["covariates"], x["size"], x["version"]) for x in s], "covariates string, size int, version string")
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("covariates", "size", "version").alias("kinds"))


_RESULTS = [("t", "Ridge", "AG + SNP", 0.4), ("t", "Mean", "", 0.0), ("t", "Ridge", "SNP", 0.2), ("t", "Ridge", "AG", 0.3), ("t", "Ridge", "AGE", 0.1), ("u", "Ridge", "AG", 0.5), ("u", "Mean", "", 0.0)]


def _results(spark):
    return spark.createDataFrame(_RESULTS, "target string, model string, covariates string, r2 double")


@query("select * from (values (0::bigint, ''), (1, 'AGE'), (2, 'SNP'), (3, 'AG'), (4, 'AG + SNP')) t(place, covariates)")
def reading_order(spark, d):
    rows = harness.ordered(_results(spark).where("target = 't'"), ["AGE"], ["SNP"], "AG").collect()
    return spark.createDataFrame([(i, x.covariates) for i, x in enumerate(rows)], "place long, covariates string")


@query("select * from (values ('Mean', '', 0.0::double, 0.0::double), ('Ridge', 'AG', 0.3, 0.5), ('Ridge', 'AG + SNP', 0.4, null), ('Ridge', 'SNP', 0.2, null), ('Ridge', 'AGE', 0.1, null)) t(model, covariates, \"t: r2\", \"u: r2\")")
def targets_side_by_side(spark, d):
    return harness.side_by_side(_results(spark), ["t", "u"], ["r2"])


@query("select * from (values ('Mean', ''), ('Ridge', 'AG'), ('Ridge', 'AG + SNP'), ('Ridge', 'AGE')) t(model, covariates)")
def rows_with_prefix(spark, d):
    return harness.with_prefix(_results(spark).where("target = 't'"), "AG").select("model", "covariates")


@query("select 'rows' as what, count(*) as n from nation union all select 'made', 2 union all select 'gone', 1")
def memo_groups(spark, d):
    """A result is made once, and again only after a group that it rests on has changed."""
    made, m = [], memo.Memo()
    make = lambda: (made.append(1), table(spark, d, "nation"))[1]
    n = m.get("nations", ["data"], make).count() and m.get("nations", ["data"], make).count()
    gone = m.changed("settings") + m.changed("data")
    m.get("nations", ["data"], make)
    m.changed("data")
    return spark.createDataFrame([("rows", n), ("made", len(made)), ("gone", len(gone))], "what string, n long")
