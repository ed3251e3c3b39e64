"""Queries over feature tables, splits, baselines and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from targetloom.functions.numeric import r6
from targetloom.operators import learning as L
from targetloom.operators.boosting import Member, fit_trees, importances, predict
from targetloom.operators.permutation import GRID_SQL, KEYS_SQL, PLACE_SQL
from targetloom.operators.prefix import average_ranks
from targetloom.operators.ranking import spearman
from targetloom.plans.registry import query
from targetloom.plans.roles import ROLE_SQL, Inputs
from targetloom.session import cut_lineage

_U = "((CAST(concat('0x', substr(md5(concat_ws('|', {keys})), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
_OMICS = ["log_tpm", "log2_cn", "damaging_mutation"]


def _features(x: Inputs, how: str = "left") -> DataFrame:
    f = x.line_features
    keys = ["cell_line_id", "kinase_id"]
    target = f.select(*keys, F.col("dependency_prob").alias("target"))
    # a table without a measurement has no row for it
    parts = [f.where(F.col(c).isNotNull()).select(*keys, c) for c in _OMICS]
    return L.multi_omic_features(target, parts, _OMICS, keys, how)


@query(
    "c02_multi_omic_features",
    """WITH m AS (SELECT quantile_cont(log_tpm, 0.5) AS a, quantile_cont(log2_cn, 0.5) AS b, quantile_cont(damaging_mutation, 0.5) AS c FROM line_features)
       SELECT cell_line_id, kinase_id, round(dependency_prob, 6) AS target, round(coalesce(log_tpm, a), 6) AS log_tpm, round(coalesce(log2_cn, b), 6) AS log2_cn,
              round(coalesce(damaging_mutation, c), 6) AS damaging_mutation, avg(dependency_prob) OVER (PARTITION BY kinase_id) > 0.05 AS pan_essential FROM line_features CROSS JOIN m""",
)
def _(x: Inputs) -> DataFrame:
    rows = _features(x)
    pan = rows.groupBy("kinase_id").agg((F.avg("target") > 0.05).alias("pan_essential"))
    return rows.join(pan, "kinase_id").select("cell_line_id", "kinase_id", *[r6(c).alias(c) for c in ("target", *_OMICS)], "pan_essential")


@query(
    "c03_response_and_profiles",
    """WITH ok AS (SELECT * FROM line_features WHERE log_tpm IS NOT NULL AND log2_cn IS NOT NULL), med AS (SELECT kinase_id, quantile_cont(log_tpm, 0.5) AS m FROM ok GROUP BY 1),
       g AS (SELECT l.cell_line_id, k.kinase_id FROM (SELECT DISTINCT cell_line_id FROM ok) l CROSS JOIN (SELECT DISTINCT kinase_id FROM line_features) k)
       SELECT g.cell_line_id, count(ok.log_tpm) AS n_seen, round(sum(coalesce(ok.log_tpm, m, 0.0)), 6) AS profile_sum, round(max(coalesce(ok.log_tpm, m, 0.0)), 6) AS profile_max
       FROM g LEFT JOIN ok ON ok.cell_line_id = g.cell_line_id AND ok.kinase_id = g.kinase_id LEFT JOIN med ON med.kinase_id = g.kinase_id GROUP BY 1""",
)
def _(x: Inputs) -> DataFrame:
    ok = x.line_features.where("log_tpm IS NOT NULL AND log2_cn IS NOT NULL")
    p = L.panel_profiles(ok, "cell_line_id", "kinase_id", "log_tpm", x.line_features)
    total = F.aggregate("profile", F.lit(0.0), lambda a, v: a + v)
    return p.select("cell_line_id", F.size(F.filter("mask", lambda m: m)).cast("long").alias("n_seen"), r6(total).alias("profile_sum"), r6(F.array_max("profile")).alias("profile_max"))


_FOLD = """pl AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, g) AS p FROM (SELECT l_suppkey AS g, count(*) AS n FROM lineitem GROUP BY 1) q),
    deal AS (SELECT CAST(0 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS g, -1 AS fold, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads
        UNION ALL SELECT pl.p, pl.g, CAST(list_position(loads, list_min(loads)) AS INTEGER) - 1,
            list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN pl.n ELSE 0 END) FROM deal JOIN pl ON pl.p = deal.p + 1),
    fd AS (SELECT g, fold FROM deal WHERE p > 0)"""


@query("k20_grouped_folds", f"WITH RECURSIVE {_FOLD} SELECT g AS l_suppkey, fold FROM fd")
def _(x: Inputs) -> DataFrame:
    return L.balanced_group_folds(x.lineitem, "l_suppkey")


@query(
    "k21_identity_baseline",
    f"""WITH RECURSIVE {_FOLD}, r AS (SELECT p_brand AS gene, fold, l_extendedprice AS y FROM lineitem JOIN part ON l_partkey = p_partkey JOIN fd ON g = l_suppkey),
        gf AS (SELECT gene, fold, sum(y) AS s, count(*) AS n FROM r GROUP BY 1, 2), ga AS (SELECT gene, sum(s) AS s, sum(n) AS n FROM gf GROUP BY 1),
        b AS (SELECT r.y, round((ga.s - gf.s) / (ga.n - gf.n), 6) AS base FROM r JOIN gf ON gf.gene = r.gene AND gf.fold = r.fold JOIN ga ON ga.gene = r.gene),
        k AS (SELECT y, base, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry, rank() OVER (ORDER BY base) + (count(*) OVER (PARTITION BY base) - 1) / 2.0::DOUBLE AS rb FROM b)
        SELECT count(*) AS n, round(1 - avg((y - base) * (y - base)) / var_pop(y), 6) AS r2, round(corr(ry, rb), 6) AS spearman FROM k""",
)
def _(x: Inputs) -> DataFrame:
    rows = x.lineitem.join(x.part, F.col("l_partkey") == F.col("p_partkey")).join(L.balanced_group_folds(x.lineitem, "l_suppkey"), "l_suppkey")
    base = L.out_of_fold_means(rows.select(F.col("p_brand").alias("gene"), "fold", F.col("l_extendedprice").alias("y")), "gene", "y")
    base = cut_lineage(base.select("y", r6("baseline").alias("baseline")))  # equal means must be ties on every engine
    rho = spearman(base, "y", "baseline").select("spearman_rho").scalar()
    return L.regression_metrics(base, "y", "baseline").select("n", r6("r2").alias("r2"), r6(rho).alias("spearman"))


def _quality(rows: DataFrame, model: str, prediction: str) -> DataFrame:
    rho = spearman(rows.where("target IS NOT NULL"), "target", prediction).select("spearman_rho").scalar()
    return L.regression_metrics(rows, "target", prediction).select(F.lit(model).alias("model"), F.round("r2", 4).alias("r2"), F.round(rho, 4).alias("spearman"))


@query("k22_grouped_cv_trees")
def _(x: Inputs) -> DataFrame:
    """150 trees of depth 3 in five folds of whole cell lines; importances are those of the fit on all rows."""
    pred, fitted = L.grouped_tree_models(_features(x), _OMICS, "target", "cell_line_id")
    m = _quality(cut_lineage(pred), "trees", "prediction")
    out = m.select(F.explode(F.array(F.struct(F.lit("r2").alias("name"), F.col("r2").alias("value")), F.struct(F.lit("spearman").alias("name"), F.col("spearman").alias("value")))).alias("m")).select("m.*")
    shares = importances(fitted, len(fitted.members) - 1)
    return out.unionByName(x.spark.createDataFrame([(f, round(v, 4)) for f, v in shares], "name string, value double"))


@query("k24_baseline_vs_trees")
def _(x: Inputs) -> DataFrame:
    """Identity baseline, trees on the omics, and trees that may also use the gene's mean in the other folds (K23)."""
    pred, _fitted = L.grouped_tree_models(_features(x), _OMICS, "target", "cell_line_id", entity="kinase_id")
    pred = cut_lineage(L.out_of_fold_means(pred, "kinase_id", "target"))
    out = _quality(pred, "gene identity", "baseline").unionByName(_quality(pred, "omics", "prediction"))
    return out.unionByName(_quality(pred, "omics and gene mean", "prediction_entity"))


def _label_cte(name: str, key: str, src: str, seed: int) -> str:
    u = _U.format(keys=f"'{seed}', CAST({key} AS VARCHAR)")
    return f"""{name} AS (SELECT k, CASE WHEN p <= greatest(round(n * 0.1), 1) THEN 'test' WHEN p <= greatest(round(n * 0.1), 1) + greatest(round(n * 0.1), 1) THEN 'val' ELSE 'train' END AS split
        FROM (SELECT {key} AS k, row_number() OVER (ORDER BY {u}, {key}) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {src}) d) q)"""


@query(
    "k25_splits",
    f"""WITH base AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events), dom AS {GRID_SQL.format(base='base')},
        shuffled AS (SELECT n, {PLACE_SQL} AS dst FROM base CROSS JOIN dom CROSS JOIN (SELECT {KEYS_SQL.format(parts="'42'")} AS ks) q),
        {_label_cte('lp', 'l_partkey', 'lineitem', 42)}, {_label_cte('ls', 'l_suppkey', 'lineitem', 42)}, {_label_cte('ls2', 'l_suppkey', 'lineitem', 43)}
        SELECT 'unseen perturbation' AS kind, split, count(*) AS n FROM lineitem JOIN lp ON k = l_partkey GROUP BY 2
        UNION ALL SELECT 'unseen context', split, count(*) FROM lineitem JOIN ls ON k = l_suppkey GROUP BY 2
        UNION ALL SELECT 'unseen both', lp.split, count(*) FROM lineitem JOIN lp ON lp.k = l_partkey JOIN ls2 ON ls2.k = l_suppkey WHERE lp.split = ls2.split GROUP BY 2
        UNION ALL SELECT 'iid', CASE WHEN dst < round_even(n * 0.1, 0) THEN 'test' WHEN dst < 2 * round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END, count(*) FROM shuffled GROUP BY 2""",
)
def _(x: Inputs) -> DataFrame:
    rows = x.lineitem.select("l_partkey", "l_suppkey")
    kinds = {
        "unseen perturbation": L.group_split(rows, "l_partkey"), "unseen context": L.group_split(rows, "l_suppkey"),
        "unseen both": L.unseen_both_split(rows, "l_partkey", "l_suppkey"), "iid": L.row_split(x.events.select("event_id"), "event_id"),
    }
    out = None
    for kind, df in kinds.items():
        part = df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "split", "n")
        out = part if out is None else out.unionByName(part)
    return out


ROLE_SQL["combo_drugs"] = "SELECT drug_row AS d FROM drugcomb UNION SELECT drug_col FROM drugcomb"
_DRUG_SPLIT = f"""{_label_cte('ld', 'd', 'combo_drugs', 42)},
    sp AS (SELECT c.*, a.split FROM drugcomb c JOIN ld a ON a.k = drug_row JOIN ld b ON b.k = drug_col AND b.split = a.split)"""


@query("k26_unseen_drug_split", f"WITH {_DRUG_SPLIT} SELECT split, count(*) AS n, count(DISTINCT drug_row) AS n_drugs FROM sp GROUP BY split")
def _(x: Inputs) -> DataFrame:
    out = L.unseen_drug_split(x.drugcomb)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("drug_row").alias("n_drugs"))


_METRICS = ["synergy_loewe", "synergy_hsa"]


@query(
    "k27_train_normalisation",
    f"""WITH {_DRUG_SPLIT}, s AS (SELECT avg(synergy_loewe) AS ml, stddev_pop(synergy_loewe) AS sl, avg(synergy_hsa) AS mh, stddev_pop(synergy_hsa) AS sh FROM sp WHERE split = 'train')
        SELECT split, round(avg((synergy_loewe - ml) / sl), 6) AS loewe, round(avg((synergy_hsa - mh) / sh), 6) AS hsa, round(max((synergy_hsa - mh) / sh), 6) AS hsa_max FROM sp CROSS JOIN s GROUP BY split""",
)
def _(x: Inputs) -> DataFrame:
    rows = L.unseen_drug_split(x.drugcomb)
    z = L.normalise(rows, L.train_normaliser(rows, _METRICS), _METRICS)
    return z.groupBy("split").agg(r6(F.avg("synergy_loewe")).alias("loewe"), r6(F.avg("synergy_hsa")).alias("hsa"), r6(F.max("synergy_hsa")).alias("hsa_max"))


@query(
    "k28_mean_baseline",
    f"""WITH {_DRUG_SPLIT}, m AS (SELECT avg(synergy_hsa) AS p FROM sp WHERE split = 'train')
        SELECT split, count(*) AS n, round(1 - avg(pow(synergy_hsa - p, 2)) / var_pop(synergy_hsa), 6) AS r2, round(avg(abs(synergy_hsa - p)), 6) AS mae, round(avg(pow(synergy_hsa - p, 2)), 6) AS mse
        FROM sp CROSS JOIN m WHERE split <> 'train' GROUP BY split""",
)
def _(x: Inputs) -> DataFrame:
    rows = L.unseen_drug_split(x.drugcomb)
    mean = rows.where("split = 'train'").agg(F.avg("synergy_hsa").alias("p")).scalar()
    out = L.regression_metrics(rows.where("split <> 'train'").withColumn("p", mean), "synergy_hsa", "p", ["split"])
    return out.select("split", "n", r6("r2").alias("r2"), r6("mae").alias("mae"), r6("mse").alias("mse"))


@query(
    "k29_pooled_features",
    """WITH a AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT vec_id, (i - 1) % 8 AS j, avg(v) AS m, max(v) AS t FROM a GROUP BY 1, 2)
       SELECT vec_id, CAST(j AS INTEGER) AS j, round(m, 6) AS mean_value, round(t, 6) AS max_value FROM p""",
)
def _(x: Inputs) -> DataFrame:
    p = L.pooled_array_features(x.embeddings, "embedding", 8)
    rows = p.select("vec_id", F.posexplode(F.slice("pooled", 1, 8)).alias("j", "m"), "pooled")
    return rows.select("vec_id", "j", r6("m").alias("mean_value"), r6(F.get("pooled", F.col("j") + 8)).alias("max_value"))


_SYNERGIES = ["synergy_bliss", "synergy_loewe", "synergy_hsa", "synergy_zip"]


@query("k29_trees_per_metric")
def _(x: Inputs) -> DataFrame:
    """One tree model per synergy metric next to the training mean, on pairs of unseen drugs.

    Rows with the same drugs and line have the same features and train as one weighted row.  200 trees of depth 6, rate
    0.05, leaves shrunk by one row, as published.
    """
    keys = ["drug_row", "drug_col", "cell_line_name"]
    rows = cut_lineage(L.unseen_drug_split(x.drugcomb))
    atoms = L.pooled_array_features(x.embeddings, "embedding", 8).select(F.concat(F.lit("Brand#"), F.col("vec_id").cast("string")).alias("drug"), F.col("pooled"))
    features, names = L.pair_features(rows.select(*keys).distinct(), atoms, 16)
    same = rows.groupBy(*keys, "split").agg(F.array(*[F.avg(m) for m in _SYNERGIES]).alias("targets"), F.array(*[F.count(m).cast("double") for m in _SYNERGIES]).alias("weights"))
    ready = cut_lineage(same.join(features, keys).withColumn("fold", F.when(F.col("split") == "train", 0).otherwise(1)))
    members = [Member(m, i, 1) for i, m in enumerate(_SYNERGIES)]
    fitted = fit_trees(ready, members, names, len(members), trees=200, depth=6, penalty=1.0, max_bins=64)
    test = predict(ready.where("split = 'test'"), fitted).select(*keys, "predictions")
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y"), F.get("predictions", i).alias("trees"), F.lit(float(b)).alias("training mean")) for i, (m, b) in enumerate(zip(_SYNERGIES, fitted.base))]))
    long = cut_lineage(rows.where("split = 'test'").join(test, keys).select(one.alias("m")).select("m.*").where("y IS NOT NULL"))
    out = None
    for model in ("training mean", "trees"):
        part = L.regression_metrics(long, "y", model, ["metric"]).select("metric", F.lit(model).alias("model"), "n", *[F.round(c, 4).alias(c) for c in ("r2", "mae", "mse")])
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "k30_rmse_pearson",
    """SELECT event_type, count(*) AS n, round(sqrt(avg(pow(value - (10 + user_id), 2))), 6) AS rmse, round(corr(value, 10 + user_id), 6) AS pearson FROM events GROUP BY event_type""",
)
def _(x: Inputs) -> DataFrame:
    out = L.regression_metrics(x.events.withColumn("p", (F.col("user_id") + 10).cast("double")), "value", "p", ["event_type"])
    return out.select("event_type", "n", r6("rmse").alias("rmse"), r6("pearson").alias("pearson"))


@query(
    "k31_differential_effects",
    """WITH g AS (SELECT p_name AS gene, round(avg(l_discount - 0.05), 9) AS t, round(avg(l_tax - 0.04), 9) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
            r AS (SELECT *, row_number() OVER (ORDER BY abs(t) DESC, gene) AS rt, row_number() OVER (ORDER BY abs(p) DESC, gene) AS rp FROM g)
       SELECT round(sum(CASE WHEN rt <= 20 AND rp <= 20 THEN 1.0 ELSE 0.0 END)::DOUBLE / 20, 6) AS top_overlap, round(avg(CASE WHEN sign(t) = sign(p) THEN 1.0 ELSE 0.0 END), 6) AS sign_agreement FROM r WHERE rt <= 20 OR rp <= 20""",
)
def _(x: Inputs) -> DataFrame:
    rows = x.lineitem.join(x.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("gene"), (F.col("l_discount") - 0.05).alias("observed"), (F.col("l_tax") - 0.04).alias("predicted"))
    return L.differential_effects(rows).select(r6("top_overlap").alias("top_overlap"), r6("sign_agreement").alias("sign_agreement"))


def _halves(x: Inputs) -> tuple[DataFrame, DataFrame]:
    v = x.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    return v.where("label < 5").select("id", "vector"), v.where("label >= 5").select("id", "vector")


_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label < 5 AS h FROM embeddings)"


@query(
    "k32_energy_distance",
    f"""WITH {_E}, d AS (SELECT a.h AS ha, b.h AS hb, avg(list_distance(a.v, b.v)) AS m FROM e a CROSS JOIN e b GROUP BY 1, 2)
        SELECT round(2 * max(CASE WHEN ha AND NOT hb THEN m END) - max(CASE WHEN ha AND hb THEN m END) - max(CASE WHEN NOT ha AND NOT hb THEN m END), 6) AS energy_distance FROM d""",
)
def _(x: Inputs) -> DataFrame:
    return L.energy_distance(*_halves(x)).select(r6("energy_distance").alias("energy_distance"))


@query(
    "k32_kernel_mmd",
    f"""WITH {_E}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, a.h AS ha, b.h AS hb, CASE WHEN a.vec_id = b.vec_id THEN 0.0 ELSE pow(list_distance(a.v, b.v), 2) END AS d2 FROM e a CROSS JOIN e b),
        s AS (SELECT quantile_cont(d2, 0.5) AS bw FROM d WHERE d2 > 0), k AS (SELECT ha, hb, avg(exp(-d2 / (2 * bw))) AS m FROM d CROSS JOIN s GROUP BY 1, 2)
        SELECT round(max(CASE WHEN ha AND hb THEN m END) + max(CASE WHEN NOT ha AND NOT hb THEN m END) - 2 * max(CASE WHEN ha AND NOT hb THEN m END), 6) AS mmd2, round((SELECT bw FROM s), 6) AS bandwidth FROM k""",
)
def _(x: Inputs) -> DataFrame:
    return L.rbf_mmd(*_halves(x)).select(r6("mmd2").alias("mmd2"), r6("bandwidth").alias("bandwidth"))


@query(
    "k33_ensemble_ranking",
    """WITH s AS (SELECT metric, candidate, count(*) AS n, avg(pred) AS m, coalesce(stddev_samp(pred), 0.0) AS sd FROM predictions GROUP BY 1, 2),
            t AS (SELECT metric, candidate, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY metric, sample ORDER BY pred DESC, candidate) AS p FROM predictions) q WHERE p <= 10 GROUP BY 1, 2),
            c AS (SELECT metric, count(DISTINCT sample) AS c FROM predictions GROUP BY 1)
       SELECT s.metric, s.candidate, n AS n_samples, round(m, 9) AS mean, round(sd, 9) AS sd, round(m - 1.96 * sd, 9) AS ci_low, round(m + 1.96 * sd, 9) AS ci_high,
              round(m - sd, 9) AS conservative, round(coalesce(k, 0) / c, 9) AS top_k_probability
       FROM s LEFT JOIN t ON t.metric = s.metric AND t.candidate = s.candidate JOIN c ON c.metric = s.metric""",
)
def _(x: Inputs) -> DataFrame:
    out = L.ensemble_ranking(x.predictions)
    return out.select("metric", "candidate", "n_samples", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "ci_low", "ci_high", "conservative", "top_k_probability")])


@query(
    "k34_candidate_sample",
    f"""WITH {_DRUG_SPLIT} SELECT drug_row, drug_col, cell_line_name FROM (SELECT DISTINCT drug_row, drug_col, cell_line_name FROM sp WHERE split = 'test') c
        ORDER BY {_U.format(keys="'42', drug_row, drug_col, cell_line_name")}, drug_row, drug_col, cell_line_name LIMIT 200""",
)
def _(x: Inputs) -> DataFrame:
    """Sampling operator: candidates of the test split in keyed-hash order, cut to the sample size."""
    return L.candidate_sample(L.unseen_drug_split(x.drugcomb), ["drug_row", "drug_col", "cell_line_name"], 200)


@query("k35_index_map", "SELECT drug, dense_rank() OVER (ORDER BY drug) - 1 AS index FROM (SELECT DISTINCT lower(drug) AS drug FROM interactions) d")
def _(x: Inputs) -> DataFrame:
    return L.index_map(x.interactions.select(F.lower("drug").alias("drug")), "drug")


@query(
    "k36_gaussian_nll",
    "SELECT event_type, round(avg(0.5 * (exp(-ln(1 + user_id)) * pow(value - user_id, 2) + ln(1 + user_id))), 6) AS nll FROM events GROUP BY event_type",
)
def _(x: Inputs) -> DataFrame:
    rows = x.events.withColumn("m", F.col("user_id").cast("double")).withColumn("lv", F.log(1.0 + F.col("user_id")))
    return L.gaussian_nll(rows, "value", "m", "lv", ["event_type"]).select("event_type", r6("nll").alias("nll"))


@query(
    "k37_histogram",
    "SELECT event_type, CAST(least(floor(value / 25.0::DOUBLE) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1, 2",
)
def _(x: Inputs) -> DataFrame:
    return L.histogram(x.events, "value", 0.0, 500.0, 20, ["event_type"])


@query(
    "k37_box_statistics",
    """SELECT event_type, round(min(value), 6) AS min_value, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
              round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max_value FROM events GROUP BY event_type""",
)
def _(x: Inputs) -> DataFrame:
    out = L.box_statistics(x.events, "value", ["event_type"])
    return out.select("event_type", *[r6(c).alias(c) for c in ("min_value", "q1", "median", "q3", "max_value")])


@query(
    "e08_average_ranks",
    "SELECT event_id, rank() OVER (ORDER BY value DESC) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rank FROM events",
)
def _(x: Inputs) -> DataFrame:
    return average_ranks(x.events.select("event_id", "value"), "value", descending=True).select("event_id", "rank")
