"""Queries over survival statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from targetloom.functions.numeric import r6
from targetloom.operators import survival as V
from targetloom.operators.cohort import survival_time_event
from targetloom.plans.registry import query
from targetloom.plans.roles import ROLE_SQL, SPARK_ROLES, Inputs
from targetloom.session import cut_lineage

ROLE_SQL["surv"] = """SELECT patient_id, subtype, age, stage_numeric, purity, tmb, CASE WHEN vital_status = 'Dead' THEN 1 ELSE 0 END AS event,
    CASE WHEN vital_status = 'Dead' THEN days_to_death ELSE days_to_last_follow_up END / 30.4375::DOUBLE AS time FROM clinical"""
SPARK_ROLES["surv"] = lambda x: survival_time_event(x.clinical)
ROLE_SQL["gene_surv"] = """SELECT e.patient_id, e.gene, e.value, s.time, s.event, s.subtype,
    CASE WHEN e.value > m.med THEN 1 ELSE 0 END AS hi FROM expression e JOIN surv s ON s.patient_id = e.patient_id
    JOIN (SELECT gene, quantile_cont(value, 0.5) AS med FROM expression GROUP BY gene) m ON m.gene = e.gene"""

_KM = """km AS (SELECT {g} time, (SELECT 1) AS one, n_events, sum(n) OVER ({p} ORDER BY time DESC) AS n_at_risk FROM (SELECT {g} time, count(*) AS n, sum(event) AS n_events FROM {t} GROUP BY {g} time) q),
    sv AS (SELECT {g} time, n_at_risk, n_events, CASE WHEN min(1 - n_events / n_at_risk) OVER ({p} ORDER BY time) <= 0 THEN 0.0
           ELSE exp(sum(ln(greatest(1 - n_events / n_at_risk, 1e-300))) OVER ({p} ORDER BY time)) END AS survival FROM km)"""


@query(
    "k03_kaplan_meier",
    f"""WITH {_KM.format(g='subtype,', p='PARTITION BY subtype', t='surv')}
        SELECT subtype, round(time, 6) AS time, CAST(n_at_risk AS BIGINT) AS n_at_risk, CAST(n_events AS BIGINT) AS n_events, round(survival, 6) AS survival FROM sv""",
)
def _(x: Inputs) -> DataFrame:
    km = V.kaplan_meier(x.surv, ["subtype"])
    return km.select("subtype", r6("time").alias("time"), "n_at_risk", "n_events", r6("survival").alias("survival"))


_LR = """per AS (SELECT gene, time, count(*) AS n, sum(hi) AS na, sum(event) AS d, sum(event * hi) AS da FROM {t} GROUP BY 1, 2),
    rk AS (SELECT gene, d, da, sum(n) OVER (PARTITION BY gene ORDER BY time DESC) AS n, sum(na) OVER (PARTITION BY gene ORDER BY time DESC) AS na FROM per),
    lr AS (SELECT gene, CAST((SELECT sum(event) FROM {t} g WHERE g.gene = rk.gene) AS BIGINT) AS n_events,
                  pow(sum(da) - sum(d * na / n), 2) / sum(d * (na / n) * ((n - na) / n) * (n - d) / (n - 1)) AS chi2
           FROM rk WHERE d > 0 AND n > 1 GROUP BY gene)"""


@query("k04_logrank_all_genes", f"WITH {_LR.format(t='gene_surv')} SELECT gene, n_events, round(chi2, 6) AS chi2 FROM lr")
def _(x: Inputs) -> DataFrame:
    from targetloom.operators.ranking import median_split

    rows = cut_lineage(x.expression.join(x.surv.select("patient_id", "time", "event"), "patient_id").select("gene", "value", "time", "event"))
    split = median_split(rows, "value", ["gene"])
    return V.logrank(split, ["gene"], F.col("expression_group") == "high").select("gene", "n_events", r6("chi2").alias("chi2"))


@query(
    "k05_rmst",
    f"""WITH {_KM.format(g='subtype,', p='PARTITION BY subtype', t='surv')}, hz AS (SELECT max(time) AS h FROM surv),
        st AS (SELECT subtype, time, survival, lead(time, 1, h) OVER (PARTITION BY subtype ORDER BY time) AS nxt, row_number() OVER (PARTITION BY subtype ORDER BY time) AS r FROM sv CROSS JOIN hz)
        SELECT subtype, round(sum(survival * (nxt - time)) + max(CASE WHEN r = 1 THEN time END), 6) AS rmst FROM st GROUP BY subtype""",
)
def _(x: Inputs) -> DataFrame:
    return V.restricted_mean(x.surv, ["subtype"]).select("subtype", r6("rmst").alias("rmst"))


@query("k06_cox_per_gene")
def _(x: Inputs) -> DataFrame:
    """Cox per gene adjusted for stage, age, purity and tmb, with C-index; checked on planted effects in the tests."""
    feats = ["value", "stage_numeric", "age", "purity", "tmb"]
    rows = x.expression.join(x.surv, "patient_id").select("gene", "time", "event", *feats)
    rows = cut_lineage(V.standardised(rows, feats, ["gene"]))
    fit = V.fit_cox(rows, feats, ["gene"])
    table = fit.table(["string"]).where("feature = 'value'")
    c = V.concordance(V.predict_risk(rows, fit, feats), ["gene"]).select("gene", "c_index")
    return table.join(c, "gene").select("gene", *[F.round(k, 4).alias(k) for k in ("hr", "hr_low", "hr_high", "p", "c_index")])


@query("k07_proportional_hazards")
def _(x: Inputs) -> DataFrame:
    feats = ["value", "age", "tmb"]
    rows = cut_lineage(V.standardised(x.expression.join(x.surv, "patient_id").select("gene", "time", "event", *feats), feats, ["gene"]))
    fit = V.fit_cox(rows, feats, ["gene"])
    ph = V.proportional_hazards(rows, fit, feats, ["gene"])
    return ph.groupBy("gene").agg((F.min("p") > 0.05).alias("assumption_ok"), F.round(F.min("p"), 4).alias("lowest_p"))


_RMST_GENE = """kmg AS (SELECT gene, hi, time, n_events, sum(n) OVER (PARTITION BY gene, hi ORDER BY time DESC) AS nr FROM (SELECT gene, hi, time, count(*) AS n, sum(event) AS n_events FROM {t} GROUP BY 1, 2, 3) q),
    svg AS (SELECT gene, hi, time, CASE WHEN min(1 - n_events / nr) OVER w <= 0 THEN 0.0 ELSE exp(sum(ln(greatest(1 - n_events / nr, 1e-300))) OVER w) END AS s FROM kmg WINDOW w AS (PARTITION BY gene, hi ORDER BY time)),
    stg AS (SELECT gene, hi, time, s, lead(time, 1, (SELECT max(time) FROM {t})) OVER (PARTITION BY gene, hi ORDER BY time) AS nxt, row_number() OVER (PARTITION BY gene, hi ORDER BY time) AS r FROM svg),
    rm AS (SELECT gene, hi, sum(s * (nxt - time)) + max(CASE WHEN r = 1 THEN time END) AS rmst FROM stg GROUP BY 1, 2),
    rd AS (SELECT gene, max(CASE WHEN hi = 1 THEN rmst END) - max(CASE WHEN hi = 0 THEN rmst END) AS rmst_diff FROM rm GROUP BY gene)"""


@query(
    "k08_survival_batch",
    f"""WITH {_LR.format(t='gene_surv')}, {_RMST_GENE.format(t='gene_surv')}
        SELECT lr.gene, n_events, round(chi2, 6) AS chi2, round(rmst_diff, 6) AS rmst_diff FROM lr JOIN rd ON rd.gene = lr.gene WHERE n_events >= 5""",
)
def _(x: Inputs) -> DataFrame:
    out = V.logrank_by_expression(x.surv, x.expression)
    return out.select("gene", "n_events", r6("chi2").alias("chi2"), r6("rmst_diff").alias("rmst_diff"))


@query("k08_survival_evidence")
def _(x: Inputs) -> DataFrame:
    """The whole batch with its Cox models; the log-rank half is checked by k08_survival_batch, the models in the tests."""
    out = V.survival_batch(x.surv, x.expression, ["stage_numeric", "age", "purity", "tmb"])
    numbers = ["chi2", "logrank_p", "rmst_diff", "hr", "hr_low", "hr_high", "p", "c_index"]
    return out.select("gene", "n_events", *[F.round(c, 4).alias(c) for c in numbers], "assumption_ok")


@query(
    "k09_subset_survival",
    f"""WITH sub AS (SELECT e.gene, s.time, s.event, CASE WHEN e.value > m.med THEN 1 ELSE 0 END AS hi FROM expression e JOIN surv s ON s.patient_id = e.patient_id AND s.subtype = 'BUILDING'
             JOIN (SELECT gene, quantile_cont(value, 0.5) AS med FROM expression WHERE patient_id IN (SELECT patient_id FROM surv WHERE subtype = 'BUILDING') GROUP BY gene) m ON m.gene = e.gene),
        {_LR.format(t='sub')} SELECT gene, n_events, round(chi2, 6) AS chi2 FROM lr WHERE n_events >= 5""",
)
def _(x: Inputs) -> DataFrame:
    out = V.logrank_by_expression(x.surv.where("subtype = 'BUILDING'"), x.expression)
    return out.select("gene", "n_events", r6("chi2").alias("chi2"))


@query(
    "k10_concordance",
    """SELECT a.subtype, count(*) AS permissible, CAST(sum(CASE WHEN a.tmb > b.tmb THEN 1 ELSE 0 END) AS BIGINT) AS concordant, CAST(sum(CASE WHEN a.tmb = b.tmb THEN 1 ELSE 0 END) AS BIGINT) AS tied,
              round((sum(CASE WHEN a.tmb > b.tmb THEN 1 ELSE 0 END) + 0.5 * sum(CASE WHEN a.tmb = b.tmb THEN 1 ELSE 0 END)) / count(*), 6) AS c_index
       FROM surv a JOIN surv b ON a.subtype = b.subtype AND a.time < b.time AND a.event = 1 GROUP BY a.subtype""",
)
def _(x: Inputs) -> DataFrame:
    out = V.concordance(x.surv, ["subtype"], risk="tmb")
    return out.select("subtype", "permissible", "concordant", "tied", r6("c_index").alias("c_index"))


@query(
    "k10_concordance_continuous",
    """WITH s AS (SELECT time, event, round(purity * 3 - age / 40, 6) AS risk FROM surv)
       SELECT count(*) AS permissible, round((sum(CASE WHEN a.risk > b.risk THEN 1 ELSE 0 END) + 0.5 * sum(CASE WHEN a.risk = b.risk THEN 1 ELSE 0 END)) / count(*), 6) AS c_index
       FROM s a JOIN s b ON a.time < b.time AND a.event = 1""",
)
def _(x: Inputs) -> DataFrame:
    rows = x.surv.withColumn("risk", F.round(F.col("purity") * 3 - F.col("age") / 40, 6))
    return V.concordance(rows).select("permissible", r6("c_index").alias("c_index"))


@query(
    "k11_standardised_risk",
    """WITH s AS (SELECT avg(age) AS ma, stddev_pop(age) AS sa, avg(tmb) AS mt, stddev_pop(tmb) AS st FROM surv)
       SELECT patient_id, round(0.5 * (age - ma) / sa - 0.25 * (tmb - mt) / st, 6) AS risk FROM surv CROSS JOIN s""",
)
def _(x: Inputs) -> DataFrame:
    z = V.standardised(x.surv.select("patient_id", "age", "tmb"), ["age", "tmb"])
    return z.select("patient_id", r6(0.5 * F.col("age") - 0.25 * F.col("tmb")).alias("risk"))


_COX_FEATURES = ["age", "stage_numeric", "purity", "tmb"]


@query("k12_ridge_cox")
def _(x: Inputs) -> DataFrame:
    rows = V.standardised(x.surv.select("time", "event", *_COX_FEATURES), _COX_FEATURES)
    return V.fit_cox(rows, _COX_FEATURES, ridge=1.0).table([]).select("feature", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"), "converged")


@query("k13_cox_cross_validation")
def _(x: Inputs) -> DataFrame:
    oof = V.cross_validated_cox(x.surv, "patient_id", _COX_FEATURES)
    per = V.concordance(oof.withColumn("risk", F.round("risk", 9)), ["fold"])
    return per.agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("c_index"), 4).alias("mean_c"), F.round(F.stddev_pop("c_index"), 4).alias("sd_c"))


@query("k14_permutation_importance")
def _(x: Inputs) -> DataFrame:
    rows = cut_lineage(V.standardised(x.surv.select("patient_id", "time", "event", *_COX_FEATURES), _COX_FEATURES))
    fit = V.fit_cox(rows, _COX_FEATURES, ridge=1.0)
    out = V.permutation_importance(rows, "patient_id", fit, _COX_FEATURES, repeats=15)
    return out.select("feature", F.round("importance", 4).alias("importance"))


@query(
    "c07_patient_feature_matrix",
    """WITH w AS (SELECT patient_id, max(CASE WHEN gene = 'Brand#1' THEN value END) AS g_0, max(CASE WHEN gene = 'Brand#2' THEN value END) AS g_1 FROM expression GROUP BY 1)
       SELECT s.patient_id, round(time, 6) AS time, event, age, g_0, g_1, CASE WHEN subtype = 'BUILDING' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_building,
              CASE WHEN subtype = 'FURNITURE' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_furniture, CASE WHEN subtype = 'HOUSEHOLD' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_household,
              CASE WHEN subtype = 'MACHINERY' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_machinery FROM surv s JOIN w ON w.patient_id = s.patient_id WHERE g_0 IS NOT NULL AND g_1 IS NOT NULL""",
)
def _(x: Inputs) -> DataFrame:
    rows, _features = V.feature_matrix(x.surv, x.expression, ["Brand#1", "Brand#2"], ["age"], "subtype")
    return rows.withColumn("time", r6("time"))


_HAZ = """SELECT gene, (CAST(sum(CASE WHEN hi = 1 THEN event ELSE 0 END) AS DOUBLE) / sum(CASE WHEN hi = 1 THEN time ELSE 0 END)) / (CAST(sum(CASE WHEN hi = 0 THEN event ELSE 0 END) AS DOUBLE) / sum(CASE WHEN hi = 0 THEN time ELSE 0 END)) AS hr FROM gene_surv {w} GROUP BY gene"""


def _rate_ratio(x: Inputs, subtype: str | None = None) -> DataFrame:
    """Event-rate ratio of high against low expression, a hazard ratio without iterations."""
    from targetloom.operators.ranking import median_split

    rows = median_split(x.expression, "value", ["gene"]).join(x.surv, "patient_id")
    if subtype:
        rows = rows.where(F.col("subtype") == subtype)

    def rate(g: str) -> F.Column:
        here = F.col("expression_group") == g
        return F.sum(F.when(here, F.col("event")).otherwise(0)) / F.sum(F.when(here, F.col("time")).otherwise(0))

    return rows.groupBy("gene").agg((rate("high") / rate("low")).alias("hr"))


@query(
    "c08_hazard_comparison",
    f"""WITH a AS ({_HAZ.format(w='')}), b AS ({_HAZ.format(w="WHERE subtype = 'BUILDING'")})
        SELECT a.gene, round(a.hr, 6) AS hr_full, round(b.hr, 6) AS hr_subset, (a.hr - 1) * (b.hr - 1) < 0 AS flipped, round(abs(a.hr - b.hr), 6) AS abs_diff FROM a JOIN b ON a.gene = b.gene""",
)
def _(x: Inputs) -> DataFrame:
    out = V.hazard_comparison(_rate_ratio(x), _rate_ratio(x, "BUILDING"))
    return out.select("gene", r6("hr_full").alias("hr_full"), r6("hr_subset").alias("hr_subset"), "flipped", r6("abs_diff").alias("abs_diff"))


@query(
    "c09_external_validation",
    f"""WITH a AS ({_HAZ.format(w="WHERE subtype = 'HOUSEHOLD'")}), b AS ({_HAZ.format(w="WHERE subtype = 'BUILDING'")})
        SELECT a.gene, round(a.hr, 6) AS hr, round(b.hr, 6) AS ext_hr, (a.hr > 1) = (b.hr > 1) AS same_direction FROM a JOIN b ON a.gene = b.gene""",
)
def _(x: Inputs) -> DataFrame:
    out = V.external_validation(_rate_ratio(x, "HOUSEHOLD"), _rate_ratio(x, "BUILDING"))
    return out.select("gene", r6("hr").alias("hr"), r6("ext_hr").alias("ext_hr"), "same_direction")
