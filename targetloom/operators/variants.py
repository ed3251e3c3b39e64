"""Variant records, pathway redundancy, bypass risk and combination suggestions for many patients at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Severity of a variant effect; anything else is 0.
EFFECT_SEVERITY = {
    "stop_gained": 1.0,
    "frameshift_variant": 0.95,
    "splice_acceptor_variant": 0.90,
    "splice_donor_variant": 0.90,
    "start_lost": 0.85,
    "missense_variant": 0.70,
    "inframe_deletion": 0.65,
    "inframe_insertion": 0.60,
    "synonymous_variant": 0.10,
    "intron_variant": 0.05,
    "upstream_gene_variant": 0.02,
}
HIGH_SEVERITY = 0.7


def effect_severity(effect: str | Column) -> Column:
    c = F.col(effect) if isinstance(effect, str) else effect
    out = F.lit(0.0)
    for name, value in EFFECT_SEVERITY.items():
        out = F.when(c == name, F.lit(value)).otherwise(out)
    return out


def interval_lookup(points: DataFrame, intervals: DataFrame, chrom: str, pos: str, bin_width: int) -> DataFrame:
    """Add ``interval_gene``: the first interval (by ord) with start <= pos <= end on the same chromosome, or null.

    Each interval is cut into its largest aligned pieces of 1, 2, 4, ... positions, up to ``bin_width``, and equal pieces
    keep only their first interval.  A position then meets at most one row per piece size, however many intervals overlap.
    Only distinct positions are looked up: a position shared by a third of all records costs one row.
    """
    top = bin_width.bit_length() - 1  # pieces have 2^0 to 2^top positions
    spans = intervals.where(F.col("chrom").isNotNull() & F.col("ord").isNotNull()).groupBy(
        F.col("chrom").alias("_pc"), F.col("start").cast("long").alias("_s"), F.col("end").cast("long").alias("_e")
    ).agg(F.min(F.struct("ord", "gene")).alias("_g"))

    def pieces(level: int) -> Column:
        first, last = F.shiftright(F.col("_s") + ((1 << level) - 1), level), F.shiftright(F.col("_e") + 1, level) - 1
        if level < top:  # at most two pieces of a size: those whose neighbour of the next size is not wholly inside
            found = F.array(F.when(first % 2 != 0, first), F.when(last % 2 == 0, last))
        else:
            found = F.sequence(first, last)
        found = F.when(first <= last, found).otherwise(F.array().cast("array<bigint>"))
        return F.transform(found, lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))

    cells = spans.select("_pc", "_g", F.explode(F.concat(*[pieces(level) for level in range(top + 1)])).alias("_c")).select("_pc", "_c.level", "_c.bin", "_g")
    cells = cells.where("bin is not null").groupBy("_pc", "level", "bin").agg(F.min("_g").alias("_g"))
    p = points.select(F.col(chrom).alias("_pc"), F.col(pos).cast("long").alias("_pp")).distinct()
    steps = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(F.col("_pp"), level).alias("bin")) for level in range(top + 1)])
    hits = p.select("_pc", "_pp", F.inline(steps)).join(cells, ["_pc", "level", "bin"])
    hits = hits.groupBy("_pc", "_pp").agg(F.min("_g").getField("gene").alias("interval_gene")).withColumnsRenamed({"_pc": chrom, "_pp": pos})
    return points.join(hits, [chrom, pos], "left")


def _info_value(key: str) -> Column:
    """Value of the last ``key=value`` token of the array column ``info``; null without one."""
    own = F.filter("info", lambda t: F.startswith(t, F.lit(f"{key}=")))
    return F.substring(F.try_element_at(own, F.lit(-1)), len(key) + 2, 1 << 30)


def parse_vcf(lines: DataFrame, known_genes: DataFrame, loci: DataFrame, bin_width: int = 100_000) -> DataFrame:
    """``lines`` (file, value) -> variant rows; header lines, short records and records without a numeric position are skipped.

    Of a repeated INFO key the last value counts; a depth or frequency that is no number counts as missing.
    """
    body = lines.where(~F.col("value").startswith("#")).withColumn("c", F.split("value", "\t")).where(F.size("c") >= 8)
    info = F.split(F.col("c")[7], ";")
    rows = body.select(
        "file", F.col("c")[0].alias("chrom"), F.col("c")[1].try_cast("long").alias("pos"), F.col("c")[2].alias("variant_id"), F.col("c")[3].alias("ref"),
        F.col("c")[4].alias("alt"), F.col("c")[5].alias("qual"), F.col("c")[6].alias("filter_status"), info.alias("info"),
    )
    rows = rows.select(
        *[c for c in rows.columns if c != "info"], _info_value("GENE").alias("tag"),
        F.coalesce(_info_value("EFFECT"), F.lit("unknown")).alias("effect"),
        F.coalesce(_info_value("DP").try_cast("int"), F.lit(0)).alias("depth"),
        F.coalesce(_info_value("AF").try_cast("double"), F.lit(0.0)).alias("allele_freq"),
    ).where("pos is not null")
    rows = interval_lookup(rows, loci, "chrom", "pos", bin_width)
    rows = rows.withColumn("gene", F.coalesce("tag", "interval_gene", F.lit("UNKNOWN"))).drop("tag", "interval_gene")
    known = known_genes.select("gene").distinct().withColumn("is_kinase", F.lit(True))
    return rows.join(known, "gene", "left").withColumn("is_kinase", F.coalesce("is_kinase", F.lit(False))).withColumn("severity", effect_severity("effect"))


def variant_summary(variants: DataFrame, by: str = "file") -> DataFrame:
    kin = F.col("is_kinase")
    return variants.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_variants"), F.count_if(kin).alias("kinase_variants"),
        F.countDistinct(F.when(kin, F.col("gene"))).alias("n_genes"),
        F.count_if(kin & (F.col("severity") >= HIGH_SEVERITY)).alias("n_high_severity"),
    )


def pathway_redundancy(affected: DataFrame, gene_pathways: DataFrame, patient: str = "patient") -> DataFrame:
    """Affected genes per pathway and both redundancy scores."""
    rows = affected.select(patient, "gene").distinct().join(gene_pathways.select("gene", "pathway").distinct(), "gene")
    n = F.col("n_genes")
    return rows.groupBy(patient, "pathway").agg(F.count(F.lit(1)).alias("n_genes")).select(
        "*", F.round(1 - 1 / (1 + 0.8 * (n - 1)), 3).alias("redundancy"), F.round(1 / (1 + F.exp(-(n - 1))), 3).alias("legacy_redundancy")
    )


# The labels of the three risk levels.
def risk_label(score: Column) -> Column:
    return (
        F.when(score >= 0.6, "HIGH BYPASS RISK — combination therapy strongly recommended")
        .when(score >= 0.3, "MODERATE BYPASS RISK — consider combination or sequential therapy")
        .otherwise("LOW BYPASS RISK — monotherapy may be effective")
    )


def bypass_risk(affected: DataFrame, gene_pathways: DataFrame, resistance: DataFrame, patient: str = "patient") -> DataFrame:
    """Per affected gene: other affected genes sharing a pathway, resistance texts naming an affected gene, risk.

    Gene neighbourhoods come from the knowledge table once; a patient's own gene list is intersected with them, so no
    gene pair is emitted per patient.
    """
    gp = gene_pathways.select("gene", "pathway").distinct()
    members = gp.groupBy("pathway").agg(F.collect_set("gene").alias("m"))
    near = gp.join(members, "pathway").groupBy("gene").agg(F.array_distinct(F.flatten(F.collect_list("m"))).alias("near"))
    texts = resistance.groupBy("gene").agg(F.collect_list("mechanism").alias("texts"))
    known = affected.select(patient, "gene").distinct()
    lists = known.groupBy(patient).agg(F.collect_set("gene").alias("genes"))
    rows = known.join(near, "gene").join(texts, "gene", "left").join(lists, patient)
    bypass = F.array_sort(F.filter(F.array_intersect("genes", "near"), lambda g: g != F.col("gene")))
    hits = F.size(F.filter(
        F.coalesce("texts", F.array().cast("array<string>")),
        lambda t: F.exists("genes", lambda g: F.contains(F.lower(t), F.lower(g))),
    ))
    rows = rows.select(patient, "gene", bypass.alias("bypass_genes"), hits.alias("n_resistance_hits"))
    score = F.least(F.lit(1.0), F.round(0.15 * F.size("bypass_genes") + 0.25 * F.col("n_resistance_hits"), 3))
    return rows.withColumn("bypass_risk", score).withColumn("recommendation", risk_label(score))


def combination_suggestions(
    affected: DataFrame, gene_pathways: DataFrame, relevance: DataFrame, inhibitors: DataFrame, patient: str = "patient"
) -> DataFrame:
    """Affected gene pairs sharing a pathway, once per pair (first pathway in table order), with up to two drugs a side.

    The pair table is built from the knowledge tables; a patient keeps the pairs whose genes are both affected.
    ``inhibitors``: (gene, drug, ord, approved); ``gene_pathways`` needs ord; ``relevance``: (gene, tnbc_relevance).
    """
    gp = gene_pathways.select("gene", "pathway", "ord").distinct()
    members = gp.groupBy("pathway").agg(F.array_sort(F.collect_set("gene")).alias("m"))
    pairs = gp.join(members, "pathway").select(
        F.col("gene").alias("gene_1"), "pathway", "ord", F.explode(F.filter("m", lambda g: g > F.col("gene"))).alias("gene_2")
    )
    pairs = pairs.groupBy("gene_1", "gene_2").agg(F.min_by("pathway", F.struct("ord", "pathway")).alias("pathway"))
    drugs = inhibitors.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("ord", "drug", "approved"))).alias("d"))
    approved = F.filter("d", lambda s: s.getField("approved"))
    pick = F.transform(F.slice(F.when(F.size(approved) > 0, approved).otherwise(F.col("d")), 1, 2), lambda s: s.getField("drug"))
    level = F.when(F.col("tnbc_relevance") == "high", 3).when(F.col("tnbc_relevance") == "moderate", 2).otherwise(1)
    cards = relevance.select("gene", level.alias("level")).join(drugs.select("gene", pick.alias("picked")), "gene", "left")
    for i in ("1", "2"):
        pairs = pairs.join(cards.select(F.col("gene").alias(f"gene_{i}"), F.col("level").alias(f"level_{i}"), F.col("picked").alias(f"drugs_{i}")), f"gene_{i}", "left")
    total = F.coalesce("level_1", F.lit(1)) + F.coalesce("level_2", F.lit(1))
    pairs = pairs.withColumn("evidence_strength", F.when(total >= 5, "strong").when(total >= 3, "moderate").otherwise("limited"))
    lists = affected.groupBy(patient).agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    own = lists.select(patient, "genes", F.explode("genes").alias("gene_1"))
    own = own.select(patient, "gene_1", F.explode(F.filter("genes", lambda g: g > F.col("gene_1"))).alias("gene_2"))
    return own.join(pairs, ["gene_1", "gene_2"]).select(
        patient, "gene_1", "gene_2", F.col("pathway").alias("shared_pathway"), F.array_join("drugs_1", ",").alias("suggested_drugs_1"),
        F.array_join("drugs_2", ",").alias("suggested_drugs_2"), "evidence_strength",
    )
