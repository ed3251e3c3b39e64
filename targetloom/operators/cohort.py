"""Cohort construction: identification, funnel with audit sets, gene-count distribution, recurrence tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from targetloom.functions.barcodes import FUNNEL_CLASSES, is_primary_tumour, participant_id


def one_aliquot_per_participant(barcodes: DataFrame, barcode: str = "barcode") -> DataFrame:
    """One row per participant: that of the lexicographically first barcode, of equal barcodes the smallest by the other columns.

    The minimum is combined map-side, so no participant is gathered in one task.
    """
    keyed = barcodes.withColumn("participant_id", participant_id(barcode))
    rest = [c for c in barcodes.columns if c != barcode]
    first = keyed.groupBy("participant_id").agg(F.min(F.struct(barcode, *rest)).alias("r"))
    return first.select("participant_id", *[F.col("r").getField(c).alias(c) for c in barcodes.columns])


def identify_subtype_negative(clinical: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Basal label when a subtype column exists, else all three receptors negative, else an error."""
    names = {c.lower(): c for c in (columns or clinical.columns)}
    if "subtype" in names:
        return clinical.where(F.lower(F.col(names["subtype"])).contains("basal"))
    receptors = [names[c] for c in ("er_status", "pr_status", "her2_status") if c in names]
    if len(receptors) < 3:
        raise ValueError("need a subtype column or the three receptor status columns")
    cond = None
    for c in receptors:
        part = F.lower(F.col(c)) == "negative"
        cond = part if cond is None else cond & part
    return clinical.where(cond)


def restrict_to(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def restriction_counts(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row: requested ids, found ids."""
    wanted = ids.select(key).distinct()
    have = df.select(key).distinct().withColumn("_f", F.lit(1))
    j = wanted.join(have, key, "left")
    return j.agg(F.count(F.lit(1)).alias("requested"), F.count("_f").alias("found"))


def eligible_mutations(
    maf: DataFrame,
    participants: DataFrame,
    panel: DataFrame,
    classes: Sequence[str] = FUNNEL_CLASSES,
    mapped_genes: DataFrame | None = None,
) -> DataFrame:
    """(participant_id, gene, class) of the participants, panel genes and classes asked for.

    The class filter and both small semi joins run before anything is shuffled.
    """
    rows = maf.where(F.col("Variant_Classification").isin(*classes)).select(
        participant_id("Tumor_Sample_Barcode").alias("participant_id"),
        F.col("Hugo_Symbol").alias("gene"),
        F.col("Variant_Classification").alias("class"),
    )
    rows = restrict_to(rows, panel.select("gene"), "gene")
    if mapped_genes is not None:
        rows = restrict_to(rows, mapped_genes.select("gene"), "gene")
    return restrict_to(rows, participants, "participant_id")


def genes_per_participant(mutations: DataFrame) -> DataFrame:
    return mutations.groupBy("participant_id").agg(F.countDistinct("gene").alias("n_genes"))


def cohort_funnel(
    subtypes: DataFrame,
    maf: DataFrame,
    panel: DataFrame,
    mapped_genes: DataFrame | None,
    label: str = "Basal",
    classes: Sequence[str] = FUNNEL_CLASSES,
    min_genes: int = 2,
) -> DataFrame:
    """Audit table (stage, participant_id) of the four stages:

    0 primary tumours with a subtype, 1 with the label, 2 also sequenced, 3 with >= min_genes eligible genes.
    """
    typed = one_aliquot_per_participant(subtypes.where(is_primary_tumour("barcode") & F.col("subtype").isNotNull()))
    stage0 = typed.select("participant_id", "subtype")
    stage1 = stage0.where(F.col("subtype") == label).select("participant_id")
    tumour = maf.where(is_primary_tumour("Tumor_Sample_Barcode"))
    sequenced = tumour.select(participant_id("Tumor_Sample_Barcode").alias("participant_id")).distinct()
    stage2 = stage1.join(sequenced, "participant_id", "left_semi")
    counts = genes_per_participant(eligible_mutations(tumour, stage2, panel, classes, mapped_genes))
    stage3 = counts.where(F.col("n_genes") >= min_genes)
    parts = [stage0, stage1, stage2, stage3]
    out = None
    for i, part in enumerate(parts):
        rows = part.select(F.lit(i).alias("stage"), "participant_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def funnel_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("stage").agg(F.countDistinct("participant_id").alias("n"))


def subset_violations(audit: DataFrame, inner: int, outer: int) -> DataFrame:
    """Participants of stage ``inner`` that are missing from stage ``outer``."""
    a = audit.where(F.col("stage") == inner).select("participant_id")
    return a.join(audit.where(F.col("stage") == outer).select("participant_id"), "participant_id", "left_anti")


def gene_count_distribution(participants: DataFrame, mutations: DataFrame, mapped_genes: DataFrame, top: int = 4) -> DataFrame:
    """Participants with exactly / at least k genes, zero included, for all genes and for drug-mapped genes."""
    wide = mutations.select("participant_id", "gene").distinct().join(
        mapped_genes.select("gene").distinct().withColumn("_m", F.lit(1)), "gene", "left"
    )
    n = wide.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n_all"), F.count("_m").alias("n_mapped"))
    per = participants.select("participant_id").distinct().join(n, "participant_id", "left").fillna(0, ["n_all", "n_mapped"])
    long = per.select(F.explode(F.array(
        F.struct(F.lit("all").alias("gene_set"), F.col("n_all").alias("n")),
        F.struct(F.lit("mapped").alias("gene_set"), F.col("n_mapped").alias("n")),
    )).alias("r")).groupBy("r.gene_set", "r.n").count()
    ks = long.select("gene_set", "n", "count", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("k"))
    return ks.groupBy("gene_set", "k").agg(
        F.sum(F.when(F.col("n") == F.col("k"), F.col("count")).otherwise(0)).alias("exactly"),
        F.sum(F.when(F.col("n") >= F.col("k"), F.col("count")).otherwise(0)).alias("at_least"),
    )


def patient_gene_flags(mutations: DataFrame, patient: str, gene: str) -> DataFrame:
    """Long form of the binary matrix; pivot at the edge when a wide table is wanted."""
    return mutations.select(patient, gene).distinct().withColumn("mutated", F.lit(1))


def pivot_flags(flags: DataFrame, patient: str, gene: str, genes: Sequence[str]) -> DataFrame:
    return flags.groupBy(patient).pivot(gene, list(genes)).agg(F.min("mutated")).fillna(0)


def altered_genes(maf: DataFrame, panel: DataFrame, patients: DataFrame) -> DataFrame:
    """Sorted distinct panel genes per patient, one scan for all patients; patients without any keep a null list.

    Patient ids are full 12-character participant ids, so the barcode match is an equi-join.
    """
    rows = maf.select(participant_id("Tumor_Sample_Barcode").alias("patient"), F.col("Hugo_Symbol").alias("gene"))
    rows = restrict_to(restrict_to(rows, panel, "gene"), patients, "patient").distinct()
    lists = rows.groupBy("patient").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    return patients.select("patient").distinct().join(lists, "patient", "left")


def altered_genes_by_fragment(maf: DataFrame, panel: DataFrame, fragments: DataFrame) -> DataFrame:
    """The same for patient ids that are any fragment of the barcode.

    Each distinct barcode is cut into its substrings of the id lengths in use, so the match is an equi-join.
    """
    rows = restrict_to(maf.select(F.col("Tumor_Sample_Barcode").alias("barcode"), F.col("Hugo_Symbol").alias("gene")), panel, "gene").distinct()
    ids = fragments.select("patient").distinct()
    lengths = sorted(r[0] for r in ids.select(F.length("patient")).distinct().collect())  # at most a barcode's length
    barcodes = rows.select("barcode").distinct().withColumn("_n", F.length("barcode"))

    def substrings(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.col("_n") - k + 1)
        cut = F.transform(starts, lambda i: F.substring(F.col("barcode"), i, F.lit(k)))
        return F.when(F.col("_n") >= k, cut).otherwise(F.array().cast("array<string>"))

    pieces = [substrings(k) for k in lengths]
    hits = barcodes.select("barcode", F.explode(F.array_distinct(F.concat(*pieces))).alias("patient")).join(ids, "patient", "left_semi")
    return rows.join(hits, "barcode").groupBy("patient").agg(F.array_sort(F.collect_set("gene")).alias("genes"))


def panel_mutations(maf: DataFrame, panel: DataFrame) -> DataFrame:
    rows = maf.select(
        participant_id("Tumor_Sample_Barcode").alias("patient_barcode"),
        F.col("Hugo_Symbol").alias("gene"), F.col("Variant_Classification").alias("alteration_type"),
    )
    return restrict_to(rows, panel, "gene").distinct()


def regimen_frequency(regimens: DataFrame, regimen: str = "top_regimen") -> DataFrame:
    """Count and percentage of the whole cohort, rows without a regimen included in the denominator."""
    total = regimens.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = regimens.where(F.col(regimen).isNotNull()).groupBy(regimen).agg(F.count(F.lit(1)).alias("n_patients"))
    return counts.withColumn("pct", F.round(F.col("n_patients") * 100.0 / total, 1))


def recurring_drugs(regimens: DataFrame, regimen: str = "top_regimen", sep: str = " \\+ ") -> DataFrame:
    """Count per regimen first, then split: a regimen shared by a third of the cohort is one row by then."""
    counts = regimens.where(F.col(regimen).isNotNull()).groupBy(regimen).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.explode(F.split(regimen, sep)).alias("drug"), "n").groupBy("drug").agg(F.sum("n").alias("n"))


def recurring_pathways(drug_counts: DataFrame, drug_gene: DataFrame, gene_pathways: DataFrame) -> DataFrame:
    j = drug_counts.join(drug_gene.select("drug", "gene"), "drug").join(gene_pathways.select("gene", "pathway"), "gene")
    return j.groupBy("pathway").agg(F.sum("n").alias("n"))


def participants_of(stage: int, audit: DataFrame) -> DataFrame:
    return audit.where(F.col("stage") == stage).select("participant_id")


def survival_time_event(clinical: DataFrame, unit: str = "months") -> DataFrame:
    """Death time when dead, follow-up otherwise, in the unit asked for; rows without a time are dropped."""
    divisor = {"days": 1.0, "months": 30.4375, "years": 365.25}[unit]
    event = (F.lower(F.col("vital_status")) == "dead").cast("int")
    days = F.when(event == 1, F.col("days_to_death")).otherwise(F.col("days_to_last_follow_up"))
    out = clinical.withColumn("event", event).withColumn("time", days / F.lit(divisor))
    return out.where(F.col("time").isNotNull() & F.col("event").isNotNull())


def stage_ordinal(text: str) -> Column:
    roman = F.regexp_extract(F.upper(F.col(text)), "(IV|III|II|I)", 1)
    return F.when(roman == "IV", 4).when(roman == "III", 3).when(roman == "II", 2).when(roman == "I", 1).cast("double")
