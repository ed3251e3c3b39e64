"""Candidate drugs from landed abstracts, confirmation, merge into the pool, repurposing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from targetloom.functions.text import candidate_drugs, looks_like_drug, mention_context, normalised_drug_name, source_count


def coverage_gaps(genes: DataFrame, maps: list[DataFrame], min_candidates: int = 2) -> DataFrame:
    """Genes with fewer than ``min_candidates`` distinct drugs over all maps, zero included."""
    pool = maps[0].select("gene", "drug")
    for m in maps[1:]:
        pool = pool.unionByName(m.select("gene", "drug"))
    n = pool.groupBy("gene").agg(F.countDistinct("drug").alias("n_candidates"))
    out = genes.select("gene").distinct().join(n, "gene", "left").fillna(0, ["n_candidates"])
    return out.where(F.col("n_candidates") < min_candidates)


def discover(abstracts: DataFrame, gaps: DataFrame, interactions: DataFrame) -> DataFrame:
    """(gene, candidate_drug, pmid, confirmed, mention_context, snippet) for the abstracts of the gap genes.

    Extraction, sentence split and pattern counts run in the scan stage; only candidate rows meet the interaction
    table, on (gene, lower-case name).
    """
    papers = abstracts.join(gaps.select("gene"), "gene", "left_semi")
    rows = papers.withColumn("snippet", F.substring("abstract", 1, 200)).withColumn("candidate_drug", F.explode(candidate_drugs("abstract")))
    rows = rows.select("gene", "pmid", "snippet", "candidate_drug", mention_context("abstract", "candidate_drug").alias("mention_context"))  # no text beyond here
    known = interactions.select("gene", F.lower("drug").alias("candidate_drug")).distinct().withColumn("_c", F.lit(True))
    return rows.join(known, ["gene", "candidate_drug"], "left").select(
        "gene", "candidate_drug", "pmid", F.coalesce("_c", F.lit(False)).alias("confirmed"), "mention_context", "snippet"
    )


def merge_candidates(pool: DataFrame, found: DataFrame, require_supportive: bool = False) -> DataFrame:
    """Pool plus confirmed candidates with the pmids that brought them; curated rows keep an empty list."""
    ok = found.where(F.col("confirmed"))
    if require_supportive:
        ok = ok.where(F.col("mention_context") == "supportive")
    rows = pool.select("gene", "drug", F.lit(None).cast("string").alias("pmid"), F.lit(True).alias("curated")).unionByName(
        ok.select("gene", F.col("candidate_drug").alias("drug"), "pmid", F.lit(False).alias("curated"))
    )
    out = rows.groupBy("gene", "drug").agg(F.max("curated").alias("curated"), F.array_sort(F.collect_set("pmid")).alias("pmids"))
    return out.withColumn("pmids", F.when(F.col("curated"), F.array().cast("array<string>")).otherwise(F.col("pmids")))


def repurposing_table(scores: DataFrame, interactions: DataFrame, top_n: int = 20, drugs_per_entity: int = 3) -> DataFrame:
    """Best entities with up to three distinct drugs by number of sources; 'none recorded' is kept as a row."""
    top = scores.orderBy(F.desc("target_score"), "kinase_id").limit(top_n)
    best = interactions.join(top.select("kinase_id"), "kinase_id", "left_semi").groupBy("kinase_id", F.lower("drug").alias("drug")).agg(
        F.max(source_count("sources")).alias("n_sources")
    )
    place = F.row_number().over(Window.partitionBy("kinase_id").orderBy(F.desc("n_sources"), "drug"))
    kept = best.withColumn("_p", place).where(F.col("_p") <= drugs_per_entity).groupBy("kinase_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "drug"))), lambda s: s.getField("drug")).alias("d")
    )
    return top.join(kept, "kinase_id", "left").select("kinase_id", "target_score", F.coalesce(F.array_join("d", "; "), F.lit("none recorded")).alias("drugs"))


def gene_drug_lists(interactions: DataFrame, validated: DataFrame | None = None, per_gene: int = 3) -> DataFrame:
    """(gene, drugs): clean names, the ``per_gene`` rows with most sources, the validated list in front."""
    genes = interactions.agg(F.array_distinct(F.collect_set(F.lower("kinase_id"))).alias("g")).scalar()
    rows = interactions.withColumn("_g", genes).where(looks_like_drug("drug", F.col("_g"))).select(
        F.col("kinase_id").alias("gene"), normalised_drug_name("drug").alias("drug"), source_count("sources").alias("n"), "ord"
    )
    place = F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("n"), "drug", "ord"))
    top = rows.withColumn("_p", place).where(F.col("_p") <= per_gene).groupBy("gene").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_p", "drug"))), lambda s: s.getField("drug"))).alias("real")
    )
    if validated is None:
        return top.select("gene", F.col("real").alias("drugs"))
    v = validated.groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "drug"))), lambda s: s.getField("drug")).alias("own"))
    none = F.array().cast("array<string>")
    return v.join(top, "gene", "full").select("gene", F.array_union(F.coalesce("own", none), F.coalesce("real", none)).alias("drugs"))


def candidate_set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(gene, drug, side): drugs only in the first or only in the second pool."""
    a, b = a.select("gene", "drug").distinct(), b.select("gene", "drug").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("first only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second only")))
