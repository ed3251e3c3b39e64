"""Drug-set search: pair synergy, toxicity overlap, regimen score, beam search for all patients at once.

Knowledge enters as tables:
``gene_drugs`` (gene, drug, ord), ``gene_pathways`` (gene, pathway), ``gene_class`` (gene, gene_class),
``drug_toxicity`` (drug, category), ``known_synergy`` (drug_a, drug_b, boost), ``class_drugs`` (gene, class, drug).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from targetloom.operators.pairs import co_occurrence, unordered_pairs
from targetloom.session import cut_lineage

# Weights of the regimen score.
OVERLAP_STEP, OVERLAP_CAP = 0.15, 0.4
COMPLEMENTARY, NOT_COMPLEMENTARY = 0.25, 0.1
EVIDENCE_STEP, TOXICITY_STEP, DIVERSITY_STEP, SIZE_STEP = 0.3, 0.2, 0.3, 0.05
TRUNCATING = ("Deep_Deletion", "Homozygous_Deletion", "Nonsense_Mutation", "Frame_Shift_Del", "Frame_Shift_Ins", "Splice_Site")


def drug_to_gene(gene_drugs: DataFrame, gene_order: str = "gene") -> DataFrame:
    """A shared drug belongs to the first gene."""
    return gene_drugs.groupBy("drug").agg(F.min_by("gene", gene_order).alias("gene"))


def heuristic_synergy(overlap: Column, class_a: Column, class_b: Column, boost: Column) -> Column:
    comp = ((class_a == "RTK") & (class_b == "INTRA")) | ((class_a == "INTRA") & (class_b == "RTK"))
    base = F.least(overlap * F.lit(OVERLAP_STEP), F.lit(OVERLAP_CAP))
    mech = F.when(F.coalesce(comp, F.lit(False)), F.lit(COMPLEMENTARY)).otherwise(F.lit(NOT_COMPLEMENTARY))
    return F.least(base + mech + boost, F.lit(1.0))


def gene_overlap(gene_pathways: DataFrame) -> DataFrame:
    """(gene_a < gene_b, overlap): number of shared pathways; pairs without a shared pathway are absent."""
    shared = co_occurrence(gene_pathways.select("gene", "pathway").distinct(), "pathway", "gene")
    return shared.select(F.col("item_a").alias("gene_a"), F.col("item_b").alias("gene_b"), F.col("n").alias("overlap"))


def toxicity_overlap(drug_toxicity: DataFrame) -> DataFrame:
    """(drug_a < drug_b, tox): number of shared toxicity categories; absent means none."""
    shared = co_occurrence(drug_toxicity.select("drug", "category").distinct(), "category", "drug")
    return shared.select(F.col("item_a").alias("drug_a"), F.col("item_b").alias("drug_b"), F.col("n").alias("tox"))


def safety_screen(pairs: DataFrame, drug_toxicity: DataFrame) -> DataFrame:
    """Shared categories as text per drug pair and the flag."""
    sets = drug_toxicity.groupBy("drug").agg(F.array_sort(F.collect_set("category")).alias("cats"))
    a = sets.select(F.col("drug").alias("drug_a"), F.col("cats").alias("ca"))
    b = sets.select(F.col("drug").alias("drug_b"), F.col("cats").alias("cb"))
    none = F.array().cast("array<string>")
    shared = F.array_intersect(F.coalesce("ca", none), F.coalesce("cb", none))
    out = pairs.join(a, "drug_a", "left").join(b, "drug_b", "left").withColumn("_s", shared)
    text = F.when(F.size("_s") > 0, F.array_join("_s", ", ")).otherwise("none")
    return out.withColumn("flagged", F.size("_s") > 0).withColumn("toxicity_overlap", text).drop("ca", "cb", "_s")


def drug_pair_table(
    drugs: DataFrame, drug_gene: DataFrame, gene_pathways: DataFrame, gene_class: DataFrame, drug_toxicity: DataFrame, known_synergy: DataFrame
) -> DataFrame:
    """(drug_a < drug_b, synergy, tox, known) for every pair of the drug pool."""
    info = drugs.select("drug").distinct().join(drug_gene.select("drug", "gene"), "drug", "left").join(gene_class, "gene", "left")
    pairs = unordered_pairs(info.select("drug", "gene", "gene_class"), "drug").withColumnsRenamed({"drug_1": "drug_a", "drug_2": "drug_b"})
    over = gene_overlap(gene_pathways)
    pairs = pairs.withColumn("gene_a", F.least("gene_1", "gene_2")).withColumn("gene_b", F.greatest("gene_1", "gene_2"))
    out = pairs.join(over, ["gene_a", "gene_b"], "left").join(toxicity_overlap(drug_toxicity), ["drug_a", "drug_b"], "left")
    known = known_synergy.select(F.least("drug_a", "drug_b").alias("drug_a"), F.greatest("drug_a", "drug_b").alias("drug_b"), "boost")
    out = out.join(known, ["drug_a", "drug_b"], "left")
    syn = heuristic_synergy(F.coalesce("overlap", F.lit(0)), F.col("gene_class_1"), F.col("gene_class_2"), F.coalesce("boost", F.lit(0.0)))
    usable = F.col("gene_1").isNotNull() & F.col("gene_2").isNotNull() & (F.col("gene_1") != F.col("gene_2"))
    return out.select(
        "drug_a", "drug_b", F.when(usable, syn).otherwise(0.0).alias("synergy"),
        F.coalesce("tox", F.lit(0)).cast("int").alias("tox"), F.col("boost").isNotNull().cast("int").alias("known"),
    )


def drug_cards(pool: DataFrame, pair_table: DataFrame, drug_gene: DataFrame) -> DataFrame:
    """One row per drug: (drug, idx, gene, partners); idx is the alphabetical place in the pool, partners[i] holds
    (synergy, tox, known) with drug i.  The row width is the size of the drug pool, which the knowledge tables bound.
    """
    names = pool.select("drug").distinct().agg(F.array_sort(F.collect_set("drug")).alias("n"))
    index = names.select(F.posexplode("n").alias("idx", "drug"))
    a = pair_table.select(F.col("drug_a").alias("drug"), F.col("drug_b").alias("other"), "synergy", "tox", "known")
    b = pair_table.select(F.col("drug_b").alias("drug"), F.col("drug_a").alias("other"), "synergy", "tox", "known")
    own = index.select("drug", F.col("drug").alias("other"), F.lit(0.0).alias("synergy"), F.lit(0).alias("tox"), F.lit(0).alias("known"))
    rows = a.unionByName(b).unionByName(own).join(index.select(F.col("drug").alias("other"), F.col("idx").alias("o")), "other")
    lists = rows.groupBy("drug").agg(F.array_sort(F.collect_list(F.struct("o", "synergy", "tox", "known"))).alias("partners"))
    return index.join(lists, "drug").join(drug_gene.select("drug", "gene"), "drug", "left")


def regimen_score(n: int, syn_sum: np.ndarray, tox: np.ndarray, known: np.ndarray, distinct_genes: np.ndarray) -> np.ndarray:
    mean = syn_sum / (n * (n - 1) / 2) if n > 1 else 0.0
    evidence = np.minimum(known * EVIDENCE_STEP, 1.0)
    score = mean + evidence + max(n - 2, 0) * SIZE_STEP - tox * TOXICITY_STEP - (n - distinct_genes) * DIVERSITY_STEP
    return np.sign(score) * np.floor(np.abs(score) * 1e9 + 0.5) / 1e9  # nine decimals, half away from zero


def _best_sets(
    avail: np.ndarray, synergy: np.ndarray, tox: np.ndarray, known: np.ndarray, gene: np.ndarray, beam_width: int, max_depth: int, top_k: int
) -> list[tuple[np.ndarray, float, int]]:
    """Beam search over one pool: (cards in order, score, size), best first.

    States stay in generation order, so the first of equal sets and, by stable sorting, the first of equal scores is kept.
    """
    cell = np.ix_(avail, avail)
    tables = synergy[cell], tox[cell], known[cell]
    own = gene[avail]
    members = np.zeros((1, 0), dtype=np.int64)
    sums = [np.zeros(1, dtype=t.dtype) for t in tables]
    adds = [np.zeros((1, len(avail)), dtype=t.dtype) for t in tables]  # what each drug would add to a state
    found = []
    for depth in range(1, max_depth + 1):
        free = np.ones((len(members), len(avail)), dtype=bool)
        np.put_along_axis(free, members, False, axis=1)
        place, pos = np.nonzero(free)
        grown = np.column_stack([members[place], pos])
        code = np.zeros(len(grown), dtype=np.int64)
        for column in np.sort(grown, axis=1).T:  # numbers each distinct set
            code = np.unique(code * len(avail) + column, return_inverse=True)[1]
        first = np.sort(np.unique(code, return_index=True)[1])
        place, pos, grown = place[first], pos[first], grown[first]
        if not len(first):
            break
        sums = [s[place] + a[place, pos] for s, a in zip(sums, adds)]
        genes = np.sort(own[grown], axis=1)
        distinct = 1 + (genes[:, 1:] != genes[:, :-1]).sum(axis=1)
        score = regimen_score(depth, *sums, distinct)
        order = np.argsort(-score, kind="stable")[: max(beam_width, top_k)]
        if depth > 1:
            found += [(np.sort(avail[grown[i]]), float(score[i]), depth) for i in order[:top_k]]
        kept = order[:beam_width]
        members, sums = grown[kept], [s[kept] for s in sums]
        adds = [a[place[kept]] + t[pos[kept]] for a, t in zip(adds, tables)]
    return sorted(found, key=lambda f: -f[1])[:top_k]


def beam_search(
    pools: DataFrame, cards: DataFrame, key: str = "patient", beam_width: int = 50, max_depth: int = 5, top_k: int = 10
) -> DataFrame:
    """Best drug sets of size 2..max_depth per key.  ``pools``: (key, drugs sorted array); ``cards``: see drug_cards.

    Keys with the same pool share one search, and the searches are spread over the tasks.  A search grows its states in
    memory, at most ``beam_width`` times the pool at a time, so no state is shuffled.  The cards, three numbers per drug
    pair, reach the tasks as one broadcast.  Equal scores keep generation order.
    """
    spark = pools.sparkSession
    rows = cards.select("idx", "drug", "gene", "partners").orderBy("idx").collect()
    tables = [np.zeros((len(rows), len(rows)), dtype=d) for d in (np.float64, np.int64, np.int64)]
    for row in rows:
        for other, *values in row["partners"]:
            for table, value in zip(tables, values):
                table[row["idx"], other] = value
    genes = {g: i for i, g in enumerate(dict.fromkeys(r["gene"] for r in rows))}  # drugs without a gene share one entry
    shared = spark.sparkContext.broadcast(([r["drug"] for r in rows], *tables, np.array([genes[r["gene"]] for r in rows], dtype=np.int64)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, *numbers = shared.value
        index = {name: i for i, name in enumerate(names)}
        for pdf in batches:
            out = []
            for pid, drugs in zip(pdf["pid"], pdf["drugs"]):
                avail = np.array([index[d] for d in dict.fromkeys(drugs) if d in index], dtype=np.int64)
                best = _best_sets(avail, *numbers, beam_width, max_depth, top_k)
                out += [(pid, " + ".join(names[i] for i in s), score, size, rank) for rank, (s, score, size) in enumerate(best, 1)]
            yield pd.DataFrame(out, columns=["pid", "regimen", "score", "size", "rank"])

    searches = cut_lineage(pools.select("drugs").distinct().select("drugs", F.monotonically_increasing_id().alias("pid")))  # fixes the ids
    # a fixed task count: pools are few bytes but long work, so they must not be coalesced by size
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = cut_lineage(searches.repartition(tasks, "pid").mapInPandas(search, "pid long, regimen string, score double, size int, rank int"))
    return pools.select(key, "drugs").join(searches, "drugs").join(best, "pid").select(key, "regimen", "score", "size", "rank")


def first_class(alterations: DataFrame) -> DataFrame:
    """First alteration class per (patient, gene), and whether others were seen."""
    return alterations.groupBy("patient", "gene").agg(
        F.min_by("class", F.struct("ord", "class")).alias("class"), (F.countDistinct("class") > 1).alias("conflict")
    )


def mapped_class(col: str = "class") -> Column:
    """Truncating and deleted alterations share one drug list, everything else takes the stable-protein list."""
    return F.when(F.col(col).isin(*TRUNCATING), "deleted").otherwise("mutant")


def available_drugs(patient_genes: DataFrame, gene_drugs: DataFrame, class_drugs: DataFrame | None = None, min_genes: int = 2) -> DataFrame:
    """Per patient: genes, sorted drug pool, genes without an entry; patients with >= min_genes mapped genes.

    ``class_drugs`` (gene, class in {mutant, deleted}, drug) overrides gene_drugs for its genes.
    """
    pg = patient_genes.withColumn("mapped", mapped_class())
    lists = gene_drugs.groupBy("gene").agg(F.collect_set("drug").alias("ds"))
    out = pg.join(lists, "gene", "left")
    if class_drugs is not None:
        special = class_drugs.groupBy("gene", F.col("class").alias("mapped")).agg(F.collect_set("drug").alias("special"))
        out = out.join(special, ["gene", "mapped"], "left").withColumn("ds", F.coalesce("special", "ds"))
    out = out.groupBy("patient").agg(
        F.array_sort(F.collect_set("gene")).alias("genes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ds")))).alias("drugs"),
        F.array_sort(F.collect_set(F.when(F.col("ds").isNull(), F.col("gene")))).alias("no_entry"),
        F.count("ds").alias("n_mapped"),
    )
    return out.where(F.col("n_mapped") >= min_genes)


def cohort_regimens(pools: DataFrame, ranked: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row per patient: top regimen, score, ties; patients whose search found nothing keep nulls."""
    top = ranked.groupBy("patient").agg(F.max("score").alias("top_score"))
    tied = ranked.join(top, "patient").where(F.col("top_score") - F.col("score") < tolerance)
    sums = tied.groupBy("patient").agg(
        F.first("top_score").alias("top_score"), F.min_by("regimen", "rank").alias("top_regimen"), F.count(F.lit(1)).alias("n_tied_top"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "regimen"))), lambda s: s.getField("regimen")).alias("tied"),
    )
    out = pools.join(sums, "patient", "left")
    return out.select(
        "patient", F.array_join("genes", ",").alias("genes"), F.size("drugs").cast("long").alias("n_available_drugs"), "top_regimen",
        F.round("top_score", 6).alias("top_score"), F.coalesce("n_tied_top", F.lit(0)).alias("n_tied_top"),
        F.array_join("tied", " | ").alias("tied_regimens"), F.array_join("no_entry", ",").alias("genes_with_no_drug_entry"),
    )


def cohort_with_all_patients(patients: DataFrame, regimens: DataFrame) -> DataFrame:
    """Patients without genes or with fewer than two drugs stay as null rows."""
    return patients.select("patient").distinct().join(regimens, "patient", "left")


def regimen_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Patients whose top regimen or score changed (null-safe), the delta and a reason naming the drugs."""
    b = before.select("patient", F.col("top_regimen").alias("regimen_before"), F.col("top_score").alias("score_before"))
    a = after.select("patient", F.col("top_regimen").alias("regimen_after"), F.col("top_score").alias("score_after"))
    j = b.join(a, "patient", "full")
    same = F.col("regimen_before").eqNullSafe(F.col("regimen_after")) & F.col("score_before").eqNullSafe(F.col("score_after"))

    def drugs(c: str) -> Column:
        return F.coalesce(F.split(c, " \\+ "), F.array().cast("array<string>"))

    added = F.array_sort(F.array_except(drugs("regimen_after"), drugs("regimen_before")))
    removed = F.array_sort(F.array_except(drugs("regimen_before"), drugs("regimen_after")))
    words = F.concat_ws(
        "; ",
        F.when(F.size(added) > 0, F.concat(F.lit("added: "), F.array_join(added, ", "))),
        F.when(F.size(removed) > 0, F.concat(F.lit("removed: "), F.array_join(removed, ", "))),
    )
    return j.where(~same).select(
        "*", (F.col("score_after") - F.col("score_before")).alias("score_delta"),
        F.when(words == "", "same drugs, score changed").otherwise(words).alias("reason"),
    )


def patient_combinations(patient_genes: DataFrame, gene_drugs: DataFrame, gene_pathways: DataFrame, gene_class: DataFrame,
                         drug_toxicity: DataFrame, known_synergy: DataFrame, top_n: int = 15) -> DataFrame:
    """Ranked two-drug combinations per patient: best gene pair per combination in gene order, top_n, pilot flag.

    The gene-pair x drug x drug table depends on the knowledge tables only; each distinct gene set is held against it once.
    """
    sides = gene_drugs.join(gene_class, "gene", "left").select("gene", "drug", "ord", "gene_class")
    genes = unordered_pairs(sides.select("gene", "gene_class").distinct(), "gene").withColumnsRenamed({"gene_1": "gene_a", "gene_2": "gene_b"})
    over = gene_overlap(gene_pathways)
    table = genes.join(over, ["gene_a", "gene_b"], "left")
    for s, other in (("a", "1"), ("b", "2")):
        table = table.join(sides.select(F.col("gene").alias(f"gene_{s}"), F.col("drug").alias(f"drug_{s}"), F.col("ord").alias(f"ord_{s}")), f"gene_{s}")
    table = table.where(F.col("drug_a") != F.col("drug_b"))
    table = table.withColumn("x", F.least("drug_a", "drug_b")).withColumn("y", F.greatest("drug_a", "drug_b"))
    known = known_synergy.select(F.least("drug_a", "drug_b").alias("x"), F.greatest("drug_a", "drug_b").alias("y"), "boost")
    table = table.join(known, ["x", "y"], "left")
    score = heuristic_synergy(F.coalesce("overlap", F.lit(0)), F.col("gene_class_1"), F.col("gene_class_2"), F.coalesce("boost", F.lit(0.0)))
    table = safety_screen(table.withColumn("score", F.round(score, 3)), drug_toxicity)
    table = table.select("gene_a", "gene_b", "drug_a", "drug_b", "ord_a", "ord_b", "score", "flagged", "toxicity_overlap")
    # per combination its gene pairs in gene order; the one row holding all combinations is as large as the knowledge tables
    table = table.withColumn("combination", F.concat_ws(" + ", "drug_a", "drug_b"))
    best = F.struct("gene_a", "gene_b", "drug_a", "drug_b", "score", "flagged", "toxicity_overlap", "combination")
    table = table.groupBy("combination").agg(F.array_sort(F.collect_list(best)).alias("pairs")).agg(F.collect_list("pairs").alias("t")).scalar()
    patients = patient_genes.groupBy("patient").agg(F.array_sort(F.collect_set("gene")).alias("gs"))

    def carried(pair: Column) -> Column:
        return F.array_contains("gs", pair.getField("gene_a")) & F.array_contains("gs", pair.getField("gene_b"))

    # patients with the same genes share one ranking, so nothing larger than its top rows is shuffled
    tasks = 4 * int(patient_genes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = patients.select("gs").distinct().repartition(tasks, "gs").withColumn("_t", table)
    hits = F.array_compact(F.transform("_t", lambda pairs: F.get(F.filter(pairs, carried), F.lit(0))))
    hits = F.array_sort(F.transform(hits, lambda r: F.struct((-r.getField("score")).alias("order"), r.getField("combination").alias("combination"), r.alias("r"))))
    ranked = ranked.select("gs", F.slice(hits, 1, top_n).alias("top"))
    # the outer form keeps the optimizer from ranking a second time to drop empty lists
    top = patients.join(ranked, "gs").select("patient", F.posexplode_outer("top").alias("rank", "c"), "top").where("c is not null")
    first_safe = F.array_position(F.transform("top", lambda c: c.getField("r").getField("flagged")), False)
    top = top.select("patient", "c.r.*", (F.col("rank") + 1).alias("rank"), F.nullif(first_safe, F.lit(0)).alias("pilot"))
    return top.withColumn("recommended_first_pilot", F.coalesce(F.col("rank") == F.col("pilot"), F.lit(False))).drop("pilot").withColumn("rationale", rationale())


def rationale() -> Column:
    """Fixed template sentence."""
    safety = F.when(
        F.col("flagged"), F.format_string("Safety Agent flags overlapping %s risk.", F.col("toxicity_overlap"))
    ).otherwise("Safety Agent finds no overlapping toxicity flags in the curated table.")
    return F.concat(
        "gene_a", F.lit("+"), "gene_b", F.lit(" co-alteration suggests combining "), "drug_a", F.lit(" and "), "drug_b",
        F.lit(" (predicted synergy "), F.col("score").cast("string"), F.lit("). "), safety,
    )
