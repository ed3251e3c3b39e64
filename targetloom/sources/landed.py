"""Readers for landed files.  Each returns a lazy DataFrame with a declared schema; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from targetloom.operators.quality import require_columns


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV or TSV by suffix."""
    name = path.lower().removesuffix(".gz")
    sep = "\t" if name.endswith((".tsv", ".maf", ".txt", ".tab")) else ","
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("gene")).where("gene <> ''")


def read_star_counts(spark: SparkSession, folder: str, pattern: str = "*.tsv", value: str = "tpm_unstranded") -> DataFrame:
    """(file_name, gene, value): recursive scan, comment lines and N_ rows skipped, largest value per symbol."""
    rows = (
        spark.read.option("header", True).option("sep", "\t").option("comment", "#").option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).csv(folder)
    )
    return star_values(rows.withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1)), value)


def star_values(rows: DataFrame, value: str) -> DataFrame:
    kept = rows.where(~F.col("gene_id").startswith("N_") & F.col("gene_name").isNotNull())
    return kept.groupBy("file_name", F.col("gene_name").alias("gene")).agg(F.max(F.col(value).try_cast("double")).alias("value"))


def sample_sheet(df: DataFrame) -> DataFrame:
    require_columns(df, ["File Name", "Case ID"], "sample sheet")
    return df.select(F.col("File Name").alias("file_name"), F.substring("Case ID", 1, 12).alias("patient_id")).distinct()


def expression_matrix(values: DataFrame, sheet: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """File -> patient, restricted to genes; several files of a patient are averaged."""
    rows = values.join(genes.select("gene"), "gene", "left_semi") if genes is not None else values
    return rows.join(sheet, "file_name").groupBy("patient_id", "gene").agg(F.avg("value").alias("value"))


def unmapped_files(values: DataFrame, sheet: DataFrame) -> DataFrame:
    return values.select("file_name").distinct().join(sheet, "file_name", "left_anti")


def genes_without_values(genes: DataFrame, matrix: DataFrame) -> DataFrame:
    have = matrix.where(F.col("value").isNotNull()).select("gene").distinct()
    return genes.select("gene").distinct().join(have, "gene", "left_anti")


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """Plain or gzip MAF files; comment lines skipped, rows with a wrong field count dropped.

    A gzip file is one task; land the result as Parquet before repeated use.
    """
    return spark.read.option("header", True).option("sep", "\t").option("comment", "#").option("mode", "DROPMALFORMED").option(
        "recursiveFileLookup", True
    ).csv(path).select("Hugo_Symbol", "Variant_Classification", "Tumor_Sample_Barcode")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")


INTERACTION_PAYLOAD = (
    "struct<data:struct<genes:struct<nodes:array<struct<name:string,interactions:array<struct<drug:struct<name:string,conceptId:string>,"
    "interactionScore:double,interactionTypes:array<struct<type:string>>,sources:array<struct<fullName:string>>>>>>>>>"
)


def parse_interaction_payload(df: DataFrame, col: str = "payload") -> DataFrame:
    """Nested gene -> interactions payload to flat rows."""
    nodes = F.from_json(F.col(col), INTERACTION_PAYLOAD).getField("data").getField("genes").getField("nodes")
    g = df.select(F.explode(nodes).alias("g"))
    i = g.select(F.col("g.name").alias("kinase_id"), F.explode_outer("g.interactions").alias("i")).where(F.col("i").isNotNull())
    return i.select(
        "kinase_id", F.col("i.drug.name").alias("drug"), F.col("i.drug.conceptId").alias("drug_concept_id"), F.col("i.interactionScore").alias("interaction_score"),
        F.array_join(F.transform("i.interactionTypes", lambda t: t.getField("type")), ",").alias("interaction_types"),
        F.array_join(F.transform("i.sources", lambda s: s.getField("fullName")), ",").alias("sources"),
    )


ACTIVITY_PAGE = "struct<activities:array<struct<molecule_chembl_id:string,standard_type:string,standard_value:string,standard_units:string>>>"


def parse_activity_pages(df: DataFrame, col: str = "payload", types: tuple[str, ...] = ("IC50", "Ki", "Kd")) -> DataFrame:
    a = df.select(*[c for c in df.columns if c != col], F.explode(F.from_json(F.col(col), ACTIVITY_PAGE).getField("activities")).alias("a"))
    return a.select(*[c for c in df.columns if c != col], "a.*").where(F.col("standard_type").isin(*types)).withColumn("standard_value", F.col("standard_value").try_cast("double"))


def choose_target(df: DataFrame, wanted: str) -> DataFrame:
    """One single-protein target per query: exact name first, then the smallest id."""
    one = df.where(F.col("target_type") == "SINGLE PROTEIN")
    exact = (F.upper("pref_name") != F.upper(F.col(wanted))).cast("int")
    return one.groupBy(wanted).agg(F.min_by("target_id", F.struct(exact, F.col("target_id"))).alias("target_id"))


def parse_reaction_counts(df: DataFrame, col: str = "payload") -> DataFrame:
    r = df.select("drug", F.explode(F.from_json(F.col(col), "struct<results:array<struct<term:string,count:long>>>").getField("results")).alias("r"))
    return r.select("drug", F.col("r.term").alias("reaction"), F.col("r.count").alias("report_count"))


def tidy_matrix(df: DataFrame, id_col: str, value: str = "value", lines: DataFrame | None = None) -> DataFrame:
    """Wide line x 'GENE (id)' matrix to long rows with the gene mean over the kept lines."""
    kept = df.join(lines.select(id_col), id_col, "left_semi") if lines is not None else df
    cols = [c for c in df.columns if c != id_col]
    long = kept.unpivot([id_col], [F.col(f"`{c}`") for c in cols], "header", value).withColumn("gene", F.trim(F.split("header", r" \(")[0])).drop("header")
    mean = long.groupBy("gene").agg(F.avg(value).alias("mean_over_lines"))
    return long.where(F.col(value).isNotNull()).join(mean, "gene")


def parse_pair_keys(lines: DataFrame, symbols: DataFrame, key: str = "key", score: str = "score") -> DataFrame:
    """Rows keyed by a text tuple ('ID1','ID2') to symbol pairs with both ends known; id versions are dropped."""
    ids = lines.select(
        F.split(F.regexp_extract(key, r"\('([^']+)'\s*,\s*'([^']+)'\)", 1), r"\.")[0].alias("i1"),
        F.split(F.regexp_extract(key, r"\('([^']+)'\s*,\s*'([^']+)'\)", 2), r"\.")[0].alias("i2"), F.col(score).alias("score"),
    )
    a = symbols.select(F.col("id").alias("i1"), F.col("gene").alias("gene1"))
    b = symbols.select(F.col("id").alias("i2"), F.col("gene").alias("gene2"))
    return ids.join(a, "i1").join(b, "i2").select("gene1", "gene2", "score")


def second_network(df: DataFrame, panel: DataFrame) -> DataFrame:
    """Upper-case, trimmed, both ends in the panel; the last row of a duplicate wins (``ord`` gives file order)."""
    require_columns(df, ["gene1", "gene2", "score"], "network")
    rows = df.withColumn("gene1", F.upper(F.trim("gene1"))).withColumn("gene2", F.upper(F.trim("gene2")))
    p = panel.select(F.upper("gene").alias("g"))
    rows = rows.join(p.withColumnRenamed("g", "gene1"), "gene1", "left_semi").join(p.withColumnRenamed("g", "gene2"), "gene2", "left_semi")
    return rows.groupBy("gene1", "gene2").agg(F.max_by(F.col("score").cast("double"), "ord").alias("score"))


def combination_rows(df: DataFrame, lines: DataFrame, drugs: DataFrame) -> DataFrame:
    """Lines of interest, both drugs resolvable, metrics renamed, rows without a metric dropped."""
    names = {"synergy_bliss": "bliss", "synergy_loewe": "loewe", "synergy_hsa": "hsa", "synergy_zip": "zip"}
    require_columns(df, ["drug_row", "drug_col", "cell_line_name", *names], "combination table")
    rows = df.join(lines.select("cell_line_name"), "cell_line_name", "left_semi")
    d = drugs.select("drug")
    rows = rows.join(d.withColumnRenamed("drug", "drug_row"), "drug_row", "left_semi").join(d.withColumnRenamed("drug", "drug_col"), "drug_col", "left_semi")
    return rows.withColumnsRenamed(names).dropna(subset=list(names.values()))


def unresolved_drugs(df: DataFrame, drugs: DataFrame) -> DataFrame:
    return df.select(F.explode(F.array("drug_row", "drug_col")).alias("drug")).distinct().join(drugs.select("drug"), "drug", "left_anti")


def file_inventory(files: DataFrame, patterns: dict[str, str], examples: int = 3) -> DataFrame:
    """(kind, n_files, examples) from a listing with a ``path`` column (binaryFile metadata, content unread)."""
    name = F.element_at(F.split("path", "/"), -1)
    kind: Column = F.lit("other")
    for label, pattern in reversed(patterns.items()):
        kind = F.when(name.rlike(pattern), label).otherwise(kind)
    rows = files.select(kind.alias("kind"), name.alias("name"))
    first = rows.withColumn("_p", F.row_number().over(Window.partitionBy("kind").orderBy("name"))).where(F.col("_p") <= examples)
    ex = first.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("examples"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_files")).join(ex, "kind")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
