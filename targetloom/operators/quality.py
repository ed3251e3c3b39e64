"""Input checks.  Every check is rows of (level, check_name, message); a report is their union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _row(level: Column, name: str, message: Column) -> list[Column]:
    return [level.alias("level"), F.lit(name).alias("check_name"), message.alias("message")]


def not_empty(df: DataFrame, name: str) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("n")).select(*_row(F.when(F.col("n") > 0, "PASS").otherwise("FAIL"), name, F.concat(F.col("n").cast("string"), F.lit(" rows"))))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Driver metadata only."""
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str], what: str) -> DataFrame:
    gone = missing_columns(df, required)
    if gone:
        raise ValueError(f"{what}: missing columns {gone}, found {df.columns}")
    return df


def accepted_schema(df: DataFrame, schemas: dict[str, Sequence[str]]) -> str | None:
    """Name of the first accepted schema the columns satisfy."""
    return next((name for name, cols in schemas.items() if not missing_columns(df, cols)), None)


def resolve_columns(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Rename the first alias present (case-insensitive) to its canonical name."""
    lower = {c.lower(): c for c in df.columns}
    found = {}
    for name, options in aliases.items():
        hit = next((lower[o.lower()] for o in options if o.lower() in lower), None)
        if hit is None:
            raise ValueError(f"no column for {name}: tried {list(options)}")
        found[hit] = name
    return df.withColumnsRenamed(found)


def numeric_range(df: DataFrame, col: str, low: float, high: float, name: str) -> DataFrame:
    v = F.col(col).cast("string").try_cast("double")
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("bad"), F.count_if((v < low) | (v > high)).alias("out"))
    level = F.when(F.col("out") > 0, "FAIL").when(F.col("bad") > 0, "WARN").otherwise("PASS")
    return agg.select(*_row(level, name, F.format_string("%d of %d outside, %d not numeric", "out", "n", "bad")))


def coverage(expected: DataFrame, have: DataFrame, key: str, name: str) -> DataFrame:
    """FAIL at 0 %, WARN below 100 % (the message says when below half), PASS at full coverage."""
    h = have.select(key).distinct().withColumn("_h", F.lit(1))
    agg = expected.select(key).distinct().join(h, key, "left").agg(F.count(F.lit(1)).alias("n"), F.count("_h").alias("h"))
    share = F.col("h") / F.col("n")
    level = F.when(F.col("h") == 0, "FAIL").when(share < 1, "WARN").otherwise("PASS")
    text = F.format_string("%d of %d covered%s", "h", "n", F.when((share > 0) & (share < 0.5), ", below half").otherwise(""))
    return agg.select(*_row(level, name, text))


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("d"))
    return dup.select(*_row(F.when(F.col("d") > 0, "WARN").otherwise("PASS"), name, F.format_string("%d duplicated keys", "d")))


def matrix_orientation(ids: DataFrame, id_col: str, pattern: str, name: str, limit: float = 0.8) -> DataFrame:
    """Which side holds gene-like ids: share of ids that match the pattern."""
    agg = ids.agg(F.avg(F.col(id_col).rlike(pattern).cast("double")).alias("s"))
    text = F.when(F.col("s") > limit, "genes in rows").otherwise("genes in columns")
    return agg.select(*_row(F.lit("PASS"), name, text))


def gene_effect_checks(cells: DataFrame, panel: DataFrame, name: str, low: float = -10.0, high: float = 10.0) -> DataFrame:
    """Orientation and value range of a gene-effect matrix given as (row_id, head, value): row and column names; ``panel``: (gene).

    Columns should carry the genes, plain or as 'GENE (number)': FAIL when panel genes stand in the rows only or nowhere,
    WARN when some are missing.  Values: FAIL when all are 0, WARN outside [low, high]; no line without values.
    """
    genes = panel.select("gene").where("gene is not null").distinct()
    heads = cells.select(F.split("head", " \\(")[0].alias("gene")).distinct().join(genes, "gene", "left_semi").select(F.lit(1).alias("c"), F.lit(0).alias("r"))
    sides = cells.select(F.col("row_id").alias("gene")).distinct().join(genes, "gene", "left_semi").select(F.lit(0).alias("c"), F.lit(1).alias("r"))
    known = genes.select(F.lit(0).alias("c"), F.lit(0).alias("r"), F.lit(1).alias("p"))
    seen = heads.unionByName(sides).withColumn("p", F.lit(0)).unionByName(known)
    agg = seen.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("c", "r", "p")])
    level = F.when(F.col("c") == 0, "FAIL").when(F.col("c") < F.col("p"), "WARN").otherwise("PASS")
    text = F.when((F.col("c") == 0) & (F.col("r") > 0), F.format_string("backwards: %d panel genes in the rows, none in the columns", "r"))
    turn = agg.select(*_row(level, f"{name} orientation", F.coalesce(text, F.format_string("%d of %d panel genes in the columns", "c", "p"))))
    span = cells.where(F.col("value").isNotNull() & ~F.isnan("value")).agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a is not null")
    zero, wide = (F.col("a") == 0) & (F.col("b") == 0), (F.col("a") < low) | (F.col("b") > high)
    words = F.when(zero, "all values are 0").when(wide, "values too wide for gene effects").otherwise("values fit gene effects")
    return turn.unionByName(span.select(*_row(F.when(zero, "FAIL").when(wide, "WARN").otherwise("PASS"), f"{name} values", words)))


def edge_scale(edges: DataFrame, weight: str, name: str) -> DataFrame:
    agg = edges.agg(F.max(weight).alias("m"))
    return agg.select(*_row(F.when(F.col("m") > 1.5, "FAIL").otherwise("PASS"), name, F.when(F.col("m") > 1.5, "raw scale").otherwise("scaled to 1")))


def enough_communities(df: DataFrame, col: str, name: str, least: int = 2) -> DataFrame:
    agg = df.agg(F.countDistinct(col).alias("c"))
    return agg.select(*_row(F.when(F.col("c") >= least, "PASS").otherwise("FAIL"), name, F.format_string("%d communities", "c")))


def list_hygiene(df: DataFrame, col: str, name: str, least: int = 10, odd: str = r"[^A-Za-z0-9_\- #()]") -> DataFrame:
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(col).alias("u"), F.count_if(F.col(col).rlike(odd)).alias("o"))
    level = F.when(F.col("n") < least, "FAIL").when((F.col("n") > F.col("u")) | (F.col("o") > 0), "WARN").otherwise("PASS")
    return agg.select(*_row(level, name, F.format_string("%d entries, %d distinct, %d odd", "n", "u", "o")))


def gene_drug_schema(df: DataFrame, name: str) -> DataFrame:
    blank = F.count_if(F.coalesce(F.trim("gene"), F.lit("")) == "").alias("g"), F.count_if(F.coalesce(F.trim("drug"), F.lit("")) == "").alias("d")
    agg = df.agg(*blank)
    bad = (F.col("g") > 0) | (F.col("d") > 0)
    return agg.select(*_row(F.when(bad, "FAIL").otherwise("PASS"), name, F.format_string("%d blank genes, %d blank drugs", "g", "d")))


def report(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
