"""Queries over drug names and literature text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from targetloom.functions import text as T
from targetloom.functions.numeric import clip, log_of, r6
from targetloom.operators import literature as L
from targetloom.plans.registry import query
from targetloom.plans.roles import ROLE_SQL, Inputs


def _normalised_sql(col: str) -> str:
    out = f"trim(lower({col}))"
    for s in T.SALT_SUFFIXES:
        out = f"regexp_replace(regexp_replace({out}, '\\s*\\({s}\\)$', ''), '\\s+{s}$', '')"
    return f"trim({out})"


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_NAMES = f"names AS (SELECT DISTINCT drug, {_normalised_sql('drug')} AS n FROM interactions)"


@query("l01_normalised_drug_names", f"WITH {_NAMES} SELECT drug, n AS normalised, n IN ({_list(T.JUNK_PHRASES)}) OR trim(lower(drug)) IN ({_list(T.JUNK_PHRASES)}) AS junk FROM names")
def _(x: Inputs) -> DataFrame:
    """L1 normalisation and L2 junk test."""
    return x.interactions.select("drug").distinct().select("drug", T.normalised_drug_name("drug").alias("normalised"), T.is_junk_drug_name("drug").alias("junk"))


ROLE_SQL["raw_names"] = """SELECT DISTINCT concat(CASE p_size % 9 WHEN 0 THEN 'compound ' WHEN 1 THEN 'CHEMBL' WHEN 2 THEN 'nvp-' WHEN 3 THEN '5-' ELSE '' END,
    CASE WHEN p_size % 9 IN (1, 2) THEN CAST(p_size AS VARCHAR(20)) WHEN p_size % 9 = 3 THEN 'fluorouracil' ELSE p_name END,
    CASE p_size % 7 WHEN 0 THEN ' inhibitor 3' WHEN 1 THEN 'nib' WHEN 2 THEN ' et al. 2001' WHEN 3 THEN ',' ELSE '' END) AS drug FROM part
    UNION SELECT DISTINCT lower(p_brand) FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part"""


@query(
    "l03_real_drug_heuristic",
    f"""WITH n AS (SELECT drug, trim(regexp_replace(trim(lower(drug)), ',+$', '')) AS n FROM raw_names)
        SELECT drug, CASE WHEN n = '' OR n IN ({_list(T.GENERIC_WORDS)}) THEN false WHEN n IN (SELECT lower(p_brand) FROM part) THEN false
            WHEN regexp_matches(n, '({'|'.join(T.NAME_ENDINGS)})$') THEN true WHEN regexp_matches(n, '\\[pmid|\\bet al\\.|^compound\\s') THEN false
            WHEN regexp_matches(n, 'chembl[:\\s]?\\d') THEN false WHEN regexp_matches(n, '^\\d+-[a-z]+$') THEN true
            WHEN regexp_matches(regexp_replace(n, '[-\\s]', '', 'g'), '^[a-z0-9]+$') AND regexp_matches(n, '[a-z]') AND regexp_matches(n, '[0-9]') THEN false
            WHEN regexp_matches(n, '-in-\\d+$|inhibitor \\d+[a-z]?$') THEN false ELSE true END AS is_drug FROM n""",
)
def _(x: Inputs) -> DataFrame:
    genes = x.part.agg(F.collect_set(F.lower("p_brand")).alias("g")).scalar()
    return x.raw_names.withColumn("_g", genes).select("drug", T.looks_like_drug("drug", F.col("_g")).alias("is_drug"))


# RE2 word boundaries know ASCII only: accented letters become underscores, which are word characters there
_ASCII = r"regexp_replace(lower(abstract), '[\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02FF}\x{0370}-\x{1FFF}]', '_', 'g')"
_WORDS = rf"regexp_extract_all({_ASCII}, '\b([a-zA-Z][a-zA-Z0-9\-]{{3,}})\b', 1)"


def _cand(endings: tuple[str, ...]) -> str:
    return f"""cand AS (SELECT gene, pmid, abstract, w AS drug FROM (SELECT gene, pmid, abstract, unnest(list_distinct({_WORDS})) AS w FROM abstracts) q
    WHERE regexp_matches(w, '..({'|'.join(endings)})$') AND w NOT IN ({_list(T.TEXT_STOPWORDS)}))"""


COMMON_ENDINGS = ("tion", "ment", "keit")


@query("l04_text_candidates", f"WITH {_cand(T.TEXT_ENDINGS)} SELECT pmid, drug FROM cand")
def _(x: Inputs) -> DataFrame:
    return x.abstracts.select("pmid", F.explode(T.candidate_drugs("abstract")).alias("drug"))


@query("l04_candidates_common_endings", f"WITH {_cand(COMMON_ENDINGS)} SELECT pmid, count(*) AS n, min(drug) AS first_word, max(drug) AS last_word FROM cand GROUP BY pmid")
def _(x: Inputs) -> DataFrame:
    rows = x.abstracts.select("pmid", F.explode(T.candidate_drugs("abstract", COMMON_ENDINGS)).alias("drug"))
    return rows.groupBy("pmid").agg(F.count(F.lit(1)).alias("n"), F.min("drug").alias("first_word"), F.max("drug").alias("last_word"))


def _hits(patterns: tuple[str, ...]) -> str:
    return " + ".join(f"(CASE WHEN regexp_matches(s, '{p}') THEN 1 ELSE 0 END)" for p in patterns)


# the shared texts hold no clinical wording, so each turn gets a closing sentence chosen by its key
ROLE_SQL["context_texts"] = """SELECT CAST(conv_id AS VARCHAR(20)) AS conv, CAST(turn AS INTEGER) AS turn, concat(text, ' ',
    CASE (conv_id + turn) % 5 WHEN 0 THEN 'Cells were resistant to olaparib. Olaparib showed limited efficacy.' WHEN 1 THEN 'The combination of olaparib was synergistic with others! It was promising.'
         WHEN 2 THEN 'Acquired resistance to olaparib was promising.' WHEN 3 THEN 'Olaparib combined well with others? Potentiating olaparib failed to improve; combination of olaparib synergy.' ELSE 'No drug is named here, resistant or not.' END) AS text
    FROM conversations"""
_SENT = r"sent AS (SELECT conv, turn, unnest(string_split_regex(regexp_replace(lower(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM context_texts)"


@query(
    "l05_mention_context",
    f"""WITH {_SENT}, h AS (SELECT conv, turn, sum({_hits(T.CAUTIONARY)}) AS bad, sum({_hits(T.SUPPORTIVE)}) AS good FROM sent WHERE contains(s, 'olaparib') GROUP BY 1, 2)
        SELECT c.conv, c.turn, CASE WHEN coalesce(bad, 0) = 0 AND coalesce(good, 0) = 0 THEN 'unclear' WHEN good > bad THEN 'supportive' ELSE 'cautionary' END AS context
        FROM context_texts c LEFT JOIN h ON h.conv = c.conv AND h.turn = c.turn""",
)
def _(x: Inputs) -> DataFrame:
    return x.context_texts.withColumn("drug", F.lit("olaparib")).select("conv", "turn", T.mention_context("text", "drug").alias("context"))


ROLE_SQL["known_interactions"] = """SELECT source AS gene, lower(split_part(text, ' ', 1)) AS drug FROM documents
    UNION SELECT source, lower(w) FROM (SELECT source, regexp_extract(text, '([A-Za-z]{3,}(nib|mab|gene|stat|cept))', 1) AS w FROM documents) q WHERE w <> ''"""


def _found(x: Inputs) -> DataFrame:
    """Candidates in the texts of all genes; the gap rule, which would leave genes out, has its own query (f08)."""
    return L.discover(x.abstracts, x.abstracts.select("gene").distinct(), x.known_interactions)


@query(
    "l06_discovery",
    f"""WITH {_cand(T.TEXT_ENDINGS)} SELECT cand.gene, drug AS candidate_drug, pmid, (cand.gene, drug) IN (SELECT gene, drug FROM known_interactions) AS confirmed, substr(abstract, 1, 200) AS snippet FROM cand""",
)
def _(x: Inputs) -> DataFrame:
    return _found(x).select("gene", "candidate_drug", "pmid", "confirmed", "snippet")


@query(
    "f07_merged_pool",
    f"""WITH {_cand(T.TEXT_ENDINGS)}, ok AS (SELECT gene, drug, pmid FROM cand WHERE (gene, drug) IN (SELECT gene, drug FROM known_interactions)),
        pool AS (SELECT DISTINCT gene, drug FROM gene_drugs), u AS (SELECT gene, drug, NULL AS pmid, 1 AS c FROM pool UNION ALL SELECT gene, drug, pmid, 0 FROM ok)
        SELECT gene, drug, max(c) = 1 AS curated, CASE WHEN max(c) = 1 THEN '' ELSE string_agg(DISTINCT pmid, ',' ORDER BY pmid) END AS pmids FROM u GROUP BY gene, drug""",
)
def _(x: Inputs) -> DataFrame:
    """F7 merge with provenance and L8 policy."""
    out = L.merge_candidates(x.gene_drugs, _found(x))
    return out.select("gene", "drug", "curated", F.array_join("pmids", ",").alias("pmids"))


@query(
    "f08_coverage_gaps",
    """SELECT m.gene, count(DISTINCT g.drug) AS n_candidates FROM (SELECT DISTINCT gene FROM markers) m LEFT JOIN gene_drugs g ON g.gene = m.gene GROUP BY 1 HAVING count(DISTINCT g.drug) < 5""",
)
def _(x: Inputs) -> DataFrame:
    return L.coverage_gaps(x.markers.select("gene"), [x.gene_drugs], 5)


@query(
    "l07_numbered_entries",
    """WITH b AS (SELECT gene, string_agg(concat(CHR(10), pmid, '. ', regexp_replace(abstract, '\\n\\d+\\.\\s', ' ', 'g')), '' ORDER BY CAST(pmid AS BIGINT)) AS block FROM abstracts GROUP BY gene)
       SELECT gene, CAST(len(string_split_regex(CHR(10) || block, '\\n\\d+\\.\\s')) - 1 AS BIGINT) AS n_entries FROM b""",
)
def _(x: Inputs) -> DataFrame:
    clean = F.regexp_replace("abstract", r"\n\d+\.\s", " ")
    entry = F.concat(F.lit("\n"), "pmid", F.lit(". "), clean)
    parts = F.array_sort(F.collect_list(F.struct(F.col("pmid").cast("long").alias("p"), entry.alias("e"))))
    block = x.abstracts.groupBy("gene").agg(F.array_join(F.transform(parts, lambda s: s.getField("e")), "").alias("block"))
    return block.select("gene", F.size(T.numbered_entries("block")).cast("long").alias("n_entries"))


@query(
    "l09_compound_symbols",
    """SELECT gene, min(split_part(compound_id, '|', -2)) AS symbol, min(CASE WHEN length(split_part(compound_id, '|', 7)) > 10 THEN split_part(compound_id, '|', 6) ELSE split_part(compound_id, '|', 7) END) AS label, count(*) AS n FROM proteome GROUP BY gene""",
)
def _(x: Inputs) -> DataFrame:
    return x.proteome.groupBy("gene").agg(F.min(T.compound_symbol("compound_id")).alias("symbol"), F.min(T.display_symbol("compound_id")).alias("label"), F.count(F.lit(1)).alias("n"))


@query(
    "l10_class_by_keyword",
    f"""SELECT doc_id, CASE WHEN regexp_matches(upper(text), '{'|'.join(T.WIDE_RTK_KEYWORDS)}') THEN 'RTK' WHEN regexp_matches(upper(text), '{'|'.join(T.WIDE_NRTK_KEYWORDS)}') THEN 'NRTK' ELSE 'Other' END AS kinase_class FROM documents""",
)
def _(x: Inputs) -> DataFrame:
    return x.documents.select("doc_id", T.kinase_class("text").alias("kinase_class"))


@query(
    "l11_source_counts",
    "SELECT kinase_id, CAST(sum(len(list_filter(string_split(sources, ','), lambda s: trim(s) <> ''))) AS BIGINT) AS n_sources FROM interactions GROUP BY kinase_id",
)
def _(x: Inputs) -> DataFrame:
    return x.interactions.groupBy("kinase_id").agg(F.sum(T.source_count("sources")).alias("n_sources"))


@query(
    "l12_keys",
    "SELECT concat(least(k1, k2), '|', greatest(k1, k2)) AS pair_key, round(xtalk, 6) AS weight FROM panel_pairs WHERE xtalk > 0",
)
def _(x: Inputs) -> DataFrame:
    return x.panel_pairs.where("xtalk > 0").select(T.pair_key("k2", "k1").alias("pair_key"), r6("xtalk").alias("weight"))


@query(
    "l15_numeric_functions",
    """SELECT event_id, round(ln(1 + value), 6) AS a, round(log2(value), 6) AS b, round(log10(value), 6) AS c, round(exp(-value / 100), 6) AS d, CAST(sign(value - 50) AS DOUBLE) AS e,
              round(least(greatest(value, 5), 100), 6) AS f, round(sqrt(abs(value - 50)), 6) AS g FROM events""",
)
def _(x: Inputs) -> DataFrame:
    v = F.col("value")
    return x.events.select(
        "event_id", *[log_of(r6(f), of).alias(n) for n, f, of in (("a", F.log1p(v), v + 1), ("b", F.log2(v), v), ("c", F.log10(v), v))],
        r6(F.exp(-v / 100)).alias("d"), F.signum(v - 50).alias("e"),
        r6(clip(v, 5.0, 100.0)).alias("f"), r6(F.sqrt(F.abs(v - 50))).alias("g"),
    )


_SRC_N = "len(list_filter(string_split(sources, ','), lambda s: trim(s) <> ''))"


@query(
    "d30_repurposing_table",
    f"""WITH top AS (SELECT kinase_id, target_score FROM panel_scores ORDER BY target_score DESC, kinase_id LIMIT 20),
        b AS (SELECT kinase_id, lower(drug) AS drug, max({_SRC_N}) AS n FROM interactions GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY kinase_id ORDER BY n DESC, drug) AS r FROM b)
        SELECT top.kinase_id, round(target_score, 6) AS target_score, coalesce(string_agg(drug, '; ' ORDER BY r), 'none recorded') AS drugs FROM top LEFT JOIN p ON p.kinase_id = top.kinase_id AND r <= 3 GROUP BY 1, target_score""",
)
def _(x: Inputs) -> DataFrame:
    return L.repurposing_table(x.panel_scores, x.interactions).select("kinase_id", r6("target_score").alias("target_score"), "drugs")


_REAL = f"""ok AS (SELECT kinase_id AS gene, {_normalised_sql('drug')} AS drug, {_SRC_N} AS n, ord FROM interactions),
    p AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n DESC, drug, ord) AS r FROM ok), rl AS (SELECT gene, drug, min(r) AS r FROM p WHERE r <= 3 GROUP BY 1, 2)"""


@query("d31_gene_drug_lists", f"WITH {_REAL} SELECT gene, string_agg(drug, ',' ORDER BY r) AS drugs FROM rl GROUP BY gene")
def _(x: Inputs) -> DataFrame:
    return L.gene_drug_lists(x.interactions).select("gene", F.array_join("drugs", ",").alias("drugs"))


@query(
    "d32_candidate_set_difference",
    f"""WITH {_REAL}, a AS (SELECT DISTINCT gene, drug FROM gene_drugs), b AS (SELECT gene, drug FROM rl)
        SELECT gene, drug, 'first only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) q UNION ALL SELECT gene, drug, 'second only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) r""",
)
def _(x: Inputs) -> DataFrame:
    real = L.gene_drug_lists(x.interactions).select("gene", F.explode("drugs").alias("drug"))
    return L.candidate_set_difference(x.gene_drugs, real)
