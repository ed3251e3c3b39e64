"""Drug names and literature text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Salt forms removed from a drug name, in this order.
SALT_SUFFIXES = (
    "hydrochloride", "dihydrochloride", "sodium", "mesylate", "dimesylate", "tartrate", "sulfate", "sulphate", "phosphate", "citrate", "maleate",
    "dimaleate", "hydrobromide", "besylate", "succinate", "fumarate", "acetate", "bromide", "chloride", "monohydrate", "dihydrate", "s-malate", "anhydrous",
)
# Class labels that are listed as if they were drugs.
JUNK_PHRASES = (
    "antineoplastic agent", "anesthetic agent", "btk inhibitor", "c-met inhibitor", "anthracycline antineoplastic antibiotic", "anthraquinone analogue",
    "antisense oligonucleotides",
)
# Words that are not a drug name on their own.
GENERIC_WORDS = (
    "human", "agent", "factor", "growth", "cytokine", "inhibitor", "recombinant", "antineoplastic", "autologous", "therapeutic", "isomer", "mab",
    "pegylated", "protein-bound", "tosylate", "esylate", "s-malate", "car-specific", "t-lymphocytes", "ii", "glulisine", "insulin", "regular",
    "arginase", "2", "i", "anhydrous", "fibroblast", "hydrochloride", "monohydrate", "sodium", "citrate", "tartrate", "succinate",
)
# Drug-name endings; the text search knows one more.
NAME_ENDINGS = (
    "nib", "rafenib", "tinib", "parib", "ciclib", "mab", "zumab", "ximab", "tuzumab", "umab", "stat", "degib", "lisib", "setron", "sertib", "clax",
    "dostat", "metinib", "afenib", "bulin", "gene", "kinra", "cept", "mustine", "platin", "rubicin",
)
TEXT_ENDINGS = (*NAME_ENDINGS, "apopt")
# Words with a drug-like ending that are no drugs.
TEXT_STOPWORDS = ("gene", "proto-oncogene", "oncogene", "celgene", "genmab", "alphamab", "numab")
# Sentence patterns for and against a drug.
CAUTIONARY = (
    r"resistan\w*\s+to\s+", r"\bresistant\b", r"cross-resistan\w*", r"limited efficacy", r"failed to improve", r"did not improve",
    r"lack of\s+\w*\s*efficacy", r"no improvement", r"acquired resistance",
)
SUPPORTIVE = (
    r"synerg\w*", r"combin\w*(?:\s+\w+){0,3}\s+with\b", r"combination of", r"enhanc\w+\s+cytotoxicity", r"potentiat\w*", r"promising",
)
# Class keywords, looked up as substrings; the first list wins.  The wide lists add a few families.
RTK_KEYWORDS = (
    "EGFR", "ERBB", "FGFR", "IGF1R", "MET", "PDGFR", "KIT", "FLT3", "ALK", "ROS1", "RET", "NTRK", "AXL", "MER", "TYRO3", "EPHA", "EPHB", "DDR",
)
NRTK_KEYWORDS = (
    "SRC", "JAK", "ABL", "FYN", "LYN", "YES", "FGR", "HCK", "LCK", "BLK", "FRK", "BRK", "TEC", "BTK", "ITK", "TXK", "SYK", "ZAP70", "CSK", "MATK",
)
WIDE_RTK_KEYWORDS = (*RTK_KEYWORDS, "INSR", "VEGFR", "TEK", "TIE", "RYK", "MUSK", "ROR")
WIDE_NRTK_KEYWORDS = (*NRTK_KEYWORDS, "PTK", "TNK", "ACK", "FAK")


def normalised_drug_name(name: str | Column) -> Column:
    """Lower case, trimmed, salt forms removed one after the other, with or without parentheses."""
    out = F.trim(F.lower(F.col(name) if isinstance(name, str) else name))
    for suffix in SALT_SUFFIXES:
        out = F.regexp_replace(out, rf"\s*\({suffix}\)$", "")
        out = F.regexp_replace(out, rf"\s+{suffix}$", "")
    return F.trim(out)


def is_junk_drug_name(name: str) -> Column:
    return F.trim(F.lower(F.col(name))).isin(*JUNK_PHRASES) | normalised_drug_name(name).isin(*JUNK_PHRASES)


def looks_like_drug(name: str, gene_names: Column | None = None) -> Column:
    """Ordered rules: empty or generic no, gene symbol no, known ending yes, citations and codes no, else yes."""
    n = F.trim(F.regexp_replace(F.trim(F.lower(F.col(name))), ",+$", ""))
    packed = F.regexp_replace(n, r"[-\s]", "")
    out = F.when((n == "") | n.isin(*GENERIC_WORDS), False)
    if gene_names is not None:
        out = out.when(F.array_contains(gene_names, n), False)
    return (
        out.when(n.rlike("(" + "|".join(NAME_ENDINGS) + ")$"), True)
        .when(n.rlike(r"\[pmid|\bet al\.|^compound\s"), False)
        .when(n.rlike(r"chembl[:\s]?\d"), False)
        .when(n.rlike(r"^\d+-[a-z]+$"), True)
        .when(packed.rlike("^[a-z0-9]+$") & packed.rlike("[a-z]") & packed.rlike("[0-9]"), False)
        .when(n.rlike(r"-in-\d+$|inhibitor \d+[a-z]?$"), False)
        .otherwise(True)
    )


def candidate_drugs(text: str, endings: tuple[str, ...] = TEXT_ENDINGS, stopwords: tuple[str, ...] = TEXT_STOPWORDS) -> Column:
    """Sorted distinct words of at least four characters with a drug-like ending and two or more characters before it."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\b([a-zA-Z][a-zA-Z0-9\-]{3,})\b"), 1)
    shaped = F.filter(words, lambda w: w.rlike("..(" + "|".join(endings) + ")$"))
    if stopwords:
        shaped = F.filter(shaped, lambda w: ~w.isin(*stopwords))
    return F.array_sort(F.array_distinct(shaped))


def mention_context(text: str, drug: str) -> Column:
    """cautionary, supportive or unclear, from the sentences that name the drug; a tie is cautionary."""
    sentences = F.filter(F.split(F.lower(F.col(text)), r"(?<=[.!?])\s+"), lambda s: F.contains(s, F.lower(F.col(drug))))

    def hits(patterns: tuple[str, ...]) -> Column:
        def count(s: Column) -> Column:
            return sum((s.rlike(p).cast("int") for p in patterns[1:]), s.rlike(patterns[0]).cast("int"))

        return F.aggregate(sentences, F.lit(0), lambda acc, s: acc + count(s))

    bad, good = hits(CAUTIONARY), hits(SUPPORTIVE)
    return F.when((bad == 0) & (good == 0), "unclear").when(good > bad, "supportive").otherwise("cautionary")


def numbered_entries(text: str) -> Column:
    """Entries of a numbered block, heading text before the first number dropped."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n\d+\.\s")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda e: F.trim(e))


def source_count(sources: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(sources), F.lit("")), ","), lambda s: F.trim(s) != ""))


def compound_symbol(compound: str) -> Column:
    """Second-last field of a bar-separated compound id, null when there are fewer than two."""
    parts = F.split(F.col(compound), r"\|")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def display_symbol(compound: str) -> Column:
    """Short label: field 7 up to a dash, or field 6 when that is all digits or longer than ten characters.

    An id with fewer than seven fields is shown by its first field, an id without bars by its first 15 characters.
    """
    parts = F.split(F.col(compound), r"\|")

    def bare(i: int) -> Column:
        return F.substring_index(F.get(parts, F.lit(i)), "-", 1)

    return (
        F.when((F.size(parts) >= 7) & (bare(6).rlike(r"^\d+$") | (F.length(bare(6)) > 10)), bare(5))
        .when(F.size(parts) >= 7, bare(6))
        .when(F.size(parts) > 1, F.get(parts, F.lit(0)))
        .otherwise(F.substring(F.col(compound), 1, 15))
    )


def kinase_class(symbol: str, wide: bool = True) -> Column:
    s = F.upper(F.col(symbol))
    rtk, nrtk = (WIDE_RTK_KEYWORDS, WIDE_NRTK_KEYWORDS) if wide else (RTK_KEYWORDS, NRTK_KEYWORDS)
    return F.when(s.rlike("|".join(rtk)), "RTK").when(s.rlike("|".join(nrtk)), "NRTK").otherwise("Other")


def pair_key(a: str, b: str) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "|")
