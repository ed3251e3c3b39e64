"""Curated knowledge tables of the regimen search, as DataFrames, from the published tables in their shape and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Gene and its pathways, in published order; the first pathway of a gene counts as its own.
GENE_PATHWAYS = """
EGFR: MAPK/ERK, PI3K/AKT
ERBB2: MAPK/ERK, PI3K/AKT
MET: MAPK/ERK, PI3K/AKT
SRC: MAPK/ERK
ABL1: MAPK/ERK
FGFR1: MAPK/ERK, PI3K/AKT
FGFR2: MAPK/ERK, PI3K/AKT
FGFR3: MAPK/ERK, PI3K/AKT
ALK: MAPK/ERK, PI3K/AKT
KIT: MAPK/ERK, PI3K/AKT
PDGFRA: MAPK/ERK, PI3K/AKT
BRAF: MAPK/ERK
PIK3CA: PI3K/AKT
AKT1: PI3K/AKT
MTOR: PI3K/AKT
JAK2: JAK/STAT
BRCA1: DNA Damage Repair
BRCA2: DNA Damage Repair
CDK4: Cell Cycle
CDK6: Cell Cycle
TP53: Cell Cycle Checkpoint
RB1: Cell Cycle
MYC: MYC/Transcriptional
PTEN: PI3K/AKT
AR: Androgen Signalling
ERBB3: MAPK/ERK
ERBB4: MAPK/ERK
INSR: PI3K/AKT
IGF1R: PI3K/AKT
INSRR: PI3K/AKT
PDGFRB: MAPK/ERK
CSF1R: MAPK/ERK
FLT1: MAPK/ERK
KDR: MAPK/ERK
FLT4: MAPK/ERK
FGFR4: MAPK/ERK
PTK7: MAPK/ERK
NTRK1: MAPK/ERK
NTRK2: MAPK/ERK
NTRK3: MAPK/ERK
ROR1: MAPK/ERK
ROR2: MAPK/ERK
MUSK: MAPK/ERK
MST1R: MAPK/ERK
AXL: PI3K/AKT
MERTK: PI3K/AKT
TYRO3: PI3K/AKT
TEK: PI3K/AKT
TIE1: PI3K/AKT
EPHA1: MAPK/ERK
EPHA2: MAPK/ERK
EPHA3: MAPK/ERK
EPHA4: MAPK/ERK
EPHA5: MAPK/ERK
EPHA6: MAPK/ERK
EPHA7: MAPK/ERK
EPHA8: MAPK/ERK
EPHA10: MAPK/ERK
EPHB1: MAPK/ERK
EPHB2: MAPK/ERK
EPHB3: MAPK/ERK
EPHB4: MAPK/ERK
EPHB6: MAPK/ERK
RET: MAPK/ERK
ROS1: MAPK/ERK
LTK: MAPK/ERK
AATK: MAPK/ERK
LMTK2: MAPK/ERK
LMTK3: MAPK/ERK
DDR1: MAPK/ERK
DDR2: MAPK/ERK
RYK: MAPK/ERK
STYK1: MAPK/ERK
ABL2: MAPK/ERK
TNK2: MAPK/ERK
TNK1: MAPK/ERK
CSK: MAPK/ERK
MATK: MAPK/ERK
PTK2: PI3K/AKT
PTK2B: PI3K/AKT
FES: MAPK/ERK
FER: MAPK/ERK
FRK: MAPK/ERK
PTK6: MAPK/ERK
SRMS: MAPK/ERK
JAK1: JAK/STAT
JAK3: JAK/STAT
TYK2: JAK/STAT
FYN: MAPK/ERK
YES1: MAPK/ERK
FGR: MAPK/ERK
LCK: MAPK/ERK
HCK: MAPK/ERK
BLK: MAPK/ERK
LYN: MAPK/ERK
SYK: BCR/Immune Signalling
ZAP70: BCR/Immune Signalling
TEC: BCR/Immune Signalling
BTK: BCR/Immune Signalling
ITK: BCR/Immune Signalling
BMX: BCR/Immune Signalling
TXK: BCR/Immune Signalling
"""
# Gene and its drugs, in published order; the first gene owns a shared drug.
GENE_DRUGS = """
EGFR: erlotinib, gefitinib, afatinib
ERBB2: lapatinib, neratinib, trastuzumab
MET: crizotinib, capmatinib
SRC: dasatinib, bosutinib
ABL1: imatinib, dasatinib, nilotinib
FGFR1: erdafitinib, pemigatinib
FGFR2: erdafitinib, pemigatinib
FGFR3: erdafitinib, pemigatinib
ALK: alectinib, crizotinib
KIT: imatinib, sunitinib
PDGFRA: imatinib, sunitinib
BRAF: vemurafenib, dabrafenib
PIK3CA: alpelisib
AKT1: capivasertib
MTOR: everolimus, temsirolimus
JAK2: ruxolitinib
BRCA1: olaparib, talazoparib
BRCA2: olaparib, talazoparib
CDK4: palbociclib, ribociclib
CDK6: palbociclib, ribociclib
TP53: adavosertib
RB1:
MYC: molibresib
PTEN: capivasertib, alpelisib
AR: enzalutamide, bicalutamide
INSR: linsitinib
IGF1R: linsitinib
FLT3: midostaurin, gilteritinib
FLT1: sunitinib, sorafenib, pazopanib, axitinib
KDR: sunitinib, sorafenib, pazopanib, axitinib, lenvatinib
FLT4: axitinib, pazopanib
CSF1R: pexidartinib
NTRK1: larotrectinib, entrectinib
NTRK2: larotrectinib, entrectinib
NTRK3: larotrectinib, entrectinib
RET: selpercatinib, pralsetinib
ROS1: crizotinib, entrectinib
DDR1: nilotinib
DDR2: dasatinib
ABL2: imatinib, nilotinib
JAK1: ruxolitinib, baricitinib
JAK3: tofacitinib
TYK2: deucravacitinib
BTK: ibrutinib, acalabrutinib, zanubrutinib
SYK: fostamatinib
"""
# Drug and its toxicity flags that are set, in published order.
DRUG_TOXICITY = """
erlotinib: hepatotoxic
afatinib:
crizotinib: hepatotoxic, qt_prolonging
alpelisib: hepatotoxic, hyperglycemic
olaparib: myelosuppressive
talazoparib: myelosuppressive
capivasertib: hepatotoxic, hyperglycemic
dasatinib: cardiotoxic, qt_prolonging, myelosuppressive
everolimus: hepatotoxic, hyperglycemic, myelosuppressive
palbociclib: hepatotoxic, qt_prolonging, myelosuppressive
adavosertib: myelosuppressive
molibresib: myelosuppressive
enzalutamide: hepatotoxic
bicalutamide: hepatotoxic
eprenetapopt: myelosuppressive
gefitinib: hepatotoxic
lapatinib: hepatotoxic, cardiotoxic, qt_prolonging
neratinib: hepatotoxic
trastuzumab: cardiotoxic
sunitinib: hepatotoxic, cardiotoxic, qt_prolonging, myelosuppressive
sorafenib: hepatotoxic, cardiotoxic
pazopanib: hepatotoxic, cardiotoxic, qt_prolonging
axitinib: cardiotoxic
lenvatinib: hepatotoxic, cardiotoxic, qt_prolonging
imatinib: hepatotoxic, myelosuppressive
nilotinib: hepatotoxic, cardiotoxic, qt_prolonging, hyperglycemic, myelosuppressive
bosutinib: hepatotoxic, myelosuppressive
dabrafenib: hepatotoxic
vemurafenib: hepatotoxic, qt_prolonging
alectinib: hepatotoxic, myelosuppressive
entrectinib: hepatotoxic, qt_prolonging, hyperglycemic
capmatinib: hepatotoxic
erdafitinib: hepatotoxic, hyperglycemic
pemigatinib: hepatotoxic, hyperglycemic, myelosuppressive
ribociclib: hepatotoxic, qt_prolonging, myelosuppressive
temsirolimus: hepatotoxic, hyperglycemic, myelosuppressive
ruxolitinib: myelosuppressive
baricitinib: myelosuppressive
tofacitinib: cardiotoxic, myelosuppressive
deucravacitinib:
linsitinib: hyperglycemic
midostaurin: hepatotoxic, qt_prolonging, myelosuppressive
gilteritinib: hepatotoxic, qt_prolonging, myelosuppressive
larotrectinib: hepatotoxic
selpercatinib: hepatotoxic, qt_prolonging
pralsetinib: hepatotoxic, cardiotoxic, qt_prolonging, myelosuppressive
pexidartinib: hepatotoxic
ibrutinib: cardiotoxic, myelosuppressive
acalabrutinib: cardiotoxic, myelosuppressive
zanubrutinib: cardiotoxic, myelosuppressive
fostamatinib: hepatotoxic, cardiotoxic, myelosuppressive
venetoclax: myelosuppressive
"""
# Pairs with published synergy.
KNOWN_SYNERGY = [("erlotinib", "crizotinib", 0.25), ("olaparib", "alpelisib", 0.30), ("palbociclib", "alpelisib", 0.20), ("dasatinib", "everolimus", 0.15)]
# Receptor and intracellular genes of the complementarity rule.
RECEPTORS = ["EGFR", "ERBB2", "MET", "FGFR1", "FGFR2", "FGFR3", "ALK", "KIT", "PDGFRA"]
INTRACELLULAR = ["SRC", "ABL1", "BRAF", "PIK3CA", "AKT1", "MTOR", "JAK2", "CDK4", "CDK6"]
# Drugs of the one gene whose drugs depend on the alteration class.
CLASS_DRUGS = [("TP53", "mutant", ["adavosertib", "eprenetapopt"]), ("TP53", "deleted", ["adavosertib", "venetoclax"])]


def _rows(text: str) -> list[tuple[str, str, int, int]]:
    """(key, value, place of the key, place of the value) of ``key: value, value`` lines."""
    out = []
    for i, line in enumerate(text.strip().split("\n")):
        key, _, values = line.partition(":")
        out += [(key, v.strip(), i, j) for j, v in enumerate(values.split(",")) if v.strip()]
    return out


def knowledge_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """gene_drugs, gene_pathways, drug_toxicity, known_synergy, gene_class, class_drugs.

    ``ord`` is a value's place in its list; ``gene_ord`` is the list position of the gene, for the first-gene rule.
    """
    return {
        "gene_drugs": spark.createDataFrame(_rows(GENE_DRUGS), "gene string, drug string, gene_ord int, ord int"),
        "gene_pathways": spark.createDataFrame(_rows(GENE_PATHWAYS), "gene string, pathway string, gene_ord int, ord int").select("gene", "pathway", "ord"),
        "drug_toxicity": spark.createDataFrame(_rows(DRUG_TOXICITY), "drug string, category string, drug_ord int, ord int").select("drug", "category"),
        "known_synergy": spark.createDataFrame(KNOWN_SYNERGY, "drug_a string, drug_b string, boost double"),
        "gene_class": spark.createDataFrame([(g, "RTK") for g in RECEPTORS] + [(g, "INTRA") for g in INTRACELLULAR], "gene string, gene_class string"),
        "class_drugs": spark.createDataFrame([(g, c, d) for g, c, drugs in CLASS_DRUGS for d in drugs], "gene string, class string, drug string"),
    }
