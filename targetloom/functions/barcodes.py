"""Sample barcodes: participant id, sample type, MAF class lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Eligible variant classes.  The funnel and the regimen run use different lists on purpose.
FUNNEL_CLASSES = (
    "Missense_Mutation", "Nonsense_Mutation", "Frame_Shift_Del", "Frame_Shift_Ins", "Splice_Site",
    "In_Frame_Del", "In_Frame_Ins", "Nonstop_Mutation", "Translation_Start_Site",
)
PROTEIN_ALTERING = (
    "Missense_Mutation", "Nonsense_Mutation", "Frame_Shift_Del", "Frame_Shift_Ins", "Splice_Site", "Splice_Region",
    "In_Frame_Del", "In_Frame_Ins", "Nonstop_Mutation",
)


def participant_id(barcode: str) -> Column:
    return F.substring(F.col(barcode), 1, 12)


def is_primary_tumour(barcode: str) -> Column:
    """Fourth dash field starts with 01; fewer than four fields is not a tumour sample."""
    return F.coalesce(F.get(F.split(F.col(barcode), "-"), F.lit(3)), F.lit("")).startswith("01")
