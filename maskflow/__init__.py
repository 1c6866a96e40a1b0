"""Mask personal data in tables, generate synthetic tables and redact text on Spark."""

from maskflow.plans.generate import generate_table
from maskflow.plans.jobs import generate_file, mask_file
from maskflow.plans.mask import mask_table
from maskflow.plans.spec import check_config
from maskflow.plans.suggest import suggest_config
from maskflow.operators.redact import redact_table, redact_text
from maskflow.sources.lookups import Lookups

__all__ = [
    "Lookups",
    "check_config",
    "generate_file",
    "generate_table",
    "mask_file",
    "mask_table",
    "redact_table",
    "redact_text",
    "suggest_config",
]
