"""What the operators of this subpackage share: tables in, settled tables out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import discarded, settled, shared_dir
from .words import WORD

__all__ = ["discarded", "n_words", "settled", "shared_dir"]


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
