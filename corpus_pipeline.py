"""From raw documents to token ids: quality, near duplicates, benchmark passages, personal data, BPE.

The stages themselves are in ``estatelens.llm.stages``.  Each reads what its predecessor kept, is written as Parquet in the shared folder and read back as
the next one's input, so a lost executor costs part of one stage.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from estatelens.llm.common import settle
from estatelens.llm.stages import STAGES, run

#: Training and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run", "settle"]
