"""The corpus operators' queries, one for each operator, and the SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_bpe
from .divergence import OP13_SQL, op13_divergence
from .language_model import op11_lm_score
from .licenses import op8_licenses
from .mixing import OP6_SQL, op6_mixing
from .neighbours import op2_neighbours
from .packing import op4_packing
from .paragraphs import op9_paragraphs
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op7_quality
from .secrets import op3_secrets
from .simhash import op10_simhash
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_neighbours": op2_neighbours,
    "op3_secrets": op3_secrets,
    "op4_packing": op4_packing,
    "op5_bpe": op5_bpe,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_paragraphs": op9_paragraphs,
    "op10_simhash": op10_simhash,
    "op11_lm_score": op11_lm_score,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {"op6_mixing": OP6_SQL, "op12_prefix_trie": OP12_SQL, "op13_divergence": OP13_SQL}
