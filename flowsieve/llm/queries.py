"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowsieve.llm.archives import ORACLE as ARCHIVES_SQL
from flowsieve.llm.archives import op9_archives
from flowsieve.llm.benchmark import op6_benchmark
from flowsieve.llm.collocations import ORACLE as COLLOCATIONS_SQL
from flowsieve.llm.collocations import op11_collocations
from flowsieve.llm.divergence import ORACLE as DIVERGENCE_SQL
from flowsieve.llm.divergence import op13_divergence
from flowsieve.llm.language import op2_language
from flowsieve.llm.licenses import op10_licenses
from flowsieve.llm.packing import op7_packing
from flowsieve.llm.pieces import op12_pieces
from flowsieve.llm.quality import ORACLE as QUALITY_SQL
from flowsieve.llm.quality import op1_quality_rules
from flowsieve.llm.repair import op3_token_shards
from flowsieve.llm.simhash import op5_simhash
from flowsieve.llm.substrings import ORACLE as SUBSTRINGS_SQL
from flowsieve.llm.substrings import op4_substrings
from flowsieve.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_language,
        op3_token_shards,
        op4_substrings,
        op5_simhash,
        op6_benchmark,
        op7_packing,
        op8_toxicity,
        op9_archives,
        op10_licenses,
        op11_collocations,
        op12_pieces,
        op13_divergence,
    )
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": QUALITY_SQL,
    "op4_substrings": SUBSTRINGS_SQL,
    "op9_archives": ARCHIVES_SQL,
    "op11_collocations": COLLOCATIONS_SQL,
    "op13_divergence": DIVERGENCE_SQL,
}
