"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP8_SQL, op8_chat
from .collocations import OP12_SQL, op12_collocations
from .decontaminate import OP6_SQL, op6_decontaminate
from .jaccard import OP9_SQL, op9_jaccard
from .packing import op7_packing
from .pii import op1_pii
from .quality import op4_quality
from .resample import OP11_SQL, op11_resample
from .secret_scan import op3_secrets
from .simhash import op13_simhash
from .substrings import OP10_SQL, op10_substrings
from .toxicity import op5_toxicity
from .urls import OP2_SQL, op2_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_urls": op2_urls,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_packing": op7_packing,
    "op8_chat": op8_chat,
    "op9_jaccard": op9_jaccard,
    "op10_substrings": op10_substrings,
    "op11_resample": op11_resample,
    "op12_collocations": op12_collocations,
    "op13_simhash": op13_simhash,
}
ORACLES: dict[str, str] = {
    "op2_urls": OP2_SQL,
    "op6_decontaminate": OP6_SQL,
    "op8_chat": OP8_SQL,
    "op9_jaccard": OP9_SQL,
    "op10_substrings": OP10_SQL,
    "op11_resample": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
