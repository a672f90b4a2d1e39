"""Registered queries of the training-data operators, and SQL for those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe
from .bytebpe import op13_bytebpe
from .chat import op4_chat
from .langid import op3_language
from .licenses import op5_licenses
from .quality import op1_quality
from .rabitq import op10_vectors
from .secrets import SECRET_VERSIONS_SQL, op8_secrets, secret_versions
from .simhash import op9_simhash
from .spans import op6_spans
from .turntrie import op11_turntrie
from .variants import op12_variants
from .winnow import op7_winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality, op2_bpe, op3_language, op4_chat, op5_licenses, op6_spans, op7_winnow, op8_secrets, op9_simhash, op10_vectors,
    op11_turntrie, op12_variants, op13_bytebpe, secret_versions)}
ORACLES: dict[str, str] = {"secret_versions": SECRET_VERSIONS_SQL}


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    return dict(QUERIES), dict(ORACLES)
