"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, lm, minhash, mixing, packing, quality, secrets, sharding, tokens, webp
from .common import read_table, spread
from .oracle import ORACLES


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spread(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": _documents(lambda d: minhash.near_duplicates(d, width=3, num=85, den=100)),
    "op2_lossless_webp": _documents(webp.media_digest),
    "op3_mix_sources": _documents(mixing.mix),
    "op4_license_scan": _documents(licenses.license_scan),
    "op5_reshard": _documents(sharding.resharded_files),
    "op6_count_tokens": _documents(tokens.count_tokens),
    "op7_quality_rules": _documents(quality.quality),
    "op8_best_fit_packing": _documents(packing.pack),
    "op9_lattice_score": _documents(lm.score),
    "op10_secret_scan": _documents(secrets.find_secrets),
}

SQL: dict[str, str] = ORACLES
