"""The queries of this folder and their SQL, for __spark_entry__.py."""

from functools import wraps

from ..plans.workers import on_workers
from . import bpe, jaccard, langid, mixing, quality, sharding, substrings, suffixes, topk, toxicity


def query(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        on_workers(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: query(f)
    for f in (
        topk.op1_topk,
        sharding.op2_sharding,
        substrings.op3_substrings,
        toxicity.op4_toxicity,
        bpe.op5_bpe,
        quality.op6_quality,
        langid.op7_langid,
        suffixes.op8_suffixes,
        mixing.op9_mixing,
        jaccard.op10_jaccard,
    )
}

ORACLES = {
    "op1_topk": topk.ORACLE,
    "op2_sharding": sharding.ORACLE,
    "op3_substrings": substrings.ORACLE,
    "op8_suffixes": suffixes.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_jaccard": jaccard.ORACLE,
}
