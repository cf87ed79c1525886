"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, embed_dedup, jaccard, packing, secrets, sharding, tokens, toxicity, url_filter, warc



def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_sharding": sharding.op3_sharding,
    "op4_embedding_dedup": embed_dedup.op4_embedding_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_warc_revisits": warc.op9_warc_revisits,
    "op10_decontamination": decontam.op10_decontamination,
    "pipeline": pipeline,
}
ORACLES = {"op2_url_filter": url_filter.ORACLE, "op4_embedding_dedup": embed_dedup.ORACLE, "op6_jaccard_join": jaccard.ORACLE, "op7_secret_scans": secrets.ORACLE, "op9_warc_revisits": warc.ORACLE}
