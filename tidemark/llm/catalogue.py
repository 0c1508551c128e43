"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tidemark.llm.bpe import op6_bpe_codec
from tidemark.llm.divergence import OP13_SQL, op13_source_divergence
from tidemark.llm.embedding_dedup import OP1_SQL, op1_embedding_near_dedup
from tidemark.llm.filter_audit import OP12_SQL, op12_filter_audit
from tidemark.llm.licenses import OP4_SQL, op4_license_scan
from tidemark.llm.mixing import op8_mix_sources
from tidemark.llm.ngram_join import OP10_SQL, op10_ngram_jaccard
from tidemark.llm.perplexity import op11_quality_rules
from tidemark.llm.quality import op3_quality_classifier
from tidemark.llm.sharding import op2_sharding
from tidemark.llm.token_files import op5_token_files
from tidemark.llm.vector_search import OP9_SQL, op9_maxscore_topk
from tidemark.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_sharding": op2_sharding,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_license_scan": op4_license_scan,
    "op5_token_files": op5_token_files,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_warc": op7_warc,
    "op8_mix_sources": op8_mix_sources,
    "op9_maxscore_topk": op9_maxscore_topk,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_quality_rules": op11_quality_rules,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": OP1_SQL,
    "op4_license_scan": OP4_SQL,
    "op7_warc": OP7_SQL,
    "op9_maxscore_topk": OP9_SQL,
    "op10_ngram_jaccard": OP10_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
