"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from lumenlex.llm import byte_bpe, dart_minhash, fuzzy_lines, ivf_pq, mixing, pii, stream_dedup, toxicity, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        url_filter.op1_url_filter,
        warc.op2_warc_captures,
        stream_dedup.op3_stream_exact_dedup,
        ivf_pq.op4_ivf_pq,
        pii.op5_personal_data,
        mixing.op6_mix_sources,
        fuzzy_lines.op7_fuzzy_lines,
        dart_minhash.op8_dart_minhash,
        byte_bpe.op9_byte_bpe,
        toxicity.op10_toxicity,
    )
}

ORACLES = {"op2_warc_captures": warc.OP2_SQL, "op3_stream_exact_dedup": stream_dedup.OP3_SQL, "op6_mix_sources": mixing.OP6_SQL}
