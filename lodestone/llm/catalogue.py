"""Name -> query and name -> DuckDB SQL of the subpackage."""

from __future__ import annotations

from lodestone.llm import queries as q

QUERIES = {
    f.__name__: f
    for f in (
        q.op1_quality_rules,
        q.op2_toxicity,
        q.op3_bpe,
        q.op4_warc,
        q.op5_token_counts,
        q.op6_line_crf,
        q.op7_ngram_join,
        q.op8_packing,
        q.op9_url_filters,
        q.op10_vector_dedup,
        q.op11_importance,
        q.op12_sort_means,
        q.op13_mixing,
    )
}

#: The other operators learn, tokenize or pack, which SQL can't express: tests hold
#: them against brute force, the tokenizers library, round trips and held-out labels.
ORACLES = {"op4_warc": q.OP4_SQL, "op7_ngram_join": q.OP7_SQL, "op9_url_filters": q.OP9_SQL, "op10_vector_dedup": q.OP10_SQL, "op11_importance": q.OP11_SQL, "op12_sort_means": q.OP12_SQL}
