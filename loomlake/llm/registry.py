"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from .decontam import op10_template_decontam
from .divergence import OP12_SQL, op12_source_divergence
from .minhash import op3_super_minhash
from .mixing import op1_mix_sources
from .pieces import op11_sentence_pieces
from .quality import op5_weak_supervision
from .runs import op13_lyndon_runs
from .sharding import op8_bin_packing
from .substring_dedup import op7_suffix_automata
from .suffix_dedup import op4_suffix_array
from .token_counts import op9_trie_unigram
from .toxicity import op6_ordinal_toxicity
from .urlfilter import OP2_SQL, op2_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_url_filter,
        op3_super_minhash,
        op4_suffix_array,
        op5_weak_supervision,
        op6_ordinal_toxicity,
        op7_suffix_automata,
        op8_bin_packing,
        op9_trie_unigram,
        op10_template_decontam,
        op11_sentence_pieces,
        op12_source_divergence,
        op13_lyndon_runs,
    )
}
ORACLES: dict[str, str] = {"op2_url_filter": OP2_SQL, "op12_source_divergence": OP12_SQL}
