"""The queries of this subpackage and, where SQL can express one, their DuckDB text."""

from __future__ import annotations

from .decontaminate import op9_latent_decontamination
from .languages import op11_language_mixture
from .licenses import op5_license_minhash
from .minhash import op6_circulant_minhash
from .mixing import OP10_SQL, op10_curriculum_mix
from .pii import op8_surrogates
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op3_quality_trees
from .secrets import op2_secret_automaton
from .sharding import op1_histogram_shards
from .spelling import op12_spelling_gram
from .suffix_dedup import op7_prefix_doubling
from .token_output import op4_arrow_sequences

#: name: (query, DuckDB SQL or None)
REGISTRY = {
    "op1_histogram_shards": (op1_histogram_shards, None),
    "op2_secret_automaton": (op2_secret_automaton, None),
    "op3_quality_trees": (op3_quality_trees, None),
    "op4_arrow_sequences": (op4_arrow_sequences, None),
    "op5_license_minhash": (op5_license_minhash, None),
    "op6_circulant_minhash": (op6_circulant_minhash, None),
    "op7_prefix_doubling": (op7_prefix_doubling, None),
    "op8_surrogates": (op8_surrogates, None),
    "op9_latent_decontamination": (op9_latent_decontamination, None),
    "op10_curriculum_mix": (op10_curriculum_mix, OP10_SQL),
    "op11_language_mixture": (op11_language_mixture, None),
    "op12_spelling_gram": (op12_spelling_gram, None),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
}
