"""The queries of this subpackage and, where SQL can express them, their SQL. The entry module adds the pipeline over them."""

from __future__ import annotations

from . import topk
from .lattice import op4_gumbel_pieces
from .minhash import op3_minhash
from .packing import op2_packing
from .paragraphs import op6_paragraphs
from .secrets import op9_secret_scan
from .simhash import op1_simhash
from .suffixes import op5_suffix_array
from .topk import op8_exact_top_k
from .toxicity import op10_toxicity
from .warc import op7_warc


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_packing": op2_packing,
        "op3_minhash": op3_minhash,
        "op4_gumbel_pieces": op4_gumbel_pieces,
        "op5_suffix_array": op5_suffix_array,
        "op6_paragraphs": op6_paragraphs,
        "op7_warc": op7_warc,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_secret_scan": op9_secret_scan,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_top_k": topk.SQL}
