"""Queries of this subpackage by name, and their SQL."""

from .embeddings import op8_embeddings
from .fill_in_middle import OP12_SQL, op12_fill_in_middle
from .fingerprints import op1_fingerprints
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language_model import op5_language_model
from .mixing import OP10_SQL, op10_mixing
from .packing import op2_packing
from .passages import op9_passages
from .simhash import op7_simhash
from .token_counts import op13_token_counts
from .toxicity import op4_toxicity
from .url_filters import OP3_SQL, op3_url_filters
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_url_filters": op3_url_filters,
    "op4_toxicity": op4_toxicity,
    "op5_language_model": op5_language_model,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_embeddings": op8_embeddings,
    "op9_passages": op9_passages,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_token_counts": op13_token_counts,
}
SQL = {"op3_url_filters": OP3_SQL, "op6_warc": OP6_SQL, "op10_mixing": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
