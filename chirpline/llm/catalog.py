"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from chirpline.llm.alignment import op13_alignment
from chirpline.llm.decontaminate import op2_decontaminate
from chirpline.llm.licenses import op9_licenses
from chirpline.llm.linededup import op3_line_dedup
from chirpline.llm.ngramjoin import op4_ngram_join
from chirpline.llm.oracle import ORACLE  # noqa: F401
from chirpline.llm.pack import op1_pack
from chirpline.llm.pii import op8_pii
from chirpline.llm.quality import op10_quality
from chirpline.llm.sentencepieces import op12_sentencepiece
from chirpline.llm.substrings import op7_substring_dedup
from chirpline.llm.tokencount import op6_token_counts
from chirpline.llm.variants import op11_variants
from chirpline.llm.vectors import op5_vectors

QUERIES = {
    "op1_pack": op1_pack,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_vectors": op5_vectors,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_pii": op8_pii,
    "op9_licenses": op9_licenses,
    "op10_quality": op10_quality,
    "op11_variants": op11_variants,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_alignment": op13_alignment,
}
