"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from lattica.llm.additive_search import op4_additive_search
from lattica.llm.byte_bpe import op8_byte_bpe
from lattica.llm.edit_counts import op5_edit_counts
from lattica.llm.exact_search import OP1_SQL, op1_exact_top_k
from lattica.llm.jaccard_join import OP2_SQL, op2_jaccard_join
from lattica.llm.lm_scoring import op7_lm_scoring
from lattica.llm.mixing import op6_mix
from lattica.llm.quality_crf import op9_quality_crf
from lattica.llm.token_files import op3_token_files
from lattica.llm.warc import OP10_SQL, op10_warc

QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_jaccard_join, op3_token_files, op4_additive_search, op5_edit_counts, op6_mix, op7_lm_scoring, op8_byte_bpe, op9_quality_crf, op10_warc)}
ORACLE_SQL: dict[str, str] = {"op1_exact_top_k": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op10_warc": OP10_SQL}
