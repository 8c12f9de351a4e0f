"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from .conversations import op13_conversation_repair
from .decontamination import op4_decontamination
from .language_id import op3_language_id
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import OP2_SQL, op2_mixing
from .nearest import OP7_SQL, op7_nearest
from .ngram_join import op12_ngram_join
from .periodic_runs import op11_periodic_runs
from .quality import op10_quality
from .simhash import op9_simhash
from .substring_dedup import op5_substring_dedup
from .suffix_dedup import op8_suffix_dedup
from .url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_nearest": op7_nearest,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ngram_join": op12_ngram_join,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op6_url_filter": OP6_SQL, "op7_nearest": OP7_SQL}
