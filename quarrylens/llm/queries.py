"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from quarrylens.llm.chat import OP7_SQL, op7_chat
from quarrylens.llm.decontaminate import op1_decontaminate
from quarrylens.llm.extract import op11_extract
from quarrylens.llm.langid import op3_langid
from quarrylens.llm.mixing import op4_mixing
from quarrylens.llm.pii import op9_pii
from quarrylens.llm.quality import op8_quality
from quarrylens.llm.runs import op12_runs
from quarrylens.llm.simhash import op2_simhash
from quarrylens.llm.substrings import op5_substrings
from quarrylens.llm.topk import OP10_SQL, op10_topk
from quarrylens.llm.warc import OP6_SQL, op6_warc

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_simhash, op3_langid, op4_mixing, op5_substrings, op6_warc, op7_chat, op8_quality, op9_pii, op10_topk, op11_extract, op12_runs)}
ORACLE_SQL: dict[str, str] = {"op6_warc": OP6_SQL, "op7_chat": OP7_SQL, "op10_topk": OP10_SQL}
