"""All registered queries of the text operators."""

from marketpanel.llm import bpe, conversations, decontaminate, lang_id, licenses, lm_score, near_dup, pii, quality_rules, shards, toxicity, url_filter, vector_codes  # noqa: F401
from marketpanel.llm.common import ORACLES, QUERIES  # noqa: F401
