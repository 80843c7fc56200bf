from .catalogue import BUILTIN, CONFIDENCE_RANK, Rule
from .custom import build_rules, rules_from_records
from .table import assert_unique, rules_df, select_rules

__all__ = ["BUILTIN", "CONFIDENCE_RANK", "Rule", "assert_unique", "build_rules",
           "rules_df", "rules_from_records", "select_rules"]
