"""Find, triage, mask, restore and score credentials in tables and streams of text."""

from .options import ScanOptions
from .operators.baseline import build_baseline, new_findings, with_baseline
from .operators.fixplan import plan_fixes
from .operators.lock import lock_files, unlock_files
from .operators.policy import decide_prompts, decide_tools, guard_inbound, guard_outbound
from .operators.redact import redact_df, rehydrate_df
from .operators.scan import blocking, findings_table, scan_df, self_test
from .operators.vault import empty_vault, key_frame, load_vault, new_key, refreshed, save_vault
from .rules import BUILTIN, Rule, build_rules, rules_df

__all__ = ["BUILTIN", "Rule", "ScanOptions", "blocking", "build_baseline", "build_rules", "decide_prompts", "decide_tools",
           "empty_vault", "findings_table", "guard_inbound", "guard_outbound", "key_frame", "load_vault", "lock_files",
           "new_findings", "new_key", "plan_fixes", "redact_df", "refreshed", "rehydrate_df", "rules_df", "save_vault",
           "scan_df", "self_test", "unlock_files", "with_baseline"]
