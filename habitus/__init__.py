"""Convention mining over code corpora on Spark."""

from habitus.config import ScanConfig
from habitus.operators.catalog import list_skills, skill_status, upsert_catalog
from habitus.operators.evidence import collect_evidence, evidence_prompt
from habitus.operators.overview import master_overview, quality_checks
from habitus.operators.rules import register_rule
from habitus.operators.sampling import code_sample
from habitus.operators.scanning import scan_files
from habitus.operators.trace import trace_rules, trace_templates
from habitus.operators.verify import inspect, layer_manifest, trace_diff, verify
from habitus.session import build_session

__all__ = [
    "ScanConfig", "build_session", "code_sample", "collect_evidence", "evidence_prompt", "inspect",
    "layer_manifest", "list_skills", "master_overview", "quality_checks", "register_rule",
    "scan_files", "skill_status", "trace_diff", "trace_rules", "trace_templates", "upsert_catalog",
    "verify",
]
