"""From raw files to prompts, and from answers to written references.

Two jobs with a caller's completion in between: the first ends in prompts, the
second starts at layer documents.  Tables that several later steps read are
written once; everything in them is far smaller than the file contents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitus.config import ScanConfig
from habitus.operators import evidence as ev
from habitus.operators import catalog, documents as docs
from habitus.operators import facts as fx
from habitus.operators import governance as gv
from habitus.operators import overview as ov
from habitus.operators import prompts, sampling, scanning
from habitus.operators import trace as tr
from habitus.operators import verify as vf
from habitus.operators.trace import KEY
from habitus.session import cut_lineage


@dataclass(frozen=True)
class Learned:
    """What the first job knows about every project; ``files`` are facts, without contents."""

    files: DataFrame
    project_types: DataFrame
    summary: DataFrame
    evidence: DataFrame
    fingerprints: DataFrame
    samples: DataFrame
    prompts: DataFrame


def prepare(
    files_raw: DataFrame, config: ScanConfig = ScanConfig(), previous: DataFrame | None = None
) -> Learned:
    """Scan, evidence, samples and prompts of all projects.

    Contents are read twice: for the facts of all files, and for the samples of
    the chosen ones.
    """
    known = fx.stored(fx.file_facts(files_raw, config))
    files = fx.write_facts(fx.scanned_facts(known, config))
    kinds = cut_lineage(fx.project_types(known))
    evidence = cut_lineage(ev.evidence_of_hits(fx.fact_hits(files), kinds))
    plan = cut_lineage(sampling.layer_file_plan(files))
    samples = sampling.layer_samples(plan, scanning.with_slashes(files_raw), files)
    asked = prompts.layer_prompts(
        samples,
        ev.evidence_prompt(evidence, kinds),
        previous=previous,
        language=config.output_language,
    )
    return Learned(
        files, kinds, scanning.project_summary(files), evidence,
        scanning.scan_fingerprint(files), samples, asked,
    )


@dataclass(frozen=True)
class Reference:
    """The tables of written references."""

    layer_docs: DataFrame
    rules: DataFrame
    templates: DataFrame
    manifest: DataFrame
    verify: DataFrame


def build_reference(
    answers: DataFrame, evidence: DataFrame, language: str = "zh",
    llm_validation: DataFrame | None = None,
) -> Reference:
    """Cleaned layer documents with trace, manifest and checks.

    ``answers`` is (skill, project_type, layer, content); ``evidence`` carries
    the same two keys.
    """
    governed = gv.govern(answers, evidence, language)
    stems = F.create_map(*[F.lit(x) for l, n in docs.LAYER_NAMES.items() for x in (l, f"{l}-{n}")])
    kept = cut_lineage(governed.withColumn("file_stem", F.try_element_at(stems, F.col("layer"))))
    rules = cut_lineage(tr.trace_rules(kept, evidence))
    templates = cut_lineage(tr.trace_templates(kept, evidence))
    return Reference(
        kept, rules, templates,
        vf.layer_manifest(kept, rules, templates),
        vf.verify(kept, rules, templates, llm_validation),
    )


def split_answers(whole: DataFrame) -> DataFrame:
    """(skill, project_type, layer, file_stem, content) of answers that hold all layers."""
    return whole.select(*KEY, F.inline(docs.split_layers(F.col("content"))))


def update_hints(previous_rules: DataFrame, files: DataFrame) -> DataFrame:
    """(project, policy): which earlier rules still have their files.

    ``previous_rules`` and ``files`` both carry (skill, project_type, project).
    """
    flags = vf.stale_rules(previous_rules, files)
    rows = previous_rules.join(flags, [*KEY, "id"]).select("project", "layer", "text", "stale")
    return prompts.update_policy(rows)


def catalog_rows(
    learned: Learned, skill: str, content: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Learned (entries, sources) of the catalog: an entry per project type of a skill.

    ``content`` is (project_type, content_hash).  Files and projects are rows of
    the sources; only the handful of languages of a type is joined into a text.
    """
    key = F.concat_ws("/", F.lit(skill), "project_type").alias("lock_key")
    per_file = learned.files.join(learned.project_types, "project").select(
        key, "project_type", "project", "language", F.concat_ws("/", "project", "path").alias("file")
    )
    sources = catalog.as_sources(per_file, "project", "project")
    for kind in ("file", "language"):
        sources = sources.unionByName(catalog.as_sources(per_file, kind, kind))
    entries = (
        per_file.groupBy("lock_key", "project_type")
        .agg(F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("language"))
        .join(content, "project_type", "left")
        .select(
            "lock_key", F.col("project_type").alias("name"), "language",
            F.concat(F.lit(f"{skill}/reference/"), "project_type", F.lit("/")).alias("skill_path"),
            "content_hash",
        )
    )
    return entries, sources


def reports(
    listed: DataFrame, reference: Reference, evidence: DataFrame
) -> dict[str, DataFrame]:
    """Type rows, checks and the entry page of all references; ``listed`` is the catalog with its lists."""
    surfaced = ov.surface(reference.layer_docs, reference.rules, reference.templates)
    stats = cut_lineage(ov.type_stats(listed, reference.layer_docs, surfaced, evidence))
    texts = ov.surfaced_texts(surfaced.type_rules, surfaced.hard_rules, surfaced.anti)
    cross = ov.cross_type_patterns(texts)
    return {
        "type_stats": stats,
        "quality": ov.quality_checks(ov.totals(stats, listed), cross),
        "overview": ov.master_overview(listed, reference.layer_docs, surfaced, stats),
    }

