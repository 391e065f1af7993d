"""Projections over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from habitus.functions import patterns as rx

# Fixed value: directories whose files are not production code.
NON_PRODUCTION_DIR = r"(^|\/)(test|tests|__tests__|fixtures?|mocks?)\/"

LAYERS = ("L1", "L2", "L3", "L4", "L5", "L6", "L7", "L8")

# Path pattern, then the weight it adds for the layers named and
# the weight it adds for every other layer.
LAYER_PATH_WEIGHTS: list[tuple[str, dict[str, int], int]] = [
    (
        r"package\.json|tsconfig|vite\.config|webpack|rollup|pom\.xml|build\.gradle|go\.mod|cargo\.toml",
        {"L1": 8, "L8": 8},
        2,
    ),
    (
        r"(^|\/)(main|app|bootstrap|index)\.(ts|tsx|js|jsx|vue|java|go|rs)$",
        {"L1": 8, "L8": 8},
        3,
    ),
    (r"(^|\/)(router|routes|pages|views|components)\/", {"L1": 6, "L4": 3}, 1),
    (
        r"(^|\/)(api|apis|controller|controllers|service|services|facade|client|request)\/",
        {"L2": 8, "L4": 3},
        1,
    ),
    (
        r"(type|types|interface|interfaces|dto|vo|do|entity|model|models|schema|enum)",
        {"L3": 8, "L2": 3},
        1,
    ),
    (
        r"(utils?|hooks?|composables?|middleware|interceptor|handler|factory|manager)",
        {"L4": 6, "L7": 6},
        1,
    ),
    (
        r"(store|stores|pinia|redux|zustand|repository|repositories|mapper|dao|database|db|cache|redis)",
        {"L5": 8},
        1,
    ),
    (
        r"(test|tests|__tests__|spec|mock|mocks|vitest|jest|playwright|cypress)",
        {"L6": 8},
        1,
    ),
    (
        r"(\.env|application-|bootstrap|security|auth|permission|guard|config|configs|logger|logging)",
        {"L7": 7, "L8": 7},
        1,
    ),
]
IMPORTANT_SCORE = 8


def is_production_file(path: Column) -> Column:
    return ~rx.test(path, NON_PRODUCTION_DIR, "i")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name, with the dot; else ''."""
    name = basename(path)
    return F.when(
        F.contains(name, F.lit(".")),
        F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1))),
    ).otherwise(F.lit(""))


def layer_scores(path: Column) -> Column:
    """Array of struct(layer, score) for all eight layers.

    The nine path patterns are evaluated once per file in an inner array; the
    eight sums only read those booleans.
    """
    lowered = F.lower(path)
    hits = F.array(*[rx.test(lowered, p) for p, _, _ in LAYER_PATH_WEIGHTS])

    def scores(hit: Column) -> Column:
        rows = []
        for layer in LAYERS:
            total = F.lit(0)
            for position, (_, named, other) in enumerate(LAYER_PATH_WEIGHTS):
                weight = named.get(layer, other)
                total = total + F.when(F.get(hit, F.lit(position)), weight).otherwise(0)
            rows.append(F.struct(F.lit(layer).alias("layer"), total.alias("score")))
        return F.array(*rows)

    return F.get(F.transform(F.array(hits), scores), F.lit(0))


def skill_path_parts(skill_path: Column, language: Column) -> Column:
    """struct(skill, project_type, overview_type) of ``<skill>/reference/<type>/``.

    ``project_type`` falls back to the language, ``overview_type`` to 'unknown'.
    """
    raw = F.split(skill_path, "/")
    at = F.array_position(raw, "reference")
    after = F.get(raw, at.cast("int"))
    kept = F.filter(raw, lambda part: part != "")
    kept_at = F.array_position(kept, "reference")
    kept_after = F.get(kept, kept_at.cast("int"))
    return F.struct(
        F.when(at > 1, F.get(raw, (at - 2).cast("int")))
        .otherwise(F.lit("unknown"))
        .alias("skill"),
        F.when(at > 0, F.coalesce(F.nullif(after, F.lit("")), language))
        .otherwise(language)
        .alias("project_type"),
        F.when(kept_at > 0, F.coalesce(kept_after, F.lit("unknown")))
        .otherwise(F.lit("unknown"))
        .alias("overview_type"),
    )
