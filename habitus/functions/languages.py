"""File language detection and language attributes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.functions.paths import basename, file_extension

# Extension -> (display name, category, group).
EXTENSIONS: dict[str, tuple[str, str, str]] = {
    ".ts": ("TypeScript", "frontend", "typescript"),
    ".tsx": ("TypeScript React", "frontend", "typescript"),
    ".js": ("JavaScript", "frontend", "javascript"),
    ".jsx": ("JavaScript React", "frontend", "javascript"),
    ".mjs": ("JavaScript ESM", "frontend", "javascript"),
    ".cjs": ("JavaScript CJS", "frontend", "javascript"),
    ".vue": ("Vue", "frontend", "vue"),
    ".svelte": ("Svelte", "frontend", "svelte"),
    ".css": ("CSS", "frontend", "css"),
    ".scss": ("SCSS", "frontend", "css"),
    ".sass": ("Sass", "frontend", "css"),
    ".less": ("Less", "frontend", "css"),
    ".styl": ("Stylus", "frontend", "css"),
    ".py": ("Python", "backend", "python"),
    ".pyi": ("Python Interface", "backend", "python"),
    ".java": ("Java", "backend", "java"),
    ".kt": ("Kotlin", "backend", "java"),
    ".kts": ("Kotlin Script", "backend", "java"),
    ".groovy": ("Groovy", "backend", "java"),
    ".scala": ("Scala", "backend", "java"),
    ".go": ("Go", "backend", "go"),
    ".rs": ("Rust", "systems", "rust"),
    ".c": ("C", "systems", "c"),
    ".h": ("C Header", "systems", "c"),
    ".cpp": ("C++", "systems", "cpp"),
    ".cc": ("C++", "systems", "cpp"),
    ".cxx": ("C++", "systems", "cpp"),
    ".hpp": ("C++ Header", "systems", "cpp"),
    ".cs": ("C#", "backend", "csharp"),
    ".rb": ("Ruby", "backend", "ruby"),
    ".php": ("PHP", "backend", "php"),
    ".swift": ("Swift", "mobile", "swift"),
    ".sh": ("Shell", "scripting", "shell"),
    ".bash": ("Bash", "scripting", "shell"),
    ".zsh": ("Zsh", "scripting", "shell"),
    ".json": ("JSON", "config", "config"),
    ".yaml": ("YAML", "config", "config"),
    ".yml": ("YAML", "config", "config"),
    ".toml": ("TOML", "config", "config"),
    ".xml": ("XML", "config", "config"),
    ".graphql": ("GraphQL", "api", "graphql"),
    ".gql": ("GraphQL", "api", "graphql"),
    ".md": ("Markdown", "docs", "docs"),
    ".mdx": ("MDX", "docs", "docs"),
    ".html": ("HTML", "frontend", "html"),
    ".sql": ("SQL", "data", "sql"),
    ".dockerfile": ("Docker", "infra", "docker"),
}
# Whole file name -> (display name, category, group).
FILE_NAMES: dict[str, tuple[str, str, str]] = {
    "Dockerfile": ("Docker", "infra", "docker"),
    "docker-compose.yml": ("Docker Compose", "infra", "docker"),
    "docker-compose.yaml": ("Docker Compose", "infra", "docker"),
    "Makefile": ("Makefile", "build", "build"),
    "CMakeLists.txt": ("CMake", "build", "build"),
    "meson.build": ("Meson", "build", "build"),
}
# Categories that are not code; file names of top priority.
NON_CODE_CATEGORIES = ("config", "docs", "build")
KEY_FILE_NAMES = (
    "package.json",
    "tsconfig.json",
    "vite.config.ts",
    "index.ts",
    "main.ts",
    "App.vue",
    "app.ts",
)


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def language_dimension() -> dict[str, tuple[str, str, bool]]:
    """Group -> (display name, category, is_code); the first entry of a group wins."""
    out: dict[str, tuple[str, str, bool]] = {}
    for name, category, group in chain(EXTENSIONS.values(), FILE_NAMES.values()):
        out.setdefault(group, (name, category, category not in NON_CODE_CATEGORIES))
    return out


def language_dimension_table(spark: SparkSession) -> DataFrame:
    rows = [(g, *v) for g, v in language_dimension().items()]
    return spark.createDataFrame(
        rows, "language string, display_name string, category string, is_code boolean"
    )


def detect_language(path: Column) -> Column:
    """Group of the file name, else of the extension, else ``other``.

    The lookup tables are constants of a few dozen entries, so they travel as
    literal maps inside the expression: no join at all.
    """
    name = F.substring_index(basename(path), "\\", -1)
    extension = F.when(
        F.contains(name, F.lit(".")),
        F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1))),
    )
    by_name = _literal_map({k: v[2] for k, v in FILE_NAMES.items()})
    by_extension = _literal_map({k: v[2] for k, v in EXTENSIONS.items()})
    return F.coalesce(
        F.try_element_at(by_name, name),
        F.try_element_at(by_extension, extension),
        F.lit("other"),
    )


def display_name(language: Column) -> Column:
    names = _literal_map({g: v[0] for g, v in language_dimension().items()})
    return F.coalesce(
        F.try_element_at(names, language),
        F.concat(F.upper(F.substring(language, 1, 1)), F.substr(language, F.lit(2))),
    )



def category(language: Column) -> Column:
    names = _literal_map({g: v[1] for g, v in language_dimension().items()})
    return F.coalesce(F.try_element_at(names, language), F.lit("other"))


def is_code(language: Column) -> Column:
    return ~category(language).isin(*NON_CODE_CATEGORIES) & (language != "other")


def file_priority(path: Column) -> Column:
    """0 key file, 1 configuration or types, 2 code, 3 the rest."""
    name = basename(path)
    return (
        F.when(name.isin(*KEY_FILE_NAMES), 0)
        .when(
            F.contains(name, F.lit("config"))
            | F.contains(name, F.lit("types"))
            | F.endswith(name, F.lit(".d.ts")),
            1,
        )
        .when(is_code(detect_language(path)), 2)
        .otherwise(3)
    )


__all__ = [
    "EXTENSIONS",
    "FILE_NAMES",
    "category",
    "detect_language",
    "display_name",
    "file_extension",
    "file_priority",
    "is_code",
    "language_dimension",
    "language_dimension_table",
]
