"""Scan settings."""

from __future__ import annotations

from dataclasses import dataclass

# Default include and exclude globs and size limit.
DEFAULT_INCLUDE = (
    "**/*.ts",
    "**/*.tsx",
    "**/*.js",
    "**/*.jsx",
    "**/*.vue",
    "**/*.py",
    "**/*.java",
    "**/*.go",
    "**/*.rs",
    "**/*.rb",
    "**/*.php",
    "**/*.swift",
    "**/*.kt",
    "**/*.cs",
    "**/*.cpp",
    "**/*.c",
    "**/*.h",
    "**/*.sql",
    "**/*.svelte",
    "**/*.css",
    "**/*.scss",
    "**/*.less",
    "**/*.html",
    "**/*.md",
    "**/*.mdx",
    "**/*.json",
    "**/*.yaml",
    "**/*.yml",
    "**/*.toml",
    "**/*.xml",
    "**/*.gradle",
    "**/*.kts",
    "**/*.prisma",
    "**/*.graphql",
    "**/*.gql",
    "**/.env*",
    "**/Dockerfile",
    "**/docker-compose.yaml",
    "**/docker-compose.yml",
    "**/Jenkinsfile",
)
DEFAULT_EXCLUDE = (
    "**/node_modules/**",
    "**/dist/**",
    "**/build/**",
    "**/.git/**",
    "**/coverage/**",
    "**/.next/**",
    "**/.nuxt/**",
    "**/target/**",
    "**/__pycache__/**",
    "**/*.min.js",
    "**/*.min.css",
    "**/package-lock.json",
    "**/pnpm-lock.yaml",
    "**/yarn.lock",
)
DEFAULT_MAX_FILE_SIZE = 200 * 1024
# Hidden directories that are scanned all the same.  A tool that keeps its own
# state in a hidden directory of the project adds that name here.
VISIBLE_HIDDEN_DIRS = (".github", ".vscode")


@dataclass(frozen=True)
class ScanConfig:
    include: tuple[str, ...] = DEFAULT_INCLUDE
    exclude: tuple[str, ...] = DEFAULT_EXCLUDE
    max_file_size: int = DEFAULT_MAX_FILE_SIZE
    respect_gitignore: bool = True
    visible_hidden_dirs: tuple[str, ...] = VISIBLE_HIDDEN_DIRS
    output_language: str = "zh"
