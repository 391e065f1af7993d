"""From raw trees to scanned files: filters, language, project and type discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitus.config import ScanConfig
from habitus.functions import globs
from habitus.functions import patterns as rx
from habitus.functions.languages import detect_language
from habitus.functions.paths import basename, file_extension
from habitus.session import BROADCAST_LIMIT, broadcast_if_small, measured_bytes

# Files that mark a project root, and project types by dependency
# in order of precedence.
PROJECT_MARKERS = (
    "package.json",
    "Cargo.toml",
    "go.mod",
    "pom.xml",
    "build.gradle",
    "build.gradle.kts",
    "Makefile",
    "CMakeLists.txt",
    "pyproject.toml",
    "setup.py",
    "setup.cfg",
    "Gemfile",
    "mix.exs",
    "pubspec.yaml",
)
TYPE_BY_DEPENDENCY = (
    ("next", "nextjs"),
    ("react", "react"),
    ("@angular/core", "angular"),
    ("svelte", "svelte"),
    ("@nestjs/core", "nestjs"),
    ("express", "express"),
)
TYPE_BY_FILE = (
    (("pom.xml", "build.gradle"), "spring-boot"),
    (("go.mod",), "go"),
    (("Cargo.toml",), "rust"),
    (("pyproject.toml", "requirements.txt"), "python"),
)
PACKAGE_SCHEMA = T.StructType(
    [
        T.StructField("dependencies", T.MapType(T.StringType(), T.StringType())),
        T.StructField("devDependencies", T.MapType(T.StringType(), T.StringType())),
    ]
)


def gitignore_patterns(files_raw: DataFrame) -> DataFrame:
    """(project, pattern): the globs of each project's root ignore file (S3)."""
    return files_raw.filter(F.col("path") == ".gitignore").select(
        "project", F.explode(globs.gitignore_globs(F.col("content"))).alias("pattern")
    )


def ignore_regexes(files_raw: DataFrame) -> DataFrame:
    """(project, ignore_regex): one alternation per project, built in place."""
    return (
        files_raw.filter(F.col("path") == ".gitignore")
        .select(
            "project",
            globs.globs_alternation(
                globs.gitignore_globs(F.col("content"))
            ).alias("ignore_regex"),
        )
        .filter(F.col("ignore_regex").isNotNull())
    )


def ignore_regex_bound(files_raw: DataFrame) -> int:
    """Upper bound in bytes for ``ignore_regexes``, from file sizes alone.

    Every character of an ignore file becomes at most six, every line gets a
    few more; no content is read.
    """
    total = (
        files_raw.filter(F.col("path") == ".gitignore")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s"))
        .first()
    )
    return 16 * total["s"] + 64 * total["n"]


def drop_ignored(
    files: DataFrame, regexes: DataFrame, regex_bytes: int | None = None
) -> DataFrame:
    """Files no ignore pattern covers, directly or through a directory.

    With a regex table of checked small size the join is a broadcast and file
    contents stay where they are.  Otherwise the decision is made on paths
    alone and only the ignored (project, path) pairs are joined back.
    """
    ignored = F.coalesce(
        globs.prunes_path(F.col("path"), F.col("ignore_regex")), F.lit(False)
    )
    if regex_bytes is None:
        regex_bytes = measured_bytes(regexes)
    if regex_bytes <= BROADCAST_LIMIT:
        return (
            files.join(F.broadcast(regexes), "project", "left")
            .filter(~ignored)
            .drop("ignore_regex")
        )
    dropped = (
        files.select("project", "path").join(regexes, "project").filter(ignored)
    )
    return files.join(dropped.select("project", "path"), ["project", "path"], "left_anti")


def outside_hidden_dirs(path: Column, allowed: tuple[str, ...]) -> Column:
    """No directory segment is hidden, but for the allowed ones."""
    names = "|".join(globs.glob_regex(a) for a in allowed)
    keep = rf"(?!(?:{names})/)" if names else ""
    return ~path.rlike(rf"(?:^|/){keep}\.[^/]*/")


def scannable(max_bytes: int) -> Column:
    """Size in (0, max], and something other than white space inside."""
    return (
        (F.col("size") > 0)
        & (F.col("size") <= max_bytes)
        & F.col("content").rlike(rf"[^{rx.SPACE_CLASS}]")
    )


def with_slashes(files_raw: DataFrame) -> DataFrame:
    """Raw files with one kind of path separator."""
    return files_raw.withColumn("path", F.replace(F.col("path"), F.lit("\\"), F.lit("/")))


def path_filters(config: ScanConfig) -> Column:
    """What a scan asks of size and path: limits, globs, hidden folders."""
    return (
        (F.col("size") > 0)
        & (F.col("size") <= config.max_file_size)
        & globs.match_globs(F.col("path"), config.include)
        & ~globs.match_globs_or_ancestor(F.col("path"), config.exclude)
        & outside_hidden_dirs(F.col("path"), config.visible_hidden_dirs)
    )


def scan_files(
    files_raw: DataFrame,
    config: ScanConfig = ScanConfig(),
    ignore: DataFrame | None = None,
) -> DataFrame:
    """Scanned files with language and extension (S1 filters, S2-S6, P4).

    ``ignore`` takes a prepared (project, ignore_regex) table, so that a large
    corpus does not look for its ignore files twice.
    """
    files = (
        with_slashes(files_raw)
        .filter(path_filters(config))
        .filter(scannable(config.max_file_size))
    )
    if config.respect_gitignore and ignore is None:
        files = drop_ignored(files, ignore_regexes(files_raw), ignore_regex_bound(files_raw))
    elif config.respect_gitignore:
        files = drop_ignored(files, ignore)
    return files.select(
        "project",
        "path",
        detect_language(F.col("path")).alias("language"),
        "content",
        F.col("size").cast("bigint").alias("size"),
        file_extension(F.col("path")).alias("extension"),
    )


def discover_projects(files_raw: DataFrame) -> DataFrame:
    """(root, project): the projects below each scanned root.

    ``files_raw.project`` is the scanned root; ``project`` is '' for the root
    itself, else the name of a first-level directory holding a marker file.
    """
    depth = F.size(F.split("path", "/"))
    child = F.substring_index("path", "/", 1)
    marker = basename(F.col("path")).isin(*PROJECT_MARKERS)
    child_marker = (
        marker
        & (depth == 2)
        & ~F.startswith(child, F.lit("."))
        & (child != "node_modules")
    )
    at_root = marker & (depth == 1)
    found = files_raw.select(
        F.col("project").alias("root"),
        F.when(child_marker, child).alias("child"),
        at_root.alias("at_root"),
    )
    # one small row per (root, child); no group is ever gathered
    children = found.groupBy("root", "child").agg(F.bool_or("at_root").alias("at_root"))
    roots = children.groupBy("root").agg(
        F.bool_or("at_root").alias("root_is_project"),
        F.count("child").alias("n_children"),
    )
    single = roots.filter(F.col("root_is_project") | (F.col("n_children") == 0)).select(
        "root", F.lit("").alias("project")
    )
    several = (
        children.filter(F.col("child").isNotNull())
        .join(
            roots.filter(~F.col("root_is_project")).select("root"), "root", "left_semi"
        )
        .select("root", F.col("child").alias("project"))
    )
    return single.unionByName(several)


def assign_projects(files_raw: DataFrame, projects: DataFrame) -> DataFrame:
    """Raw files re-keyed from scanned root to discovered project, paths made relative."""
    small = broadcast_if_small(projects)
    side = projects if small is None else small
    child = F.substring_index("path", "/", 1)
    nested = F.contains(F.col("path"), F.lit("/"))
    keyed = files_raw.withColumnRenamed("project", "root").withColumn(
        "__child", F.when(nested, child)
    )
    whole = side.filter(F.col("project") == "").select("root")
    parts = side.filter(F.col("project") != "").select(
        "root", F.col("project").alias("__child")
    )
    as_root = keyed.join(whole, "root", "left_semi").select(
        F.col("root").alias("project"), "path", "content", "size"
    )
    as_child = keyed.join(parts, ["root", "__child"], "left_semi").select(
        F.concat_ws("/", "root", "__child").alias("project"),
        F.substr("path", F.length("__child") + 2).alias("path"),
        "content",
        "size",
    )
    return as_root.unionByName(as_child)


def detect_project_type(files_raw: DataFrame) -> DataFrame:
    """(project, project_type) from root manifests, first hit wins.

    Marker files are found on (project, path) alone; contents are read through
    a path filter the scan can use, and only of root package manifests.
    """
    path = F.col("path")
    markers = [
        F.bool_or(path.isin(*names)).alias(f"__has_{kind}")
        for names, kind in TYPE_BY_FILE
    ]
    packages = (
        files_raw.filter(path == "package.json")
        .groupBy("project")
        .agg(F.max("content").alias("package"))
    )
    per_project = files_raw.groupBy("project").agg(*markers).join(packages, "project", "left")
    parsed = F.from_json("package", PACKAGE_SCHEMA)
    deps = F.coalesce(parsed["dependencies"], F.create_map().cast("map<string,string>"))
    dev = F.coalesce(
        parsed["devDependencies"], F.create_map().cast("map<string,string>")
    )

    def has(name: str) -> Column:
        return F.map_contains_key(deps, name) | F.map_contains_key(dev, name)

    version = F.coalesce(
        F.when(F.map_contains_key(dev, "vue"), F.try_element_at(dev, F.lit("vue"))).otherwise(
            F.try_element_at(deps, F.lit("vue"))
        ),
        F.lit(""),
    )
    kind = F.when(
        has("vue"), F.when(version.rlike(r"^\^?3"), "vue3").otherwise("vue2")
    )
    for dependency, name in TYPE_BY_DEPENDENCY:
        kind = kind.when(has(dependency), name)
    for _, name in TYPE_BY_FILE:
        kind = kind.when(F.col(f"__has_{name}"), name)
    return per_project.select("project", kind.otherwise("unknown").alias("project_type"))


def group_by_language(files: DataFrame) -> DataFrame:
    """(project, language, n_files, total_size, position), largest first (A1)."""
    groups = files.groupBy("project", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_size")
    )
    order = Window.partitionBy("project").orderBy(F.desc("total_size"), "language")
    return groups.withColumn("position", F.row_number().over(order))


def project_summary(files: DataFrame) -> DataFrame:
    """(project, languages, file_count, total_size); languages in A1 order (A2)."""
    groups = files.groupBy("project", "language").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")
    )
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("s")).alias("s"), "language"))
    )
    return groups.groupBy("project").agg(
        F.transform(ordered, lambda x: x["language"]).alias("languages"),
        F.sum("n").alias("file_count"),
        F.sum("s").alias("total_size"),
    )


def scan_fingerprint(files: DataFrame) -> DataFrame:
    """(project, file_count, scan_hash): equal when the file sets are (P10).

    ``files`` has contents or, from ``file_facts``, their digests.  Different sets
    differ but for a chance collision.  An order-independent digest: every file contributes four 60-bit lanes of
    its SHA-256 and the lanes are summed, so the aggregate is a few numbers per
    project and task instead of a sorted list of all files.
    """
    of_content = F.col("digest") if "digest" in files.columns else F.sha2("content", 256)
    digest = F.sha2(
        F.concat_ws("\x1f", "path", F.col("size").cast("string"), of_content), 256
    )
    lanes = [
        F.conv(F.substring(F.col("__digest"), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
        for i in range(4)
    ]
    return (
        files.select("project", digest.alias("__digest"))
        .groupBy("project")
        .agg(
            F.count(F.lit(1)).alias("file_count"),
            *[F.sum(lane).alias(f"__lane{i}") for i, lane in enumerate(lanes)],
        )
        .select(
            "project",
            "file_count",
            F.sha2(
                F.concat_ws(
                    ":",
                    F.col("file_count").cast("string"),
                    *[F.col(f"__lane{i}").cast("string") for i in range(4)],
                ),
                256,
            ).alias("scan_hash"),
        )
    )
