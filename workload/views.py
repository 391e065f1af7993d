"""Corpus views over the driver tables.

The given tables hold no source code, so each query starts from one projection
that turns whole tables into the library's relations.  The projection of each
view is one SQL text both engines run; the few functions with different names
are filled in per engine.  No view drops, samples or caps rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Path layouts of the corpus: directory, suffix of the file name, first lines.
LAYOUTS = [
    ("src/api/d", "/index.ts", "import request from '@/config/axios'\nexport const load = () => request.get({ url: 'x' })"),
    ("src/views/d", ".vue", "<template><div v-hasPermi=\"['a']\"/></template>\n<script setup>\nconst n = ref(0)\n</script>"),
    ("src/store/modules/d", ".ts", "import { defineStore } from 'pinia'\nexport const useUser = defineStore('user', {})"),
    ("legacy/components/d", ".vue", "<script>\nexport default {\n  data: 1,\n  methods: {}\n}\n</script>"),
    ("src/main/java/demo/d", "Controller.java", "@RestController\n@PreAuthorize(\"x\")\npublic class UserController {}"),
    ("src/main/java/demo/d", "DO.java", "@Data\n@TableName(\"u\")\npublic class UserDO {}"),
    ("src/users/d", ".controller.ts", "@Controller('users')\nexport class UserController {}"),
    ("src/users/dto/d", ".dto.ts", "import { IsString } from 'class-validator'\nexport class UserDto {}"),
    ("app/routers/d", ".py", "router = APIRouter()\n@router.get('/x')\ndef read(session: Session): ..."),
    ("internal/store/d", ".go", "package store\nfunc Load(ctx context.Context) error {\n\tif err != nil { return err }\n\trows, _ := sql.Open(\"x\", \"y\")\n}"),
    ("src/d", "/routes.rs", "mod user;\n#[derive(Serialize)]\npub struct User {}\nfn f() -> Result<(), E> { Router::new().route(\"/\", get(h))?; }"),
    ("services/d", "/Program.cs", "builder.Services.AddScoped<IUser>();\napp.MapGet(\"/x\", h);\n[Authorize]\nclass C : ControllerBase {}"),
    ("routes/d", ".php", "Route::get('/x', [UserController::class, 'index']);"),
    ("app/models/d", ".rb", "class User < ApplicationRecord\n  has_many :posts\nend"),
    (".github/workflows/d", ".yml", "on: push\nsteps:\n  - uses: actions/checkout\n  - run: npm test"),
    ("src/test/java/demo/d", "Test.java", "import org.mockito.Mockito;\nclass UserTest { @Test void a() {} }"),
    ("packages/d", "/useUser.tsx", "'use client'\nexport function useUser() { return create((set) => ({})) }"),
    ("dist/d", ".js", "const x = 1"),
    (".cache/d", ".ts", "export const cached = 1"),
    ("private/d", ".ts", "export const secret = process.env.SECRET"),
    ("docs/d", ".md", "# Notes\n\nplain text"),
    ("deploy/d", "/Dockerfile", "FROM node:20\nRUN pnpm install"),
    ("src/router/d", ".js", "router.beforeEach((to) => { if (to.meta.token) return true })"),
    ("assets/d", ".bin", "binary"),
    ("src/old/d", ".vue", "<script>\nexport default {\n  name: 'x',\n  methods: {}\n}\n</script>"),
    ("src/stores/d", ".js", "import Vuex from 'vuex'\nexport default new Vuex.Store({ state: {} })\nmapState(['a'])"),
    ("web/d", "/main.js", "new Vue({ el: '#app', router, store })"),
    ("web/d", "/app.ts", "createApp(App).use(router)"),
    ("web/d", "/vite.config.ts", "export default {}"),
    ("ui/d", "/index.tsx", "export * from './button'"),
    ("app/d", "/page.tsx", "export default function Page() {}"),
    ("server/routes/d", ".js", "router.get('/x', handler)"),
    ("server/models/d", ".ts", "const db = new PrismaClient()"),
    ("server/middleware/d", ".ts", "app.use(helmet())"),
    ("pkg/d", "/schemas.py", "class User(BaseModel): ..."),
    ("internal/handlers/d", ".go", "http.HandleFunc(\"/x\", serve)"),
    ("Data/d", "/Context.cs", "class Context : DbContext {}"),
    ("app/Models/d", ".php", "class User extends Model {}"),
    ("app/Requests/d", ".php", "public function rules() { return ['a' => 'required|string']; }"),
    ("backend/d", "/config/routes.rb", "Rails.application.routes.draw do\n  resources :users\nend"),
    ("app/services/d", ".rb", "class Pay\nend"),
    ("conf/d", "/.env", "MODE=dev"),
    ("src/api/blank/d", "/client.ts", " " * 1200 + "\nexport const late = 1"),
]
# Manifests by project: what a digest of the name selects.
MANIFESTS = [
    ("package.json", '{"dependencies":{"vue":"^3.4.0","pinia":"2"}}'),
    ("package.json", '{"dependencies":{"vue":"^3.0.0"},"devDependencies":{"vue":"2.7.0"}}'),
    ("package.json", '{"dependencies":{"react":"18","next":"14"}}'),
    ("pom.xml", "<module>a</module>"),
    ("go.mod", "module x"),
    ("package.json", '{"dependencies": broken'),
    ("Cargo.toml", "[package]"),
    ("package.json", '{"devDependencies":{"express":"4"}}'),
    ("services/api/pyproject.toml", "[project]"),
    ("package.json", '{"dependencies":{"react":"18"}}'),
    ("package.json", '{"dependencies":{"@angular/core":"17"}}'),
    ("package.json", '{"devDependencies":{"svelte":"4"}}'),
    ("package.json", '{"dependencies":{"@nestjs/core":"10","express":"4"}}'),
    ("requirements.txt", "fastapi"),
    ("api/go.mod", "module api"),
]
IGNORE_FILE = "# build output\n  dist  \n\n/private/\n*.gen.ts\nlegacy/**\n!keep\n"

_DUCK = {
    "bytes": "strlen({0})",
    "extract": "regexp_extract({0}, '{1}', {2})",
    "k": "CAST(json_extract(props, '$.k') AS BIGINT)",
    "millis": "epoch_ms(ts)",
    "chr10": "chr(10)",
    "pick": "list_extract([{0}], 1 + {1})",
    "digest": "CAST('0x' || substr(md5({0}), 1, 6) AS BIGINT)",
}
_SPARK = {
    "bytes": "octet_length({0})",
    "extract": "regexp_extract({0}, '{1}', {2})",
    "k": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    "millis": "unix_millis(ts)",
    "chr10": "chr(10)",
    "pick": "element_at(array({0}), 1 + {1})",
    "digest": "CAST(conv(substr(md5({0}), 1, 6), 16, 10) AS BIGINT)",
}


def quote(text: str) -> str:
    """A string literal of both engines: line breaks and quotes spelled out."""
    parts = []
    for piece in text.split("\n"):
        parts.append("'" + piece.replace("'", "''") + "'")
    joined = " || chr(10) || ".join(parts)
    return f"({joined})"


def _spark_quote(text: str) -> str:
    pieces = [
        "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in text.split("\n")
    ]
    return "(" + " || chr(10) || ".join(pieces) + ")"


def _pick(index: str, values: list[str], lit, f) -> str:
    """The text at a place of a constant list; one look-up, however long the list."""
    return f["pick"].replace("{1}", index).replace("{0}", ", ".join(lit(v) for v in values))


def _files_raw(lit, f) -> str:
    n = len(LAYOUTS)
    which = f"CAST(doc_id % {n} AS INT)"
    prefix = _pick(which, [a for a, _, _ in LAYOUTS], lit, f)
    suffix = _pick(which, [b for _, b, _ in LAYOUTS], lit, f)
    head = _pick(which, [c for _, _, c in LAYOUTS], lit, f)
    docs = (
        f"SELECT source AS project, {prefix} || CAST(doc_id AS STRING) || {suffix} AS path,"
        f" {head} || chr(10) || text AS content FROM documents"
    )
    host = f["extract"].format("url", "//([^/]+)", 1)
    page = (
        f"SELECT {host} AS project,"
        " CASE WHEN page_id % 2 = 0 THEN 'web/pages/p' ELSE 'public/p' END"
        " || CAST(page_id AS STRING) ||"
        " CASE WHEN page_id % 2 = 0 THEN '.vue' ELSE '.html' END AS path,"
        " html AS content FROM pages"
    )
    names = (
        "SELECT DISTINCT project FROM (SELECT source AS project FROM documents"
        f" UNION ALL SELECT {host} AS project FROM pages) AS p"
    )
    m = len(MANIFESTS)
    kind = f"CAST({f['digest'].format('project')} % {m} AS INT)"
    manifest = (
        f"SELECT project, {_pick(kind, [a for a, _ in MANIFESTS], lit, f)} AS path,"
        f" {_pick(kind, [b for _, b in MANIFESTS], lit, f)} AS content FROM ({names}) AS n1"
        f" UNION ALL SELECT project, '.gitignore' AS path, {lit(IGNORE_FILE)} AS content"
        f" FROM ({names}) AS n2"
    )
    size = f["bytes"].format("content")
    return (
        f"SELECT project, path, content, CAST({size} AS BIGINT) AS size"
        f" FROM ({docs} UNION ALL {page} UNION ALL {manifest}) AS u"
    )


# Lines a layer document is made of; {t} is the running text of the driver row.
def _layer_docs(lit, f) -> str:
    """Eight consecutive documents form the layer documents of one reference."""
    def cat(*parts: str) -> str:
        return " || ".join(parts)

    nl = "chr(10)"
    line = lambda s: cat(lit(s), nl)
    layer = "'L' || CAST(1 + doc_id % 8 AS STRING)"
    bullets = "replace(text, chr(10), chr(10) || '- ')"
    body = cat(
        "'## ' || " + layer + " || ' · Layer'", nl,
        nl,
        line("### Scope"),
        "CASE WHEN doc_id % 3 = 0 THEN '- Owns: ' || lang || chr(10) ELSE 'Prose for ' || source || chr(10) || 'and more' || chr(10) END",
        nl,
        line("### Rules"),
        "CASE WHEN doc_id % 2 = 0 THEN '#### Naming [Must]' || chr(10) ELSE '' END",
        "'- **API naming** [项目特定] [必须]: keep api names of ' || source || ' in src/api/' || source || '.ts'", nl,
        "'- [个人偏好][必须] store modules of ' || lang || ' use Pinia stores for shared state'", nl,
        line("```ts"),
        line("- not a rule inside a fence [x]"),
        line("```"),
        "'- ' || " + bullets, nl,
        "CASE WHEN doc_id % 5 = 0 THEN '- suggest moving helpers of ' || source || chr(10) ELSE '' END",
        nl,
        "CASE WHEN doc_id % 4 = 0 THEN '### Templates: Store ' || lang || chr(10) || '```ts' || chr(10) || 'const a = 1' || chr(10) || '```' || chr(10)"
        " WHEN doc_id % 4 = 1 THEN '### Templates' || chr(10) || '#### First' || chr(10) || 'No existing pattern' || chr(10) || '#### Second ' || source || chr(10) || 'see `src/a.ts` ' || chr(10)"
        " WHEN doc_id % 4 = 2 THEN '### Template' || chr(10) || 'No existing pattern.' || chr(10) ELSE '' END",
        "CASE WHEN doc_id % 6 <> 0 THEN '### Anti-patterns' || chr(10) || '- ❌ Do not call fetch from views of ' || source || chr(10) || '- 直接修改 state 对象会破坏数据流约定' || chr(10) ELSE '' END",
        "CASE WHEN doc_id % 7 <> 0 THEN '### Evidence' || chr(10) || '- src/a.ts' || chr(10) ELSE '' END",
        "'### Gaps'", nl,
        line("#### Observed Risks"),
        "'- risk in ' || lang", nl,
        line("#### Suggested Improvements"),
        "CASE WHEN doc_id % 2 = 0 THEN '- None.' ELSE '- add tests for ' || source END",
        "CASE WHEN doc_id % 11 = 0 THEN chr(10) || '```' ELSE '' END",
        "CASE WHEN doc_id % 13 = 0 THEN chr(10) || 'tail `code' ELSE '' END",
    )
    return (
        "SELECT 'skill' || CAST(CAST(floor(doc_id / 64) AS BIGINT) AS STRING) AS skill,"
        " CASE CAST(CAST(floor(doc_id / 8) AS BIGINT) % 8 AS INT) WHEN 0 THEN 'vue3' WHEN 1 THEN 'spring-boot'"
        " WHEN 2 THEN 'react' WHEN 3 THEN 'nestjs' WHEN 4 THEN 'go' WHEN 5 THEN 'rust' WHEN 6 THEN 'python' ELSE 'unknown' END"
        " || CASE WHEN doc_id % 16 = 15 THEN '-b' ELSE '' END AS project_type,"
        " 'src' || CAST(CAST(floor(doc_id / 8) AS BIGINT) % 20 AS STRING) AS project, doc_id,"
        f" {layer} AS layer, {layer} || '-layer' AS file_stem, {body} AS content FROM documents"
    )


def _full_docs(lit, f) -> str:
    """Documents holding all layers, in the heading forms that occur."""
    head = "CASE WHEN doc_id % 4 = 1 THEN '### ' ELSE '## ' END"
    mark = "CASE WHEN doc_id % 4 = 2 THEN '' WHEN doc_id % 4 = 3 THEN '：Part ' || lang ELSE ' · Part ' || source END"
    parts = ["'# Memory' || chr(10)"]
    for n in range(1, 9):
        drop = f"CASE WHEN doc_id % 9 = {n} THEN '' ELSE "
        body = "text" if n == 3 else "'- line of ' || source || ' ' || lang"
        parts.append(
            f"{drop}{head} || 'L{n}' || {mark} || chr(10) || {body} || chr(10) END"
        )
    parts.append("CASE WHEN doc_id % 5 = 0 THEN '## L2 · Part again' || chr(10) || '- later ' || lang || chr(10) ELSE '' END")
    parts.append(
        "CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || '## Notes inside' || chr(10) || '```' || chr(10)"
        " || chr(10) || '---' || chr(10) || chr(10) || '## Notes' || chr(10) || source ELSE '' END"
    )
    return (
        "SELECT doc_id, " + " || ".join(parts) + " AS content FROM documents"
    )


def _governed_docs(lit, f) -> str:
    """Layer documents as a completion returns them, before they are cleaned."""
    layer = "'L' || CAST(1 + doc_id % 8 AS STRING)"
    nl = "chr(10)"
    parts = [
        f"'## ' || {layer} || ' · Layer' || {nl}",
        f"CASE WHEN doc_id % 3 = 0 THEN {nl} || '### Scope' || {nl} || 'Owned by ' || source || {nl}"
        f" WHEN doc_id % 3 = 1 THEN {nl} || '### Scope' || {nl} || {nl} ELSE '' END",
        f"{nl} || '### Rules' || {nl} || '- keep names of ' || source || {nl} || text || {nl}",
        f"'- 建议 move helpers of ' || lang || {nl} || '- maybe cache ' || source || {nl}",
        f"CASE WHEN doc_id % 7 = 0 THEN 'continue exactly where the truncated response ended' || {nl} ELSE '' END",
        f"'```ts' || {nl} || '// consider this' || {nl} || '```' || {nl}",
        f"CASE WHEN doc_id % 4 = 0 THEN {nl} || '### Templates' || {nl} || '#### Good ' || lang || {nl} || 'const a = 1' || {nl}"
        f" || '#### Bad' || {nl} || 'see example.com' || {nl}"
        f" WHEN doc_id % 4 = 1 THEN {nl} || '### Template: Runner' || {nl} || 'run JaCoCo and SonarQube here' || {nl}"
        f" WHEN doc_id % 4 = 2 THEN {nl} || '### Template: Hooks' || {nl} || 'const hook = 1' || {nl} ELSE '' END",
        f"CASE WHEN doc_id % 5 <> 0 THEN {nl} || '### Anti-patterns' || {nl} || '- never inline ' || source || {nl} ELSE '' END",
        f"CASE WHEN doc_id % 2 = 0 THEN {nl} || '### Gaps' || {nl} || '#### Observed Risks' || {nl} || '- None.' || {nl}"
        f" || '- risk in ' || lang || {nl} || 'add tests for ' || source || {nl} ELSE '' END",
    ]
    return (
        "SELECT 'skill' || CAST(CAST(floor(doc_id / 64) AS BIGINT) AS STRING) AS skill,"
        " 'type' || CAST(CAST(floor(doc_id / 8) AS BIGINT) % 8 AS STRING) AS project_type,"
        " 'src' || CAST(CAST(floor(doc_id / 8) AS BIGINT) % 20 AS STRING) AS project,"
        f" {layer} AS layer, " + " || ".join(parts) + " AS content FROM documents"
    )


def _catalog(lit, f) -> str:
    """Every (source, lang) pair as a learned entry; ``k`` tells the halves apart."""
    return (
        "SELECT source || '/' || lang AS lock_key, lang AS name, lang AS language,"
        " source || '/reference/' || lang || '/' AS skill_path,"
        " doc_id % 2 AS k, doc_id, 'proj' || CAST(doc_id % 7 AS STRING) AS source_project,"
        " 'f' || CAST(doc_id % 23 AS STRING) || '.ts' AS source_file, n_chars FROM documents"
    )


def _calls(lit, f) -> str:
    return (
        "SELECT CAST(user_id AS STRING) AS run_id, ts AS called_at, event_type AS phase, event_id,"
        " CAST(event_id % 4 AS INT) AS attempt, CAST(floor(value * 100) AS BIGINT) AS duration_ms,"
        " CAST(event_id % 1000 AS BIGINT) AS request_chars,"
        " CAST(event_id % 300 AS BIGINT) AS response_chars,"
        f" event_type <> 'error' AS ok, {f['k']} AS k FROM events"
    )


_VIEWS = {
    "v_files_raw": _files_raw,
    "v_layer_docs": _layer_docs,
    "v_full_docs": _full_docs,
    "v_governed_docs": _governed_docs,
    "v_catalog": _catalog,
    "v_calls": _calls,
}


def duck_sql(view: str) -> str:
    """The view's SELECT for DuckDB."""
    return _VIEWS[view](quote, _DUCK)


def duck_with(*views: str) -> str:
    """``WITH`` list of views for an oracle."""
    return ", ".join(f"{v} AS ({duck_sql(v)})" for v in views)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_INPUT = 1 << 30
#: Estimated bytes of rows that a task holds where a larger input is spread.
TASK_BYTES = 64 << 20


def scan_tasks(tables: Iterable[DataFrame]) -> tuple[int, int]:
    """Rows of the largest scan task, and of all; no column is read."""
    most, total = 0, 0
    for scan in tables:
        per_task = scan.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
        row = per_task.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
        most, total = max(most, row["most"] or 0), total + (row["total"] or 0)
    return most, total


def spread(df: DataFrame, tables: Iterable[DataFrame], small: int = SMALL_INPUT, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Use all cores, whatever the files of ``tables`` that ``df`` is read from look like.

    A scan cuts files at row groups only: a file of one group is one task however
    large it is and however many cores there are.  An input of any size whose rows
    already lie in enough tasks of bounded size stays as read, since dealing it out
    writes all of it to disk, once for each reading.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    most, total = scan_tasks(tables)
    if 4 * cores * most <= 5 * total and most * size <= 4 * task_bytes * total:
        return df
    return df.repartition(cores if size <= small else max(cores, -(-size // task_bytes)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the parquet files of ``sf_dir``."""
    text = _VIEWS[name](_spark_quote, _SPARK)
    tables = {
        t: table(spark, sf_dir, t)
        for t in ("documents", "pages", "events", "conversations")
        if f" {t}" in text
    }
    for t in tables:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    # literal braces of code snippets must survive the table placeholders
    for open_close in ("{", "}"):
        text = text.replace(open_close, open_close * 2)
    for t in tables:
        text = text.replace("{{" + t + "}}", "{" + t + "}")
    return spread(spark.sql(text, **tables), tables.values())
