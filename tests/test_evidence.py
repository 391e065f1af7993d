"""Convention rules on small corpora of our own making."""

from pyspark.sql import functions as F

from habitus.functions.languages import detect_language
from habitus.functions.paths import file_extension
from habitus.operators import evidence as ev
from habitus.operators.rules import RULES

MIXED = {
    "src/api/user/index.ts": "import request from '@/config/axios'\nexport const get = () => request.get({})",
    "src/views/User.vue": "<template><div/></template>\n<script setup>\nconst n = ref(1)\n</script>",
    "src/store/modules/user.ts": "import { defineStore } from 'pinia'\nexport const u = defineStore('u', {})",
    "legacy/components/User.vue": "<script>\nexport default {\n  methods: {}\n}\n</script>",
    "legacy/store/index.js": "import Vuex from 'vuex'\nexport default new Vuex.Store({ state: {} })",
    "pom.xml": "<modules><module>a</module></modules>",
    "src/main/java/demo/UserController.java": "@RestController\npublic class UserController { @Valid Object o; }",
    "src/main/java/demo/UserDO.java": "@Data\n@TableName(\"t\")\npublic class UserDO {}",
    "src/app.module.ts": "@Module({})\nexport class AppModule {}",
    "src/users/user.controller.ts": "@Controller('u')\nexport class UserController { constructor(private s: S) {} }",
    "src/users/dto/create-user.dto.ts": "import { IsString } from 'class-validator'",
    "src/prisma/schema.prisma": "model User { id Int @id }",
    "app/routers/users.py": "router = APIRouter()\n@router.get('/u')\ndef users(): ...",
    "app/schemas.py": "from pydantic import BaseModel\nclass User(BaseModel): ...",
    "internal/handlers/user.go": "package h\nfunc H(w http.ResponseWriter, r *http.Request) {}",
    "internal/store/user.go": "package s\nvar db *sql.DB",
    "src/lib.rs": "mod routes;\n#[derive(Serialize)]\npub struct U {}",
    "src/routes.rs": "pub fn r() { Router::new().route(\"/u\", get(h)); }",
    "Program.cs": "builder.Services.AddScoped<IUser, User>();\napp.MapGet(\"/u\", h);\napp.UseAuthorization();",
    "routes/api.php": "Route::get('/u', [UserController::class, 'index']);",
    "app/Models/User.php": "class User extends Model {}",
    "config/routes.rb": "Rails.application.routes.draw do\n  resources :users\nend",
    "app/models/user.rb": "class User < ApplicationRecord\n  has_many :posts\nend",
    ".github/workflows/ci.yml": "steps:\n  - uses: actions/checkout@v4\n  - run: npm test",
}
# Rule ids the mixed corpus must show.
MIXED_IDS = """
    frontend-api-facade vue-single-file-components vue2-options-api vue2-vuex-state
    vue3-composition-api vue3-pinia-state spring-module-boundaries spring-controller-contract
    java-dto-vo-do-naming lombok-models nestjs-module-boundaries node-dto-validation
    node-orm-repository python-api-routes python-schema-models go-http-handlers
    go-persistence-layer rust-crate-modules rust-web-routes rust-serde-types
    dotnet-controller-contract dotnet-service-di dotnet-validation-auth php-mvc-routes
    php-eloquent-models ruby-rails-routes ruby-active-record-models ci-workflows
""".split()


def files_of(spark, contents, project="p"):
    rows = [(project, p, c, 120) for p, c in contents.items()]
    raw = spark.createDataFrame(rows, "project string, path string, content string, size bigint")
    return raw.select(
        "project", "path", detect_language(F.col("path")).alias("language"), "content", "size",
        file_extension(F.col("path")).alias("extension"),
    )


def ids(spark, contents, kind):
    kinds = spark.createDataFrame([("p", kind)], "project string, project_type string")
    found = ev.collect_evidence(files_of(spark, contents), kinds)
    return {r.rule_id: r for r in found.collect()}


def test_rule_set():
    assert len(RULES) == 54 and len({r.id for r in RULES}) == 54


def test_mixed_corpus(spark):
    found = ids(spark, MIXED, "mixed-fixture")
    assert set(MIXED_IDS) <= set(found), set(MIXED_IDS) - set(found)


def test_vue3_project(spark):
    files = {
        "src/main.ts": "createApp(App).use(router)",
        "src/api/user/index.ts": MIXED["src/api/user/index.ts"],
        "src/store/modules/user.ts": MIXED["src/store/modules/user.ts"],
        "src/views/User.vue": MIXED["src/views/User.vue"],
        ".env.development": "VITE_X=1",
    }
    found = set(ids(spark, files, "vue3"))
    assert {"env-config", "frontend-api-facade", "vue-single-file-components", "vue3-composition-api",
            "vue3-pinia-state", "vue3-router-bootstrap"} <= found
    assert not found & {"react-router", "react-state-management", "vue2-options-api", "vue2-vuex-state",
                        "node-middleware-security"}


def test_production_guard_and_its_exception(spark):
    files = {
        "src/test/java/demo/UserControllerTest.java": "@RestController class A { @Test void t() {} }",
        "tests/a.ts": "mapState({})",
        "src/fixtures/x.spec.ts": "test",
    }
    found = ids(spark, files, "unknown")
    assert "spring-controller-contract" not in found
    assert found["vue2-vuex-state"].files == ["tests/a.ts"]
    assert found["test-fixtures"].files == [
        "src/test/java/demo/UserControllerTest.java", "tests/a.ts",
    ]


def test_pattern_traps(spark):
    compose = ids(spark, {"a/x.txt": "services:\n  db:\n"}, "go")
    assert "containerized-runtime" not in compose
    assert "containerized-runtime" in ids(spark, {"a/x.txt": "services:web"}, "go")
    assert "dotnet-controller-contract" not in ids(spark, {"A.cs": "[Route(\"x\")]"}, "csharp")
    assert "dotnet-controller-contract" in ids(spark, {"A.cs": "[Route]"}, "csharp")
    # an accented letter is no word character
    assert "vue2-vuex-state" in ids(spark, {"a.js": "émapState(x)"}, "vue2")
    assert "vue2-vuex-state" not in ids(spark, {"a.js": "xmapState(x)"}, "vue2")


def test_only_lines_that_are_no_comments_count(spark):
    assert "vue3-pinia-state" not in ids(spark, {"a.ts": "// createPinia()\n * createPinia()"}, "vue3")
    assert "vue3-pinia-state" not in ids(spark, {"a.ts": "const f = () => createPinia()"}, "vue3")
    assert "vue3-pinia-state" in ids(spark, {"a.ts": "x\r\n  app.use(createPinia())"}, "vue3")


def test_twelve_files_and_full_count_on_a_hot_group(spark):
    files = {f"app/models/m{i:03}.rb": "x" for i in range(300)}
    row = ids(spark, files, "rails")["ruby-active-record-models"]
    assert row["count"] == 300 and row.confidence == "high"
    assert row.files == sorted(files)[:12]


def test_contents_are_not_shuffled_and_patterns_run_once(spark):
    rows = files_of(spark, MIXED)
    plan = ev.rule_hits(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mapState|mapGetters") == 1  # the pattern; the guard before it names single words
    kinds = spark.createDataFrame([("p", "go")], "project string, project_type string")
    physical = ev.collect_evidence(rows, kinds)._jdf.queryExecution().executedPlan().toString()
    below = [l for l in physical.splitlines() if "Exchange hashpartitioning" in l]
    assert below and not any("content" in l for l in below)


def test_chosen_contents_are_not_shuffled(spark):
    from habitus.operators import sampling

    rows = files_of(spark, MIXED)
    plan = sampling.layer_file_plan(rows)
    for frame in (sampling.code_sample(rows), sampling.layer_samples(plan, rows)):
        physical = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in physical and "Exchange hashpartitioning" not in physical
