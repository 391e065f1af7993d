"""The convention rules: one boolean expression per rule.

A rule looks at one file's path, extension and content.  It is written against
a small ``probe`` object, so that the same rule text can be compiled to a Spark
``Column`` (``ColumnProbe`` below) and, in the checks, to plain SQL.  Rules test
path and extension before content, so generated code skips the content scan for
most files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.functions import patterns as rx
from habitus.functions.paths import is_production_file

Predicate = Callable[[Any], Any]

# Project families and script-like extensions.
FRONTEND_TYPES = (
    "vue",
    "vue2",
    "vue3",
    "react",
    "nextjs",
    "angular",
    "svelte",
    "astro",
    "frontend",
)
NODE_TYPES = ("node", "nodejs", "express", "koa", "fastify", "nestjs", "nextjs")
JAVA_TYPES = ("java", "spring-boot")
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".vue")
DEFAULT_MIN_HIGH = 5
DEFAULT_MIN_MEDIUM = 2

# Line patterns of the two shared helpers.
PINIA_LINES = (
    r"^import\s+.*\s+from\s+['\"]pinia['\"]",
    r"^import\s+['\"]pinia-plugin-persistedstate['\"]",
    r"^(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*defineStore\s*\(",
)
PINIA_CREATE = r"\bcreatePinia\s*\("
JAVA_GUARD = r"@(?:Valid|Validated|PreAuthorize)\b"
PERMISSION_IMPORT = r"^import\s+.*permission"
PERMISSION_DIRECTIVE = r"v-has(Permi|Role)"
SECURITY_TYPE = r"^(class|interface)\s+\w*(Security|Xss)\w*"
SANITIZE_CALL = r"^(?:return\s+)?sanitize\s*\("
PERMISSION_DIR = r"(^|\/)(permission|directives|security)\/"


@dataclass(frozen=True)
class Rule:
    """A convention rule; ``when`` receives a probe and returns its predicate."""

    id: str
    layer: str
    category: str
    summary: str
    when: Predicate
    applies_to: tuple[str, ...] = ()
    min_high: int = DEFAULT_MIN_HIGH
    min_medium: int = DEFAULT_MIN_MEDIUM


class ColumnProbe:
    """Compiles the rule vocabulary to Spark columns."""

    def __init__(
        self, path: Column, extension: Column, content: Column,
        production: Column | None = None, lowered: Column | None = None,
    ) -> None:
        """``production`` and ``lowered``, the lower-cased path, where they are columns already."""
        self._path, self._extension, self._content = path, extension, content
        self._lowered = F.lower(path) if lowered is None else lowered
        self.production = is_production_file(path) if production is None else production

    def path(self, pattern: str, flags: str = "") -> Column:
        return rx.guarded_test(self._path, pattern, flags, self._lowered)

    def body(self, pattern: str, flags: str = "") -> Column:
        return rx.guarded_test(self._content, pattern, flags)

    def ext(self, *extensions: str) -> Column:
        return self._extension.isin(*extensions)

    def _line(self, pattern: str, needs: tuple[str, ...], without: str = "") -> Column:
        """A trimmed, non-comment line matches; done as one multi-line search.

        The content is never split: ``(?m)`` anchors plus a one-line white-space
        class give the line-wise answer inside generated code.  ``needs`` names
        literal text one of which every match contains: a plain byte search
        that spares most files the regular expression.
        """
        space = rx.INLINE_SPACE_CLASS
        skip_comment = rf"(?![{space}]*(?://|\*))"
        veto = f"(?!.*{rx.java(without, inline=True)})" if without else ""
        body = rx.java(pattern, inline=True)
        if body.startswith("^"):
            tail = f"[{space}]*{body[1:]}"
        else:
            tail = f".*{body}"
        return rx.contains_any(self._content, [(text,) for text in needs]) & self._content.rlike(f"(?m)^{skip_comment}{veto}{tail}")

    def pinia(self) -> Column:
        """Imports pinia, declares a store, or creates the store container."""
        found = self._line(PINIA_CREATE, ("createPinia",), without="=>")
        for pattern, needed in zip(PINIA_LINES, ("pinia", "pinia", "defineStore")):
            found = self._line(pattern, (needed,)) | found
        return found

    def security(self) -> Column:
        """Validation or authorisation markers on some non-comment line."""
        java = self.ext(".java")
        vue = self.ext(".vue")
        script = self.ext(".ts", ".js", ".tsx", ".jsx")
        guarded = self.path(PERMISSION_DIR, "i")
        return (
            (java & self._line(JAVA_GUARD, ("@Valid", "@PreAuthorize")))
            | ((script | vue) & self._line(PERMISSION_IMPORT, ("permission",)))
            | (
                (vue | guarded)
                & self._line(PERMISSION_DIRECTIVE, ("v-has",), without=r"rules\.includes")
            )
            | (java & self._line(SECURITY_TYPE, ("Security", "Xss")))
            | self._line(SANITIZE_CALL, ("sanitize",))
        )


# The rule set.  Ids, layers, categories, summaries, targets,
# thresholds and patterns must match the specification to give equal evidence.
RULES: list[Rule] = [
    Rule(
        "vue-single-file-components",
        "L1",
        "Component",
        "Vue 页面/组件使用单文件组件组织模板、脚本和样式。",
        lambda f: f.production & f.ext(".vue") & f.body(r"<template[\s>]|<script[\s>]"),
        ("vue", "vue2", "vue3", "mixed"),
        8,
        3,
    ),
    Rule(
        "vue2-options-api",
        "L4",
        "Implementation",
        "Vue 2 组件主要通过 Options API 的 data/methods/computed/watch 组织逻辑。",
        lambda f: f.production
        & f.ext(".vue")
        & f.body(
            r"export\s+default\s+\{[\s\S]*\b(data|methods|computed|watch)\s*:", "m"
        ),
        ("vue2", "mixed"),
    ),
    Rule(
        "vue2-vuex-state",
        "L5",
        "State",
        "Vue 2 跨页面状态通过 Vuex store、mapState/mapActions 或 createStore 集中管理。",
        # the second alternative is not restricted to production files
        lambda f: (
            f.production
            & f.path(r"(^|\/)(store|stores)\/", "i")
            & f.body(r"(Vuex|new\s+Vuex\.Store|createStore|state\s*:|mutations\s*:)")
        )
        | f.body(r"\b(mapState|mapGetters|mapMutations|mapActions)\s*\("),
        ("vue2", "mixed"),
    ),
    Rule(
        "vue2-router-bootstrap",
        "L8",
        "Bootstrap",
        "Vue 2 启动流程显式装配 VueRouter、Vuex store 和根组件。",
        lambda f: f.production
        & f.path(r"(^|\/)(main|app)\.(ts|js)$")
        & f.body(r"(new\s+Vue\s*\(|Vue\.use\s*\(\s*VueRouter|router\s*,|store\s*,)"),
        ("vue2", "mixed"),
    ),
    Rule(
        "vue3-composition-api",
        "L4",
        "Implementation",
        "Vue 3 组件优先使用 Composition API 与 `<script setup>` 组织逻辑。",
        lambda f: f.production
        & f.ext(".vue")
        & (
            f.body(r"<script\s+setup")
            | f.body(r"\b(ref|reactive|computed|watch|onMounted)\s*\(")
        ),
        ("vue3", "mixed"),
    ),
    Rule(
        "vue3-pinia-state",
        "L5",
        "State",
        "Vue 3 跨页面状态通过 Pinia store 管理，并以模块方式组织。",
        lambda f: f.production
        & (
            (
                f.path(r"(^|\/)(store|stores)\/", "i")
                & f.body(r"(defineStore|createPinia|from\s+['\"]pinia['\"])")
            )
            | f.pinia()
        ),
        ("vue3", "mixed"),
    ),
    Rule(
        "vue3-router-bootstrap",
        "L8",
        "Bootstrap",
        "Vue 3 启动流程显式装配 createApp、router、Pinia 或组件库插件。",
        lambda f: f.production
        & f.path(r"(^|\/)(main|app)\.(ts|js)$")
        & f.body(r"(createApp|createRouter|createPinia|\.use\s*\()"),
        ("vue3", "mixed"),
    ),
    Rule(
        "frontend-api-facade",
        "L2",
        "API",
        "前端接口调用集中通过 API/facade 文件封装，而不是在组件中散落请求细节。",
        lambda f: f.production
        & f.ext(*SCRIPT_EXTENSIONS)
        & (
            f.path(r"(^|\/)(api|apis|services?)\/", "i")
            | (
                f.path(r"(^|\/)(request|http|axios|client)\.(ts|tsx|js|jsx)$")
                & f.body(
                    r"from\s+['\"]@\/config\/axios['\"]|request\.(get|post|put|patch|delete)|axios\.(get|post|put|patch|delete)|fetch\s*\("
                )
            )
        ),
        ("frontend", "mixed"),
    ),
    Rule(
        "frontend-route-guards",
        "L7",
        "Routing",
        "前端路由层包含导航守卫、鉴权跳转或权限元信息处理。",
        lambda f: f.production
        & f.ext(*SCRIPT_EXTENSIONS)
        & (
            f.path(r"(^|\/)(router|routes|permission)\/", "i")
            | f.body(r"\b(beforeEach|beforeResolve|loader|redirect|Navigate)\b")
        )
        & f.body(r"\b(auth|token|permission|role|requiresAuth|meta)\b", "i"),
        ("frontend", "mixed"),
    ),
    Rule(
        "frontend-permission-controls",
        "L7",
        "Security",
        "前端权限控制通过指令、权限组件或统一工具收敛在横切层。",
        lambda f: f.production & f.security(),
        ("frontend", "mixed"),
    ),
    Rule(
        "frontend-build-config",
        "L8",
        "Build",
        "前端工程通过 Vite/Webpack/Next/Nuxt 等配置文件集中管理构建与别名。",
        lambda f: f.production
        & f.path(
            r"(^|\/)(vite|webpack|next|nuxt|svelte|astro)\.config\.(ts|js|mjs|cjs)$"
        ),
        ("frontend", "mixed"),
    ),
    Rule(
        "react-component-structure",
        "L1",
        "Component",
        "组件文件按功能/路由组织，存在 index 桶文件模式。",
        lambda f: f.production & f.path(r"(^|\/)index\.(tsx|jsx)$"),
        ("react", "nextjs", "mixed"),
        min_medium=3,
    ),
    Rule(
        "react-hooks-pattern",
        "L4",
        "Hooks",
        "项目使用自定义 hooks (useXxx) 封装逻辑。",
        lambda f: f.production & f.path(r"(^|\/)use[A-Z]\w+\.(ts|tsx|js|jsx)$"),
        ("react", "nextjs", "mixed"),
    ),
    Rule(
        "react-state-management",
        "L5",
        "State",
        "使用 Redux/Zustand/Jotai 等状态管理。",
        lambda f: f.production
        & (
            f.path(r"(^|\/)store\/")
            | f.path(r"(^|\/)stores\/")
            | f.body(r"createSlice|configureStore|createStore")
            | f.body(
                r"from\s+['\"](zustand|jotai|valtio|redux)['\"]|create\s*\(\s*\(\s*(set|get|store)"
            )
        ),
        ("react", "nextjs", "mixed"),
    ),
    Rule(
        "react-router",
        "L1",
        "Routing",
        "使用 React Router 进行路由管理。",
        lambda f: f.production
        & (
            f.path(r"(^|\/)router\/")
            | f.path(r"(^|\/)routes\/")
            | f.body(r"createBrowserRouter|Route\s")
        ),
        ("react", "mixed"),
    ),
    Rule(
        "nextjs-app-router",
        "L1",
        "Routing",
        "Next.js 项目使用 app router 的目录约定组织页面、布局和服务端组件。",
        lambda f: f.production
        & f.path(
            r"(^|\/)app\/.+\/(page|layout|loading|error|route)\.(ts|tsx|js|jsx)$"
        ),
        ("nextjs", "mixed"),
    ),
    Rule(
        "react-server-client-boundaries",
        "L4",
        "Rendering",
        "React/Next 组件显式区分 client component、server action 或服务端数据读取边界。",
        lambda f: f.production
        & f.path(r"\.(tsx|jsx|ts|js)$")
        & (
            f.body(r"^['\"]use client['\"]", "m")
            | f.body(r"^['\"]use server['\"]", "m")
            | f.body(r"\bgetServerSideProps\b|\bgetStaticProps\b")
        ),
        ("react", "nextjs", "mixed"),
    ),
    Rule(
        "spring-module-boundaries",
        "L1",
        "Architecture",
        "后端按 Maven/Gradle 多模块和业务域分层组织代码。",
        lambda f: f.production
        & f.path(r"pom\.xml$|build\.gradle$")
        & f.body(r"<module>|plugins\s*\{|dependencies\s*\{"),
        ("java", "spring-boot", "mixed"),
    ),
    Rule(
        "spring-controller-contract",
        "L2",
        "API",
        "后端对外接口通过 Controller/API 层暴露，并使用注解声明路由和参数契约。",
        lambda f: f.production
        & f.path(r"\.java$")
        & f.body(
            r"@(RestController|Controller|RequestMapping|GetMapping|PostMapping)|interface\s+\w+Api\b"
        ),
        ("java", "spring-boot", "mixed"),
    ),
    Rule(
        "java-dto-vo-do-naming",
        "L3",
        "Naming",
        "Java 数据契约采用 DTO/VO/DO/Mapper/Service 等后缀表达职责边界。",
        lambda f: f.production
        & f.path(r"\.java$")
        & f.body(
            r"\b(class|interface|enum)\s+\w+(DTO|ReqVO|RespVO|VO|DO|Mapper|Service|Api|Enum)\b"
        ),
        ("java", "spring-boot", "mixed"),
    ),
    Rule(
        "lombok-models",
        "L3",
        "Typing",
        "Java 模型类使用 Lombok 注解减少样板代码。",
        lambda f: f.production
        & f.path(r"\.java$")
        & f.body(
            r"@(Data|Getter|Setter|Builder|AllArgsConstructor|NoArgsConstructor)"
        ),
        ("java", "spring-boot", "mixed"),
    ),
    Rule(
        "mapper-persistence",
        "L5",
        "Persistence",
        "持久化访问通过 Mapper/ORM 抽象集中处理。",
        lambda f: f.production
        & f.path(r"\.(java|xml)$")
        & (
            f.path(r"Mapper\.java$")
            | f.body(r"BaseMapper|@Mapper|@TableName|JpaRepository|CrudRepository")
        ),
        ("java", "spring-boot", "mixed"),
    ),
    Rule(
        "validation-security",
        "L7",
        "Security",
        "输入校验、认证授权或安全过滤通过框架注解/统一入口处理。",
        lambda f: f.production & f.security(),
        ("java", "spring-boot", "mixed"),
    ),
    Rule(
        "express-route-handlers",
        "L2",
        "API",
        "Node 服务通过 Express/Koa/Fastify 路由或 controller 入口暴露 HTTP API。",
        lambda f: f.production
        & f.path(r"\.(ts|js|mts|mjs|cts|cjs)$")
        & (
            f.path(r"(^|\/)(routes?|controllers?)\/", "i")
            | f.body(r"\b(router|app)\.(get|post|put|patch|delete)\s*\(")
            | f.body(r"\bfastify\.(get|post|put|patch|delete)\s*\(")
        ),
        ("node", "express", "koa", "fastify", "nestjs", "mixed"),
    ),
    Rule(
        "nestjs-module-boundaries",
        "L1",
        "Architecture",
        "NestJS 服务通过 module/controller/service 文件和装饰器表达模块边界。",
        lambda f: f.production
        & f.path(r"\.(ts|js)$")
        & (
            f.path(r"\.(module|controller|service)\.ts$")
            | f.body(r"@(Module|Controller|Injectable)\s*\(")
        ),
        ("nestjs", "mixed"),
    ),
    Rule(
        "node-dto-validation",
        "L3",
        "Typing",
        "Node/TypeScript 接口契约通过 DTO、schema 或运行时校验库表达。",
        lambda f: f.production
        & f.path(r"\.(ts|tsx|js|jsx)$")
        & (
            f.path(r"(^|\/)(dto|schemas?|validators?)\/", "i")
            | f.body(
                r"\b(z\.object|Joi\.object|body\s*\(|param\s*\(|query\s*\(|class-validator|@Is[A-Z]\w*)"
            )
        ),
        ("node", "express", "koa", "fastify", "nestjs", "mixed"),
    ),
    Rule(
        "node-orm-repository",
        "L5",
        "Persistence",
        "Node 数据访问通过 ORM、repository、model 或 prisma/drizzle/schema 层集中处理。",
        lambda f: f.production
        & f.path(r"\.(ts|js|prisma)$")
        & (
            f.path(
                r"(^|\/)(repositories?|models?|entities|prisma|drizzle|schema)\/", "i"
            )
            | f.body(
                r"\b(PrismaClient|drizzle\s*\(|sequelize\.define|mongoose\.model|TypeORM|Repository<)\b"
            )
        ),
        ("node", "express", "koa", "fastify", "nestjs", "mixed"),
    ),
    Rule(
        "node-middleware-security",
        "L7",
        "Security",
        "Node 服务通过 middleware/guard/filter 或安全库集中处理认证、校验和横切逻辑。",
        lambda f: f.production
        & f.path(r"\.(ts|js|mts|mjs|cts|cjs)$")
        & (
            f.path(r"(^|\/)(middlewares?|guards?|interceptors?|filters?)\/", "i")
            | f.body(
                r"\b(passport|helmet|cors|authGuard|CanActivate|UseGuards|middleware)\b",
                "i",
            )
            | f.security()
        ),
        ("node", "express", "koa", "fastify", "nestjs", "mixed"),
    ),
    Rule(
        "python-api-routes",
        "L2",
        "API",
        "Python 服务通过 FastAPI/Flask/Django 路由、view 或 router 暴露 HTTP API。",
        lambda f: f.production
        & f.ext(".py")
        & (
            f.path(r"(^|\/)(views|routers?|api)\.py$")
            | f.body(
                r"(@(?:app|router|bp)\.(get|post|put|patch|delete|route)\s*\(|APIView|ViewSet|path\s*\(|re_path\s*\()"
            )
        ),
        ("python", "mixed"),
    ),
    Rule(
        "python-schema-models",
        "L3",
        "Typing",
        "Python 数据契约通过 Pydantic、dataclass、serializer 或 ORM model 显式建模。",
        lambda f: f.production
        & f.ext(".py")
        & (
            f.path(r"(^|\/)(schemas?|serializers?|models)\.py$")
            | f.body(r"\b(BaseModel|Serializer|dataclass|SQLModel|models\.Model)\b")
        ),
        ("python", "mixed"),
    ),
    Rule(
        "python-service-boundaries",
        "L1",
        "Architecture",
        "Python 代码按 app/service/repository/router 等职责目录组织模块边界。",
        lambda f: f.production
        & f.ext(".py")
        & f.path(
            r"(^|\/)(app|apps|services?|repositories?|routers?|blueprints|handlers)\/",
            "i",
        ),
        ("python", "mixed"),
        8,
        3,
    ),
    Rule(
        "python-persistence-layer",
        "L5",
        "Persistence",
        "Python 数据访问通过 ORM session、repository、model 或 migration 层集中处理。",
        lambda f: f.production
        & f.ext(".py")
        & (
            f.path(r"(^|\/)(repositories?|models|migrations)\/", "i")
            | f.body(
                r"\b(Session|sessionmaker|db\.session|select\s*\(|models\.Model|alembic)\b"
            )
        ),
        ("python", "mixed"),
    ),
    Rule(
        "go-package-boundaries",
        "L1",
        "Architecture",
        "Go 项目通过 cmd/internal/pkg 等目录约定表达可执行入口和内部包边界。",
        lambda f: f.production & f.ext(".go") & f.path(r"(^|\/)(cmd|internal|pkg)\/"),
        ("go", "mixed"),
        8,
        3,
    ),
    Rule(
        "go-http-handlers",
        "L2",
        "API",
        "Go 服务通过 handler/router 目录、net/http 或常见 Web 框架暴露 HTTP API。",
        lambda f: f.production
        & f.ext(".go")
        & (
            f.path(r"(^|\/)(handlers?|routers?|api)\/", "i")
            | f.body(
                r"\b(http\.HandleFunc|http\.NewServeMux|gin\.Default|echo\.New|fiber\.New|chi\.NewRouter)\b"
            )
        ),
        ("go", "mixed"),
    ),
    Rule(
        "go-error-context",
        "L7",
        "Reliability",
        "Go 实现中显式传递 context 并对错误进行早返回处理。",
        lambda f: f.production
        & f.ext(".go")
        & f.body(r"\bcontext\.Context\b")
        & f.body(r"if\s+err\s*!=\s*nil\s*\{"),
        ("go", "mixed"),
        8,
        3,
    ),
    Rule(
        "go-persistence-layer",
        "L5",
        "Persistence",
        "Go 数据访问通过 repository/store/model 或 database/sql、gorm、sqlc 等层收敛。",
        lambda f: f.production
        & f.ext(".go")
        & (
            f.path(r"(^|\/)(repositories?|stores?|models?)\/", "i")
            | f.body(r"\b(sql\.DB|gorm\.DB|sqlc|QueryContext|ExecContext)\b")
        ),
        ("go", "mixed"),
    ),
    Rule(
        "rust-crate-modules",
        "L1",
        "Architecture",
        "Rust crate 通过 lib/main、mod 声明和 src 子模块组织边界。",
        lambda f: f.production
        & f.ext(".rs")
        & (
            f.path(r"^src\/(lib|main)\.rs$")
            | f.body(r"^\s*(pub\s+)?mod\s+\w+;", "m")
        ),
        ("rust", "mixed"),
    ),
    Rule(
        "rust-web-routes",
        "L2",
        "API",
        "Rust Web 服务通过 axum/actix/rocket 路由或 handler 函数暴露 HTTP API。",
        lambda f: f.production
        & f.ext(".rs")
        & (
            f.body(
                r"\b(Router::new|route\s*\(|get\s*\(|post\s*\(|HttpServer::new|App::new)\b"
            )
            | f.body(r"#\[(get|post|put|patch|delete|route)\(")
        ),
        ("rust", "mixed"),
    ),
    Rule(
        "rust-result-error-flow",
        "L7",
        "Reliability",
        "Rust 实现通过 Result、? 操作符或 thiserror/anyhow 形成显式错误流。",
        lambda f: f.production
        & f.ext(".rs")
        & (
            f.body(r"\bResult<[^>]+>")
            | f.body(r"\banyhow::Result\b|\bthiserror\b")
        )
        & f.body(r"\?;|\?\)"),
        ("rust", "mixed"),
        8,
        3,
    ),
    Rule(
        "rust-serde-types",
        "L3",
        "Typing",
        "Rust 数据契约通过 struct/enum 与 serde 派生显式建模。",
        lambda f: f.production
        & f.ext(".rs")
        & f.body(r"#\[derive\([^)]*(Serialize|Deserialize)")
        & f.body(r"\b(pub\s+)?(struct|enum)\s+\w+"),
        ("rust", "mixed"),
    ),
    Rule(
        "dotnet-controller-contract",
        "L2",
        "API",
        ".NET 服务通过 Controller、Minimal API 或路由特性暴露 HTTP API。",
        lambda f: f.production
        & f.ext(".cs")
        & (
            f.body(r"\[(ApiController|Route|HttpGet|HttpPost|HttpPut|HttpDelete)\]")
            | f.body(r"\bapp\.Map(Get|Post|Put|Patch|Delete)\s*\(")
            | f.body(r"Controller\s*:\s*ControllerBase")
        ),
        ("csharp", "dotnet", "mixed"),
    ),
    Rule(
        "dotnet-service-di",
        "L1",
        "Architecture",
        ".NET 项目通过 Program/Startup 的依赖注入注册组织服务边界。",
        lambda f: f.production
        & f.ext(".cs")
        & f.path(r"(^|\/)(Program|Startup)\.cs$")
        & f.body(
            r"\bservices\.Add(Scoped|Singleton|Transient)|builder\.Services\.Add"
        ),
        ("csharp", "dotnet", "mixed"),
    ),
    Rule(
        "dotnet-efcore-persistence",
        "L5",
        "Persistence",
        ".NET 数据访问通过 DbContext、DbSet 或 repository 层集中处理。",
        lambda f: f.production
        & f.ext(".cs")
        & (
            f.path(r"(^|\/)(Repositories?|Data|Entities|Models)\/", "i")
            | f.body(r"\bDbContext\b|\bDbSet<|UseSql(Server|ite)|UseNpgsql")
        ),
        ("csharp", "dotnet", "mixed"),
    ),
    Rule(
        "dotnet-validation-auth",
        "L7",
        "Security",
        ".NET 横切关注点通过授权特性、认证中间件或数据校验特性集中处理。",
        lambda f: f.production
        & f.ext(".cs")
        & (
            f.body(r"\[(Authorize|AllowAnonymous|Required|StringLength|MaxLength)\]")
            | f.body(r"\bUseAuthentication\s*\(|\bUseAuthorization\s*\(")
        ),
        ("csharp", "dotnet", "mixed"),
    ),
    Rule(
        "php-mvc-routes",
        "L2",
        "API",
        "PHP 项目通过 routes/controller 或框架路由方法暴露 HTTP API。",
        lambda f: f.production
        & f.ext(".php")
        & (
            f.path(r"(^|\/)(routes|controllers?)\/", "i")
            | f.body(r"\bRoute::(get|post|put|patch|delete|resource)\s*\(")
            | f.body(r"class\s+\w+Controller\b")
        ),
        ("php", "mixed"),
    ),
    Rule(
        "php-eloquent-models",
        "L5",
        "Persistence",
        "PHP 数据访问通过 Eloquent Model、migration 或 repository 层集中处理。",
        lambda f: f.production
        & f.ext(".php")
        & (
            f.path(r"(^|\/)(Models|migrations|Repositories)\/")
            | f.body(r"extends\s+Model\b|Schema::create|DB::table\s*\(")
        ),
        ("php", "mixed"),
    ),
    Rule(
        "php-request-validation",
        "L7",
        "Security",
        "PHP 输入校验通过 FormRequest、validate/rules 或中间件集中处理。",
        lambda f: f.production
        & f.ext(".php")
        & (
            f.path(r"(^|\/)(Requests|Middleware)\/")
            | f.body(r"function\s+rules\s*\(|->validate\s*\(|'required\|")
        ),
        ("php", "mixed"),
    ),
    Rule(
        "ruby-rails-routes",
        "L2",
        "API",
        "Ruby/Rails 项目通过 routes.rb、controller 或资源路由暴露 HTTP API。",
        lambda f: f.production
        & f.ext(".rb")
        & (
            f.path(r"(^|\/)config\/routes\.rb$")
            | f.path(r"(^|\/)app\/controllers\/")
            | f.body(
                r"\b(resources|namespace|scope|get|post|patch|put|delete)\s+[:'\"]"
            )
        ),
        ("ruby", "rails", "mixed"),
    ),
    Rule(
        "ruby-active-record-models",
        "L5",
        "Persistence",
        "Ruby/Rails 数据访问通过 ActiveRecord model、migration 或 repository 层集中处理。",
        lambda f: f.production
        & f.ext(".rb")
        & (
            f.path(r"(^|\/)app\/models\/")
            | f.path(r"(^|\/)db\/migrate\/")
            | f.body(r"ApplicationRecord|ActiveRecord::Migration")
        ),
        ("ruby", "rails", "mixed"),
    ),
    Rule(
        "ruby-service-objects",
        "L4",
        "Implementation",
        "Ruby 业务逻辑通过 service/job/policy/form 等对象从控制器中拆分。",
        lambda f: f.production
        & f.ext(".rb")
        & f.path(r"(^|\/)app\/(services|jobs|policies|forms)\/"),
        ("ruby", "rails", "mixed"),
    ),
    Rule(
        "test-fixtures",
        "L6",
        "Quality",
        "项目包含自动化测试或测试基类作为回归安全网。",
        lambda f: ~f.path(r"(^|\/)(fixtures?|mocks?)\/", "i")
        & (
            f.path(r"(^|\/)(test|tests|__tests__)\/")
            | f.path(r"\.(spec|test)\.[^.]+$")
            | f.path(r"Test\.java$")
            | f.body(r"^\s*@Test\b", "m")
            | f.body(r"^\s*import\s+.*\s+from\s+['\"](vitest|jest)['\"]", "m")
            | f.body(r"^\s*import\s+.*Mockito", "m")
            | f.body(r"^\s*@ExtendWith\s*\(\s*MockitoExtension\.class\s*\)", "m")
        ),
    ),
    Rule(
        "env-config",
        "L8",
        "Environment",
        "环境差异通过 .env、profile 或配置文件集中管理。",
        lambda f: f.production
        & (
            f.path(r"(^|\/)\.env")
            | f.path(r"(^|\/)(application-|bootstrap).*\.ya?ml$")
            | f.body(
                r"import\.meta\.env|process\.env|os\.environ|std::env|spring\.profiles"
            )
        ),
    ),
    Rule(
        "containerized-runtime",
        "L8",
        "Environment",
        "运行环境通过 Dockerfile、Compose 或容器构建配置描述。",
        lambda f: f.production
        & (
            f.path(r"(^|\/)Dockerfile$")
            | f.path(r"(^|\/)docker-compose\.ya?ml$")
            | f.body(r"^\s*(FROM|services:)\b", "m")
        ),
    ),
    Rule(
        "ci-workflows",
        "L6",
        "Quality",
        "项目包含 CI 工作流或流水线配置作为持续验证入口。",
        lambda f: f.production
        & (
            f.path(r"(^|\/)\.github\/workflows\/.+\.ya?ml$")
            | f.path(r"(^|\/)(\.gitlab-ci|azure-pipelines|Jenkinsfile)")
            | f.body(
                r"\b(actions\/checkout|npm\s+test|mvn\s+test|go\s+test|cargo\s+test|pytest)\b"
            )
        ),
    ),
]


@lru_cache(maxsize=16)
def rule_conditions(rules: tuple[Rule, ...]) -> list[Column]:
    """The rules' predicates over the columns path, extension, content, production, lowered.

    Expressions name columns only, so they are built once and used for any table.
    """
    probe = ColumnProbe(*map(F.col, ("path", "extension", "content", "production", "lowered")))
    return [rule.when(probe) for rule in rules]


def shared_columns() -> dict[str, Column]:
    """The columns ``rule_conditions`` shares, so that no rule computes them again."""
    path = F.col("path")
    return {"production": is_production_file(path), "lowered": F.lower(path)}


def register_rule(
    id: str,
    layer: str,
    category: str,
    summary: str,
    when: Predicate,
    applies_to: tuple[str, ...] = (),
    min_high: int = DEFAULT_MIN_HIGH,
    min_medium: int = DEFAULT_MIN_MEDIUM,
    rules: list[Rule] | None = None,
) -> list[Rule]:
    """The rule set with one more rule (M4); the shipped set is not changed.

    ``when`` may return any boolean ``Column``: built from the probe, from
    ``F.col("path")`` / ``F.col("content")``, or from a pandas UDF over them for
    logic that has no column form.
    """
    base = list(RULES if rules is None else rules)
    if any(rule.id == id for rule in base):
        raise ValueError(f"a rule named {id!r} exists")
    return base + [
        Rule(id, layer, category, summary, when, applies_to, min_high, min_medium)
    ]


def rules_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The rule set as a table; its size is the number of rules, not of files."""
    return spark.createDataFrame(
        [
            (
                r.id,
                r.layer,
                r.category,
                r.summary,
                r.min_high,
                r.min_medium,
                list(r.applies_to),
            )
            for r in (RULES if rules is None else rules)
        ],
        "rule_id string, layer string, category string, summary string,"
        " min_high int, min_medium int, applies_to array<string>",
    )


def normalize_project_type(project_type: Column) -> Column:
    return F.replace(F.lower(rx.trim(project_type)), F.lit("_"), F.lit("-"))


def rule_applies(applies_to: Column, project_type: Column) -> Column:
    """No targets, or one target covers the project type."""
    kind = normalize_project_type(project_type)

    def covers(target: Column) -> Column:
        wanted = normalize_project_type(target)
        return (
            F.when(wanted == "frontend", kind.isin(*FRONTEND_TYPES))
            .when(wanted == "node", kind.isin(*NODE_TYPES))
            .when(wanted == "java", kind.isin(*JAVA_TYPES))
            .when(wanted == "mixed", F.contains(kind, F.lit("mixed")) | (kind == "unknown"))
            .otherwise(kind == wanted)
        )

    return (F.size(applies_to) == 0) | F.exists(applies_to, covers)
