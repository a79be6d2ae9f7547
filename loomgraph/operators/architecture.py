"""What a code base is made of: layers, domains, modules, routes, violations, patterns, roles and features.

Rules are tables of patterns in order, the first that holds counts; every rule is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRESENTATION, LOGIC, DOMAIN, DATA, CORE, UNKNOWN = (
    "Presentation (UI / View)", "Business Logic (State / Services)", "Domain (Entities / UseCases)", "Data & Infrastructure (Repository / DB / API)",
    "Core & Utilities (Config / Common / Router)", "General / Unclassified",
)
#: (layer, folders, file names, words of the text); fixed values.
LAYER_PATTERNS = (
    (PRESENTATION, r"/(presentation|views?|screens?|pages?|widgets?|components?|templates?|dialogs?|ui)/",
     r"(controller|view|screen|page|widget|dialog|fragment|activity|component)\.(dart|java|kt|ts|tsx|js|jsx|vue|php|py)$",
     r"\b(StatefulWidget|StatelessWidget|Widget|Screen|Page|View|Component|Dialog)\b"),
    (DOMAIN, r"/(domain|entities|models?|usecases?|interactors?|contracts?|interfaces?|value_objects?|aggregates?)/",
     r"(entity|model|usecase|interactor|contract|interface|value_object)\.(dart|java|kt|ts|js|php|py|go|rs)$",
     r"\b(Entity|UseCase|Interactor|Aggregate|ValueObject|Contract|DomainModel)\b"),
    (LOGIC, r"/(bloc|cubit|notifiers?|viewmodels?|services?|handlers?|actions?|reducers?|state|events?|store)/",
     r"(bloc|cubit|viewmodel|service|handler|notifier|reducer|store)\.(dart|java|kt|ts|js|php|py|go|rs)$",
     r"\b(Bloc|Cubit|ViewModel|Service|Handler|Notifier|StateNotifier|ChangeNotifier|Reducer)\b"),
    (DATA, r"/(data|repositories|repository|datasources?|dao|dto|api|clients?|network|database|db|queries|migrations?|rest)/",
     r"(repository|datasource|dao|dto|client|api|dao_impl|repository_impl)\.(dart|java|kt|ts|js|php|py|go|rs)$",
     r"\b(Repository|DataSource|Dao|Dto|ApiClient|RestClient|HttpService|DatabaseHelper|SqliteHelper)\b"),
    (CORE, r"/(core|common|utils?|helpers?|configs?|constants?|security|auth|middleware|interceptors?|router|routes?|theme)/",
     r"(config|constant|util|helper|router|route|middleware|interceptor|theme|security)\.(dart|java|kt|ts|js|php|py|go|rs)$",
     r"\b(Config|Constants|AppRouter|Utils|Helper|Middleware|Interceptor|Theme)\b"),
)
#: (layer, folders) for what no pattern knows; fixed values.
LAYER_FOLDERS = (
    (PRESENTATION, ("/ui/", "/widget/", "/screen/", "/page/", "/view/")), (LOGIC, ("/logic/", "/bloc/", "/service/", "/store/", "/action/")),
    (DOMAIN, ("/model/", "/entity/", "/dto/", "/schema/")), (DATA, ("/data/", "/repo/", "/api/", "/db/", "/sql/", "/network/")), (CORE, ("/core/", "/shared/", "/base/", "/util/", "/lib/")),
)
#: Folders and file names of tests and mocks; fixed values.
TEST_FOLDERS = ("test", "tests", "integration_test", "integration_tests", "mock", "mocks", "spec", "specs", "__tests__", "__test__")
#: Controllers of user interfaces, which are no endpoints; fixed values.
UI_CONTROLLERS = (
    "texteditingcontroller", "scrollcontroller", "animationcontroller", "tabcontroller", "pagecontroller", "focusnode", "changenotifier", "valuenotifier", "streamcontroller", "searchcontroller",
    "segmentedbuttoncontroller", "expansiontilecontroller", "undomanager", "statecontroller", "viewcontroller", "uicontroller", "gesturecontroller", "refreshcontroller",
)
#: Main languages by extension; fixed values.
MAIN_LANGUAGES = {
    ".dart": "Dart / Flutter", ".java": "Java (JVM)", ".kt": "Kotlin (Android/JVM)", ".ts": "TypeScript", ".tsx": "TypeScript (React)", ".js": "JavaScript", ".jsx": "JavaScript (React)",
    ".php": "PHP", ".py": "Python", ".go": "Go", ".rs": "Rust", ".cpp": "C++", ".c": "C", ".swift": "Swift", ".cs": "C# (.NET)",
}
#: (language family, framework, what a label or a path holds); fixed values. A list in a place means any, a tuple all.
FRAMEWORKS = (
    ("dart", "BLoC / Cubit State Management", (("label", "bloc"), ("label", "cubit"), ("path", "/bloc/"))), ("dart", "Provider", (("label", "provider"),)),
    ("dart", "GetX", (("label", "getx"), ("path", "get_state"))), ("dart", "Dio / REST API", (("label", "retrofit"), ("label", "dio"), ("path", "http"))),
    ("dart", "Local Storage (SQLite/Hive)", (("label", "hive"), ("label", "sqflite"), ("label", "shared_preferences"))),
    ("java", "Spring Boot Framework", (("path", "spring"), ("label", "@controller"), ("label", "autowired"))),
    ("java", "Spring Data JPA / Hibernate", (("path", "jpa"), ("label", "hibernate"), ("path", "repository"))), ("java", "Security & Auth Gateway", (("path", "security"), ("label", "jwt"), ("label", "otp"))),
    ("script", "NestJS Modular Framework", (("label", "@nestjs"), ("path", "/controllers", "/modules"))), ("script", "React UI Framework", (("path", "react"), ("label", "usestate"), ("label", "useeffect"))),
    ("script", "State Management (Redux/Zustand)", (("path", "redux"), ("path", "zustand"), ("path", "pinia"))),
    ("php", "Laravel MVC Framework", (("label", "eloquent"), ("path", "artisan"), ("path", "app/http/controllers"))), ("php", "Symfony Framework", (("path", "symfony"),)),
    ("python", "FastAPI", (("label", "fastapi"), ("label", "apirouter"))), ("python", "Django Framework", (("path", "django"), ("label", "models.model"))),
    ("python", "SQLAlchemy / SQLite Storage", (("label", "sqlite3"), ("label", "sqlalchemy"))),
)
#: (framework that must be there, or None; whether the clean folders must be; pattern), first match; fixed values.
PATTERNS = (
    ("BLoC / Cubit State Management", True, "Flutter BLoC Clean Architecture (Feature-First)"), ("BLoC / Cubit State Management", False, "BLoC / Event-Driven State Architecture"),
    ("Spring Boot Framework", False, "Layered MVC & Enterprise Service Architecture (Spring Boot)"), ("NestJS Modular Framework", False, "Modular Microservice / Hexagonal Architecture (NestJS)"),
    ("React UI Framework", False, "Component-Driven Client Architecture (React SPA)"), ("Laravel MVC Framework", False, "Action-Domain-Responder / Model-View-Controller (Laravel PHP)"),
    ("FastAPI", False, "Asynchronous API & Service Layer Architecture (FastAPI)"), (None, True, "Clean Architecture / Onion Layered Architecture"),
)
#: Roles by what path and name hold; fixed values.
ROLES = (
    ("Admin (Quản trị hệ thống)", ("/admin", "admincontroller", "admin/")), ("ServiceProvider (Đối tác / Merchant)", ("/sp", "/partner", "/merchant", "partnercontroller")),
    ("System Integration (Webhook / External Caller)", ("/webhook", "webhookcontroller", "webhook")), ("API Client / External System", ("/api", "apicontroller", "restcontroller")),
)
OTHER_ROLE = "EndUser (Người dùng cuối / Khách hàng)"
#: Feature types by what a method's name holds; fixed values.
FEATURES = (
    ("CRUD - Danh sách & Tra cứu (List/Search)", ("index", "list", "search", "getall", "find")), ("CRUD - Xem chi tiết (Detail/View)", ("show", "detail", "getbyid", "findbyid")),
    ("CRUD - Thêm mới (Create/Store)", ("create", "store", "add", "insert", "register")), ("CRUD - Cập nhật (Update/Edit)", ("edit", "update", "patch", "modify")),
    ("CRUD - Xóa / Hủy (Delete/Cancel)", ("destroy", "delete", "remove", "cancel")), ("Export - Xuất dữ liệu báo cáo", ("export", "download", "excel", "csv")),
    ("Import - Nhập dữ liệu từ file", ("import", "upload")), ("StatusChange - Chuyển đổi trạng thái / Phê duyệt", ("approve", "reject", "lock", "unlock", "activate", "deactivate", "status")),
)
MONEY_FEATURE, OTHER_FEATURE = "Business Transaction - Giao dịch thanh toán / Hạn mức", "Custom - Xử lý nghiệp vụ đặc thù"
#: Related features: (category, risk, words of which one must be there, words of which one must be there too); fixed values.
RELATED = (
    ("WEBHOOK", "HIGH", ("webhook",), ()), ("SYNC", "HIGH", ("sync",), ("subscriber", "user", "data")), ("CRON", "MEDIUM", ("@scheduled", "cron", "scheduler", "runjob"), ()),
    ("OBSERVER", "HIGH", ("@eventlistener", "@transactionaleventlistener", "observer", "eventpublisher"), ()), ("QUEUE", "HIGH", ("@kafkalistener", "@rabbitlistener", "sqslistener", "consumermessage"), ()),
    ("NOTIFICATION", "MEDIUM", ("sendsms", "sendemail", "pushnotification", "mailservice"), ()),
)


def first_of(rules: list[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def layer_of(path: Column, label: Column, keywords: Column | None = None) -> Column:
    """The layer of a node by its lower-case path and its label. Keywords stand character by character in the text, so that
    no word of them is found, as in the graph's own rule."""
    low, name = F.lower(_text(path)), _text(label)
    spaced = F.lit("") if keywords is None else F.array_join(F.split(F.lower(F.concat_ws(" ", keywords)), ""), " ")
    text = F.concat_ws(" ", low, name, spaced)
    rules = []
    for layer, folders, files, words in LAYER_PATTERNS:
        hit = F.lit(False)
        for hay in (text, low, name):
            hit = hit | F.rlike(hay, F.lit(f"(?i){folders}")) | F.rlike(hay, F.lit(f"(?i){files}")) | F.rlike(hay, F.lit(words))
        rules.append((hit, layer))
    rules += [(holds(low, folders), layer) for layer, folders in LAYER_FOLDERS]
    return first_of(rules, UNKNOWN)


def is_test_or_mock(path: Column) -> Column:
    low = F.lower(F.regexp_replace(_text(path), r"\\", "/"))
    folders = F.rlike(low, F.lit(rf"(^|/)({'|'.join(TEST_FOLDERS)})/"))
    name = F.element_at(F.split(low, "/"), -1)
    return folders | F.rlike(name, F.lit(r"^(test_|mock_)|_test\.|\.spec\.|\.test\.|_mock\.|-test\.|-spec\.|(_test|_spec)$"))


def title(words: Column) -> Column:
    """Blanks for - and _, and every run of letters with one capital."""
    runs = F.regexp_extract_all(F.regexp_replace(words, "[-_]", " "), F.lit("\\p{L}+|[^\\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.initcap(x)), "")


def domain_of(path: Column) -> Column:
    """Business domain: what stands after a feature folder, else the first folder of a source root, else the file's folder."""
    parts = F.filter(F.split(_text(path), "/"), lambda p: (p != "") & (p != "."))
    low = F.transform(parts, lambda p: F.lower(p))
    rules = [(_text(path) == "", F.lit("Global / Root Domain"))]
    for marker in ("features", "modules", "domains", "services", "components", "pages", "apps"):
        at = F.array_position(low, marker)
        rules.append(((at > 0) & (at < F.size(parts)), F.concat(title(F.get(parts, at.cast("int"))), F.lit(" Domain"))))
    for root in ("lib", "src", "app"):
        at = F.array_position(low, root)
        folder = F.get(parts, at.cast("int"))
        name = F.when(F.lower(folder).isin("core", "shared", "common", "utils", "config"), "Core & Shared Domain").otherwise(F.concat(title(folder), F.lit(" Domain")))
        rules.append(((at > 0) & (at + 1 < F.size(parts)), name))
    parent = F.get(parts, F.size(parts) - 2)
    return first_of([*rules, ((F.size(parts) > 1) & (parent != ""), F.concat(title(parent), F.lit(" Module")))], "General Domain")


def domain_category(name: Column) -> Column:
    low = F.lower(name)
    return first_of([
        (holds(low, ("core", "common", "shared", "util", "infrastructure", "network", "config")), "Generic / Infrastructure Domain"),
        (holds(low, ("auth", "login", "user", "profile", "setting", "notification")), "Supporting Domain"),
    ], "Core Business Domain")


def domains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """domain, category, node_count, file_count, sample_symbols (6 by id), cohesion, dependencies (6 by name).

    Edges are reduced to pairs of domains before anything else, so the rest works on as many rows as there are pairs.
    """
    of = nodes.select("id", "path", "kind", "label", domain_of(F.col("path")).alias("domain"))
    place = Window.partitionBy("domain").orderBy("id")
    samples = of.where("kind <> 'file'").withColumn("n", F.row_number().over(place)).where("n <= 6").groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("n", "label"))).alias("s"))
    counts = of.groupBy("domain").agg(F.count(F.lit(1)).alias("node_count"), F.count_distinct(F.when(_text(F.col("path")) != "", F.col("path"))).alias("file_count"))
    ends = lambda end, name: of.select(F.col("id").alias(end), F.col("domain").alias(name))
    pairs = edges.join(ends("src", "a"), "src").join(ends("dst", "b"), "dst").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    inner = pairs.where("a = b").select(F.col("a").alias("domain"), F.col("n").alias("inside"))
    outer = pairs.where("a <> b").select(F.explode(F.array("a", "b")).alias("domain"), "n").groupBy("domain").agg(F.sum("n").alias("outside"))
    deps = pairs.where("a <> b").groupBy(F.col("a").alias("domain")).agg(F.slice(F.sort_array(F.collect_set("b")), 1, 6).alias("dependencies"))
    x = counts.join(samples, "domain", "left").join(inner, "domain", "left").join(outer, "domain", "left").join(deps, "domain", "left")
    i, o = F.coalesce("inside", F.lit(0)), F.coalesce("outside", F.lit(0))
    none = F.array().cast("array<string>")
    return x.select(
        "domain", domain_category(F.col("domain")).alias("category"), "node_count", "file_count", F.coalesce(F.transform("s", lambda z: z["label"]), none).alias("sample_symbols"),
        F.when(i + o > 0, F.round(i / (i + o), 2)).otherwise(1.0).alias("cohesion"), F.coalesce("dependencies", none).alias("dependencies"),
    )


def module_category(name: Column, category: Column) -> Column:
    low = F.lower(name)
    return first_of([
        (F.contains(category, F.lit("Core")), "Core Business"), (F.contains(category, F.lit("Supporting")), "Supporting & Service"),
        (holds(low, ("api", "gateway", "router", "controller", "webhook")), "Integration & Gateway"), (holds(low, ("ui", "page", "widget", "screen", "view")), "UI / Presentation"),
    ], "Platform & Infrastructure")


def functional_modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """domain, category, core_entities and entrypoints (5 each, by id of their first node; else 4 of the sample symbols)."""
    d = domains(nodes, edges)
    of = nodes.where("kind <> 'file' and path <> ''").select("id", "label", domain_of(F.col("path")).alias("domain"), layer_of(F.col("path"), F.col("label")).alias("layer"))
    low = F.lower("label")
    entity = F.col("layer").isin(DOMAIN, DATA) & holds(low, ("class", "struct", "model", "entity", "dto", "schema", "table"))
    entry = F.col("layer").isin(PRESENTATION, LOGIC) & holds(low, ("controller", "page", "screen", "router", "handler", "bloc", "cubit", "service", "callback"))
    role = F.when(entity, "entity").when(entry, "entry")
    named = of.withColumn("role", role).where("role is not null").groupBy("domain", "role", "label").agg(F.min("id").alias("id"))
    place = Window.partitionBy("domain", "role").orderBy("id")
    top = named.withColumn("n", F.row_number().over(place)).where("n <= 5").groupBy("domain").pivot("role", ["entity", "entry"]).agg(F.array_sort(F.collect_list(F.struct("n", "label"))))
    labels = lambda c: F.transform(c, lambda z: z["label"])
    some = lambda words: F.slice(F.filter("sample_symbols", lambda s: holds(F.lower(s), words)), 1, 4)
    x = d.join(top, "domain", "left")
    pick = lambda c, words: F.when(F.size(c) > 0, labels(c)).otherwise(some(words))
    return x.select(
        "domain", module_category(F.col("domain"), F.col("category")).alias("category"), "node_count",
        pick("entity", ("model", "data", "entity", "result", "item", "order", "user", "info", "state")).alias("core_entities"),
        pick("entry", ("page", "bloc", "service", "ctrl", "controller", "router", "helper", "action")).alias("entrypoints"), "dependencies",
    )


def layer_breakdown(nodes: DataFrame) -> DataFrame:
    """layer, node_count, file_count of all layers, those without nodes too."""
    every = nodes.sparkSession.createDataFrame([(x,) for x in (PRESENTATION, LOGIC, DOMAIN, DATA, CORE, UNKNOWN)], "layer string")
    of = nodes.select("id", "path", layer_of(F.col("path"), F.col("label")).alias("layer"))
    n = of.groupBy("layer").agg(F.count(F.lit(1)).alias("node_count"), F.count_distinct(F.when(_text(F.col("path")) != "", F.col("path"))).alias("file_count"))
    return every.join(n, "layer", "left").fillna(0)


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """violation, severity, from_path, to_path: distinct pairs of places whose layers depend the wrong way."""
    of = nodes.select("id", F.when(_text(F.col("path")) != "", F.col("path")).otherwise(F.col("label")).alias("place"), layer_of(F.col("path"), F.col("label")).alias("layer"))
    a, b = of.select(F.col("id").alias("src"), F.col("place").alias("from_path"), F.col("layer").alias("la")), of.select(F.col("id").alias("dst"), F.col("place").alias("to_path"), F.col("layer").alias("lb"))
    kind = F.when((F.col("la") == PRESENTATION) & (F.col("lb") == DATA), "LAYER_BYPASS").when(F.col("la").isin(DATA, DOMAIN) & (F.col("lb") == PRESENTATION), "INVERTED_DEPENDENCY")
    found = edges.select("src", "dst").join(a, "src").join(b, "dst").select(kind.alias("violation"), "from_path", "to_path").where("violation is not null").distinct()
    return found.select("violation", F.when(F.col("violation") == "LAYER_BYPASS", "MEDIUM").otherwise("HIGH").alias("severity"), "from_path", "to_path")


def stack(nodes: DataFrame) -> DataFrame:
    """One row: language, frameworks, pattern, by the most frequent extension and by what labels and paths hold."""
    low = lambda c: F.lower(_text(F.col(c)))
    checks = {}
    for k, (_, _, alternatives) in enumerate(FRAMEWORKS):
        for j, (place, *words) in enumerate(alternatives):
            for i, w in enumerate(words):
                checks[f"c{k}_{j}_{i}"] = F.max(F.contains(low(place), F.lit(w)))
    clean = F.max(holds(low("path"), ("/presentation/", "/domain/", "/data/")))
    flags = nodes.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()], F.coalesce(clean, F.lit(False)).alias("clean"))
    ext = F.lower(F.regexp_extract(F.col("path"), r"[^/](\.[^./]+)$", 1))
    top = nodes.select(ext.alias("ext")).where("ext <> ''").groupBy("ext").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("ext", F.struct(-F.col("n"), "ext")).alias("ext"))
    language = first_of([(F.col("ext") == e, x) for e, x in MAIN_LANGUAGES.items()], "Multi-language / General")
    x = flags.crossJoin(top).withColumn("language", F.when(F.col("ext").isNull(), "Python").otherwise(language))  # single rows
    name = F.lower("language")
    family = {
        "dart": F.contains(name, F.lit("dart")), "java": (F.contains(name, F.lit("java")) | F.contains(name, F.lit("kotlin"))), "script": F.contains(name, F.lit("typescript")),
        "php": F.contains(name, F.lit("php")), "python": F.contains(name, F.lit("python")),
    }
    found = []
    for k, (fam, framework, alternatives) in enumerate(FRAMEWORKS):
        any_ = F.lit(False)
        for j, (_, *words) in enumerate(alternatives):
            all_ = F.lit(True)
            for i in range(len(words)):
                all_ = all_ & F.col(f"c{k}_{j}_{i}")
            any_ = any_ | all_
        found.append(F.when(family[fam] & any_, framework))
    x = x.withColumn("frameworks", F.array_compact(F.array(*found))).withColumn("clean", F.col("clean") & family["dart"])
    rules = [((F.array_contains("frameworks", f) if f else F.lit(True)) & (F.col("clean") if must else F.lit(True)), F.lit(p)) for f, must, p in PATTERNS]
    return x.select("language", "frameworks", first_of(rules, F.concat(F.lit("Modular Layered Architecture ("), "language", F.lit(")"))).alias("pattern"))


def routes(nodes: DataFrame, include_tests: bool = False) -> DataFrame:
    """route_type, route, method, guard, path, label, line of endpoints, pages and events; one a path and label."""
    n = nodes.where("path <> '' and kind <> 'file'")
    if not include_tests:
        n = n.where(~is_test_or_mock(F.col("path")))
    n = n.withColumn("layer", layer_of(F.col("path"), F.col("label")))
    label, low, place = F.col("label"), F.lower("label"), F.lower("path")
    bare = F.trim(F.element_at(F.split(F.regexp_replace(label, r"^(class|def|async def|function|method)\s+", ""), r"\("), 1))
    page_folders = ("/page/", "/pages/", "/screen/", "/screens/", "/views/", "/ui/", "/widgets/", "/components/")
    no_ui = (F.col("layer") != PRESENTATION) & ~holds(low, UI_CONTROLLERS) & ~holds(place, ("/widgets/", "/components/", "/views/", "/pages/", "/screens/", "/ui/", "lib/src/widgets", "/templates/"))
    serves = holds(place, ("controller", "router", "openapi", "endpoints", "api/", "routes/", "views.py", "endpoints.py", "controllers/")) | holds(low, ("controller", "router"))
    public = ~F.startswith(bare, F.lit("_")) | bare.isin("_authenticate", "_authenticate_bearer", "_config", "_ok", "_err")
    http = no_ui & serves & holds(low, ("def ", "async def ", "function ", "method ", "class ")) & public & ~F.lower(bare).isin(*UI_CONTROLLERS)
    method = first_of([(holds(low, ("post", "create", "insert", "upload", "callback", "upsert", "write")), "POST"), (holds(low, ("get", "list", "fetch", "query", "find", "search", "read")), "GET")], "ANY")
    page = F.trim(F.element_at(F.split(F.trim(F.regexp_replace(label, r"^class\s+", "")), r"\s+"), 1))
    ui = ((F.col("layer") == PRESENTATION) | holds(place, page_folders)) & holds(low, ("page", "screen", "view", "dialog", "widget")) & holds(low, ("class ", "widget"))
    ui = ui & (~F.startswith(page, F.lit("_")) | F.endswith(page, F.lit("Page")))
    page_route = F.concat(F.lit("/"), F.replace(F.replace(F.lower(F.regexp_replace(page, r"(?<!^)(?=[A-Z])", "_")), F.lit("_page"), F.lit("")), F.lit("_screen"), F.lit("")))
    event_name = F.trim(F.element_at(F.split(F.regexp_replace(label, r"^(class|def|function)\s+", ""), r"\("), 1))
    event = holds(low, ("event", "state", "action", "mutation", "signal", "listener")) & holds(low, ("class ", "def ", "function ")) & (event_name != "")
    guarded = lambda words, yes, no: F.when(holds(place, words) | holds(low, words), yes).otherwise(no)
    one = lambda kind, route, how, guard: F.struct(F.lit(kind).alias("route_type"), route.alias("route"), how.alias("method"), guard.alias("guard"))
    kinds = F.array_compact(F.array(
        F.when(http, one("HTTP_API", F.concat(F.lit("/"), F.replace(bare, F.lit("_"), F.lit("/"))), method, guarded(("auth", "admin", "token", "secure", "guard"), "Bearer / Session Auth", "Public / None"))),
        F.when(ui, one("UI_PAGE", page_route, F.lit("PAGE_ROUTE"), guarded(("admin", "client", "auth", "secure", "verify"), "Authenticated Route", "Standard Page"))),
        F.when(event, one("EVENT_DISPATCH", F.concat(F.lit("Event::"), event_name), F.lit("EVENT_EMIT"), F.lit("Domain Scope"))),
    ))
    x = n.select("id", "path", "label", F.coalesce("line_start", F.lit(1)).alias("line"), F.explode(kinds).alias("r")).select("id", "path", "label", "line", "r.*")
    return x.groupBy("route_type", "path", "label").agg(F.min_by(F.struct("route", "method", "guard", "line"), "id").alias("r")).select("route_type", "path", "label", "r.*")


def role_of(path: Column, name: Column) -> Column:
    text = F.lower(F.concat_ws("/", _text(path), _text(name)))
    return first_of([(holds(text, words), role) for role, words in ROLES], OTHER_ROLE)


def feature_type(method: Column, body: Column) -> Column:
    m = F.lower(_text(method))
    money = F.contains(F.lower(_text(body)), F.lit("bccs")) | holds(m, ("deduct", "payment", "transfer"))
    return first_of([*[(holds(m, words), kind) for kind, words in FEATURES], (money, MONEY_FEATURE)], OTHER_FEATURE)


def feature_inventory(nodes: DataFrame, module: str = "", most: int = 100) -> DataFrame:
    """role, type, symbol, path, line of the first callables of a module, by path, line and id; private ones not."""
    n = nodes.where(F.contains("path", F.lit(module)) & F.col("kind").isin("function", "method", "class", "struct")).orderBy("path", "line_start", "id").limit(most)
    n = n.where((_text(F.col("symbol")) != "") & ~F.startswith("symbol", F.lit("_")))
    return n.select(role_of(F.col("path"), F.col("symbol")).alias("role"), feature_type(F.col("symbol"), F.col("body")).alias("type"), "symbol", "path", F.coalesce("line_start", F.lit(1)).alias("line"))


def related_features(nodes: DataFrame, module: str = "", seen: int = 200, most: int = 10) -> DataFrame:
    """category, risk, symbol, path of features that run beside the main flow, one a name; of the first nodes of the module
    by id, and the first of those."""
    n = nodes.where(F.contains("path", F.lit(module)) & (F.col("kind") != "file")).orderBy("id").limit(seen)
    text = F.lower(F.concat_ws(" ", "path", _text(F.col("symbol")), _text(F.col("body"))))
    rules = [(holds(text, words) & (holds(text, more) if more else F.lit(True)), F.struct(F.lit(c).alias("category"), F.lit(r).alias("risk"))) for c, r, words, more in RELATED]
    x = n.select("id", "symbol", "path", first_of(rules).alias("f")).where("f is not null").select("id", "symbol", "path", "f.*")
    once = x.groupBy("category", "symbol").agg(F.min_by(F.struct("id", "path", "risk"), "id").alias("r"))
    return once.select("r.id", "category", "r.risk", "symbol", "r.path").orderBy("id").limit(most)


def service_of(steps: DataFrame, nodes: DataFrame, module: str) -> str:
    """The service a solution is about: a stored step's that the module names, else the most frequent, else a service node."""
    found = steps.where(F.contains(F.lower("service_symbol"), F.lit(module.lower()))) if module else steps
    top = found.groupBy("service_symbol").count().orderBy(F.desc("count"), "service_symbol").limit(1).collect()  # one row
    if not top:
        top = nodes.where((F.col("kind") == "service") & F.contains("path", F.lit(module))).select("symbol").orderBy("id").limit(1).collect()
    return top[0][0] if top else ""
