"""Categories of code hints, as column expressions over node_kind, text and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"

#: Names of categories, with what they hold.
CATEGORIES = {
    "async_patterns": "asynchronous calls and awaits",
    "class_hierarchy": "classes, interfaces and implementations",
    "collection_pipelines": "chains over collections",
    "comprehensions": "comprehensions and generator expressions",
    "concurrency": "parallel tasks and channels",
    "data_access": "reads and writes of stores and services",
    "decorators": "decorators",
    "error_handling": "errors raised, matched and caught",
    "framework_hooks": "hooks of component frameworks",
    "http_routing": "routes of web servers",
    "logging": "diagnostic output",
    "null_safety": "guards against missing values",
    "resource_management": "resources acquired and released",
    "schema_validation": "schemas and validators",
    "serialization": "values turned into text or bytes and back",
    "state_management": "closures over state",
    "state_store": "shared state containers",
    "testing": "tests and expectations",
    "type_assertions": "casts",
}

#: Categories that follow from a node kind alone.
NODE_KINDS = {
    "async_patterns": ["await_expression"],
    "class_hierarchy": ["class_declaration", "class_definition", "abstract_class_declaration", "interface_declaration", "impl_item"],
    "comprehensions": ["dictionary_comprehension", "generator_expression", "list_comprehension", "set_comprehension"],
    "concurrency": ["go_statement", "select_statement"],
    "data_access": ["call_expression", "call"],
    "decorators": ["decorator", "decorated_definition"],
    "error_handling": ["try_statement", "try_expression", "match_expression", "except_clause", "catch_clause", "throw_statement"],
    "null_safety": ["optional_chain", "non_null_expression"],
    "resource_management": ["macro_invocation", "with_statement", "defer_statement", "try_with_resources_statement"],
    "state_management": ["closure_expression"],
    "type_assertions": ["as_expression", "type_cast_expression"],
}

TSJS = ("typescript", "javascript")
#: Patterns over the text of calls, in order of precedence: category, languages, pattern.
CALLS = (
    ("async_patterns", TSJS, r"\.(then|catch|finally)\("),
    ("testing", TSJS, r"^(describe|it|test|xit|xdescribe|fdescribe|fit|context|beforeEach|afterEach|beforeAll|afterAll|expect)\("),
    ("testing", TSJS, r"^(jest|vi)\.(fn|mock|spyOn|clearAllMocks|resetAllMocks|useFakeTimers)\("),
    ("testing", ("go",), r"\bt\.(Run|Error|Errorf|Fatal|Fatalf|Helper|Skip|Skipf|Log|Logf|Cleanup|Parallel)\("),
    ("testing", ("python",), r"\bself\.assert[A-Z]\w*\("),
    ("serialization", TSJS, r"^(JSON\.(parse|stringify)\(|structuredClone\()"),
    ("serialization", ("python",), r"^(json|pickle)\.(loads|dumps|load|dump)\("),
    ("serialization", ("go",), r"^json\.(Marshal|Unmarshal|MarshalIndent|NewEncoder|NewDecoder)\("),
    ("schema_validation", TSJS, r"^(z|yup|v|s)\.\w|\.safeParse\("),
    ("schema_validation", ("python",), r"\bField\(|\bconstr\(|\bconint\("),
    ("state_store", TSJS, r"^(createSlice|configureStore|createStore|combineReducers|createAsyncThunk|createReducer|createAction|createSignal|createEffect|createMemo|createResource)\(|^use(Selector|Dispatch|Store)\b|^create\(|^(atom|selector|atomFamily|selectorFamily)\(|^(observable|action|computed|makeObservable|makeAutoObservable|runInAction|signal|effect|batch)\("),
    ("framework_hooks", TSJS, r"^use[A-Z]"),
    ("http_routing", TSJS, r"^(app|router|fastify|server|srv)\.(get|post|put|delete|patch|head|options|all|use|route)\("),
    ("http_routing", ("go",), r"^(http|mux|r|e|router|engine|g|rg)\.(HandleFunc|Handle|GET|POST|PUT|DELETE|PATCH|Any|Group)\("),
    ("http_routing", ("python",), r"\.add_url_rule\("),
    ("logging", TSJS, r"^(console|logger|log)\."),
    ("logging", ("python",), r"^(logging\.|print\b)"),
    ("logging", ("go",), r"^fmt\.(Print|Println|Printf|Errorf|Fprint|Sprint)"),
    ("logging", ("java",), r"^(System\.(out|err)\.|logger\.|Log\.|LOG\.)"),
    ("logging", ("rust",), r"^(tracing|log)::|^(println|eprintln|print|eprint|dbg)!"),
    ("data_access", (*TSJS, "go"), r"^(fetch|axios)\b|\b(query|read|write|get|post|put|delete|patch)\(|\b(db|sql)\.|\.(query|read|write|fetch)\("),
    ("data_access", ("python",), r"^(open\(|requests\.|httpx\.|cursor\.|session\.|conn\.)"),
    ("collection_pipelines", (*TSJS, "go", "java"), r"\.(map|filter|reduce|flatMap|forEach|find|findIndex|some|every|flat)\("),
    ("concurrency", TSJS, r"^Promise\.(all|allSettled|race|any)\("),
    ("concurrency", ("python",), r"^asyncio\.(gather|create_task|wait|as_completed|run)\("),
)
RUST_LOGGING = next(p for c, langs, p in CALLS if c == "logging" and langs == ("rust",))


def node_kind_category(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for category, kinds in NODE_KINDS.items():
        out = F.when(kind.isin(*kinds), category).otherwise(out)
    return out


def call_matches(text: Column, language: Column) -> Column:
    """All categories whose patterns a call's text matches, in order of precedence; the first one is its category."""
    found = [F.when(language.isin(*languages) & F.coalesce(text, F.lit("")).rlike("(?U)" + pattern), category) for category, languages, pattern in CALLS]
    return F.array_distinct(F.filter(F.array(*found), lambda c: c.isNotNull()))


def hint_category(kind: Column, text: Column, language: Column) -> Column:
    """The category of a hint, or null. Patterns are found anywhere, with Unicode words."""
    text = F.coalesce(text, F.lit(""))
    call = F.when(F.lit(False), F.lit(None).cast("string"))
    for category, languages, pattern in CALLS:
        call = call.when(language.isin(*languages) & text.rlike("(?U)" + pattern), category)
    macro = F.when((language == "rust") & text.rlike("(?U)" + RUST_LOGGING), "logging").otherwise("resource_management")
    return F.when(kind.isin("call_expression", "call"), call).when(kind == "macro_invocation", macro).otherwise(node_kind_category(kind))


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(SCHEMA_VERSION, n, d) for n, d in sorted(CATEGORIES.items())], "schema_version string, name string, description string")
