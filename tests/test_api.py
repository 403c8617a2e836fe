"""The façade over a small project."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.api import Corpus

FILES = {
    "lib/main.dart": "import 'presentation/home.dart';\nvoid main() {\n  runApp(Home());\n}\n",
    "lib/presentation/home.dart": "import '../domain/user.dart';\nimport 'package:me/data/repo.dart';\nclass Home extends StatelessWidget {\n  Widget build(BuildContext context) {\n    return Column(\n      children: [\n        Text('Hello'),\n      ],\n    );\n  }\n  void onTap() {\n    load();\n  }\n}\n",
    "lib/domain/user.dart": "import '../data/repo.dart';\nclass User {\n  final String name;\n  User(this.name);\n}\n",
    "lib/data/repo.dart": "import '../domain/user.dart';\nclass Repo {\n  // TODO: cache\n  User load() => User('x');\n}\n",
    "l10n/app_en.arb": json.dumps({"@@locale": "en", "hi": "Hi {name}", "bye": "Bye"}),
    "l10n/app_de.arb": json.dumps({"@@locale": "de", "hi": "Hallo {nme}"}),
    "pubspec.yaml": "name: me\ndependencies:\n  http: ^1.0.0\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content string").cache()


@pytest.mark.parametrize("dialect", ["rs", "ts"])
def test_every_query_runs(spark, files, dialect):
    c = Corpus(files, dialect, "me").cached()
    assert c.search("Home").first()["name"] == "Home"
    assert {r["node"]: r["hops"] for r in c.impact_analysis("lib/data/repo.dart").collect()} == {"lib/presentation/home.dart": 1, "lib/domain/user.dart": 1, "lib/main.dart": 2}
    assert c.circular_dependencies().first()["nodes"] == ["lib/data/repo.dart", "lib/domain/user.dart", "lib/data/repo.dart"]
    assert c.node_at_cursor("lib/presentation/home.dart", 12).first()["name"] == "onTap"
    assert "load();" in c.code_block("onTap").first()["source"] and c.read_fragment("Repo").count() > 0
    assert {r["layer"]: r["files"] for r in c.architectural_layers().collect()}["domain"] == 1
    assert ("lib/domain/user.dart", "lib/data/repo.dart") in {(r["src"], r["dst"]) for r in c.layer_violations().collect()} or dialect == "ts"
    assert ("Domain Purity" if dialect == "rs" else "Domain Layer Isolation") in {r["rule"] for r in c.validate_architecture().collect()}
    assert c.detect_mockups().count() == 1 and {r["value"] for r in c.code_warnings().collect()} == {"Hello"} | ({"// TODO: cache"} if dialect == "ts" else set())
    nodes, edges = c.detailed_graph("lib/main.dart")
    assert nodes.count() >= 3 and edges.where("type = 'imports'").count() >= 1
    every = {(r["src"], r["dst"], r["type"]) for r in c.detailed_graph()[1].collect()}
    assert {("class:Home", "method:Home.onTap", "contains"), ("class:Home", "class:StatelessWidget", "extends"), ("file:lib/main.dart", "func:main", "contains")} <= every
    assert [r["key"] for r in c.missing_translations().collect()] == ["bye"] and c.validate_icu().count() == 1
    assert c.missing_payload().first()["locales"] == "de" and c.unused_translations().count() == (1 if dialect == "rs" else 2) and c.list_translations("de").count() == 1
    assert c.packages().first()["name"] == "http" and c.pubspec().count() == 1 and c.stats().first()["files"] == 7 and c.index_status().count() == 1
    assert {r["name"] for r in c.widget_outline().collect()} == {"Column"} | ({"Text"}) and c.widget_depth(1).count() == 1 and c.duplicate_widgets().count() == 0
    assert c.dependencies("lib/main.dart").first()["target"] == "lib/presentation/home.dart" and c.reverse_deps("lib/presentation/home.dart").first()["path"] == "lib/main.dart"
    assert c.find_references("Repo").count() >= 1 and c.search_text("hello").count() == 1 and c.direct_search("repo").count() >= 1
    assert c.read_lines("lib/main.dart", 2, 3).count() == 2 and c.file_info("lib/main.dart").count() >= 2 and c.outline().count() >= 3
    assert json.loads(c.parse_ast("lib/main.dart").first()["ast"])[0]["kind"] == "import"
    assert c.logic_flow("onTap").count() == 0 and c.memory_leaks().count() == 0 and c.duplicate_logic().count() == 0
    assert c.git_blast_radius(["lib/data/repo.dart", "lib/main.dart"]).where("hops = 0").count() == 2
    assert c.edit_file("lib/main.dart", "Home()", "App()").where("content like '%App()%'").count() == 1
    assert c.replace_lines("lib/main.dart", 1, 1, "").first()["content"].startswith("void")
    assert c.project_structure().where("path = 'lib'").first()["n"] == 4 and c.hints("symbol").count() == 1
    fresh = spark.createDataFrame([("lib/new.dart", "class New {}\n")], "path string, content string")
    assert c.write_files(fresh).search("New").first()["name"] == "New" and c.under("lib").files.count() == 4
    assert c.update_translations(spark.createDataFrame([("de", "bye", "Tschüss")], "locale string, key string, value string")).where("key = 'bye'").count() == 2
    assert c.delete_translation("hi").count() == 1 and c.generate_messages().count() == 2
    out = spark.createDataFrame([("lib/a.dart:3: error: x",)], "text string")
    assert c.diagnostics(out, "a.dart").count() == 1 and c.search_packages(files, "class").count() >= 1
    assert c.unused_assets(spark.createDataFrame([("assets/a.png", 1)], "path string, size int")).count() == 1
    assert c.asset_report(spark.createDataFrame([("assets/a.png", 1)], "path string, size int")).first()["bytes"] == 1
    assert c.code_warnings("text", "hell", "HOME").count() == 1 and c.code_warnings("color").count() == 0
    assert c.widget_depth(1).first()["deepest"] == ("Column > Text" if dialect == "rs" else "Column -> Text")
    assert c.quick_search("repo").first()["usage_count"] >= 0 and c.users_of("User", "class").count() >= 1
    assert c.graph_stats().first()["most_imported"] == "lib/data/repo.dart"
    assert c.runtime_errors(spark.createDataFrame([("s", 1, "Error", "m")], "stream string, ts int, kind string, message string")).count() == 1
    assert {r["node"]: r["component"] for r in c.import_components().collect()}["lib/domain/user.dart"] == "lib/data/repo.dart"
    assert {r["node"]: r["risk"] for r in c.import_risk().collect()}["lib/data/repo.dart"] == "medium"
    assert {r["line"]: r["parent_line"] for r in c.indent_tree("lib/main.dart").collect()} == {1: None, 2: None, 3: 2, 4: None}
    assert c.search_text("todo", comments=False).count() == 0 and c.search_text("Text", comments=False, strings=False).count() >= 1
    assert c.tool_search("Home").first()["name"] == "Home" and ("method:Home.onTap", "func:load") in {(a, b) for a, b, t in every if t == "calls"} and any(t == "uses_class" for *_, t in every)
    assert files.where(F.col("path") == "x").count() == 0
