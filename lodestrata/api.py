"""One entry point for a parsed corpus: the public queries by name, with a dialect where they differ.

A :class:`Corpus` is built from a file table (path, content[, hash]) and keeps the parsed tables as lazy DataFrames; call
``cached()`` to hold the parse in memory.  Each query returns a DataFrame.  Network, process and editor control have
no place in an engine over tables and are left out; their outputs (tool logs, runtime events, change lists) are
taken as tables instead.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import audit, components, edits, graph, l10n, lexical, lines, resolve, search, spans
from lodestrata.parse import tables
from lodestrata.sources import files as sources
from lodestrata.sources import packages as package_lists
from lodestrata.streaming import changes

# fixed values: short advice for each kind of question
HINTS = (
    ("find a symbol", "search"), ("read a part of a file", "read_lines"), ("find uses of a name", "find_references"), ("see what a change touches", "impact_analysis"),
    ("check the architecture", "architectural_layers"), ("find unfinished code", "detect_mockups"), ("compare locale files", "missing_translations"),
)


class Corpus:
    def __init__(self, files: DataFrame, dialect: str = "rs", package: str | None = None, aliases: tuple = ()):
        self.files, self.dialect, self.package, self.aliases = files, dialect, package, aliases
        self._keep = False

    def cached(self) -> Corpus:
        self._keep = True
        return self

    # ---- derived tables
    @cached_property
    def symbols(self) -> DataFrame:
        s = tables.parsed(self.files)
        return s.cache() if self._keep else s

    @cached_property
    def lines(self) -> DataFrame:
        return lines.lines(self.files, self.dialect)

    @cached_property
    def spans(self) -> DataFrame:
        return tables.symbol_spans(self.symbols)

    @cached_property
    def imports(self) -> DataFrame:
        """path, spec, line, target."""
        found = tables.of_kind(self.symbols, "import").select("path", F.col("name").alias("spec"), "line")
        return resolve.resolve_imports(found, self.files, self.package, self.aliases)

    @cached_property
    def import_edges(self) -> DataFrame:
        return self.imports.where("target is not null").select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()

    @cached_property
    def translations(self) -> DataFrame:
        return l10n.translations(self.locale_files)

    @property
    def locale_files(self) -> DataFrame:
        return self.files.where(F.endswith("path", F.lit(".arb")))

    def _nodes(self) -> DataFrame:
        drawn = tables.of_kind(self.symbols, "widget").select("path", F.lit(True).alias("drawn")).distinct()
        layer = audit.layer_of(F.concat(F.lit("/"), "path"), self.dialect, F.coalesce("drawn", F.lit(False)))
        return self.files.select("path").join(drawn, "path", "left").select(F.col("path").alias("node"), layer.alias("layer"))

    def _layered_edges(self) -> DataFrame:
        n = self._nodes()
        return self.import_edges.join(n.select(F.col("node").alias("src"), F.col("layer").alias("src_layer")), "src").join(n.select(F.col("node").alias("dst"), F.col("layer").alias("dst_layer")), "dst")

    # ---- search and lookup
    def search(self, query: str, kind: str | None = None, k: int = 50) -> DataFrame:
        docs = tables.search_docs(self.symbols)
        docs = docs.where(F.col("kind") == kind) if kind else docs
        return search.search(docs, query, "rs", k) if self.dialect == "rs" else search.symbol_search(docs, query, k)

    def direct_search(self, query: str, k: int = 50) -> DataFrame:
        return lines.direct_definitions(lines.lines(sources.direct_search_files(self.files), self.dialect), query, k)

    def search_text(self, query: str, regex: bool = False, case_sensitive: bool = False, k: int = 100, comments: bool = True, strings: bool = True) -> DataFrame:
        return lines.search_text(self.lines, query, regex, case_sensitive, k, self.dialect == "ts", comments, strings)

    def tool_search(self, query: str, kind: str | None = None, mode: str = "both", direct: bool = False, k: int = 50) -> DataFrame:
        return search.tool_search(self.symbols, self.files, query, kind, mode, k, direct, None if direct else tables.search_docs(self.symbols))

    def find_references(self, symbol: str) -> DataFrame:
        if self.dialect == "rs":
            return lines.word_references(self.lines, symbol)
        return lines.references(tables.of_kind(self.symbols, "call"), tables.of_kind(self.symbols, "class"), self.lines, symbol)

    def read_lines(self, path: str, start: int = 1, end: int | None = None, most: int = 100) -> DataFrame:
        return lines.read_lines(self.files, path, start, end, most)

    def node_at_cursor(self, path: str, line: int) -> DataFrame:
        cursor = self.files.sparkSession.createDataFrame([(path, line)], "path string, at int")
        return spans.node_at(self.spans.where(F.col("path") == path), cursor, self.dialect)

    def code_block(self, name: str) -> DataFrame:
        return lines.code_blocks(self.spans, self.lines, name, self.dialect)

    def read_fragment(self, name: str, kind: str | None = None, parent: str | None = None, context: int = 3) -> DataFrame:
        return lines.fragment(self.spans, self.lines, name, kind, parent, context, self.dialect)

    def file_info(self, path: str) -> DataFrame:
        """(kind, n) of a file; ts takes the end of a path, in any case."""
        mine = F.endswith(F.lower("path"), F.lit(path.lower())) if self.dialect == "ts" else F.col("path") == path
        return self.symbols.where(mine).groupBy("kind").agg(F.count("*").alias("n"))

    def outline(self) -> DataFrame:
        return tables.quick_outline(self.symbols)

    def parse_ast(self, path: str) -> DataFrame:
        """(path, ast): all rows of a file as JSON."""
        rows = tables.parsed(self.files.where(F.col("path") == path))
        return rows.groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(F.struct("line", "kind", "name", "parent", "type", "line_end")))).alias("ast"))

    def stats(self) -> DataFrame:
        return tables.global_stats(self.symbols, self.files, self.dialect)

    def index_status(self) -> DataFrame:
        return self.files.agg(F.count("*").alias("files"), F.sum(F.char_length("content")).alias("chars"))

    def project_structure(self, depth: int = 4) -> DataFrame:
        """(path, depth, n): folders to a depth, with the number of files below each."""
        parts = F.split("path", "/")
        up = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), n.alias("depth")))
        return self.files.select(F.explode(up).alias("x")).groupBy("x.path", "x.depth").agg(F.count("*").alias("n")).orderBy("path")

    def pubspec(self) -> DataFrame:
        return self.files.where(F.col("path") == "pubspec.yaml")

    def packages(self) -> DataFrame:
        return package_lists.all_packages(self.files)

    def search_packages(self, package_files: DataFrame, query: str, k: int = 50) -> DataFrame:
        return lines.search_text(lines.lines(package_files), query, k=k)

    def hints(self, topic: str = "") -> DataFrame:
        h = self.files.sparkSession.createDataFrame(list(HINTS), "question string, query string")
        return h.where(F.contains("question", F.lit(topic.lower())))

    # ---- graph
    def detailed_graph(self, focus: str | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        s = self.symbols
        functions = tables.of_kind(s, "function").select("path", "name", "line", F.col("parent").alias("parent_class"))
        calls = tables.of_kind(s, "call").select("path", "name", "receiver", F.col("parent").alias("caller_class"), "caller_function")
        others = s.where("kind in ('mixin', 'enum')").select("name", "kind")
        nodes, edges = graph.symbol_graph(self.files.select("path"), tables.of_kind(s, "class"), functions, self.imports)
        edges = edges.unionByName(graph.call_edges(calls, functions, tables.of_kind(s, "class"), others)).unionByName(graph.usage_edges(self.usages))
        if focus is None:
            return nodes, edges
        seeds = nodes.where(F.col("path") == focus).select(F.col("id").alias("node"))
        edges = graph.ego_graph(edges, seeds, depth)
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(seeds.select(F.col("node").alias("id"))).distinct()
        return nodes.join(ends, "id", "left_semi"), edges

    def dependencies(self, path: str) -> DataFrame:
        return self.imports.where(F.col("path") == path).select("spec", "line", "target", F.col("target").isNull().alias("external"))

    @cached_property
    def usages(self) -> DataFrame:
        return tables.usages(self.symbols, self.files)

    def usage_places(self, name: str) -> DataFrame:
        """(name, used_in, line, times, class, function): where a name is used, and in what."""
        return tables.usage_places(self.symbols, self.files, self.spans, self.dialect).where(F.col("name") == name)

    def users_of(self, name: str, kind: str, parent: str | None = None) -> DataFrame:
        return tables.users_of(self.symbols, self.usages, name, kind, parent)

    def quick_search(self, query: str = "", k: int = 150) -> DataFrame:
        """The interactive list: definitions in the order of rerank(), by how many files use them."""
        named = tables.search_docs(self.symbols).select("id", "kind", "name", "path")
        counts = tables.usage_counts(self.symbols, self.files).withColumnRenamed("def_path", "path")
        return search.rerank(named.join(counts, ["kind", "name", "path"], "left").na.fill(0, ["usage_count"]), query, k)

    def graph_stats(self) -> DataFrame:
        return graph.graph_stats(*self.detailed_graph())

    def reverse_deps(self, path: str) -> DataFrame:
        return self.import_edges.where(F.col("dst") == path).select(F.col("src").alias("path")) if self.dialect == "ts" else lines.reverse_import_lines(self.lines, path)

    def entry_points(self) -> DataFrame:
        f = tables.of_kind(self.symbols, "function")
        main = (F.col("name") == "main") & F.col("parent").isNull()
        hook = F.col("parent").isNotNull() & (F.col("name").isin("build", "initState") | F.startswith("name", F.lit("on")))
        return f.where(main | hook).select(F.col("path").alias("node"), F.concat_ws(":", "path", F.concat_ws(".", "parent", "name")).alias("entry"))

    def impact_analysis(self, path: str, most: int = 25) -> DataFrame:
        return graph.impact(self.import_edges, path, self.entry_points(), most)

    def git_blast_radius(self, changed: list[str], most: int = 25) -> DataFrame:
        seeds = self.files.sparkSession.createDataFrame([(c,) for c in changed], "node string")
        return graph.bfs(self.import_edges, seeds, most, backwards=True)

    def import_components(self) -> DataFrame:
        """(node, component): files that import each other in circles share a component, its least file."""
        return components.strong_components(self.import_edges)

    def import_risk(self) -> DataFrame:
        """(node, risk) of every file by how many others depend on it."""
        reverse = self.import_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return components.risk_of(reverse, self.files.select(F.col("path").alias("node")))

    def indent_tree(self, path: str | None = None) -> DataFrame:
        return lexical.indent_tree(self.lines.where(F.col("path") == path) if path else self.lines)

    def circular_dependencies(self) -> DataFrame:
        return graph.cycle_list(self.import_edges, self.dialect)

    def architectural_layers(self) -> DataFrame:
        return audit.layer_report(self._nodes(), self.import_edges, self.dialect)

    def layer_violations(self) -> DataFrame:
        return audit.layer_violations(self._layered_edges(), self.dialect)

    def validate_architecture(self, rules=None) -> DataFrame:
        if self.dialect == "rs":
            return audit.rule_violations(self._layered_edges(), rules or audit.RULES)
        # an import that names no file counts by what it says
        edges = self.imports.select(F.col("path").alias("src"), F.coalesce("target", "spec").alias("dst"))
        return audit.segment_violations(edges, rules or audit.RULES_TS)

    # ---- audits
    def code_warnings(self, kind: str | None = None, text: str | None = None, path: str | None = None) -> DataFrame:
        """(path, line, type, value), by kind, text and path; ts has the mock-ups among them."""
        found = audit.hardcoded_values(self.lines, self.dialect)
        if self.dialect == "ts":
            made = audit.mockups(self.lines, True).unionByName(audit.unbound_inputs(self.files)).join(self.lines, ["path", "line"]).select("path", "line", "type", F.trim("text").alias("value"))
            found = found.unionByName(made)
        return audit.warnings_where(found, kind, text, path)

    def detect_mockups(self) -> DataFrame:
        return audit.rule_hits(self.lines) if self.dialect == "rs" else audit.mockups(self.lines, True).unionByName(audit.unbound_inputs(self.files))

    def duplicate_warnings(self) -> DataFrame:
        s = self.symbols.where(F.col("kind").isin("class", "function"))
        return audit.duplicate_warnings(s.select("path", "line", "name", "parent", F.col("kind").alias("type"), "body_hash", "body_length"))

    def duplicate_logic(self, least: int = 50) -> DataFrame:
        f = tables.of_kind(self.symbols, "function").where(F.col("body_length") >= least)
        return f.groupBy("body_hash").agg(F.count("*").alias("n"), F.min(F.struct("path", "line", "name")).alias("first")).where("n > 1")

    def _ui(self) -> DataFrame:
        return tables.of_kind(self.symbols, "widget").select("path", "node_id", "parent_id", "root_id", "ord", "depth", "name", "line")

    def widget_depth(self, most: int = 5) -> DataFrame:
        return audit.deepest_paths(self._ui(), most, self.dialect)

    def duplicate_widgets(self, least: int = 3) -> DataFrame:
        return audit.duplicate_subtrees(self._ui(), least, self.dialect)

    def widget_outline(self) -> DataFrame:
        return self._ui().orderBy("path", "ord")

    def memory_leaks(self) -> DataFrame:
        if self.dialect == "rs":
            return audit.leak_candidates(self.files)
        return audit.leaking_fields(tables.of_kind(self.symbols, "property"), tables.of_kind(self.symbols, "function"), self.files)

    def unused_assets(self, assets: DataFrame) -> DataFrame:
        return audit.unused_assets(assets, self.files) if self.dialect == "rs" else audit.unnamed_assets(audit.declared_assets(assets, self.files), self.files)

    def asset_report(self, assets: DataFrame) -> DataFrame:
        found = assets if self.dialect == "rs" else audit.declared_assets(assets, self.files)
        return audit.asset_report(found, self.unused_assets(assets))

    def logic_flow(self, function: str, parent: str | None = None) -> DataFrame:
        s = self.spans.where((F.col("name") == function) & F.col("kind").isin("method", "function"))
        s = s.where(F.col("parent") == parent) if parent else s
        # the first method of the name, then the first function
        s = spans.with_ends(s.orderBy(F.desc("kind"), "path", "line").limit(1), self.dialect, lines.FLOW_LINES)
        body = s.select(F.col("path").alias("p"), F.col("line").alias("a"), "line_end").join(self.lines, (F.col("p") == F.col("path")) & F.col("line").between(F.col("a"), F.col("line_end")))
        return lines.logic_flow(body, ("path", "a"))

    def diagnostics(self, output: DataFrame, target: str | None = None, k: int = 100, severity: str | None = None) -> DataFrame:
        return audit.diagnostics_where(audit.diagnostics(output), target, severity).orderBy("file", "line", "col").limit(k)

    def analysis_report(self, output: DataFrame, exit_code: int | None = 0, target: str | None = None, timed_out: bool = False) -> DataFrame:
        return audit.diagnostics_report(audit.diagnostics(output), exit_code, target, timed_out)

    # ---- localisation
    def list_translations(self, locale: str | None = None) -> DataFrame:
        return l10n.listed(self.translations, locale)

    def missing_translations(self) -> DataFrame:
        return l10n.missing_keys(self.translations)

    def unused_translations(self) -> DataFrame:
        return l10n.unused_keys(self.translations, self.files.where(~F.endswith("path", F.lit(".arb"))), self.dialect)

    def validate_icu(self) -> DataFrame:
        return l10n.message_issues(self.translations, self.dialect)

    def missing_payload(self, source: str = "en") -> DataFrame:
        return l10n.missing_payload(self.translations, source)

    def update_translations(self, updates: DataFrame) -> DataFrame:
        return l10n.with_translations(self.translations, updates, l10n.unreadable(self.locale_files))

    def delete_translation(self, key: str, locale: str | None = None) -> DataFrame:
        return l10n.without_key(self.translations, key, locale)

    def generate_messages(self) -> DataFrame:
        return l10n.generated_source(self.translations)

    def message_members(self, locale: str = "en") -> DataFrame:
        return l10n.message_members(self.locale_files, locale)

    def locales(self) -> DataFrame:
        return l10n.locale_names(self.locale_files)

    def remove_locale(self, locale: str, main: str = "en") -> Corpus:
        return Corpus(l10n.without_locale(self.files, locale, main), self.dialect, self.package, self.aliases)

    # ---- edits give a new corpus
    def rewrite_files(self, fresh: DataFrame) -> Corpus:
        """Put JSON contents in place in the style of the old files, which are kept beside them."""
        return Corpus(edits.rewritten(self.files, fresh), self.dialect, self.package, self.aliases)

    def without_excluded(self) -> Corpus:
        return Corpus(sources.without_excluded(self.files), self.dialect, self.package, self.aliases)

    def edit_file(self, path: str, old: str, new: str, replace_all: bool = False, expected: int | None = None) -> DataFrame:
        return edits.replaced(self.files.where(F.col("path") == path), old, new, replace_all, expected)

    def replace_lines(self, path: str, start: int, end: int, text: str, guard: str | None = None) -> DataFrame:
        return edits.lines_replaced(self.files.where(F.col("path") == path), start, end, text, guard)

    def write_files(self, fresh: DataFrame) -> Corpus:
        return Corpus(edits.written_files(self.files, fresh), self.dialect, self.package, self.aliases)

    def runtime_errors(self, events: DataFrame) -> DataFrame:
        return changes.runtime_errors(events)

    def under(self, path: str | None) -> Corpus:
        return Corpus(sources.under(self.files, path), self.dialect, self.package, self.aliases)
