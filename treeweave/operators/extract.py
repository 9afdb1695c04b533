"""Symbols and calls from flattened syntax trees (``schemas.SYNTAX``).

All joins are on (repo, file_path) and a node id of that file, so one partitioning by file serves them all. Containment is read off
pre-order numbers, file by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import trim
from ..schemas import NODES, check_range
from ..tables import cut, if_small

#: The kinds of syntax nodes that make symbols, by type, and those that are calls.
KINDS = {
    "function": ["function_declaration", "function_definition", "method_definition", "method_declaration", "arrow_function", "function_item", "func_declaration", "function_expression"],
    "class": ["class_declaration", "class_definition", "struct_item", "struct_specifier", "impl_item", "type_declaration"],
    "interface": ["interface_declaration", "trait_item"],
    "import": ["import_statement", "import_declaration", "use_declaration", "preproc_include"],
    "export": ["export_statement", "export_declaration"],
    "enum": ["enum_declaration", "enum_item", "enum_specifier"],
}
CALLS = ["call_expression", "new_expression", "method_invocation", "invocation_expression"]
MEMBERS = ["member_expression", "field_expression"]
FILE = ["repo", "file_path"]


def classify(kind: Column) -> Column:
    """The symbol type of a syntax kind; null for all others."""
    out = F.lit(None).cast("string")
    for name, kinds in reversed(KINDS.items()):
        out = F.when(kind.isin(kinds), name).otherwise(out)
    return out


def symbol_signature(text: Column) -> Column:
    """Up to the first ``{`` if one comes later than the start; else through the first ``)``, likewise; else all. Trimmed; 200 characters at most and dots."""
    brace, paren = F.instr(text, "{"), F.instr(text, ")")
    head = F.when(brace > 1, F.substring(text, F.lit(1), brace - 1)).when(paren > 1, F.substring(text, F.lit(1), paren)).otherwise(text)
    head = trim(head)
    return F.when(F.length(head) > 200, F.concat(F.substring(head, 1, 200), F.lit("..."))).otherwise(head)


def symbol_body(text: Column, max_body: int = 2000) -> Column:
    check_range("maxBodySize", max_body, 100, 50_000)
    return F.when(F.length(text) > max_body, F.concat(F.substring(text, 1, max_body), F.lit("..."))).otherwise(text)


def child_texts(syntax: DataFrame, fields: list[str]) -> DataFrame:
    """For each parent: the text of its first child in each field (null: none), as a column a field."""
    held = syntax.filter(F.col("field").isin(fields) & F.col("parent_node_id").isNotNull())
    of = lambda f: F.min_by(F.when(F.col("field") == f, F.struct("text", "node_id")), F.when(F.col("field") == f, F.col("child_index")))
    return held.groupBy(*FILE, F.col("parent_node_id").alias("node_id")).agg(*[of(f).alias(f"_{f}") for f in fields])


def with_children(nodes: DataFrame, texts: DataFrame, fields: list[str], of: str = "node_id", prefix: str = "", how: str = "left") -> DataFrame:
    """``nodes`` with the fields' first children, out of ``child_texts``, of the node that column ``of`` names."""
    own = texts.select(*FILE, F.col("node_id").alias(of), *(F.col(f"_{f}").alias(f"{prefix}{f}_child") for f in fields))
    return nodes.join(own, [*FILE, of], how)


def symbol_names(syntax: DataFrame) -> DataFrame:
    """Symbol nodes of ``syntax`` with ``type`` (as classified) and ``name``.

    A name is the text of the child ``name``, or of the child ``declarator``'s child ``name``, or of the declarator; an arrow function's is its
    parent's; an export's its declaration's, by these rules; an import's its source or path without quotes, or its first 80 characters.
    """
    key = [*FILE, "node_id"]
    fields = ["name", "declarator", "declaration", "source", "path"]
    own = syntax.withColumn("type", classify(F.col("kind"))).filter(F.col("type").isNotNull())
    texts = cut(child_texts(syntax, fields), "children")  # few of a tree's nodes, read several times
    # what isn't a node's own child is looked up only for the nodes that need it, so all others are shuffled once
    declarators = if_small(texts.filter("_declarator IS NOT NULL").select(*key, F.col("_declarator.node_id").alias("_inner")))
    inner = with_children(declarators, texts, ["name"], "_inner", "inner_", "inner").select(*key, "inner_name_child")
    arrows = if_small(syntax.filter((F.col("kind") == "arrow_function") & F.col("parent_node_id").isNotNull()).select(*key, "parent_node_id"))
    parents = with_children(arrows, texts, ["name"], "parent_node_id", "parent_", "inner").select(*key, "parent_name_child")
    # an exported declaration is a node of its own: its kind, its children, and (for an arrow function) its parent, the export
    exports = if_small(texts.filter("_declaration IS NOT NULL").select(*key, F.col("_declaration.node_id").alias("_decl")))
    declared = syntax.filter(F.col("field") == "declaration").select(*FILE, F.col("node_id").alias("_decl"), F.col("kind").alias("_decl_kind"), F.substring("text", 1, 80).alias("_decl_text"))
    exported = exports.join(declared, [*FILE, "_decl"])
    exported = with_children(exported, texts, ["name", "declarator", "source", "path"], "_decl", "decl_")
    exported = exported.join(inner.select(*FILE, F.col("node_id").alias("_decl"), F.col("inner_name_child").alias("decl_inner_name_child")), [*FILE, "_decl"], "left")
    own = with_children(own, texts, fields).join(inner, key, "left").join(parents, key, "left").join(exported, key, "left")
    direct = F.coalesce("name_child.text", "inner_name_child.text", "declarator_child.text")
    quotes = lambda c: F.regexp_replace(c, "['\"]", "")
    imported = lambda source, path, text: F.coalesce(quotes(F.coalesce(source, path)), F.substring(text, 1, 80))
    anonymous = F.lit("<anonymous>")
    of_declaration = F.coalesce(
        "decl_name_child.text",
        "decl_inner_name_child.text",
        "decl_declarator_child.text",
        F.when(F.col("_decl_kind") == "arrow_function", F.col("name_child.text")),
        F.when(F.col("_decl_kind").isin(KINDS["import"]), imported(F.col("decl_source_child.text"), F.col("decl_path_child.text"), F.col("_decl_text"))),
        F.when(F.col("_decl").isNotNull(), anonymous),
    )
    name = F.coalesce(
        direct,
        F.when(F.col("kind") == "arrow_function", F.col("parent_name_child.text")),
        F.when(F.col("kind") == "export_statement", F.coalesce(of_declaration, F.lit("<export>"))),
        F.when(F.col("type") == "import", imported(F.col("source_child.text"), F.col("path_child.text"), F.col("text"))),
        anonymous,
    )
    return own.select(*[F.col(c) for c in syntax.columns], "type", name.alias("name"))


def innermost(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(repo, file_path, node_id, inner, outer) for each row of ``inner`` (repo, file_path, node_id, inner) within a node of ``outer`` (repo, file_path, node_id,
    last_desc, outer): with what the innermost one carries.

    One pass over a file's outer and inner nodes in page order counts how many outer ones are open; of those that are equally deep
    the last one begun is the one still open. So a file costs its nodes, sorted, not their pairs.
    """
    event = lambda at, turn, by, of: F.struct(at.cast("long").alias("at"), F.lit(turn).alias("turn"), F.lit(by).alias("by"), of.alias("outer"))
    none = F.lit(None).cast(outer.schema["outer"].dataType)
    ends = F.explode(F.array(event(F.col("node_id"), 1, 1, F.col("outer")), event(F.col("last_desc"), 2, -1, none)))
    asked = inner.select(*FILE, event(F.col("node_id"), 0, 0, none).alias("e"), "inner").select(*FILE, "e.*", "inner")
    events = asked.unionByName(outer.select(*FILE, ends.alias("e")).select(*FILE, "e.*"), allowMissingColumns=True)
    order = Window.orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("depth", F.sum("by").over(order.partitionBy(*FILE))).filter((F.col("turn") < 2) & (F.col("depth") > 0))
    events = events.withColumn("outer", F.last("outer", ignorenulls=True).over(order.partitionBy(*FILE, "depth")))
    return events.filter("turn = 0").select(*FILE, F.col("at").alias("node_id"), "inner", "outer")


def enclosing(syntax: DataFrame, inner: DataFrame, types: list[str]) -> DataFrame:
    """(repo, file_path, node_id, outer_id) for each row of ``inner`` inside a symbol of these types: the innermost one's node id."""
    outer = syntax.filter(classify(F.col("kind")).isin(types)).select(*FILE, "node_id", "last_desc", F.col("node_id").cast("long").alias("outer"))
    return innermost(outer, inner.select(*FILE, "node_id", F.lit(None).cast("string").alias("inner"))).select(*FILE, "node_id", F.col("outer").alias("outer_id"))


def methods(syntax: DataFrame) -> DataFrame:
    """(repo, file_path, node_id, _in) of the functions inside a function, class, interface or enum."""
    functions = syntax.filter(classify(F.col("kind")) == "function")
    return enclosing(syntax, functions, ["function", "class", "interface", "enum"]).select(*FILE, "node_id", F.lit(True).alias("_in"))


def symbol_types(syntax: DataFrame) -> DataFrame:
    """Symbol nodes with ``type``: a function inside a function, class, interface or enum is a method. Imports and exports enclose nothing."""
    own = syntax.withColumn("type", classify(F.col("kind"))).filter(F.col("type").isNotNull())
    own = own.join(methods(syntax), [*FILE, "node_id"], "left")
    return own.withColumn("type", F.when(F.col("_in"), "method").otherwise(F.col("type"))).drop("_in")


def symbol_id(hash_: Column, node_id: Column) -> Column:
    """Ids change with a file's content, and need no numbering over all files."""
    return F.md5(F.concat_ws("\x00", "repo", "file_path", hash_, node_id.cast("string")))


def symbols(syntax: DataFrame, hashes: DataFrame, max_body: int = 2000) -> DataFrame:
    """Node rows (``schemas.NODES``) of syntax trees, and ``node_id`` and ``last_desc``; ``hashes``: (repo, file_path, hash)."""
    rows = symbol_names(syntax).join(methods(syntax), [*FILE, "node_id"], "left").join(hashes.select(*FILE, "hash"), FILE)
    plain = F.col("type").isin("import", "export")
    return rows.select(
        "repo",
        "file_path",
        symbol_id(F.col("hash"), F.col("node_id")).alias("id"),
        "name",
        F.when(F.col("_in"), "method").otherwise(F.col("type")).alias("type"),
        F.when(plain, F.substring("text", 1, 200)).otherwise(symbol_signature(F.col("text"))).alias("signature"),
        (F.col("start_row") + 1).alias("start_line"),
        (F.col("end_row") + 1).alias("end_line"),
        "start_col",
        "end_col",
        F.lit(None).cast("string").alias("parent_id"),
        "language",
        F.when(plain, "").otherwise(symbol_body(F.col("text"), max_body)).alias("body_text"),
        "node_id",
        "last_desc",
    )


def call_names(syntax: DataFrame, call_kinds: list[str] | None = None) -> DataFrame:
    """(repo, file_path, node_id, start_row, callee_name) of call nodes: the child ``function``, or ``method``, or else the first child; of a member access the member.

    Calls and what may be their callees meet in one aggregate; only member accesses are looked up further.
    """
    rank = F.when(F.col("field") == "function", 0).when(F.col("field") == "method", 1).otherwise(2)
    callees = syntax.filter(F.col("parent_node_id").isNotNull() & (F.col("field").isin("function", "method") | (F.col("child_index") == 0)))
    callees = callees.select(*FILE, F.col("parent_node_id").alias("node_id"), F.struct(F.col("node_id").alias("at"), "kind", "text").alias("callee"), F.struct(rank.alias("rank"), "child_index").alias("_order"))
    calls = syntax.filter(F.col("kind").isin(CALLS if call_kinds is None else call_kinds)).select(*FILE, "node_id", F.struct("start_row").alias("_call"))
    both = calls.unionByName(callees, allowMissingColumns=True).groupBy(*FILE, "node_id").agg(F.max("_call").alias("_call"), F.min_by("callee", "_order").alias("callee"))
    found = both.filter(F.col("_call").isNotNull()).select(*FILE, "node_id", "_call.start_row", "callee.*")
    accesses = syntax.filter(F.col("kind").isin(MEMBERS)).select(*FILE, F.col("node_id").alias("at"))
    members = with_children(if_small(accesses), child_texts(syntax, ["property", "field"]), ["property", "field"], "at", "", "inner")
    found = found.join(members, [*FILE, "at"], "left")
    name = F.when(F.col("kind").isin(MEMBERS), F.coalesce("property_child.text", "field_child.text", "text")).otherwise(F.col("text"))
    return found.select(*FILE, "node_id", "start_row", name.alias("callee_name"))


def call_edges(syntax: DataFrame, nodes: DataFrame, call_kinds: list[str] | None = None) -> DataFrame:
    """Edge rows (``schemas.EDGES``), unresolved: each named call in the innermost function around it. ``nodes``: ``symbols``, with node_id and last_desc."""
    calls = call_names(syntax, call_kinds).filter(F.coalesce("callee_name", F.lit("")) != "")
    callers = nodes.filter(F.col("type").isin("function", "method")).select(*FILE, "node_id", "last_desc", F.col("id").alias("outer"))
    held = innermost(callers, calls.select(*FILE, "node_id", F.struct("callee_name", (F.col("start_row") + 1).alias("line")).alias("inner")))
    return held.select(*FILE, F.col("outer").alias("caller_id"), F.lit(None).cast("string").alias("callee_id"), "inner.callee_name", "inner.line")


def file_records(changed: DataFrame, nodes: DataFrame, now_ms: int) -> DataFrame:
    """File rows (``schemas.FILES``) of ``changed`` (repo, file_path, hash, language): nodes counted, 0 where there are none."""
    counts = nodes.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n"))
    return changed.join(counts, FILE, "left").select(*FILE, "hash", "language", F.lit(now_ms).cast("bigint").alias("last_indexed"), F.coalesce("n", F.lit(0)).cast("bigint").alias("node_count"))


def node_rows(symbols_: DataFrame) -> DataFrame:
    return symbols_.select(*NODES.names)
