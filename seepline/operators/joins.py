"""Joins between facts: as-of, anti, range and key joins behind the detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import frames, text as tx
from ..plans.durable import by_key, cut
from ..rules.languages import CATEGORY_SANITIZERS
from ..rules.names import DANGEROUS, FLAGS, SHELLS
from . import facts
from .taint import propagate

#: Categories that some sanitizer clears.
SANITIZED = sorted({c for by in CATEGORY_SANITIZERS.values() for c in by})

VAR = ["file_id", "scope_id", "var"]


def nearest_assignment(points: DataFrame, assigns: DataFrame) -> DataFrame:
    """Backward as-of join: the last assignment of ``var`` strictly before each point.

    Adds ``def_line`` and ``rhs``, null without one. Points and assignments meet in one
    block-wise window per variable, so no pairs are formed.
    """
    defs = (
        assigns.groupBy("file_id", "scope_id", F.col("lhs").alias("var"), "line_no").agg(F.max("rhs").alias("rhs"))
        .withColumn("_def", F.struct(F.col("line_no").alias("def_line"), "rhs")).drop("rhs")
    )
    extra = [c for c in points.columns if c not in (*VAR, "line_no")]
    both = points.withColumn("_row", F.lit(True)).unionByName(defs, allowMissingColumns=True)
    placed = frames.running_last(both, VAR, "line_no", F.col("_def"), "_found", inclusive=False)
    return placed.filter("_row").select(*VAR, "line_no", *extra, "_found.def_line", "_found.rhs")


def _definition(var: str | Column, line: str) -> Column:
    return F.concat_ws("@", var, line)


def _definitions(assigns: DataFrame) -> DataFrame:
    """file_id, lang, scope_id, var, line_no, rhs: one row per variable and line that assigns it."""
    return assigns.groupBy("file_id", "lang", "scope_id", F.col("lhs").alias("var"), "line_no").agg(F.max("rhs").alias("rhs"))


def _reads(points: DataFrame, defs: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What reads which definition, looked up in one pass: edges between definitions (file_id, scope_id, src, dst, and the
    columns of live that aren't those of a definition), and points with their definition as def.

    A live definition reads, for every name of its right-hand side, the last definition above it. Only line numbers travel.
    """
    extra = [c for c in live.columns if c not in ("file_id", "lang", "scope_id", "var", "line_no", "rhs")]
    used = facts.explode_tokens(live.withColumnRenamed("var", "of_var"), "rhs", None, "var").select(*VAR, "line_no", "of_var", *extra)
    asked = points.select(*VAR, "line_no").distinct()
    own = defs.select(*VAR, "line_no", F.col("line_no").alias("_def"))
    both = used.withColumn("_asks", F.lit(1)).unionByName(asked.withColumn("_asks", F.lit(2)), allowMissingColumns=True).unionByName(own, allowMissingColumns=True)
    placed = cut(frames.running_last(both, VAR, "line_no", F.col("_def"), "_found", inclusive=False).filter("_asks is not null and _found is not null"))
    edges = placed.filter("_asks = 1").select("file_id", "scope_id", _definition("var", "_found").alias("src"), _definition("of_var", "line_no").alias("dst"), *extra)
    return edges, placed.filter("_asks = 2").select(*VAR, "line_no", _definition("var", "_found").alias("def"))


def flow_sensitive(points: DataFrame, assigns: DataFrame, depth: int | None = None) -> DataFrame:
    """Points whose nearest assignments lead to a source, over any number of steps (or at most ``depth``).

    A killing or literal right-hand side ends a walk; otherwise it goes on with the names of
    that right-hand side, looked up at its own line. So each assignment reads the last ones above it, all looked up in
    one pass, and sources spread over what reads them. Points are (file_id, lang,
    scope_id, var, line_no); result rows are distinct points.
    """
    lang, rhs = F.col("lang"), F.col("rhs")
    source = tx.by_language(lang, lambda l: tx.matches(rhs, l.source) & ~tx.matches(rhs, l.safe_source))
    killed = tx.by_language(lang, lambda l: tx.matches(rhs, l.killer))
    defs = cut(_definitions(assigns).filter("rhs is not null").withColumn("source", source).withColumn("killed", killed))
    live = defs.filter("not killed")
    edges, placed = _reads(points, defs, live.filter("not source").drop("source", "killed"))
    seeds = live.filter("source").select("file_id", "scope_id", _definition("var", "line_no").alias("var"), F.lit("user").alias("label"), "line_no")
    reached = propagate(seeds, edges.withColumn("label", F.lit("user")), None if depth is None else depth - 1)
    found = reached.select("file_id", "scope_id", F.col("var").alias("def"))
    return placed.join(by_key(found), ["file_id", "scope_id", "def"], "left_semi").select(*VAR, "line_no")


def cleared_categories(lang: Column, rhs: Column) -> Column:
    """Categories for which a right-hand side is safe: all where it converts, else those of its sanitizers."""
    by = [F.when((lang == name) & rhs.rlike(p), F.lit(c)) for name, pats in CATEGORY_SANITIZERS.items() for c, p in pats.items()]
    killed = tx.by_language(lang, lambda l: tx.matches(rhs, l.killer))
    every = F.array(*(F.lit(c) for c in SANITIZED))
    return F.when(killed, every).otherwise(F.array_distinct(F.array_compact(F.array(*by))))


def category_taint(points: DataFrame, assigns: DataFrame) -> DataFrame:
    """Points with each category for which user input still reaches them: file_id, scope_id, var, line_no, category.

    Each assignment is a definition of its own. It is reached by what its right-hand side uses, as last assigned
    before it, but for the categories that it clears; so cleared state follows copies, holds for the paths that were
    cleared only, and is reset by a later source. Points are (file_id, lang, scope_id, var, line_no).
    """
    lang, rhs = F.col("lang"), F.col("rhs")
    source = tx.by_language(lang, lambda l: tx.matches(rhs, l.source) & ~tx.matches(rhs, l.safe_source))
    every = F.array(*(F.lit(c) for c in SANITIZED))
    defs = cut(_definitions(assigns).withColumn("source", source).withColumn("labels", F.array_except(every, cleared_categories(lang, rhs))))
    live = defs.filter(F.size("labels") > 0)
    edges, placed = _reads(points, defs, live.drop("source"))
    seeds = live.filter("source").select("file_id", "scope_id", _definition("var", "line_no").alias("var"), F.explode("labels").alias("label"), "line_no")
    reached = propagate(seeds, edges).select("file_id", "scope_id", F.col("var").alias("def"), F.col("label").alias("category"))
    return placed.join(by_key(reached), ["file_id", "scope_id", "def"]).select(*VAR, "line_no", "category")


# Factories that need hardening and the calls that harden them.
FACTORY = r"(\w+)\s*=\s*(?:new\s+)?(DocumentBuilderFactory|SAXParserFactory|XMLInputFactory|TransformerFactory|SchemaFactory|SAXReader|SAXBuilder|XMLReader|XStream|Kryo|ObjectMapper|Yaml)\b"
HARDENING = r"(\w+)\.(?:setFeature|setProperty|setExpandEntityReferences|setXIncludeAware|setAttribute|setEntityResolver|allowTypes|addPermission|denyTypes|setRegistrationRequired|setObjectInputFilter|setXMLResolver)\s*\("


def unsecured_factories(lines: DataFrame) -> DataFrame:
    """Parsers and readers created but never hardened in their scope."""
    scoped = facts.with_scope(lines)
    created = (
        scoped.withColumn("var", F.regexp_extract("text", FACTORY, 1)).withColumn("factory", F.regexp_extract("text", FACTORY, 2))
        .filter("var <> ''").select(*VAR, "line_no", "factory")
    )
    hardened = scoped.withColumn("var", F.regexp_extract("text", HARDENING, 1)).filter("var <> ''").select(*VAR).distinct()
    return created.join(by_key(hardened), VAR, "left_anti")


LITERAL_ONLY = r"""^\s*(?:"[^"]*"|'[^']*'|`[^`$]*`|[0-9]+(?:\.[0-9]+)?|true|false|True|False|null|None|nil)\s*$"""


def safe_literals(assigns: DataFrame) -> DataFrame:
    """Variables that only ever hold literals."""
    return (
        assigns.groupBy("file_id", "scope_id", F.col("lhs").alias("var"))
        .agg(F.bool_and(F.col("rhs").rlike(LITERAL_ONLY)).alias("safe")).filter("safe").drop("safe")
    )


def dangerous_functions(spark: SparkSession) -> DataFrame:
    rows = [(m, f) for m, names in DANGEROUS.items() for f in names]
    return spark.createDataFrame(rows, "module string, func string")


def constants(assigns: DataFrame) -> DataFrame:
    """Variables with a text that can be computed: (file, scope, var, line_no, value)."""
    return (
        assigns.withColumn("value", tx.fold_constant(F.col("rhs"))).filter("value is not null")
        .select("file_id", "scope_id", F.col("lhs").alias("var"), "line_no", "value")
    )


def hidden_functions(folded: DataFrame) -> DataFrame:
    """Computed texts that name a dangerous function, alone or as module.function."""
    dim = F.broadcast(dangerous_functions(folded.sparkSession))
    last = F.substring_index("value", ".", -1)
    return folded.join(dim.select(F.col("func")).distinct(), last == F.col("func"), "left_semi")


GETATTR = r"\bgetattr\s*\(\s*(\w+)\s*,\s*[\"']?(\w+)[\"']?\s*\)"


def virtual_sinks(assigns: DataFrame, folded: DataFrame) -> DataFrame:
    """Variables bound to a dangerous function: getattr with a plain or computed name, or a
    computed name that is itself callable."""
    scope = ["file_id", "scope_id"]
    bound = (
        assigns.withColumn("module", F.regexp_extract("rhs", GETATTR, 1)).withColumn("name", F.regexp_extract("rhs", GETATTR, 2))
        .filter("module <> ''").select(*scope, F.col("lhs").alias("var"), "line_no", "module", "name")
    )
    texts = folded.groupBy(*scope, F.col("var").alias("name")).agg(F.max_by("value", F.struct("line_no", "value")).alias("value"))
    getattrs = bound.join(by_key(texts), [*scope, "name"], "left").withColumn("func", F.coalesce(F.substring_index("value", ".", -1), "name"))
    direct = folded.select(*scope, "var", "line_no", F.lit("").alias("module"), F.col("value").alias("func"))
    return (
        getattrs.select(*scope, "var", "line_no", "module", "func").unionByName(direct)
        .join(F.broadcast(dangerous_functions(assigns.sparkSession)), ["module", "func"], "left_semi")
    )


def virtual_calls(lines: DataFrame, vsinks: DataFrame) -> DataFrame:
    """Calls through a variable that is bound to a dangerous function."""
    callee = r"(?:^|[^\w.>])\$?(\w+)\s*\("
    called = (
        facts.with_scope(lines).filter(F.col("text").contains("("))
        .select("file_id", "scope_id", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(callee), F.lit(1)))).alias("var"))
    )
    targets = vsinks.select("file_id", "scope_id", "var", "module", "func").distinct()
    return called.join(by_key(targets), VAR)


CLASS = r"\bclass\s+(\w+)"


def with_class(lines: DataFrame) -> DataFrame:
    """Line to the class it stands in: the last class header at or before it."""
    header = F.when(F.col("text").rlike(CLASS), F.regexp_extract("text", CLASS, 1))
    return frames.running_last(lines, ["file_id"], "line_no", header, "class_name")


FIELD_SET = r"(?:this\.|\$this->|self\.|@)(\w+)\s*=\s*\$?(\w+)\s*;?\s*$"
FIELD_USE = r"(?:this\.|\$this->|self\.|@|\b)(_?\w+)"


def tainted_fields(lines: DataFrame, taint: DataFrame) -> DataFrame:
    """Fields set from a tainted variable: (file, class, field)."""
    sets = (
        with_class(lines).withColumn("field", F.regexp_extract("text", FIELD_SET, 1)).withColumn("var", F.regexp_extract("text", FIELD_SET, 2))
        .filter("field <> '' and class_name is not null")
    )
    users = taint.filter("label = 'user'").select("file_id", "var").distinct()
    return sets.join(by_key(users), ["file_id", "var"], "left_semi").select("file_id", "class_name", "field").distinct()


def field_uses(lines: DataFrame, fields: DataFrame) -> DataFrame:
    """Lines of the class that read a tainted field."""
    reads = with_class(lines).filter("class_name is not null").select(
        "file_id", "class_name", "line_no",
        F.explode(F.array_distinct(F.regexp_extract_all(tx.right_hand_side(F.col("text")), F.lit(FIELD_USE), F.lit(1)))).alias("field"),
    )
    return reads.join(by_key(fields), ["file_id", "class_name", "field"], "left_semi")


# Methods that run without being called, and calls dangerous inside them.
MAGIC = ("__destruct", "__wakeup", "__toString", "__call", "__get", "__set", "__invoke", "__unserialize", "__callStatic")
MAGIC_CALLS = r"\b(?:eval|exec|system|passthru|shell_exec|popen|proc_open|assert|unlink|file_put_contents|call_user_func|call_user_func_array|include|require|unserialize|create_function)\s*\("


def gadget_methods(scoped: DataFrame, functions: DataFrame) -> DataFrame:
    """Magic methods with a dangerous call in their scope."""
    risky = scoped.filter(F.col("text").rlike(MAGIC_CALLS)).select("file_id", "scope_id").distinct()
    return (
        functions.filter(F.col("name").isin(*MAGIC)).join(by_key(risky), ["file_id", "scope_id"], "left_semi")
        .select("file_id", "scope_id", "name")
    )


def exclude_ranges(hits: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Range anti-join against ranges that do not overlap: the last range that starts at or
    before a hit decides, so it is an as-of lookup and forms no pairs."""
    marks = ranges.select(F.col(key), F.col("start_line").alias("line_no"), "end_line")
    both = hits.withColumn("_row", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("_order", F.when(F.col("_row"), 1).otherwise(0))
    placed = frames.running_last(both, [key], "line_no", F.col("end_line"), "_until", tie=["_order"])
    return placed.filter("_row and (_until is null or _until < line_no)").select(*hits.columns)


# Names under which database handles and process modules are known.
RECEIVERS = ("db", "database", "connection", "conn", "client", "pool", "mysql", "pg", "knex", "sequelize", "prisma", "cursor", "cur", "stmt", "statement", "em", "session", "engine", "jdbcTemplate", "child_process")


def gate_receivers(calls: DataFrame) -> DataFrame:
    """Calls whose receiver, or the module behind it, is a known handle."""
    known = F.broadcast(calls.sparkSession.createDataFrame([(r,) for r in RECEIVERS], "known string"))
    base = F.regexp_extract(F.col("resolved") if "resolved" in calls.columns else F.col("receiver"), r"^(\w+)", 1)
    return calls.join(known, F.regexp_replace(base, r"\d+$", "") == F.col("known"), "left_semi")


def validation_gates(lines: DataFrame, assigns: DataFrame) -> DataFrame:
    """Variables checked against an anchored pattern with an exit in the next 10 lines,
    before the block closes: (file, scope, var)."""
    check = r"if\s*\(\s*!\s*preg_match\s*\(\s*\$(\w+)\s*,\s*\$(\w+)\s*\)"
    php = facts.with_scope(lines).filter("lang = 'php'")
    text, line = F.col("text"), F.col("line_no")
    marked = php.select(
        "file_id", "scope_id", "line_no",
        F.regexp_extract(text, check, 1).alias("var"), F.regexp_extract(text, check, 2).alias("checked"),
        F.when(text.rlike(r"\b(?:exit|die|return)\b"), line).alias("exit"),
        F.when(F.trim(text) == "}", line).alias("close"),
    ).filter("var <> '' or exit is not null or close is not null")
    judged = frames.framed(
        marked, ["file_id"], "line_no", {"exits": (F.min("exit"), 1, 10), "closes": (F.min("close"), 1, 10)}
    ).filter("var <> '' and exits is not null and (closes is null or exits < closes)")
    quoted = r"^[\"'](.+)[\"']$"
    patterns = assigns.filter(F.col("rhs").rlike(quoted))
    placed = nearest_assignment(judged.select(*VAR, "line_no", "checked"), patterns)
    return (
        placed.filter(F.regexp_extract("rhs", quoted, 1).rlike(r"^/\^.*\$/[a-z]*$"))
        .select("file_id", "scope_id", F.col("checked").alias("var")).distinct()
    )


def subtract_validated(taint: DataFrame, gates: DataFrame) -> DataFrame:
    """User taint minus validated variables; other labels stay."""
    cleared = gates.select(*VAR).withColumn("label", F.lit("user"))
    return taint.join(by_key(cleared), [*VAR, "label"], "left_anti")


ALLOW_LIST = r"^\s*if\s+(\w+)\s+(?:not\s+)?in\s+[\[({\w]"


def allow_listed(lines: DataFrame) -> DataFrame:
    """Python variables compared with an allow-list: (file, scope, var, line)."""
    return (
        facts.with_scope(lines).filter("lang = 'python'").withColumn("var", F.regexp_extract("text", ALLOW_LIST, 1))
        .filter("var <> ''").select(*VAR, "line_no")
    )


ARGV = r"""[\[({]\s*((?:["'][^"']*["']|[$\w.]+)(?:\s*,\s*(?:["'][^"']*["']|[$\w.]+))+)\s*[\])}]"""


def shell_argv(lines: DataFrame) -> DataFrame:
    """``[shell, flag, command...]`` arrays: shell name and the command elements."""
    element = F.transform(F.split(F.regexp_extract("text", ARGV, 1), ","), lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", ""))
    return (
        facts.with_scope(lines).withColumn("argv", element).filter(F.size("argv") >= 2)
        .withColumn("shell", F.substring_index(F.get("argv", F.lit(0)), "/", -1))
        .filter(F.col("shell").isin(*SHELLS) & F.get("argv", F.lit(1)).isin(*FLAGS))
        .select("file_id", "scope_id", "line_no", "shell", F.slice("argv", F.lit(3), F.size("argv")).alias("command"))
    )


def safe_object(text: Column) -> Column:
    """Object literal whose values are all literals or coerced to a plain type."""
    inner = F.regexp_extract(text, r"\{([^{}]*)\}", 1)
    value = lambda p: F.trim(F.regexp_replace(p, r"^[^:]*:", ""))
    return (inner != "") & F.forall(
        F.split(inner, ","),
        lambda p: value(p).rlike(r"""^(?:"[^"]*"|'[^']*'|[0-9.]+|true|false|null|(?:String|Number|parseInt|parseFloat|Boolean|ObjectId)\(.*)$"""),
    )
