"""Facts read off source lines: assignments, calls, functions, aliases, statements.

Every operator here is a narrow projection except the ones that place a line in its
statement or function, which use block-wise windows. Files are ``(file_id, path, lang,
content)``, lines ``(file_id, lang, line_no, text)``; a fact row carries ``scope_id``,
0 for file-level tracking.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import frames, text as tx
from ..rules.languages import CATEGORY_SANITIZERS, LANGUAGES, NEVER, QUOTED
from ..plans.durable import by_key, cut
from . import brackets, groups

LINE_KEYS = ("file_id", "lang", "scope_id", "line_no")


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select(
        "file_id", "lang", F.posexplode(tx.split_lines(F.col("content"))).alias("pos", "text")
    ).select("file_id", "lang", (F.col("pos") + 1).alias("line_no"), "text")


def drop_comments(lines: DataFrame, langs: Iterable[str] | None = None) -> DataFrame:
    """Drop lines that are comments as a whole."""
    text = F.col("text")
    # most lines have no sign of a comment, and aren't searched
    is_comment = tx.by_language(F.col("lang"), lambda l: tx.holds(text, l.comment, "#/*") & tx.matches(text, l.comment) if not l.comment.startswith(NEVER) else F.lit(False), langs)
    return lines.filter(~is_comment)


def with_scope(lines: DataFrame) -> DataFrame:
    """File-level scope unless a scope was assigned before."""
    return lines if "scope_id" in lines.columns else lines.withColumn("scope_id", F.lit(0))


def extract_assignments(lines: DataFrame, langs: Iterable[str] | None = None) -> DataFrame:
    """(lhs, rhs) of every assignment, before target lists are split."""

    def groups(n: int) -> Column:
        return tx.by_language(
            F.col("lang"), lambda l: F.regexp_extract_all(F.col("text"), F.lit(l.assign), F.lit(n)), langs
        )

    return (
        with_scope(lines)
        .filter(F.col("text").contains("="))
        .select(*LINE_KEYS, F.explode(F.arrays_zip(groups(1).alias("lhs"), groups(2).alias("rhs"))).alias("a"))
        .select(*LINE_KEYS, F.trim("a.lhs").alias("lhs"), _without_end(F.col("a.rhs")).alias("rhs"))
    )


#: Last characters of a text that ends with neither a semicolon nor white space.
LAST = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_)]}'\"`"


def _without_end(rhs: Column) -> Column:
    """The text without a closing semicolon and white space; most end with neither, and aren't searched."""
    return F.when(F.lit(LAST).contains(F.right(rhs, F.lit(1))), rhs).otherwise(F.regexp_replace(rhs, r";?\s*$", ""))


def explode_targets(assigns: DataFrame) -> DataFrame:
    """One row per assigned name: destructuring, tuple and list targets are split."""
    inner = F.translate("lhs", "{}[]()", "")

    def name(target: Column) -> Column:
        bare = F.regexp_extract(target, r"(?:.*:)?\s*(?:\.\.\.)?\s*([\w.$@>-]+)", 1)
        return F.regexp_replace(bare, r"^(?:this\.|self\.|this->)", "")

    # in the array, where each name is worked out once; a filter on a column would work it out again
    # a plain name is its own target
    targets = F.when(F.col("lhs").rlike(r"\A\w+\z"), F.array("lhs")).otherwise(F.transform(F.split(inner, ","), name))
    names = F.filter(targets, lambda n: (n != "") & (n != "_"))
    rest = [c for c in assigns.columns if c not in ("lhs", "rhs")]
    return assigns.select(*rest, F.explode(names).alias("lhs"), "rhs")


def explode_tokens(df: DataFrame, col: str, langs: Iterable[str] | None = None, out: str = "var") -> DataFrame:
    """One row per distinct identifier used in ``col``."""
    return df.withColumn(out, F.explode(tx.identifiers(F.col(col), F.col("lang"), langs)))


# Bindings that are not plain assignments (group 1 name, group 2 source).
BINDINGS = {
    "java": (r"\bfor\s*\(\s*(?:final\s+)?[\w<>\[\]]+\s+(\w+)\s*:\s*([^)]+)\)", r"\btry\s*\(\s*[\w<>]+\s+(\w+)\s*=\s*([^;]+)\)\s*\{"),
    "go": (r"\bfor\s+(?:\w+\s*,\s*)?(\w+)\s*:=\s*range\s+([^{]+)",),
    "javascript": (r"\bof\s+()([^)]+)\)", r"\.then\s*\(\s*\(?\s*(\w+)\s*\)?\s*=>()", r"\bfor\s*\(\s*(?:const|let|var)\s+(\w+)\s+of\s+([^)]+)\)"),
    "python": (r"^\s*for\s+(\w+)\s+in\s+([^:]+):", r"^\s*with\s+.*\bas\s+(\w+)()"),
    "php": (r"\bforeach\s*\(.*\bas\s+(?:\$\w+\s*=>\s*)?\$(\w+)()",),
    "csharp": (r"\bforeach\s*\(\s*\w+\s+(\w+)\s+in\s+([^)]+)\)",),
    "ruby": (r"\.each\s+do\s*\|\s*(\w+)()",),
}


def extract_bindings(lines: DataFrame, langs: Iterable[str] | None = None) -> DataFrame:
    """Loop, resource and callback variables as assignment facts.

    Where the bound expression stands before the name, the text left of it is the source.
    """
    names = [n for n in (langs or BINDINGS) if n in BINDINGS]
    found = None
    for name in names:
        per_lang = None
        for pattern in BINDINGS[name]:
            lhs = F.regexp_extract("text", pattern, 1)
            rhs = F.regexp_extract("text", pattern, 2)
            before = F.regexp_extract("text", r"^(.*?)(?:\bas\b|\.then\b|\.each\b)", 1)
            row = F.when(
                F.col("text").rlike(pattern) & (lhs != ""),
                F.struct(lhs.alias("lhs"), F.trim(F.when(rhs != "", rhs).otherwise(before)).alias("rhs")),
            )
            per_lang = row if per_lang is None else F.coalesce(per_lang, row)
        found = F.when(F.col("lang") == name, per_lang) if found is None else found.when(F.col("lang") == name, per_lang)
    return (
        with_scope(lines).withColumn("b", found).filter("b is not null")
        .select(*LINE_KEYS, "b.lhs", "b.rhs")
    )


CALL = r"([A-Za-z_$][\w$.]*(?:->\w+)*)\s*\("
# Words before a bracket that call nothing.
CONTROL = ("if", "for", "while", "switch", "return", "function", "catch", "foreach")


def extract_calls(lines: DataFrame) -> DataFrame:
    """Calls with receiver, callee and top-level arguments; nested calls ``f(g(x), y)`` give one row each.

    Arguments are read by bracket balance, linear in the length of a line, literals blanked. Calls whose brackets close on
    another line need ``assemble_statements`` first.
    """
    found = brackets.calls(with_scope(lines).filter(F.col("text").contains("(")), LINE_KEYS, "text")
    return found.select(
        *LINE_KEYS,
        "call_no",
        F.regexp_extract("name", r"^(.*?)(?:\.|->)?(\w+)$", 1).alias("receiver"),
        F.regexp_extract("name", r"([\w$]+)$", 1).alias("callee"),
        F.transform("args", lambda a: F.regexp_replace(a, QUOTED, '""')).alias("args"),
    ).filter(~F.col("callee").isin(*CONTROL))


def _bracket_surplus(text: Column) -> Column:
    """Opening less closing brackets of a line, literals left out; only lines with a quote meet the regular expression."""
    quoted = text.contains('"') | text.contains("'")
    bare = F.when(quoted, F.regexp_replace(text, r'"[^"]*"' + r"|'[^']*'", "")).otherwise(text)
    return groups.once(bare, lambda x: F.length(F.translate(x, ")]", "")) - F.length(F.translate(x, "([", "")))


def _statements(lines: Column) -> Column:
    """The statements of a file's array of lines: an array of line_no, end_line, text."""
    zero = F.array(F.lit(0))

    def of(ls: Column, before: Column, starts: Column) -> Column:
        def statement(s: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1) - 1, F.size(ls))
            whole = F.array_join(F.transform(F.slice(ls, s, end - s + 1), lambda x: F.trim(x)), " ")
            return F.struct(s.alias("line_no"), end.alias("end_line"), F.when(end == s, F.trim(F.element_at(ls, s))).otherwise(whole).alias("text"))

        return F.transform(starts, statement)

    def with_balance(ls: Column) -> Column:
        # the balance before each line, from the first on
        before = F.aggregate(ls, zero, lambda a, x: F.array_append(a, F.element_at(a, F.lit(-1)) + _bracket_surplus(x)))
        starts = lambda b: F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: F.element_at(b, i) <= 0)
        return groups.once(before, lambda b: groups.once(starts(b), lambda s: of(ls, b, s)))

    return groups.once(lines, with_balance)


def file_statements(files: DataFrame) -> DataFrame:
    """`assemble_statements` of whole files: file_id, lang, line_no, end_line, text.

    Files of at most `groups.IN_ROW` lines are read in their own rows, and nothing of them moves; longer ones by the windows over lines.
    """
    def rows(content: Column) -> Column:
        """Statements, or of a long file one row with its content."""
        breaks = F.length(content) - F.length(F.translate(content, "\r\n", ""))
        whole = F.struct(F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("text"), content.alias("content"))
        none = F.lit(None).cast("string").alias("content")
        own = F.transform(_statements(tx.split_lines(content)), lambda s: F.struct(s["line_no"].alias("line_no"), s["end_line"].alias("end_line"), s["text"].alias("text"), none))
        return F.when(breaks < groups.IN_ROW, own).when(content.isNotNull(), F.array(whole))

    # the content is worked out one time, within one expression
    out = cut(files.select("file_id", "lang", F.explode(groups.once(F.col("content"), rows)).alias("s")).select("file_id", "lang", "s.*"))
    found = out.filter("content is null").drop("content")
    large = out.filter("content is not null").select("file_id", "lang", "content")
    if large.isEmpty():
        return found
    return found.unionByName(assemble_statements(explode_lines(large)))


def assemble_statements(lines: DataFrame) -> DataFrame:
    """Join physical lines whose brackets are still open into one statement.

    An unbalanced bracket would make one statement of the rest of its file, so a
    statement is cut into pieces of ``frames.BLOCK`` lines; no line is left out.
    """
    counted = lines.withColumn("_delta", _bracket_surplus(F.col("text")))
    balanced = frames.running_sum(counted, ["file_id"], "line_no", F.col("_delta"), "balance")
    starts = F.when(F.col("balance") - F.col("_delta") <= 0, F.col("line_no"))
    placed = frames.running_last(balanced, ["file_id"], "line_no", starts, "start_line")
    piece = F.floor((F.col("line_no") - F.col("start_line")) / F.lit(frames.BLOCK))
    return (
        placed.withColumn("start_line", F.coalesce("start_line", F.lit(1)))
        .groupBy("file_id", "lang", "start_line", piece.alias("piece"))
        .agg(
            F.min("line_no").alias("line_no"),
            F.max("line_no").alias("end_line"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: F.trim(s["text"])), " "
            ).alias("text"),
        )
        .drop("start_line", "piece")
    )


def extract_functions(lines: DataFrame, langs: Iterable[str] | None = None) -> DataFrame:
    """Function headers; the scope of a function is the number of its header line."""
    lang = F.col("lang")

    def group(n: int) -> Column:
        return tx.by_language(lang, lambda l: F.regexp_extract("text", l.function, n), langs)

    return (
        lines.filter(tx.by_language(lang, lambda l: tx.may_match(F.col("text"), l.function, 3), langs)).withColumn("name", group(1))
        .filter("name <> ''")
        .select(
            "file_id", "lang", F.col("line_no").alias("scope_id"), "name",
            F.filter(F.transform(F.split(group(2), ","), lambda p: F.trim(p)), lambda p: p != "").alias("params"),
            F.col("line_no").alias("start_line"),
        )
    )


def parameter_name(param: Column, lang: Column, langs: Iterable[str] | None = None) -> Column:
    """Name declared by one parameter text."""

    def build(l) -> Column:
        if l.name in ("python", "javascript", "ruby", "go"):
            return F.regexp_extract(param, r"^[*&.]*(\w+)", 1)
        if l.name == "php":
            return F.regexp_extract(param, r"\$(\w+)", 1)
        return F.regexp_extract(param, r"(\w+)(?:\[\])?\s*(?:=.*)?$", 1)

    return tx.by_language(lang, build, langs)


def explode_parameters(functions: DataFrame, langs: Iterable[str] | None = None) -> DataFrame:
    """(scope, position, name, text) of every parameter, positions from 0."""
    return (
        functions.select("file_id", "lang", "scope_id", "name", "start_line", F.posexplode("params").alias("arg_pos", "param"))
        .withColumn("var", parameter_name(F.col("param"), F.col("lang"), langs))
        .filter("var <> ''")
    )


def assign_scope(lines: DataFrame, langs: Iterable[str] | None = None) -> DataFrame:
    """Line to enclosing function: the last header at or before it, 0 above the first."""
    header = tx.by_language(
        F.col("lang"), lambda l: F.when(tx.matches(F.col("text"), l.function), F.col("line_no")), langs
    )
    placed = frames.running_last(lines, ["file_id"], "line_no", header, "scope_id")
    return placed.withColumn("scope_id", F.coalesce("scope_id", F.lit(0)))


# Import forms (group 1 local name, group 2 module).
ALIASES = (
    r"^\s*import\s+[\w.]+\s+as\s+(\w+)()",
    r"\b(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]",
    r"^\s*import\s+(?:\*\s+as\s+)?(\w+)\s+from\s+['\"]([^'\"]+)['\"]",
)


def extract_aliases(lines: DataFrame) -> DataFrame:
    """Local name of every imported module or member."""
    text = F.col("text")
    as_name = F.regexp_extract(text, r"^\s*import\s+([\w.]+)\s+as\s+(\w+)", 2)
    as_target = F.regexp_extract(text, r"^\s*import\s+([\w.]+)\s+as\s+(\w+)", 1)
    from_module = F.regexp_extract(text, r"^\s*from\s+([\w.]+)\s+import\s+(.+)$", 1)
    from_names = F.split(F.regexp_extract(text, r"^\s*from\s+([\w.]+)\s+import\s+(.+)$", 2), ",")
    from_rows = F.transform(
        from_names,
        lambda n: F.struct(
            F.regexp_extract(n, r"(\w+)\s*$", 1).alias("alias"),
            F.concat(from_module, F.lit("."), F.regexp_extract(n, r"^\s*(\w+)", 1)).alias("target"),
        ),
    )
    one = lambda a, t: F.array(F.struct(a.alias("alias"), t.alias("target")))
    rows = F.when(as_name != "", one(as_name, as_target)).when(from_module != "", from_rows)
    for pattern in ALIASES[1:]:
        rows = rows.when(text.rlike(pattern), one(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)))
    return (
        lines.filter(text.contains("import") | text.contains("require"))
        .withColumn("a", F.explode(rows)).select("file_id", "line_no", "a.alias", "a.target").filter("alias <> ''")
    )


def resolve_aliases(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace the first part of a receiver, or a bare callee, by what was imported."""
    base = F.when(F.col("receiver") == "", F.col("callee")).otherwise(F.regexp_extract("receiver", r"^(\w+)", 1))
    targets = aliases.groupBy("file_id", "alias").agg(F.max_by("target", "line_no").alias("target"))
    return (
        calls.withColumn("alias", base)
        .join(by_key(targets), ["file_id", "alias"], "left")
        .withColumn(
            "resolved",
            F.when(F.col("target").isNull(), F.concat_ws(".", F.when(F.col("receiver") != "", F.col("receiver")), "callee"))
            .when(F.col("receiver") == "", F.col("target"))
            .otherwise(F.concat(F.col("target"), F.lit("."), F.col("callee"))),
        )
        .drop("alias", "target")
    )


def sanitized_vars(assigns: DataFrame) -> DataFrame:
    """Variables cleared for one category: (file_id, scope_id, var, category)."""
    rows = []
    for lang, by_category in CATEGORY_SANITIZERS.items():
        for category, pattern in by_category.items():
            rows.append(F.when((F.col("lang") == lang) & F.col("rhs").rlike(pattern), F.lit(category)))
    return (
        assigns.withColumn("category", F.explode(F.array_compact(F.array(*rows))))
        .select("file_id", "scope_id", F.col("lhs").alias("var"), "category")
        .distinct()
    )


def extract_scripts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Inline script bodies with the lines they span in their page."""
    opening = r"(?i)<script[^>]*>"
    bodies = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    # The n-th piece ends where the n-th body starts; line breaks up to there give the offset.
    pieces = F.split(F.col(html), opening)
    return (
        pages.select(key, pieces.alias("pieces"), F.posexplode(bodies).alias("script_no", "body"))
        .withColumn(
            "start_line",
            F.aggregate(
                F.slice("pieces", 1, F.col("script_no") + 1),
                F.lit(1),
                lambda n, piece: n + F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit(""))),
            ),
        )
        .withColumn("end_line", F.col("start_line") + F.length("body") - F.length(F.replace(F.col("body"), F.lit("\n"), F.lit(""))))
        .select(key, "script_no", "start_line", "end_line", "body")
    )


def locate(content: Column, offset: Column) -> tuple[Column, Column]:
    """(line, column) of a 1-based character offset."""
    before = F.substring(content, F.lit(1), offset - F.lit(1))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + F.lit(1)
    column = F.length(F.substring_index(before, "\n", -1)) + F.lit(1)
    return line, column


def detect_minified(files: DataFrame) -> DataFrame:
    """Flag generated or compressed files: by name, by very long lines, or as statements packed without white space.

    Rates are taken over the whole text, so that a header of comments doesn't decide.
    """
    content = F.col("content")
    lengths = F.transform(tx.split_lines(content), lambda l: F.length(l))
    lines, size = F.size(lengths), F.length(content)
    statements = size - F.length(F.replace(content, F.lit(";"), F.lit("")))
    blanks = size - F.length(F.translate(content, " \t\r\n", ""))
    name = F.lower(F.substring_index("path", "/", -1))
    return files.withColumn(
        "minified",
        name.rlike(r"[.-]min\.")
        | (F.aggregate(lengths, F.lit(0), lambda a, x: a + x) > 500 * lines)
        | (F.array_max(lengths) > 1000)
        | ((statements >= 3 * lines) & (10 * blanks < size)),
    )


def attribute_over(lines: DataFrame, name: str, limit: int) -> DataFrame:
    """Lines whose numeric attribute exceeds a limit, with its value."""
    value = F.regexp_extract("text", r"(?i)" + name + r"\s*=\s*[\"'](\d+)[\"']", 1)
    return (
        lines.withColumn("value", value.try_cast("int")).filter(F.col("value") > limit).select("file_id", "line_no", "value")
    )
