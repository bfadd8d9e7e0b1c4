"""Seeds, definition-use edges and their closure.

State is narrow: (file, scope, variable, label). It is hash-partitioned on the whole key,
so the variables of one large file spread over tasks, and edges are made distinct before
the first hop so that fan-out per key is bounded by distinct variables, not by lines.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..plans.durable import by_key, cut
from ..rules.languages import ACCESS, LABEL_SEEDS, LANGUAGES
from . import brackets, facts, groups

KEY = ["file_id", "scope_id", "var", "label"]


def _langs(langs: Iterable[str] | None) -> list[str]:
    return list(langs) if langs is not None else [n for n in LANGUAGES if n != "webconfig"]


def seed_sources(assigns: DataFrame, langs: Iterable[str] | None = None, labels: Iterable[str] | None = None) -> DataFrame:
    """Assignments whose right-hand side is a source: (file, scope, var, label, line_no)."""
    lang, rhs = F.col("lang"), F.col("rhs")
    user = tx.by_language(
        lang,
        lambda l: tx.matches(rhs, l.source) & ~tx.matches(rhs, l.killer) & ~tx.matches(rhs, l.safe_source),
        langs,
    )
    db = tx.by_language(lang, lambda l: tx.matches(F.concat(F.lit("= "), rhs), l.db_source), langs)
    found = [F.when(user, F.lit("user")), F.when(db, F.lit("db"))]
    for name in _langs(langs):
        for label, pattern in LABEL_SEEDS.get(name, {}).items():
            found.append(F.when((lang == name) & rhs.rlike(pattern), F.lit(label)))
    out = assigns.select(
        "file_id", "scope_id", F.col("lhs").alias("var"), F.explode(F.array_compact(F.array(*found))).alias("label"), "line_no"
    )
    return out if labels is None else out.filter(F.col("label").isin(*labels))


def tag_parameters(params: DataFrame, langs: Iterable[str] | None = None) -> DataFrame:
    """Parameters with their verdict: user-controlled by annotation, type, default or convention."""
    lang, param = F.col("lang"), F.col("param")
    tainted = tx.by_language(
        lang,
        lambda l: (F.lit(True) if l.all_params else tx.matches(param, l.tainted_param)) & ~tx.matches(param, l.safe_param),
        langs,
    )
    return params.withColumn("tainted", tainted)


def seed_parameters(params: DataFrame, langs: Iterable[str] | None = None, file_level: bool = True) -> DataFrame:
    """User-controlled parameters as seeds."""
    scope = F.lit(0) if file_level else F.col("scope_id")
    return (
        tag_parameters(params, langs).filter("tainted")
        .select("file_id", scope.cast("int").alias("scope_id"), "var", F.lit("user").alias("label"), F.col("start_line").alias("line_no"))
    )


def seed_scans(lines: DataFrame) -> DataFrame:
    """Go: variables filled by ``Scan(&v)`` hold database values; decoded bodies hold user values."""
    text = F.col("text")
    label = F.when(text.rlike(r"\.Scan\s*\("), F.lit("db")).when(
        text.rlike(r"\b(?:Decode|Unmarshal|ShouldBind(?:JSON)?|BindJSON|Bind|BodyParser)\s*\("), F.lit("user")
    )
    return (
        facts.with_scope(lines).filter((F.col("lang") == "go") & text.contains("&"))
        .withColumn("label", label).filter("label is not null")
        .select("file_id", "scope_id", F.explode(F.regexp_extract_all("text", F.lit(r"&(\w+)"), F.lit(1))).alias("var"), "label", "line_no")
    )


def def_use_edges(assigns: DataFrame, langs: Iterable[str] | None = None) -> DataFrame:
    """(file, scope, src, dst, label, line_no): user taint follows any use that is not
    killed, second-order labels follow property, index and getter access."""
    lang, rhs = F.col("lang"), F.col("rhs")
    killed = tx.by_language(lang, lambda l: tx.matches(rhs, l.killer), langs)
    uses = F.when(~killed, F.transform(tx.identifiers(rhs, lang, langs), lambda t: F.struct(t.alias("src"), F.lit("user").alias("label"))))
    base = tx.by_language(
        lang, lambda l: F.regexp_extract(rhs, ACCESS[l.name], 1), [n for n in _langs(langs) if n in ACCESS]
    )
    # Only languages with decoder labels pass them on.
    carried = F.lit(["db"])
    if any(n in LABEL_SEEDS for n in _langs(langs)):
        carried = F.when(lang.isin(*LABEL_SEEDS), F.lit(["db", "json", "unser"])).otherwise(carried)
    access = F.when(base != "", F.transform(carried, lambda x: F.struct(base.alias("src"), x.alias("label"))))
    none = F.array().cast("array<struct<src:string,label:string>>")
    return (
        assigns.select(
            "file_id", "scope_id", "line_no", F.col("lhs").alias("dst"),
            F.explode(F.concat(F.coalesce(uses, none), F.coalesce(access, none))).alias("e"),
        )
        .select("file_id", "scope_id", "e.src", "dst", "e.label", "line_no")
        .filter("src <> dst")
    )


# Calls that store their argument in the receiver.
BUILDERS = r"\b(\w+)\.(?:append|add|addAll|push|put|insert|concat|WriteString|write|Append|AppendFormat|Add)\s*\((.*)\)"


def builder_edges(lines: DataFrame, langs: Iterable[str] | None = None) -> DataFrame:
    """Receiver takes taint from what is appended to it, chained calls included."""
    chain = (
        facts.with_scope(lines).filter(tx.may_match(F.col("text"), BUILDERS))
        .withColumn("dst", F.regexp_extract("text", BUILDERS, 1))
        .withColumn("arg", F.regexp_extract("text", BUILDERS, 2))
        .filter("dst <> ''")
    )
    return (
        facts.explode_tokens(chain, "arg", langs, "src").filter("src <> dst")
        .select("file_id", "scope_id", "src", "dst", F.lit("user").alias("label"), "line_no")
    )


def wrapper_edges(assigns: DataFrame) -> DataFrame:
    """``x = new A(new B(y))``: the wrapper takes taint from constructor arguments, any depth."""
    inner = assigns.filter(F.col("rhs").rlike(r"^\s*new\s+\w+")).withColumn(
        "arg", F.regexp_extract("rhs", r"^\s*new\s+[\w.<>]+\s*\((.*)\)", 1)
    )
    return (
        inner.withColumn("src", F.explode(F.array_distinct(F.regexp_extract_all(
            F.regexp_replace("arg", r'"[^"]*"', '""'), F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))))
        .filter("src <> 'new' and src <> lhs")
        .select("file_id", "scope_id", "src", F.col("lhs").alias("dst"), F.lit("user").alias("label"), "line_no")
    )


def lambda_edges(lines: DataFrame) -> DataFrame:
    """Lambda parameters take taint from arguments at ``.accept/.apply/.test`` and where the
    lambda is handed over beside the argument."""
    text = F.col("text")
    scoped = facts.with_scope(lines)
    bindings = (
        scoped.filter(text.contains("->"))
        .withColumn("holder", F.regexp_extract("text", r"(\w+)\s*=\s*\(?([\w\s,]*)\)?\s*->", 1))
        .withColumn("p", F.explode(F.split(F.regexp_extract("text", r"(\w+)\s*=\s*\(?([\w\s,]*)\)?\s*->", 2), ",")))
        .withColumn("dst", F.regexp_extract("p", r"(\w+)\s*$", 1))
        .filter("holder <> '' and dst <> ''").select("file_id", "scope_id", "holder", "dst").distinct()
    )
    invoked = (
        scoped.filter(text.contains("accept") | text.contains("apply") | text.contains("test"))
        .withColumn("holder", F.regexp_extract("text", r"(\w+)\s*\.\s*(?:accept|apply|test)\s*\(\s*([^)]+)\)", 1))
        .withColumn("args", F.regexp_extract("text", r"(\w+)\s*\.\s*(?:accept|apply|test)\s*\(\s*([^)]+)\)", 2))
        .filter("holder <> ''")
        .withColumn("src", F.explode(F.regexp_extract_all("args", F.lit(r"([A-Za-z_]\w*)"), F.lit(1))))
        .select("file_id", "scope_id", "holder", "src", "line_no")
    )
    parts = F.transform(F.split(F.regexp_extract("text", r"\w+\s*\(\s*([^()]+)\)", 1), ","), lambda p: F.trim(p))
    # only a name may hold a lambda; the parts are worked out once, within the array
    holders = groups.once(parts, lambda ps: F.transform(
        F.filter(F.array_distinct(ps), lambda h: (F.size(ps) >= 2) & h.rlike(r"\A\w+\z")), lambda h: F.struct(h.alias("holder"), ps.alias("parts"))))
    handed = (
        scoped.filter(~text.contains("->") & text.contains(",") & text.contains("("))
        .select("file_id", "scope_id", "line_no", F.explode(holders).alias("h")).select("file_id", "scope_id", "line_no", "h.*")
    )
    keys = ["file_id", "scope_id", "holder"]
    beside = handed.join(by_key(bindings), keys).withColumn("src", F.explode("parts")).filter("holder <> src").drop("parts")
    return (
        invoked.join(by_key(bindings), keys).unionByName(beside)
        .filter("src <> dst")
        .select("file_id", "scope_id", "src", "dst", F.lit("user").alias("label"), "line_no")
    )


# Query operators that hand elements of their receiver on.
LINQ = r"(\w+)\.(?:Select|SelectMany|Where|Aggregate|OrderBy|Concat|Zip|First|Single|ToList|ToArray)\s*\(\s*\(?\s*(\w+)\s*(?:,\s*(\w+)\s*)?\)?\s*=>"


def linq_edges(lines: DataFrame) -> DataFrame:
    """Lambda parameters of query operators take taint from the receiver."""
    names = F.array(F.regexp_extract("text", LINQ, 2), F.regexp_extract("text", LINQ, 3))
    return (
        facts.with_scope(lines).filter(F.col("text").contains("=>"))
        .withColumn("src", F.regexp_extract("text", LINQ, 1)).withColumn("dst", F.explode(names))
        .filter("src <> '' and dst <> '' and src <> dst")
        .select("file_id", "scope_id", "src", "dst", F.lit("user").alias("label"), "line_no")
    )


def wildcard_seeds(lines: DataFrame) -> DataFrame:
    """``extract($_GET)`` and one-argument ``parse_str`` taint every variable of the file."""
    hit = F.col("text").rlike(r"\bextract\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)\b|\bparse_str\s*\(\s*[^,)]+\)")
    return facts.with_scope(lines).filter((F.col("lang") == "php") & hit).select(
        "file_id", "scope_id", F.lit("*").alias("var"), F.lit("user").alias("label"), "line_no"
    )


#: Frontiers of at most so many rows, some MB, are sent to all tasks, so that nothing else moves in their hops.
SMALL = 50_000


def propagate(seeds: DataFrame, edges: DataFrame, max_hops: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Closure of seeds over edges: (file, scope, var, label, origin_line, hop).

    ``hop`` is the least number of edges from a seed and ``origin_line`` the first seed line over all shortest ways. Edges
    without a label column carry any label, or those of an array ``labels``. ``known`` rows (KEY) are reached already and are neither reached again nor
    returned. Small groups are closed in their rows (`groups`), others by hops over tables (`propagate_hops`).
    """
    on = [c for c in ("file_id", "scope_id", "label") if c != "label" or "label" in edges.columns]
    own = [c for c in ("var", "label") if c not in on]
    some = ["labels"] if "labels" in edges.columns else []
    parts = {"edges": edges.select(*on, "src", "dst", *some), "seeds": seeds.select(*on, *own, F.col("line_no").cast("int").alias("line_no"))}
    if known is not None:
        parts["known"] = known.select(*on, *own)
    met = groups.gather(parts, on, "seeds")
    node = lambda var, x, line, hop: F.struct(
        var.alias("var"), *(x[c].alias(c) for c in own[1:]), line.cast("int").alias("origin_line"), hop.cast("int").alias("hop"))
    equal = lambda a, b: (a["var"] == b["var"]) & (a["label"] == b["label"]) if "label" in own else a["var"] == b["var"]
    start = groups.firsts(F.transform("seeds", lambda s: node(s["var"], s, s["line_no"], F.lit(0))), equal)
    if known is not None:
        start = F.concat(F.transform("known", lambda k: node(k["var"], k, F.lit(None), F.lit(-1))), start)

    def step(reached: Column, hop: Column) -> Column:
        last = F.filter(reached, lambda r: r["hop"] == hop - 1)
        led = F.flatten(F.transform(last, lambda f: F.transform(
            F.filter("edges", lambda e: (e["src"] == f["var"]) & F.array_contains(e["labels"], f["label"]) if some else e["src"] == f["var"]), lambda e: node(e["dst"], f, f["origin_line"], hop))))
        fresh = F.filter(led, lambda x: ~F.exists(reached, lambda r: equal(r, x)))
        return F.concat(reached, groups.firsts(fresh, equal))

    closed = F.filter(groups.rounds(F.col("edges"), start, step, max_hops), lambda r: r["hop"] >= 0)
    rows, large = _close(met, on, closed)
    small = rows.select(*(f"r.{c}" if c in own else c for c in KEY), "r.origin_line", "r.hop")
    if large is None:
        return small
    each = edges.withColumn("label", F.explode("labels")).drop("labels") if some else edges
    rest = [None if d is None else d.join(by_key(large), on, "left_semi") for d in (seeds, each, known)]
    return small.unionByName(propagate_hops(rest[0], rest[1], max_hops, rest[2]))


def _close(met: DataFrame, on: list[str], closed: Column) -> tuple[DataFrame, DataFrame | None]:
    """on and r, an element of the array `closed`, for gathered groups that are whole; the keys of those that are too large, if there are any."""
    # one row without an element stands for a large group
    out = cut(met.select(*on, "n", F.explode_outer(F.when(F.col("n") <= groups.IN_ROW, closed)).alias("r")))
    large = out.filter(F.col("n") > groups.IN_ROW).select(*on)
    return out.filter(F.col("r").isNotNull()), None if large.isEmpty() else cut(large.distinct())


def propagate_hops(seeds: DataFrame, edges: DataFrame, max_hops: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """`propagate` by hops over tables dealt by the whole key, for groups of any size.

    Breadth-first: only newly reached keys travel in a hop, and the loop ends when a hop
    reaches nothing new.
    """
    on = [c for c in KEY if c != "label" or "label" in edges.columns]
    # Distinct before the first hop: a hop reads names only, once per pair of names.
    steps = cut(edges.select(*[F.col("src").alias(c) if c == "var" else F.col(c) for c in on], "dst").distinct())
    frontier = cut(
        seeds.groupBy(*KEY).agg(F.min("line_no").cast("int").alias("origin_line")).withColumn("hop", F.lit(0))
    )
    reached = [frontier]
    hop = 0
    rows = frontier.count()
    while rows and (max_hops is None or hop < max_hops):
        hop += 1
        seen = _union([*(r.select(*KEY) for r in reached), *([] if known is None else [known.select(*KEY)])])
        met = F.broadcast(frontier).join(steps, on) if rows <= SMALL else frontier.join(by_key(steps), on)
        found = (
            met.groupBy("file_id", "scope_id", F.col("dst").alias("var"), "label")
            .agg(F.min("origin_line").alias("origin_line"))
        )
        frontier = cut(_without(found, seen, rows).withColumn("hop", F.lit(hop)))
        rows = frontier.count()
        if rows:
            reached.append(frontier)
    return _union(reached)


def _without(found: DataFrame, seen: DataFrame, rows: int) -> DataFrame:
    """found less what was seen; a hop from a small frontier (of so many rows) looks up its own keys only, so that seen rows stay where they are."""
    if rows <= SMALL:
        found = cut(found)
        if found.count() <= SMALL:
            seen = seen.join(F.broadcast(found.select(*KEY)), KEY, "left_semi")
    return found.join(by_key(seen), KEY, "left_anti")


def chains(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """The way of each reached key from its seed: KEY, origin_line, chain (variables in order, the seed's first).

    reached: of `propagate`, over these edges. A key's predecessor is the least variable one hop before it. Small groups are
    put together in their rows.
    """
    on = [c for c in ("file_id", "scope_id", "label") if c != "label" or "label" in edges.columns]
    own = [c for c in ("var", "label") if c not in on]
    met = groups.gather({"edges": edges.select(*on, "src", "dst"), "reached": reached.select(*on, "hop", *own, "origin_line")}, on, "reached")

    def step(ways: Column, r: Column) -> Column:
        before = F.filter(ways, lambda w: (w["hop"] == r["hop"] - 1) & (w["label"] == r["label"] if "label" in own else F.lit(True)) & F.exists("edges", lambda e: (e["src"] == w["var"]) & (e["dst"] == r["var"])))
        least = F.array_min(F.transform(before, lambda w: F.struct(w["var"], w["chain"])))
        chain = F.concat(F.coalesce(least["chain"], F.array().cast("array<string>")), F.array(r["var"]))
        return F.array_append(ways, F.struct(*(r[c].alias(c) for c in ("hop", *own, "origin_line")), chain.alias("chain")))

    none = F.array().cast("array<struct<hop:int," + "".join(f"{c}:string," for c in own) + "origin_line:int,chain:array<string>>>")
    rows, large = _close(met, on, F.aggregate(F.array_sort("reached"), none, step))
    small = rows.select(*(f"r.{c}" if c in own else c for c in KEY), "r.origin_line", "r.chain")
    return small if large is None else small.unionByName(_doubled(*(d.join(by_key(large), on, "left_semi") for d in (reached, edges))))


def _doubled(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """`chains` of groups of any size, by pointer doubling.

    A round appends to each the way of the key at which it begins, so
    ways of n hops take log n rounds, and a way that has met its seed isn't joined again.
    """
    on = [c for c in KEY if c != "label" or "label" in edges.columns]
    steps = edges.select(*[F.col("src").alias(c) if c == "var" else F.col(c) for c in on], "dst").distinct()
    hops = cut(reached.select(*KEY, "origin_line", "hop"))
    before = (
        hops.join(by_key(steps), on).select("file_id", "scope_id", F.col("dst").alias("var"), "label", F.struct((F.col("hop") + 1).alias("hop"), F.col("var").alias("src")).alias("step"))
        .groupBy(*KEY).agg(F.min("step").alias("step"))
    )
    at = F.col("step.src")
    now = cut(hops.join(by_key(before), KEY, "left").select(*KEY, "origin_line", F.when(F.col("hop") > 0, at).alias("start"), F.array("var").alias("chain")))
    done = []
    while True:
        done.append(now.filter("start is null").drop("start"))
        open_ = now.filter("start is not null")
        if open_.isEmpty():
            break
        every = _union([*(d.withColumn("start", F.lit(None).cast("string")) for d in done), open_])
        first = every.select("file_id", "scope_id", F.col("var").alias("start"), "label", F.col("start").alias("new_start"), F.col("chain").alias("head"))
        now = cut(
            open_.join(by_key(first), ["file_id", "scope_id", "start", "label"])
            .select(*KEY, "origin_line", F.col("new_start").alias("start"), F.concat("head", "chain").alias("chain"))
        )
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SHIFT = 1 << 32


def propagate_passes(seeds: DataFrame, edges: DataFrame, passes: int) -> DataFrame:
    """Closure limited to ``passes`` in-order sweeps over each file.

    A sweep crosses any chain whose lines ascend, so a pass is spent only where an edge
    stands at or above the line that tainted its source. The state keeps the least
    (pass, line) per variable, packed in one long; a key travels again when it improves. Small groups are swept in
    their rows, others over tables.
    """
    on = ["file_id", "scope_id", "label"]
    met = groups.gather({"edges": edges.select(*on, "src", "dst", F.col("line_no").cast("long").alias("edge_line")), "seeds": seeds.select(*on, "var")}, on, "seeds")
    state = lambda var, at, nth: F.struct(var.alias("var"), at.cast("long").alias("at"), nth.cast("int").alias("nth"))

    def step(best: Column, nth: Column) -> Column:
        last = F.filter(best, lambda b: b["nth"] == nth - 1)
        led = F.flatten(F.transform(last, lambda f: F.transform(
            F.filter("edges", lambda e: e["src"] == f["var"]), lambda e: state(e["dst"], _arrival(f["at"], e["edge_line"]), nth))))
        better = F.filter(led, lambda x: (x["at"] < F.lit((passes + 1) * SHIFT)) & ~F.exists(best, lambda b: (b["var"] == x["var"]) & (b["at"] <= x["at"])))
        fresh = groups.firsts(better, lambda a, b: a["var"] == b["var"])
        return groups.once(fresh, lambda n: F.concat(F.filter(best, lambda b: ~F.exists(n, lambda x: x["var"] == b["var"])), n))

    start = F.array_distinct(F.transform("seeds", lambda v: state(v["var"], F.lit(SHIFT), F.lit(0))))
    rows, large = _close(met, on, groups.rounds(F.col("edges"), start, step))
    best = rows.select("file_id", "scope_id", "r.var", "label", "r.at")
    if large is not None:
        best = best.unionByName(_sweeps(*(d.join(by_key(large), on, "left_semi") for d in (seeds, edges)), passes))
    turn = F.floor(F.col("at") / F.lit(SHIFT)).cast("int")
    return best.select(*KEY, turn.alias("pass_no"), (F.col("at") % F.lit(SHIFT)).cast("int").alias("line_no"))


def _arrival(at: Column, edge_line: Column) -> Column:
    """When an edge's target is tainted whose source is since `at`."""
    turn = F.floor(at / F.lit(SHIFT)).cast("long")
    return (turn + F.when(edge_line <= at - turn * F.lit(SHIFT), 1).otherwise(0)) * F.lit(SHIFT) + edge_line


def _sweeps(seeds: DataFrame, edges: DataFrame, passes: int) -> DataFrame:
    """KEY and at, by tables dealt by the whole key."""
    steps = cut(
        edges.select("file_id", "scope_id", F.col("src").alias("var"), "label", "dst", F.col("line_no").cast("long").alias("edge_line"))
        .distinct()
    )
    best = cut(seeds.select(*KEY).distinct().withColumn("at", F.lit(SHIFT)))
    frontier = best
    while True:
        found = (
            frontier.join(by_key(steps), KEY).withColumn("at", _arrival(F.col("at"), F.col("edge_line"))).filter(F.col("at") < F.lit((passes + 1) * SHIFT))
            .groupBy("file_id", "scope_id", F.col("dst").alias("var"), "label").agg(F.min("at").alias("new_at"))
        )
        frontier = cut(
            found.join(by_key(best), KEY, "left").filter("at is null or new_at < at").select(*KEY, F.col("new_at").alias("at"))
        )
        if frontier.isEmpty():
            break
        best = cut(best.unionByName(frontier).groupBy(*KEY).agg(F.min("at").alias("at")))
    return best


def table_name_taint(assigns: DataFrame, taint: DataFrame) -> DataFrame:
    """Table-like variables fed by a database or decoded value get the label ``table``."""
    named = assigns.filter(F.col("lhs").rlike(r"(?i)table|tbl|entity"))
    used = facts.explode_tokens(named, "rhs", ["php"], "var")
    return (
        used.join(by_key(taint.filter(F.col("label").isin("db", "json")).select("file_id", "scope_id", "var").distinct()),
                  ["file_id", "scope_id", "var"], "left_semi")
        .groupBy("file_id", "scope_id", F.col("lhs").alias("var"))
        .agg(F.min("line_no").alias("line_no")).withColumn("label", F.lit("table"))
    )


def call_assignments(assigns: DataFrame, functions: DataFrame) -> DataFrame:
    """Assignments from a call of a function of the same file, one row per argument token:
    (file, scope, line, lhs, callee, arg_pos, src)."""
    names = functions.select("file_id", F.col("name").alias("callee")).distinct()
    own = (
        assigns.withColumn("callee", F.regexp_extract("rhs", r"^\s*(?:await\s+)?[$\w.]*?(\w+)\s*\((.*)\)\s*$", 1))
        .filter("callee <> ''").join(by_key(names), ["file_id", "callee"], "left_semi")
    )
    # commas within the brackets of an argument don't part it
    found = brackets.whole_calls(own, ["file_id", "lang", "scope_id", "line_no", "lhs", "callee"], "rhs")
    calls = found.select("file_id", "lang", "scope_id", "line_no", "lhs", "callee", F.posexplode("args").alias("arg_pos", "arg"))
    return facts.explode_tokens(calls, "arg", None, "src").drop("arg", "lang")


EDGE = ["file_id", "scope_id", "src", "dst"]


def without_calls(assigns: DataFrame, calls: DataFrame) -> DataFrame:
    """Assignments but those from calls of the file's own functions. calls: of `call_assignments`."""
    key = ["file_id", "scope_id", "line_no", "lhs"]
    return assigns.join(by_key(calls.select(*key).distinct()), key, "left_anti")


def summarize_functions(lines: DataFrame, functions: DataFrame, calls: DataFrame | None = None, assigns: DataFrame | None = None) -> DataFrame:
    """Which parameter positions reach the return value: (file, name, param_to_return).

    Parameters carry their position as a label through the edges of their own scope. Calls
    of summarised functions add edges for the next round, until no summary grows, however
    long a chain of calls is. Small files are summarised in their rows, others by rounds over tables. ``calls``, ``assigns``: of
    `call_assignments` and of the lines, where they are there already.
    """
    assigns = cut(facts.explode_targets(facts.extract_assignments(lines))) if assigns is None else assigns
    calls = cut(call_assignments(assigns, functions)) if calls is None else calls
    params = facts.explode_parameters(functions).select(
        "file_id", "scope_id", "var", F.col("arg_pos").cast("string").alias("label"), F.col("start_line").alias("line_no")
    )
    plain = cut(def_use_edges(without_calls(assigns, calls)).filter("label = 'user'").select(*EDGE).distinct())
    lang = F.col("lang")
    returned = (
        facts.with_scope(lines)
        .withColumn("expr", tx.by_language(lang, lambda l: F.regexp_extract("text", l.returns, 1)))
        .filter("expr <> ''")
    )
    returned = cut(facts.explode_tokens(returned, "expr", None, "var").select("file_id", "scope_id", "var").distinct())
    named = functions.select("file_id", "scope_id", "name").distinct()
    # what a file returns is named here, so that a summary needs one lookup
    given = returned.join(by_key(named), ["file_id", "scope_id"])
    parts = {
        "params": params.select("file_id", "scope_id", "var", F.col("label").cast("int").alias("pos")), "edges": plain.select(*EDGE),
        "calls": calls.select("file_id", "scope_id", "src", F.col("lhs").alias("dst"), "callee", "arg_pos"), "given": given.select("file_id", "scope_id", "var", "name"),
    }
    rows, large = _close(groups.gather(parts, ["file_id"], "params"), ["file_id"], _summaries())
    found = rows.select("file_id", "r.name", "r.arg_pos")
    if large is not None:
        found = found.unionByName(_rounds(*(d.join(by_key(large), "file_id", "left_semi") for d in (params, plain, calls, returned, named))))
    return found.groupBy("file_id", "name").agg(F.array_sort(F.collect_set("arg_pos")).alias("param_to_return"))


def _summaries() -> Column:
    """(name, arg_pos) of all summaries of a file whose params, edges, calls and given are gathered."""
    node = lambda scope, var, pos: F.struct(scope.alias("scope_id"), var.alias("var"), pos.cast("int").alias("pos"))

    def returns(reached: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform("given", lambda g: F.transform(
            F.filter(reached, lambda r: (r["scope_id"] == g["scope_id"]) & (r["var"] == g["var"])), lambda r: F.struct(g["name"].alias("name"), r["pos"].alias("arg_pos"))))))

    def over(steps: Column, nodes: Column) -> Column:
        return F.flatten(F.transform(nodes, lambda f: F.transform(
            F.filter(steps, lambda e: (e["scope_id"] == f["scope_id"]) & (e["src"] == f["var"])), lambda e: node(e["scope_id"], e["dst"], f["pos"]))))

    def step(state: Column, _: Column) -> Column:
        reached = state["reached"]
        known = lambda sums: F.filter("calls", lambda c: F.exists(sums, lambda s: (s["name"] == c["callee"]) & (s["arg_pos"] == c["arg_pos"])))
        led = F.concat(over(F.col("edges"), state["fresh"]), groups.once(returns(reached), lambda sums: groups.once(known(sums), lambda open_: over(open_, reached))))
        return F.when(F.size(state["fresh"]) == 0, state).otherwise(
            groups.once(F.array_except(led, reached), lambda fresh: F.struct(F.concat(reached, fresh).alias("reached"), fresh.alias("fresh"))))

    start = F.array_distinct(F.transform("params", lambda p: node(p["scope_id"], p["var"], p["pos"])))
    # a round reaches something new, or is the last: as many rounds as there are targets and positions are enough
    most = (F.size("edges") + F.size("calls")) * (F.array_max(F.transform("params", lambda p: p["pos"])) + 1) + 1
    done = F.aggregate(F.sequence(F.lit(1), most), F.struct(start.alias("reached"), start.alias("fresh")), step, lambda state: state["reached"])
    return groups.once(done, returns)


def _rounds(params: DataFrame, plain: DataFrame, calls: DataFrame, returned: DataFrame, named: DataFrame) -> DataFrame:
    """file_id, name, arg_pos of summaries, by rounds over tables; a round goes on from what the one before it reached."""
    edges, reached, summaries = [plain], [], []
    fresh = propagate(params, plain)
    while True:
        # what is new returns, which makes edges of calls, and these lead on from all that was reached before
        reached.append(fresh.select(*KEY))
        found = (
            fresh.join(by_key(returned), ["file_id", "scope_id", "var"], "left_semi").join(by_key(named), ["file_id", "scope_id"])
            .select("file_id", "name", F.col("label").cast("int").alias("arg_pos")).distinct()
        )
        found = cut(found.join(by_key(_union(summaries)), ["file_id", "name", "arg_pos"], "left_anti") if summaries else found)
        if found.isEmpty():
            break
        summaries.append(found)
        added = cut(summary_edges(calls, found).select(*EDGE).distinct().join(by_key(_union(edges)), EDGE, "left_anti"))
        known = _union(reached)
        led = known.join(by_key(added.withColumnRenamed("src", "var")), ["file_id", "scope_id", "var"])
        start = led.select("file_id", "scope_id", F.col("dst").alias("var"), "label").distinct().join(by_key(known), KEY, "left_anti")
        edges.append(added)
        start = cut(start.withColumn("line_no", F.lit(0)))
        if start.isEmpty():
            break
        fresh = propagate(start, _union(edges), known=known)
    if not summaries:
        summaries = [found]
    return _union(summaries)


def summary_edges(calls: DataFrame, summaries: DataFrame) -> DataFrame:
    """Arguments at returning positions carry taint to the assigned variable."""
    if "param_to_return" in summaries.columns:
        summaries = summaries.select("file_id", "name", F.explode("param_to_return").alias("arg_pos"))
    return (
        calls.join(by_key(summaries.withColumnRenamed("name", "callee")), ["file_id", "callee", "arg_pos"])
        .filter("src <> lhs")
        .select("file_id", "scope_id", "src", F.col("lhs").alias("dst"), F.lit("user").alias("label"), "line_no")
        .distinct()
    )


def interprocedural(lines: DataFrame) -> DataFrame:
    """Taint per function scope with calls of the file's own functions seen through summaries."""
    scoped = cut(facts.assign_scope(facts.drop_comments(lines)))
    functions = cut(facts.extract_functions(scoped.drop("scope_id")))
    assigns = cut(facts.explode_targets(facts.extract_assignments(scoped)))
    calls = cut(call_assignments(assigns, functions))
    summaries = summarize_functions(scoped, functions, calls, assigns)
    edges = def_use_edges(without_calls(assigns, calls)).filter("label = 'user'").unionByName(summary_edges(calls, summaries))
    seeds = seed_sources(assigns, labels=["user"]).unionByName(
        seed_parameters(facts.explode_parameters(functions), file_level=False)
    )
    return propagate(seeds, edges)
