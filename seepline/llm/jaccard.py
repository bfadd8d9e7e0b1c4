"""Near-duplicate documents: an exact Jaccard join of word shingles by adaptive multi-match prefixes.

A document's tokens, hashes of its shingles, stand in one order for all, that of the hash. Two sets whose likeness
reaches the threshold share at least m tokens of their prefixes if both prefixes hold m - 1 tokens more than the least
that must share one. A token is charged by its posting list: the prefix is lengthened by one, and one more shared token
is asked for. Charged first is each token that any other document holds: where a prefix then asks for more than it
has of these, its document has no partner and is done, which is the case of almost all that have none. Of the others,
those with equal sets form a class, postings are counted among classes, and charged is each token that more than
HEAVY of them hold. As no pair shares more heavy tokens than were charged, one of the shared tokens is light, so
postings of light tokens alone find all candidates. Classes with too few light tokens (members of large families
of near copies) are candidates of each other by their heavy tokens too.

Postings aren't paired. Each list names a hub, its member with the fewest rare tokens; a list's members join the hub's
family. Families first move with prefixes alone: a class stays in one only if some member shares as many prefix tokens as
both ask for. Then each class comes with its whole text, compressed, to one of its families, in blocks of bounded mass;
within a block it is held against such members that aren't yet in its component. What is left after that first comparison
is little: families move with prefixes again, and only members of different components that may be linked come
together, those of families of more than one block as the classes not in its largest component against all blocks.
What comes out are links that keep components as they are, never all pairs of a family.

Null, empty and blank texts have no shingles and are linked with nothing. Texts shorter than a shingle have one, all of
their words. Null and repeated ids are kept: documents are told apart by their rows, classes by their sets; `component_id`
is the smallest id of a component (null if all are null; a document without shingles: its own). Other columns aren't read.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import mix, range_hashes
from .rows import CHARACTERS, slices
from .store import Written, release

#: Classes that hold a token before it is charged; shingles and rows of a block; tokens that a task works on at once.
HEAVY, MASS, MEMBERS, TOKENS = 32, 1 << 18, 512, 1 << 20
_C = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as ascending 64-bit hashes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    edges = np.cumsum([0] + [len(r) + 1 for r in raw])
    solid = np.concatenate([[False], ~_SPACE[data], [False]])
    starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(~solid[1:] & solid[:-1])
    words = range_hashes(data, starts, ends)
    first = np.searchsorted(starts, edges)
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = mix(rolled * _C + words[k : k + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = mix(whole * _C + words[k : k + 1])
            out.append(whole)
        else:
            out.append(words[:0])
    return out


def prefix_base(n: int, num: int, den: int) -> int:
    """Tokens of a set of n, in any order, of which a set that reaches num/den shares one."""
    return n - -(-num * n // den) + 1


def most_matches(n: int, num: int, den: int) -> int:
    """Up to so many shared tokens a set of n may ask for."""
    return 5 + prefix_base(n, num, den) // 2


def partnerless(n: int, held: list[int], num: int, den: int) -> bool:
    """Whether some prefix asks for more shared tokens than it has; held: places of tokens that another set holds (ascending).

    Tokens are counted among longest prefixes, so no more is asked for than that of the smallest partner holds.
    """
    base, most = prefix_base(n, num, den), most_matches(-(-num * n // den), num, den)
    for k, place in enumerate([*held, n + base + len(held)]):
        if place >= base + k:  # the prefix that asks for k + 1 has k
            return k < most and base + k <= n
    raise AssertionError


def choose(n: int, heavy: list[int], num: int, den: int) -> tuple[int, bool]:
    """Shared tokens to ask for, given the places of heavy tokens (ascending); whether light tokens are too few for that.

    What a class asks for by light tokens alone stays within what its smallest partner may ask for, so it's never more than a hot partner asks.
    """
    base, most = prefix_base(n, num, den), most_matches(-(-num * n // den), num, den)
    for k, place in enumerate([*heavy, n + base + len(heavy)]):
        if place >= base + k:  # with k heavy ones the prefix ends before this one
            asked = k + 1
            return (asked, False) if asked <= most and base + asked - 1 <= n else (min(most_matches(n, num, den), n - base + 1), True)
    raise AssertionError


def _scan(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, key (of the text), n, class (16 bytes), wide (the longest prefix that may be asked for; tokens of 48 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], size)
                wide = [s[: prefix_base(len(s), num, den) + most_matches(len(s), num, den) - 1] >> np.uint64(16) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("key").slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([w.astype(np.int64) for w in wide], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "n", "class", "wide"],
                )

    return docs.mapInArrow(run, "doc_id long, key long, n long, class binary, wide array<long>")


def _counted(tokens: DataFrame, row: str) -> DataFrame:
    """tokens: row, n, place, token. Each row beside those of its tokens that another row holds too: row, n, at (array of place, token, df)."""
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    return tokens.join(shared, "token").groupBy(row, "n").agg(F.collect_list(F.struct("place", "token", "df")).alias("at"))


def _partnered(counted: DataFrame, num: int, den: int) -> DataFrame:
    """The rows that may have partners. counted: of `_counted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at")
            places, bounds = at.flatten().field("place").to_numpy(), at.offsets.to_numpy() - at.offsets[0].as_py()
            kept = [not partnerless(n, sorted(places[a:b].tolist()), num, den) for n, a, b in zip(batch.column("n").to_pylist(), bounds[:-1], bounds[1:], strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return counted.mapInArrow(run, counted.schema)


def _asked(counted: DataFrame, num: int, den: int) -> DataFrame:
    """cid, n, asked, rare (places of the longest prefix that no other class holds), held (tokens of the prefix that another class holds) and tokens, those of them that index a class. counted: cid, n, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_tokens(batch, "at"):
                yield _choices(part, num, den)

    return counted.mapInArrow(run, "cid long, n long, asked long, rare long, held array<long>, tokens array<long>")


def _by_tokens(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows that hold at most TOKENS list members together (a longer row is alone)."""
    ends = np.cumsum(batch.column(column).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, "right")))
        yield batch.slice(a, b - a)
        a = b


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.ListArray:
    """A list for each of n rows. rows: the row of each value, ascending."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32()), pa.array(values, pa.int64()))


def _choices(batch: pa.RecordBatch, num: int, den: int) -> pa.RecordBatch:
    """What `_asked` gives for some rows."""
    n, at = batch.column("n").to_numpy(), batch.column("at")
    sizes = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(batch)), sizes)
    flat = at.flatten()
    place, token, df = (flat.field(c).to_numpy() for c in ("place", "token", "df"))
    order = np.lexsort((place, row))
    place, token, heavy = place[order], token[order], df[order] > HEAVY
    ends = np.cumsum(sizes)
    chosen = [choose(k, place[a:b][heavy[a:b]].tolist(), num, den) for k, a, b in zip(n.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True)]
    asked, hot = np.array([c[0] for c in chosen], np.int64), np.array([c[1] for c in chosen], bool)
    base = n - -(-num * n // den) + 1
    held = place < (base + asked - 1)[row]
    index = held & (hot[row] | ~heavy)
    columns = [batch.column("cid"), batch.column("n"), pa.array(asked), pa.array(base + 5 + base // 2 - 1 - sizes), _lists(token[held], row[held], len(batch)), _lists(token[index], row[index], len(batch))]
    return pa.RecordBatch.from_arrays(columns, names=["cid", "n", "asked", "rare", "held", "tokens"])


def _near(shared: np.ndarray, x: int, n: np.ndarray, asked: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which members share as many prefix tokens with x as both ask for, and are of a size that can be linked."""
    return (shared >= np.minimum(asked, asked[x])) & (den * np.minimum(n, n[x]) >= num * np.maximum(n, n[x]))


def _paired(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """family, cid of the members that may be linked to one of another component. dealt: family, block, side, cid, n, asked, held, component; sides as in `block_links`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (family, _), rows in _groups(batches, ["family", "block"]):
            rows = _once(rows)
            n, asked, sides, component, cid = (rows.column(c).to_numpy() for c in ("n", "asked", "side", "component", "cid"))
            lists = rows.column("held").combine_chunks()
            held = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1])
            tokens, members = np.concatenate(held), np.repeat(np.arange(len(cid)), [len(h) for h in held])
            by_token = np.argsort(tokens, kind="stable")
            posted, tokens = members[by_token], tokens[by_token]
            kept = np.zeros(len(cid), bool)
            for x in np.flatnonzero(sides == 0):
                if kept[x] and sides.max() == 0:
                    continue
                lo, hi = np.searchsorted(tokens, held[x]), np.searchsorted(tokens, held[x], "right")
                near = np.concatenate([posted[:0], *(posted[a:b] for a, b in zip(lo, hi, strict=True))])
                able = _near(np.bincount(near, minlength=len(cid)), x, n, asked, num, den) & (component != component[x])
                if able.any():
                    kept[x] = True
                    kept |= able
            yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.sum(), family)), pa.array(cid[kept])], names=["family", "cid"])

    placed = dealt.repartition("family", "block").sortWithinPartitions("family", "block")
    return placed.mapInArrow(run, "family long, cid long").distinct()


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, text (compressed) of the wanted classes (cid, doc_id, key). A compressed text takes a quarter of what its set of hashes takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            packed = [packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(packed, pa.binary())], names=["cid", "text"])

    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["key"] == wanted["key"])
    return docs.join(wanted, same).select("cid", "text").mapInArrow(run, "cid long, text binary").dropDuplicates(["cid"])


def block_links(sets: list[np.ndarray], asked: np.ndarray, sides: np.ndarray, component: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what the block's pairs connect, beyond what the given components do. sides: 0 held against 1 and 0; 1 only against 0."""
    n = np.array([len(s) for s in sets])
    ends = np.cumsum(n)
    starts = ends - n
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    lengths = np.minimum(n, np.array([prefix_base(int(k), num, den) for k in n]) + asked - 1)
    members = np.repeat(np.arange(len(sets)), lengths)
    places = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    order = np.argsort(flat[places], kind="stable")
    posted, sorted_tokens = members[order], flat[places][order]
    component, links = component.copy(), []
    mark = np.zeros(int(flat.max()) + 1, bool)
    for x in np.flatnonzero(sides == 0):
        own = flat[starts[x] : starts[x] + lengths[x]]
        lo, hi = np.searchsorted(sorted_tokens, own), np.searchsorted(sorted_tokens, own, "right")
        near = np.concatenate([posted[a:b] for a, b in zip(lo, hi, strict=True)])
        shared = np.bincount(near, minlength=len(sets))
        able = _near(shared, x, n, asked, num, den) & (component != component[x])
        able[(sides == 0) & (np.arange(len(sets)) < x)] = False
        found = np.flatnonzero(able)
        if not len(found):
            continue
        mark[flat[starts[x] : ends[x]]] = True
        sizes = n[found]
        at = np.repeat(starts[found] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        both = np.add.reduceat(mark[flat[at]], np.cumsum(sizes) - sizes, dtype=np.int64)
        mark[flat[starts[x] : ends[x]]] = False
        for y in found[den * both >= num * (n[x] + sizes - both)]:
            if component[x] != component[y]:
                links.append((int(x), int(y)))
                component[component == component[y]] = component[x]
    return links


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal keys (numbers)."""
    now, parts = None, []
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in keys]
        new = np.ones(len(batch), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        starts = np.flatnonzero(new).tolist()
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            key = tuple(int(c[a]) for c in columns)
            if key != now:
                if parts:
                    yield now, pa.Table.from_batches(parts)
                now, parts = key, []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield now, pa.Table.from_batches(parts)


def _once(rows: pa.Table) -> pa.Table:
    """The rows of a block, each class once, by its number: as one that asks (side 0), if it does."""
    cid = rows.column("cid").to_numpy()
    order = np.lexsort((rows.column("side").to_numpy(), cid))
    _, first = np.unique(cid[order], return_index=True)
    return rows.take(pa.array(order[first]))


def _unpacked(packed: Iterator[bytes], size: int) -> list[np.ndarray]:
    """The shingles of compressed texts, of which few are held at once."""
    unpacker = zstandard.ZstdDecompressor()
    sets, texts, characters = [], [], 0
    for p in packed:
        texts.append(unpacker.decompress(p).decode("utf-8", "surrogatepass"))
        characters += len(texts[-1])
        if characters > CHARACTERS:
            sets += shingle_sets(texts, size)
            texts, characters = [], 0
    return sets + shingle_sets(texts, size) if texts else sets


def _compare(dealt: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b). dealt: family, block, side, cid, asked, component, text (compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ["family", "block"]):
            rows = _once(rows)
            sets = _unpacked((t.as_py() for t in rows.column("text")), size)
            asked, sides, component, cid = (rows.column(c).to_numpy() for c in ("asked", "side", "component", "cid"))
            links = np.array(block_links(sets, asked, sides, component, num, den), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(cid[links[:, 0]]), pa.array(cid[links[:, 1]])], names=["a", "b"])

    placed = dealt.repartition("family", "block").sortWithinPartitions("family", "block")
    return placed.mapInArrow(run, "a long, b long")


def _blocks() -> Column:
    """Blocks that some classes (n: their shingles) take, of bounded mass and number."""
    return F.greatest(F.ceil(F.sum("n") / MASS), F.ceil(F.count("*") / MEMBERS))


def _massed(families: DataFrame) -> DataFrame:
    """family, cid, n, other columns: those of more than one member, with blocks, the blocks of bounded mass that a family takes."""
    mass = families.groupBy("family").agg(_blocks().alias("blocks"), F.count("*").alias("members")).where("members > 1")
    return families.join(mass.drop("members"), "family")


def _whole(massed: DataFrame) -> DataFrame:
    """Families of one block: all members are held against each other."""
    return massed.where("blocks = 1").drop("blocks").withColumn("block", F.lit(0).cast("long")).withColumn("side", F.lit(0))


def _among_hub(massed: DataFrame) -> DataFrame:
    """Blocks of families, in each of which the hub stands too."""
    block = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    spread = F.when(F.col("family") == F.col("cid"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(block))
    return massed.withColumn("block", F.explode(spread)).drop("blocks").withColumn("side", F.lit(0))


def _beyond_main(massed: DataFrame) -> DataFrame:
    """Families of several blocks: members that aren't in their family's largest component, in blocks, are held against all members, in blocks."""
    large = massed.where("blocks > 1")
    parts = large.groupBy("family", "component").agg(F.count("*").alias("members"))
    main = parts.groupBy("family").agg(F.max(F.struct("members", "component")).alias("main"))
    large = large.join(main, "family").withColumn("asks", F.col("component") != F.col("main.component")).drop("main")
    rows = large.where("asks").groupBy("family").agg(_blocks().alias("ask_blocks"))
    placed = large.join(rows, "family").withColumn("column", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda c: F.pmod(F.xxhash64("cid"), F.col("ask_blocks")) * F.col("blocks") + c)
    down = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ask_blocks") - 1), lambda r: r * F.col("blocks") + F.col("column"))
    asking = placed.where("asks").withColumn("block", F.explode(across)).withColumn("side", F.lit(0))
    # those that ask are held against each other too: each stands in the column of its own block as well
    held = placed.withColumn("block", F.explode(down)).withColumn("side", F.lit(1))
    return asking.unionByName(held).drop("asks", "ask_blocks", "column", "blocks")


def _left(families: DataFrame) -> DataFrame:
    """family, cid of families of several components; of those with the same members, one. families: family, cid, component."""
    several = families.groupBy("family").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), *(F.sum(F.xxhash64("cid", F.lit(k)).cast("decimal(38,0)")).alias(f"sum{k}") for k in (0, 1))
    )
    one = several.where("low <> high").groupBy("members", "sum0", "sum1").agg(F.min("family").alias("family"))
    return families.join(one.select("family"), "family").select("family", "cid")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (xxhash64 of the text), n_shingles, component (a number; null without shingles), component_id, of each row. Linked: den * intersection >= num * union."""
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    given = given.withColumn("key", F.xxhash64("text"))
    scanned = Written(_scan(given, size, num, den).withColumn("rid", F.monotonically_increasing_id()), "shingles")
    tokens = scanned.df.select("rid", "n", F.posexplode("wide").alias("place", "token"))
    partnered = Written(_partnered(_counted(tokens, "rid"), num, den), "partnered")
    release(spark)

    rows = partnered.df.join(scanned.df.select("rid", "class", "doc_id", "key"), "rid")
    own = rows.groupBy("class").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "key")).alias("least"), F.first("n").alias("n"), F.first("at").alias("at"))
    classes = Written(own, "classes")
    # fewer rows share fewer tokens, so the same question sends more of them away, as long as that pays
    left, size_now = Written(classes.df.select("cid", "n", "at"), "left"), None
    while True:
        held = left.df.select("cid", "n", F.explode("at").alias("x")).select("cid", "n", "x.place", "x.token")
        after = Written(_partnered(_counted(held, "cid"), num, den), "left")
        left.drop()
        left, size_before, size_now = after, size_now, after.df.count()
        if size_before is not None and size_now >= 0.9 * size_before:
            break
    indexed = Written(_asked(left.df, num, den), "prefixes")
    release(spark)

    posted = indexed.df.select("cid", "n", "rare", F.explode("tokens").alias("token"))
    hubs = posted.groupBy("token").agg(F.min(F.struct("rare", "cid")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    family = posted.join(hubs, "token").select(F.col("hub.cid").alias("family"), F.col("hub.rare").alias("hub_rare"), "cid", "n").distinct()
    joined = Written(family, "families")
    lists = indexed.df.select("cid", "asked", "held")
    apart = _massed(joined.df.withColumn("component", F.col("cid")))
    # larger families are sifted after the first comparison
    able = _paired(_whole(apart).join(lists, "cid"), num, den).unionByName(apart.where("blocks > 1").select("family", "cid"))
    families = Written(joined.df.join(able, ["family", "cid"]), "paired")
    joined.drop()
    wanted = families.df.select("cid").distinct().join(classes.df.select("cid", "least"), "cid")
    texts = Written(_texts(given, wanted.select("cid", F.col("least.doc_id").alias("doc_id"), F.col("least.key").alias("key"))), "texts")
    release(spark)

    # each class is compared in one family first, that of the hub with the fewest rare tokens, in which hubs meet as well
    own = families.df.groupBy("cid", "n").agg(F.min(F.struct("hub_rare", "family")).alias("hub")).select("hub.family", "cid", "n")
    hubs = families.df.where("family = cid").join(own.select("family").distinct(), "family").select("family", "cid", "n")
    payload = lists.select("cid", "asked").join(texts.df, "cid")
    once = _among_hub(_massed(own.unionByName(hubs).distinct())).withColumn("component", F.col("cid"))
    first = Written(_compare(once.join(payload, "cid"), size, num, den), "compared")
    release(spark)

    # then only those come together again that may be linked and aren't in one component yet
    known = Written(components(first.df), "components")
    named = known.df.select(F.col("node").alias("cid"), "root")
    member = families.df.select("family", "cid", "n").join(named, "cid", "left").select("family", "cid", "n", F.coalesce("root", "cid").alias("component"))
    open_families = Written(_massed(member.join(_left(member), ["family", "cid"])), "open")
    dealt = _whole(open_families.df).unionByName(_beyond_main(open_families.df))
    sifted = Written(_paired(dealt.join(lists, "cid"), num, den), "sifted")
    still = open_families.df.join(sifted.df, ["family", "cid"])
    still = Written(_massed(still.join(_left(still), ["family", "cid"]).drop("blocks")), "still")
    again = _whole(still.df).unionByName(_beyond_main(still.df)).join(payload, "cid")
    second = Written(_compare(again, size, num, den), "compared")
    found = components(first.df.unionByName(second.df))
    release(spark)

    low = classes.df.select("cid", "class", "low")
    rooted = low.join(found, low["cid"] == found["node"], "left").select("class", "low", F.coalesce("root", "cid").alias("root"))
    known = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("class", "root", "component_id")
    narrow = scanned.df.select("doc_id", "key", "n", "class", "rid").join(known, "class", "left")
    # a document without partners is alone, and so is one without shingles
    return narrow.select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("root", "rid")).alias("component"),
        F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
