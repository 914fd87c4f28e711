"""Exact n-gram Jaccard self-join and its components, with a token-group matrix.

Texts become sets of hashed word shingles; equal sets are one class. Two linked sets of sizes a <= b share at least
ceil(b * threshold) shingles, so each lacks at most a known number of the other's. Hence both *windows* (the smallest
hashes of a set, as many as it may lack and ``MARGIN`` more) hold the first ``MARGIN`` common shingles, and of these at
least the rarest is still there when each side leaves out its ``MARGIN - 1`` most frequent ones. What is left are a
class's *tokens*: classes without a common token aren't linked.

1. Partition: classes with the same least neighbour over their tokens form groups of a bounded size. Each group is
   compared within itself, which gives first components: windows tell which members may be linked, and only their sets
   are made, from the texts.
2. Token-group matrix: for each token the groups that hold it, with the components there. First every class asks one
   group of another component, the one that holds most of its tokens among those with the least component. Such rounds
   are linear in the number of tokens, and repeat with new components as long as they find more than a few links. No
   class asks a group twice: all links that it has there are found.
3. Then a class asks every group of the matrix that may hold a linked set by tokens and sizes. Classes with a frequent
   token in common with other components first get sharper tokens from their whole sets, in place of such ones.
4. A group that is asked is opened if windows of its members, and its union of shingles, hold enough of the query's (a
   bound for every member), and the query is compared with its members, exactly.

Windows bound a pair in two ways: they share the first ``MARGIN`` common shingles, and up to the hash where the first of
them ends, a set lacks no more of the other's than linked sets of these sizes may.

All links between groups are found in opened groups. Pairs inside a component are never made: what joins nothing new
is left out, so large groups of copies cost no more than their number.

64-bit hashes stand for shingles, 128-bit hashes for sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, discard, release, stage
from .components import connected_components
from .textnum import PIECE_BYTES, mix, slices, span_hashes, utf8_parts, word_spans

#: Common shingles that two windows surely hold, if the sets have as many.
MARGIN = 32
#: Classes of a group, and queries that meet a group in one task, about; and shingles of either.
GROUP, QUERIES, SHINGLES = 512, 500, 250_000
#: A token of more classes than this is frequent.
FREQUENT = 64
#: Bits of Spark's bitmaps.
MAP_BITS = 32_768
#: Rounds end when one finds links fewer than this share of the classes.
FEW = 1 / 100

#: Makes the sets (``v``, ``n``, ``g``, ``keys``) of some classes (``v``) from their texts.
Sets = Callable[[DataFrame], DataFrame]

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the bounds of each text's.

    Words are runs of bytes other than ASCII white space, compared without ASCII case. A text of fewer than ``k``
    words, but not none, has one shingle: the whole sequence.
    """
    n = len(off) - 1
    starts, ends, of = word_spans(raw, off, _WORD)
    h = span_hashes(raw, starts, ends)
    words = np.bincount(of, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    salt = [np.uint64(2 * j + 0x632BE59BD9B4E019) for j in range(k)]
    total = len(h) - k + 1
    if total > 0:
        run = np.zeros(total, np.uint64)
        for j in range(k):
            run += mix(h[j : j + total] * salt[j])
        whole = of[:total] == of[k - 1 :]
        keys, owner = mix(run[whole]), of[:total][whole]
    else:
        keys, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for short in range(1, k):
        rows = np.flatnonzero(words == short)
        if len(rows):
            run = np.full(len(rows), short, np.uint64)
            for j in range(short):
                run += mix(h[first[rows] + j] * salt[j])
            keys, owner = np.concatenate([keys, mix(run)]), np.concatenate([owner, rows])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[fresh], owner[fresh]
    return keys, np.searchsorted(owner, np.arange(n + 1))


def _window(keys: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all sets (sorted hashes) and their bounds."""
    size = np.diff(bounds)
    common = -(-size * num // den)
    take = np.minimum(size, size - common + np.minimum(common, MARGIN))
    owner = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(keys)) - bounds[owner] < take[owner]
    return keys[inside], np.concatenate([[0], np.cumsum(take)]).astype(np.int64)


def _list(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int64)))


def _prints(keys: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """128-bit hashes of the sets."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)):
        total = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(mix(keys ^ np.uint64(salt)), out=total[1:])
        out[:, k] = mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    return pa.array([x.tobytes() for x in out], pa.binary())


def _describe(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, sets: bool) -> DataFrame:
    """Per row: ``id``, ``n``, ``print`` and either the window (``tokens``) or the set itself (``keys``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE_BYTES):
            keys, bounds = shingle_sets(*utf8_parts(batch.column("text")), k)
            out = {"id": batch.column("id"), "n": pa.array(np.diff(bounds)), "print": _prints(keys, bounds)}
            out["keys" if sets else "tokens"] = _list(keys, bounds) if sets else _list(*_window(keys, bounds, num, den))
            yield pa.record_batch(out)

    head = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType())]
    longs = T.ArrayType(T.LongType())
    more = T.StructField("keys" if sets else "tokens", longs)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType([*head, more]))


class _Members:
    """The members of one group with their shingles listed in order, to be compared with queries."""

    def __init__(self, keys: pa.ChunkedArray, num: int, den: int):
        column = keys.combine_chunks()
        bounds = np.asarray(column.offsets, np.int64)
        flat = np.asarray(column.values)[bounds[0] : bounds[-1]]
        order = np.argsort(flat, kind="stable")
        self.num, self.den, self.size = num, den, np.diff(bounds)
        self.listed, self.owner = flat[order], np.repeat(np.arange(len(self.size)), self.size)[order]

    def shared(self, keys: np.ndarray, least: int) -> np.ndarray:
        """How many shingles each member shares with a set; zeros if the group's union holds fewer than ``least``."""
        at, to = np.searchsorted(self.listed, keys, "left"), np.searchsorted(self.listed, keys, "right")
        hit = to > at
        if int(hit.sum()) < max(least, 1):
            return np.zeros(len(self.size), np.int64)
        count = (to - at)[hit]
        where = np.repeat(at[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.bincount(self.owner[where], minlength=len(self.size))

    def linked(self, keys: np.ndarray) -> np.ndarray:
        """Which members are linked with a set."""
        both = self.shared(keys, -(-self.num * len(keys) // self.den))
        return (both > 0) & (self.den * both >= self.num * (self.size + len(keys) - both))


class _Forest:
    """Union-find over numbers as they come; the smaller root stays."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[up]
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
        return a != b


class _Windows(_Members):
    """The windows of one group's members (``n``: sizes of their sets), to be compared with windows of queries."""

    def __init__(self, tokens: pa.ChunkedArray, n: pa.ChunkedArray, num: int, den: int):
        super().__init__(tokens, num, den)
        self.n = np.asarray(n)
        self.end = np.array([_end(x, k) for x, k in zip(tokens, self.n.tolist(), strict=True)], np.uint64)

    def near(self, tokens: pa.ListScalar, n: int) -> np.ndarray:
        """Which members may be linked with a set of ``n`` shingles; all that are linked, for certain.

        Up to the hash where the first of two windows ends both are complete, so what only one holds there, it
        holds alone.
        """
        keys = np.asarray(tokens.values)
        certain = -(-(-(-n * self.num // self.den)) * self.num // self.den)
        shared = self.shared(keys, least := min(certain, MARGIN))
        common = -(-(self.n + n) * self.num // (self.num + self.den))
        held = np.searchsorted(keys.view(np.uint64), np.minimum(self.end, _end(tokens, n)), "right")
        return (shared >= max(least, 1)) & (common <= self.n) & (held - shared <= n - common)


def _end(tokens: pa.ListScalar, n: int) -> np.uint64:
    """The hash up to which a window is complete: its last, or any if it is the whole set of ``n``."""
    return tokens.values[-1].as_py() & (2**64 - 1) if len(tokens.values) < n else 2**64 - 1


def _close(num: int, den: int, group: pa.Table) -> pa.Table:
    """Members of one group (``v``, ``n``, ``tokens``) that may be linked with others of it: ``v``."""
    members, close = _Windows(group["tokens"], group["n"], num, den), np.zeros(group.num_rows, bool)
    for k, (tokens, n) in enumerate(zip(group["tokens"], members.n.tolist(), strict=True)):
        near = members.near(tokens, n)
        near[k] = False
        close[k] |= near.any()
        close |= near
    return group.select(["v"]).filter(pa.array(close, pa.bool_()))


def _within(num: int, den: int, group: pa.Table) -> pa.Table:
    """Components inside one group, named by their least member."""
    members, v, forest = _Members(group["keys"], num, den), group["v"].to_pylist(), _Forest()
    for mine, keys in zip(v, group["keys"], strict=True):
        for k in np.flatnonzero(members.linked(np.asarray(keys.values))).tolist():
            forest.join(mine, v[k])
    roots = [forest.find(x) for x in v]
    return pa.table({"v": group["v"], "component": pa.array(roots, pa.int64())})


def _qualifying(num: int, den: int, rows: pa.Table) -> pa.Table:
    """Queries (``asks``) of a group and its members whose windows (``keys``) may be those of linked sets: ``v``, ``g``,
    ``asks``."""
    left, right = rows.filter(rows["asks"]), rows.filter(pc.invert(rows["asks"]))
    members, n = _Windows(right["keys"], right["n"], num, den), left["n"].to_pylist()
    met, asks = np.zeros(len(members.size), bool), np.zeros(len(n), bool)
    for k, tokens in enumerate(left["keys"]):
        near = members.near(tokens, n[k])
        asks[k] = near.any()
        met |= near
    out = pa.concat_tables([left.filter(pa.array(asks, pa.bool_())), right.filter(pa.array(met, pa.bool_()))])
    return out.select(["v", "g", "asks"])


def _open_groups(num: int, den: int, rows: pa.Table) -> pa.Table:
    """Links between queries (``asks``) and members of one group (the other rows) in other components, as component pairs.

    Of the links found here, those that close a circle are left out: they join nothing new.
    """
    left, right = rows.filter(rows["asks"]), rows.filter(pc.invert(rows["asks"]))
    members, component = _Members(right["keys"], num, den), np.asarray(right["component"])
    out: list[tuple[int, int]] = []
    forest = _Forest()
    for keys, mine in zip(left["keys"], left["component"].to_pylist(), strict=True):
        found = members.linked(np.asarray(keys.values)) & (component != mine)
        out += [(mine, other) for other in np.unique(component[found]).tolist() if forest.join(mine, other)]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _common(n: str, num: int, den: int) -> str:
    """Shingles that a set of ``n`` shares with a linked set at least: ceil(n * num / den), as SQL."""
    return f"(({n}) * {num} + {den - 1}) div {den}"


def _rarest(cells: DataFrame, sizes: DataFrame, spare: Column) -> DataFrame:
    """Of the cells (``v``, ``token``), those whose token occurs twice or more, but for the ``spare`` (over ``sizes``:
    ``v``, ``n``) most frequent ones of each ``v``."""
    # Written first, so that the shuffles of both steps don't lie on the disk at once.
    shared = stage(cells.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared")
    release(cells.sparkSession)
    # One row per class, with as many entries as its own set has at most.
    per = cells.join(shared, "token").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("c", "token")), asc=False).alias("x"))
    left = per.join(sizes.select("v", spare.cast("int").alias("spare")), "v").filter(F.size("x") > F.col("spare"))
    return left.select("v", F.explode(F.slice("x", F.col("spare") + 1, F.size("x"))).alias("x")).select("v", "x.token")


def _having(rows: DataFrame, some: DataFrame) -> DataFrame:
    """``rows`` whose number ``v`` is one of ``some``'s. Numbers follow each other within a partition, so they are a bit each
    of a map that is broadcast: the rows, which may be large, stay where they are."""
    numbers = some.select(F.expr(f"v div {MAP_BITS}").alias("word"), F.expr(f"v % {MAP_BITS}").alias("at"))
    maps = numbers.repartition("word").groupBy("word").agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
    byte = f"cast(conv(hex(substring(bits, cast(v % {MAP_BITS} div 8 as int) + 1, 1)), 16, 10) as int)"
    is_set = F.expr(f"getbit({byte}, cast(v % 8 as int)) = 1")
    return rows.join(F.broadcast(maps), (F.expr(f"v div {MAP_BITS}") == F.col("word")) & is_set, "left_semi")


def _class_sets(docs: DataFrame, wanted: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``v``, ``n``, ``g`` and ``keys`` of grouped classes (``v``, ``n``, ``least``, ``print``, ``g``), made again from their
    texts (``id``, ``text``). Classes without an id are looked for in all rows without one."""
    named = docs.join(wanted.filter("least is not null").select(F.col("least").alias("id")).distinct(), "id", "left_semi")
    found = _describe(named.unionByName(docs.filter("id is null")), "id", "text", k, num, den, sets=True)
    one = found.select("print", "keys").join(wanted.select("v", "n", "g", "print"), "print")
    # By the key of the join, so that the sets aren't moved again.
    return one.groupBy("print").agg(*(F.first(x).alias(x) for x in ("v", "n", "g", "keys"))).drop("print")


def _bins(rows: DataFrame, key: str, many: int) -> DataFrame:
    """Per ``key``, the number of shares of about ``many`` rows and ``SHINGLES`` shingles (``n``) each."""
    shares = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(many), F.sum("n") / F.lit(SHINGLES)))
    return rows.groupBy(key).agg(shares.cast("long").alias("shares"))


def _partition(classes: DataFrame, cells: DataFrame) -> DataFrame:
    """Classes with a common token, with the group of each: ``v``, ``n``, ``least``, ``print``, ``g``."""
    lead = cells.groupBy("token").agg(F.min("v").alias("lead"), F.max("v").alias("last")).filter("lead != last")
    near = stage(cells.join(lead, "token").groupBy("v").agg(F.min("lead").alias("near")).join(classes, "v"), "near")
    share = F.pmod(F.xxhash64("v"), F.col("shares"))
    return near.join(_bins(near, "near", GROUP), "near").select("v", "n", "least", "print", F.xxhash64("near", share).alias("g"))


def _pieces(asked: DataFrame, member: DataFrame, sets: DataFrame, keys: Column) -> DataFrame:
    """Queries (``asks``) and the members of the groups that they ask, with ``keys`` of each, by ``g`` and ``bin``: queries of
    a group are dealt to bins, members are in all of them."""
    bins = stage(_bins(asked, "g", QUERIES), "query-bins")
    own = F.pmod(F.xxhash64("v", F.lit(1)), F.col("shares"))
    kept = ["v", "g", "component"]
    queries = asked.join(bins, "g").select(*kept, own.alias("low"), own.alias("high"), F.lit(True).alias("asks"))
    first, last = F.lit(0).cast("long").alias("low"), (F.col("shares") - 1).alias("high")
    members = member.join(bins, "g").select(*kept, first, last, F.lit(False).alias("asks"))
    # Written first, so that its size is known: the sets are much larger, and are moved once, or not at all if few are wanted.
    wanted = stage(queries.unionByName(members), "wanted")
    placed = wanted.join(sets.select("v", "n", keys.alias("keys")), "v")
    return placed.select("v", "n", "g", F.explode(F.sequence("low", "high")).alias("bin"), "component", "asks", "keys")


def _links(asked: DataFrame, member: DataFrame, windows: DataFrame, sets: Sets, num: int, den: int) -> DataFrame:
    """Pairs of components (``a``, ``b``) linked by queries (``asked``: ``v``, ``n``, ``component``, ``g``) and members of
    the groups that they ask. Windows, a small part of the sets, tell which groups qualify; only for these, and only for
    members that are met there, whole sets are made and moved."""
    spark = windows.sparkSession
    near = _pieces(asked, member, windows, F.col("tokens")).groupBy("g", "bin")
    found = near.applyInArrow(lambda rows: _qualifying(num, den, rows), "v long, g long, asks boolean")
    hold = stage(found.distinct(), "qualifying")
    release(spark)
    whole = stage(sets(hold.select("v").distinct()), "sets-near")
    asked = stage(asked.join(hold.filter("asks").drop("asks"), ["v", "g"], "left_semi"), "asked-near")
    member = stage(member.join(hold.filter("not asks").drop("asks"), ["v", "g"], "left_semi"), "members-near")
    opened = _pieces(asked, member, whole, F.col("keys")).groupBy("g", "bin")
    found = opened.applyInArrow(lambda rows: _open_groups(num, den, rows), "a long, b long")
    links = stage(found.distinct(), "links")
    delete(spark, whole.staged_at)
    return links


def _joined(member: DataFrame, links: DataFrame) -> DataFrame:
    """``member`` with components joined along ``links``."""
    merged = connected_components(links).select(F.col("v").alias("component"), "root")
    return stage(
        member.join(merged, "component", "left").select("v", "n", "g", F.coalesce("root", "component").alias("component")), "members"
    )


def _crossing(cells: DataFrame, member: DataFrame) -> DataFrame:
    """Cells whose token occurs in several components: ``v``, ``token``, ``n``, ``g``, ``component``, ``lead`` (a group of
    the least of them) and ``c``, the number of the token's cells."""
    placed = cells.join(member, "v")
    spread = placed.groupBy("token").agg(
        F.min(F.struct("component", "g")).alias("lead"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c")
    )
    return placed.join(spread.filter("lead.component != hi").drop("hi"), "token")


def _ask_all(cross: DataFrame, num: int, den: int) -> DataFrame:
    """Queries with all groups that hold one of their tokens in a lesser component: each link between two components
    has one side that asks. A large component is likely the lesser, and is asked by the group, not class by class."""
    matrix = cross.groupBy("token", "g").agg(F.min("component").alias("lo"), F.min("n").alias("least"), F.max("n").alias("most"))
    may = f"lo < component and g != own and n * {num} <= most * {den} and least * {num} <= n * {den}"
    asked = cross.select("token", "v", "n", "component", F.col("g").alias("own")).join(matrix, "token").filter(may)
    return asked.select("v", "n", "component", "g")


def _components(member: DataFrame, cells: DataFrame, windows: DataFrame, sets: Sets, num: int, den: int) -> DataFrame:
    """``member`` (``v``, ``n``, ``g``, ``component``) with all links between groups."""
    spark, before, few = windows.sparkSession, cells, FEW * member.count()
    past = spark.createDataFrame([], "v long, g long")
    while True:
        cross = stage(_crossing(cells, member), "crossing")
        delete(spark, before.staged_at)
        asked = (
            cross.filter("lead.component != component and lead.g != g")
            .groupBy("v", "n", "component", "lead.g")
            .agg(F.count(F.lit(1)).alias("held"))
            .join(past, ["v", "g"], "left_anti")
            .groupBy("v", "n", "component")
            .agg(F.max(F.struct("held", "g")).alias("most"))
        )
        asked = stage(asked.select("v", "n", "component", "most.g"), "asked")
        # A linked class of another component holds a token that crosses.
        placed = stage(member.join(cross.select("v").distinct(), "v", "left_semi"), "members-crossing")
        links, past = _links(asked, placed, windows, sets, num, den), past.unionByName(asked.select("v", "g"))
        if links.count() <= few:
            break
        member, cells, before = _joined(member, links), cross.select("v", "token"), cross
    hot = stage(member.join(cross.filter(F.col("c") > FREQUENT).select("v").distinct(), "v").select("v", "n"), "hot")
    whole = stage(sets(hot.select("v")), "sets-hot")
    shingles = whole.select("v", F.explode("keys").alias("token"))
    sharp = stage(_crossing(_rarest(shingles, hot, F.expr(_common("n", num, den)) - 1), member), "crossing-whole")
    discard(whole)
    asked = _ask_all(cross.filter(F.col("c") <= FREQUENT), num, den).unionByName(_ask_all(sharp, num, den))
    asked = stage(asked.distinct().join(past, ["v", "g"], "left_anti").select("v", "n", "component", "g"), "asked-all")
    # The last round's links are few, and join here.
    return _joined(member, _links(asked, placed, windows, sets, num, den).unionByName(links))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100
) -> DataFrame:
    """Components of the documents whose sets of ``k``-word shingles have a Jaccard similarity of num/den or more.

    Returns one row per input row: ``id_col``, ``n_shingles`` and ``component_id``, the smallest id of the
    component; a document without links is its own.

    * Texts that are null, empty or without words have no shingles and are linked with nothing.
    * Rows with a null id are joined like others but name no component: a component of such rows only is null.
    * Repeated rows are equal sets, so they share a component. An empty table gives an empty result.
    * Further columns are ignored. Texts of any length are read whole.
    """
    described = _describe(docs, id_col, text_col, k, num, den, sets=False)
    found = stage(described.withColumn("v", F.monotonically_increasing_id()), "windows")
    rows = stage(found.select("v", "id", "n", "print"), "rows")
    classes = stage(
        rows.filter("n > 0").groupBy("print").agg(F.min("v").alias("v"), F.min("id").alias("least"), F.first("n").alias("n")), "classes"
    )
    # One window of each class, so that copies aren't read or moved again.
    windows = stage(_having(found.select("v", "tokens"), classes), "class-windows")
    discard(found)
    certain = f"least({_common(_common('n', num, den), num, den)}, {MARGIN})"
    every = windows.select("v", F.explode("tokens").alias("token"))
    cells = stage(_rarest(every, classes, F.expr(certain) - 1), "tokens")
    release(docs.sparkSession)

    grouped = stage(_partition(classes, cells), "groups")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    all_windows, windows = windows, stage(_having(windows, grouped).join(grouped.select("v", "n", "g"), "v"), "windows-grouped")
    discard(all_windows)

    def sets(some: DataFrame) -> DataFrame:
        return _class_sets(texts, grouped.join(some, "v", "left_semi"), k, num, den)

    close = windows.groupBy("g").applyInArrow(lambda group: _close(num, den, group), "v long")
    close = stage(close, "close")
    within = sets(close).groupBy("g").applyInArrow(lambda group: _within(num, den, group), "v long, component long")
    within = stage(within, "within")
    release(docs.sparkSession)
    placed = grouped.join(within, "v", "left").select("v", "n", "g", F.coalesce("component", "v").alias("component"))
    member = _components(stage(placed, "members"), cells, windows.drop("g"), sets, num, den)
    discard(windows)

    named = stage(member.select("v", "component").join(classes.select("v", "print", "least"), "v"), "named")
    smallest = stage(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    of_print = named.join(smallest, "component").select("print", "component_id")
    alone = classes.join(member.select("v"), "v", "left_anti").select("print", F.col("least").alias("component_id"))
    of_print = stage(of_print.unionByName(alone), "components")
    return rows.select("id", "n", "print").join(of_print, "print", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id, all columns kept (pipeline stage).

    Rows without an id stay. Of repeated rows with one id, all stay or none.
    """
    found = jaccard_components(docs, id_col, text_col, k, num, den)
    lost = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__id")).distinct()
    return docs.join(lost, docs[id_col] == lost["__id"], "left_anti")
