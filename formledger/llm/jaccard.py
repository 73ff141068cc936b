"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles, as sorted hashes; this order is the same in every set.  Two sets are linked when
``den * intersection >= num * union``.  A set of n hashes shares at least o = ceil(num * n / den) with any partner, so if
its prefix has n - o + l hashes, and a partner's is made likewise, the prefixes share at least l of them.

The prefixes adapt to what they cost.  A hash that more than ``HOT`` sets index is expensive: each of its rows would meet all
others.  A set whose prefix holds h expensive hashes lengthens it until l = 1 + h + x, x a margin; a pair then
shares more prefix hashes than it can share expensive ones, so expensive hashes need not meet each other: the pair meets at
1 + x others at least, and fewer such matches drop it before any verification.  The number of sets that index a hash is
counted over all sets: first in the plain prefixes, then also in the longer lists of sets that met expensive ones (their
whole sets, if a quarter of their prefix is expensive).

Sets that run out of hashes (nearly all are expensive, as in large groups of near copies) are compared with the others as
above, by their whole lists.  Among themselves they form families, which hang together by hashes of plain prefixes.  A family has
a pivot, the hashes of more than half of its sets, and each set is held as its d differences from the pivot.  Two sets of
sizes n differ in d + d' - 2c hashes, c of them shared differences, so they are linked when ``v + v' + 2 (den + num) c >= 0``
with ``v = (den - num) n - (den + num) d``.  Pairs with v + v' >= 0 are counted by rank, not listed, and linked through the set
nearest to the pivot.  The others are looked for in blocks of sets: a task counts the links of two blocks and gives the edges
of a forest that connects the same sets, so there are never rows for pairs.

Equal sets are one class from the beginning (its links are those of one of them).  Candidates are verified on whole sets.

Defined results: null and empty texts have an empty set, no links and their own id as component; rows may repeat; a null id is
never a representative unless its component has no other.  Hashes have 64 bits: two different shingles of a pair of
documents fall together with a chance of about n*n / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, components, shingles

HOT = 48  #: a hash indexed by more sets is expensive
MARGIN = 1  #: further matches that pairs of longer sets need
MARGIN_FROM = 20  #: hashes in a longer set
BLOCK = 2048  #: sets of a family that a task compares with as many others
GROUP = 1000  #: sets of a family that meet one copy of its pivot


def _required(n, num: int, den: int):
    return -(-num * n // den)


def _margin(n):
    return np.where(n >= MARGIN_FROM, MARGIN, 0)


def signatures(docs: DataFrame, id_col: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """id, n, digest, prefix for every row."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shingles.sets(batch.column(1).to_pylist(), k)
            n = np.array([len(s) for s in own])
            size = np.where(n > 0, n - _required(n, num, den) + 1 + _margin(n), 0)
            prefix = pa.array([s[:m].view(np.int64) for s, m in zip(own, size)], pa.list_(pa.int64()))
            digests = pa.array([shingles.digest(s) if len(s) else None for s in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), digests, prefix], names=["id", "n", "digest", "prefix"])

    return source.mapInArrow(run, "id long, n long, digest binary, prefix array<long>")


def lists(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """cid, n, members for the classes in ``wanted`` (cid, digest, id, reach): the first ``reach`` hashes, as little-endian bytes.

    Only the texts of those ids are read into Python.  ``wanted`` should be settled.
    """
    wanted = common.narrow(wanted.select(F.col("id").alias("wanted_id"), "cid", "digest", "reach"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).join(wanted, F.col("id").eqNullSafe(F.col("wanted_id"))).select("t", "cid", "digest", "reach")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shingles.sets(batch.column(0).to_pylist(), k)
            # an id may have other texts too
            mine = [(c, s, r) for s, c, d, r in zip(own, *(x.to_pylist() for x in batch.columns[1:])) if shingles.digest(s) == d]
            columns = [
                pa.array([c for c, _, _ in mine], pa.int64()),
                pa.array([len(s) for _, s, _ in mine], pa.int64()),
                pa.array([s[:r].tobytes() for _, s, r in mine], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "n", "members"])

    got = common.settled(source.mapInArrow(run, "cid long, n long, members binary"), "lists")
    # whole lists are shuffled only if rows with this id are there more than once
    if got.count() == got.select("cid").distinct().count():
        return got
    return common.settled(got.dropDuplicates(["cid"]), "lists", free=True)


def _listed(sets: DataFrame) -> DataFrame:
    """cid, n, pos, token for every hash of the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int64()))], names=["cid", "n", "tokens"])

    return sets.select("cid", "n", "members").mapInArrow(run, "cid long, n long, tokens array<long>").select("cid", "n", F.posexplode("tokens").alias("pos", "token"))


def _fits(a: Column, b: Column, num: int, den: int) -> Column:
    """Sizes that leave the link possible."""
    return F.least(a, b) * den >= F.greatest(a, b) * num


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out.append(den * shared >= num * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("members").alias("of_a")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("members").alias("of_b")), "b")
    return both.where(linked("of_a", "of_b")).select("a", "b")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _families(lists: DataFrame) -> DataFrame:
    """node, component: the sets of ``lists`` (token, cid) that hang together by tokens; a set that meets no other is not there."""
    low = lists.groupBy("token").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high").select("token", "low")
    return components.components(lists.join(low, "token").select("cid", "low"), "cid", "low")


def _differences(crowd: DataFrame, num: int, den: int, n: int) -> DataFrame:
    """family, cid, v, diff for sets (family, cid, n, members): what differs from the family's pivot, the tokens of more than half of its sets."""
    sizes = common.settled(crowd.groupBy("family").agg(F.count("*").alias("size")), "families", rows=n)
    counted = _listed(crowd).join(crowd.select("cid", "family"), "cid").groupBy("family", "token").agg(F.count("*").alias("c"))
    pivots = counted.join(common.narrow(sizes), "family").where(2 * F.col("c") > F.col("size")).groupBy("family").agg(F.sort_array(F.collect_list("token")).alias("pivot"))
    copies = F.ceil(F.col("size") / GROUP)
    spread = sizes.join(common.settled(pivots, "pivots", rows=n), "family", "left").select("family", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    own = crowd.join(common.narrow(sizes), "family").withColumn("copy", F.pmod(F.xxhash64("cid"), copies))
    both = own.join(spread, ["family", "copy"]).select("family", "cid", "n", "members", "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(3), batch.column(4))
            diff = [np.setxor1d(np.frombuffer(x.as_py(), np.int64), np.array(y.as_py() or [], np.int64), assume_unique=True) for x, y in pairs]
            v = (den - num) * np.asarray(batch.column(2)) - (den + num) * np.array([len(x) for x in diff], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(v, pa.int64()), pa.array(diff, pa.list_(pa.int64()))], names=["family", "cid", "v", "diff"])

    return both.mapInArrow(run, "family long, cid long, v long, diff array<long>")


def _sure(far: DataFrame) -> DataFrame:
    """cid, n: the sets v' >= -v of the same family, which are linked whatever they share; counted over the different values of v."""
    n = far.count()
    values = common.settled(far.groupBy("family", "v").agg(F.count("*").alias("c")), "values", rows=n)
    points = values.select("family", F.col("v").alias("at"), "c", F.lit(None).cast("long").alias("asks")).unionByName(values.select("family", (-F.col("v")).alias("at"), F.lit(0).cast("long").alias("c"), F.col("v").alias("asks")))
    above = Window.partitionBy("family").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sure = points.withColumn("sure", F.sum("c").over(above)).where("asks IS NOT NULL").select("family", F.col("asks").alias("v"), (F.col("sure") - (F.col("asks") >= 0).cast("long")).alias("sure"))
    return far.select("family", "cid", "v").join(common.narrow(common.settled(sure, "sure", rows=n)), ["family", "v"]).select("cid", F.col("sure").alias("n"))


def _unsure(far: DataFrame, num: int, den: int, count: bool) -> DataFrame:
    """The links that need shared differences: rows (cid, n), how many a set has (if ``count``), and (a, b), enough to connect what they link.

    ``far``: family, cid, v, diff, core.  A family's sets are dealt to blocks of about ``BLOCK``; each two blocks meet in one task, which
    counts shared differences by the list of sets that have one.  It gives a number for each set and the edges of a forest, never
    pairs.  Without ``count`` only sets outside of the core look for others, for the core is connected.
    """
    looking = F.lit(True) if count else ~F.col("core")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK))
    sizes = far.groupBy("family").agg(blocks(F.count_if(looking)).alias("xs"), blocks(F.count("*")).alias("ys"))
    dealt = far.join(common.narrow(common.settled(sizes, "blocks")), "family")
    to = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    last = F.col("ys") - 1
    zero = F.lit(0).cast("long")
    # for counts blocks are the same on both sides and meet once
    one = dealt.where(looking).select("family", to("xs").alias("x"), F.explode(F.sequence(to("xs") if count else zero, last)).alias("y"), "cid", "v", "diff")
    again = {c: F.col(c).alias(c) for c in ("family", "cid", "v", "diff")}  # columns of its own, for both sides are one table
    two = dealt.select(again["family"], F.explode(F.sequence(zero, to("ys") if count else F.col("xs") - 1)).alias("x"), to("ys").alias("y"), again["cid"], again["v"], again["diff"])
    step = 2 * (den + num)

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n_left, n_right, edges = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64), []
        if len(left) and len(right):
            owner = np.repeat(np.arange(len(right)), [len(d) for d in right["diff"]])
            tokens = np.concatenate([np.asarray(d, np.int64) for d in right["diff"]])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            v, ids, tree = right["v"].to_numpy(), right["cid"].to_numpy(), np.arange(len(right))
            for i, (cid, own, diff) in enumerate(zip(left["cid"].tolist(), left["v"].tolist(), left["diff"])):
                begin, end = (np.searchsorted(tokens, np.asarray(diff, np.int64), side=s) for s in ("left", "right"))
                met = [owner[a:b] for a, b in zip(begin.tolist(), end.tolist()) if b > a]
                shared = np.bincount(np.concatenate(met), minlength=len(right)) if met else np.zeros(len(right), np.int64)
                linked = (v + own < 0) & (v + own + step * shared >= 0) & (ids != cid)
                n_left[i] = linked.sum()
                n_right += linked
                at = np.flatnonzero(linked)
                if len(at):  # one edge to each tree among these, which then are one
                    trees, first = np.unique(tree[at], return_index=True)
                    edges += [(cid, x) for x in ids[at[first]].tolist()]
                    if len(trees) > 1:
                        tree[np.isin(tree, trees)] = trees[0]
        parts = [pd.DataFrame({"a": [a for a, _ in edges], "b": [b for _, b in edges]}, dtype="Int64")]
        if count:
            parts.append(pd.DataFrame({"cid": left["cid"], "n": n_left}))
        if count and key[1] != key[2]:
            parts.append(pd.DataFrame({"cid": right["cid"], "n": n_right}))
        return pd.concat([p.reindex(columns=["cid", "n", "a", "b"]).astype("Int64") for p in parts])

    keys = ["family", "x", "y"]
    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInPandas(meet, "cid long, n long, a long, b long")


def _crowded(lists: DataFrame, known: DataFrame, num: int, den: int, count: bool) -> tuple[DataFrame, DataFrame | None]:
    """Links among sets whose hashes are nearly all expensive: (a, b) of enough links to connect what is linked; cid, n of all links if ``count``.

    ``lists``: token, cid of the sets' plain prefixes, so that two linked ones meet; ``known``: cid, n, members.
    """
    n = lists.select("cid").distinct().count()
    families = common.settled(_families(lists), "crowd", rows=n).select(F.col("node").alias("cid"), F.col("component").alias("family"))
    crowd = common.settled(known.join(common.narrow(families), "cid").select("family", "cid", "n", "members"), "crowd-sets")
    far = common.settled(_differences(crowd, num, den, n), "differences", free=True)
    # all that are linked to the family's nearest to the pivot whatever they share are one component
    most = far.groupBy("family").agg(F.max("v").alias("most"), F.max_by("cid", F.struct("v", "cid")).alias("nearest"))
    most = common.narrow(common.settled(most, "nearest", rows=n))
    core = F.col("v") + F.col("most") >= 0
    connecting = far.join(most, "family").where(core & (F.col("cid") != F.col("nearest"))).select(*_ordered("cid", "nearest"))
    # the others need shared differences
    found = common.settled(_unsure(far.join(most.select("family", "most"), "family").withColumn("core", core), num, den, count), "crowd-links", free=True)
    edges = found.where("a IS NOT NULL").select(*_ordered("a", "b")).distinct()
    return connecting.union(edges), _sure(far).union(found.where("cid IS NOT NULL").select("cid", "n")) if count else None


def _degrees(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("cid")).union(links.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("n"))


def links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, num: int = 8, den: int = 10, count: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(rows, classes, links, degree).

    rows: id, n, digest; classes: cid, digest, id, n; links: a, b between the cids of different linked sets, all but those of two
    sets of a crowd, of which there are as many as connect the same sets; degree (if ``count``): cid, n, parts of the number of all links
    of each set, to be summed.
    """
    common.small_batches(docs.sparkSession, 100)  # two whole sets of a pair can be large
    rows = common.settled(signatures(docs, id_col, text, k, num, den), "signatures", free=True)
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    # a number for each class, for it is carried along with each hash; it stays, for the table is written
    n = rows.count()
    classes = common.settled(classes.withColumn("cid", F.monotonically_increasing_id()), "classes", free=True)
    plain = classes.select("cid", "n", F.explode("prefix").alias("token"))
    counted = plain.groupBy("token").agg(F.count("*").alias("df"))
    n_plain = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    hot = common.settled(counted.where(F.col("df") > HOT).select("token"), "hot", free=True, rows=n_plain // HOT)
    touched = plain.join(common.narrow(hot), "token", "left_semi").groupBy("cid").agg(F.count("*").alias("h"))
    plain_size = F.size("prefix")
    reach = F.when(F.col("h") > plain_size / 4, F.col("n")).otherwise(F.least(F.col("n"), plain_size + 2 * F.col("h") + 10))
    touched = common.settled(classes.join(common.narrow(common.settled(touched, "touched-by", rows=n)), "cid").select("cid", "digest", "id", reach.alias("reach")), "touched", free=True, rows=n)
    sets = lists(docs, touched, id_col, text, k)
    calm = plain.join(common.narrow(touched.select("cid")), "cid", "left_anti")
    listed = _listed(sets)
    # expensive for the touched sets: already so in the plain prefixes, or in all lists together
    both = calm.select("token").unionByName(listed.select("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    both = common.settled(both, "met", free=True)
    met_tokens = common.narrow(both.select("token"))  # a hash of one set only meets none
    n_listed = sets.agg(F.sum(F.length("members") / 8).cast("long")).first()[0] or 0
    hot = hot.union(both.where(F.col("df") > HOT).select("token")).distinct()
    hot = common.narrow(common.settled(hot, "hot-all", rows=(n_plain + n_listed) // HOT))

    margin = F.when(F.col("n") >= MARGIN_FROM, MARGIN).otherwise(0)
    base = F.col("n") - F.ceil(F.col("n") * num / den) + 1

    @F.pandas_udf("long")
    def enough(n: pd.Series, listed: pd.Series, places: pd.Series) -> pd.Series:
        """Length of the prefix that holds more than its expensive hashes, by n, the list's length and their places.

        0: the whole set has no such prefix.  Negative: the list is too short to say; the plain prefix, without silence.
        """
        out = []
        for size, known, at in zip(n.tolist(), listed.tolist(), places):
            at = np.sort(np.asarray(at, np.int64)) if at is not None else np.empty(0, np.int64)
            first, more = size - _required(size, num, den) + 1, int(_margin(size))
            length = first + more
            while length <= size and (h := int(np.searchsorted(at, length))) > length - first - more:
                length = first + more + h
            out.append(length if length <= known else 0 if known == size else -first - more)
        return pd.Series(out)

    places = listed.join(hot, "token", "left_semi").groupBy("cid").agg(F.collect_list("pos").alias("places"))
    places = sets.select("cid", "n", (F.length("members") / 8).cast("long").alias("listed")).join(places, "cid", "left")
    lengths = common.settled(places.select("cid", enough("n", "listed", "places").alias("length")), "lengths", rows=n)
    full = F.col("length") == 0
    costly = hot.withColumn("costly", F.lit(True))
    index = (
        listed.join(common.narrow(lengths), "cid")
        .where(full | (F.col("pos") < F.abs("length")))
        .join(costly, "token", "left")
        .select("token", "cid", "n", F.when(full, 1 << 20).otherwise(margin).alias("x"), (F.coalesce("costly", F.lit(False)) & (F.col("length") >= 0)).alias("silent"))
        .unionByName(calm.select("token", "cid", "n", margin.alias("x"), F.lit(False).alias("silent")))
        .join(met_tokens, "token", "left_semi")
    )
    index = common.settled(index, "index", free=True)
    loud = index.where("not silent").select("token", F.col("cid").alias("p"), F.col("n").alias("pn"), F.col("x").alias("px"))
    other = index.select("token", F.col("cid").alias("q"), F.col("n").alias("qn"), F.col("x").alias("qx"), "silent")
    met = loud.join(other, "token").where((F.col("p") < F.col("q")) | (F.col("silent") & (F.col("p") != F.col("q"))))
    met = met.where(_fits(F.col("pn"), F.col("qn"), num, den) & (F.least("px", "qx") <= MARGIN))
    pairs = met.groupBy(*_ordered("p", "q")).agg(F.count("*").alias("matches"), F.min(F.least("px", "qx")).alias("x")).where(F.col("matches") > F.col("x")).select("a", "b")
    pairs = common.settled(pairs, "pairs", free=True)
    crowded = lengths.where(full).select("cid")
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).union(crowded.select("cid")).distinct()
    ends = classes.join(ends, "cid", "left_semi").select("cid", "digest", "id", F.col("n").alias("reach"))
    known = lists(docs, common.settled(ends, "ends", rows=n), id_col, text, k)
    found = verified(pairs, known, num, den)
    found = common.settled(found, "links")
    rows, classes = rows.select("id", "n", "digest"), classes.select("cid", "digest", "id", "n")
    degree = _degrees(found) if count else None
    if not crowded.take(1):
        return rows, classes, found, degree
    crowd = listed.join(common.narrow(crowded), "cid").where(F.col("pos") < base).select("token", "cid")
    connecting, more = _crowded(common.settled(crowd, "crowd-lists"), known.join(common.narrow(crowded), "cid"), num, den, count)
    return rows, classes, found.union(connecting), degree.union(more) if count else None


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links reach), n_links (of the row's set to different sets), digest (of its set)."""
    rows, classes, found, degree = links(docs, id_col, text, k, num, den)
    labels = components.components(found, "a", "b")
    degree = degree.groupBy("cid").agg(F.sum("n").alias("n_links"))
    out = _placed(rows, classes, labels, degree)
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "digest")


def _placed(rows: DataFrame, classes: DataFrame, labels: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """id, n, digest, component_id for every row, and what ``degree`` (by cid) has."""
    grouped = classes.drop("n").join(labels, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    known = grouped.join(least, "component").drop("id", "node", "component")
    known = known if degree is None else known.join(degree, "cid", "left")
    return rows.join(known.drop("cid"), "digest", "left").withColumn("component_id", F.coalesce("component_id", "id"))


def kept(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One document of each group: that with the group's smallest id, once if its row is there again.

    Rows with an empty set and rows without an id stay all.
    """
    rows, classes, found, _ = links(docs, id_col, text, k, num, den, count=False)
    labels = components.components(found, "a", "b")
    n = rows.count()
    found = common.settled(_placed(rows, classes, labels).select("id", "component_id", "digest"), "groups", rows=n)
    gone = found.where(F.col("component_id") < F.col("id")).select(F.col("id").alias("gone")).distinct()
    gone = common.narrow(common.settled(gone, "gone", rows=n))
    out = docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
    again = common.settled(found.where(F.col("id").isNotNull() & F.col("digest").isNotNull()).groupBy("id", "digest").count().where("count > 1").select(F.col("id").alias("again")).distinct(), "again", rows=n)
    if not again.take(1):
        return out
    again = common.narrow(again)
    once = out.join(again, docs[id_col] == again["again"], "left_semi").dropDuplicates([id_col, text])
    return out.join(again, docs[id_col] == again["again"], "left_anti").unionByName(once)


def oracle(k: int, num: int, den: int) -> str:
    """The same as ``join`` by all pairs that share a shingle, in DuckDB's SQL over the table documents (no null ids)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    one = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(translate(text, '{upper}', '{lower}'), ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: {one}))) END AS s FROM words),
sized AS (SELECT doc_id, s, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS class FROM sets),
classes AS (SELECT class, n, s FROM sized WHERE doc_id = class AND n > 0),
postings AS (SELECT class, n, unnest(s) AS t FROM classes),
links AS (SELECT a.class AS a, b.class AS b FROM postings a JOIN postings b ON a.t = b.t AND a.class <> b.class GROUP BY a.class, b.class, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
reach AS (SELECT class AS c, class AS r FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT c, min(r) AS component_id FROM reach GROUP BY c),
degree AS (SELECT a AS c, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE l.component_id END AS component_id, coalesce(CASE WHEN n > 0 THEN d.n_links END, 0) AS n_links
FROM sized LEFT JOIN least l ON l.c = class LEFT JOIN degree d ON d.c = class"""
