"""Near-duplicate components from bottom-k sketches of word shingles.

One hash function serves everything: a shingle's 64-bit hash identifies it, and the K
smallest hashes of a set are its sketch. Documents with equal sets form a class and go
on as one. Inverted lists of the rarer retained values yield candidate pairs, the sketch
of the union estimates their similarity, and full shingle sets decide.

Two sets at the similarity sought share at least ``SHARED`` retained values (for sets
that fit in a sketch, exactly the share that the similarity asks for), so among the
size - shared + 1 rarest values of either one is common: only those are indexed, and
passages that many documents share stay out of the lists.

Lists never give all their pairs. First each member is paired only with the list's most
connected member, its hub; the links found are joined to components. What is left are
outsiders: members of a hub's group outside the hub's component. Let M be any reference
set, I(x) the size of x's intersection with it, and call x's elements outside M added.
If x and y share no added element, their intersection lies in M and has min(I(x), I(y))
elements at most, so their similarity can reach the limit p only if

    (1 + p) min(I(x), I(y)) >= p (|x| + |y|).

The same holds, and more tightly, with M cut into blocks and I counted in each: the sum
of the lesser counts takes the place of min(I(x), I(y)). M is what three well-connected
members hold, in blocks by the place in their texts, so that excerpts of one text differ
in their counts, and, as a block of its own, whatever else a quarter of the group holds.
Counts of such a pair differ by (1 - p) / (1 + p) of both sizes at most, summed over the
blocks, and so do sums of counts with signs; two such sums, rounded to that width, are
the keys by which pairs meet.

So only pairs that share an added element, or meet this bound, are made and verified.
Those that share one must meet it too, with added elements counted by hash in further
blocks, so that texts which share edits or a passage but are not alike do not leave the
join. Pairs inside one component are never made, since they cannot change the result.
Where added elements are still common (a passage that copies of a text share), their
lists get hub rounds of their own first, until few pairs of different components remain
or a round leaves most of them. Labels are joined to members, not to their elements, and
members that share fewer added elements than a link asks of them are in no list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import drop_path, id_and_text, map_arrow, new_path, scratch, stage
from fieldloom.llm.textvec import Words, mix, ordered_shingles, shingle_sets, text_slices

K = 64
WORDS = 5
#: Standard deviations between the expected and the least shared values: P(loss) < 1e-5 for a pair at the limit.
MARGIN = 4.75
_TOP = np.uint64(1 << 63)
#: Blocks into which a reference set is cut.
BLOCKS = 32


def shared_at_least(percent: int, k: int = K) -> int:
    """Retained values of a union's k that two sets at ``percent`` similarity both hold, but for chance below 1e-5."""
    p = percent / 100
    return int(k * p - MARGIN * (k * p * (1 - p)) ** 0.5 + 1)


def _sketch_batches(k: int, words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, offsets in text_slices(batch):
                sets = shingle_sets(Words(data, offsets), words)
                n = np.array([len(s) for s in sets], np.int64)
                d1 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
                d2 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(0x14057B7EF767814F))) if len(s) else 0 for s in sets], np.uint64)
                bounds = np.concatenate(([0], np.cumsum(np.minimum(n, k)))).astype(np.int32)
                values = (np.concatenate([s[:k] for s in sets]) ^ _TOP).view(np.int64)
                sketch = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), sketch], schema=schema)

    return run


def sketches(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, n (set size), d1 and d2 (digest of the set), sketch (k smallest hashes, ascending)."""
    return map_arrow(id_and_text(docs), _sketch_batches(k, words), "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def _verify_batches(percent: int, words: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets_of(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
        for _, _, data, offsets in text_slices(batch, column):
            yield from shingle_sets(Words(data, offsets), words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(sets_of(batch, "text_a"), sets_of(batch, "text_b"), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            picked = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([picked.column("a"), picked.column("b")], schema=schema)

    return run


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, k: int = K, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose full sets meet ``percent``: union-sketch estimate first, then the texts' shingle sets."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.array_intersect("sa", "sb")
    likely = pairs.join(side("a"), "a").join(side("b"), "b")
    whole = (F.size("sa") < k) & (F.size("sb") < k)  # then sketches are the sets
    sure = 100 * F.size(shared) >= percent * (F.size("sa") + F.size("sb") - F.size(shared))
    likely = likely.filter(F.when(whole, sure).otherwise(F.size(F.array_intersect(shared, union)) >= shared_at_least(percent, k)))
    likely = stage(likely.select("a", "b").distinct(), "likely")
    needed = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    texts = stage(id_and_text(docs).join(needed, "doc_id", "left_semi"), "texts")
    text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    both = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    return map_arrow(both, _verify_batches(percent, words), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) for every id of ``edges`` (a, b): label is the least id reachable.

    Alternating large-star and small-star steps; minima are aggregated before they are
    joined back, so a node of any degree is spread over tasks. Each round is written to
    the shared folder, and the one before it deleted.
    """
    spark = edges.sparkSession

    def store(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, "star")
        df.write.parquet(path)
        out = spark.read.schema("u long, v long").parquet(path)
        mark = out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return out, path, tuple(mark)

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.union(e.select("v", "u")) if large else e
        # stored, so that the join below it can be split where one node has very many edges
        least = stage(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        moved = around.filter("v > u") if large else around
        out = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.union(least.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now, path, mark = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        after, new, new_mark = store(star(star(now, True), False))
        drop_path(spark, path)
        now, path = after, new
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(now.select("v", "v").distinct())


def inverted_lists(reps: DataFrame, percent: int, k: int = K) -> DataFrame:
    """(value, id, n, pop): rows of the rarest retained values that two or more classes hold; pop: how connected id is."""
    held = reps.select("id", "d1", "n", F.explode("sketch").alias("value"))
    often = stage(held.groupBy("value").agg(F.count("*").alias("f")).filter("f > 1"), "often")
    common = held.join(often, "value").groupBy("id", "d1", "n").agg(F.sort_array(F.collect_list(F.struct("f", "value"))).alias("held"), F.sum("f").alias("pop"))
    size, least = F.least("n", F.lit(k)), shared_at_least(percent, k)
    exact = F.ceil(F.col("n") * percent / 100)  # sets whose partners at this similarity all fit in a sketch too
    shared = F.when(100 * F.col("n") < k * percent, exact).otherwise(F.least(exact, F.lit(least)))
    first = size - shared + 1 - (size - F.size("held"))  # values that one class alone holds come first
    common = common.withColumn("first", F.greatest(F.lit(0), first).cast("int"))
    rows = common.select("id", "n", "pop", F.explode(F.slice("held", F.lit(1), F.col("first"))).alias("e"))
    return rows.select("e.value", "id", "n", "pop")


def reference_set(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted elements, block of each) of the guides' ordered shingles; what a later one adds lies beside what it follows."""
    at: dict[int, int] = {}
    for text in texts:
        place = np.array([at.get(h, -1) for h in text.tolist()], np.int64)
        known = np.flatnonzero(place >= 0)
        if len(known):
            last = np.maximum.accumulate(np.where(place >= 0, np.arange(len(place)), -1))
            place = place[np.where(last >= 0, last, known[0])]
        else:
            place = np.arange(len(text)) * BLOCKS // max(1, len(text))
        for h, p in zip(text.tolist(), place.tolist(), strict=True):
            at.setdefault(h, p)
    elements = np.array(list(at), np.uint64)
    order = np.argsort(elements)
    return elements[order], np.array(list(at.values()), np.int64)[order]


#: Texts that guide a group, and members about that one copy of them serves.
GUIDES = 3
GUIDED = 512


def guided(placed: DataFrame, guides: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, part, slot, id, text): members of groups in parts of about ``GUIDED``, each part in one task and after its group's guides.

    placed: hub, id; guides: hub, h2, h3 (the latter two may be null); texts: doc_id, text.
    Slots 0 to ``GUIDES`` - 1 are the guides, once a part; members have ``GUIDES``.
    """
    parts = placed.groupBy("hub").agg(F.ceil(F.count("*") / GUIDED).cast("int").alias("parts"))
    members = placed.select("hub", "id").join(parts, "hub").select("hub", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(GUIDES).alias("slot"), "id")
    leaders = guides.select("hub", F.posexplode(F.array("hub", "h2", "h3")).alias("slot", "id")).filter("id is not null").join(parts, "hub")
    leaders = leaders.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "slot", "id")
    rows = members.union(leaders).join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    return rows.select("hub", "part", "slot", "id", "text").repartition("hub", "part").sortWithinPartitions("hub", "part", "slot", "id", "text")


def _diff_batches(words: int):
    schema = pa.schema([("hub", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("counts", pa.list_(pa.int32())), ("added", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, guides, known = None, {}, None
        for batch in batches:
            slots, ids = batch.column("slot").to_numpy(), batch.column("id").to_pylist()
            keys = list(zip(batch.column("hub").to_pylist(), batch.column("part").to_pylist(), strict=True))
            rows = []
            for a, end, data, offsets in text_slices(batch):
                split = Words(data, offsets)
                guide = slots[a:end] < GUIDES
                ordered = ordered_shingles(split, words) if guide.any() else None
                sets = None if guide.all() else shingle_sets(split, words)
                for r in range(end - a):
                    if keys[a + r] != group:
                        group, guides, known = keys[a + r], {}, None
                    if guide[r]:
                        guides.setdefault(int(slots[a + r]), ordered[r].copy())  # of a document's several texts the least
                        continue
                    if known is None:
                        known = reference_set([guides[k] for k in sorted(guides)])
                    elements, block = known
                    s = sets[r]
                    at = np.minimum(np.searchsorted(elements, s), max(0, len(elements) - 1))
                    inside = elements[at] == s if len(elements) else np.zeros(len(s), bool)
                    counts = np.bincount(block[at[inside]], minlength=BLOCKS).astype(np.int32) if len(elements) else np.zeros(BLOCKS, np.int32)
                    rows.append((group[0], ids[a + r], len(s), counts, (s[~inside] ^ _TOP).view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether sets of ``n_x`` and ``n_y`` elements with these counts by class may be linked: they share the lesser count of each class at most."""
    least = F.aggregate(F.zip_with(x, y, lambda v, w: F.least(v, w)), F.lit(0), lambda a, v: a + v)
    return (100 + percent) * least >= percent * (F.col("n_x") + F.col("n_y"))


def close_pairs(outside: DataFrame, everyone: DataFrame, percent: int) -> DataFrame:
    """(id_x, id_y): an outsider and a member of another component of the hub's group whose counts allow a link.

    Both: hub, id, n, counts, label, main. Sizes fall into classes of ratio 100 /
    percent; a pair meets in the larger one's class, whose cells are as wide as two
    signed sums of counts may differ there.
    """
    signs = ([-1] * (BLOCKS // 2) + [1] * (BLOCKS // 2), [1 if (k * 4 // BLOCKS) in (0, 3) else -1 for k in range(BLOCKS)])
    width = lambda k: F.lit(2 * (100 - percent) / (100 + percent)) * F.pow(F.lit(100 / percent), k + 1)

    def cell(sign: list[int], k):
        marked = F.aggregate(F.zip_with(F.slice("counts", 1, BLOCKS), F.array(*[F.lit(x) for x in sign]), lambda v, e: v * e), F.lit(0), lambda a, v: a + v)
        return F.floor(marked / width(k)).cast("long")

    def placed(df: DataFrame, x: str, reach: list[int]) -> DataFrame:
        able = df.filter((100 + percent) * F.col("both") >= percent * F.col("n") + percent * F.ceil(F.col("n") * percent / 100))
        able = able.withColumn("class", F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("long"))
        able = able.withColumn("k", F.explode(F.array(F.col("class"), F.col("class") + 1)))
        able = able.withColumn("c", F.explode(F.array(*[F.lit(d) for d in reach]))).withColumn("c", F.col("c") + cell(signs[0], F.col("k")))
        able = able.withColumn("d", F.explode(F.array(*[F.lit(d) for d in reach]))).withColumn("d", F.col("d") + cell(signs[1], F.col("k")))
        own = [F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "label", "counts", "class")]
        return able.select("hub", "k", "c", "d", *own, (F.col("label") == F.col("main")).alias(f"in_{x}"))

    fits = (F.col("label_x") != F.col("label_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & (F.col("k") == F.greatest("class_x", "class_y"))
    fits = fits & (F.col("in_y") | (F.col("id_x") < F.col("id_y"))) & may_link("counts_x", "counts_y", percent)
    return placed(outside, "x", [-1, 0, 1]).join(placed(everyone, "y", [0]), ["hub", "k", "c", "d"]).filter(fits).select("id_x", "id_y")


#: Sub-hub rounds over common added elements at most, and pairs a row from which one is worth it.
SUB_ROUNDS = 4
#: Share of a group from which an added element counts as part of its reference set, in a block of its own.
COMMON = 0.25
PAIRS_A_ROW = 4
#: Counters over which a member's added elements are spread by hash, to bound what two members share.
MARKS = 64
#: A further sub-hub round takes place if the last one left no larger share of the pairs.
WORTH = 0.9


def added_needed(percent: int) -> Column:
    """Added elements that a member of ``n`` elements, ``both`` of them in the reference set, must share with any partner it is linked to by one."""
    return F.greatest(F.lit(1), F.ceil((percent * F.col("n") - 100 * F.col("both")) / 100))


def sharing_members(added: DataFrame, bounds: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """The rows of ``bounds`` whose added elements can make a link between components, with ``held`` and ``marks`` for ``counts``.

    added: hub, value, id of elements that several members added; placed: hub, id, label.
    A member that shares fewer of them than any link asks of it goes, and then each
    element that only one component still holds, since all that two linked members of
    different components share stays with both. held: (f, value), rarest first; marks:
    counts of all that can be shared, by block of the reference set, common, and added by
    hash.
    """
    able = added.groupBy("hub", "id").agg(F.count("*").alias("many")).join(bounds, ["hub", "id"]).filter(F.col("many") >= added_needed(percent)).select("hub", "id")
    able = stage(able.join(placed.select("hub", "id", "label"), ["hub", "id"]), "able")
    added = added.join(able, ["hub", "id"])
    several = added.groupBy("hub", "value").agg(F.count("*").alias("f"), F.min("label").alias("low"), F.max("label").alias("high"))
    several = stage(several.filter("low <> high").select("hub", "value", "f"), "several")
    held = added.join(several, ["hub", "value"]).groupBy("hub", "id").agg(F.sort_array(F.collect_list(F.struct("f", "value"))).alias("held"))
    marks = F.transform(F.sequence(F.lit(0), F.lit(MARKS - 1)), lambda b: F.size(F.filter("held", lambda e: F.pmod(e["value"], F.lit(MARKS)) == b)))
    held = bounds.join(held, ["hub", "id"]).filter(F.size("held") >= added_needed(percent))
    return held.withColumn("marks", F.concat("counts", marks)).drop("counts")


def join_outsiders(met: DataFrame, links: DataFrame, labels: DataFrame, docs: DataFrame, percent: int, words: int, confirm) -> DataFrame:
    """(id, label) after all links between components of the hubs' groups are added; see the module's text."""
    label = lambda c, name: labels.select(F.col("id").alias(c), F.col("label").alias(name))
    placed = met.join(label("id", "l"), "id", "left").join(label("hub", "main"), "hub", "left")
    placed = stage(placed.select("hub", "id", "pop", F.coalesce("l", "id").alias("label"), F.coalesce("main", "hub").alias("main")), "groups")
    open_groups = placed.groupBy("hub").agg(F.count("*").alias("size"), F.max((F.col("label") != F.col("main")).cast("int")).alias("open")).filter("size > 1 and open = 1").select("hub")
    open_groups = stage(open_groups, "open-hubs")
    placed = stage(placed.join(open_groups, "hub", "left_semi"), "open-groups")
    if placed.isEmpty():
        return labels
    best = F.max(F.struct("pop", (-F.col("id")).alias("minus"))).alias("h")
    inner = placed.filter("label = main")
    second = inner.groupBy("hub").agg(best).select("hub", (-F.col("h.minus")).alias("h2"))
    third = inner.join(second, "hub").filter("id <> h2").groupBy("hub").agg(best).select("hub", (-F.col("h.minus")).alias("h3"))
    guides = open_groups.join(second, "hub", "left").join(third, "hub", "left")
    needed = placed.select(F.col("id").alias("doc_id")).union(guides.select("hub")).distinct()
    texts = stage(id_and_text(docs).join(needed, "doc_id", "left_semi"), "open-texts")
    diffs = map_arrow(guided(placed, guides, texts), _diff_batches(words), "hub long, id long, n long, counts array<int>, added array<long>")
    diffs = stage(diffs.join(placed.select("hub", "id", "pop"), ["hub", "id"]), "diffs")

    held = diffs.select("hub", "id", "n", "pop", F.explode("added").alias("value"))
    sizes = diffs.groupBy("hub").agg(F.count("*").alias("size"))
    shared = held.groupBy("hub", "value").agg(F.count("*").alias("f")).filter("f > 1").join(sizes, "hub")
    shared = stage(shared, "shared")
    held = stage(held.join(shared, ["hub", "value"]).withColumn("common", F.col("f") >= COMMON * F.col("size")), "held")
    added = held.filter("not common").select("hub", "value", "id")
    more_both = held.filter("common").groupBy("hub", "id").agg(F.count("*").alias("more"))
    diffs = diffs.join(more_both, ["hub", "id"], "left").withColumn("counts", F.concat("counts", F.array(F.coalesce("more", F.lit(0)).cast("int"))))
    diffs = stage(diffs.withColumn("both", F.aggregate("counts", F.lit(0), lambda a, v: a + v).cast("long")).drop("added", "more"), "bounds")
    listed = stage(sharing_members(added, diffs, placed, percent), "listed")

    def labelled(df: DataFrame) -> DataFrame:
        df = df.join(label("id", "l"), "id", "left").join(label("hub", "main"), "hub", "left")
        return df.withColumn("label", F.coalesce("l", "id")).withColumn("main", F.coalesce("main", "hub")).drop("l")

    def list_rows() -> tuple[DataFrame, DataFrame]:
        """Rows of the lists with their members' present labels, and of each list that several components share its pairs and its sub-hub."""
        rows = stage(labelled(listed.select("hub", "id", "pop", F.col("held.value").alias("values"))).withColumn("value", F.explode("values")).drop("values"), "list-rows")
        # one row per list and component: its size and its best-connected member
        best = F.max(F.struct("pop", (-F.col("id")).alias("minus"))).alias("b")
        parts = rows.groupBy("hub", "value", "label", "main").agg(F.count("*").cast("double").alias("n"), best)
        lists = parts.groupBy("hub", "value").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.max(F.when(F.col("label") != F.col("main"), F.struct("n", "b.pop", "b.minus"))).alias("s"))
        return rows, stage(lists.filter("own < n * n and s is not null").select("hub", "value", (F.col("n") * F.col("n") - F.col("own")).alias("pairs"), (-F.col("s.minus")).alias("sub")), "sub-hubs")

    (rows, lists), tested, before = list_rows(), None, None
    enough = PAIRS_A_ROW * rows.count()
    for _ in range(SUB_ROUNDS):
        pairs = lists.agg(F.sum("pairs")).first()[0] or 0
        if pairs <= enough or before is not None and pairs > WORTH * before:
            break
        tried = rows.join(lists.select("hub", "value", "sub"), ["hub", "value"]).filter("id <> sub")
        tried = tried.select(F.least("id", "sub").alias("a"), F.greatest("id", "sub").alias("b")).distinct()
        tried = stage(tried if tested is None else tried.join(tested, ["a", "b"], "left_anti"), "tried")
        tested = tried if tested is None else tested.union(tried)
        more = confirm(tried).join(links, ["a", "b"], "left_anti")
        if more.isEmpty():
            break
        links = stage(links.union(more), "links")
        labels = stage(components(links), "labels")
        before, (rows, lists) = pairs, list_rows()

    mixed = lists.select("hub", "value")
    marked = stage(labelled(listed).drop("pop"), "marked")
    # x needs so many added elements in common with any partner that its rarest others suffice
    first = F.size("held") - added_needed(percent) + 1
    own = marked.filter("label <> main").withColumn("held", F.slice("held", F.lit(1), F.greatest(F.lit(0), first).cast("int")))

    def side(df: DataFrame, x: str) -> DataFrame:
        rows = df.withColumn("value", F.explode("held.value")).join(mixed, ["hub", "value"], "left_semi")
        return rows.select("hub", "value", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "label", "n", "marks")], (F.col("label") == F.col("main")).alias(f"in_{x}"))

    apart = (F.col("label_x") != F.col("label_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & (F.col("in_y") | (F.col("id_x") < F.col("id_y")))
    sharing = side(own, "x").join(side(marked, "y"), ["hub", "value"]).filter(apart & may_link("marks_x", "marks_y", percent))

    members = labelled(diffs)
    close = close_pairs(members.filter("label <> main"), members, percent)
    pairs = sharing.select("id_x", "id_y").union(close)
    pairs = pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
    cross = stage(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "cross")
    if cross.isEmpty():
        return labels
    more = confirm(cross)
    return labels if more.isEmpty() else stage(components(links.union(more)), "labels")


def _small(df: DataFrame) -> DataFrame:
    """A stored table of ids, broadcast where it is small (some 40 MB)."""
    return F.broadcast(df) if df.count() <= 500_000 else df


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text).

    Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z. Two
    documents are linked when 100 * intersection >= percent * union of their sets of
    5-word shingles. Texts of 1-4 words have their whole sequence as only shingle; null
    and empty texts have none and stay alone. component_id is the smallest doc_id
    reachable; kept marks it. Whole texts count, however long. doc_id is the key: rows
    that repeat one are one document, linked by any of its texts, and each has the set
    size of its own text. A row without doc_id is linked with nothing: its component_id is
    null, and it is kept. Extra columns are ignored; an empty table gives an empty result.
    The result is stored.
    """
    with scratch(docs.sparkSession, "near-duplicates") as keep:
        return keep(_near_duplicates(docs, percent, k, words))


def _near_duplicates(docs: DataFrame, percent: int, k: int, words: int) -> DataFrame:
    nameless = docs.filter("doc_id is null")
    docs = docs.filter("doc_id is not null")
    sets = stage(sketches(docs, k, words), "sketches")
    filled = sets.filter("n > 0")
    # aggregates are stored before they are joined back: only then can Spark split the joins of hot keys
    classes = stage(filled.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "class-ids")
    chosen = classes.select(F.col("rep").alias("doc_id"), "d1", "d2", "n")
    reps = stage(filled.join(chosen, ["doc_id", "d1", "d2", "n"], "left_semi").dropDuplicates(["doc_id", "d1", "d2", "n"]).withColumnRenamed("doc_id", "id"), "classes")
    lists = stage(inverted_lists(reps, percent, k), "lists")
    # the classes of a doc_id's different texts are one node
    repeated = stage(sets.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    several = filled.join(_small(repeated), "doc_id", "left_semi").select("doc_id", "d1", "d2", "n").distinct().join(classes, ["d1", "d2", "n"]).groupBy("doc_id").agg(F.collect_set("rep").alias("reps"))
    same = several.filter("size(reps) > 1").select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).filter("a <> b").distinct()

    rank = F.max(F.struct("pop", (-F.col("id")).alias("minus"), "n"))
    hubs = stage(lists.groupBy("value").agg(rank.alias("h")).select("value", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
    met = stage(lists.join(hubs, "value").filter(F.col("id") != F.col("hub")).groupBy("hub", "id").agg(F.max("pop").alias("pop"), F.max("n").alias("n"), F.max("hub_n").alias("hub_n")), "met")
    pairs = met.filter((100 * F.least("n", "hub_n")) >= (percent * F.greatest("n", "hub_n")))
    pairs = pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = stage(verified(pairs, reps, docs, percent, k, words).union(same), "links")
    labels = stage(components(links), "labels")
    confirm = lambda pairs: stage(verified(pairs, reps, docs, percent, k, words), "more-links")
    labels = join_outsiders(met, links, labels, docs, percent, words, confirm)

    found = filled.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"]).join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
    alone = sets.filter("n = 0").select("doc_id")
    if not repeated.isEmpty():  # an empty text of a document that has others
        found = stage(found, "found")
        other = found.join(_small(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        alone = alone.join(_small(stage(other, "others")), "doc_id", "left")
    else:
        alone = alone.withColumn("component_id", F.lit(None).cast("long"))
    alone = alone.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    rest = map_arrow(id_and_text(nameless), _sketch_batches(k, words), "doc_id long, n long, d1 long, d2 long, sketch array<long>").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.union(alone).union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The same by whole sets, for 85 percent, in DuckDB's SQL; a row without doc_id is linked with nothing.
ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT line, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END AS s FROM split
), rows AS MATERIALIZED (
  SELECT line, len(s) AS n, unnest(s) AS h FROM sets WHERE doc_id IS NOT NULL
), links AS (
  SELECT a.line AS a, b.line AS b FROM rows a JOIN rows b ON a.h = b.h AND a.line < b.line AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.line, b.line, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM links JOIN sets x ON x.line = a JOIN sets y ON y.line = b WHERE x.doc_id <> y.doc_id
), around AS MATERIALIZED (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
  SELECT DISTINCT doc_id, doc_id AS other FROM sets WHERE doc_id IS NOT NULL
  UNION SELECT r.doc_id, e.b FROM reach r JOIN around e ON e.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept FROM sets LEFT JOIN least USING (doc_id)
"""
