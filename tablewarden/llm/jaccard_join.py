"""N-gram Jaccard join of documents, size-aware: subsets for small sets, inverted lists for large ones.

1. Every text becomes the set of its distinct word shingles; equal sets are one set from here on.
2. Packed batches of shingle hashes meet by bucket (see :mod:`exchange`). A shingle that no other set has cannot
   be shared, so only sets of which three quarters recur can have a link, and only their recurring shingles are
   kept. In a corpus with few near copies that leaves a small part of the sets.
3. Shingles are ordered by their frequency among those sets, rarest first. Two linked sets share at least ``c``
   of the first ``n - ceil(t n) + c`` shingles of each. Small sets list all pairs of those (``c`` = 2), which are
   selective keys; large sets scan the inverted lists of single ones (``c`` = 1). The boundary is the size at
   which the two costs add up to the least.
4. In each list a leader stands for those of like size: members are verified against it exactly, and the links
   found merge sets into components. Sets that share lists at all form clusters. Where a cluster still holds
   several components, the sets outside its largest one scan the inverted lists of the whole cluster, block by
   block, and count their overlaps exactly. So a group of near copies costs a comparison per member and list
   and a scan for those that stay outside, no pair is written down that is no link, and none is lost.

Defined results: NULL or empty text, or white space only, has an empty set and is linked with nothing. A text of
fewer words than a shingle has one shingle, its whole word sequence. Repeated rows are linked (with an empty set:
not). A NULL key takes part; the component of a group is its smallest key that is not NULL. An empty table gives
an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import exchange, words
from tablewarden.llm.common import WHITE, numbered, stored, text_or_empty
from tablewarden.llm.components import components

#: Words of a shingle, and the similarity in hundredths from which documents are linked.
SHINGLE, LEAST = 5, 75
#: Sets whose sizes differ by less than this factor share a leader in a list.
CLASS = 1.15
#: Sets of a block when outsiders scan a cluster, and the tasks that clusters of one block share.
BLOCK, SMALL_CLUSTER_TASKS = 256, 4096
#: Cost of an entry of an inverted list against that of a listed subset.
ENTRY = 4.0

SHRED = (
    "bucket int, key long, th long, n long, a long, b long, known array<long>,"
    " heads_a array<long>, heads_b array<long>, counts array<int>, hashes array<long>, repeated array<long>"
)
ANSWER = (
    "key long, th long, n long, a long, b long, row boolean, found array<long>,"
    " slice int, sets_a array<long>, sets_b array<long>, counts array<int>"
)
FOUND = "a long, b long, found array<long>"


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts end to end (ascending in each), and where each text's set begins."""
    part = words.words_of(texts, words.SPACED, fold=True)
    h, counts = part.hashes(), part.counts
    inner = words.inner_starts(part.first, size)
    values = [words.sequence_hashes(h, size)[inner]]
    owners = [part.document()[: len(inner)][inner]]
    for n in range(1, size):  # short texts: the whole sequence, told apart by its length
        short = np.flatnonzero(counts == n)
        if len(short):
            own = np.arange(n)[None, :] + part.first[short][:, None]
            lone = words.sequence_hashes(h[own].ravel(), n)[::n]
            values.append(words.mixed(lone + np.uint64(n)))
            owners.append(short)
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[fresh], owners[fresh]
    return values, np.searchsorted(owners, np.arange(len(texts) + 1))


def set_digests(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each set, as two numbers."""
    n = len(first) - 1
    out = []
    for salt in (1, 2):
        x = words.mixed(values + np.uint64(salt * 0xA24BAED4963EE407 % 2**64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        sums = total[first[1:]] - total[first[:-1]]
        out.append(exchange.signed(words.mixed(sums + np.diff(first).astype(np.uint64) * np.uint64(salt))))
    return out[0][:n], out[1][:n]


def shred(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """A row per document (key, size and digest of its set), and the packed questions; ``docs`` has key, th, _text."""
    names = [part.split()[0] for part in SHRED.split(", ") for part in [part.strip()]]
    kinds = [pa.int32()] + [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3 + [pa.list_(pa.int32())] + [pa.list_(pa.int64())] * 2

    def batch_of(rows: int, **columns) -> pa.RecordBatch:
        filled = [columns.get(n, pa.nulls(rows, k)) for n, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([c.cast(k) if c.type != k else c for c, k in zip(filled, kinds, strict=True)], names)

    def chunk(key: pa.Array, th: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        values, first = shingle_sets(texts, size)
        n = np.diff(first)
        a, b = set_digests(values, first)
        # each distinct set once
        _, lead, back = np.unique(np.column_stack([a, b, n]), axis=0, return_index=True, return_inverse=True)
        leads = np.zeros(len(n), bool)
        leads[lead] = True
        owner = np.repeat(np.arange(len(n)), n)
        mine = leads[owner]
        values, owner = values[mine], owner[mine]
        order, heads = exchange.grouped(values)
        group = np.diff(np.append(heads, len(values)))
        twice = np.zeros(len(values), bool)
        twice[order] = np.repeat(group > 1, group)
        known = np.searchsorted(owner[twice], np.arange(len(n) + 1))
        yield batch_of(
            len(n),
            bucket=pa.array(np.arange(len(n)) % buckets, pa.int32()),
            key=key, th=th, n=pa.array(n, pa.int64()), a=pa.array(a), b=pa.array(b),
            known=exchange.lists(exchange.signed(values[twice]), known, pa.int64()),
        )
        single = np.flatnonzero(~twice)
        single = single[np.argsort(exchange.bucket_of(values[single], buckets), kind="stable")]
        bucket = exchange.bucket_of(values[single], buckets)
        pair = bucket * len(n) + owner[single]
        heads = np.flatnonzero(np.diff(pair, prepend=-1))
        counts = np.diff(np.append(heads, len(single)))
        of, who = bucket[heads], owner[single][heads]
        every = np.arange(buckets + 1)
        header, entry = np.searchsorted(of, every), np.searchsorted(bucket, every)
        repeated = np.unique(values[twice])
        repeated = repeated[np.argsort(exchange.bucket_of(repeated, buckets), kind="stable")]
        shared = np.searchsorted(exchange.bucket_of(repeated, buckets), every)
        yield batch_of(
            buckets,
            bucket=pa.array(np.arange(buckets), pa.int32()),
            heads_a=exchange.lists(a[who], header, pa.int64()),
            heads_b=exchange.lists(b[who], header, pa.int64()),
            counts=exchange.lists(counts, header, pa.int32()),
            hashes=exchange.lists(exchange.signed(values[single]), entry, pa.int64()),
            repeated=exchange.lists(exchange.signed(repeated), shared, pa.int64()),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.column(batch, "_text")
            for x, y in words.slices(texts, exchange.CHUNK_BYTES):
                yield from chunk(*(words.column(batch, c).slice(x, y - x) for c in ("key", "th", "_text")))

    return docs.select("key", "th", "_text").mapInArrow(run, SHRED)


def answer(table: pa.Table, buckets: int) -> pa.Table:
    """For one bucket: rows of documents as they are, and of each set its hashes that another set has too."""
    is_row = np.asarray(table["n"].combine_chunks().is_valid())
    rows, table = table.filter(pa.array(is_row)), table.filter(pa.array(~is_row))
    hashes, _ = exchange.flat(table["hashes"])
    repeated, _ = exchange.flat(table["repeated"])
    a, _ = exchange.flat(table["heads_a"])
    b, _ = exchange.flat(table["heads_b"])
    counts, _ = exchange.flat(table["counts"])
    # one set may have asked from several batches: its number, and one question of each set and hash
    distinct, number = np.unique(np.column_stack([a, b]), axis=0, return_inverse=True)
    owner = np.repeat(number.ravel().astype(np.int32), counts)
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    del order
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
    group = np.diff(np.append(heads, len(hashes)))
    found = np.repeat(group > 1, group) | np.isin(hashes, repeated)
    hashes, owner = hashes[found], owner[found]
    # answers in a row per slice of the sets
    to = exchange.bucket_of(distinct[:, 0].view(np.uint64), buckets)[owner] if len(owner) else owner
    order = np.lexsort((owner, to))
    hashes, owner, to = hashes[order], owner[order], to[order]
    fresh = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else np.zeros(0, np.int64)
    sizes, who = np.diff(np.append(fresh, len(owner))), owner[fresh]
    used, first = np.unique(to, return_index=True)
    ends = np.append(first, len(to)) if len(used) else np.zeros(1, np.int64)
    heads = np.searchsorted(fresh, ends)
    size = len(used)
    columns = {
        "a": pa.nulls(size, pa.int64()),
        "row": pa.array(np.zeros(size, bool)),
        "found": exchange.lists(hashes, ends, pa.int64()),
        "slice": pa.array(used, pa.int32()),
        "sets_a": exchange.lists(distinct[who, 0] if size else [], heads, pa.int64()),
        "sets_b": exchange.lists(distinct[who, 1] if size else [], heads, pa.int64()),
        "counts": exchange.lists(sizes, heads, pa.int32()),
    }
    order = ["key", "th", "n", "a", "b", "row", "found", "slice", "sets_a", "sets_b", "counts"]
    told = pa.table([columns.get(c, columns["a"]) for c in order], names=order)
    given = {c: rows[c] for c in ("key", "th", "n", "a", "b")}
    given |= {"row": pa.array(np.ones(len(rows), bool)), "found": rows["known"]}
    kept = pa.table(
        [given[c] if c in given else pa.nulls(len(rows), told.schema.field(c).type) for c in order], names=order
    )
    return pa.concat_tables([kept.cast(told.schema), told])


def by_set(table: pa.Table) -> pa.Table:
    """For one slice of the sets: all recurring hashes of a set in one row."""
    found, _ = exchange.flat(table["found"])
    a, _ = exchange.flat(table["sets_a"])
    b, _ = exchange.flat(table["sets_b"])
    counts, _ = exchange.flat(table["counts"])
    distinct, number = np.unique(np.column_stack([a, b]), axis=0, return_inverse=True)
    owner = np.repeat(number.ravel(), counts)
    order = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(len(distinct) + 1))
    return pa.table(
        {
            "a": pa.array(distinct[:, 0], pa.int64()),
            "b": pa.array(distinct[:, 1], pa.int64()),
            "found": exchange.lists(found[order], ends, pa.int64()),
        }
    )


def least_overlap(n: Column) -> Column:
    """``ceil(t n)``: what any set of at least the threshold's similarity shares with one of ``n`` shingles."""
    return F.floor((n * LEAST + 99) / 100).cast("long")


def recurring_sets(told: DataFrame) -> DataFrame:
    """Sets that can have links: s, a, b, n, r and ``top``, their recurring shingles, rarest first."""
    sizes = told.where("row").groupBy("a", "b").agg(F.max("n").alias("n"))
    answers = told.where("not row").select("slice", "sets_a", "sets_b", "counts", "found")
    answers = answers.groupBy("slice").applyInArrow(by_set, FOUND)
    known = told.where(F.col("row") & (F.size("found") > 0)).select("a", "b", "found")
    parts = stored(answers.unionByName(known))
    enough = F.col("r") * 100 >= F.col("n") * LEAST
    some = parts.groupBy("a", "b").agg(F.sum(F.size("found")).alias("r")).join(sizes, ["a", "b"]).where(enough)
    held = parts.join(some.select("a", "b", "n"), ["a", "b"])
    elements = stored(held.select("a", "b", "n", F.explode("found").alias("h")).distinct())
    for _ in range(2):  # what recurs only in sets that are out by now does not count
        wide = elements.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
        elements = elements.select("a", "b", "n", "h").join(wide, "h")
        r = elements.groupBy("a", "b").agg(F.count("*").alias("r"), F.first("n").alias("n")).where(enough)
        elements = stored(elements.join(r.select("a", "b"), ["a", "b"], "left_semi"))
    tops = elements.groupBy("a", "b", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("top"))
    return stored(tops.withColumns({"r": F.size("top").cast("long"), "s": F.monotonically_increasing_id()}))


def prefix(c: int) -> Column:
    """The recurring shingles among the first ``n - ceil(t n) + c``; unshared ones stand before them."""
    length = F.col("n") - least_overlap(F.col("n")) + c - (F.col("n") - F.col("r"))
    return F.slice("top", 1, F.greatest(F.least(length, F.col("r")), F.lit(0)).cast("int"))


def boundary(sets: DataFrame) -> int:
    """The size up to which sets list subsets: where listed subsets and list entries cost the least together."""
    m1, m2 = F.size(prefix(1)).cast("double"), F.size(prefix(2)).cast("double")
    # sizes in steps of five per cent: a few hundred rows whatever the corpus
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.05)))).alias("step")
    costs = sets.groupBy(step).agg(
        F.max("n").alias("n"), F.sum(m2 * (m2 - 1) / 2).alias("subsets"), F.sum(m1 * ENTRY).alias("entries")
    )
    rows = sorted((r["n"], r["subsets"], r["entries"]) for r in costs.collect())
    best, chosen = None, 0
    for x in [0, *(n for n, _, _ in rows)]:
        cost = sum(s for n, s, _ in rows if n <= x) + sum(e for n, _, e in rows if n >= LEAST * (x + 1) / 100)
        if best is None or cost < best:
            best, chosen = cost, x
    return chosen


def keys_of(sets: DataFrame, x: int) -> DataFrame:
    """Entries of the lists: k (of two shingles of a small set, or one of a large one), s, n, at, size_class.

    ``at`` is the place of the (first) shingle in the whole set. Sets that a large one can be linked with are
    entered in the lists of single shingles as well.
    """
    unshared = F.col("n") - F.col("r")
    two = prefix(2)
    last = F.size(two)
    subsets = F.flatten(
        F.transform(
            two,
            lambda e, i: F.transform(
                F.slice(two, i + 2, F.greatest(last - i - 1, F.lit(0))),
                lambda o: F.struct(
                    F.least(e["h"], o["h"]).alias("k1"), F.greatest(e["h"], o["h"]).alias("k2"), (unshared + i).alias("at")
                ),
            ),
        )
    )
    single = F.transform(
        prefix(1), lambda e, i: F.struct(e["h"].alias("k1"), F.lit(None).cast("long").alias("k2"), (unshared + i).alias("at"))
    )
    small = sets.where(F.col("n") <= x).select("s", "n", F.explode(subsets).alias("e"))
    large = sets.where(F.col("n") * 100 >= LEAST * (x + 1)).select("s", "n", F.explode(single).alias("e"))
    both = small.unionByName(large)
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(CLASS)))).cast("int")
    return both.select(
        F.xxhash64("e.k1", "e.k2").alias("k"), "s", "n", F.col("e.at").alias("at"), size_class.alias("size_class")
    )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``inter``, the exact number of shared shingles, to pairs ``a``, ``b`` with sizes ``na``, ``nb``."""
    hashes = sets.select("s", F.transform("top", lambda e: e["h"]).alias("hs"))
    left = hashes.select(F.col("s").alias("a"), F.col("hs").alias("ha"))
    right = hashes.select(F.col("s").alias("b"), F.col("hs").alias("hb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("inter"))


def linked() -> Column:
    return F.col("inter") * 100 >= (F.col("na") + F.col("nb") - F.col("inter")) * LEAST


def fits(n: Column, at: Column, other_n: Column, other_at: Column) -> Column:
    """Whether two sets can be linked whose first shared shingle stands at these places."""
    after = F.least(n - at, other_n - other_at)
    near = F.least(n, other_n) * 100 >= F.greatest(n, other_n) * LEAST
    return near & (after * (100 + LEAST) >= (n + other_n) * LEAST)


def clusters_of(entries: DataFrame, leaders: DataFrame) -> DataFrame:
    """Sets that share a list with others of like size, as ``node`` and ``label``.

    Nothing is compared here: whatever might be linked is in one cluster. The leaders of a list are tied where
    their size classes are near enough for a link.
    """
    own = entries.join(leaders, ["k", "size_class"]).select(F.col("s").alias("a"), F.col("leader").alias("b"))
    reach = int(np.ceil(np.log(100 / LEAST) / np.log(CLASS)))
    other = leaders.select("k", F.col("size_class").alias("class2"), F.col("leader").alias("leader2"))
    tied = leaders.join(other, "k").where((F.col("class2") > F.col("size_class")) & (F.col("class2") <= F.col("size_class") + reach))
    return components(own.unionByName(tied.select(F.col("leader").alias("a"), F.col("leader2").alias("b"))).distinct())


def scan_blocks(table: pa.Table) -> pa.Table:
    """Scans the inverted lists of each block for its outsiders; links that merge components come back."""
    column = {c: np.asarray(table[c]) for c in ("cluster", "bi", "bo", "scans", "s", "n", "c")}
    values, counts = exchange.flat(table["hs"])
    ends = np.concatenate([[0], np.cumsum(counts)])
    order = np.lexsort((column["bo"], column["bi"], column["cluster"]))
    keys = [column[c][order] for c in ("cluster", "bi", "bo")]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    links: list[tuple[int, int]] = []
    for rows in np.split(order, np.flatnonzero(fresh)[1:]):
        scans = column["scans"][rows]
        links += block_links(rows[scans], rows[~scans], column, values, ends)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def block_links(scanners, members, column: dict, values: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Links between outsiders and members, as many as it takes to merge what they connect."""
    if not len(scanners) or not len(members):
        return []
    size = ends[members + 1] - ends[members]
    at = np.repeat(ends[members], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    order = np.argsort(values[at], kind="stable")
    lists, owners = values[at][order], np.repeat(np.arange(len(members)), size)[order]
    n, c, s = column["n"], column["c"], column["s"]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for row in scanners:
        own = values[ends[row] : ends[row + 1]]
        low, high = np.searchsorted(lists, own, "left"), np.searchsorted(lists, own, "right")
        length = high - low
        found = np.repeat(low, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        inter = np.bincount(owners[found], minlength=len(members))
        near = inter * 100 >= (n[row] + n[members] - inter) * LEAST
        for i in np.flatnonzero(near & (c[members] != c[row])):
            x, y = root(int(c[row])), root(int(c[members[i]]))
            if x != y:
                parent[x] = y
                out.append((int(s[row]), int(s[members[i]])))
    return out


def links_between(clusters: DataFrame, labels: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links that merge components of one cluster: all but its largest component scan all its sets.

    Sets go to blocks of about ``block``; each block of outsiders meets each block of sets in a task of its
    own, so no task holds more than two blocks, and no pair is written down that is no link.
    """
    marked = clusters.select(F.col("node").alias("s"), F.col("label").alias("cluster")).join(
        labels.select(F.col("node").alias("s"), F.col("label").alias("c")), "s", "left"
    )
    marked = stored(marked.withColumn("c", F.coalesce("c", "s")))
    sizes = marked.groupBy("cluster", "c").agg(F.count("*").alias("m"))
    total = sizes.groupBy("cluster").agg(
        F.sum("m").alias("m"), F.max("m").alias("most"), F.max_by("c", F.col("m").cast("decimal(20,0)") * 10**18 + F.col("c")).alias("main")
    )
    total = total.where("most < m").select(
        "cluster", "main", F.ceil(F.col("m") / block).alias("ni"), F.ceil((F.col("m") - F.col("most")) / block).alias("no")
    )
    rows = marked.join(total, "cluster").join(
        sets.select("s", "n", F.transform("top", lambda e: e["h"]).alias("hs")), "s"
    )
    mine = rows.withColumns({"bi": F.pmod(F.xxhash64("s"), F.col("ni")), "bo": F.pmod(F.xxhash64(F.lit("outside"), "s"), F.col("no"))})
    scanners = mine.where("c <> main").withColumn("bi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1)))
    members = mine.withColumn("bo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("no") - 1)))
    both = scanners.withColumn("scans", F.lit(True)).unionByName(members.withColumn("scans", F.lit(False)))
    # small clusters share tasks
    together = F.pmod(F.xxhash64("cluster"), F.lit(SMALL_CLUSTER_TASKS))
    unit = F.when((F.col("ni") == 1) & (F.col("no") == 1), together).otherwise(F.xxhash64("cluster", "bi", "bo"))
    given = both.select(unit.alias("unit"), "cluster", "bi", "bo", "scans", "s", "n", "c", "hs")
    return given.groupBy("unit").applyInArrow(scan_blocks, "a long, b long")


def links_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links ``a``, ``b`` that connect all linked sets, and the components of them."""
    entries = stored(keys_of(sets, boundary(sets)))
    lists = entries.groupBy("k").agg(F.count("*").alias("members")).where("members > 1")
    entries = stored(entries.join(lists.select("k"), "k", "left_semi"))
    first = F.min(F.struct("n", "s", "at"))
    leaders = stored(
        entries.groupBy("k", "size_class").agg(first.alias("f")).select(
            "k", "size_class", F.col("f.s").alias("leader"), F.col("f.n").alias("leader_n"), F.col("f.at").alias("leader_at")
        )
    )
    led = entries.join(leaders, ["k", "size_class"]).where("s <> leader")
    before = F.col("s") < F.col("leader")
    star = led.where(fits(F.col("n"), F.col("at"), F.col("leader_n"), F.col("leader_at"))).select(
        F.least("s", "leader").alias("a"), F.greatest("s", "leader").alias("b"),
        F.when(before, F.col("n")).otherwise(F.col("leader_n")).alias("na"),
        F.when(before, F.col("leader_n")).otherwise(F.col("n")).alias("nb"),
    )
    found = stored(verified(star.distinct(), sets).where(linked()).select("a", "b"))
    labels = components(found)
    more = stored(links_between(clusters_of(entries, leaders), labels, sets, BLOCK))
    if more.limit(1).count():
        found = stored(found.unionByName(more))
        labels = components(found)
    return found, labels


def grouped_rows(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: key, th (a hash of the text), n, and ``ga``, ``gb``, the label of its component."""
    body = text_or_empty(text)
    given = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(body).alias("th"), body.alias("_text"))
    buckets = buckets or exchange.buckets_for(given, "_text")
    told = stored(shred(given, shingle, buckets).groupBy("bucket").applyInArrow(lambda t: answer(t, buckets), ANSWER))
    sets = recurring_sets(told)
    _, labels = links_of(sets)
    names = sets.select(F.col("s").alias("label"), F.col("a").alias("ga"), F.col("b").alias("gb"))
    merged = sets.select("s", "a", "b").join(labels.withColumnRenamed("node", "s"), "s").join(names, "label")
    rows = told.where("row").select("key", "th", "n", "a", "b").join(merged.select("a", "b", "ga", "gb"), ["a", "b"], "left")
    return stored(rows.select("key", "th", "n", F.coalesce("ga", "a").alias("ga"), F.coalesce("gb", "b").alias("gb")))


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, buckets: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, and ``text_hash``, a hash of the text."""
    rows = grouped_rows(docs, key, text, shingle, buckets)
    full = rows.where("n > 0")
    smallest = full.groupBy("ga", "gb").agg(F.min("key").alias("component_id"))
    out = full.join(smallest, ["ga", "gb"]).unionByName(rows.where("n = 0").withColumn("component_id", F.col("key")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("th").alias("text_hash"))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest key.

    Rows without words all stay. Components are told apart by their own labels, so those without any key, or with
    the same smallest key, each keep a row; among rows of that key it is the one with the smallest text hash. Of
    repeats of the row that stays, one does. Whole rows meet the decision by their number, so repeats are spread as
    all other rows are.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = numbered(docs, names)
    body = text_or_empty(names[text])
    groups = grouped_rows(rows, names[key], names[text]).where("n > 0")
    first = F.min(F.struct(F.col("key").isNull().alias("last"), F.col("key").alias("k"), F.col("th").alias("h")))
    # a text has one component, so key and text hash also name the row's component
    kept = groups.groupBy("ga", "gb").agg(first.alias("f")).select(F.col("f.k").alias("k"), F.col("f.h").alias("h"))
    light = rows.select(
        "_row", F.col(names[key]).cast("long").alias("_key"), F.xxhash64(body).alias("_th"), (F.btrim(body, F.lit(WHITE)) == "").alias("_blank")
    )
    # one number for each key and text, found in the tasks first
    one = light.where(~F.col("_blank")).groupBy("_key", "_th").agg(F.min("_row").alias("_row"))
    stay = one.join(kept, F.col("_key").eqNullSafe(F.col("k")) & (F.col("_th") == F.col("h")), "left_semi").select("_row")
    stay = stay.unionByName(light.where("_blank").select("_row"))
    return rows.join(stay, "_row", "left_semi").select([F.col(n).alias(c) for c, n in names.items()])
