"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts are sets of word shingles in one global order, rare ones first. Two sets with
enough overlap share a shingle within their prefixes, and l shingles within prefixes
that are l - 1 longer. Each document picks its l by the estimated cost of its candidates;
a pair is verified only when it shares as many prefix shingles as the shorter of its two
lengthenings asks for. Equal sets are one class and only classes are joined.

A shingle that many classes share is not expanded into all pairs at once: every class is
first compared with one other, then with the smallest class of each of its shingles, and
linked classes become one component each time; only pairs of different components are
compared afterwards. Pairs inside a component cannot change the result, so no link
between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.llm.components import components
from failcast.llm.words import blocks, find_words, mix, return_memory, windows
from failcast.scratch import finished, materialize, scope

#: Most words by which a prefix is lengthened, plus 1.
MOST_MATCHES = 4
#: Cost of a verification against that of reading a posting.
VERIFY_COST = 20.0
#: Shingles in at least 1 of so many documents of a slice of the input are counted as common, and the most
#: frequent ones of them are told to all tasks. Which ones only decides the order of shingles: any order
#: gives the same links.
COMMON_SHARE, MOST_COMMON = 500, 200_000
#: Shingles of a slice, bits of a bitmap, and text bytes whose prefixes go to a bucket.
SLICE_SHINGLES, BITS, BUCKET_BYTES = 1_000_000, 1024, 3_000_000
#: Sets larger than this have a second bitmap of so many bits.
WIDE_FROM, WIDE_BITS = 300, 8192
#: Where blocks meet, rows bring the second bitmap folded to this size.
FOLDED_BITS = WIDE_BITS // 2
#: A shingle of this many classes is compared block against block in Python, and the classes of a block.
HEAVY, BLOCK = 24, 512


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """For rows of bounded text: their distinct shingle hashes, sorted (words of A-Z lowered text)."""
    return_memory()
    for rows, data, offsets in blocks(batch):
        w = find_words(data, offsets, lower=True)
        h = w.hashes()
        grams, at = windows(h, w.first, k)
        edge = np.searchsorted(at, w.first)
        sets = []
        for i, (a, b) in enumerate(zip(edge, edge[1:])):
            if b > a:
                sets.append(np.unique(grams[a:b]))
            else:
                short = h[w.first[i]: w.first[i + 1]]  # fewer than k words: all of them are one shingle
                value = np.uint64(len(short))
                for x in short:
                    value = mix(np.array([value ^ x]))[0]
                sets.append(np.array([value] if len(short) else [], np.uint64))
        yield rows, sets


def least_overlap(n, percent: int):
    return -(-percent * n // 100)


def _signatures(k: int):
    salt = np.uint64(0x5851F42D4C957F2D)

    def run(batches):
        """Per document its size, a 128-bit sum of its set and a bitmap of it; per slice its common shingles."""
        seen, docs, held = [], 0, 0

        def common():
            value, times = np.unique(np.concatenate(seen), return_counts=True)
            often = (times >= 2) & (times * COMMON_SHARE >= docs)
            n = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(times[often], pa.int64()), pa.array(value[often].view(np.int64)), pa.nulls(n, pa.int64()),
                                               pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], ["doc_id", "n", "h1", "h2", "bits", "wide"])

        for batch in batches:
            for rows, sets in shingle_sets(batch, k):
                n = np.array([len(s) for s in sets])
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                sums = [np.array([x.sum(dtype=np.uint64) for x in np.split(mix(flat ^ s), np.cumsum(n)[:-1])], np.uint64) for s in (np.uint64(0), salt)]
                bits = np.zeros((len(sets), BITS), dtype=bool)
                bits[np.repeat(np.arange(len(sets)), n), (flat % np.uint64(BITS)).astype(np.int64)] = True
                longs = np.packbits(bits, axis=1).view(np.int64)
                wide = np.zeros(len(sets), dtype=object)
                for i, x in enumerate(sets):  # a long set fills a small bitmap
                    wide[i] = None
                    if len(x) > WIDE_FROM:
                        b = np.zeros(WIDE_BITS, dtype=bool)
                        b[(x % np.uint64(WIDE_BITS)).astype(np.int64)] = True
                        wide[i] = np.packbits(b).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), *[pa.array(s.view(np.int64)) for s in sums],
                                                  pa.array(list(longs), pa.list_(pa.int64())), pa.array(list(wide), pa.list_(pa.int64()))], ["doc_id", "n", "h1", "h2", "bits", "wide"])
                seen.append(flat)
                docs, held = docs + len(sets), held + len(flat)
                if held > SLICE_SHINGLES:
                    yield common()
                    seen, docs, held = [], 0, 0
        if docs:
            yield common()
    return run


SENT = "bucket int, token binary, doc binary, at binary, many binary"


def _send(k: int, percent: int, common: np.ndarray, weight: np.ndarray, buckets: int):
    """Prefixes long enough for every lengthening. Each distinct shingle of a slice goes once to its bucket,
    with its first document and whether the slice has more; the others, known to share, go along by document."""
    def heads(rows, sets):
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        key = flat >> np.uint64(8)
        if len(common):
            place = np.minimum(np.searchsorted(common, flat), len(common) - 1)
            key |= np.where(common[place] == flat, weight[place], 0).astype(np.uint64) << np.uint64(56)
        token, doc, at, done = [], [], [], 0
        for name, s in zip(rows.column("doc_id").to_numpy(), sets):
            n = len(s)
            if n:
                most = min(n, n - least_overlap(n, percent) + MOST_MATCHES)
                mine = key[done: done + n]
                first = np.argpartition(mine, most - 1)[:most] if most < n else np.arange(n)
                token.append(s[first[np.lexsort((s[first], mine[first]))]])
                doc.append(np.full(most, name)), at.append(np.arange(most))
            done += n
        return token, doc, at

    def told(parts):
        token, doc, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, token))
        token, doc, at = token[order], doc[order], at[order]
        same = np.zeros(len(token), dtype=bool)
        same[1:] = token[1:] == token[:-1]
        repeat = same.copy()
        repeat[1:] &= doc[1:] == doc[:-1]  # rows that share an id
        token, doc, at, same = token[~repeat], doc[~repeat], at[~repeat], same[~repeat]
        many = np.append(same[1:], False) & ~same  # the first of several
        bucket = np.where(same, mix(doc.astype(np.int64).view(np.uint64)), token >> np.uint64(24)) % np.uint64(buckets)
        flag = np.where(same, 2, many)  # 2: only goes along
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = {c.split()[0]: [] for c in SENT.split(", ")}
        for i, (x, y) in enumerate(zip(edge, edge[1:])):
            if y > x:
                part = order[x:y][np.argsort(doc[order[x:y]], kind="stable")]
                for c, v in zip(out, (i, token[part].astype("<u8").tobytes(), doc[part].astype("<i8").tobytes(), at[part].astype("<u4").tobytes(), flag[part].astype("u1").tobytes())):
                    out[c].append(v)
        return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *[pa.array(out[c], pa.binary()) for c in list(out)[1:]]], list(out))

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for rows, sets in shingle_sets(batch, k):
                for t, d, a in zip(*heads(rows, sets)):
                    parts.append((t, d, a))
                    held += len(t)
                if held > SLICE_SHINGLES // 4:
                    yield told(parts)
                    parts, held = [], 0
        if held:
            yield told(parts)
    return run


def _meet(table: pa.Table) -> pa.Table:
    """One bucket: the prefix shingles that more than one document holds."""
    return_memory()
    token, doc, at, flag = (np.concatenate([np.frombuffer(x, d) for x in table.column(c).to_pylist()]) for c, d in (("token", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("many", "u1")))
    order = np.argsort(token, kind="stable")
    token, doc, at, flag = token[order], doc[order], at[order], flag[order]
    asks = flag < 2
    _, which, times = np.unique(token[asks], return_inverse=True, return_counts=True)
    many = np.bincount(which, weights=flag[asks], minlength=len(times)) > 0
    shared = np.ones(len(token), dtype=bool)
    shared[asks] = (many | (times > 1))[which]
    return pa.table([pa.array(token[shared].view(np.int64)), pa.array(doc[shared]), pa.array(at[shared], pa.int64())], names=["token", "doc", "at"])


def _with_sets(rows: DataFrame, k: int) -> DataFrame:
    """Rows (any long columns and text) with their sets in place of the text."""
    own = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part, sets in shingle_sets(batch, k):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], [*own, "shingles"])

    return rows.select(*own, "text").mapInArrow(run, ", ".join(f"{c} long" for c in own) + ", shingles array<long>")


def _postings(docs: DataFrame, classes: DataFrame, common: DataFrame, k: int, percent: int) -> DataFrame:
    """token, doc, n, matches, hub: prefix shingles that two classes or more share."""
    often = common.orderBy(F.desc("times"), "h1").limit(MOST_COMMON).collect()
    values, times = np.array([r.h1 for r in often], np.int64).view(np.uint64), np.array([r.times for r in often], float)
    order = np.argsort(values)
    weight = np.minimum(255, 1 + 8 * np.log2(np.maximum(times[order], 1))).astype(np.uint64)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size * (100 - percent) // (100 * BUCKET_BYTES)) + 1
    sent = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_send(k, percent, values[order], weight, buckets), SENT)
    met = sent.groupBy("bucket").applyInArrow(_meet, "token long, doc long, at long")
    every = materialize(met.join(classes.select(F.col("rep").alias("doc"), "n"), "doc"), "prefixes")
    shared = every.groupBy("token").agg(F.count("*").alias("classes"), F.min("doc").alias("hub")).where("classes > 1")
    mine = (every.join(materialize(shared, "shared"), "token").groupBy("doc", "n")
            .agg(F.sort_array(F.collect_list(F.struct("at", "token", "classes", "hub"))).alias("row")))
    base = F.col("n") - F.expr(f"-floor(-{percent} * n / 100)").cast("long")  # prefix length less 1 for one match
    overlap = F.col("n") - base

    def cost(matches: int):
        read = F.aggregate(F.filter("row", lambda x: x["at"] <= base + matches - 1), F.lit(0).cast("long"), lambda a, x: a + x["classes"] - 1)
        return F.when(F.lit(matches) <= overlap, F.struct((read + VERIFY_COST * read / matches).alias("cost"), F.lit(matches).alias("matches")))

    best = F.array_min(F.array_compact(F.array(*[cost(m) for m in range(1, MOST_MATCHES + 1)])))["matches"]
    picked = mine.withColumn("matches", best).withColumn("x", F.explode(F.filter("row", lambda x: x["at"] <= base + F.col("matches") - 1)))
    return materialize(picked.select("x.token", "doc", "n", "matches", "x.hub"), "postings")


def _alike(m, n, percent: int):
    """Sizes that allow a link."""
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _differ(x, y):
    """Bits in which two bitmaps differ: as many shingles, at least, are in one set only."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0).cast("long"), lambda s, v: s + v)


def _possible(n_a, n_b, differ, percent: int):
    most = (n_a + n_b - differ) / 2  # of the intersection
    return 100 * most >= percent * (n_a + n_b - most)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, wide: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough. Bitmaps go first, then wide ones for long
    texts, which drop a pair of ids if they rule out every pair of their texts; only the sets of the
    pairs left are made from the texts."""
    left, right = (classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    pairs = pairs.join(left, "a").join(right, "b").where(_possible(F.col("n_a"), F.col("n_b"), _differ("bits_a", "bits_b"), percent))
    some = F.col("a") >= -(1 << 63)  # Spark makes its Bloom filters of filtered tables
    near = materialize(pairs.select("a", "b"), "candidates")
    if near.isEmpty():  # no jobs for what can find nothing: the driver keeps the plans of all of them
        return near
    near = near.where(some)
    left, right = (wide.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"), F.col("texts").alias(f"texts_{c}")) for c in "ab")
    apart = near.distinct().join(left, "a").join(right, "b").where(~_possible(F.col("n_a"), F.col("n_b"), _differ("wide_a", "wide_b"), percent))
    unlike = materialize(apart.groupBy("a", "b").agg(F.count("*").alias("met"), F.first(F.col("texts_a") * F.col("texts_b")).alias("all")).where("met = all").select("a", "b"), "unlike")
    near = materialize(near.join(unlike, ["a", "b"], "left_anti"), "candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("b"), "text").join(near.where(some), "b")
    hubs = docs.select(F.col("doc_id").cast("long").alias("a"), "text").join(materialize(near.select("a").distinct(), "hubs").where(some), "a", "left_semi")
    member, hub = _with_sets(texts, k), _with_sets(hubs, k).withColumnRenamed("shingles", "of_hub")
    both = F.size(F.array_intersect("shingles", "of_hub"))
    linked = member.join(hub, "a").where(100 * both >= percent * (F.size("shingles") + F.size("of_hub") - both))
    return materialize(linked.select("a", "b"), "links")


def _blocks_meet(percent: int):
    """Runs of rows of one shingle and one pair of blocks, in order: the pairs that may be linked."""
    count = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)

    def run_pairs(doc, n, label, matches, second, bits, wide, has_wide):
        out = []
        for i in range(len(doc)):
            m = np.abs(n[i + 1:] - n[i]) * 100 <= (100 - percent) * np.maximum(n[i + 1:], n[i])
            m &= label[i + 1:] != label[i]
            if second.any():
                m &= second[i + 1:] != second[i]
            at = np.flatnonzero(m) + i + 1
            if len(at):
                differ = count[bits[at] ^ bits[i]].sum(axis=1, dtype=np.int64)
                twice = n[at] + n[i] - differ  # twice the largest possible intersection
                at = at[100 * twice >= percent * (2 * (n[at] + n[i]) - twice)]
                if has_wide[i]:  # long sets fill the small bitmaps
                    differ = np.where(has_wide[at], count[wide[at] ^ wide[i]].sum(axis=1, dtype=np.int64), 0)
                    twice = n[at] + n[i] - differ
                    at = at[100 * twice >= percent * (2 * (n[at] + n[i]) - twice)]
                out.append((np.minimum(doc[at], doc[i]), np.maximum(doc[at], doc[i]), np.minimum(matches[at], matches[i])))
        return out

    def told(rows: pa.Table, last: bool):
        size = len(rows)
        change = np.zeros(size, dtype=bool)
        change[:1] = True
        for c in ("token", "one", "two"):
            v = rows.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        edge = np.append(np.flatnonzero(change), size)
        runs = len(edge) - 1 if last else len(edge) - 2
        doc, n, label, matches, second = (rows.column(c).to_numpy() for c in ("doc", "n", "label", "matches", "second"))
        bits = rows.column("bits").combine_chunks().flatten().to_numpy().reshape(size, -1).view(np.uint16)
        given = rows.column("wide").combine_chunks()
        has_wide = given.is_valid().to_numpy(zero_copy_only=False)
        wide = given.flatten().to_numpy().reshape(-1, FOLDED_BITS // 64).view(np.uint16)
        place = np.cumsum(has_wide) - 1

        def of_run(a, b):
            here = np.zeros((b - a, FOLDED_BITS // 16), np.uint16)
            here[has_wide[a:b]] = wide[place[a:b][has_wide[a:b]]]
            return run_pairs(doc[a:b], n[a:b], label[a:b], matches[a:b], second[a:b], bits[a:b], here, has_wide[a:b])

        out = [x for a, b in zip(edge[:max(0, runs)], edge[1: runs + 1]) for x in of_run(a, b)]
        cols = [np.concatenate([np.zeros(0, np.int64), *[x[i] for x in out]]) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["a", "b", "asked"]), rows.slice(edge[max(0, runs)])

    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            out, held = told(held, last=False)
            yield out
        if held is not None and len(held):
            yield told(held, last=True)[0]
    return run


def _far(rest: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share as many prefix shingles as the shorter lengthening
    asks for and that sizes and bitmaps allow. Shingles of few classes are joined with themselves; those of
    many are compared in blocks, and only pairs that may be linked come out."""
    bits = classes.select(F.col("rep").alias("doc"), "bits", "wide")
    x, y = rest.where(F.col("classes") < HEAVY).alias("x"), rest.where(F.col("classes") < HEAVY).alias("y")
    meets = (F.col("x.token") == F.col("y.token")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.label") != F.col("y.label")) & _alike(F.col("x.n"), F.col("y.n"), percent)
    light = x.join(y, meets).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.least("x.matches", "y.matches").alias("asked"))
    blocks_of = F.ceil(F.col("classes") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("doc"), blocks_of).cast("int")
    placed = (rest.where(F.col("classes") >= HEAVY).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks_of - 1)))
              .select("token", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), (F.col("mine") > F.col("other")).alias("second"),
                      "doc", "n", "label", F.col("matches").cast("long").alias("matches")).join(bits, "doc"))
    key = ["token", "one", "two"]
    heavy = placed.repartition(*key).sortWithinPartitions(*key).mapInArrow(_blocks_meet(percent), "a long, b long, asked long")
    met = light.unionByName(heavy).groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("asked").alias("asked"))
    return met.where("shared >= asked").select("a", "b")


def _mixed(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """token, doc, n, matches, label, classes: the shingles whose documents are not all in one component yet."""
    groups = materialize(components(links), "labels")
    now = materialize(labelled.join(groups, labelled["doc"] == groups["node"], "left").select(
        "token", "doc", "n", "matches", F.coalesce("component", "doc").alias("label")), "labelled")
    mixed = now.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("classes")).where("low < high").select("token", "classes")
    return materialize(now.join(materialize(mixed, "mixed_tokens"), "token"), "mixed")


def link_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union of their sets of distinct k-word
    shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered; fewer than k words: all as one shingle).
    component_id is the smallest doc_id reachable by links, itself included. Null, empty and
    blank texts have no shingles and link with nothing. Rows that share an id count as one document;
    rows without an id link with nothing and have a null component.
    The result is written; all other tables that the join writes are deleted at its end.
    """
    with scope(docs.sparkSession):
        return finished(_linked(docs, k, percent), "linked")


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    made = materialize(docs.select("doc_id", "text").mapInArrow(_signatures(k), "doc_id long, n long, h1 long, h2 long, bits array<long>, wide array<long>"), "signatures")
    rows = made.where("h2 IS NOT NULL").drop("bits", "wide")
    common = made.where("h2 IS NULL").groupBy("h1").agg(F.sum("n").alias("times"))
    half = FOLDED_BITS // 64  # longs; a shingle's bit is its remainder, so the halves fold into one another
    folded = F.zip_with(F.slice("wide", 1, half), F.slice("wide", half + 1, half), lambda x, y: x.bitwiseOR(y))
    classes = materialize(made.where("n > 0 AND h2 IS NOT NULL AND doc_id IS NOT NULL").groupBy("n", "h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.first("bits").alias("bits"), F.first(folded).alias("wide")), "classes")
    # Spark's own Bloom filters keep rows that meet nothing out of the shuffles of selective joins
    docs.sparkSession.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1MB")
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    wide = made.where("wide IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n", "h1", "h2", "wide")
    if several:  # with the number of each id's different texts
        texts = rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "h1", "h2").distinct().groupBy("doc_id").agg(F.count("*").alias("texts"))
        wide = materialize(wide.dropDuplicates(["doc_id", "n", "h1", "h2"]).join(texts, "doc_id"), "wide")
    else:
        wide = wide.withColumn("texts", F.lit(1).cast("long"))
    postings = _postings(docs, classes, common, k, percent)

    # each class with the smallest of its shingles' smallest classes: one pair a class
    sizes = materialize(postings.groupBy("hub").agg(F.count("*").alias("rows")).select("hub").join(
        classes.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n")), "hub"), "hubs")
    first = (postings.where("doc <> hub").join(sizes, "hub").where(_alike(F.col("n"), F.col("hub_n"), percent))
             .groupBy("doc").agg(F.min("hub").alias("a")).select("a", F.col("doc").alias("b")))
    links = _verified(first, docs, classes, wide, k, percent)
    # then, where a shingle's classes are still apart, each of them with the shingle's smallest
    rest = _mixed(postings, links)
    hubs = rest.groupBy("token").agg(F.min(F.struct("doc", "n", "label")).alias("h")).select("token", "h.doc", "h.n", "h.label").toDF("token", "a", "a_n", "a_label")
    stars = rest.join(hubs, "token").where((F.col("label") != F.col("a_label")) & _alike(F.col("n"), F.col("a_n"), percent))
    more = _verified(stars.select("a", F.col("doc").alias("b")).distinct(), docs, classes, wide, k, percent)
    # then all pairs of different components that share as many prefix shingles as they must
    if not more.isEmpty():  # else the components are as they were, and so are their shingles
        links = materialize(links.unionByName(more), "links")
        rest = _mixed(rest, links)
    links = links.unionByName(_verified(_far(rest, classes, percent), docs, classes, wide, k, percent))
    found = rows.join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"], "left")
    if several:  # ids with several rows tie their texts' classes together
        links = links.unionByName(found.where("rep IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
        found = found.withColumn("rep", F.col("doc_id"))
    out = found.join(components(links), F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component kept, the one of the smallest id; rows without an id stay.

    Rows that share an id are one document: if it stays, each of its different texts stays once, and of rows with
    equal id and text one stays."""
    kept = link_components(docs, k, percent).where("doc_id = component_id").select("doc_id").distinct()
    text = "__text_sha"
    named = docs.join(kept, "doc_id", "left_semi").withColumn(text, F.sha2("text", 256)).dropDuplicates(["doc_id", text])
    return named.drop(text).unionByName(docs.where("doc_id IS NULL")).select(*[F.col(f"`{c}`") for c in docs.columns])
