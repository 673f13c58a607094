"""MinHash near-dedup: b-bit signatures, a multi-index Hamming join that loses no pair, links confirmed on full sets.

A document is the set of its five-word shingles; documents of equal sets are one node. A node's signature has SYMBOLS
symbols of eight bits, each of a MinHash. The first INDEXED of them are split into chunks. Two signatures that differ in
at most RADIUS of these symbols differ, by pigeonhole, in at most ERRORS symbols of one chunk; so each node is put under
every choice of a chunk's symbols that leaves ERRORS of them out, and such pairs always meet under a common choice. All
symbols together then bound the candidates more tightly (WIDE). With Jaccard similarity s, symbols differ with
probability (1 - s) * 255/256: at 0.85 a pair is over RADIUS with probability 2e-5, over WIDE with less than 1e-6.

No row is made for a pair. Within a bucket, candidates are joined to a spanning forest. A bucket of more than HOT nodes
is not paired: what is at all near its first node (3/2 WIDE) is linked to it, which adds candidates and loses none, and
only where something is not does the bucket go on, twice with the next node, then under choices of the other chunks; what
is crowded even there is linked to the bucket's first node as it is. Trees of candidates are families. A family's sets
meet in one task, where common shingles are counted; of a larger one, random blocks meet first, and then whatever is not
yet in the family's largest group meets all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, map_batches, narrowed, renamed, text_of
from palimpsest.llm.near_dup import shingles
from palimpsest.llm.simhash import components

SIMILARITY = (85, 100)  # as a fraction: the least Jaccard similarity of a link
SYMBOLS, WIDE = 128, 40  # symbols of a signature, and how many of them may differ
CHUNKS = (6, 6, 6, 7, 7)  # symbols of each indexed chunk
INDEXED, ERRORS = sum(CHUNKS), 2
RADIUS = len(CHUNKS) * (ERRORS + 1) - 1  # of the indexed symbols, so many may differ
DEEP_ERRORS = RADIUS // (len(CHUNKS) - 1)  # in one of the other chunks, if one chunk agrees
HOT = 4096  # nodes of a bucket that are compared with each other, in half a second and half a megabyte
BLOCK = 1 << 20  # shingles that meet in one task
ROUNDS = 2  # of random blocks, for families of more
FEW = 100_000  # rows of at most 150 bytes that are broadcast; more are joined by a shuffle
STEP = 2048  # shingles that are hashed at once


def _multipliers():
    import numpy as np

    rnd = np.random.default_rng(11)
    return rnd.integers(0, 1 << 63, (SYMBOLS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), rnd.integers(0, 1 << 63, (SYMBOLS, 1), dtype=np.uint64)


def signature(hashes, factors) -> bytes:
    """Eight bits of each MinHash of a set's 64-bit hashes; sets of any size are taken in steps of bounded memory."""
    import numpy as np

    a, b = factors
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, (a * hashes[at:at + STEP] + b).min(axis=1), out=least)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def choices(errors: int) -> list[tuple[int, ...]]:
    """The places of the symbols that stay, for each choice of a chunk's symbols that leaves `errors` out."""
    out, start = [], 0
    for size in CHUNKS:
        out += combinations(range(start, start + size), size - errors)
        start += size
    return out


def keys(signatures, errors: int):
    """A 64-bit key for each signature (a row of symbols) and choice."""
    import numpy as np

    out = np.empty((len(signatures), len(choices(errors))), dtype=np.uint64)
    for at, places in enumerate(choices(errors)):
        key = np.full(len(signatures), at, dtype=np.uint64)
        for p in places:
            key = (key << np.uint64(8)) | signatures[:, p]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, at] = key ^ (key >> np.uint64(32))
    return out.view(np.int64)


def _symbols(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SYMBOLS)


def node_key(hashes) -> bytes:
    """128 bits that stand for a set."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes())


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body, n, node, sig) for every row: body a hash of the text, n the size of its set, node and sig null if that is empty."""
    slim = renamed(docs, id=id_col, text=text_col).select("id", text_of(F.col("text")).alias("text"))
    slim = slim.select("id", F.xxhash64("text").alias("body"), "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        factors = _multipliers()
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                text = t.as_py()
                if text.encode("utf-8", "replace").strip():
                    s = shingles(text)
                    rows.append((len(s), node_key(s), signature(s.view("<u8"), factors)))
                else:
                    rows.append((0, None, None))
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 3, (pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("body"), *columns], names=["id", "body", "n", "node", "sig"])

    return map_batches(slim, run, f"id {dict(slim.dtypes)['id']}, body long, n long, node binary, sig binary")


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _under(nodes: DataFrame, errors: int, base: Column) -> DataFrame:
    """(no, sig, bucket): each row under all its choices, within the bucket `base`."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                own = keys(_symbols(b.column("sig")), errors)
                offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(own.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["no", "sig", "base", "keys"])

    keyed = map_batches(nodes.select("no", "sig", base.alias("base")), run, "no long, sig binary, base long, keys array<long>")
    return keyed.select("no", "sig", "base", F.explode("keys").alias("k")).select("no", "sig", F.xxhash64("base", "k").alias("bucket"))


def _forest(rows: DataFrame) -> DataFrame:
    """(a, b): within each bucket, a spanning forest of the pairs whose signatures are within RADIUS and WIDE."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def found(nodes, sigs):
            s = np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(-1, SYMBOLS)
            first, top = np.ascontiguousarray(s[:, :INDEXED]), list(range(len(s)))

            def root(x):
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            for i in range(len(s) - 1):
                near = i + 1 + np.flatnonzero(np.count_nonzero(first[i + 1:] != first[i], axis=1) <= RADIUS)
                for j in near[np.count_nonzero(s[near] != s[i], axis=1) <= WIDE].tolist() if len(near) else ():
                    x, y = root(i), root(j)
                    if x != y:
                        top[max(x, y)] = min(x, y)
                        yield nodes[i], nodes[j]

        def batch_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*pairs)) or [()] * 2], names=["a", "b"])

        bucket, nodes, sigs, pairs = None, [], [], []
        for batch in batches:
            for here, node, sig in zip(*[batch.column(c).to_pylist() for c in ("bucket", "no", "sig")]):
                if here != bucket:
                    if len(nodes) > 1:
                        pairs += found(nodes, sigs)
                    bucket, nodes, sigs = here, [], []
                nodes.append(node)
                sigs.append(sig)
            if pairs:
                yield batch_of(pairs)
                pairs = []
        if len(nodes) > 1:
            pairs += found(nodes, sigs)
        yield batch_of(pairs)

    return map_batches(rows.repartition("bucket").sortWithinPartitions("bucket"), run, "a long, b long").distinct()


def _against_hubs(hot: DataFrame, sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(no, bucket, near) rows of crowded buckets against one node of each: links to it, and the rows that must go on.

    A bucket's hub is the first of the nodes that no hub is near yet. Nodes within 3/2 WIDE of it are linked to it and so
    to each other. Where those are all, the bucket is done. Else the nodes that are not go on, and those that may be
    within WIDE of such a one, which nodes within WIDE / 2 of the hub are not. A node meets a hub once, however many
    buckets they share.
    """
    hubs = hot.groupBy("bucket").agg(F.min(F.struct("near", "no")).alias("h")).select("bucket", F.col("h.no").alias("hub"))
    placed = cut(hot.join(_near(cut(hubs)), "bucket").where("no <> hub").select("no", "bucket", "hub"))
    pairs = placed.select("no", "hub").distinct()
    firsts = pairs.select("hub").distinct().join(sigs.select(F.col("no").alias("hub"), F.col("sig").alias("hub_sig")), "hub")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            far = (_symbols(batch.column("sig")) != _symbols(batch.column("hub_sig"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.select(["no", "hub"]).columns, pa.array(far.astype("int32"))], names=["no", "hub", "far"])

    met = pairs.join(sigs, "no").join(_near(cut(firsts)), "hub").select("no", "hub", "sig", "hub_sig")
    told = cut(map_batches(met, run, "no long, hub long, far int"))
    linked = told.where(2 * F.col("far") <= 3 * WIDE).select(F.col("no").alias("a"), F.col("hub").alias("b"))
    placed = placed.join(told.where(2 * F.col("far") > WIDE), ["no", "hub"]).select("no", "bucket", (2 * F.col("far") <= 3 * WIDE).alias("near"))
    open_ = placed.where("NOT near").select("bucket").distinct()
    return linked, placed.join(open_, "bucket", "left_semi")


def candidates(rows: DataFrame, sigs: DataFrame, depth: int = 0) -> DataFrame:
    """(no, sig, bucket[, near]) -> (a, b), edges that join all nodes of a bucket whose signatures are within RADIUS and WIDE."""
    shared = cut(rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"))
    met = narrowed(rows, F.col("bucket"), shared.select("bucket"))
    crowded = cut(shared.where(F.col("c") > HOT).select("bucket"))
    if crowded.isEmpty():
        return _forest(met)
    crowded = _near(crowded)
    out = _forest(met.join(crowded, "bucket", "left_anti"))
    near = F.col("near") if "near" in rows.columns else F.lit(False)
    hot = cut(met.join(crowded, "bucket", "left_semi").select("no", "bucket", near.alias("near")))
    if depth == 3:
        first = hot.groupBy("bucket").agg(F.min("no").alias("b"))
        return out.unionByName(hot.join(first, "bucket").where("no <> b").select(F.col("no").alias("a"), "b").distinct())
    linked, rest = _against_hubs(hot, sigs)
    out, rest = out.unionByName(linked), cut(rest)
    if rest.isEmpty():
        return out
    rest = rest.join(sigs, "no")
    return out.unionByName(candidates(_under(rest, DEEP_ERRORS, F.col("bucket")) if depth == 1 else rest, sigs, depth + 1))


def confirmed(nodes: list, groups: list, sets: list) -> list:
    """Pairs of similar nodes that join all that similar pairs join, where nodes of one group (if any) are joined already.

    Nodes outside the largest group are compared with all others, by counts of common shingles, until none is left; so
    every pair of two groups is compared from one side at least.
    """
    import numpy as np

    top, named = list(range(len(nodes))), {}
    for i, g in enumerate(groups):
        if g is not None:
            top[i] = named.setdefault(g, i)
    size = np.bincount(top, minlength=len(nodes))

    def root(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    if size.max() == len(nodes):
        return []
    n = np.array([len(s) for s in sets])
    kind, c = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(sets)), n)
    kept = c[kind] > 1
    kind, owner = kind[kept], owner[kept]
    edges = np.searchsorted(owner, np.arange(len(sets) + 1))
    order = np.argsort(kind, kind="stable")
    holder, starts = owner[order], np.searchsorted(kind[order], np.arange(len(c) + 1))
    least, whole = SIMILARITY
    out, done = [], np.zeros(len(nodes), dtype=bool)
    while True:
        largest = int(size.argmax())
        left = [i for i in np.flatnonzero(~done).tolist() if root(i) != largest]
        if not left:
            return out
        for i in left:
            done[i] = True
            if root(i) == int(size.argmax()):
                done[i] = False  # joined since; asked again if its group does not stay the largest
                continue
            common = np.zeros(len(nodes), dtype=np.int64)
            for k in kind[edges[i]:edges[i + 1]].tolist():
                common[holder[starts[k]:starts[k + 1]]] += 1
            for j in np.flatnonzero((whole + least) * common >= least * (n + n[i])).tolist():
                x, y = root(i), root(j)
                if x != y:
                    top[max(x, y)] = min(x, y)
                    size[min(x, y)] += size[max(x, y)]
                    size[max(x, y)] = 0
                    out.append((nodes[i], nodes[j]))


def _meet(rows: DataFrame) -> DataFrame:
    """(meeting, no, part, set) -> (a, b), the confirmed links of each meeting; part names what is joined already."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def found(rows):
            pairs = confirmed(*zip(*rows)) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*pairs)) or [()] * 2], names=["a", "b"])

        meeting, rows = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                for here, node, part, s in zip(*[b.column(c).to_pylist() for c in ("meeting", "no", "part", "set")]):
                    if here != meeting:
                        yield found(rows)
                        meeting, rows = here, []
                    if not rows or rows[-1][0] != node:
                        rows.append((node, part, np.frombuffer(s, dtype="<i8")))
        yield found(rows)

    slim = rows.select("meeting", "no", "part", "set").repartition("meeting").sortWithinPartitions("meeting", "no")
    return map_batches(slim, run, "a long, b long")


def _sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(no, root, blocks, set) of the members' texts; a node's text is that of its first row."""
    slim = renamed(docs, id=id_col, text=text_col).select("id", text_of(F.col("text")).alias("text")).withColumn("body", F.xxhash64("text"))
    wanted = members.select("no", "node", "root", "blocks", F.col("rep.id").alias("rep_id"), F.col("rep.body").alias("rep_body"))
    held = narrowed(slim, F.col("body"), wanted.select("rep_body")).join(
        wanted, (F.col("body") == F.col("rep_body")) & F.col("id").eqNullSafe(F.col("rep_id")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column("text")]
            own = pa.array([node_key(s) == k for s, k in zip(found, batch.column("node").to_pylist())], pa.bool_())
            sets = pa.array([s.tobytes() for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.select(["no", "root", "blocks"]).columns, sets], names=["no", "root", "blocks", "set"]).filter(own)

    return map_batches(held.select("no", "node", "root", "blocks", "text"), run, "no long, root long, blocks long, set binary")


def links(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(no, node, n, rep, sig) -> (a, b), similar pairs that join all that similar pairs under the radius join."""
    sigs = nodes.select("no", "sig")
    families = components(candidates(_under(nodes, ERRORS, F.lit(0).cast("long")), sigs)).withColumnRenamed("node", "no")
    members = cut(families.join(nodes.select("no", "node", "n", "rep"), "no"))
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).alias("blocks"))
    sets = cut(_sets(docs, members.join(blocks, "root"), id_col, text_col))
    none = F.lit(None).cast("long").alias("part")
    out = _meet(sets.where("blocks = 1").select(F.xxhash64("root").alias("meeting"), "no", none, "set"))
    large = sets.where("blocks > 1").dropDuplicates(["no"]).withColumn("n", F.octet_length("set") / 8)
    if large.isEmpty():
        return out
    found, parts = None, None
    for r in range(ROUNDS):
        block = F.pmod(F.xxhash64(F.lit(r), "no"), "blocks")
        parted = large.withColumn("part", F.col("no")) if parts is None else large.join(parts, "no", "left").withColumn("part", F.coalesce("part", "no"))
        here = _meet(parted.select(F.xxhash64("root", F.lit(r), block).alias("meeting"), "no", "part", "set"))
        found = cut(here if found is None else found.unionByName(here))
        parts = components(found).select(F.col("node").alias("no"), F.col("root").alias("part"))
    slim = cut(large.select("no", "root", "blocks", "n").join(parts, "no", "left").withColumn("part", F.coalesce("part", "no")))
    main = slim.groupBy("root", "part").agg(F.sum("n").alias("n")).groupBy("root").agg(F.max_by("part", "n").alias("main"))
    slim = slim.join(main, "root").withColumn("mine", F.pmod(F.xxhash64("no"), "blocks"))
    apart = slim.where("part <> main")
    asking = apart.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).alias("askers"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = F.pmod(F.xxhash64(F.lit("apart"), "no"), "askers").alias("i")
    asked = apart.join(asking, "root").select("root", "no", "part", own, every("blocks").alias("j"))
    told = slim.join(asking, "root").select("root", "no", "part", F.col("mine").alias("j"), every("askers").alias("i"))
    last = asked.unionByName(told).select(F.xxhash64("root", F.lit("apart"), "i", "j").alias("meeting"), "no", "part")
    return out.unionByName(found).unionByName(_meet(last.join(large.select("no", "set"), "no")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component) for every row; component is the smallest id of the group.

    Null texts and texts without words have no shingles and are groups of their own. A text of fewer than five words is
    one shingle. Very long texts are taken whole. Rows with equal sets, repeated rows among them, are one node. Null ids
    are members like any other but never the smallest; a group of null ids alone has a null component. Columns other than
    the two named may have any names. Of no rows, no rows come.
    """
    rows = cut(prints(docs, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "body")).alias("rep")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(first, F.max("n").alias("n"), F.max("sig").alias("sig"))
    nodes = cut(nodes.withColumn("no", F.monotonically_increasing_id()))  # a number of 8 bytes, and no two alike
    roots = components(links(docs, nodes, id_col, text_col)).withColumnRenamed("node", "no")
    rooted = nodes.select("node", "no", F.col("rep.id").alias("least")).join(roots, "no", "left").select("node", "least", F.coalesce("root", "no").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    told = rows.where("node IS NOT NULL").select("id", "n", "node").join(named, "node").select("id", F.col("n").alias("n_shingles"), "component")
    return told.unionByName(rows.where("node IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component")))


def digest(docs: DataFrame) -> DataFrame:
    found = groups(docs)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


SQL = r"""
WITH RECURSIVE
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM docs),
sets AS (SELECT list_sort(s) AS s, min(doc_id) AS node FROM runs WHERE len(s) > 0 GROUP BY ALL),
held AS (SELECT node, len(s) AS n, unnest(s) AS h FROM sets),
common AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM held a JOIN held b ON a.h = b.h AND a.node <> b.node GROUP BY a.node, b.node),
edges AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (n + m - c)),
reach AS (SELECT DISTINCT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT r.doc_id, len(r.s) AS n_shingles, CASE WHEN len(r.s) = 0 THEN r.doc_id ELSE coalesce(t.root, s.node) END AS component_id,
  r.doc_id = (CASE WHEN len(r.s) = 0 THEN r.doc_id ELSE coalesce(t.root, s.node) END) AS kept
FROM runs r LEFT JOIN sets s ON list_sort(r.s) = s.s LEFT JOIN roots t ON t.node = s.node
"""
