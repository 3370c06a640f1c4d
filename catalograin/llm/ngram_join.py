"""N-gram Jaccard join: a prefix-tree join over globally ordered shingle sets.

Plan (every step is exact, none drops a possible link):

1. One pass turns each text into the set of its `width`-word shingles (64-bit hashes), keeps the set's size, a 128-bit
   fingerprint, and an extended prefix in hash order. Texts with equal sets form one class.
2. Two linked sets share at least l shingles of their extended prefixes (|A| - ceil(t|A|) + l shingles, l half of the plain
   prefix). Classes with fewer prefix shingles that any other class also has can have no link and leave. Whether a shingle
   has two owners is a minimum and a maximum, so frequent shingles combine before the shuffle.
3. The classes left send their whole sets once; shingles of one owner are counted, not kept. Of the rest, ordered from the
   rarest, only as many count as the plain prefix allows. Classes that meet there form candidate components; each link lies
   within one of them.
4. Each component is cut into blocks of at most `block_shingles`; a task takes two blocks (or one with itself), stores the
   sets in a trie ordered from the most frequent shingle, and walks it level by level for each set: overlaps are
   counted once per shared path, and subtrees go whose remaining lengths can't reach the bound. Sets already connected are
   not compared again, and a task returns a spanning forest, never all pairs.
5. Connected components over those forests give the classes; every row gets its class's smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import BATCH_BYTES, small, stored
from .wordbytes import blocks, give_back, mix, runs

#: What a row of a few longs takes in a broadcast.
ROW_BYTES = 80
BLOCK_SHINGLES = 2_000_000


def least_shared(n: int, percent: int) -> int:
    """Smallest overlap of a set of n elements with any linked set: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int) -> int:
    return n - least_shared(n, percent) + 1


def slack(n: int, percent: int) -> int:
    """Shared shingles demanded of extended prefixes; grows with n."""
    return max(1, prefix_size(n, percent) // 2)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Place in the batch and sorted distinct shingle hashes, of every text."""
    for block in blocks(texts):
        starts, stops, counts = block.words()
        shingles, before = runs(block.hashes(starts, stops, lower=True), counts, width)
        for k, row in enumerate(block.rows):
            yield row, np.unique(shingles[before[k] : before[k + 1]])


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; equal sets only have equal ones, but for chance."""
    return tuple(int(np.sum(mix(shingles ^ np.uint64(salt))).view(np.int64)) for salt in (0x5BF0A8B1, 0xC2B2AE3D27D4EB4F))


def _summaries(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, sizes, first, second, prefixes, needs = batch.column(0), batch.column(2), [], [], [], [], []
            for _, s in shingle_sets(batch.column(1), width):
                n = len(s)
                a, b = fingerprint(s)
                sizes.append(n)
                first.append(a)
                second.append(b)
                prefixes.append(s[: n - least_shared(n, percent) + slack(n, percent)].view(np.int64) if n else s.view(np.int64))
                needs.append(slack(least_shared(n, percent), percent) if n else 0)
            lengths = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, texts, pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(needs, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))],
                ["doc_id", "th", "n_shingles", "f1", "f2", "need", "prefix"],
            )
        give_back()

    return run


def _wanted_sets(width: int):
    """Rows (cls, n, h) of the batch's texts whose fingerprint is the one wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, classes = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for row, s in shingle_sets(batch.column(0), width):
                if len(s) and fingerprint(s) == (first[row], second[row]):
                    columns = np.full(len(s), classes[row], np.int64), np.full(len(s), len(s), np.int64), s.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["cls", "n", "h"])
        give_back()

    return run


def _batched(run, rows: int = 50_000):
    """`run`, its small batches joined."""

    def joined(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


class Forest:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


class Trie:
    """A prefix tree over sequences of token numbers; chains without a branch are one node with several tokens.

    Nodes are ordered by level: `level[k]` to `level[k + 1]` are those at depth k. Each has its parent, its tokens, the tokens
    on its path, the sets that end there, and the least and most remaining tokens of the sets below.
    """

    def __init__(self, sets: list[np.ndarray]):
        # as bytes, most significant first, tokens compare as their numbers do and take no object each
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        nodes: list[list] = []  # parent, first set, from, to, set ending here, depth
        levels = [[(-1, 0, len(order), 0)]]
        self.level = [0]
        while levels[-1]:
            below = []
            for parent, lo, hi, at in levels[-1]:
                k = lo
                while k < hi and len(sets[order[k]]) == at:
                    if parent >= 0:
                        nodes[parent][4].append(order[k])
                    k += 1
                while k < hi:
                    token = sets[order[k]][at]
                    end = k + 1
                    while end < hi and sets[order[end]][at] == token:
                        end += 1
                    a, b = sets[order[k]], sets[order[end - 1]]
                    m = min(len(a), len(b))
                    differ = np.flatnonzero(a[at:m] != b[at:m])
                    to = at + int(differ[0]) if len(differ) else m
                    nodes.append([parent, order[k], at, to, []])
                    below.append((len(nodes) - 1, k, end, to))
                    k = end
            self.level.append(len(nodes))
            levels.append(below)
        self.parent = np.array([x[0] for x in nodes], np.int64)
        self.depth = np.array([x[3] for x in nodes], np.int64)
        self.ends = [x[4] for x in nodes]
        self.edges = np.concatenate([sets[x[1]][x[2] : x[3]] for x in nodes]) if nodes else np.zeros(0, np.int64)
        self.begin = np.concatenate([[0], np.cumsum([x[3] - x[2] for x in nodes])]).astype(np.int64)
        self.longest = np.zeros(len(nodes), np.int64)
        self.shortest = np.full(len(nodes), 1 << 60, np.int64)
        for i in range(len(nodes) - 1, -1, -1):
            if self.ends[i]:
                self.longest[i] = max(self.longest[i], self.depth[i])
                self.shortest[i] = min(self.shortest[i], self.depth[i])
            if (p := self.parent[i]) >= 0:
                self.longest[p] = max(self.longest[p], self.longest[i])
                self.shortest[p] = min(self.shortest[p], self.shortest[i])


def trie_links(sets: list[np.ndarray], sizes: np.ndarray, percent: int, n_left: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (within all if `same`, else between the first n_left and the rest).

    sets: token numbers in the common order, without the tokens that no other set has; sizes: of the whole sets.
    """
    n_tokens = 1 + max((int(s.max()) for s in sets if len(s)), default=-1)
    stored_sets, offset = (sets, 0) if same else (sets[n_left:], n_left)
    trie = Trie(stored_sets)
    forest, links = Forest(len(sets)), []
    size_of = np.asarray(sizes, np.int64)
    below = [(int(trie.level[k]), int(trie.level[k + 1])) for k in range(len(trie.level) - 1)]
    has = np.zeros(n_tokens, bool)
    # the least and the largest whole set below each node
    low, high = np.full(len(trie.parent), 1 << 60, np.int64), np.zeros(len(trie.parent), np.int64)
    for i in range(len(trie.parent) - 1, -1, -1):
        for s in trie.ends[i]:
            low[i], high[i] = min(low[i], size_of[s + offset]), max(high[i], size_of[s + offset])
        if (p := trie.parent[i]) >= 0:
            low[p], high[p] = min(low[p], low[i]), max(high[p], high[i])
    ending = np.array([bool(x) for x in trie.ends], bool)
    probes = range(len(sets)) if same else range(n_left)
    for a in probes:
        mine, n = sets[a], int(size_of[a])
        if not len(mine):
            continue
        has[mine] = True
        alive = np.zeros(len(trie.parent) + 1, bool)
        alive[-1] = True  # the parent of the first level is -1
        overlap = np.zeros(len(trie.parent) + 1, np.int64)
        for lo, hi in below:
            nodes = lo + np.flatnonzero(alive[trie.parent[lo:hi]])
            if not len(nodes):
                break
            # tokens of these nodes, end to end
            lengths = trie.begin[nodes + 1] - trie.begin[nodes]
            ends = np.cumsum(lengths)
            tokens = trie.edges[np.repeat(trie.begin[nodes] - (ends - lengths), lengths) + np.arange(ends[-1])]
            counted = np.concatenate([[0], np.cumsum(has[tokens])])
            got = overlap[trie.parent[nodes]] + counted[ends] - counted[ends - lengths]
            overlap[nodes] = got
            # no set below can have more in common than this, and its union is at least the larger set
            most = np.minimum(got + trie.longest[nodes] - trie.depth[nodes], len(mine))
            keep = 100 * most >= percent * (n + low[nodes] - most)
            keep &= (100 * high[nodes] >= percent * n) & (percent * low[nodes] <= 100 * n)
            nodes = nodes[keep]
            alive[nodes] = True
            for i in nodes[ending[nodes]]:
                for s in trie.ends[i]:
                    b = s + offset
                    if a != b and 100 * overlap[i] >= percent * (n + size_of[b] - overlap[i]) and forest.root(a) != forest.root(b):
                        forest.join(a, b)
                        links.append((a, b))
        has[mine] = False
    return links


def _join_blocks(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = int(group.left.iloc[0]), int(group.right.iloc[0])
        group = group.sort_values(["block", "cls"], kind="stable")
        tokens = [np.asarray(x, np.int64) for x in group.tokens]
        _, places = np.unique(np.concatenate(tokens), return_inverse=True)
        flat = np.concatenate(tokens)
        ordered = [np.asarray(x, np.int64) for x in group.ranks]
        # tokens come as hashes with document counts; number them from the most frequent
        values, index = np.unique(flat, return_index=True)
        counts = np.concatenate(ordered)[index]
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, -counts))] = np.arange(len(values))
        numbers = rank[places]
        cuts = np.cumsum([len(x) for x in tokens])[:-1]
        sets = [np.sort(x) for x in np.split(numbers, cuts)]
        n_left = int((group.block == left).sum())
        classes = group.cls.to_numpy()
        n_tokens = len(flat)
        del tokens, ordered, flat, places, numbers, values, index, counts, rank
        links = trie_links(sets, group.n.to_numpy(), percent, n_left, left == right)
        if n_tokens > BLOCK_SHINGLES // 10:
            del sets
            give_back()
        return pd.DataFrame({"a": [classes[i] for i, _ in links], "b": [classes[j] for _, j in links]}, dtype="int64")

    return run


def ngram_join(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two rows link when 100 * |A & B| >= percent * |A | B| for their sets of `width`-word shingles; words are
    `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A text of fewer words is one shingle. Null and empty texts have none,
    link with nothing and are their own component. Repeated rows stay; rows of equal sets share a component. A null doc_id
    is kept, and counts in a component only if it has no other id. Other columns of any name are ignored. An empty
    table gives no rows. The id must be an integer.
    """
    return _joined(docs, width, percent, id_col, text_col, block_shingles).select("doc_id", "n_shingles", "component_id")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _joined(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, block_shingles: int) -> DataFrame:
    """The rows of `ngram_join` with th, the hash of a row's text, and root, its component's number (null without shingles)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _text_hash(text_col).alias("th"))
    schema = "doc_id long, th long, n_shingles long, f1 long, f2 long, need long, prefix array<long>"
    rows = stored(docs.mapInArrow(_summaries(width, percent), schema), "sets", BATCH_BYTES)

    # 1. classes of equal sets; f1 names a class (f2 guards the text lookup below)
    classes = rows.where("n_shingles > 0").groupBy("f1", "f2").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "th")).alias("at"), F.first("n_shingles").alias("n"), F.first("need").alias("need"), F.first("prefix").alias("prefix")
    )
    classes = stored(classes.withColumn("cls", F.xxhash64("f1", "f2")), "classes")

    # 2. classes with enough shared prefix shingles
    tokens = classes.select("cls", F.explode("prefix").alias("h"))
    # stored, here and below, so that the shuffle that counts is gone from the disk before the one that joins
    owned_twice = stored(tokens.groupBy("h").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("h"), "owned")
    shared = tokens.join(owned_twice, "h").groupBy("cls").agg(F.count("*").alias("shared"))
    left = stored(classes.join(shared, "cls").where("shared >= need").select("cls", "at", "f1", "f2", "n"), "left")

    # 3. their whole sets
    n_left = left.count()
    chosen = left.select(F.col("at.doc_id").alias("rep"), F.col("at.th").alias("rep_th"), "f1", "f2", "cls")
    texts = docs.join(small(chosen, ROW_BYTES * n_left), docs.doc_id.eqNullSafe(chosen.rep) & (docs.th == chosen.rep_th))
    sets = stored(texts.select("text", "f1", "f2", "cls").mapInArrow(_batched(_wanted_sets(width)), "cls long, n long, h long"), "tokens", BATCH_BYTES)
    frequent = stored(sets.groupBy("h").agg(F.count("*").alias("df"), F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("h", "df"), "frequent")
    weighed = sets.join(frequent, "h").groupBy("cls", "n").agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("t"))
    need = F.ceil(F.col("n") * percent / F.lit(100)).cast("int")
    weighed = weighed.withColumn("need", need).where(F.size("t") >= F.col("need"))
    weighed = stored(weighed.select("cls", "n", F.col("t.h").alias("tokens"), F.col("t.df").alias("ranks"), (F.size("t") - F.col("need") + 1).cast("int").alias("p")), "weighed")

    # candidate components: classes that meet at a prefix shingle (the p rarest of the shared ones)
    meet = weighed.select("cls", F.explode(F.slice("tokens", F.lit(1), F.col("p"))).alias("h"))
    hubs = meet.groupBy("h").agg(F.min("cls").alias("hub"), F.max("cls").alias("other")).where("hub <> other").select("h", "hub")
    candidates = components(meet.join(hubs, "h").select(F.col("cls").alias("a"), F.col("hub").alias("b")))

    # 4. blocks of a component, and pairs of blocks
    placed = weighed.join(candidates, weighed.cls == candidates.node).select("cls", "n", "tokens", "ranks", "root")
    weights = placed.groupBy("root").agg(F.ceil(F.sum(F.size("tokens")) / F.lit(block_shingles)).cast("int").alias("n_blocks"))
    placed = placed.join(weights, "root").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    placed = placed.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    links = placed.groupBy("root", "left", "right").applyInPandas(_join_blocks(percent), "a long, b long")
    links = stored(links, "links")

    # 5. components of the links, then the smallest doc_id of each
    found = components(links)
    ids = classes.join(found, classes.cls == found.node, "left").select("f1", "f2", "rep", F.coalesce("root", "cls").alias("root"))
    smallest = ids.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = ids.join(smallest, "root").select("f1", "f2", "root", "component_id")
    # texts without shingles are linked with nothing, so they need no join, in which they all would have one key
    linked = rows.where("n_shingles > 0").select("doc_id", "th", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    alone = rows.where("n_shingles = 0").select("doc_id", "th", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "th", "n_shingles", "root", "component_id").unionByName(alone)


def keep_one(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """`docs` with one row of each component: one with the smallest id (null last). Rows that repeat an id are told apart by text;
    of rows equal in id and text, one stays. Rows without shingles are linked with nothing, and stay."""
    found = stored(_joined(docs, width, percent, id_col, text_col, block_shingles), "joined")
    texts = found.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "n"))
    linked = texts.where("root IS NOT NULL").groupBy("root").agg(first.alias("first")).select("first.doc_id", "first.th", "first.n")
    stay = stored(linked.unionByName(texts.where("root IS NULL").select("doc_id", "th", "n")), "stay")
    n, most = stay.agg(F.count("*"), F.max("n")).first()
    ids = stay.select(F.col("doc_id").alias("kept id"), F.col("th").alias("kept text"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("kept id")) & (_text_hash(text_col) == F.col("kept text"))
    kept = docs.join(small(ids, ROW_BYTES * n), same, "left_semi")
    return kept.dropDuplicates([id_col, text_col]) if most and most > 1 else kept


#: The rows of `ngram_join` with its default parameters in DuckDB's SQL.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS (SELECT * FROM s WHERE sh IN (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
