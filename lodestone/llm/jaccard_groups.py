"""N-gram Jaccard join by a token-group matrix.

A document's tokens are its distinct word shingles, as 64-bit hashes; equal sets
are one node. Nodes are partitioned into groups of similar documents: nodes that
share rare tokens are brought to the leader of those tokens, and what links to a
leader joins its class; a class is cut into groups of bounded size. The matrix is
a stored table with a row for each group, the union of its members' tokens.

A query node is brought to the groups of other classes with which it shares
enough of the tokens that come first in a common order, at places that leave room
for enough others. There its tokens are held against the group's row: only where
they share what a link with any member would ask for is the group opened, and
its members' sets are compared exactly. A group of one member has its row for its
set, so the row alone decides. Links and classes are united in components.

The common order puts frequent tokens last. How frequent a token is only orders
the tokens, so the table of the most frequent ones can be bounded without any
effect on the result: every link of two different sets is found, or joins
two nodes that are in one class already. (Sets are told apart by 128-bit digests,
tokens by 64-bit hashes: two different shingles with one hash count as the same.)

Defined results: without words or text a set is empty and linked with nothing;
with fewer words than a shingle has, the whole sequence is the one token; repeated
rows have equal sets and link; a row without doc_id gets the component of its
class (null if no row there has a doc_id); an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at_work, scratch, slices, staged, tuned
from .components import component_labels

#: Tokens that a linked pair's first tokens share at least (fewer for very small sets).
HITS = 3
#: Entries of the table of frequent tokens (8 bytes each, sent to every worker), and the documents of a batch in which a token stands before it is counted.
FREQUENT, LOCAL_COUNT = 262_144, 2
#: Members of a group, queries that one task brings to a group, leaders that a node is compared with in a round, rounds.
GROUP_SIZE, TASK_QUERIES, LEADERS, ROUNDS = 64, 128, 2, 3
#: Rows (some 40 bytes each) that are sent to every task to pick texts, instead of shuffling the texts.
BROADCAST_ROWS = 500_000
#: Bytes of texts that are taken up together.
SLICE_BYTES = 4 << 20
#: With more pairs of a node and a group left than this for each node, another round of leaders comes first.
PAIRS_PER_NODE = 2


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the array's strings, eight bytes at a time over all of them."""
    _, offsets, data = words.buffers()
    if not len(words):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    start, length = offsets[:-1], np.diff(offsets)
    raw = np.concatenate([np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    start = start - offsets[0]
    out = _stir(length.astype(np.uint64))
    todo = np.flatnonzero(length)
    while len(todo):
        left = length[todo]
        out[todo] = _stir(out[todo] ^ eight[start[todo]] & masks[np.minimum(left, 8)])
        todo = todo[left > 8]
        start[todo] += 8
        length[todo] -= 8
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct tokens of each text: lower-cased A-Z, words between white space of one byte."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = cut.flatten()
    offsets = cut.offsets.to_numpy()
    bounds = offsets - offsets[0]
    filled = pc.binary_length(flat).to_numpy() > 0
    if not filled.all():  # white space at a text's ends
        bounds = np.r_[0, np.cumsum(filled)][bounds]
        flat = flat.filter(pa.array(filled))
    h = word_hashes(flat)
    with np.errstate(over="ignore"):
        x = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            x = _stir(x + h[k : k + len(x)])
        out = []
        bounds = bounds.tolist()
        for first, last in zip(bounds, bounds[1:], strict=False):
            n = last - first
            if n >= words:
                out.append(_distinct(x[first : last - words + 1]))
            else:  # the whole sequence as one token, or none
                y = np.full(min(n, 1), n, np.uint64)
                for k in range(n):
                    y = _stir(y + h[first + k : first + k + 1])
                out.append(y)
    return out


def least_overlap(n, percent: int):
    """What a set of n tokens shares at least with any set it links with."""
    return (n * percent + 99) // 100


def first_tokens(n, percent: int):
    """(hits, length): sets that link share so many of their first tokens, in the common order."""
    overlap = least_overlap(n, percent)
    hits = min(HITS, overlap)
    return hits, n - overlap + hits


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    data = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)


def text_hash(text: Column) -> Column:
    """With an id, what a text is found again by; rows with one id can be very many."""
    return F.xxhash64(text)


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """Rows of two kinds: 0, a document's set size and digest, and its text's hash; 1, a token that several sets of a batch have, with their number."""

    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("jaccard")
        names = ["kind", "doc_id", "n", "a", "b", "t"]
        for batch in slices(batches, SLICE_BYTES, 1):
            sets = shingle_sets(batch.column(1), words)
            digests = [set_digest(s) for s in sets]
            columns = [np.zeros(len(sets), np.int32), batch.column(0), np.array([len(s) for s in sets], np.int32), np.array([d[0] for d in digests], np.int64), np.array([d[1] for d in digests], np.int64), batch.column(2)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
            distinct = [*dict(zip(digests, sets, strict=True)).values()]
            tokens = np.sort(np.concatenate(distinct)) if distinct else np.empty(0, np.uint64)
            starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, np.int64)
            counts = np.diff(np.r_[starts, len(tokens)])
            often = counts >= LOCAL_COUNT
            token, count = tokens[starts[often]].view(np.int64), counts[often]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), np.int32)), pa.nulls(len(token), batch.schema.field(0).type), pa.array(np.zeros(len(token), np.int32)), pa.array(token), pa.array(count.astype(np.int64)), pa.nulls(len(token), pa.int64())], names)

    return docs.withColumn("t", text_hash(F.col("text"))).mapInArrow(profile, f"kind int, doc_id {docs.schema[0].dataType.simpleString()}, n int, a long, b long, t long")


def _frequent(profiles: DataFrame) -> np.ndarray:
    """The most frequent tokens, the most frequent last; at most FREQUENT of them."""
    counts = profiles.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).orderBy(F.desc("n"), "a").limit(FREQUENT)
    return np.concatenate([np.empty(0, np.int64), *(c.to_numpy() for c in counts.select("a").toArrow().column(0).chunks)])[::-1].copy().view(np.uint64)


def _first_token_rows(docs: DataFrame, words: int, percent: int, frequent: np.ndarray, clashes: set[int]) -> tuple[DataFrame, Broadcast]:
    """(token, node, place): the first tokens of each set; place holds the set's size and the token's number. And what is sent to the workers for that.

    Copies inside one partition give their rows once.
    """
    ranked = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[ranked], ranked, clashes))

    def first(tokens: np.ndarray, length: int) -> np.ndarray:
        """The tokens by their hash, then the frequent ones by their number."""
        known, ranked, _ = sent.value
        if not len(known):
            return tokens[:length]
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        often = known[at] == tokens
        out = tokens[~often][:length]
        if len(out) < length:
            more = np.sort(ranked[at[often]])[: length - len(out)]
            out = np.r_[out, frequent[more]]
        return out

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clashes = sent.value[2]
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, SLICE_BYTES, 1):
            nodes, sizes, tokens = [], [], []
            for s in shingle_sets(batch.column(1), words):
                if len(s) and (d := set_digest(s)) not in seen:
                    seen.add(d)
                    nodes.append(d[1] if d[0] in clashes else d[0])
                    sizes.append(len(s))
                    tokens.append(first(s, first_tokens(len(s), percent)[1]))
            if not tokens:
                continue
            lengths = np.array([len(t) for t in tokens])
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            place |= np.repeat(np.array(sizes, np.int64) << 32, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), lengths)), pa.array(place)], ["token", "node", "place"])

    return docs.mapInArrow(rows, "token long, node long, place long"), sent


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (token, node, place) of tokens that several nodes have, each once.

    One shuffle by token; sorted runs are read as a stream, and of a run no more
    than its first and its last row are held.
    """

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list | None = None  # token, node, place of the open run's first row; whether it was given out; the last node
        for batch in batches:
            if not batch.num_rows:
                continue
            t, n, v = (c.to_numpy() for c in batch.columns)
            again = head is not None and t[0] == head[0]
            new = np.r_[not again, t[1:] != t[:-1]]
            same = np.r_[again and n[0] == head[4], (t[1:] == t[:-1]) & (n[1:] == n[:-1])]
            more = ~new & ~same
            run = np.cumsum(new)
            shared = np.bincount(run[more], minlength=run[-1] + 1) > 0
            starts = np.flatnonzero(new)
            out = more.copy()
            out[starts[shared[1:]]] = True
            token, node, place = t[out], n[out], v[out]
            if shared[0] and not head[3]:
                token, node, place = np.r_[head[0], token], np.r_[head[1], node], np.r_[head[2], place]
                head[3] = True
            if run[-1]:
                k = starts[-1]
                head = [t[k], n[k], v[k], bool(shared[-1]), n[-1]]
            else:
                head[4] = n[-1]
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array(place)], ["token", "node", "place"])

    return rows.repartition("token").sortWithinPartitions("token", "node").mapInArrow(runs, "token long, node long, place long")


def _with_leader(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """(node, leader): for each node the first nodes of its tokens, in an order of this round, that it shares most with; only where class and size allow a new link.

    In the first round that is the node in which the token comes earliest: of
    near copies the one with the fewest tokens of its own, which most others are
    like. Later rounds draw another one. A token's first node is pre-aggregated and
    stored, so that rows of a token that very many nodes have can be split.
    """
    order = F.struct(*([F.xxhash64("node", F.lit(turn)).alias("o")] if turn else [F.expr("place & 4294967295").alias("o")]), F.xxhash64("node").alias("h"), "node", "place", "class")
    first = staged(rows.groupBy("token").agg(F.min(order).alias("f")).select("token", F.col("f.node").alias("leader"), F.col("f.place").alias("l_place"), F.col("f.class").alias("l_class")), "jaccard-leaders")
    size, l_size = F.shiftright("place", 32), F.shiftright("l_place", 32)
    rest = lambda c: F.shiftright(c, 32) - F.expr(f"{c} & 4294967295")
    small, large = F.least(size, l_size), F.greatest(size, l_size)
    most = F.least(rest("place"), rest("l_place")) + (HITS - 1)
    fits = (F.col("class") != F.col("l_class")) & (small * 100 >= large * percent) & (most * (100 + percent) >= (small + large) * percent)
    needed = F.least(F.lit(HITS), F.floor((small * percent + 99) / 100))
    pairs = rows.join(first, "token").filter(fits).groupBy("node", "leader").agg(F.count("*").alias("hits"), F.min(needed).alias("needed")).filter("hits >= needed")
    best = Window.partitionBy("node").orderBy(F.desc("hits"), "leader")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= LEADERS).select("node", "leader")


def token_sets(nodes: DataFrame, docs: DataFrame, owners: DataFrame, words: int) -> DataFrame:
    """(node, tokens), staged: the sorted tokens of the nodes (node); of rows with one id and text one a task is cut. owners: (node, owner, t), the id and hash of a text that the node has."""
    placed = staged(nodes.join(owners, "node"), "jaccard-placed")
    if placed.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)  # else both sides are shuffled
    found = docs.withColumn("_t", text_hash(F.col("text")))
    texts = found.join(placed, (F.col("_t") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("owner"))).select("node", "text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("jaccard")
        seen: set[int] = set()
        for batch in slices(batches, SLICE_BYTES, 1):
            nodes = batch.column(0).to_pylist()
            todo = [k for k, node in enumerate(nodes) if node not in seen]
            own, sets = [], []
            while todo:  # a row of each node; of two texts with one hash and id the digest tells the right one
                first = {nodes[k]: k for k in reversed(todo)}
                for (node, k), s in zip(first.items(), shingle_sets(batch.column(1).take(pa.array(list(first.values()), pa.int64())), words), strict=True):
                    if node in set_digest(s):
                        seen.add(node)
                        own.append(k)
                        sets.append(s)
                tried = set(first.values())
                todo = [k for k in todo if nodes[k] not in seen and k not in tried]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), _lists(sets)], ["node", "tokens"])

    return staged(texts.mapInArrow(cut, "node long, tokens array<long>"), "jaccard-sets")


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))


def _arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, offsets = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy().tolist()
    return (values[x:y] for x, y in zip(offsets, offsets[1:], strict=False))


def token_matrix(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(group, members, node, tokens), staged: the union of the tokens of each group's members (group, node), their number, and the only member of a group of one.

    A group has a bounded number of members; the members of one stand together.
    """
    rows = members.join(sets, "node").select("group", "node", "tokens").repartition("group").sortWithinPartitions("group", "node")

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("jaccard")
        group, nodes, parts = None, [], []
        for batch in batches:
            done: list[tuple] = []
            for g, node, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), strict=True):
                if g != group:
                    if nodes:
                        done.append((group, nodes, _distinct(np.concatenate(parts))))
                    group, nodes, parts = g, [], []
                if node not in nodes[-1:]:
                    nodes.append(node)
                    parts.append(own.copy())
            yield _matrix_rows(done)
        if nodes:
            yield _matrix_rows([(group, nodes, _distinct(np.concatenate(parts)))])

    return staged(rows.mapInArrow(unite, "group long, members int, node long, tokens array<long>"), "jaccard-matrix")


def _matrix_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int32()), pa.array([r[1][0] for r in rows], pa.int64()), _lists([r[2] for r in rows])]
    return pa.RecordBatch.from_arrays(columns, ["group", "members", "node", "tokens"])


def _dealt(held: DataFrame, queries: DataFrame, sets: DataFrame) -> DataFrame:
    """(group, task, role, node, members, tokens), sorted: what a group holds (role 0), then the queries (group, node) that a task brings to it; a group's queries are dealt to several tasks if they are many."""
    dealt = staged(queries.groupBy("group").agg(F.ceil(F.count("*") / TASK_QUERIES).alias("tasks")), "jaccard-tasks")
    left = held.join(dealt, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("role"), "node", "members", "tokens")
    right = queries.join(dealt, "group").join(sets, "node").select("group", F.pmod(F.xxhash64("node"), "tasks").alias("task"), F.lit(1).alias("role"), "node", F.lit(0).alias("members"), "tokens")
    return left.unionByName(right).repartition("group", "task").sortWithinPartitions("group", "task", "role", "node")


def bounded(queries: DataFrame, matrix: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, group, other), staged: the queries (group, node) that share enough tokens with a group's row; other: the member of a group of one with which the query links (null: a group to open)."""

    def hold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("jaccard")
        now, row, members, only = None, None, 0, None
        for batch in batches:
            found: list[tuple] = []
            groups, tasks, roles, nodes, many = (batch.column(i).to_pylist() for i in range(5))
            for g, k, role, node, m, own in zip(groups, tasks, roles, nodes, many, _arrays(batch.column(5)), strict=True):
                if role == 0:
                    now, row, members, only = (g, k), own.copy(), m, node
                elif (g, k) == now and node != only:
                    at = np.minimum(np.searchsorted(row, own), len(row) - 1)
                    shared = int(np.count_nonzero(row[at] == own)) if len(row) else 0
                    if members == 1:
                        if shared * 100 >= percent * (len(row) + len(own) - shared):
                            found.append((node, g, only))
                    elif shared >= least_overlap(len(own), percent):
                        found.append((node, g, None))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["node", "group", "other"])

    rows = matrix.select("group", F.when(F.col("members") == 1, F.col("node")).alias("node"), "members", "tokens")
    return staged(_dealt(rows, queries, sets).mapInArrow(hold, "node long, group long, other long"), "jaccard-bounded")


def opened(queries: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): for each query (group, node) and group that it opens a member with which it links, if there is one."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("jaccard")
        now, nodes, sets = None, [], []
        tokens = owners = sizes = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            groups, tasks, roles, own = (batch.column(i).to_pylist() for i in range(4))
            for g, k, role, node, q in zip(groups, tasks, roles, own, _arrays(batch.column(5)), strict=True):
                if role == 0:
                    if (g, k) != now:
                        now, nodes, sets, tokens = (g, k), [], [], None
                    if node not in nodes[-1:]:
                        nodes.append(node)
                        sets.append(q.copy())
                    continue
                if (g, k) != now:
                    continue
                if tokens is None:
                    tokens = np.concatenate(sets)
                    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                    order = np.argsort(tokens, kind="stable")
                    tokens, owners = tokens[order], owners[order]
                    sizes = np.array([len(s) for s in sets])
                low, high = np.searchsorted(tokens, q, "left"), np.searchsorted(tokens, q, "right")
                low, count = low[high > low], (high - low)[high > low]
                at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                shared = np.bincount(owners[at], minlength=len(sets))
                linked = [m for m in np.flatnonzero(shared * 100 >= percent * (sizes + len(q) - shared)).tolist() if nodes[m] != node]
                if linked:
                    found.append((node, nodes[linked[0]]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    held = members.join(queries.select("group").distinct(), "group", "left_semi").join(sets, "node").select("group", "node", F.lit(0).alias("members"), "tokens")
    return _dealt(held, queries, sets).mapInArrow(compare, "u long, v long")


def open_groups(members: DataFrame, queries: DataFrame, docs: DataFrame, owners: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v), staged: links of query nodes with members of the groups that they are brought to, one for each query and group at most. members: (group, node); queries: (group, node); docs: (doc_id, text)."""
    with scratch(docs.sparkSession):
        sets = token_sets(members.select("node").union(queries.select("node")).distinct(), docs, owners, words)
        fit = bounded(queries, token_matrix(members, sets), sets, percent)
        links = fit.filter("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v"))
        return staged(links.unionByName(opened(fit.filter("other IS NULL").select("group", "node"), members, sets, percent)), "jaccard-links", outside=True)


def _united(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class) with the classes united that links (u, v) join; only links that are new go into it."""
    other = classes.select(F.col("node").alias("v"), F.col("class").alias("c"))
    between = links.join(classes.withColumnRenamed("node", "u"), "u").join(other, "v").select(F.col("class").alias("u"), F.col("c").alias("v"))
    labels = component_labels(between, "jaccard-components").withColumnRenamed("node", "class")
    return staged(classes.join(labels, "class", "left").select("node", F.coalesce("label", "class").alias("class")), "jaccard-classes")


def _remaining(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """(members, queries, their number): the groups of other classes that nodes must still be brought to.

    rows: (token, node, place, class) of the shared first tokens. The nodes of the
    smaller class (by the number of its nodes here) are the queries, the larger
    class gives the groups.
    """
    nodes = rows.groupBy("node", "class").agg(F.first(F.shiftright("place", 32)).alias("n"))
    nodes = staged(nodes, "jaccard-sized")
    sizes = staged(nodes.groupBy("class").agg(F.count("*").alias("many")), "jaccard-classes")  # stored, so that the join can split a large class
    nodes = nodes.join(sizes, "class")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / GROUP_SIZE))
    nodes = nodes.select("node", "class", "n", "many", F.xxhash64("class", part).alias("group"))
    mixed = rows.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high").select("token")
    full = staged(rows.join(mixed, "token").select("token", "node", F.expr("place & 4294967295").alias("at")).join(nodes, "node"), "jaccard-mixed")
    hits = F.least(F.lit(HITS), F.expr(f"(n * {percent} + 99) div 100"))
    # what a set can still share from its first shared token on, against what a link asks for: the parts of that comparison that are each side's own
    room = (F.col("n") - F.col("at")) * (100 + percent)
    side = full.groupBy("token", "group", "class", "many").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min(hits).alias("least_hits"), F.max(room - F.col("n") * percent).alias("g_room"))
    side = side.select("token", "group", F.col("class").alias("g_class"), F.col("many").alias("g_many"), "least_n", "most_n", "least_hits", "g_room")
    query = full.select("token", "node", "class", "many", "n", room.alias("room"))
    smaller = (F.col("many") < F.col("g_many")) | ((F.col("many") == F.col("g_many")) & (F.col("class") < F.col("g_class")))
    alike = (F.col("least_n") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("most_n") * 100)
    enough = (F.col("room") >= (F.col("n") + F.col("least_n")) * percent) & (F.col("g_room") >= F.col("n") * percent)
    pairs = staged(query.join(side, "token").filter(smaller & alike & enough).select("group", "node").distinct(), "jaccard-pairs")
    # of what is left, those that share enough first tokens: looked up for each pair, by equality
    listed = pairs.join(full.select("node", "token", hits.alias("hits")), "node")
    shared = listed.join(side.select("token", "group", "least_hits"), ["token", "group"])
    counts = shared.groupBy("group", "node").agg(F.count("*").alias("shared"), F.min(F.least("hits", "least_hits")).alias("needed")).filter("shared >= needed")
    queries = staged(counts.select("group", "node"), "jaccard-queries")
    members = nodes.select("group", "node").join(queries.select("group").distinct(), "group")
    return members, queries, queries.count()


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) of every row: component_id is the least id reachable by links."""
    source = tuned(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(source.sparkSession):  # its tables go when the result is written
        return staged(_components(source, words, percent).withColumnRenamed("doc_id", id_col), "jaccard-result", outside=True)


def _components(source: DataFrame, words: int, percent: int) -> DataFrame:
    """similar_components of (doc_id, text)."""
    profiles = staged(_profiles(source, words), "jaccard-profiles")
    sets = profiles.filter("kind = 0")
    filled = sets.filter("n > 0")
    # a 64-bit number stands for a set; of two sets with one number, both take the digest's other half
    clashes = {r.a for r in filled.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).filter("low != high").select("a").collect()}
    node = F.when(F.col("a").isin(*clashes), F.col("b")).otherwise(F.col("a")) if clashes else F.col("a")
    filled = filled.withColumn("node", node)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "t")).alias("o")
    owners = staged(filled.groupBy("node").agg(least).select("node", F.col("o.doc_id").alias("owner"), "o.t"), "jaccard-owners")
    first, sent = _first_token_rows(source, words, percent, _frequent(profiles), clashes)
    rows = staged(_shared(first), "jaccard-first")
    sent.destroy()  # workers and executors keep it no longer
    nodes = staged(rows.select("node").distinct(), "jaccard-nodes")
    classes = nodes.select("node", F.col("node").alias("class"))
    for turn in range(ROUNDS):
        queries = staged(_with_leader(rows.join(classes, "node"), percent, turn).select(F.col("leader").alias("group"), "node"), "jaccard-queries")
        members = queries.select("group").distinct().select("group", F.col("group").alias("node"))
        classes = _united(classes, open_groups(members, queries, source, owners, words, percent))
        members, queries, pairs = _remaining(rows.join(classes, "node"), percent)
        if pairs <= PAIRS_PER_NODE * nodes.count():
            break
    classes = _united(classes, open_groups(members, queries, source, owners, words, percent))
    known = owners.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = staged(known.groupBy("class").agg(F.min("owner").alias("component_id")), "jaccard-least")
    of_node = known.join(least, "class").select("node", "component_id")
    out = sets.withColumn("node", node).join(of_node, "node", "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), alone.alias("component_id"))


def components_sql(words: int = 4, percent: int = 85) -> str:
    """similar_components of the table documents, in DuckDB's SQL: all pairs that share a token, and what they reach."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i : i + {words - 1}], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON e.x = r.m)
SELECT n.doc_id, n.n AS n_shingles, min(r.m) AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY 1, 2"""
