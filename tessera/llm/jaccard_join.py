"""N-gram Jaccard join over a token-group matrix.

A document is the set of its runs of `N` words (all its words, if there are fewer); sets with |A & B| / |A | B| >=
`THRESHOLD` are linked. Documents with equal sets are collapsed first, to one node with a 128-bit fingerprint. Then

1. n-grams are counted by sets, in hashed buckets of about `BUCKET_GRAMS`, and put in one order for all: rare ones first. Of a
   set of n, at least c = ceil(THRESHOLD n) must be shared with a partner, so the least n-gram that two similar sets share
   is among the first n - c + 1 of both (prefix filter): those are the set's tokens. N-grams of one set only can't be
   shared and come first, so a set with fewer than c others has no token and no partner, and goes;
2. sets with a token in common are partitioned into groups: a set goes with the fullest of its tokens; groups of more than
   `GROUP_GRAMS` n-grams are cut by a hash, so a group's memory is bounded, whatever the texts' length, while nothing is
   left out;
3. the token-group matrix holds each group's union of tokens, one row a (token, group) however many members
   have it. A set is sent as a query to the groups whose row meets its tokens (of two groups one asks the other);
4. where a group and its queries meet, the group's union of n-grams bounds the overlap of a query with any member:
   |Q & union| >= THRESHOLD |Q| or the group stays closed. In open groups the overlap with each member is counted exactly.

So no pair at or above the threshold is left out and none below it gets in, but for equal 64-bit hashes of different words.
N-grams travel packed: once to be counted, those that several sets have once more to the sets' tokens. Texts of sets with
a possible partner are moved once, by id, and their n-grams only to groups that may open. A passage that many documents
share doesn't make them candidates, unless it is most of what a document shares with any.

Every link between different texts is counted, but none is written out as a pair: a group returns a sum of links a set and
a spanning forest of the links it saw, at most an edge a member and a query. So the result is as long as the corpus,
`near_duplicates`: one row a document with its class (connected component of links) and number of links.
`jaccard_join` lists all pairs, for tables where their number is wanted.

Defined cases: documents without a word, or null text, have no link and are a class of their own; in `near_duplicates`
a null doc_id takes no part, repeated rows (equal id, equal set) count and are reported once, and texts that share
a doc_id but not the set are documents of their own, with a row each; very long texts are whole sets; ties don't
arise, a class is called by its smallest id; an empty table gives an empty result; other columns are never read. In
`one_of_each_group` a null doc_id is the last choice of its group but takes part, of repeated rows one stays, rows
without a word stay all, and every column passes through, whatever it is called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.operators.graph import connected_components
from tessera.session import broadcast_if_small, materialize, release, small_batches

N = 3
THRESHOLD = 0.5
#: N-grams of a group's members together, about: 8 bytes each where they meet.
GROUP_GRAMS = 1 << 19
#: N-grams that are counted, or ordered for their sets, at a time, about; and those that a task holds before it sends them.
BUCKET_GRAMS = 1 << 19
SENT_GRAMS = 1 << 18

_SALT = np.random.default_rng(60).integers(0, 1 << 63, dtype=np.uint64)
_LOW, _HIGH = np.uint64(0xFFFFFFFF), np.uint64(32)


def gram_sets(texts: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    w = tk.words(texts)
    grams, at = tk.ngrams(w, n)
    cut = np.searchsorted(at, w.offsets)
    for d in range(len(w.offsets) - 1):
        if cut[d] < cut[d + 1]:
            yield np.unique(grams[cut[d] : cut[d + 1]])
        elif w.offsets[d] < w.offsets[d + 1]:
            yield tk.range_hashes(w.hash, w.offsets[d : d + 1], w.offsets[d + 1 : d + 2])
        else:
            yield grams[:0]


def fingerprint(grams: np.ndarray) -> bytes:
    """128 bits of a set."""
    a = np.add.reduce(tk.mix(grams), dtype=np.uint64)
    b = np.add.reduce(tk.mix(grams ^ _SALT), dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            rows, nodes, sizes, lows = [], [], [], []
            for i, g in enumerate(gram_sets(part.column("text"))):
                if len(g):
                    rows.append(i)
                    nodes.append(fingerprint(g))
                    sizes.append(len(g))
                    lows.append(len(np.unique(g.astype(np.uint32))))
            cols = [*(part.column(c).take(pa.array(rows, pa.int64())) for c in ("id", "row")), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(lows, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "row", "node", "size", "low"])


# A token is an n-gram's bucket and the lower half of its hash, a key the first half of a set's fingerprint. Packed rows
# hold the tokens of one part, sorted by key: each key once, with its number of tokens.
_PACKED = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
_SHARED = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("sets", pa.binary())])
_TOKENS = pa.schema([("node", pa.binary()), ("size", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _pack(part: np.ndarray, key: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """Part, keys, counts and values of rows sorted by part and key."""
    first = starts(part)
    cuts, runs = np.append(first, len(part)), starts(part, key)
    at = np.searchsorted(runs, cuts)
    counts = np.diff(np.append(runs, len(part))).astype(np.uint32)
    return [pa.array(part[first].astype(np.int64)), _blobs(key[runs], at), _blobs(counts, at), *(_blobs(v, cuts) for v in values)]


def _keys(keys: list[bytes], counts: list[bytes]) -> np.ndarray:
    return np.repeat(np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(counts), np.uint32))


def _scatter(buckets: int):  # noqa: ANN202
    """All n-grams by bucket."""

    def packed(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.concatenate(sets)
        bucket = ((grams >> _HIGH) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        key = np.repeat(np.array(keys, np.uint64), [len(g) for g in sets])
        return pa.RecordBatch.from_arrays(_pack(bucket[order], key[order], grams.astype(np.uint32)[order]), schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, held = [], [], 0
        for batch in batches:
            for part in tk.slices(batch, "text"):
                for g in gram_sets(part.column("text")):
                    if not len(g):
                        continue
                    keys.append(int.from_bytes(fingerprint(g)[:8], "big"))
                    sets.append(g)
                    held += len(g)
                    if held >= SENT_GRAMS:
                        yield packed(keys, sets)
                        keys, sets, held = [], [], 0
        if sets:
            yield packed(keys, sets)

    return run


def _shared(parts: int):  # noqa: ANN202
    """Tokens that several sets have, by part of the sets, with the number of sets (up to 65,535: it only orders)."""

    def of_bucket(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, counts, tokens = zip(*rows, strict=True)
        token = np.frombuffer(b"".join(tokens), np.uint32)
        order = np.argsort(token)
        again = token[order[1:]] == token[order[:-1]]
        held = np.zeros(len(token), bool)
        held[1:] |= again
        held[:-1] |= again
        order = order[held]
        if not len(order):
            return
        token, key = token[order], _keys(keys, counts)[order]
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        one = starts(token, key)  # a set may stand in many documents
        token, key = token[one], key[one]
        sets = np.diff(np.append(starts(token), len(token)))
        sets = np.repeat(sets, sets)
        token, key, sets = token[sets > 1], key[sets > 1], sets[sets > 1]
        if not len(token):
            return
        part = key % np.uint64(parts)
        order = np.lexsort((key, part))
        cols = _pack(part[order], key[order], token[order], np.minimum(sets[order], 65535).astype(np.uint16))
        yield pa.RecordBatch.from_arrays([cols[0], pa.array(np.full(len(cols[0]), bucket)), *cols[1:]], schema=_SHARED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if rows:
                        yield from of_bucket(now, rows)
                    now, rows = bucket, []
                rows.append(row)
        if rows:
            yield from of_bucket(now, rows)

    return run


def _prefix(threshold: float):  # noqa: ANN202
    """The tokens of each set of a part: rows with a size are the sets, the others their tokens by bucket."""

    def of_part(sets: list[tuple], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        buckets, keys, counts, tokens, times = zip(*rows, strict=True)
        key = _keys(keys, counts)
        token = np.frombuffer(b"".join(tokens), np.uint32).astype(np.int64)
        token |= np.repeat(np.array(buckets, np.int64) << 32, [len(t) // 4 for t in tokens])
        order = np.lexsort((token, np.frombuffer(b"".join(times), np.uint16), key))
        key, token = key[order], token[order]
        runs = starts(key)
        ends = np.append(runs[1:], len(key))
        known = key[runs]
        nodes, size, low = zip(*sets, strict=True)
        size, low = np.array(size, np.int64), np.array(low, np.int64)
        own = np.array([int.from_bytes(n[:8], "big") for n in nodes], np.uint64)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        # n-grams of a set may be one token, at most `size - low` times: as many tokens more
        most = (ends - runs)[at] - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1 + size - low
        most = np.where(known[at] == own, np.minimum(most, (ends - runs)[at]), 0)
        stay = np.flatnonzero(most > 0)
        lengths = most[stay]
        place = np.repeat(runs[at[stay]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in stay], pa.binary()), pa.array(size[stay].astype(np.int32)), tk.lists(pa.array(token[place]), lengths)], schema=_TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, rows = None, [], []
        for batch in batches:
            for part, node, size, low, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if sets and rows:
                        yield from of_part(sets, rows)
                    now, sets, rows = part, [], []
                if node is not None:
                    sets.append((node, size, low))
                else:
                    rows.append(row)
        if sets and rows:
            yield from of_part(sets, rows)

    return run


_SENT = "gid long, role int, node binary, weight long, grams binary"
_SEND_BYTES = 1 << 22


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for the set's own group (role 0) and one for each group that it asks (role 1)."""
    schema = pa.schema([("gid", pa.int64()), ("role", pa.int32()), ("node", pa.binary()), ("weight", pa.int64()), ("grams", pa.binary())])
    for batch in batches:
        for part in tk.slices(batch, "text"):
            out: list[list] = [[], [], [], [], []]
            held = 0
            for node, weight, gid, targets, g in zip(*(part.column(c).to_pylist() for c in ("node", "copies", "gid", "targets")), gram_sets(part.column("text")), strict=True):
                data = g.tobytes()
                for k, to in enumerate([gid, *(targets or ())]):
                    for c, v in zip(out, (to, int(k > 0), node, weight, data), strict=True):
                        c.append(v)
                    held += len(data)
                    if held > _SEND_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                        out, held = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


class Group:
    """Members' n-grams in one sorted table; the distinct ones are the union that bounds a query's overlap."""

    def __init__(self, members: dict[bytes, tuple[int, np.ndarray]]) -> None:
        self.nodes = list(members)
        self.weight = np.array([w for w, _ in members.values()], np.int64)
        self.sets = [g for _, g in members.values()]
        self.sizes = np.array([len(g) for g in self.sets], np.int64)
        self.links = np.zeros(len(members), np.int64)
        self.label = np.arange(len(members))  # the class of each member, as far as seen here
        grams = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(members), dtype=np.int32), self.sizes)
        order = np.argsort(grams, kind="stable")
        self.owner = owner[order]
        self.union, self.first = np.unique(grams[order], return_index=True)
        self.upto = np.append(self.first[1:], len(grams))

    def query(self, g: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Members with at least the threshold, and their Jaccard similarity."""
        k = np.minimum(np.searchsorted(self.union, g), len(self.union) - 1)
        k = k[self.union[k] == g]
        if len(k) < threshold * len(g) - 1e-9:
            return np.zeros(0, np.int64), np.zeros(0)
        times = self.upto[k] - self.first[k]
        at = np.repeat(self.first[k] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        both = np.bincount(self.owner[at], minlength=len(self.nodes))
        j = both / (len(g) + self.sizes - both)
        found = np.flatnonzero(j >= threshold)
        return found, j[found]


    def join(self, found: np.ndarray) -> np.ndarray:
        """A member of each class of the found ones, which are one class from now on."""
        labels, first = np.unique(self.label[found], return_index=True)
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]
        return found[first]


_FOUND = "a binary, b binary, links long, jaccard double"


def _open(threshold: float, pairs: bool):  # noqa: ANN202
    """Counts of links (a, null, links) and spanning edges (a, b), or with `pairs` all pairs (a, b, jaccard) of a group."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64()), ("jaccard", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, members, group, last = None, {}, None, None
        out: list[tuple] = []

        def begin() -> None:
            """Links inside a group, once all its members are there."""
            nonlocal group
            if group is None and members:
                group = Group(members)
                members.clear()
                for i, g in enumerate(group.sets):
                    who, j = group.query(g, threshold)
                    if pairs:
                        out.extend((group.nodes[i], group.nodes[m], 0, x) for m, x in zip(who, j, strict=True) if m > i)
                        continue
                    group.links[i] += group.weight[who].sum() - group.weight[i]
                    heads = group.join(who)
                    out.extend((group.nodes[heads[0]], group.nodes[m], 0, None) for m in heads[1:])
                group.sets = []

        def end() -> None:
            begin()
            if group is not None and not pairs:
                out.extend((group.nodes[m], None, int(group.links[m]), None) for m in np.flatnonzero(group.links))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for to, role, node, weight, data in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if to != gid:
                    end()
                    gid, group, last = to, None, None
                    members.clear()
                if (role, node) == last:  # a row that stands twice in the documents
                    continue
                last = role, node
                g = np.frombuffer(data.as_buffer(), np.uint64)
                if role == 0:
                    members[node] = (weight, g)
                    continue
                begin()
                if group is None:
                    continue
                who, j = group.query(g, threshold)
                if pairs:
                    out.extend((node, group.nodes[m], 0, x) for m, x in zip(who, j, strict=True))
                elif len(who):
                    out.append((node, None, int(group.weight[who].sum()), None))
                    group.links[who] += weight
                    out.extend((node, group.nodes[m], 0, None) for m in group.join(who))
                if len(out) > 1 << 16:
                    yield flush()
            yield flush()
        end()
        yield flush()

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """id, row (with the id it tells rows with different texts apart, and a null id from any other) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), row_key(docs).alias("row"), "text")


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"], docs["doc_id"].isNull())


def signatures(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return _rows(docs).where("text IS NOT NULL").mapInArrow(_sign, "id long, row long, node binary, size int, low int")


def tokens(docs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """node, size and tokens of every set that can have a partner: any two at or above the threshold have a token in common."""
    grams = signed.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    parts = grams // BUCKET_GRAMS + 1
    packed = docs.select("text").where("text IS NOT NULL").mapInArrow(_scatter(parts), "part long, keys binary, counts binary, tokens binary")
    shared = packed.repartition("part").sortWithinPartitions("part").mapInArrow(_shared(parts), "part long, bucket long, keys binary, counts binary, tokens binary, sets binary")
    # the key is unsigned: its upper and lower half by themselves
    upper, lower = (F.conv(F.hex(F.substring("node", i, 4)), 16, 10).cast("long") for i in (1, 5))
    part = F.pmod(F.pmod(upper, F.lit(parts)) * ((1 << 32) % parts) + lower, F.lit(parts))
    sets = signed.groupBy("node").agg(F.first("size").alias("size"), F.first("low").alias("low"))
    rows = sets.select(part.cast("long").alias("part"), "node", "size", "low").unionByName(shared, allowMissingColumns=True)
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(_prefix(threshold), "node binary, size int, tokens array<long>")


def link(docs: DataFrame, signed: DataFrame, threshold: float, pairs: bool = False) -> DataFrame:
    """What the groups find, see `_open`; a, b are nodes. Kept in the shared folder."""
    at = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    sets = signed.groupBy("node").agg(F.min(at).alias("at"))
    copies = signed.select("node", "id").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("copies"))

    prefixes = materialize(tokens(docs, signed, threshold), "tokens")
    cells = prefixes.select("node", "size", F.explode("tokens").alias("token"))
    full = cells.groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("grams")).where("sets > 1")
    own = cells.join(full, "token").groupBy("node").agg(F.max(F.struct("sets", "token", "grams")).alias("top"), F.collect_set("token").alias("tokens"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("top.grams") / GROUP_GRAMS))
    own = materialize(own.select("node", "tokens", F.xxhash64("top.token", part).alias("gid")), "groups")
    release(prefixes)
    matrix = own.select(F.explode("tokens").alias("token"), F.col("gid").alias("to")).distinct()
    asked = own.select("node", "gid", F.explode("tokens").alias("token")).join(matrix, "token").where("to > gid")
    targets = asked.groupBy("node").agg(F.collect_set("to").alias("targets"))
    known = sets.select("node", "at.id", "at.row").join(copies, "node")
    send = own.select("node", "gid").join(known, "node").join(targets, "node", "left")

    # null-safe by a pair: hash keys stay plain
    texts = _rows(docs).where("text IS NOT NULL").withColumn("id", F.coalesce("id", F.lit(0)))
    sent = texts.join(send.withColumn("id", F.coalesce("id", F.lit(0))), ["id", "row"]).drop("id", "row").mapInArrow(_send, _SENT)
    found = materialize(sent.repartition("gid").sortWithinPartitions("gid", "role", "node").mapInArrow(_open(threshold, pairs), _FOUND), "links")
    release(own)
    return found


def classes(found: DataFrame) -> DataFrame:
    """node, component for every node with a link."""
    return connected_components(found.where("b IS NOT NULL"), "a", "b")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest id of the class) and links (documents at or above the threshold) of every document."""
    docs = docs.where("doc_id IS NOT NULL")
    signed = materialize(signatures(docs), "signatures")
    found = link(docs, signed, threshold)
    members = signed.select("id", "node").distinct()
    sets = members.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    others = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    component = materialize(classes(found), "classes")
    grouped = sets.join(component, "node", "left").join(others, "node", "left")
    named = grouped.select("node", F.coalesce("component", "node").alias("component"), "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # the smallest id of a class: only classes of several sets need it, which are few rows of a set each
    names = named.join(component.select("node"), "node", "left_semi").groupBy("component").agg(F.min("first").alias("class_id"))
    of_set = named.join(names, "component", "left").select("node", F.coalesce("class_id", "first").alias("class_id"), "links")
    linked = members.join(of_set, "node").select(F.col("id").alias("doc_id"), "class_id", "links")
    # without a word there is no set
    alone = _rows(docs).where(~has_word(F.coalesce("text", F.lit("")))).select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links")).distinct()
    return linked.unionByName(alone)


def has_word(text: Column) -> Column:
    return text.rlike(tk.WORD)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_a < doc_b and their similarity, for all pairs of documents at or above the threshold: as many rows as there are."""
    docs = docs.where("doc_id IS NOT NULL")
    signed = materialize(signatures(docs), "signatures")
    pairs = link(docs, signed, threshold, pairs=True).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
    held = signed.select("id", "node").distinct()
    left, right = held.select(F.col("id").alias("da"), F.col("node").alias("a")), held.select(F.col("id").alias("db"), F.col("node").alias("b"))
    near = pairs.join(left, "a").join(right, "b").where("da <> db").select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"), "jaccard")
    same = left.join(right, F.col("a") == F.col("b")).where("da < db").select(F.col("da").alias("doc_a"), F.col("db").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(same).groupBy("doc_a", "doc_b").agg(F.round(F.max("jaccard"), 6).alias("jaccard"))


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each class of near copies the document with the smallest id (null last), all columns; of equal rows one.

    The rows that go are narrow (id and hash of the text); texts are moved once, to meet them.
    """
    signed = materialize(signatures(docs), "signatures")
    found = link(docs, signed, threshold)
    at = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    rows = signed.select("node", at.alias("at"))
    sets = rows.groupBy("node").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    component = materialize(classes(found), "classes")
    best = sets.join(component, "node").groupBy("component").agg(F.min("first").alias("best"))
    stays = sets.join(component.join(best, "component").select("node", "best"), "node", "left").select("node", F.coalesce("best", "first").alias("best"), "last", "first")
    # only sets of which something goes meet their rows again
    gone = rows.join(stays.where("best <> first OR last <> best").select("node", "best"), "node").where("at <> best").select(F.coalesce("at.id", F.lit(0)).alias("__id"), F.col("at.row").alias("__row")).distinct()
    gone = materialize(gone, "gone")
    gone = broadcast_if_small(gone, gone.count())
    repeated = signed.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    release(signed, found, component)
    keyed = docs.withColumns({"__id": F.coalesce(docs["doc_id"].cast("long"), F.lit(0)), "__row": row_key(docs)})
    kept = keyed.join(gone, ["__id", "__row"], "left_anti")
    if not repeated:
        return kept.select(*[f"`{c}`" for c in docs.columns])
    again = F.row_number().over(Window.partitionBy("__id", "__row").orderBy("__id")) > 1
    return kept.withColumn("__again", again & has_word(F.coalesce("text", F.lit("")))).where("NOT __again").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pairs_sql(source: str = "documents") -> str:
    """Exact pairs. Sets are compared where they share an n-gram."""
    return f"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\x0B]+') ws FROM {source}),
g AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(ws) < {N} THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + {N - 1}], ' ') END) AS g
      FROM w, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - {N - 1}) + 1)) AS i) WHERE len(ws) > 0),
z AS (SELECT doc_id, count(*) n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id a, b.doc_id b, count(*) o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a AS doc_a, b AS doc_b, round(o / CAST(x.n + y.n - o AS DOUBLE), 6) AS jaccard
         FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE o / CAST(x.n + y.n - o AS DOUBLE) >= {THRESHOLD})"""


QUERIES = {"op10_jaccard_join": query}
CLASSES_SQL = f"""
WITH RECURSIVE {pairs_sql().replace("near AS (", "near AS MATERIALIZED (")},
e AS MATERIALIZED (SELECT doc_a a, doc_b b FROM near UNION ALL SELECT doc_b, doc_a FROM near),
r AS (SELECT DISTINCT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id),
n AS (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(n.links, 0) AS links FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
SQL = {"op10_jaccard_join": CLASSES_SQL}
