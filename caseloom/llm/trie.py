"""The prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

Conversations are sorted by their turns (as digests), ranges of the order in parts. The longest common prefix of two neighbours is an edge; edges are
taken in descending depth, and each joins the components on its two sides: at a depth that neither has as its top a branching node comes into being,
else the nodes melt into one. What lies between a node and its parent is a chain of nodes with the same members.

A part knows all of a node that holds neither its first nor its last conversation. The others, the open ones, are at most as many as these two have
turns; the part's forest is contracted to them, with the counts of all that hangs below, and some parts' contracted forests in a row are one
sequence for the same union-find, with edges across the boundaries. So rounds of merging go on until one part is left, and no task holds more than its
part or FAN contracted forests.

Sums over subtrees are sums over intervals of the order: the members of a node, its leaves (last copies of conversations that no other continues), and,
for the words saved, the words of the common prefix of each two neighbours in it, less those above the node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import WORD, staged

#: Turns in a part of the order, about; contracted forests that are merged at once; bytes of an id list that travel as one row.
PART_TURNS, FAN, CHUNK = 400_000, 64, 1 << 20
DIGEST = 16
EMPTY = hashlib.sha256(b"").hexdigest()

#: A node as it is found: up is the level, part and number of the open node that is its parent, if that was not known yet; ends names the list of
#: those that end in it, where parts hold pieces of it.
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary, up_level int, up_part int, up_at int"
#: A piece of a contracted forest: the open nodes of a part in the order of their members, with the depth of the edge before each, and what it stands for a level below.
ITEMS = "part int, at int, edge long, depth long, n long, conv_id long, leaves long, saved long, children long, ends binary, first boolean, key binary, words binary"
#: Which open node became which, or which conversation names it at last.
NAMES = "level int, part int, at int, to_part int, to_at int, name long"
CHUNKS = "ends binary, first_id long, ids binary"
KINDS = ("node", "item", "name", "chunk")


def digest(role: Column, text: Column) -> Column:
    """32 hexadecimal digits that stand for a turn; a null role or text is empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


class Forest:
    """Union-find over a sequence of partial nodes, with an edge between each two neighbours."""

    def __init__(self, depth, n, conv, leaves, saved, children, edges, edge_saved):
        """Arrays by item; edges (one fewer): the depth at which neighbours part, and what each edge adds to the words shared."""
        m = len(depth)
        self.depth, self.n, self.conv, self.leaves, self.saved, self.children = (list(map(int, x)) for x in (depth, n, conv, leaves, saved, children))
        self.parent, self.lo, self.hi = [-1] * m, list(range(m)), list(range(m))
        self.into = list(range(m))  # the node that an item, or a node that melted, is part of
        top = list(range(m))  # of the component, by its set's root
        sets = list(range(m))

        def root(i):
            while sets[i] != i:
                sets[i] = sets[sets[i]]
                i = sets[i]
            return i

        edges, edge_saved = list(map(int, edges)), list(map(int, edge_saved))
        for e in np.argsort(-np.asarray(edges, np.int64), kind="stable").tolist():
            a, b, d = root(e), root(e + 1), edges[e]
            x, y = top[a], top[b]
            if self.depth[x] > d and self.depth[y] > d:
                z = self._new(d)
                self._below(z, x)
                self._below(z, y)
            elif self.depth[x] > d:
                z = y
                self._below(z, x)
            elif self.depth[y] > d:
                z = x
                self._below(z, y)
            else:
                z = x
                self.into[y] = x
                self._add(x, y)
                self.children[x] += self.children[y]
            self.saved[z] += edge_saved[e]
            sets[b] = a
            top[a] = z
        self.parent = [self.node(p) if p >= 0 else p for p in self.parent]

    def _new(self, depth):
        z = len(self.depth)
        for values, v in ((self.depth, depth), (self.n, 0), (self.conv, None), (self.leaves, 0), (self.saved, 0), (self.children, 0), (self.parent, -1), (self.lo, z), (self.hi, -1), (self.into, z)):
            values.append(v)
        return z

    def _add(self, z, x):
        self.n[z] += self.n[x]
        self.leaves[z] += self.leaves[x]
        self.saved[z] += self.saved[x]
        if self.conv[z] is None or (self.conv[x] is not None and self.conv[x] < self.conv[z]):
            self.conv[z] = self.conv[x]
        self.lo[z], self.hi[z] = min(self.lo[z], self.lo[x]), max(self.hi[z], self.hi[x])

    def _below(self, z, x):
        self.parent[x] = z
        self.children[z] += 1
        self._add(z, x)

    def node(self, i):
        """What an item, or a node that melted into another, is now."""
        while self.into[i] != i:
            i = self.into[i]
        return i

    def nodes(self):
        return [i for i in range(len(self.depth)) if self.into[i] == i]


def _common(a: bytes, b: bytes) -> int:
    """Turns in which two keys agree from the start."""
    k = min(len(a), len(b)) // DIGEST
    if a[: k * DIGEST] == b[: k * DIGEST]:
        return k
    x, y = (np.frombuffer(v, np.uint64, 2 * k).reshape(k, 2) for v in (a, b))
    return int((x != y).any(1).argmax())


class _Out:
    """Rows of all kinds, as batches of one table with a struct for each kind."""

    def __init__(self):
        self.rows = {kind: [] for kind in KINDS}

    def batches(self, types, most=4096):
        for k, kind in enumerate(KINDS):
            for at in range(0, len(self.rows[kind]), most):
                part = self.rows[kind][at : at + most]
                columns = [pa.array(part, types[j]) if j == k else pa.nulls(len(part), types[j]) for j in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(columns, list(KINDS))


def _types():
    of = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return [pa.struct([(name, of[kind]) for name, kind in (c.split() for c in columns.split(", "))]) for columns in (NODES, ITEMS, NAMES, CHUNKS)]


def _out_schema() -> str:
    return ", ".join(f"{k} struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in kind.split(', '))}>" for k, kind in zip(KINDS, (NODES, ITEMS, NAMES, CHUNKS), strict=True))


def _emit(out: _Out, f: Forest, words_of, level: int, part: int, last_part: bool, first: dict, ends_of, items_in=None):
    """Rows for the nodes of a part's forest: closed ones whole, open ones as the part's contracted forest.

    words_of(node) -> words of the first d turns, for d from 0; ends_of(node) -> (SHA-256, None) or (None, name of the list). With last_part all are closed. items_in: (part, at) of
    each item, whose names are told.
    """
    m = max(f.hi, default=-1)
    nodes = f.nodes()
    is_open = lambda i: not last_part and (f.lo[i] == 0 or f.hi[i] == m)
    spine = [i for i in nodes if is_open(i)]
    left = sorted((i for i in spine if f.lo[i] == 0 and f.hi[i] != m), key=lambda i: -f.depth[i])
    right = sorted((i for i in spine if f.hi[i] == m and f.lo[i] != 0), key=lambda i: f.depth[i])
    whole = sorted((i for i in spine if f.lo[i] == 0 and f.hi[i] == m), key=lambda i: -f.depth[i])  # the top, and nothing else
    order = [*left, *whole, *right]
    at = {i: k for k, i in enumerate(order)}
    below = {}
    for i in order:
        if f.parent[i] in at:
            below.setdefault(f.parent[i], []).append(i)
    for k, i in enumerate(order):
        own = below.get(i, [])
        edge = None if not k else f.depth[i] if k <= len(left) else f.depth[order[k - 1]]
        sha, ends = ends_of(i)
        side = {"first": k <= len(left)}
        out.rows["item"].append({"part": part, "at": k, "edge": edge, "depth": f.depth[i], "n": f.n[i] - sum(f.n[c] for c in own), "conv_id": f.conv[i], "leaves": f.leaves[i] - sum(f.leaves[c] for c in own), "saved": f.saved[i] - sum(f.saved[c] for c in own), "children": f.children[i] - len(own), "ends": ends} | side | (first if k == 0 else {"key": None, "words": None}))
    for i in nodes:
        if i in at:
            continue
        p, words = f.parent[i], words_of(i)
        low = f.depth[p] if p >= 0 else -1
        sha, ends = ends_of(i)
        for d in range(low + 1, f.depth[i] + 1):
            end = d == f.depth[i]
            row = {"conv_id": f.conv[i], "depth": d, "n_convs": f.n[i], "n_leaves": f.leaves[i], "saved_tokens": f.saved[i] - (f.n[i] - 1) * (int(words[d - 1]) if d else 0), "n_children": f.children[i] if end else 1}
            row |= {"ends_sha256": sha if end and ends is None else EMPTY, "ends": ends if end else None}
            if d > low + 1:
                row["parent_conv_id"] = f.conv[i]
            elif p in at:
                row |= {"up_level": level, "up_part": part, "up_at": at[p]}
            elif p >= 0:
                row["parent_conv_id"] = f.conv[p]
            out.rows["node"].append(row)
    for i, (was_part, was_at) in enumerate(items_in or []):
        z = f.node(i)
        out.rows["name"].append({"level": level - 1, "part": was_part, "at": was_at} | ({"to_part": part, "to_at": at[z]} if z in at else {"name": f.conv[z]}))


def _leaves(batches):
    """A part of the sorted conversations (conv_id, key, words) -> rows of all kinds."""
    types, part = _types(), TaskContext.get().partitionId()
    ids, keys, sums = [], [], []
    for b in batches:
        ids += b.column("conv_id").to_pylist()
        keys += b.column("key").to_pylist()
        sums += [np.frombuffer(w, ">i8") for w in b.column("words").to_pylist()]
    if not ids:
        return
    sums = [np.concatenate([[0], np.cumsum(w)]).astype(np.int64) for w in sums]
    depth = [len(k) // DIGEST for k in keys]
    edges = [_common(a, b) for a, b in zip(keys, keys[1:], strict=False)]
    saved = [sums[i + 1][e] for i, e in enumerate(edges)]
    # The last one's leaf is counted where the next part is known.
    leaves = [int(e < d) for e, d in zip(edges, depth, strict=False)] + [0]
    f = Forest(depth, np.ones(len(ids), int), ids, leaves, [0] * len(ids), [0] * len(ids), edges, saved)
    m, copies = len(ids) - 1, {}
    for i in range(len(ids)):
        z = f.node(i)
        if f.depth[z] == depth[i]:
            copies.setdefault(z, []).append(i)
    out = _Out()

    def ends_of(i):
        mine = copies.get(i)
        if not mine:
            return EMPTY, None
        if 0 < f.lo[i] and f.hi[i] < m:
            return hashlib.sha256(",".join(str(ids[c]) for c in mine).encode()).hexdigest(), None
        name, step = hashlib.sha256(keys[mine[0]]).digest(), CHUNK // 24
        for at in range(0, len(mine), step):
            some = [ids[c] for c in mine[at : at + step]]
            out.rows["chunk"].append({"ends": name, "first_id": some[0], "ids": ",".join(map(str, some)).encode()})
        return None, name

    ends = {"key": keys[0], "words": sums[0].astype(">i8").tobytes()}
    _emit(out, f, lambda i: sums[f.lo[i]], 0, part, False, ends, ends_of)
    # The last conversation travels with the last item, unless that is the first one too.
    out.rows["item"].append({"part": part, "at": -1, "key": keys[m], "words": sums[m].astype(">i8").tobytes()})
    yield from out.batches(types)


def _merge(level: int, whole: bool):
    """Contracted forests of some parts in a row -> rows of all kinds. whole: these are all parts."""

    def run(key, table):
        types, part = _types(), key[0].as_py()
        rows = sorted(table.drop_columns(["group"]).to_pylist(), key=lambda r: (r["part"], r["at"] < 0, r["at"]))
        items, keys = [r for r in rows if r["at"] >= 0], {}
        for r in rows:
            if r["key"] is not None:
                keys[r["part"], r["at"] < 0] = (r["key"], np.frombuffer(r["words"], ">i8").astype(np.int64))
        edges, saved = [], []
        for a, b in zip(items, items[1:], strict=False):
            if a["part"] == b["part"]:
                edges.append(b["edge"])
                saved.append(0)
                continue
            before, after = keys[a["part"], True], keys[b["part"], False]
            edges.append(e := _common(before[0], after[0]))
            saved.append(int(after[1][e]))
            a["leaves"] += int(e < len(before[0]) // DIGEST)
        if whole:
            items[-1]["leaves"] += 1
        f = Forest(*([r[c] for r in items] for c in ("depth", "n", "conv_id", "leaves", "saved", "children")), edges, saved)
        listed = {}
        for i, r in enumerate(items):
            if r["ends"] is not None:
                listed[f.node(i)] = r["ends"]
        side = [keys[r["part"], not r["first"]][1] for r in items]
        out, low, high = _Out(), items[0]["part"], items[-1]["part"]
        # Any member's words serve: a node's turns are all its members' first turns.
        _emit(out, f, lambda i: side[f.lo[i]], level, part, whole, dict(zip(("key", "words"), (keys[low, False][0], keys[low, False][1].astype(">i8").tobytes()), strict=True)), lambda i: (None, listed[i]) if i in listed else (EMPTY, None), [(r["part"], r["at"]) for r in items])
        if not whole:
            out.rows["item"].append({"part": part, "at": -1, "key": keys[high, True][0], "words": keys[high, True][1].astype(">i8").tobytes()})
        return pa.Table.from_batches(out.batches(types), pa.schema(list(zip(KINDS, types, strict=True))))

    return run


def _hashed(batches):
    """Pieces of id lists, sorted by list and first id -> ends, sha. One list at a time, piece by piece."""
    name, h = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([h.hexdigest()])], ["ends", "sha"])
    for b in batches:
        for ends, ids in zip(b.column("ends").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if ends == name:
                h.update(b",")
            else:
                if name is not None:
                    yield done()
                name, h = ends, hashlib.sha256()
            h.update(ids)
    if name is not None:
        yield done()


def prefix_trie(turns: DataFrame, part_turns: int = PART_TURNS, fan: int = FAN) -> DataFrame:
    """turns (conv_id, key: the digests of its turns one after the other, words: their words as big-endian longs) -> the nodes of the trie.

    A row for each distinct sequence of first turns, the empty one (the root) included: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. A conversation is one row, and its turns are held by one task (24 bytes each); an empty table has no node.
    """
    spark = turns.sparkSession
    held = turns.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("key") / DIGEST + 1).alias("turns")).first()
    if not held["n"]:
        return spark.createDataFrame([], NODES).select(*_node_columns())
    parts = min(held["n"], max(spark.sparkContext.defaultParallelism, -(-int(held["turns"]) // part_turns)))
    ordered = turns.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = [staged(ordered.mapInArrow(_leaves, _out_schema()), "trie-level")]
    kind = lambda df, k: df.where(F.col(k).isNotNull()).select(f"{k}.*")
    while True:
        level = len(found)
        items = kind(found[-1], "item")
        last = items.agg(F.max("part")).first()[0]
        groups = items.withColumn("group", F.floor(F.col("part") / fan).cast("int"))
        whole = last < fan
        found.append(staged(groups.groupBy("group").applyInArrow(_merge(level, whole), _out_schema()), "trie-level"))
        if whole:
            break
    # From the last level down: the conversation that names each open node. A part's nodes ask for its own open nodes only, so no name is asked for by many.
    names = kind(found[-1], "name").where("to_at IS NULL").select("level", "part", "at", "name")
    told = [names]
    for df in found[-2:0:-1]:
        up = kind(df, "name")
        on = told[-1].select(F.col("part").alias("to_part"), F.col("at").alias("to_at"), F.col("name").alias("later"))
        told.append(up.join(on, ["to_part", "to_at"], "left").select("level", "part", "at", F.coalesce("name", "later").alias("name")))
    every = told[0]
    for t in told[1:]:
        every = every.unionByName(t)
    every = staged(every.select(F.col("level").alias("up_level"), F.col("part").alias("up_part"), F.col("at").alias("up_at"), "name"), "trie-names")
    nodes, chunks = kind(found[0], "node"), kind(found[0], "chunk")
    for df in found[1:]:
        nodes = nodes.unionByName(kind(df, "node"))
    shas = staged(chunks.repartition("ends").sortWithinPartitions("ends", "first_id").select("ends", "ids").mapInArrow(_hashed, "ends binary, sha string"), "trie-ends")
    known = nodes.where("up_level IS NULL")
    asking = nodes.where("up_level IS NOT NULL").join(every, ["up_level", "up_part", "up_at"], "left").withColumn("parent_conv_id", F.col("name")).drop("name")
    nodes = known.unionByName(asking)
    plain = nodes.where("ends IS NULL")
    listed = nodes.where("ends IS NOT NULL").join(shas, "ends", "left").withColumn("ends_sha256", F.col("sha")).drop("sha")
    return plain.unionByName(listed).select(*_node_columns())


def _node_columns() -> list[str]:
    return ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(turns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> conv_id, turns: an array of (turn, role, digest in hexadecimal, words), in order.

    Turns are in order of their number (null first), ties in order of role and digest. Rows without conv_id belong to no conversation. by: columns of the conversation that stay.
    """
    text = F.coalesce("text", F.lit(""))
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), digest(F.col("role"), F.col("text")).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    return turns.where(F.col("conv_id").isNotNull()).select(*by, "conv_id", one.alias("one")).groupBy(*by, "conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def as_keys(rebuilt: DataFrame) -> DataFrame:
    """conv_id, turns -> conv_id, key, words, as prefix_trie takes them."""
    hexed = lambda x: F.lpad(F.hex(x), 16, "0")
    return rebuilt.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("key"), F.unhex(F.array_join(F.transform("turns", lambda x: hexed(x["words"])), "")).alias("words"))


def rebuilt_from_heads(turns: DataFrame) -> DataFrame:
    """conv_id, turns: the first h turns of conversation c - c % 20, then c's own after its first h; h is the CRC-32 of c in decimal, modulo 4."""
    # The twenty conversations of a head meet before they are grouped, so that the turns move once.
    together = conversations(turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).repartition("base"), ("base",))
    heads = together.where("conv_id = base").select("base", F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    none = F.slice("turns", 1, 0)
    begun = F.when(F.col("h") == 0, none).otherwise(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")))
    return together.join(heads, "base", "left").withColumn("h", h).select("conv_id", F.concat(begun, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def op13_prefix_trie(spark, sf_dir):
    """The prefix trie of all conversations, each rebuilt with the head of the one whose id is next below it and divisible by 20.

    A null role or text is empty; rows without conv_id belong to no conversation; repeated turns are turns of their own. An empty table has no node.
    """
    keys = as_keys(rebuilt_from_heads(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
    return prefix_trie(staged(keys, "trie-conversations"))


ORACLE = r"""
WITH RECURSIVE K AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS v, 0 AS s FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, s + 1 FROM K WHERE s < 8),
T AS (SELECT list(v ORDER BY i) AS tab FROM K WHERE s = 8),
C AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
H AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a // 256, tab[xor(a, b) % 256 + 1])), 4294967295) % 4 AS h FROM C, T),
X AS (SELECT conv_id, turn, coalesce(role, '') AS role, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations),
O AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, m) AS place FROM X),
B AS (SELECT H.conv_id, 0 AS own, place, m, words FROM H JOIN O ON O.conv_id = H.conv_id - H.conv_id % 20 WHERE place <= h UNION ALL SELECT H.conv_id, 1, place, m, words FROM H JOIN O ON O.conv_id = H.conv_id WHERE place > h),
S AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY own, place) AS k, words FROM B
  UNION ALL SELECT conv_id, 0, '', 0 FROM C),
N AS (SELECT k, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(words) AS own FROM S GROUP BY k),
P AS (SELECT substr(k, 1, length(k) - 32) AS k, count(*) AS n FROM N WHERE depth > 0 GROUP BY 1),
Q AS (SELECT conv_id, max_by(k, depth) AS k FROM S GROUP BY conv_id),
E AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM Q GROUP BY k),
L AS (SELECT N.*, coalesce(P.n, 0) AS n_children, CASE WHEN P.n IS NULL THEN 1 ELSE 0 END AS leaf FROM N LEFT JOIN P ON P.k = N.k),
U AS (SELECT leaf, own, k, unnest(generate_series(0, depth)) AS d FROM L),
V AS (SELECT substr(k, 1, CAST(32 * d AS BIGINT)) AS k, sum(leaf) AS n_leaves, sum(own) AS saved FROM U GROUP BY 1)
SELECT L.conv_id, CAST(L.depth AS BIGINT) AS depth, A.conv_id AS parent_conv_id, CAST(L.n_convs AS BIGINT) AS n_convs, CAST(L.n_children AS BIGINT) AS n_children, CAST(V.n_leaves AS BIGINT) AS n_leaves,
  CAST(V.saved AS BIGINT) AS saved_tokens, coalesce(E.ends, sha256('')) AS ends_sha256
FROM L JOIN V ON V.k = L.k LEFT JOIN E ON E.k = L.k LEFT JOIN N A ON L.depth > 0 AND A.k = substr(L.k, 1, length(L.k) - 32)
"""
