"""The prefix trie against a plain one, over parts of all sizes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from caseloom.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for v in members:
        if v:
            children[v[:-1]] += 1
    for v, m in members.items():
        own = (len(m) - 1) * len(WORD.findall(v[-1][1])) if v else 0
        for d in range(len(v) + 1):
            saved[v[:d]] += own
            leaves[v[:d]] += v not in children
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(v), min(members[v[:-1]]) if v else -1, len(m), children[v] if v in children else 0, leaves[v], saved[v], sha(ends.get(v, []))) for v, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def some(seed, convs, alphabet, longest, hot=0):
    rng = random.Random(seed)
    texts = ["a b", "c", "", "d e f", "g h i j"][:alphabet]
    rows = [(c, t, rng.choice("us"), rng.choice(texts)) for c in rng.sample(range(convs * 2), convs) for t in range(rng.randint(1, longest))]
    return rows + [(10_000 + c, t, "u", "same words here") for c in range(hot) for t in range(3)]


SCHEMA = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize(("case", "shape"), [((1, 30, 1, 3, 0), (12, 2)), ((2, 60, 2, 5, 0), (10_000, 64)), ((3, 120, 5, 4, 40), (12, 2)), ((3, 120, 5, 4, 40), (40, 64)), ((4, 200, 2, 12, 0), (12, 2)), ((5, 8, 1, 40, 0), (1, 3))])
def test_trie(spark, case, shape):
    """From one part for some turns of each core to one for each conversation, merged at once or two at a time."""
    rows = some(*case)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    keys = trie.as_keys(trie.rebuilt_from_heads(df))
    assert found(trie.prefix_trie(keys, *shape)) == plain(rebuilt(rows))


def test_copies_over_many_parts(spark, monkeypatch):
    """All conversations are equal, or prefixes of one another, so that nodes end in every part, and lists of ids come in pieces."""
    monkeypatch.setattr(trie, "CHUNK", 48)
    rows = [(c, t, "u", "x y") for c in range(0, 60) for t in range(4 if c % 3 else 2)]
    keys = trie.as_keys(trie.conversations(spark.createDataFrame(rows, SCHEMA)))
    own = defaultdict(list)
    for c, _, r, t in rows:
        own[c].append((r, t))
    assert found(trie.prefix_trie(keys, 5, 2)) == plain(own)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None), (1, 0, "u", "a  b\x0bc"), (1, 0, "u", "a  b\x0bc"), (2, 1, "", ""), (None, 0, "u", "lost"), (20, 0, "u", "x"), (21, 0, "u", "y"), (33, 5, "u", "y"), (-7, 0, "u", "z")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", base int, turns string, `a.b` int")
    df.write.parquet(str(tmp_path / "odd" / "conversations.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    got = [r for r in found(trie.op13_prefix_trie(spark, str(tmp_path / "odd")))]
    # The base of a negative id is towards zero, as SQL has it.
    heads = [(c if c is None else c, t, r, x) for c, t, r, x in rows]
    own = rebuilt([r for r in heads if r[0] != -7])
    own[-7] = [("u", "z")][zlib.crc32(b"-7") % 4 :]
    assert got == plain(own)
    assert trie.op13_prefix_trie(spark, str(tmp_path / "none")).count() == 0


def test_all_turnless(spark):
    rows = [(c, 0, "u", "x") for c in (1, 2, 3, 5) if zlib.crc32(str(c).encode()) % 4]
    keys = trie.as_keys(trie.rebuilt_from_heads(spark.createDataFrame(rows, SCHEMA)))
    assert found(trie.prefix_trie(keys, 1)) == plain(rebuilt(rows)) and len(plain(rebuilt(rows))) == 1
