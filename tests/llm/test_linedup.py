import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.llm import linedup


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=12), st.lists(st.sampled_from("abcdef"), max_size=12))
def test_patience_pairs_rise_and_are_equal(a, b):
    pairs = linedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if set(a) & set(b):
        assert pairs


def test_moved_blocks_are_found():
    first = ["a", "b", "c", "d", "e", "f"]
    assert linedup.common_blocks(["d", "e", "f", "new", "a", "b", "c"], [9] * 7, first, 20) == [0, 1, 2, 4, 5, 6]
    assert linedup.common_blocks(["a", "new", "b"], [9] * 3, first, 20) == []


def test_the_alignment_decides_which_block_is_repeated():
    """The block stands twice in the first document; a lookup of runs takes the first place, the alignment the one between the same neighbours."""
    first = ["x", "y", "start", "x", "y", "end"]
    later = ["start", "x", "y", "end"]
    assert linedup.block_places(later, [9] * 4, first, 18) == [(0, 2), (1, 3), (2, 4), (3, 5)]
    assert linedup._in_common_runs(later, [9] * 4, first, 18)[1] == 3
    first = ["x", "y", "a", "x", "y", "b"]
    later = ["new", "x", "y", "b"]
    assert linedup.block_places(later, [9] * 4, first, 18) == [(1, 3), (2, 4), (3, 5)]
    assert linedup._in_common_runs(later, [9] * 4, first, 18)[1] == 0


def test_places_of_blocks(spark):
    say = lambda s: f"the line that says {s} and has some words more than ten in it"
    rows = [(1, "\n".join(map(say, ["x", "y", "a", "x", "y", "b"]))), (2, "\n".join(["own", "", *map(say, ["x", "y", "b"])])), (3, None)]
    got = {(r.doc_id, r.at, r.first_id, r.first_at) for r in linedup.repeated_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 2, 1, 3), (2, 3, 1, 4), (2, 4, 1, 5)}
    lines = {i: (t or "").split("\n") for i, t in rows}
    assert all(lines[d][i] == lines[f][j] for d, i, f, j in got)


def brute(rows, least):
    """Every stretch of lines of enough words that any earlier document has goes; blank lines count for nothing."""
    seqs, out = [], {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        lines = text.split("\n")
        at = [n for n, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        keys = [lines[n].strip(" ") for n in at]
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", lines[n])) for n in at]
        spans = [(a, b) for a in range(len(at)) for b in range(a + 1, len(at) + 1) if sum(words[a:b]) >= least]
        inside = lambda run: any(run == s[k : k + len(run)] for s in seqs for k in range(len(s)))
        gone = {at[k] for a, b in spans if inside(keys[a:b]) for k in range(a, b)}
        out[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
        seqs.append(keys)
    return out


@pytest.mark.parametrize("joined", [False, True])
def test_equals_brute_force(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(linedup, "small", lambda df, limit=0: df)
        monkeypatch.setattr(linedup, "ALIGN_ROWS", 4)
    rnd = random.Random(3)
    pool = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(rnd.randint(1, 14))) for _ in range(60)]
    rows = [(i, "\n".join([rnd.choice(pool) if rnd.random() < 0.4 else f"own line {i} {n} with a few words of its own" for n in range(rnd.randint(0, 9))] + (["the hot line that every third document has, of twelve words or so"] if i % 3 == 0 else []))) for i in range(150)]
    got = {r.doc_id: r.text for r in linedup.delete_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows, linedup.LEAST_WORDS)


def test_odd_rows(odd, none):
    out = linedup.delete_repeated(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_deleted"] and out.count() == odd.count()
    got = {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in out.collect()}
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 0) and got[None] == ("no id here", 1, 0)
    assert got[2][0].startswith("THE QUICK") and got[2][2] == 1 and got[7][0] == "" and got[6][2] == 0
    assert linedup.delete_repeated(none).count() == 0


def test_near_copies_can_be_spared(spark):
    words = [f"w{i}" for i in range(300)]
    lines = [" ".join(words[i : i + 30]) for i in range(0, 300, 30)]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[:9], "changed " + lines[9]])), (3, "\n".join(["own words", lines[2]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r.doc_id: r.n_deleted for r in linedup.delete_repeated(df).collect()}
    spared = {r.doc_id: r.n_deleted for r in linedup.delete_repeated(df, spare=0.7).collect()}
    assert cut == {1: 0, 2: 9, 3: 1} and spared == {1: 0, 2: 0, 3: 1}


def jaccard(s, t):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (s.split(), t.split()))
    return len(x & y) / len(x | y)


def spared_or_cut(spark, rows):
    """Deletes with spare; every pair that still has a common block is a copy by what is left, and no other pair has one."""
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    out = linedup.delete_repeated(df, spare=0.8).orderBy("doc_id").collect()
    left = [(r.doc_id, r.text) for r in out]
    for n, (j, t) in enumerate(left):
        for i, s in left[:n]:
            words = [len(x.split()) for x in t.split("\n")]
            if s.strip() and linedup.common_blocks(t.split("\n"), words, s.split("\n"), linedup.LEAST_WORDS):
                assert jaccard(s, t) >= 0.8, (i, j)
    return {r.doc_id: r.n_deleted for r in out}


def test_only_confirmed_copies_are_spared(spark):
    """A pair between 0.7 and 0.8 is aligned; so is one that falls below 0.8 when other blocks go. One that then comes to 0.8 is spared."""
    lines = lambda name, n: [" ".join(f"{name}{i}x{k}" for k in range(20)) for i in range(n)]
    text = "\n".join
    base, other = lines("a", 20), lines("o", 3)
    rows = [(1, base), (2, base[:17] + lines("b", 3)), (3, other), (4, [*lines("c", 20), *other[:2]]), (5, [*lines("c", 20), *lines("d", 3)])]
    assert 0.7 < jaccard(text(base), text(rows[1][1])) < 0.8 and jaccard(text(rows[3][1]), text(rows[4][1])) < 0.8 < jaccard(text(lines("c", 20)), text(rows[4][1]))
    assert spared_or_cut(spark, rows) == {1: 0, 2: 17, 3: 0, 4: 2, 5: 0}
    rows = [(1, other), (2, [*base, *other]), (3, [*base[:10], *other, *base[10:]])]
    assert spared_or_cut(spark, rows) == {1: 0, 2: 3, 3: 3}
    # A passage of 3 that 2 lacks goes to 1, and with it a third of what made 3 a copy of 2.
    rows = [(1, base[:8]), (2, [*base, *lines("e", 1)]), (3, [*base, *lines("f", 1), *lines("g", 1)])]
    left = [text(x) for x in ([*base[8:], *lines("e", 1)], [*base[8:], *lines("f", 1), *lines("g", 1)])]
    assert jaccard(text(rows[1][1]), text(rows[2][1])) > 0.8 > jaccard(*left)
    assert spared_or_cut(spark, rows) == {1: 0, 2: 8, 3: 20}


def test_sparing_takes_several_rounds(spark):
    """Random documents of shared passages: whatever is cut, no common block is left to nobody."""
    rnd = random.Random(11)
    pool = [[" ".join(f"p{n}l{k}w{w}" for w in range(6)) for k in range(4)] for n in range(12)]
    rows = []
    for i in range(60):
        if i > 10 and rnd.random() < 0.6:
            x = [y for y in rnd.choice(rows)[1] if rnd.random() < 0.93] + [f"own {i} of a few words, and more of them than ten here"]
        else:
            x = [y for n in rnd.sample(range(12), 4) for y in pool[n]] + [f"own line {i} {k} with words of its own" for k in range(4)]
        rows.append((i, x))
    spared_or_cut(spark, rows)


def test_blocks_whose_lines_first_occur_elsewhere(spark):
    p, q = "P p p p p p", "Q q q q q q"
    rows = [(1, p), (2, q), (3, f"{p}\n{q}\nb"), (4, f"c\n{p}\n{q}"), (5, f"{p}\n{q}\n{p}")]
    # The last line of 8 is in a block with 7 only, the long line before it first in 6.
    rows += [(6, "one line of more than ten words that documents have in common"), (7, "one line of more than ten words that documents have in common\nits end"), (8, "start\none line of more than ten words that documents have in common\nits end"), (9, "its end")]
    got = {r.doc_id: r.text for r in linedup.delete_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == dict(rows) | {4: "c", 5: p, 7: "its end", 8: "start"}


def test_small_blocks_are_extended():
    P, Q = "P", "Q"
    assert linedup.common_blocks([P, Q, "n"], [6, 6, 1], [P, "z", P, Q, "m"], 10) == [0, 1]
    assert linedup.common_blocks([P, Q, "x"], [6, 6, 1], [P, "z", Q, "w", P, Q, "y"], 10) == [0, 1]
    assert linedup.common_blocks([P, None, Q], [6, 0, 6], [None, "a", P, Q], 10) == [0, 2]
    assert linedup.common_blocks([None, P], [0, 6], [None, P], 10) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=10), st.lists(st.sampled_from("abcd"), max_size=10), st.integers(1, 14))
def test_common_blocks_are_all_common_runs(later, first, least):
    words = ["abcd".index(x) * 2 + 1 for x in later]
    spans = [(s, e) for s in range(len(later)) for e in range(s + 1, len(later) + 1) if sum(words[s:e]) >= least]
    want = {k for s, e in spans if any(later[s:e] == first[j : j + e - s] for j in range(len(first))) for k in range(s, e)}
    assert linedup.common_blocks(later, words, first, least) == sorted(want)


def test_blank_lines_stay(spark):
    p, q = "p1 p2 p3 p4 p5 p6", "q1 q2 q3 q4 q5 q6"
    rows = [(1, f"{p}\n\n{q}\n\t\n \nend"), (2, f"new\n{p}\n\n\n{q}\n\t\nother"), (3, f"{p}\n\nown")]
    got = {r.doc_id: r.text for r in linedup.delete_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {2: "new\n\n\n\t\nother"}


def test_equals_alignment_with_all_earlier_documents(spark):
    """Blocks of short lines whose lines first occur elsewhere, one by one, are found too."""
    rnd = random.Random(5)
    pool = [" ".join(f"s{i}" for _ in range(rnd.randint(2, 8))) for i in range(12)]
    rows = [(i, x) for i, x in enumerate(pool)]
    rows += [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.7 else f"own {i} {n}" for n in range(rnd.randint(1, 8)))) for i in range(20, 120)]
    rows += [(500, "P p p p p p"), (501, "Q q q q q q"), (502, "P p p p p p\nQ q q q q q\nb"), (503, "c\nP p p p p p\nQ q q q q q")]
    want = brute(rows, linedup.LEAST_WORDS)
    got = {r.doc_id: r.text for r in linedup.delete_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got[503] == "c"
    assert {i for i in want if got[i] != want[i]} == set()


def test_four_documents_without_a_common_first_holder(spark):
    p, q = "P p p p p p", "Q q q q q q"
    rows = [(1, p), (2, q), (3, f"{p}\n{q}"), (4, f"{p}\n{q}")]
    got = {r.doc_id: r.n_deleted for r in linedup.delete_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 2}


def test_repeated_ids_and_clashing_names(spark):
    line = "a line of more than ten words that two documents have in common"
    rows = [(1, line, 7), (5, f"own words\n{line}", 8), (5, f"{line}\nother words\n{line}", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int").withColumns({c: F.lit(0) for c in ("_gone_id", "gone", "row", "at", "part", "lines")})
    got = {r._gone: (r.text, r.n_deleted) for r in linedup.delete_repeated(df).collect()}
    assert got == {7: (line, 0), 8: ("own words", 1), 9: ("other words", 2)}
