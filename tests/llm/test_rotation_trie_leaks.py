"""Fill-in-the-middle, the prefix trie and decontamination against brute force on small tables."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from kinespark.llm import decontaminate, fim, trie
from kinespark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, form string, n long, class string, row int"
TEXTS = [None, "", " ", "a", "word", "two words", "has <P> inside", "naïve café 日本語 😀😀 x", "a<", "<S", ">b", "x" * 200_000, "ab, " * 30_000, "ab, cd. " * 9, "ab, cd. " * 9]
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(k, t, None, "psm", 3, "c", 1) for k, t in enumerate(TEXTS * 4)]
    return spark.createDataFrame([*rows, rows[13], (None, "no id here", "en", "", 1, "", 2)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_block_rotation", "op12_prefix_trie", "op13_prefix_filtered_leaks"])
def test_queries_equal_their_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    want = con.sql(ORACLE[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def by_hand(doc_id, text):
    text, hexed = text or "", sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_rotation_by_definition(edge, empty):
    want = sorted((by_hand(r.doc_id, r.text) for r in edge.collect()), key=repr)
    assert sorted((tuple(r) for r in fim.transform(edge).collect()), key=repr) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = fim.restore(fim.transform(edge)).collect()
    texts = {r.doc_id: r.text or "" for r in edge.collect()}
    assert all(r.restored == texts[r.doc_id] for r in back) and len(back) == edge.count()
    assert fim.digests(empty).count() == 0


def test_outputs_of_no_form_are_not_restored(spark):
    rows = spark.createDataFrame([("<S>a<P>b", "spm"), ("<P>a<M>b<S>c", "psm"), ("abc", "psm"), (None, "psm"), ("abc", None), (None, "plain")], "output string, form string")
    assert [r.restored for r in fim.restore(rows).collect()] == [None, None, None, None, "abc", ""]


def test_exchange_in_place_over_many_swaps(monkeypatch):
    monkeypatch.setattr(fim, "SWAP_BYTES", 3)
    for low, mid, high in [(0, 0, 0), (0, 5, 20), (2, 19, 20), (3, 3, 20), (3, 20, 20), (0, 10, 20)]:
        buffer = np.arange(20, dtype=np.uint8)
        fim.exchange(buffer, low, mid, high)
        assert buffer.tolist() == [*range(low), *range(mid, high), *range(low, mid), *range(high, 20)]


def test_markers_of_other_kinds():
    with pytest.raises(ValueError):
        fim.Markers("<a>", "<a>", "<m>")
    with pytest.raises(ValueError):
        fim.Markers("a", "ba", "c")


def trie_by_hand(turns):
    convs = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role, sha(f"{len(role)}:{role}{text}"), text))
    convs = {c: [(r, t) for *_, r, _, t in sorted(rows)] for c, rows in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {v: [u for u in members if len(u) == len(v) + 1 and u[:-1] == v] for v in members}
    words = lambda v: len(re.findall(r"[^\x20\x09-\x0D]+", v[-1][1])) if v else 0

    def total(v, of):
        todo, n = [v], 0
        while todo:
            u = todo.pop()
            n += of(u)
            todo += children[u]
        return n

    return {
        (min(m), len(v), min(members[v[:-1]]) if v else None, len(m), len(children[v]), total(v, lambda u: not children[u]), total(v, lambda u: (len(members[u]) - 1) * words(u)), sha(",".join(str(c) for c in sorted(m) if rebuilt[c] == v)))
        for v, m in members.items()
    }


def test_trie_by_definition(spark, monkeypatch):
    """Long and hot conversations, copies, ties, nulls; small ranges of ends and few heavy parents, so all paths are taken."""
    monkeypatch.setattr(trie, "ENDS_RANGE", 3)
    monkeypatch.setattr(trie, "HEAVY_CHILDREN", 3)
    rng = random.Random(5)
    turns = [(0, k, "user", f"long {k % 7} x") for k in range(70)]
    turns += [(c, k, "user" if k % 2 == 0 else None, rng.choice(["a b", "c", "", None, "a  b"])) for c in range(1, 45) if c != 20 for k in range(rng.randint(1, 9))]
    turns += [(c, k, "user", "the same words here") for c in range(100, 140) for k in range(3)]
    turns += [(60, None, "user", "null first"), (60, 2, "b", "x"), (60, 2, "a", "y"), (60, 2, "a", "y"), (None, 1, "user", "nobody's"), (61, 0, "user", "cut away"), (-7, 0, "user", "below zero")]
    rng.shuffle(turns)
    table = spark.createDataFrame([(*t, "extra", 1) for t in turns], "conv_id long, turn long, role string, text string, name string, depth int").repartition(5)
    got = [tuple(r) for r in trie.conversations_trie(table).collect()]
    assert len(got) == len(set(got)) and set(got) == trie_by_hand(turns)


def test_trie_of_nothing_and_of_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.conversations_trie(spark.createDataFrame([], schema)).count() == 0
    # the head conversation 60 is absent, and all own turns are cut away
    c, h = next((c, zlib.crc32(str(c).encode()) % 4) for c in range(61, 80) if zlib.crc32(str(c).encode()) % 4)
    turns = [(c, k, "user", "w") for k in range(h)]
    assert {tuple(r) for r in trie.conversations_trie(spark.createDataFrame(turns, schema)).collect()} == {(c, 0, None, 1, 0, 1, 0, sha(str(c)))}


def leaks_by_hand(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if item is None else str(item))
    found = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for size in {len(v) for v in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    named |= windows[tuple(w[k : k + size])]
        found.append((doc, len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit)))
    return sorted(found, key=repr)


ITEMS = "item_id long, text string, words string"


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_leaks_by_definition(spark, monkeypatch, broadcast):
    """Windows at texts' ends, over block bounds of 64 words, with repeated shingles, short items, near misses, copies."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", (1 << 6, 1 << 8))  # nearly all is a false hit
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["é日", "ß", "x"]
    said = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    long, other = said(40), said(12)
    items = [(1, " ".join(long)), (2, " ".join(long)), (2, " ".join(other)), (10, "Alpha, BETA!"), (11, "gamma"), (12, " ".join(["a"] * 15)), (None, "one two three four"), (13, ""), (14, None), (15, "?!"), (16, " ".join(other[:11] + ["no"])), (9, "alpha beta")]
    docs = [" ".join(said(55) + long + said(9)), " ".join(long[5:15]), " ".join(long[5:14]), " ".join(said(60) + other), "alpha-beta gamma", "ALPHA beta", "alpha x beta", "a " * 9, "a " * 10, "a " * 300, "one two three four", "one two three", None, "", "...", "É日 é日", " ".join([*long[:9], "miss", *long[10:]]), " ".join(long * 20), "gammas"]
    rows = [(None if k == 3 else k % 15, t) for k, t in enumerate(docs)]
    table = spark.createDataFrame([(i, t, "x", "y", 1, "z", 2) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in decontaminate.contaminated(table, spark.createDataFrame([(i, t, "w") for i, t in items], ITEMS)).collect()), key=repr)
    assert got == leaks_by_hand(rows, items)


def test_leaks_without_items_or_documents(spark, edge, empty):
    none = spark.createDataFrame([], ITEMS)
    assert {(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contaminated(edge, none).collect()} == {(0, 0, sha(""), False)}
    some = spark.createDataFrame([(1, "two words", "w")], ITEMS)
    assert decontaminate.contaminated(empty, some).count() == 0
    assert decontaminate.contaminated(edge, some).filter("contaminated").count() == 4
