"""Jaccard join, prefix trie and structure repair against SQL and against definitions written out."""

import glob
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from stockloom.llm import jaccard_join, oracle, prefix_trie, queries, turn_repair

SF = "/root/testdata/sf0.01"
LONG = "lorem ipsum dolor sit amet consectetur " * 4_000


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def rows_of_sql(sql, **tables):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, (ddl, rows) in tables.items():
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT 1")
        con.execute(f"DROP VIEW {name}")
        con.execute(f"CREATE TABLE {name} ({ddl})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=str)


@pytest.mark.parametrize("name", ["op11_jaccard_join", "op12_prefix_trie", "op13_turn_repair"])
def test_whole_tables_match_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of_sql(queries.SQL[name])


# --- Jaccard join -------------------------------------------------------------------------------

def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def slow_classes(docs):
    """Components over rows, all pairs compared."""
    sets = [shingles(t) for _, t in docs]
    low = list(range(len(docs)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            low[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((least.get(root(i)), doc_id, len(sets[i])) for i, (doc_id, _) in enumerate(docs)), key=str)


def near_copies(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            w[at:at + 1] = rng.choice([[], ["new%d" % rng.randrange(10**6)], [w[at], "more%d" % rng.randrange(10**6)]])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("group", "frequent"), [(10_000, 1 << 15), (7, 1 << 15), (10_000, 0), (5, 40)])
def test_jaccard_classes(spark, monkeypatch, group, frequent):
    """Groups of near copies, a passage that all share, and every bound small enough to matter."""
    monkeypatch.setattr(jaccard_join, "STRETCH", 5)
    rng = random.Random(5)
    texts = []
    for size, n, edits in ((60, 40, 6), (45, 25, 2), (300, 12, 14), (9, 10, 1), (4, 6, 1)):
        texts += near_copies(rng, ["w%d" % rng.randrange(500) for _ in range(size)], n, edits)
    passage = " ".join("p%d" % i for i in range(40))
    texts += [passage + " " + " ".join("q%d" % rng.randrange(10**6) for _ in range(k % 12)) for k in range(30)]
    texts += [texts[0]] * 15 + [texts[3].upper(), "", None, " \t\n", None, "one two", "One  TWO", "one", LONG, LONG + "x"]
    docs = list(enumerate(texts, 100)) + [(None, texts[7]), (None, "nameless text of five words"), (100, "another text with the id of the first one"), (100, texts[0])]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, node long, tokens int").repartition(3)
    got = sorted(((r.component_id, r.doc_id, r.n_shingles) for r in jaccard_join.classes(df, frequent_tokens=frequent, group=group).collect()), key=str)
    assert got == slow_classes(docs)


def test_jaccard_orders_and_empty(spark):
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))
    orders = jaccard_join.Orders([int(t) for t in x[5:8]])
    for r in range(jaccard_join.ORDERS):
        whole = orders.prefix(x, r, 0)[:200]
        assert whole[-3:].tolist() == x[5:8].tolist() and len(orders.prefix(x, r)) == jaccard_join.prefix_length(len(x))
        near = np.concatenate([x[16:], np.arange(16, dtype=np.uint64)])  # 184 of 216 tokens: at the threshold
        near.sort()
        assert np.isin(orders.prefix(x, r), orders.prefix(near, r)).any()
    for _ in range(50):
        y, z = (np.unique(rng.choice(rng.integers(0, 1 << 63, 3_000).astype(np.uint64), rng.integers(1, 2_000))) for _ in range(2))
        y = np.unique(np.concatenate([y, z[rng.integers(0, len(z)):]]))
        similar = 100 * len(np.intersect1d(y, z)) >= 85 * len(np.union1d(y, z))
        assert jaccard_join._may_pass(*(jaccard_join._read_bitmap(jaccard_join._bitmap(s)) for s in (y, z)), 85) or not similar
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.classes(empty).collect() == []
    assert jaccard_join.tokens_of(LONG.encode()).tolist() == jaccard_join.tokens_of((LONG * 20).encode()).tolist()


# --- prefix trie --------------------------------------------------------------------------------

CONVERSATIONS = "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR"


def odd_conversations(seed, n=90):
    """Shared beginnings, copies, absent first conversations, null cells, ties, repeated rows, negative ids."""
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-45, 150), n):
        kind = rng.randrange(4)
        for t in range(rng.randrange(1, 6)):
            text = {0: f"Turn {t}.", 1: f"Turn {t} of {c % 3}!", 2: rng.choice(["", None, "  \n", "same words here", "Same words here?"]), 3: f"a b c {rng.randrange(9)}"}[kind]
            out.append((c, rng.choice([t, t, t, t, None, 2]), rng.choice(["user", "assistant"]) if kind == 3 else ("system", "user", "assistant", None, "")[(t + c) % 5] if kind == 2 else ("user", "assistant")[t % 2], text))
    out += [(7, 0, "user", "Turn 0.")] * 3 + [(1000, 0, "user", LONG), (1000, 1, "assistant", "é 漢字 😀."), (1001, 0, "user", LONG)]
    return out


@pytest.mark.parametrize("shard", [20, 2_000])
def test_trie_matches_sql(spark, shard):
    rows = odd_conversations(1) + [(None, 1, "user", "no conversation")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, path int, depth int").repartition(5)
    assert rows_of(prefix_trie.trie(df, shard)) == rows_of_sql(oracle.PREFIX_TRIE, conversations=(CONVERSATIONS, rows))


def test_trie_of_many_copies_and_a_long_conversation(spark):
    """One conversation in a thousand copies, and one of thousands of turns, against sums written out."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"hello there {t}") for c in range(3_000, 4_000) for t in range(3)]
    rows += [(5_005, t, "user", f"turn number {t}") for t in range(5_000)]
    got = {(r.conv_id, r.depth): r for r in prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 200).collect()}
    head = {c: zlib.crc32(str(c).encode()) % 4 for c in (*range(3_000, 4_000), 5_005)}
    root = got[3_000, 0]
    assert (root.n_convs, root.parent_conv_id, root.n_children, root.n_leaves, root.saved_tokens) == (1_001, None, 2, 2, 999 * 9)
    leaf = got[3_000, 3]
    assert (leaf.n_convs, leaf.parent_conv_id, leaf.n_children, leaf.n_leaves, leaf.saved_tokens) == (1_000, 3_000, 0, 1, 999 * 3)
    assert leaf.ends_sha256 == sha(",".join(map(str, range(3_000, 4_000)))) and root.ends_sha256 == sha("")
    assert len(got) == 1 + 3 + 5_000 - head[5_005]  # its group has no first conversation
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# --- structure repair ---------------------------------------------------------------------------

def slow_repair(rows):
    """Cheapest edits by the states of the grammar, from the end, whole audits compared."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    after = {0: (0, ""), 3: (0, "")}
    for i in range(len(rows), -1, -1):
        now = after
        if i < len(rows):
            code = chr(rows[i])
            cut, now = 3 * code.isupper(), {}
            for q in range(4):
                options = [(after[q][0] + 4, "D" + after[q][1])]
                for c in () if code == "d" else {code.lower(), "u", "a"}:
                    if (q, c) in step and (c == code.lower() or c in "ua"):
                        rest = after[step[q, c]]
                        options.append((rest[0] + cut + (0 if c == code.lower() else 3), ("K" if c == code.lower() else "R") + rest[1]))
                now[q] = min(options)
        for _ in range(3):
            for (q, c), to in step.items():
                if c != "s" and to in now:
                    now[q] = min(([now[q]] if q in now else []) + [(now[to][0] + 3, "I" + now[to][1])])
        after = now
    return after[0]


def test_repair_is_the_cheapest_and_least():
    for n in range(4):
        for rows in itertools.product(b"suaoSUAOd", repeat=n):
            assert turn_repair.repair(bytes(rows)) == slow_repair(bytes(rows))
    rng = random.Random(3)
    for _ in range(400):
        rows = bytes(rng.choices(b"suaoSUAOd", [1, 6, 6, 1, 1, 1, 1, 1, 2], k=rng.randint(4, 90)))
        assert turn_repair.repair(rows) == slow_repair(rows)


def test_repair_of_a_long_conversation():
    rows = bytes(random.Random(4).choices(b"suaUAd", [1, 60, 60, 3, 3, 9], k=2_000))
    assert turn_repair.repair(rows) == slow_repair(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repairs_match_sql(spark, seed):
    rows = odd_conversations(seed) + [(None, 1, "user", "No conversation."), (None, None, None, None), (None, 3, "tool", "Text")]
    rows += [(2_000 + c, t, ("system", "user", "assistant", "user")[t], "Whole. " * t) for c in range(60) for t in range(4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, gone int").repartition(5)
    got = rows_of(turn_repair.repairs(df))
    assert got == rows_of_sql(oracle.TURN_REPAIR, conversations=(CONVERSATIONS, rows))
    dropped = [c for c in {r[0] for r in rows} if all(zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 == 0 for d, t, *_ in rows if d == c)]
    empty = [r for r in got if r[4] in dropped]
    assert len(got) == len({r[0] for r in rows}) and all(r[0] == "" and r[-2] == sha("") for r in empty)
    assert turn_repair.repairs(df.limit(0)).collect() == []


def test_repairs_by_hand(spark):
    """Texts of all kinds of edits, of rows that are not damaged further."""
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "user", "Hello?"), (1, 3, "assistant", "No end"),
            (2, 0, "assistant", "First."), (2, 5, "tool", "Out."), (3, 0, "user", " \t"), (4, 0, "system", "Alone.")]
    df = spark.createDataFrame([(*r, False) for r in rows], "conv_id long, turn long, role string, text string, gone boolean")
    got = {r.conv_id: r for r in turn_repair.repaired(df).collect()}
    assert tuple(got[1])[1:8] == (0, 0, 1, 1, 1, 7, "KKDK") and got[1].repaired_sha256 == sha("system:Be kind.\nuser:Hello?\nassistant:No end")
    assert (got[2].gaps, got[2].illegal, got[2].cost, got[2].audit) == (4, 1, 6, "RR") and got[2].repaired_sha256 == sha("user:First.\nassistant:Out.")
    assert (got[3].blank, got[3].cost, got[3].audit, got[3].repaired_sha256) == (1, 4, "D", sha(""))
    assert (got[4].cost, got[4].audit, got[4].repaired_sha256) == (4, "D", sha(""))
