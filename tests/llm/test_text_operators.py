"""Decontamination, SimHash, tokens, packing and the pipeline against definitions written out row by row."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from stockloom.llm import common, components, decontamination, packing, queries, secrets, simhash, tokens

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor " * 4_000
#: Nulls, an empty text, ties and repeats, a very long text, and columns whose names clash with results.
ODD = [(1, "The Quick brown fox jumps over the lazy dog. " * 4, "a", 1), (1, "The Quick brown fox jumps over the lazy dog. " * 4, "a", 1),
       (None, None, None, None), (2, "", "b", 2), (None, "quick brown fox", "c", 3), (3, LONG, None, 4), (4, " \t\n ", "d", 5),
       (5, "éÉ ñandú 漢字 😀 <|endoftext|> don't!!", "e", 6), (5, "another text under the same id", "f", 7)]
SCHEMA = "doc_id long, text string, items string, fp long"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contaminated(docs, bench, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows = defaultdict(set)
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i:i + size])].add(item)
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i:i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    items |= owners
        ids = sorted(str(i) for i in items if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [10_000_000, 150])
def test_decontamination(spark, block):
    rng = random.Random(1)
    item = " ".join(rng.choice("abcdefgh") for _ in range(40))
    bench = [(1, item), (2, "One-two THREE"), (3, None), (4, "?!"), (2, "One-two THREE"), (None, "nameless item words here"), (5, "x")]
    docs = [(1, "start " + item[10:70] + " end " * 30), (2, "one two three one two, three one TWO three"), (3, None), (3, None), (4, ""), (5, item.upper()),
            (None, "nameless item words here"), (6, "x " * 300 + item), (7, "y " * 50)]
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), 13, block)
    assert sorted(map(tuple, got.collect()), key=str) == contaminated(docs, bench)


def test_decontamination_keeps_all_columns(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog the quick brown fox")], "item_id long, text string")
    kept = decontamination.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("items <> 'a' OR items IS NULL").collect()))
    assert decontamination.contamination(docs, bench.limit(0)).filter("n_hit > 0").isEmpty()
    assert decontamination.contamination(docs.limit(0), bench).isEmpty()


def slow_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_over_texts(spark):
    got = simhash.near_duplicates(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(got) == len(ODD)
    prints = sorted((str(r[0]), f"{slow_fingerprint(r[1]):016x}") for r in ODD)
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == prints
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {2}
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_simhash_links_and_components_match_brute_force(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values):
        for _ in range(8):
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                v ^= 1 << b
            values.append(v)
    values = sorted({simhash._signed(v) for v in values})
    pairs = {(a, b) for i, a in enumerate(values) for b in values[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    found = simhash.links(fps)
    assert sorted(map(tuple, found.collect())) == sorted(pairs)
    want = closed(pairs, {n for p in pairs for n in p})
    assert {r.fp: r.component for r in simhash.groups(fps).collect()} == want


def test_no_exploded_fingerprints_in_the_driver(spark):
    """64 rows a fingerprint, which Spark takes for no more than the file they came from."""
    plan = simhash.links(common.written(spark.createDataFrame([(1,), (3,)], "fp long"), "prints"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(0, 90)] + [(200, 150), (150, 200), (7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(91)}, 150: 150, 200: 150}


def test_pipeline_tables_that_grow_with_documents_stay_out_of_the_driver(spark, monkeypatch):
    plans = {}

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return common.written(df, label)

    monkeypatch.setattr(simhash, "written", seen)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "x y z")], "doc_id long, text string")
    assert {r.doc_id for r in simhash.without_near_duplicates(docs).collect()} == {1, 3}
    assert re.search("LeftSemi|SortMergeJoin", plans["kept"]) and not re.search(r"BroadcastHashJoin \[coalesce\(doc_id", plans["kept"])
    parts = spark.createDataFrame([(1, "k", 0, 5, "account", True)], "key long, kind string, start long, end long, role string, weak boolean")
    assert "Broadcast" not in secrets.linked(common.written(parts, "parts"), ["key"], 60)._jdf.queryExecution().executedPlan().toString()


def test_simhash_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "5", "5", "None"]  # two texts under one id
    nameless = simhash.without_near_duplicates(spark.createDataFrame([(None, "a b c d e")] * 3 + [(None, "other words in here")], "doc_id long, text string"))
    assert nameless.count() == 2


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def encoded(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(1)
    parts = ["a", "B", "é", "É", " ", "\n", "'s", "'", "n't", ".", ",", "!", "1", "٣", "<|endoftext|>", "<|ENDOFTEXT|>", "́", "\xa0", "\x1c", "İ", "Σ", "漢字", "ก็",
             "J̌", "\x85", "ﬁ", "_", "ª"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4_000)] + [None, "", LONG]
    got = tokens.Encoder(TOKENIZER).encode([None if t is None else t.encode() for t in texts])
    assert all((np.frombuffer(g, "<u2") == encoded(tokenizer, t)).all() for g, t in zip(got, texts, strict=True))


def test_encoder_equals_the_library_in_small_groups_and_caches(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 60)
    monkeypatch.setattr(tokens, "GROUP", 40, raising=False)
    rng = random.Random(2)
    parts = ["a", "b", "S", "ß", "ÿ", "ñ", "Ñ", "À", "×", "÷", "µ", "\xad", "ö", "\xa0", " ", "  ", "\t", "\x0b", "\n", ".", "'", "Ā", "\u0308", "<|", "7"]
    texts = [rng.choice(["", " "]) + "".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(3_000)] + ["", None, " ", None]
    encoder = tokens.Encoder(TOKENIZER)
    got = [g for i in range(0, len(texts), 700) for g in encoder.encode([None if t is None else t.encode() for t in texts[i:i + 700]])]
    assert all((np.frombuffer(g, "<u2") == encoded(tokenizer, t)).all() for g, t in zip(got, texts, strict=True))
    assert list(encoder.encode([])) == [] and list(encoder.encode([b"a\xff b", b"\xe2\x82"])) == list(encoder.encode(["a\ufffd b".encode(), "\ufffd".encode()]))


def test_encoder_keeps_words_in_use(tokenizer, monkeypatch):
    sent = Counter()

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            sent.update(w for t in texts for w in t.split())
            return self.inner.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokens, "CACHE", 200)
    encoder = tokens.Encoder(TOKENIZER)
    encoder.tokenizer, encoder.plain = Counting(tokenizer), Counting(getattr(encoder, "plain", tokenizer))
    rng = random.Random(3)
    for _ in range(50):
        text = "kept, kept; wörter WORD " + " ".join("".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(40))
        assert (np.frombuffer(next(encoder.encode([text.encode()])), "<u2") == encoded(tokenizer, text)).all()
    assert sent["kept"] == sent["wörter"] == sent["word"] == 1
    assert len(encoder.known) <= 200


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_001, dtype=np.uint64).astype(np.uint32)
    data = tokens.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    for a, b in ((0, len(ids)), (5, 5), (3, 4), (1_001, 69_999)):
        assert (tokens.unpack(data, bits, a, b) == ids[a:b]).all()


def test_token_files(spark, tokenizer, tmp_path):
    got = tokens.token_files(spark.createDataFrame(ODD, SCHEMA), TOKENIZER, str(tmp_path / "ids")).collect()
    want = sorted((str(r[0]), len(encoded(tokenizer, r[1])), zlib.crc32(encoded(tokenizer, r[1]).tobytes())) for r in ODD)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    assert tokens.token_files(spark.createDataFrame([], SCHEMA), TOKENIZER).isEmpty()


def whole_pieces(rows, texts, tokenizer):
    """Every id in one piece, checksums right, sequences without gaps; the padding."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        documents[r.doc_id].append(r)
    for doc_id, text in texts.items():
        ids, at = encoded(tokenizer, text), 0
        for r in sorted(documents[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        padding += packing.WINDOW - at if at & (at - 1) else 0
    return padding


def test_packing(spark, tokenizer):
    rows = queries.op4_packing(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert whole_pieces(rows, docs, tokenizer) == 0
    odd = packing.packed(spark.createDataFrame(ODD, SCHEMA), TOKENIZER).collect()
    assert sum(r.length for r in odd) == sum(len(encoded(tokenizer, r[1])) for r in ODD)
    assert packing.packed(spark.createDataFrame([], SCHEMA), TOKENIZER).isEmpty()


def test_least_squares_packs_what_fits():
    counts = np.zeros(packing.WINDOW, int)
    counts[[3000, 1096, 2048, 1100, 2000]] = [50, 50, 10, 7, 7]
    shares = packing.plan(counts)
    by = {c: round(s * counts.sum()) for c, s in shares}
    assert by[3000, 1096] == 50 and by[2048, 2048] == 5
    pieces = packing.pack_lengths(np.repeat(np.flatnonzero(counts), counts[counts > 0]), shares)
    assert len(pieces) == 124 + np.sum(pieces[:, 1] > 0)


def test_unrelated_texts_of_one_id_all_stay(spark):
    """Rows go by the group of their own text, whatever other rows have their doc_id."""
    texts = ["alpha beta gamma delta epsilon", "one two three four five six seven", "red green blue yellow black white"]
    rows = [(1, texts[0], "a"), (1, texts[1], "b"), (2, texts[2], "c"), (1, texts[1], "b"), (3, texts[1], "d"), (None, texts[2], "e"), (4, "", "f"), (4, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(map(tuple, kept.collect()), key=str)
    assert [r[:2] for r in got if r[1]] == [(1, texts[0]), (1, texts[1]), (2, texts[2])]
    assert len(got) == 4 and got[-1][0] == 4  # an empty and a null text have one fingerprint


def test_pipeline_is_its_stages(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    language = corpus_pipeline.known_language(spark, docs, SF)
    assert language.columns == columns and language.count() == len(rows)
    unique = corpus_pipeline.near_duplicates(spark, docs, SF)
    fps = {i: slow_fingerprint(r.text) for i, r in rows.items()}
    ids = sorted(rows)
    label = closed({(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (fps[a] ^ fps[b]).bit_count() <= 4}, ids)
    assert unique.columns == columns and {r.doc_id for r in unique.collect()} == set(label.values())
    clean = corpus_pipeline.decontaminated(spark, docs, SF)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([(i, r.text) for i, r in rows.items() if i % 5 == 0], bench) if r[-1]}
    assert clean.columns == columns and {r.doc_id for r in clean.filter("doc_id % 5 = 0").collect()} == {i for i in ids if i % 5 == 0} - bad
    masked = {r.doc_id: r for r in corpus_pipeline.secrets_masked(spark, docs, SF).collect()}
    spans = {r.doc_id: r.spans for r in secrets.report(docs).collect()}
    for i, r in rows.items():
        text, end = "", 0
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s):
            if a >= end:
                text += r.text[end:a] + secrets.MARK
            end = max(end, b)
        assert masked[i].text == text + r.text[end:] and (masked[i].n_chars == len(masked[i].text) or not spans[i])
    result = corpus_pipeline.run(spark, SF)
    kept = set(label.values()) - {r[0] for r in contaminated([(i, rows[i].text) for i in set(label.values())], bench) if r[-1]}
    assert whole_pieces(result.collect(), {i: masked[i].text for i in kept}, tokenizer) == 0
    assert {r.doc_id for r in result.select("doc_id").distinct().collect()} == kept


def test_pipeline_stages_on_odd_rows(spark):
    odd = spark.createDataFrame([(*r[:2], "en", "s", len(r[1] or ""), *r[2:]) for r in ODD],
                                "doc_id long, text string, lang string, source string, n_chars long, items string, fp long")
    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
        assert corpus_pipeline.packed(spark, docs, SF).count() >= 0
