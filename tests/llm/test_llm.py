"""The pipeline operators against brute force, round trips and held-out rows, and
on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import os
import random
import re
import threading
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revana.llm import (chat, embedding_dedup, fingerprints, language_id, licenses, mixing, near_dedup, packing,
                        quality, queries, suffix_dedup)
from revana.llm.common import Rolling, components, groups

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def read(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet' ORDER BY 1").fetchall()


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


PROSE = "the quick brown fox jumps over the lazy dog and runs into the deep dark wood where nobody ever goes at night "
ODD = [None, "", " \n ", "!!! 123", PROSE, PROSE, PROSE * 300, "x" * 70_000, "naïve ünï 漢字かな " * 9, "a"]


# ---- language ------------------------------------------------------------------

def brute_profile(texts, size):
    n = Counter()
    for t in texts:
        p = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        for k in (1, 2, 3):
            for g in (p[i:i + k] for i in range(len(p) - k + 1)):
                if k == 3 and g[1] == " " or not g.strip():
                    continue
                n[g] += 1
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], [ord(c) << 0 for c in x[0]] and _packed(x[0])))][:size]


def _packed(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def test_ranks_equal_plain_counting_across_pieces(monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 50)
    for text in (PROSE * 3, "Ünï ñ ß!", "a", "漢字 x"):
        want = [_packed(g) for g in brute_profile([text], 400)]
        assert language_id.ranked(text, 400).tolist() == want


def test_language_held_out_and_distance(spark):
    rows = queries.op1_language_id(spark, SF).collect()
    truth = {r[0]: r[2] for r in read("documents")}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    want = brute_language(read("documents"), lambda i: zlib.crc32(str(i).encode()) % 4 != 2)
    got = {r.doc_id: r for r in rows}
    for (i, *_), (lang, score) in zip(read("documents"), want):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score)


def test_language_odd_texts(spark):
    df = documents(spark, ODD).withColumn("lang_pred", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.identify(df, F.lit(True)).collect()}
    assert len(got) == len(ODD) and [got[i].lang_pred for i in range(4)] == ["und"] * 4
    assert all(got[i].lang_pred == "en" for i in range(4, len(ODD)))
    nothing = language_id.identify(df, F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language_id.identify(df.limit(0), F.lit(True)).collect() == []


# ---- packing -------------------------------------------------------------------

def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[1] for r in read("documents")][:60] + [*ODD[:6], ODD[6], "a <|endoftext|> b", "  \t" * 50]
    rows = packing.pack(documents(spark, texts)).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert set(sequences) == set(range(len(sequences)))


def test_packed_sequences_hold_the_ids(spark):
    docs = documents(spark, [PROSE * 60, PROSE, "", None, "hello world"])
    packed = packing.pack(docs)
    from revana.workspace import materialise
    packed = materialise(packed, "packed")
    got = {r.sequence_id: r.ids for r in packing.sequences(docs, packed).collect()}
    ids = {r.doc_id: packing.encode(r.text).tolist() for r in docs.collect()}
    for r in packed.collect():
        assert got[r.sequence_id][r.offset:r.offset + r.length] == ids[r.doc_id][r.start:r.start + r.length]


def test_packing_empty_and_repeated(spark):
    assert packing.pack(documents(spark, []).limit(0)).collect() == []
    rows = packing.pack(documents(spark, [PROSE] * 500, ids=[7] * 500)).collect()
    assert len(rows) == 500 and len({(r.sequence_id, r.offset) for r in rows}) == 500


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_length_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(512, rng.lognormal(4.3, 1, 4000).astype(int) + 1)
    histogram = dict(Counter(lengths.tolist()))
    plan = packing.pack_histogram(histogram, 512)
    placed = Counter()
    for pattern, n in plan:
        assert sum(u * a for u, a in pattern.items()) <= 512 and n > 0
        for u, a in pattern.items():
            placed[u] += a * n
    assert placed == Counter(histogram)
    assert sum(n for _, n in plan) <= 1.01 * lengths.sum() / 512 + 2


def test_plan_is_found_beside_spark_and_tokenizers(spark):
    """The solver once stalled for good in a BLAS thread pool of such a process."""
    packing.pack(documents(spark, [PROSE] * 50)).collect()
    packing.encode(PROSE)
    for seed in range(10):
        rng = np.random.default_rng(seed)
        histogram = {u: int(n) for u, n in enumerate(rng.integers(1, 200, 512), start=1)}
        done = []
        solver = threading.Thread(target=lambda: done.append(packing.pack_histogram(histogram, 512)), daemon=True)
        solver.start()
        solver.join(60)
        assert done and sum(n for _, n in done[0]) <= 1.03 * sum(u * n for u, n in histogram.items()) / 512 + 2


def test_first_inverse():
    rng = np.random.default_rng(5)
    units, demand = np.arange(3, 200), rng.integers(1, 90, 197).astype(float)
    basis, rows = np.zeros((197, 197)), np.zeros(197, int)
    for k, (pattern, _, unit) in enumerate(packing.first_patterns(units, demand, 512)):
        basis[list(pattern), k], rows[k] = list(pattern.values()), unit
    inverse = packing._triangular_inverse(basis, rows)
    assert np.abs(np.einsum("ij,jk->ik", inverse, basis) - np.eye(197)).max() < 1e-9


# ---- fingerprints -----------------------------------------------------------------

def test_next_rows_by_descending_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PER_BUCKET", 3)
    ids = [5, 90, 7, 3, 1000, 8, 44, 2, 10, 11, 12, None]
    rows = [(i, f"t{i}") for i in ids]
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(
        spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"]).collect()}
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


def test_winnowing_equals_plain_windows_and_guarantees_matches(spark):
    rng = random.Random(3)
    words = [rng.choice("abcdefgh") for _ in range(400)]
    texts = [" ".join(words), "z z z " + " ".join(words[100:100 + fingerprints.MATCH_WORDS]) + " y y y", "a b", "", None, "a b"]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in df.select("doc_id", fingerprints.winnow(F.col("text")).alias("f")).collect()}
    hashes = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    h = [r[0] for r in hashes]
    grams = spark.createDataFrame([tuple(h[i:i + 5]) for i in range(len(h) - 4)], ",".join(f"c{k} long" for k in range(5)))
    g = [r[0] for r in grams.select(F.xxhash64(*grams.columns)).collect()]
    want = []
    for i in range(len(g) - fingerprints.WINDOW + 1):
        best = min(range(i, i + fingerprints.WINDOW), key=lambda p: ((g[p] & (2**64 - 1)) >> 33, -p))
        if best not in want:
            want.append(best)
    assert [f.position for f in got[0].f] == want and [f.hash for f in got[0].f] == [g[p] for p in want]
    assert {f.hash for f in got[0].f} & {f.hash for f in got[1].f}
    assert got[2].f == got[5].f and len(got[2].f) == 1 and got[3].f == [] == got[4].f


def test_fingerprint_query(spark):
    docs = [(r[0], r[1]) for r in read("documents")]
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    docs.reverse()
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    # Likeness against plain sets: the fingerprints of texts that Python edited.
    halves = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for (_, t), (_, n) in zip(docs, docs[1:] + docs[:1])]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([t for _, t in docs] + halves)], "k int, text string")
    sets = {r.k: set(r.winnowed) for r in fingerprints.fingerprints(df).collect()}
    n = len(docs)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, _) in enumerate(docs):
        assert got[i].near_edited == pytest.approx(like(sets[k], sets[n + k]))
        assert got[i].near_next == pytest.approx(like(sets[k], sets[(k + 1) % n]))


def test_a_kept_half_is_found_at_every_size(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(n)) for n in range(5, 41)]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (70, 300, 5000)]     # no blanks
    rows = [(i, t, " ".join(word() for _ in range(60)) + "".join(rng.choice("klmnop") for _ in range(3000))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, following string")
    df = fingerprints.fingerprints(df.withColumn("edited", fingerprints.half_edited(F.col("text"), F.col("following"))))
    edited = fingerprints.fingerprints(df, "edited", "edited_winnowed")
    near = fingerprints.likeness(F.col("winnowed"), F.col("edited_winnowed"))
    assert [r.doc_id for r in edited.select("doc_id", near.alias("near")).filter("near = 0").collect()] == []


# ---- chat ---------------------------------------------------------------------------

def test_chat_round_trip_and_digests(spark):
    turns = "conv_id long, turn long, role string, text string, part string"
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\||>", "", None, "naïve 漢字\n", "a<|b"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(nasty)]
    rows += [(None, 0, None, None, "x"), (2, 5, "assi\\stant\n<|", "t", "x"), (2, 5, "assistant", "same", "x"),
             (2, 5, "assistant", "same", "x"), (2, None, "user", "first", "x")]
    rows += [(3, i, "assistant", f"turn {i}", "x") for i in range(500)]
    df = spark.createDataFrame(rows, turns)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert set(got) == {None, 1, 2, 3}
    for conv in got:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        turn = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        loss = "".join(x for *_, r, x in own if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(turn.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = chat.format_chats(df).filter("conv_id = 3").collect()
    assert len(parts) > 1 and sum(len(p.formatted) for p in parts) == got[3].formatted_chars
    assert chat.format_chats(df.limit(0)).collect() == []


# ---- near-duplicates ---------------------------------------------------------------

def brute_components(links, nodes):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == brute_components(real, {n for e in real for n in e})


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    sets = [base[:900], base[100:], base[:3], base[:0]]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    out = near_dedup.sketch(np.concatenate(sets), at)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (out[:3] != full).all() and (out[3] == full).all()
    assert abs((out[0] == out[1]).mean() - 0.8) < 0.09


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, width):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    texts = []
    for i in range(60):                 # a large group, some members near the threshold
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(120)] = word()
        texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(40)) for _ in range(20)]
    texts += [None, "", " \t", "one two", "ONE two", "one two three four", "é É", "É é", texts[0], texts[0].upper()]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(documents(spark, texts), width=width).collect()}
    sets = []
    for t in texts:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).replace("\t", " ").split(" ") if x]
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and
             100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = brute_components(links, range(len(sets)))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(s), want[i], want[i] == i) for i, s in enumerate(sets)}


def test_near_duplicates_empty_and_null_ids(spark):
    assert near_dedup.near_duplicates(documents(spark, []).limit(0)).collect() == []
    rows = near_dedup.near_duplicates(documents(spark, [PROSE, PROSE, "", "other"], ids=[3, None, None, None])).collect()
    assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in rows) == sorted(
        map(str, [(3, 3, True), (None, 3, False), (None, None, True), (None, None, True)]))


def test_members_apart_meet_once_and_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 5)
    n, shared = 40, [3, 7]          # all are alike and apart; two bands are shared by all, one by half of them
    bands = [[1000 * k + (0 if k in shared else i % 2 if k == 9 else i + 1) for k in range(near_dedup.BANDS)] for i in range(n)]
    info = spark.createDataFrame([(i, 100, bands[i], b"x" * near_dedup.COORDINATES) for i in range(n)],
                                 "rep long, n_shingles long, bands array<long>, bins binary")
    rows = [(bands[i][k], i, i, i != 0 or k == 9, 100) for i in range(n) for k in (*shared, 9)]
    labelled = spark.createDataFrame(rows, "band long, rep long, root long, apart boolean, n_shingles long")
    place = near_dedup._PLACE

    def met(batches):
        for group in groups(batches, place):
            rep = group["rep"].to_numpy()
            for i, near in near_dedup._plausible_partners(group):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), rep[i])), pa.array(rep[near])], ["a", "b"])

    tiles = near_dedup._tiled(labelled).join(info, "rep").repartition(*place).sortWithinPartitions(*place)
    got = [tuple(sorted(r)) for r in tiles.mapInArrow(met, "a long, b long").collect()]
    assert sorted(got) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    largest = near_dedup._tiled(labelled).groupBy("band", "block", "tile").count().agg(F.max("count")).first()[0]
    assert largest <= 30            # about two times five, not all that are apart
    # A tile returns fewer links than it has members, whatever the number of pairs.
    texts = spark.createDataFrame([(i, PROSE) for i in range(n)], "doc long, text string")
    links = near_dedup._apart_links(labelled, info, texts, 4).collect()
    assert brute_components([(r.a, r.b) for r in links], range(n)) == dict.fromkeys(range(n), 0)
    assert len(links) < tiles.select(*place, "rep").distinct().count() - tiles.select(*place).distinct().count() + 1
    # Cut by shingles as well.
    monkeypatch.setattr(near_dedup, "TILE", 1000)
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", 1000)
    assert near_dedup._tiled(labelled).groupBy("band", "block", "tile").count().agg(F.max("count")).first()[0] <= 36


def test_alike_but_apart_texts_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 4)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, texts = [word() for _ in range(120)], []
    for i in range(70):             # most of them 60 to 85 % alike
        own = list(base)
        for at in rng.sample(range(120), rng.randrange(2, 7)):
            own[at] = word()
        texts.append(" ".join(own))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    sets = [{tuple(w[i:i + 4]) for i in range(117)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(70) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert got == brute_components(links, range(70))


# ---- mixing --------------------------------------------------------------------------

def test_mixture_meets_entropy_or_repeat_limit():
    sources = {"a": 1000, "b": 100, "c": 10, "none": 0}
    m = mixing.choose_mixture(sources, target=0.9, max_repeats=1e9)
    w = [m.weights[s] for s in "abc"]
    assert sum(w) == pytest.approx(1) and -sum(x * np.log(x) for x in w) == pytest.approx(0.9 * np.log(3), abs=1e-9)
    limited = mixing.choose_mixture(sources, target=0.9, max_repeats=4)
    assert max(1110 * limited.weights[s] / sources[s] for s in "abc") == pytest.approx(4, abs=1e-6)
    assert m.weights["none"] == 0 and mixing.choose_mixture({}).budgets == {}


def test_mix_realises_budgets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BUCKET", 7)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 30), "en", "big" if i % 4 else "small" if i % 8 else None, 1) for i in range(300)]
    rows += [(300, None, "en", "empty", 1), (301, "", "en", "big", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("weight", F.lit("clash"))
    mixed, m = mixing.mix(df)
    got = mixed.collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        per.setdefault("null" if r.source is None else "=" + r.source, []).append(r)
    for s, own in per.items():
        own.sort(key=lambda r: (r.place, r.n_tokens))
        total, at = sum(r.n_tokens for r in own), 0
        blocks, rest = divmod(m.budgets[s], total) if total else (0, 0)
        for r in own:
            assert r.place == at and r.copies == blocks + (r.place < rest)
            at += r.n_tokens
        used = sum(r.copies * r.n_tokens for r in own)
        assert m.budgets[s] <= used < m.budgets[s] + 30 or total == 0
    assert mixing.realise(mixed).count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0))[0].collect() == []


# ---- repeated passages ------------------------------------------------------------------

def brute_cut(texts):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i:i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if n[b[i:i + 200]] > 1:
                gone[i:i + 200] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()),
                    np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def cases(seed):
    rng = random.Random(seed)
    letters = lambda n, a="abcdefghijklmnop é\n": "".join(rng.choice(a) for _ in range(n))
    passage, short = letters(330), letters(150)
    texts = [letters(rng.randrange(0, 400)) + passage + letters(rng.randrange(0, 400)) for _ in range(25)]
    texts += [letters(100) + short + letters(100) for _ in range(25)]
    texts += [letters(50) + passage[k:k + 200 + k] for k in range(0, 120, 10)]
    same = letters(900)
    return texts + [same, same, same[:450], same[300:], "ab" * 700, "b" + "ab" * 500, "x" * 1500, "x" * 200, "x" * 199,
                    letters(500) * 2, "", None, "abc"]


@pytest.mark.parametrize("share,piece", [(2000, 2 << 20), (5, 700)])
def test_passages_equal_brute_force(spark, monkeypatch, share, piece):
    monkeypatch.setattr(suffix_dedup, "SHARE", share)
    texts = cases(share)
    rows = suffix_dedup.remove_repeats(documents(spark, texts).withColumn("kept", F.lit(1))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == dict(enumerate(brute_cut(texts)))


@pytest.mark.parametrize("seed", range(3))
def test_passages_single_in_one_share_and_repeated_in_another(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "SHARE", 2)
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    many = letters(50_000)
    best = int(np.argmin(Rolling(np.frombuffer(many.encode(), np.uint8)).grams(suffix_dedup.GRAM)))
    hot, texts = many[best:best + suffix_dedup.GRAM], []        # the anchor of nearly all strings around it
    for _ in range(8):
        after, before = letters(100), letters(100)
        texts += [letters(250) + hot + after + letters(250) for _ in range(3)]      # strings of exactly three places
        equal = before + hot + letters(100)
        texts += [letters(250) + equal, letters(260) + equal, letters(250) + before + hot + letters(250)]   # two equal contexts and one
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")       # so that the shares meet in tasks of their own
    try:
        rows = suffix_dedup.remove_repeats(documents(spark, texts)).collect()
    finally:
        spark.conf.unset(coalesce)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == dict(enumerate(brute_cut(texts)))


def test_long_texts_are_cut_in_pieces_alike(monkeypatch):
    rng = np.random.default_rng(0)
    import pyarrow as pa
    text = bytes(rng.integers(97, 100, 9000, dtype=np.uint8)).decode() + "x" * 3000
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["doc", "h", "text"])
    whole = [r for b in suffix_dedup._anchor_rows(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    pieces = [r for b in suffix_dedup._anchor_rows(iter([batch])) for r in b.to_pylist()]
    assert whole == pieces


@pytest.mark.parametrize("text", [b"", b"a", b"banana", b"mississippi" * 9, b"aaaaaaaa", bytes(range(256)) * 2, b"abab" * 60])
def test_suffix_array(text):
    assert suffix_dedup.suffix_array(text, len(text) + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    whole = suffix_dedup.suffix_array(text)
    for step in (1, 3, 7):
        wanted = np.arange(len(text)) % step == 0
        part = suffix_dedup.suffix_array(text, wanted=wanted)
        assert part[wanted[part]].tolist() == whole[wanted[whole]].tolist()


def test_passages_empty_repeated_and_null_ids(spark):
    assert suffix_dedup.remove_repeats(documents(spark, []).limit(0)).collect() == []
    long = PROSE * 3 + "".join(chr(97 + i * i % 26) for i in range(400))
    rows = suffix_dedup.remove_repeats(documents(spark, [long, long, "z" * 10], ids=[None, 4, 4])).collect()
    assert sorted(r.n_bytes - r.n_removed for r in rows) == [0, 0, 10]
    text = suffix_dedup.without_repeats(documents(spark, ["é" * 150 + "end", "ab" + "é" * 150, None])).orderBy("doc_id").collect()
    assert [r.text for r in text] == ["end", "ab", None]


# ---- licenses ---------------------------------------------------------------------------

def test_license_places_labels_and_blocks(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    filler = "word " * 100
    texts = [filler + gpl + filler, "CC-BY cc by  CC\nBY", "All rights reserved. all rights", None, "",
             filler + "licensed under the Apache License, Version 2.0; you may not use this file except in compliance",
             "ccby cc bye xcc by", "general", filler]
    got = licenses.summarise(licenses.scan_licenses(documents(spark, texts))).orderBy("doc_id").collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [
        (1, 107, 107, "gpl"), (3, 0, 4, "cc-by"), (1, 0, 0, "reserved"), (0, None, None, ""), (0, None, None, ""),
        (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, "")]
    assert [r.labels for r in got] == ["gpl", "cc-by", "reserved", "", "", "apache", "", "", ""]
    assert got[0].score == 1 and 0.8 <= got[5].score < 1 and got[8].score == 0
    assert licenses.scan_licenses(documents(spark, []).limit(0)).collect() == []


# ---- vectors -----------------------------------------------------------------------------

def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (1, 2):
        centres = rng.normal(size=(30, 16))
        for c in centres:
            rows += [(c + rng.normal(scale=0.15, size=16), label) for _ in range(rng.integers(1, 6))]
        rows += [(centres[0] + rng.normal(scale=0.05, size=16), label) for _ in range(80)]
        rows += [(rows[-1][0], label)] * 30
    rows = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 16]
    rows += [(n + i, v, None if i == 6 else 1) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    x = np.array([v for _, v, _ in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows[:n]])
    linked = (x @ x.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    want = brute_components([(int(a), int(b)) for a, b in zip(*np.nonzero(linked))], range(n + 7))
    count = [*linked.sum(1).tolist(), *[0] * 7]
    wrong = [i for i in range(n + 7) if (got[i].n_links, got[i].component_id) != (count[i], want[i])]
    assert len(got) == n + 7 and len(wrong) <= 0.03 * n
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).collect() == []


def _exact_components(rows, found):
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.93
    np.fill_diagonal(linked, False)
    want = brute_components([(int(a), int(b)) for a, b in zip(*np.nonzero(linked))], range(len(rows)))
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {
        i: (n, want[i]) for i, n in enumerate(linked.sum(1).tolist())}


@pytest.mark.parametrize("tile", [512, 20])
def test_vectors_of_two_dense_groups_are_linked_across(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(8)
    centre, aside = np.eye(48)[0], np.eye(48)[1]
    angle = np.arccos(0.945)
    groups = [centre, np.cos(angle) * centre + np.sin(angle) * aside]
    rows = [(60 * g + i, [float(x) for x in c + rng.normal(scale=0.008, size=48)], 1) for g, c in enumerate(groups) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    _exact_components(rows, embedding_dedup.near_duplicate_vectors(df).collect())


def test_vectors_are_all_compared_if_recall_stays_short(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 20)
    monkeypatch.setattr(embedding_dedup, "descend", lambda nodes, lists, k: lists or nodes.sparkSession.createDataFrame([], "p long, q long, sim double"))
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.eye(16)[i % 7] + rng.normal(scale=0.06, size=16)], 1) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    _exact_components(rows, embedding_dedup.near_duplicate_vectors(df).collect())


# ---- quality ------------------------------------------------------------------------------

def test_machine_scores_by_the_identity():
    rng = np.random.default_rng(1)
    model = quality.FactorisationMachine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 4)))
    ids, values = rng.choice(quality.FEATURES, 12, replace=False), rng.normal(size=12)
    z, _ = model.margins(np.array([0, 12]), ids, values)
    pairs = sum(model.factors[ids[i]] @ model.factors[ids[j]] * values[i] * values[j] for i in range(12) for j in range(i))
    assert z[0] == pytest.approx(0.3 + model.weights[ids] @ values + pairs)


def test_quality_learns_and_handles_odd_rows(spark):
    got = {r.doc_id: r for r in queries.op10_quality(spark, "/root/testdata/sf0.01").collect()}
    truth = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(got[i].score, q) for i, q in truth if got[i].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.8
    model = quality.fit(np.zeros(1, int), np.zeros(0, int), np.zeros(0), np.zeros(0))
    rows = quality.score(documents(spark, ODD).withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_training_rows_are_bounded_and_chosen_alike(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda starts, ids, values, labels: seen.append(np.asarray(labels).tolist()))
    texts = [f"text number {i} " * (1 + i % 5) for i in range(300)]
    docs = documents(spark, [*texts, *[f"hot {i}" for i in range(150)], "same", "same", None], ids=[*range(300), *[7] * 150, 8, 8, 9])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(7, 0, 1), (7, 0, 0), (7, 1, 1), (None, 1, 1), (5, None, 1)],
                                   "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    everything = 300 + 1 + 2 * 150 + 1 + 1          # with a label of each kind for 7, and 8 and 9 again
    for bound in (10_000, 100, 7, 0):
        quality.train(docs, labels, F.lit(True), bound)
        quality.train(docs.repartition(5), labels, F.lit(True), bound)
        assert seen[-1] == seen[-2] and len(seen[-1]) == min(bound, everything)
    quality.train(docs.limit(0), labels, F.lit(True))
    quality.train(docs, labels.limit(0), F.lit(True))
    assert seen[-2:] == [[], []]


def test_ids_of_texts_that_overflow_the_fast_matcher():
    text = "\n" * 3_000_000 + "x"
    assert packing._fast(text, packing._file("byte_bpe_50k.tiktoken")) is None
    ids = packing.encode(text)
    assert ids[-1] == packing.END_ID and len(ids) > 2 and packing._fast("x", packing._file("byte_bpe_50k.tiktoken")) == [87]


# ---- pipeline ---------------------------------------------------------------------------

def brute_language(rows, train):
    """Language and score of each text, by plain out-of-place distances."""
    texts = {}
    for i, text, lang, *_ in rows:
        if train(i) and lang is not None and text is not None:
            texts.setdefault(lang, []).append(text)
    profiles = {lang: {g: k for k, g in enumerate(brute_profile(t, 400))} for lang, t in texts.items()}
    out = []
    for _, text, *_ in rows:
        own = brute_profile([text], 400) if text else []
        if not own or not profiles:
            out.append(("und", 0.0))
            continue
        d = {lang: sum(abs(p[g] - i) if g in p else 400 for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(d), key=d.get)
        out.append((best, 1 - d[best] / (400 * len(own))))
    return out


def brute_near_copies(rows, width):
    """The rows that stay: the first of each component by (id, null last), and those without words."""
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    first, out = {}, []
    for i, c in brute_components(links, range(len(rows))).items():
        if not sets[i]:
            out.append(rows[i])
        elif c not in first or (rows[i][0] is None, rows[i][0] or 0) < (first[c][0] is None, first[c][0] or 0):
            first[c] = rows[i]
    return [*out, *first.values()]


def brute_passages(rows):
    out = []
    for row, (_, removed, _, kept) in zip(rows, brute_cut([r[1] for r in rows])):
        text = row[1] if not removed else kept.decode(errors="ignore")
        if not removed or text.strip(" "):
            out.append((row[0], text, *row[2:4], None if text is None else len(text)))
    return out


def pipeline_rows():
    rng = random.Random(9)
    docs = read("documents")
    prose = [(r[1], r[2]) for r in docs if 60 < len(r[1].split()) < 150 and r[2]][:24]
    shared = " ".join(prose[0][0].split()[:60])
    texts = [(t, lang) for t, lang in prose]
    texts += [(t + " one more", lang) for t, lang in prose[:8]]                 # near copies
    texts += [(prose[1][0], prose[1][1])] * 3                                   # copies
    texts += [(f"{a} {shared} {b}", lang) for (a, lang), (b, _) in zip(prose[8:14], prose[14:20])]
    texts += [("".join(rng.choice("0123456789#$%/") for _ in range(200)), "en") for _ in range(3)]
    texts += [("".join(chr(rng.randrange(0x4e00, 0x9000)) for _ in range(80)), "en"), (None, "en"), ("", None), (" \n", None)]
    texts += [(prose[2][0], None), ("kurz", "de")]
    rows = []
    for i, (text, lang) in enumerate(texts):
        source = None if i % 11 == 5 else "hot" if i % 3 else f"s{i % 4}"
        rows.append((None if i in (30, 33) else i, text, lang, source, None if text is None else len(text)))
    return rows


def test_pipeline_equals_plain_python(spark, tmp_path, monkeypatch):
    rows = pipeline_rows()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    made = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            made[name] = sorted(map(tuple, out.collect()), key=repr)
            return out
        return run

    plain = [(n, s) for n, s in corpus_pipeline.STAGES]
    assert [n for n, _ in plain] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "packing"]
    before = set(os.listdir("/tmp/checkpoints")) if os.path.isdir("/tmp/checkpoints") else set()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(n, s)) for n, s in plain])
    packed = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    if before:
        left = {n.rsplit("-", 1)[0] for n in set(os.listdir("/tmp/checkpoints")) - before}
        assert not left & {"sketches", "info", "candidates", "contexts", "anchors", "pieces", "language_id", "near_dedup"}
    key = lambda r: sorted(r, key=repr)

    named = brute_language(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 != 2)
    kept = [r for r, (lang, score) in zip(rows, named) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE]
    assert made["language_id"] == key(kept) and len(kept) < len(rows) - 5
    kept = brute_near_copies(kept, corpus_pipeline.SHINGLE)
    assert made["near_dedup"] == key(kept)
    kept = brute_passages(kept)
    assert made["suffix_dedup"] == key(kept)

    tokens = Counter()
    for r in kept:
        tokens[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    mixture = mixing.choose_mixture({str(s): n for s, n in tokens.items()})
    used = Counter(made["mixing"])
    assert set(used) <= set(kept)
    for s, total in tokens.items():
        blocks, rest = divmod(mixture.budgets[str(s)], total)
        own = [r for r in kept if r[3] == s]
        assert all(used[r] in (blocks, blocks + 1) for r in own)
        more = sum(len((r[1] or "").split()) for r in own if used[r] == blocks + 1)
        assert rest <= more < rest + max(len((r[1] or "").split()) for r in own) + 1
    ids = {r: packing.encode(r[1]) for r in used}
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in packed if r["start"] == 0) == Counter(
        {k: sum(n for r, n in used.items() if (r[0], len(ids[r])) == k) for k in {(r[0], len(ids[r])) for r in used}})
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert any(r["doc_id"] == d[0] and zlib.crc32(i[r["start"]:r["start"] + r["length"]]) == r["ids_crc32"] for d, i in ids.items())
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist()
        assert sum(n for _, n in own) <= 2048
    assert sum(r["length"] for r in packed) == sum(len(ids[r]) * n for r, n in used.items())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "a b c", "en", "s", 5)] * 3])
def test_pipeline_of_few_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ({1} if len(rows) == 3 else set())


def test_near_copies_with_repeated_and_null_ids(spark):
    near, own = PROSE * 6, " ".join(f"w{i}" for i in range(60))
    texts = [near, near + "end", own, near, near, own + " x y", None, "", " "]
    ids = [5, 7, 7, None, 7, None, 1, None, None]
    got = corpus_pipeline.one_of_near_copies(spark, documents(spark, texts, ids=ids), SF).collect()
    key = lambda rows: sorted(map(repr, rows))
    assert key((r.doc_id, r.text) for r in got) == key([(5, near), (7, own), (1, None), (None, ""), (None, " ")])
    copies = corpus_pipeline.one_of_near_copies(spark, documents(spark, [own] * 3, ids=[4, 4, None]), SF).collect()
    assert [(r.doc_id, r.text) for r in copies] == [(4, own)]
