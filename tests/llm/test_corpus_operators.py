"""The ten corpus operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import bwt, compression, decontaminate, jaccard_join, line_dedup, mixing, repeats, sharding, token_counts, toxicity, url_filter
from tessera.llm import textkit as tk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "tu", "sha", "ven", "dor") for b in ("n", "ra", "sti", "mo", "x", "lum", "ek")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCAB) + str(rng.randint(0, 60)) for _ in range(n))


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and columns named like results."""
    long = " ".join(["word"] * 60_000)
    rows = [(None, "text without an id here", None, None, None), (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n ", None, "a", 3), (4, long, "en", "a", len(long)), (5, "same row", "en", "b", 8), (5, "same row", "en", "b", 8), (5, "other text of the same id", "en", "b", 9), (6, "ünïcödé ☃ text", "de", "b", 14)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("shard", "score", "toxic", "tokens", "hi", "lo", "rep", "anchor", "digest", "id", "place", "item_id", "n_tokens"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_are_what_the_pattern_says():
    texts = ["The  Quick\nbrown", "", None, "É a b", " x ", "one"]
    w = tk.words(pa.array(texts))
    assert list(w.counts) == [3, 0, 0, 2, 1, 1]
    seen = {}
    for i in range(len(w.hash)):
        s = w.data[w.start[i] : w.end[i]].tobytes()
        assert seen.setdefault(s, w.hash[i]) == w.hash[i]
    assert len(set(seen.values())) == len(seen)


# 1 sharding


def brute_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_loop_and_moves_little():
    keys = np.random.default_rng(0).integers(0, 1 << 60, 3000)
    a, b = sharding.jump(keys, 100), sharding.jump(keys, 110)
    assert a.tolist() == [brute_jump(int(k), 100) for k in keys]
    moved = a != b
    assert set(b[moved]) <= set(range(100, 110)) and 0.06 < moved.mean() < 0.13
    assert sharding.jump(keys, 1).max() == 0


def test_shards_of_odd_rows(odd, nothing):
    got = sharding.shard(odd, shards=7)
    assert got.columns == odd.columns
    rows = got.select("doc_id", "shard").collect()
    assert [r.shard for r in rows if r.doc_id is None] == [None]
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1 and all(0 <= r.shard < 7 for r in rows if r.doc_id is not None)
    assert sharding.shard(nothing).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(odd, shards=0)


# 2 compression


def test_compression_matches_brute_force(spark, odd, nothing):
    rng = random.Random(1)
    noise = "".join(chr(rng.randint(33, 126)) for _ in range(6000))
    texts = [prose(rng, 300), "again and again " * 900, noise, prose(rng, 20), prose(rng, 2500), prose(rng, 700) + " spam" * 6000]
    rows = {r.doc_id: r for r in compression.compression_bands(docs_of(spark, texts)).collect()}
    assert [rows[i].verdict for i in range(6)] == ["keep", "repetitive", "incompressible", "keep", "keep", "repetitive"]
    z = zstandard.ZstdCompressor(level=compression.LEVEL, write_checksum=False, write_content_size=False)
    for i, t in enumerate(texts):
        d = t.encode()
        assert rows[i].ratio == len(d) / len(z.compress(d))
        hi = [len(c) for k in range(0, len(d), 4096) if (c := d[k : k + 4096]) and compression.band(len(c)) and len(c) / len(z.compress(c)) > compression.band(len(c))[1]]
        assert rows[i].high_share == pytest.approx(sum(hi) / len(d) if len(d) > 4096 else 0)
    got = compression.compression_bands(odd).collect()
    assert len(got) == 9 and all(r.verdict == "keep" and r.ratio is None for r in got if r.n_bytes == 0)
    assert compression.compression_bands(nothing).count() == 0


# 3 mixing


def brute_mix(rows, weights, budget):
    from hashlib import md5

    key = lambda d: int(md5(f"mix{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    by = defaultdict(list)
    for d, s, n in rows:
        by[s].append((key(d), -1 if d is None else d, n, s))
    done = []
    for s, group in by.items():
        used = 0
        for k, d, n, _ in sorted(group):
            used += n
            if weights.get(s or "", 1.0) > 0:
                done.append((used / weights.get(s or "", 1.0), k, d, n))
    out, total = [], 0
    for _, _, d, n in sorted(done):
        total += n
        if total > budget:
            break
        out.append(d)
    return out


def test_mix_matches_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(300)]
    docs = docs_of(spark, texts)
    w = {"src0": 5.0, "src1": 1.0, "src2": 0.0}
    rows = [(i, f"src{i % 3}", len(t.split())) for i, t in enumerate(texts)]
    got = [r.doc_id for r in mixing.mix(docs, budget=1500, weights=w).orderBy("total", "finish").collect()]
    assert sorted(got) == sorted(brute_mix(rows, w, 1500))
    kept = mixing.select_documents(docs, budget=1500, weights=w)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(got)
    sums = Counter()
    for r in mixing.mix(docs, budget=900, weights=w).collect():
        sums[r.source] += r.tokens
    assert 4 < sums["src0"] / sums["src1"] < 6 and "src2" not in sums


def test_a_null_source_is_not_the_empty_one(spark):
    rows = [(i, "a b c d", None if i % 2 else "", i) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = mixing.mix(docs, budget=10**6).collect()
    for s in (None, ""):
        assert sorted(r.finish for r in got if r.source == s) == [4.0, 8.0, 12.0, 16.0]
    some = brute_mix([(i, s, 4) for i, _, s, _ in rows], mixing.WEIGHTS, 20)
    assert sorted(r.doc_id for r in mixing.select_documents(docs, budget=20).collect()) == sorted(some) and len(some) == 5


def test_mix_of_odd_rows(odd, nothing):
    every = mixing.mix(odd, budget=10**9).collect()
    assert len(every) == 9 and max(r.total for r in every) == 60_000 + 5 + 2 + 2 + 6 + 3
    assert mixing.select_documents(odd, budget=10**9).count() == 9
    assert mixing.mix(odd, budget=-1).count() == 0 and mixing.mix(nothing).count() == 0


# 4 repeats


def brute_spans(texts, k):
    where = defaultdict(set)
    ws = [(t or "").lower().split() for t in texts]
    for d, w in enumerate(ws):
        for i in range(len(w) - k + 1):
            where[tuple(w[i : i + k])].add(d)
    out = set()
    for d, w in enumerate(ws):
        hit = [i for i in range(len(w) - k + 1) if len(where[tuple(w[i : i + k])]) > 1]
        spans = []
        for i in hit:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + k
            else:
                spans.append([i, i + k])
        out |= {(d, a, b) for a, b in spans}
    return out


def test_bwt_and_prefixes_match_sorting(tmp_path, monkeypatch):
    rng = random.Random(2)
    for _ in range(60):
        monkeypatch.setattr(bwt, "BLOCK", rng.choice([1 << 20, 7, 3]))
        strs = [[rng.randint(1, 3) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 8))]
        flat, offs = np.array([x for s in strs for x in s], np.uint16), np.concatenate([[0], np.cumsum([len(s) for s in strs])]).astype(np.int64)
        files = bwt.build(flat, offs, 3, 100, str(tmp_path), spool=rng.choice([10, 1 << 20]))
        got = list(zip(*[np.concatenate([np.zeros(0, int), *f.blocks()]).tolist() for f in files], strict=True))
        suf = sorted(((*s[len(s) - n :], -1000 + j), j, n) for j, s in enumerate(strs) for n in range(len(s) + 1))
        want = []
        for i, (key, j, n) in enumerate(suf):
            p, a = 0, suf[i - 1][0][:-1] if i else ()
            while p < min(len(a), len(key) - 1) and a[p] == key[p]:
                p += 1
            want.append((strs[j][len(strs[j]) - n - 1] if n < len(strs[j]) else 0, p, (j << 20) | n))
        assert got == want


def test_repeats_match_brute_force(spark):
    rng = random.Random(4)
    shared = [prose(rng, n) for n in (12, 20, 35, 60)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            w = s.split()
            a = rng.randint(0, 4)
            parts += [" ".join(w[a : len(w) - rng.randint(0, 4)]), prose(rng, rng.randint(0, 12))]
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], "loop loop " * 40, "", None, texts[5].upper()]
    got = {(r.doc_id, r.from_word, r.to_word) for r in repeats.repeats(docs_of(spark, texts), least=10, anchor=3).collect()}
    assert got == brute_spans(texts, 10)


def test_repeats_with_a_large_alphabet_and_files(tmp_path, monkeypatch):
    monkeypatch.setattr(bwt, "BLOCK", 50_000)
    monkeypatch.setattr(bwt, "SPOOL", 1 << 16)
    rng = np.random.default_rng(0)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join([f"w{x}" for x in rng.integers(0, 10**9, 60)] + (common if i % 2 else [])) for i in range(1200)]
    s, at, older = repeats.repeated_starts(pa.array(texts, pa.large_string()), np.arange(1200), np.arange(1200), 20, str(tmp_path))
    assert sorted(zip(s.tolist(), at.tolist(), strict=True)) == [(i, a) for i in range(1, 1200, 2) for a in range(60, 71)]
    assert older.tolist() == (s > 1).tolist()


@pytest.mark.parametrize("hot", [200_000, 5])
def test_all_but_the_first_occurrence_goes(spark, monkeypatch, hot):
    """With hot anchors too: a common head in many different surroundings."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(41)
    head, shared = prose(rng, 14), [prose(rng, n) for n in (12, 20, 35)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 20)), head if i % 2 else "", prose(rng, 1)]
        for s in rng.sample(shared, rng.randint(0, 2)):
            parts += [s, prose(rng, rng.randint(0, 9))]
        texts.append("  ".join(parts) + "\n")
    texts += [texts[3], "", None, texts[5].upper(), " ".join(head.split()[:9])]
    docs = docs_of(spark, texts, removed_words="clash")
    assert {(r.doc_id, r.from_word, r.to_word) for r in repeats.repeats(docs, least=10, anchor=3).collect()} == brute_spans(texts, 10)
    seen, want = {}, {}
    for d, t in enumerate(texts):
        w = (t or "").lower().split()
        gone = set()
        for i in range(len(w) - 9):
            if seen.setdefault(tuple(w[i : i + 10]), d) < d:
                gone |= set(range(i, i + 10))
        want[d] = ([x for i, x in enumerate((t or "").split()) if i not in gone], len(gone))
    got = repeats.remove_repeats(docs, least=10, anchor=3)
    assert got.columns == [*docs.columns[:-1], "removed_words"]
    assert {r.doc_id: ((r.text or "").split(), r.removed_words) for r in got.collect()} == want
    assert sum(n for _, n in want.values()) > 500


def test_a_hot_anchor_is_split(monkeypatch):
    rng = random.Random(42)
    head = prose(rng, 12)
    w = tk.words(pa.array([f"{prose(rng, 40)} {head} {prose(rng, 40)}" for _ in range(50)]))
    key, _, _, _, n = repeats.strings(w, 30, 3)
    hot, times = np.unique(key, return_counts=True)
    assert times.max() > 20
    split, _, _, _, m = repeats.strings(w, 30, 3, [hot[times > 20]])
    assert np.unique(split, return_counts=True)[1].max() <= 20 and m.max() <= n.max()


def test_repeats_of_odd_rows(spark, odd, nothing):
    assert repeats.remove_repeats(odd).count() == 9 and repeats.remove_repeats(nothing).count() == 0
    assert {r.doc_id for r in repeats.repeats(odd, least=2, anchor=1).collect()} <= {4, 5, 6}
    assert repeats.repeats(nothing).count() == 0


# 5 toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    bad = "idiot moron clown pathetic scum worthless".split()
    texts, y = [], []
    for i in range(400):
        w, t = prose(rng, rng.randint(15, 120)).split(), i % 7 == 0
        for _ in range(rng.randint(3, 6) if t else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        y.append(int(t))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, y[i]) for i in range(250)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = range(250, 400)
    assert sum(got[i].toxic == bool(y[i]) for i in held) / len(held) > 0.97
    assert not any(got[i].toxic for i in held if not y[i])
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}


def test_toxicity_features():
    f = toxicity.features(pa.array(["You idiot! you MORON", "plain text only", None, "an i.d.i.o.t and a m0r0n", "sooo good", ""]))
    at = toxicity.NAMES.index
    assert f[0, at("insult")] == 0.5 and f[0, at("near_second")] == pytest.approx(np.log1p(2)) and f[0, at("capital_words")] == 0.25
    assert f[1, : at("capitals")].sum() == 0 and f[2].sum() == 0 and f[5].sum() == 0
    assert f[3, at("hidden")] == pytest.approx(np.log1p(2)) and f[4, at("stretched")] == 0.5


def test_learned_lexicons_hold_every_language(spark):
    """Toxic words that no list has, other ones in each of three languages, one of them a stem with many endings."""
    rng = random.Random(12)
    stems = {"xx": ["zorbl", "quemf"], "yy": ["ñandró", "öltwik"], "zz": ["жабур", "крумп"]}
    rows, y, lang = [], {}, {}
    for i in range(900):
        words = prose(rng, rng.randint(20, 60)).split()
        lang[i], y[i] = rng.choice(list(stems)), int(rng.random() < 0.25)
        for _ in range(3 if y[i] else 0):
            words.insert(rng.randrange(len(words)), rng.choice(stems[lang[i]]) + rng.choice(["", "en", "ar", "ik", "os"]))
        rows.append((i, " ".join(words), lang[i]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y[i]) for i in range(600)], "doc_id long, toxic int"))
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, model).collect()}
    for name in stems:
        held = [i for i in range(600, 900) if lang[i] == name]
        assert sum(got[i] for i in held if y[i]) / sum(y[i] for i in held) > 0.9
        assert sum(got[i] for i in held if not y[i]) / len(held) < 0.02


def test_features_and_trees_match_a_count_by_hand(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(60):
        words = [rng.choice([*VOCAB, "you", "idiot", "scum", "KILL", "m0r0n", "zorblen", "zorblar", "so?!", "aaargh"]) for _ in range(rng.randint(0, 30))]
        if not any("zorbl" in w for w in words):  # else the known words are found harmless
            words = [w for w in words if w not in ("idiot", "scum", "KILL")]
        texts.append(" ".join(words))
    y = np.array([int("zorbl" in t) for t in texts])
    rows = spark.createDataFrame([(i, t, int(k)) for i, (t, k) in enumerate(zip(texts, y, strict=True))], "doc_id long, text string, toxic int")
    counts = toxicity.learn(rows)
    # the counts are those of sets of words and beginnings of each document
    fold = toxicity.folds(np.arange(60))
    held = [set(re.findall(r"[a-z]+", t.lower())) for t in texts]
    for word in ("zorblen", "zorblar"):
        at = np.flatnonzero(counts.key == tk.words(pa.array([word])).hash[0])
        for f in range(toxicity.FOLDS):
            assert counts.toxic[at, f].sum() == sum(word in h and fold[i] == f and y[i] for i, h in enumerate(held))
    assert counts.total[0].sum() == y.sum() and counts.total[1].sum() == (1 - y).sum()
    lexicon = counts.lexicon()
    learned = set(lexicon.key[lexicon.kind == 5].tolist())

    def starts(w):
        return any(len(w) > n and int(tk.words(pa.array([w[:n]])).hash[0] ^ salt) in learned for n, salt in zip(toxicity.PREFIXES, toxicity._SALT, strict=True))

    assert starts("zorblen") and starts("zorblar")
    x = toxicity.features(pa.array(texts), lexicon)
    at = toxicity.NAMES.index
    for i, t in enumerate(texts):
        words = re.findall(r"[a-z]+", t.lower())
        n = max(len(words), 1)
        assert x[i, at("insult")] == pytest.approx(sum(w == "idiot" for w in words) / n)
        assert x[i, at("contempt")] == pytest.approx(sum(w == "scum" for w in words) / n)
        assert x[i, at("threat")] == pytest.approx(sum(w == "kill" for w in words) / n)
        assert x[i, at("second")] == pytest.approx(sum(w == "you" for w in words) / n)
        assert x[i, at("learned_begins")] == pytest.approx(sum(starts(w) for w in words) / n)
        assert x[i, at("exclaim")] == pytest.approx(t.count("!") / n) and x[i, at("question")] == pytest.approx(t.count("?") / n)
        assert x[i, at("hidden")] == pytest.approx(np.log1p(sum(w == "m0r0n" for w in t.split())))
        assert x[i, at("capital_words")] == pytest.approx(sum(w == "KILL" for w in t.split()) / n)
        assert x[i, at("length")] == pytest.approx(np.log1p(len(words)))
        near = sum(any(words[j] == "you" for j in range(max(0, k - toxicity.NEAR), min(len(words), k + toxicity.NEAR + 1))) for k, w in enumerate(words) if w in ("idiot", "scum", "kill") or starts(w) or tk.words(pa.array([w])).hash[0] in lexicon.words)
        assert x[i, at("near_second")] == pytest.approx(np.log1p(near))
    model = toxicity.fit_arrays(x, y.astype(float))

    def score(row):
        total = model.base
        for feat, cut, leaf in model.trees:
            node = 0
            while feat[node] >= 0:
                node = 2 * node + (2 if row[feat[node]] > cut[node] else 1)
            total += leaf[node]
        return total

    assert model.trees and np.allclose(model.raw(x), [score(r) for r in x])


def test_known_words_that_are_harmless_here_are_dropped(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, 20) + (" vile" if i % 2 else "") + (" scum" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(300)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int")).lexicon()
    vile, scum, crap = tk.words(pa.array(["vile", "scum", "crap"])).hash
    assert vile not in lexicon.key and scum in lexicon.key and crap in lexicon.key


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    for _ in range(20):
        s, y = rng.integers(0, 8, 30).astype(float), rng.integers(0, 2, 30).astype(float)
        x, v = toxicity.isotonic(s, y)
        p = np.interp(s, x, v)
        assert (np.diff(v) >= -1e-12).all() and p.mean() == pytest.approx(y.mean())
        best = ((p - y) ** 2).sum()
        for c in np.unique(s):  # no step function of one cut is better
            q = np.where(s < c, y[s < c].mean() if (s < c).any() else 0, y[s >= c].mean())
            if not (s < c).any() or q[s < c][0] <= q[s >= c][0]:
                assert best <= ((q - y) ** 2).sum() + 1e-9


def test_toxicity_of_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, none)
    assert model.constant == 0.0 and toxicity.toxicity(odd, model).count() == 9
    assert toxicity.reject_toxic(odd, model).count() == 9
    assert toxicity.fit(odd, spark.createDataFrame([(4, 1), (5, 1), (6, 1)], "doc_id long, toxic int")).constant == 1.0
    assert toxicity.toxicity(nothing, toxicity.fit(nothing, none)).count() == 0


# 6 token counts


def test_token_counts_are_the_tokenizers(spark, odd, nothing):
    rng = random.Random(6)
    texts = [prose(rng, 50), "don't we'll I'd 12,345.67 a\n\n  b\t\tc   ", "<|endoftext|> x", "naïve ☃   \x1c日本語 ١٢٣", "a" * 500, "", None, "  lead", "trail  ", "\r\n\r\n"]
    enc = token_counts.encoding()
    for frequent in (None, {}):
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs_of(spark, texts), frequent=frequent).collect()}
        assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    rows = token_counts.token_counts(odd).collect()
    assert len(rows) == 9 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert token_counts.token_counts(nothing).count() == 0


def test_summaries_keep_heavy_words(monkeypatch):
    monkeypatch.setattr(token_counts, "SUMMARY", 20)
    texts = [f"often always {i} {i}x" for i in range(3000)]
    (batch,) = token_counts._summaries(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    held = dict(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    assert len(held) <= 20 and held["often"] > 2500 and held["always"] > 2500


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 10)
    lengths = token_counts.Lengths({" the": 1}, token_counts.VOCABULARY)
    text = " ".join(f"w{i}q" for i in range(500))
    assert token_counts.count(text, lengths) == len(token_counts.encoding().encode_ordinary(text)) and len(lengths) <= 12


# 7 line dedup


def brute_lines(texts):
    first, out = {}, {}
    for d, t in enumerate(texts):
        if t is None:
            out[d] = None
            continue
        kept = []
        for _, lines in line_dedup.chunks(t):
            c = "\n".join(lines)
            if line_dedup._multi(lines) and c in first:
                continue
            if line_dedup._multi(lines):
                first[c] = d
            kept += lines
        out[d] = "\n".join(kept)
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_line_dedup_matches_brute_force(spark, monkeypatch, most):
    """With the shared digests sent to the tasks, and joined."""
    monkeypatch.setattr(line_dedup, "BROADCAST", most)
    rng = random.Random(7)
    block = [prose(rng, 8) for _ in range(30)]
    texts = []
    for _ in range(40):
        a = rng.randint(0, 10)
        texts.append("\n".join([prose(rng, 6) for _ in range(rng.randint(0, 5))] + block[a : a + rng.randint(0, 20)] + [prose(rng, 6)] * rng.randint(0, 3)))
    texts += [None, "", "one line", texts[2], "\n".join(block + block)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs_of(spark, texts)).collect()}
    assert got == brute_lines(texts)
    assert sum(len(x or "") for x in got.values()) < 0.8 * sum(len(x or "") for x in texts)


def test_bounds_fall_into_step_after_an_insertion():
    rng = random.Random(8)
    lines = [prose(rng, 5) for _ in range(80)]
    cut = lambda ls: {"\n".join(x) for _, x in line_dedup.chunks("\n".join(ls))}
    a, b = cut(lines), cut([*lines[:10], "new line", *lines[10:]])
    assert len(a & b) >= len(a) - 3


def test_digests_are_found_whatever_their_last_bytes():
    keys = [b"a" * 15 + b"\0", b"a" * 14 + b"\0\0", b"z" * 16, b"\0" * 16]
    held = line_dedup.Shared(keys, np.array([1, 2, 3, 4]))
    assert [held.first_of(k) for k in keys] == [1, 2, 3, 4] and held.first_of(b"b" * 16) is None
    assert line_dedup.Shared([], np.zeros(0, np.int64)).first_of(b"a" * 16) is None


def test_line_dedup_of_odd_rows(odd, nothing):
    got = line_dedup.line_dedup(odd.withColumn("removed_lines", F.lit("clash")))
    assert got.columns == [*odd.columns, "removed_lines"] and got.count() == 9
    assert {r.removed_lines for r in got.collect()} == {0}
    assert [r.text for r in got.where("doc_id = 1").collect()] == [None]
    assert line_dedup.line_dedup(nothing).count() == 0


def brute_runs(texts):
    """Every window of lines with two that aren't blank at its ends, and what of it stands earlier."""
    seen, out = set(), {}
    for d, t in enumerate(texts):
        lines, cut, new = (t or "").split("\n"), set(), []
        for i in range(len(lines)):
            for j in range(i + 1, len(lines)):
                if lines[i].strip() and lines[j].strip():
                    new.append((i, j, "\n".join(lines[i : j + 1])))
        for i, j, run in new:
            if run in seen:
                cut.update(range(i, j + 1))
            seen.add(run)
        out[d] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in cut)
    return out


def test_every_repeated_run_of_lines_goes(spark):
    rng = random.Random(17)
    block = [prose(rng, 8) if i % 5 else "" for i in range(30)]
    texts = []
    for _ in range(40):
        a = rng.randint(0, 28)
        texts.append("\n".join([prose(rng, 6) for _ in range(rng.randint(0, 5))] + block[a : a + rng.randint(0, 6)] + [prose(rng, 6)] * rng.randint(0, 3)))
    texts += [None, "", "one line", "one line", " \n \n ", " \n \n ", texts[2], "\n".join(block + block), "again\nagain\nagain\nagain"]
    got = {r.doc_id: r.text for r in line_dedup.repeated_lines(docs_of(spark, texts)).collect()}
    want = brute_runs(texts)
    assert got == want and got[len(texts) - 1] == "again"
    assert line_dedup.QUERIES["op7_repeated_lines"]
    first = {x for t in texts for x in (t or "").split("\n")}
    assert first == {x for t in got.values() for x in (t or "").split("\n")}


def test_repeated_lines_of_odd_rows(spark, odd, nothing):
    got = line_dedup.repeated_lines(odd.withColumn("removed_lines", F.lit("clash")))
    assert got.columns == [*odd.columns, "removed_lines"] and got.count() == 9
    assert {r.removed_lines for r in got.collect()} == {0}
    rows = [(None, "a\nb\nx"), (None, "a\nb\ny"), (3, "c\na\nb"), (4, "q\nr"), (4, "q\nr\ns")]
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.removed_lines for r in got) == [0, 0, 2, 2, 2] and {r.text for r in got if r.doc_id is None} == {"x", "y"}
    assert line_dedup.repeated_lines(nothing).count() == 0


# 8 URL filter


def test_url_vocabulary_from_a_table(spark):
    rows = [("Casino", 3, True), ("casino", 9, False), (" bonus ", None, None), (None, 1, True), ("", 1, True)]
    terms = spark.createDataFrame(rows, "term string, weight int, strict boolean")
    assert url_filter.vocabulary(terms) == ({"casino": 9}, {"bonus": 1})
    with pytest.raises(ValueError):
        url_filter.vocabulary(terms, 1)
    long = "http://x.example/" + "a/" * 200_000 + "casino"
    pages = spark.createDataFrame([(None, long), (1, long), (1, long), (2, None), (3, "")], "page_id long, url string")
    got = url_filter.url_filter(pages, strict={"casino": 9}, soft={}).collect()
    assert sorted(str((r.page_id, r.rejected)) for r in got) == sorted(["(None, True)", "(1, True)", "(1, True)", "(2, False)", "(3, False)"])


def test_urls_match_brute_force(spark):
    import re

    urls = ["http://porn.example/", "http://pornography.example", "http://x.example/cheap-pills", "http://cheap.example/", None, "", "HTTP://A.EXAMPLE/XXX?b=1", "http://cheap-cheap.example", "xxx", "http://essex.example/sexton"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("score", F.lit("clash")).withColumn("terms", F.lit(1))
    got = {r.page_id: r for r in url_filter.url_filter(df).collect()}
    for i, u in enumerate(urls):
        hit = lambda v, u=u: {t for t in v if re.search(rf"(^|[^a-z0-9]){t}([^a-z0-9]|$)", (u or "").lower())}
        s, f = hit(url_filter.STRICT), hit(url_filter.SOFT)
        assert (got[i].n_strict, got[i].n_soft, got[i].rejected) == (len(s), len(f), bool(s) or len(f) >= 2)
        assert got[i].terms == ",".join(sorted(s | f))
    assert [i for i in got if got[i].rejected] == [0, 2, 6, 8]
    assert url_filter.url_filter(df.where("page_id < 0")).count() == 0


# 9 decontamination


def brute_align(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_brute_force():
    rng = random.Random(9)
    for _ in range(30):
        pairs = [([rng.randint(1, 4) for _ in range(rng.randint(1, 9))], [rng.randint(1, 4) for _ in range(rng.randint(1, 14))]) for _ in range(6)]
        la, lb = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
        a, b = np.zeros((6, la.max()), np.uint64), np.zeros((6, lb.max()), np.uint64)
        for k, (x, y) in enumerate(pairs):
            a[k, : len(x)], b[k, : len(y)] = x, y
        assert decontaminate.align(a, la, b, lb).tolist() == [brute_align(x, y) for x, y in pairs]


def test_contaminated_documents_are_those_of_full_alignment(spark):
    rng = random.Random(10)
    items = [prose(rng, rng.randint(12, 40)) for _ in range(8)]
    texts = []
    for i in range(60):
        w = prose(rng, rng.randint(5, 60)).split()
        if i % 3 == 0:
            piece = [x if rng.random() > rng.choice([0, 0.1, 0.25]) else "edited" for x in items[i % 8].split()]
            k = rng.randint(0, len(w))
            w[k:k] = piece
        texts.append(" ".join(w))
    docs = docs_of(spark, texts + [None, ""])
    bench = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, ""), (92, "too short"), (None, items[0]), (0, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, q in enumerate(items):
            s = brute_align(q.split(), t.split()) / (2 * len(q.split()))
            if s >= decontaminate.SCORE:
                want[d, i] = s
    assert len(want) >= 15 and set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    kept = decontaminate.reject_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(62)) - {d for d, _ in got}


def test_edited_copies_are_found_however_many_hold_them(spark):
    rng = random.Random(15)
    item = prose(rng, 24).split()
    edited = " ".join(item[:12] + [x if i % 4 else "edited" for i, x in enumerate(item[12:])])
    half = " ".join(item[:12])
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    for copies, others in ((1, 59), (1000, 9000)):
        for piece in (edited, half):
            docs = docs_of(spark, [f"{prose(rng, 6)} {piece} {prose(rng, 6)}" for _ in range(copies)] + [prose(rng, 12) for _ in range(others)])
            got = {r.doc_id: r.score for r in decontaminate.contaminated(docs, bench).collect()}
            assert set(got) == set(range(copies)) and min(got.values()) >= decontaminate.SCORE
            assert decontaminate.reject_contaminated(docs, bench).count() == others


def test_common_seeds_in_bounded_pieces(monkeypatch):
    rng = random.Random(16)
    items = ["which of the following is " + prose(rng, 10) for _ in range(20)]
    texts = [f"{items[i % 20]} {prose(rng, 5)} which of the following is {prose(rng, 8)}" for i in range(30)] + ["", "which of the following is " * 9]
    slab, w = decontaminate.Slab(list(range(20)), items), tk.words(pa.array(texts))
    every = sorted(decontaminate.scores(slab, w))
    best = [x for x in every if x[2] >= 0.5]
    assert sorted({(d, i) for d, i, *_ in best}) == [(i, i % 20) for i in range(30)]
    monkeypatch.setattr(decontaminate, "_PAIRS", 7)
    monkeypatch.setattr(decontaminate, "_WORDS", 50)
    assert sorted(decontaminate.scores(slab, w)) == every
    assert [x for x in sorted(decontaminate.scores(slab, w, 0.5)) if x[2] >= 0.5] == best


def test_slabs_give_the_same_as_one(spark, monkeypatch):
    rng = random.Random(11)
    items = [prose(rng, 15) for _ in range(6)]
    docs = docs_of(spark, [prose(rng, 10) + " " + i for i in items])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "slabs", lambda b, most=20, f=decontaminate.slabs: f(b, most))
    assert {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()} == one and len(one) == 6


def test_an_id_is_reported_once_over_slabs(spark, monkeypatch):
    rng = random.Random(21)
    texts = [prose(rng, 15) for _ in range(4)]
    docs = docs_of(spark, [" ".join(texts)])
    bench = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[2]), (2, texts[3])], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SLAB", 5)
    assert len(list(decontaminate.slabs(bench))) == 2
    assert sorted((r.item_id, r.score) for r in decontaminate.contaminated(docs, bench).collect()) == [(1, 1.0), (2, 1.0)]
    assert decontaminate.reject_contaminated(docs, bench).count() == 0


def test_items_shorter_than_a_seed_are_found_whole(spark):
    docs = docs_of(spark, ["one of them holds Blue Whale here", "a blue or a whale", "blue", "xylophone stands alone", None, ""])
    bench = spark.createDataFrame([(1, "blue whale"), (2, "xylophone"), (3, "not to be found"), (4, "whale blue or"), (5, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(0, 1), (3, 2)]
    assert sorted(r.doc_id for r in decontaminate.reject_contaminated(docs, bench).collect()) == [1, 2, 4, 5]


def test_one_edited_copy_in_a_small_corpus_and_many_in_a_large_one(spark):
    rng = random.Random(22)
    item = prose(rng, 40).split()
    edited = " ".join(f"q{i}" if i % 7 == 3 else x for i, x in enumerate(item))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    few = docs_of(spark, [prose(rng, 30) for _ in range(59)] + [edited])
    assert [r.doc_id for r in decontaminate.contaminated(few, bench).collect()] == [59]
    many = docs_of(spark, [prose(rng, 12) for _ in range(9000)] + [edited] * 1000)
    assert decontaminate.contaminated(many, bench).count() == 1000 and decontaminate.reject_contaminated(many, bench).count() == 9000


def test_decontamination_of_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "other text of the same id")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(odd, bench).collect()] == [5]
    empty = bench.where("item_id < 0")
    assert decontaminate.contaminated(odd, empty).count() == 0 and decontaminate.reject_contaminated(odd, empty).count() == 9
    assert decontaminate.contaminated(nothing, bench).count() == 0


# 10 Jaccard join


def brute_pairs(texts, t):
    def grams(s):
        w = (s or "").lower().split()
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    g = [grams(s) for s in texts]
    out = {}
    for a in range(len(g)):
        for b in range(a + 1, len(g)):
            if g[a] and g[b] and (j := len(g[a] & g[b]) / len(g[a] | g[b])) >= t:
                out[a, b] = round(j, 6)
    return out


def mutants(rng, n_bases, copies):
    texts = []
    for _ in range(n_bases):
        base = prose(rng, rng.randint(3, 150)).split()
        for _ in range(rng.randint(1, copies)):
            rate = rng.choice([0, 0, 0.02, 0.08])
            texts.append(" ".join(x if rng.random() > rate else "other" + str(rng.randint(0, 99)) for x in base))
    return texts


def test_pairs_match_brute_force(spark):
    rng = random.Random(12)
    texts = mutants(rng, 40, 7) + ["a b", "a b", "A  b", "a", None, "", "x y z"]
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard_join.jaccard_join(docs_of(spark, texts)).collect()}
    want = brute_pairs(texts, jaccard_join.THRESHOLD)
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and all(got[k] == want[k] for k in got)


def test_pairs_across_small_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_GRAMS", 400)
    rng = random.Random(13)
    base = prose(rng, 120).split()
    texts = [" ".join(x if rng.random() > 0.03 else f"z{rng.randint(0, 999)}" for x in base) for _ in range(60)]
    got = {(r.doc_a, r.doc_b) for r in jaccard_join.jaccard_join(docs_of(spark, texts)).collect()}
    want = set(brute_pairs(texts, jaccard_join.THRESHOLD))
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 1000


def test_one_of_each_group(spark):
    rng = random.Random(14)
    texts = mutants(rng, 25, 5)
    docs = docs_of(spark, texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_pairs(texts, jaccard_join.THRESHOLD):
        root[max(find(a), find(b))] = min(find(a), find(b))
    kept = jaccard_join.one_of_each_group(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {find(i) for i in range(len(texts))}


def classes_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("grams", [400, 1 << 19])
def test_classes_and_links_lose_nothing(spark, monkeypatch, grams):
    """Over small groups and one group; a hot set of many copies and a chain of edits among them."""
    monkeypatch.setattr(jaccard_join, "GROUP_GRAMS", grams)
    rng = random.Random(16)
    texts = mutants(rng, 25, 6) + [prose(random.Random(3), 40)] * 30 + ["", None, " ", "x"]
    chain = prose(rng, 90).split()
    for k in range(8):
        chain = chain[8:] + prose(rng, 8).split()
        texts.append(" ".join(chain))
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard_join.near_duplicates(docs_of(spark, texts)).collect()}
    pairs = brute_pairs(texts, jaccard_join.THRESHOLD)
    links = Counter(x for p in pairs for x in p)
    root = classes_of(len(texts), pairs)
    assert got == {i: (root[i], links[i]) for i in range(len(texts))}


def test_pairs_at_the_threshold_are_all_found(spark, monkeypatch):
    """20 of 30 3-grams shared, so Jaccard is 20 / 40; over several buckets of n-grams."""
    monkeypatch.setattr(jaccard_join, "BUCKET_GRAMS", 10_000)
    rng = random.Random(11)
    texts = []
    for _ in range(2000):
        both = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(22)]
        texts += [" ".join(both + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(10)]) for _ in range(2)]
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: (i - i % 2, 1) for i in range(4000)}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.55, 0.8])
def test_pairs_by_prefixes_lose_nothing(spark, monkeypatch, threshold):
    monkeypatch.setattr(jaccard_join, "BUCKET_GRAMS", 300)
    rng = random.Random(17)
    texts = mutants(rng, 30, 6) + [prose(random.Random(5), 20) + " " + prose(rng, rng.randint(1, 40)) for _ in range(30)] + ["a b", "A  b", None, ""]
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard_join.jaccard_join(docs_of(spark, texts), threshold).collect()}
    assert got == brute_pairs(texts, threshold)


def test_prefix_grows_where_ngrams_fall_together():
    """Of 6 n-grams in 5 tokens, all shared, 3 must be shared: 5 - 3 + 1 tokens and one more, the rarest first."""
    key, none = bytes(8), [None] * 4
    counts, tokens, sets = (np.array(v, t).tobytes() for v, t in (([5], np.uint32), ([1, 2, 3, 4, 5], np.uint32), ([9, 2, 3, 2, 8], np.uint16)))
    schema = pa.schema([("part", pa.int64()), ("node", pa.binary()), ("size", pa.int32()), ("low", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("sets", pa.binary())])
    rows = [(0, bytes(16), 6, 5, None, *none), (0, None, None, None, 1, key, counts, tokens, sets)]
    (got,) = jaccard_join._prefix(0.5)(iter([pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)]))
    assert got.column("tokens").to_pylist() == [[(1 << 32) + t for t in (2, 4, 3, 5)]]


def test_jaccard_of_odd_rows(spark, odd, nothing):
    assert jaccard_join.jaccard_join(odd).count() == 0
    # of the repeated row one stays
    assert sorted(str(r.text) for r in jaccard_join.one_of_each_group(odd).collect()) == sorted({str(r.text) for r in odd.collect()})
    assert jaccard_join.one_of_each_group(odd).columns == odd.columns
    got = sorted((r.doc_id, r.class_id, r.links) for r in jaccard_join.near_duplicates(odd).collect())
    assert got == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (5, 5, 0), (6, 6, 0)]
    for f in (jaccard_join.jaccard_join, jaccard_join.near_duplicates, jaccard_join.one_of_each_group):
        assert f(nothing).count() == 0
    text = prose(random.Random(4), 30)
    rows = [(None, text), (None, text), (7, text), (7, text), (9, text + " more"), (None, "alone among the null ids"), (7, "quite another text under the same id"), (None, None), (None, None)]
    kept = jaccard_join.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, [r for r in spark.createDataFrame([(7, text), rows[5], rows[6], rows[7], rows[8]], "doc_id long, text string").collect()]))
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(7, 7, 0), (7, 7, 1), (9, 7, 1)]


# pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    items = [prose(rng, 25) for _ in range(4)]
    texts = mutants(rng, 60, 3) + [prose(rng, 20) + " " + i for i in items] + [prose(rng, 30) + " idiot moron scum clown idiot" for _ in range(20)] + [None, ""]
    docs = docs_of(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bad = {i for i, t in enumerate(texts) if t and "moron" in t}
    spark.createDataFrame([(i, 1, int(i in bad)) for i in range(len(texts)) if i % 2 == 0 or i in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    from tessera import session

    before = session.made()
    result = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id: r.shard for r in result.collect()}
    assert len(session.made() - before) == 1  # the mix, which the result reads

    left = [i for i in range(len(texts)) if i not in bad]
    root = {i: i for i in left}
    for a, b in brute_pairs([texts[i] for i in left], jaccard_join.THRESHOLD):
        x, y = left[a], left[b]
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    left = [i for i in left if root[i] == i]
    left = [i for i in left if not any(brute_align(q.split(), (texts[i] or "").split()) >= len(q.split()) for q in items)]
    rows = [(i, f"src{i % 3}", len((texts[i] or "").split())) for i in left]
    want = brute_mix(rows, mixing.WEIGHTS, int(sum(n for _, _, n in rows) * mixing.SHARE))
    from hashlib import md5

    assert got == {i: brute_jump(int(md5(str(i).encode()).hexdigest()[:15], 16), sharding.SHARDS) for i in want}
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "something else altogether here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns and (k == 3 or got.count() == (8 if k == 1 else 9))
        assert stage(spark, odd.where("doc_id = -1"), str(tmp_path)).count() == 0


def test_queries_match_their_sql(spark):
    import duckdb

    from tessera.llm import registry

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in registry.SQL.items():
        df, want = registry.QUERIES[name](spark, "/root/testdata/sf0.001"), c.sql(sql)
        assert sorted(df.columns) == sorted(want.columns), name
        assert sorted(map(str, df.select(*want.columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, want.df().itertuples(index=False, name=None))), name
