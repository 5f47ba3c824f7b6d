"""Runs, phrases and the compression classifier against brute force and labels, with nulls, empties, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import phrases, quality, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long, suffix string, n int, part int, `a.b` int, phrase string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1, "x", 2, 3, 4, "p") for i, t, g in rows], DOCS)


# Runs


def naive_runs(ws):
    out = {}
    for p in range(1, len(ws) // 4 + 1):
        i = 0
        while i + p < len(ws):
            s = i
            while i + p < len(ws) and ws[i] == ws[i + p]:
                i += 1
            if i + p - s >= max(6, 4 * p):
                out.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e, p) for (s, e), p in out.items())


def naive_op11(doc_id, text):
    ws = (text or "").encode().split()
    n = len(ws)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
    found = naive_runs(ws)
    gone = {i for s, e, p in found for i in range(s + p, e)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    s, e, p = best or (None, None, None)
    return (doc_id, len(found), s, best and e - s, p, best and 1000 * (e - s) // p, hashlib.sha256("".join(f"{s},{e - s},{p}\n" for s, e, p in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest())


def run_texts(seed=1, n=150):
    rng = random.Random(seed)
    texts = [None, "", " \t\n ", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "x" * 300 + " y", "é é\xa0 é é é é é é", "w " * 9000]
    for _ in range(n):
        letters = "abcdefghijklmnopqrstuvwxyzABCD"[:rng.choice([1, 2, 3, 30])]
        ws = [rng.choice(letters) for _ in range(rng.randint(1, 120))]
        q, s = rng.randint(1, max(1, len(ws) // 4)), rng.randint(0, len(ws) // 2)
        for i in range(s + q, min(len(ws), s + q * rng.randint(2, 9))):
            ws[i] = ws[i - q]
        texts.append(rng.choice([" ", "  ", "\n", "\x0b"]).join(ws))
    return texts


def test_runs(spark):
    rows = [(i, t, "en") for i, t in enumerate(run_texts())] + [(None, "b b b b b b", None), (7, "a b a b a b a b", "en")]
    got = runs.op11(docs_of(spark, rows).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(naive_op11(i, t)) for i, t, _ in rows)
    assert sum(r.n_runs > 0 for r in got) > 50


def test_runs_of_long_periodic_and_long_plain_texts(spark):
    rng = random.Random(2)
    block = [str(rng.randint(0, 999)) for _ in range(700)]
    texts = [" ".join(block * 30 + block[:50]), " ".join(str(rng.randint(0, 40)) for _ in range(300_000))]
    got = {r.doc_id: r for r in runs.periodic_runs(docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert got[0].runs == [[0, 21_050, 700]] and got[0].collapsed == " ".join(block) and got[0].exponent_milli == 30_071
    assert got[1].n_runs == 0 and got[1].collapsed == texts[1]


def test_runs_with_words_that_meet_in_a_hash():
    """Where different words hash alike, the very words decide."""
    texts = runs.Texts([1, 2], pa.array(["a b c a b c a b c a b d q", "a a a a a a b"]), False)
    texts.words.hashes[0] = np.array([1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 5, 5, 5, 5, 5, 5, 5], np.uint64)
    assert [r.tolist() for r in texts.runs()] == [[], [[13, 19, 1]]]


def test_grid_in_parts():
    sizes, starts = np.array([0, 3, 50, 1, 400]), np.array([0, 0, 3, 53, 54])
    whole = [np.concatenate(x) for x in zip(*runs.grid(sizes, starts))]
    parts = [np.concatenate(x) for x in zip(*runs.grid(sizes, starts, most=7))]
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert set(zip(whole[1].tolist(), whole[2].tolist())) == {(s + 3 * p * k, p) for n, s in zip(sizes.tolist(), starts.tolist()) for p in range(1, n // 4 + 1) for k in range(n) if 3 * p * k + p < n}


def test_runs_of_no_documents(spark):
    assert runs.op11(docs_of(spark, [])).collect() == []


# Phrases


def naive_phrases(rows, least, most):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for i in range(len(ws)):
                for k in range(1, 6):
                    if i + k <= len(ws):
                        f[lang, tuple(ws[i:i + k])] += 1
    found = [(lang, p, a) for (lang, p), a in f.items() if len(p) > 1 and a >= least]
    inside = {(lang, p[i:j]): max(0, a) for lang, p, a in sorted(found, key=lambda x: x[2]) for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}
    out = []
    for lang, p, a in found:
        if inside.get((lang, p), 0) >= a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place, ranked = Counter(), []
    for lang, *r in out:
        place[lang] += 1
        if place[lang] <= most:
            ranked.append((lang, place[lang], *r))
    return ranked


def phrase_rows(seed=4):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "é", "x\x00y", "a\x01", "\x00", "a-b", "\xa0", "ab", "zz\x1f"]
    rows = [(1, None, "en"), (2, "", None), (3, " \t\n,,", "en"), (4, "hot pair " * 700, "en"), (5, "und only", "und"), (6, "und only", None), (6, "und only", None), (7, "x", "")]
    for i in range(90):
        ws = [rng.choice(words[:rng.choice([4, 13])]) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randint(1, 60))]
        rows.append((10 + i, " ".join(ws + ["fixed phrase of five words"] * (i % 3)), rng.choice(["en", "en", "de", "d\0e", "d\x01\x02", None])))
    return rows


@pytest.mark.parametrize("least,most,flush", [(2, 50, 8 << 20), (5, 2000, 300), (1, 7, 1000)])
def test_phrases(spark, monkeypatch, least, most, flush):
    monkeypatch.setattr(phrases, "FLUSH_BYTES", flush)
    monkeypatch.setattr(phrases, "SAMPLED", 3)  # uneven ranges
    rows = phrase_rows()
    got = phrases.collocations(docs_of(spark, rows).repartition(4), least, most).orderBy("lang", "rank").collect()
    assert [tuple(r) for r in got] == naive_phrases(rows, least, most)
    assert len(got) > 20


def test_suffixes_in_blocks_of_words(monkeypatch):
    """A long text is handled a block of words at a time; suffixes reach over the blocks' ends."""
    text = " ".join(random.Random(5).choice("abc") for _ in range(1000))
    s = phrases.Suffixes(pa.array([text], pa.large_string()))
    total = Counter()
    for first in range(0, len(s), 37):
        names, rows, n = s.counted(first, min(first + 37, len(s)))
        for row, c in zip(rows.tolist(), n.tolist()):
            total[tuple(names[k - 1].as_py() for k in row if k)] += c
    ws = text.split()
    assert total == Counter(tuple(ws[i:i + 5]) for i in range(len(ws)))


def test_stack_over_batches():
    """Beginnings stay open from batch to batch; those at an edge leave whatever they count."""
    rows = sorted([("\0".join(["en", *(random.Random(i).choice("ab") for _ in range(1 + i % 5))]), 1 + i % 3) for i in range(60)] + [("de\0a", 5)], reverse=True)
    want = Counter()
    for suffix, n in rows:
        lang, *ws = suffix.split("\0")
        want[lang, None] += n
        for k in range(1, len(ws) + 1):
            want[lang, " ".join(ws[:k])] += n
    for size in (1, 7, 61):
        stack, got = phrases.Stack(1), []
        for i in range(0, len(rows), size):
            part = rows[i:i + size]
            got += stack.read(pa.array([r[0] for r in part]), np.array([r[1] for r in part]))
        total = Counter()
        for lang, phrase, n in got + stack.finish():
            total[lang, phrase] += n
        assert total == want


def test_sampled_suffixes():
    text = "a b c d e " * 500 + " ".join(f"w{i}" for i in range(300))
    s = phrases.Suffixes(pa.array([text], pa.large_string()))
    for most in (3, 200, 10_000):
        some = s.some(most)
        assert len(some) == len(set(some)) == min(most, len({s.spelled(i) for i in range(len(s))}))


def test_no_phrases(spark):
    assert phrases.op12(docs_of(spark, [])).collect() == []
    assert phrases.op12(docs_of(spark, [(1, None, None), (2, ".,", "en")])).collect() == []


def test_scores_beyond_64_bits(spark):
    """1000 a n passes 64 bits: the table of frequencies alone decides, so it is given."""
    known = spark.createDataFrame([("en", None, 10**15), ("en", "p q", 10**13), ("en", "p", 3 * 10**13), ("en", "q", 7 * 10**13)], "lang string, phrase string, f long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrases, "frequent", lambda docs, least: known)
        row = phrases.collocations(known, 1).first()
    assert (row.l, row.r, row.score) == (3 * 10**13, 7 * 10**13, 1000 * 10**13 * 10**15 // (21 * 10**26))


# Quality


def quality_rows(seed=6, n=240):
    rng = random.Random(seed)
    good = [f"{a}{b}" for a in "ge ver be ent zer".split() for b in "hen sten lichen tern ging".split()]
    bad = [w.upper() + "!!" for w in good[:12]] + ["|", "$$$", "%%%"]
    docs, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.7)
        docs.append((i, " ".join(rng.choice(good if y else bad) for _ in range(rng.randint(5, 200))), "en"))
        labels.append((i, y, 0))
    return docs, labels


def brute_differences(text, good, bad):
    import zstandard

    raw = (text or "").encode()
    size = lambda d, p: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(p))
    own = [raw[i:i + 1024] for i in range(0, len(raw), 1024)]
    return sum(size(bad, p) - size(good, p) for p in own) / (len(raw) + 128)


def test_quality(spark):
    rows, known = quality_rows()
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "gehen " * 200_000, "en"), (rows[5][0], rows[5][1], "de"), (None, "gehen", "en")]
    docs = docs_of(spark, rows + extra).repartition(3)
    labels = spark.createDataFrame(known + [(3, None, 1), (None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.op13(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    truth = {i: y for i, y, _ in known}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i].held_out == (i in out) for i in truth) and by[None].held_out is False
    assert np.mean([by[i].predicted == truth[i] for i in out]) > 0.95
    assert by[1000].score == by[1001].score and by[1002].score != by[1001].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    again = {r.doc_id: r.score for r in quality.op13(docs.repartition(5), labels).collect()}
    assert again == {r.doc_id: r.score for r in got}
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}


def test_quality_learns_nothing_from_held_out_labels(spark):
    rows, known = quality_rows(n=120)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y, t) for i, y, t in known]
    make = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    assert {tuple(r) for r in quality.op13(docs, make(known)).collect()} == {tuple(r) for r in quality.op13(docs, make(turned)).collect()}


def test_quality_without_labels_or_documents(spark):
    rows, known = quality_rows(n=30)
    docs, none = docs_of(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.op13(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i, _, _ in known], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.op13(docs, one).collect()} == {1}
    assert quality.op13(docs_of(spark, []), one).collect() == []


def test_differences():
    rows, known = quality_rows(n=60)
    sides = [[p for (_, t, _), (_, y, _) in zip(rows, known) if y == k for p in quality.pieces(t)] for k in (0, 1)]
    bad, good = (quality.train(x * 20) for x in sides)
    texts = [rows[0][1], "", None, rows[1][1] * 30]
    assert quality.differences(texts, good, bad) == pytest.approx([brute_differences(t, good, bad) for t in texts])


def test_calibration():
    """Against the likelihood over a fine grid."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.1, 300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(12 * x + 1)))).astype(float)
    slope, bias = quality.calibrate(x, y)
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda s, b: np.sum(np.logaddexp(0, s * x + b) - soft * (s * x + b))
    assert loss(slope, bias) <= min(loss(s, b) for s in np.linspace(5, 20, 60) for b in np.linspace(0, 2, 40)) + 1e-9
    assert quality.calibrate(np.array([1.0, 2, -1, -2]), np.array([1.0, 1, 0, 0]))[0] < 10


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_quality_on_held_out_labels(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    got = quality.op13(read("documents"), read("labels")).where("held_out").join(read("labels").where("quality is not null"), "doc_id")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95
