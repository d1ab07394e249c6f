"""Spelling variants, periodic runs and SentencePiece ids against plain versions of themselves."""

import hashlib
import random
import re
from array import array
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import sentencepiece

from twinledger.llm import hashing, queries, runs, sentencepieces, variants

# spelling variants


def letters(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[A-Za-zÀ-ÿ]+", text or "")]


def plain_variants(counts, times=5):
    alphabet = sorted({c for w in counts for c in w})
    near = {}
    for w in counts:
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
        other = {w[:i] + c + w[i + k :] for k in (0, 1) for i in range(len(w) + 1 - k) for c in alphabet}
        near[w] = [x for x in (cut | other) - {w} if x in counts]
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= times * counts[w]:
            form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


def collected(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_of_texts(spark, tmp_path):
    r = random.Random(4)
    bases = ["letters", "lettres", "summer", "grüße__".strip("_"), "aaaaaaa", "missing", "MISSING"]
    docs = []
    for i in range(300):
        words = []
        for _ in range(r.randrange(0, 60)):
            w = r.choice(bases)
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abéÿ") + w[k:], w[:k] + r.choice("abéÿ") + w[k + 1 :]])
            words.append(w)
        docs.append((i, r.choice([" ", ", ", "-9 ", "×"]).join(words), "x"))
    docs += [(300, None, None), (301, "", None), (302, "aaaaaaaaaa " * 30, None), (302, "aaaaaaaaaa " * 30, None), (303, "q" * 3000 + " " + "q" * 3001 + " ", None), (304, ("q" * 3000 + " ") * 25 + ("q" * 3001 + " ") * 4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n string").repartition(5)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = collected(queries.op11_spelling_variants(spark, str(tmp_path)))
    counts = Counter()
    for i, text, _ in docs:
        for w in letters(text):
            h = crc32(f"{i}:{w}".encode())
            if not h % 199:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    wanted = plain_variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    assert got == wanted and any(x[3] > 3 for x in wanted.values()) and any(x[0] for x in wanted.values())


@pytest.mark.parametrize("seed", range(3))
def test_variants_of_dense_words(spark, seed):
    r = random.Random(seed)
    words = {"".join(r.choice("ab\U0001f642") for _ in range(r.randrange(1, 6))): r.randrange(1, 400) for _ in range(150)}
    assert collected(variants.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(4), 2)) == plain_variants(words, 2)


def test_words_whose_keys_collide(spark, monkeypatch):
    words = {"".join(c): 1 + 7 * i for i, c in enumerate((a, b, c, d) for a in "ab" for b in "ab" for c in "cd" for d in "ef")} | {"abc": 900, "bcdef": 3}
    plain = variants.keys_of
    monkeypatch.setattr(variants, "keys_of", lambda w: ((x := plain(w))[0] % np.uint64(3), *x[1:]))
    got = list(variants._keys(iter([__import__("pyarrow").record_batch({"id": list(range(len(words))), "word": list(words)})])))
    rows = sorted((k, s != variants.ITSELF, i, s) for b in got for k, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True))
    names = list(words)
    batch = __import__("pyarrow").record_batch({"key": [x[0] for x in rows], "stands": [x[3] for x in rows], "id": [x[2] for x in rows], "word": [names[x[2]] for x in rows], "n": [words[names[x[2]]] for x in rows]})
    near, best = Counter(), {}
    for b in variants._near(iter([batch])):
        for i, k, n, w, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
            near[names[i]] += k
            best[names[i]] = min(best.get(names[i], (0, "")), (-n, w))
    wanted = plain_variants(words, 1)
    assert {w: near[w] for w in words} == {w: x[3] for w, x in wanted.items()}
    assert all(words[w] == 0 or best.get(w, (0, ""))[1] == (x[0] or best.get(w, (0, ""))[1]) for w, x in wanted.items())


def test_keys_are_those_of_strings():
    r = random.Random(1)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(60)]
    key, of, stands = variants.keys_of(words)
    seen = {}
    for k, i, s in zip(key.tolist(), of.tolist(), stands.tolist(), strict=True):
        w, at = words[i], s if s >= 0 else -2 - s
        text = w if s == -1 else w[:at] + ("?" if s >= 0 else "") + w[at + 1 :]
        assert seen.setdefault(k, text) == text
    assert len(set(seen.values())) == len(seen)


def test_roots_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100 + i, 7) for i in range(30)], "id long, root long")
    assert {r.root for r in variants.roots_of(links).collect()} == {40}


def test_no_words(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert variants.variants(variants.word_counts(none)).count() == 0 == variants.variants(variants.word_counts(none.limit(0))).count()


# periodic runs


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            b = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - b >= max(6, 4 * q):
                out.setdefault((b, i + q), q)
            i += i == b
    return sorted(((b, e, q) for (b, e), q in out.items()), key=lambda x: (x[0], x[2]))


def repetitive(r, n, k):
    out = []
    while len(out) < n:
        if not out or r.random() < 0.5:
            out.append(r.randrange(k))
        else:
            w = r.randrange(1, min(9, len(out)) + 1)
            s = r.randrange(len(out) - w + 1)
            out += out[s : s + w] * r.randrange(1, 7)
    return out + out[: r.randrange(n + 1)] * r.randrange(2)


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_all_periods(seed):
    r = random.Random(seed)
    for _ in range(1500):
        words = repetitive(r, r.randrange(0, 60), r.choice([1, 2, 2, 3, 4]))
        assert runs.runs_of(words) == plain_runs(words)


def test_factors_are_the_longest_that_began_before():
    r = random.Random(9)
    for _ in range(300):
        words = repetitive(r, r.randrange(1, 40), 3)
        at = 0
        for s, t, j in runs.factors(words):
            assert s == at and (j < 0) == (words[s] not in words[:s])
            if j >= 0:
                assert j < s and words[j : j + t - s] == words[s:t]
                assert t == len(words) or not any(words[i : i + t + 1 - s] == words[s : t + 1] for i in range(s))
            at = t
        assert at == len(words)


def test_zones_hold_all_runs():
    r = random.Random(3)
    for _ in range(200):
        texts = [repetitive(r, r.randrange(0, 50), r.choice([2, 3, 30])) for _ in range(4)]
        bounds = np.cumsum([0, *map(len, texts)])
        spans = list(runs.zones(hashing.mix(np.array(sum(texts, []), np.uint64)), bounds))
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        for first, words in zip(bounds.tolist(), texts, strict=False):
            for b, e, _ in plain_runs(words):
                assert sum(x <= first + b and first + e <= y for x, y in spans) == 1


def test_runs_of_documents(spark, tmp_path):
    r = random.Random(6)
    text = lambda n, k: r.choice([" ", "\n\t"]).join(f"W{x}é" if x % 2 else f"w{x} " for x in repetitive(r, n, k))
    docs = [(i, text(r.randrange(1, 90), r.choice([2, 3, 50]))) for i in range(400)] + [(401, None), (402, ""), (403, " \n "), (404, "a " * 70_000), (405, "a A " * 9), (None, "x y " * 20), (None, "x y " * 20), (5, "x")]
    spark.createDataFrame([(i, t, 3, "r") for i, t in docs], "doc_id long, text string, runs long, start string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect()))
    wanted = Counter()
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), crc32(("" if i is None else str(i)).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = [(0, 70_000, 1)] if n == 70_000 else plain_runs(words)
        gone = {k for b, e, q in found for k in range(b + q, e)}
        b, e, q = min(found, key=lambda x: (-(x[1] - x[0]) / x[2], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{x},{y - x},{z}\n" for x, y, z in found)
        rest = " ".join(w for k, w in enumerate(words) if k not in gone)
        wanted[(i, len(found), b, e and e - b, q, e and 1000 * (e - b) // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())] += 1
    assert got == wanted
    assert runs.digested(runs.without_runs(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


# SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)


def strange(r):
    if r.random() < 0.5:
        return "".join(r.choice("ab e▁ \n\t<0x41>s/é中😀​\x00ßﬁ的is") for _ in range(r.randrange(0, 30)))
    return "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x20, 0x3000), r.randrange(0x10000, 0x11000)])) for _ in range(r.randrange(0, 40)))


def test_ids_and_texts_are_the_librarys(library):
    r, pieces = random.Random(2), sentencepieces.pieces_of(sentencepieces.MODEL)
    texts = [strange(r) for _ in range(3000)] + ["", " ", "  x", "a" * 5000, " " * 1000, "<s></s><unk>", "ab" * 3000, "�", "▁"]
    for text in texts:
        wanted = library.encode(text, add_bos=True, add_eos=True)
        assert list(array("I", pieces.encoded(text))) == wanted and pieces.decoded(array("I", wanted).tobytes()) == library.decode(wanted)


def test_any_ids_are_decoded_as_the_library_does(library):
    r, pieces = random.Random(3), sentencepieces.pieces_of(sentencepieces.MODEL)
    for _ in range(3000):
        ids = [r.choice([1, 2, 0, 3 + r.randrange(256), 3 + 0xE4, 3 + 0x80, 29871, r.randrange(259, 32000), 3 + 0x20]) for _ in range(r.randrange(0, 7))]
        assert pieces.decoded(array("I", ids).tobytes()) == library.decode(ids)
    with pytest.raises(IndexError):
        pieces.decoded(array("I", [32_000]).tobytes())


def test_last_pieces_are_those_of_plain_merging():
    r, pieces = random.Random(5), sentencepieces.pieces_of(sentencepieces.MODEL)
    for _ in range(800):
        text = "".join(r.choice(["the", "in", "ing", "▁", "a", "st", "é", "的", "\U0001f642", "tion", "0"]) for _ in range(r.randrange(1, 9)))
        assert [pieces.names[i] for i in pieces.split(text)] == pieces.merged(text)


def test_kept_tables_start_afresh(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT", 3)
    monkeypatch.setattr(sentencepieces, "KEPT_PAIRS", 3)
    pieces, text = sentencepieces.Pieces(sentencepieces.MODEL), "some words and other ones, then words again and again " * 3
    assert list(array("I", pieces.encoded(text, False))) == library.encode(text) and len(pieces.known) + len(pieces.known.before) <= 3 and len(pieces.beside) <= 3


def test_documents_round_trip(spark, library, tmp_path):
    r = random.Random(8)
    docs = [(i, strange(r)) for i in range(200)] + [(201, None), (202, ""), (None, "no id"), (202, "again"), (203, "long " * 300_000), (204, "x" * 100_000)]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, ids string, decoded long").repartition(3)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, queries.op13_sentencepiece(spark, str(tmp_path)).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = Counter()
    for i, t in docs:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        wanted[(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()))] += 1
    assert got == wanted
    parts = sentencepieces.decoded(sentencepieces.encoded(rows))
    assert Counter(map(tuple, parts.collect())) == Counter((i, library.decode(library.encode(t or ""))) for i, t in docs)
    assert sentencepieces.round_trip(rows.limit(0)).count() == 0
