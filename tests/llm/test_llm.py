"""Operators against plain versions on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinledger.llm import decontamination, fingerprints, licenses, neardup, packing, pii, quality, tokencounts, urlfilter, warc

R = random.Random(5)
WORDS = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(60)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


BASE = prose(80)
TEXTS = [None, "", "   ", "one two", BASE, BASE, BASE + " extra", BASE.replace("Word1 ", "Word2 ", 1), prose(3000), prose(12), "a\n\n b  c'll 12345 日本語 🙂 <|endoftext|>x!<|endoftext|>", "x" * 5000,
    "Licensed under the Apache License, Version 2.0.\nunder the MIT license", "mail 12@mail3.example.com, +1 (523) 555-1055, at 8.196.197.208; call (415) 555-1234"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "words", i) for i, t in enumerate(TEXTS)] + [(None, BASE, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, words string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_fingerprints(docs, none):
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs.filter("doc_id is not null")).collect()}
    for i, t in enumerate(TEXTS):
        t, other = t or "", TEXTS[i - 1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + other[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[4].fingerprint == got[5].fingerprint and got[5].near_next == 1
    assert fingerprints.compare_with_next(none).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, none):
    got = {r.id: r for r in neardup.near_duplicates(docs).collect() if r.id is not None}
    sets = [shingles(t) for t in TEXTS]
    group = list(range(len(TEXTS)))
    for _ in TEXTS:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in got] == [(len(sets[i]), group[i], group[i] == i) for i in got]
    assert neardup.near_duplicates(none).count() == 0


def test_token_counts(docs, none):
    library = Tokenizer.from_file(tokencounts.VOCABULARY)
    got = {r.doc_id: r for r in tokencounts.token_counts(docs).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert len(got) == len(TEXTS) + 1 and tokencounts.token_counts(none).count() == 0


def test_packing(docs, none):
    library = Tokenizer.from_file(tokencounts.VOCABULARY)
    rows = packing.pack(docs.filter("doc_id is not null")).collect()
    seen, places = {}, {}
    for r in rows:
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids)
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece(seed):
    r = np.random.default_rng(seed)
    histogram = np.zeros(257, np.int64)
    np.add.at(histogram, r.integers(1, 257, 5000) if seed else np.full(5000, 200), 1)
    used = np.zeros_like(histogram)
    for fill, n in packing.plan(histogram, 256):
        assert sum(fill) <= 256
        for x in fill:
            used[x] += n
    assert (used == histogram).all()


def test_warc(spark, none):
    big = "<p>" + "é" * 800
    rows = [(i, f"http://a.example/{i}", h) for i, h in enumerate([big, "small", big, None, "small", big + "x", big])] + [(None, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    for i, _, h in rows:
        data = (h or "").encode()
        same = h == big and i != 6
        assert got[i] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if same else "response", 6 if same else None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_is_deterministic_and_rolls(spark, tmp_path):
    pages = spark.range(200).selectExpr("id page_id", "concat('http://x/', id) url", "repeat(sha2(cast(id as string), 512), 20) html")
    first, second = (sorted((r.name, r.sha256) for r in warc.write(p, f"file://{tmp_path}/{n}", file_bytes=20_000).collect()) for n, p in (("a", pages), ("b", pages.repartition(7))))
    assert [s for _, s in first] == [s for _, s in second] and len(first) > 4
    assert not list(tmp_path.glob("*/*.tmp"))


def brute_rules(url):
    _, there, rest = (url or "").partition("://")
    m = re.match(r"([^/?#]*)([^?#]*)", rest if there else "")
    host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1", "http://example.org/en/12?x", "http://x.org", "http://org/", "https://b.example.com/fr/x#y", "http://c.example.net/en/5", "a://b://c/d?e", "http://notorg/", "http://example.org/en/12?x"]
    got = urlfilter.filtered(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute_rules(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")


def test_url_rules_of_the_contract(spark):
    urls = {
        "http://x.org/a": ("org/", "allow"), "http://www.example.org/es/1": ("example.org/es/", "block"), "http://example.org/en/12": ("example.org/en/1", "block"), "http://example.org/en/2": ("org/", "allow"),
        "https://a.COM/fr/x?y": ("com/fr/", "allow"), "http://b.com/de/": ("com/de/", "block"),
    }
    got = urlfilter.filtered(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {list(urls)[r.page_id]: (r.rule, r.verdict) for r in got} == urls


def test_url_model(spark):
    texts = [("a.org/x", "allow"), ("a.org/y", "allow"), ("b.com/fr/é", "block"), ("c.net", None)]
    grams = [(("\x02" * 3 + t + "\x03")[i : i + 4], v) for t, v in texts for i in range(len(t) + 1)]
    rows = spark.createDataFrame(grams, "gram string, v string").groupBy("gram").agg(F.count_if(F.col("v") == "allow").alias("a"), F.count_if(F.col("v") == "block").alias("r"))
    for r in urlfilter.log_ratios(rows).collect():
        p = {}
        for c in ("allow", "block"):
            p[c] = 1 / urlfilter.ALPHABET
            for k in range(1, 5):
                tail = sum(v == c and g[4 - k :] == r.gram[4 - k :] for g, v in grams)
                before = sum(v == c and g[4 - k : 3] == r.gram[4 - k : 3] for g, v in grams)
                p[c] = (tail + urlfilter.WEIGHT * p[c]) / (before + urlfilter.WEIGHT)
        assert abs(r.ratio - np.log(p["allow"] / p["block"])) < 1e-9


def test_alignment():
    def plain(a, b):
        h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    pairs = [([R.randint(2, 6) for _ in range(R.randint(1, 12))], [R.randint(2, 6) for _ in range(R.randint(1, 20))]) for _ in range(300)]
    best, start, stop = decontamination.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert best.tolist() == [plain(a, b) for a, b in pairs]
    assert all(plain(a, b[i:j]) == s for (a, b), i, j, s in zip(pairs, start, stop, best, strict=True))


def test_leaks(spark, docs):
    items = [prose(20) for _ in range(5)]
    edited = items[1].split()
    edited[7] = "other"
    del edited[13]
    rows = [(0, prose(50) + " " + "".join(c.upper() if c.isascii() else c for c in items[0]).replace(" ", ", ") + " " + prose(9)), (1, " ".join(edited)), (2, prose(300)), (3, None), (4, ""), (5, items[0]), (5, items[0])]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (8, "too short"), (None, items[2])], "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(table, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (5, 0)}
    assert (got[0, 0].start_word, got[0, 0].end_word, got[0, 0].score) == (50, 70, 1.0)
    assert sorted(r.doc_id for r in decontamination.decontaminated(table, bench).collect()) == [2, 3, 4]
    assert decontamination.leaks(table, bench.limit(0)).count() == decontamination.leaks(table.limit(0), bench).count() == 0


def test_leaks_of_edited_copies(spark, monkeypatch):
    own = lambda name: [f"{name}{i}" for i in range(40)]
    edited = lambda words, k: " ".join("other" + str(k) if i % 6 == 5 else w for i, w in enumerate(words))
    bench = spark.createDataFrame([(0, " ".join(own("a"))), (1, " ".join(own("b")))], "item_id long, text string")
    # item 0: edited copies alone; item 1: edited alike, beside an exact one
    rows = [(0, edited(own("a"), 0)), (1, " ".join(own("b"))), *((i, edited(own("b"), 1)) for i in range(2, 60)), (60, " ".join(own("b")[:4] + own("c")))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = {(0, 0): 62 / 80, (1, 1): 1.0} | {(i, 1): 62 / 80 for i in range(2, 60)}
    assert {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(table, bench).collect()} == wanted
    monkeypatch.setattr(decontamination, "HOT", 7)  # seeds under several keys
    assert {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(table, bench).collect()} == wanted


def test_pii(docs, none):
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    r = got[len(TEXTS) - 1]
    assert (r.n_email, r.n_ip, r.n_phone, r.n_card) == (1, 1, 1, 0) and "phone" in r.spans.split(",")[-1]
    assert all(got[i].spans == "" for i in range(len(TEXTS) - 4))
    last = pii.redacted(docs).filter(F.col("doc_id") == len(TEXTS) - 1).first()
    assert last.text.startswith("mail <EMAIL>, <PHONE>, at <IP>; call ") and last.n_chars == len(last.text)
    assert pii.redacted(docs).columns == docs.columns and pii.spans(none).count() == 0


def test_pii_held_out():
    model, hit, missed, wrong = pii.trained(), 0, 0, 0
    for text, spans in pii.labelled_table(300, 99):
        got = set(pii.added_spans([text], [[]], model)[0])
        hit, missed, wrong = hit + len(got & set(spans)), missed + len(set(spans) - got), wrong + len(got - set(spans))
    assert hit / (hit + missed) > 0.8 and hit / (hit + wrong) > 0.8


def test_patterns():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for _ in range(3000):
        t = "".join(R.choice("a.@-+1 23()%x45.9") for _ in range(R.randint(1, 60)))
        wanted = []
        for i, (k, p) in enumerate(kinds.items()):
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[k]
                if good:
                    wanted.append((m.start(), i, m.end(), k))
        assert pii.base_spans(t) == [(a, b, k) for a, _, b, k in sorted(wanted)]


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = got[12]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (12, 2, 3, 8, "apache-2,mit", "apache-2,mit", 1.0)
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].labels, got[0].score) == (0, 0, None, "", 0.0)
    assert licenses.scan(none).count() == 0


def test_licenses_wrapped_and_long(spark):
    own = random.Random(1)
    long = [f"t{i}" for i in range(300)] + ["of"] * 50
    known = (*licenses.TEMPLATES, (" ".join(long), "long"))
    wrap = lambda words, n: "\n".join(" * " + " ".join(words[i : i + n]) for i in range(0, len(words), n))
    part = [w for w in long if own.random() < 0.9]
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mit = "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy\nof this software"
    half = mit.replace("\n", " ").split()
    rows = [bsd, mit, "x\n" * 100 + wrap(part, 9) + "\ny" * 100, " ".join(long[:200]), " ".join(half[:8]) + " x" * 70 + " " + " ".join(half[8:]), *([" ".join(half[:8]), " ".join(half[8:])])]
    got = [r for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1), known=known).orderBy("doc_id").collect()]
    assert [r.labels for r in got] == ["bsd", "mit", "long", "", "", "", ""]
    assert (got[0].score, got[1].score, got[2].score) == (1.0, 1.0, len(set(part)) / 301)


def test_license_blocks_by_brute_force():
    own = random.Random(2)
    names = [f"t{i}" for i in range(12)]
    known = [(own.sample(names, 6) + own.sample(names, 2), f"k{i}") for i in range(4)]
    texts = [[own.choice(names[: own.randint(1, 12)] + ["x"] * 120) for _ in range(own.choice([0, 3, 40, 900, 3000]))] for _ in range(60)]
    hashes = [licenses.hashed([" ".join(t)])[0] for t, _ in known]
    tokens = np.unique(np.concatenate(hashes))
    made = licenses.Templates(tokens, [np.searchsorted(tokens, np.unique(h)) for h in hashes], [len(h) for h in hashes], [label for _, label in known], np.arange(len(tokens)), 0.5)
    got = {}
    for words in licenses.WordHasher(licenses.ALPHANUMERIC).blocks(pa.array([" ".join(t) for t in texts])):
        got |= {(words.first + d, i): s for d, i, s in zip(*(x.tolist() for x in made.matches(words)), strict=True)}
    wanted = {}
    for d, text in enumerate(texts):
        for i, (t, _) in enumerate(known):
            most = max((len(set(text[j : j + 64]) & set(t)) for j in range(len(text))), default=0)
            if most >= made.least[i]:
                wanted[d, i] = most / len(set(t))
    assert got == wanted and 10 < len(wanted) < 230


def test_quality_held_out(spark):
    rows = [(i, prose(60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(60).split())) for i in range(300)] + [(300, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(7, None), (None, 1)], "doc_id long, quality int")
    got = [r for r in quality.classified(docs, labels).collect()]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    assert {r.score for r in quality.classified(docs, labels.limit(0)).collect()} == {0.5}


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    kept = corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    whole = corpus_pipeline.run(spark, data)
    ids = {r.doc_id for r in whole.select("doc_id").distinct().collect()}
    assert ids and ids <= {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_rows_without_or_with_one_id(spark, tmp_path):
    import corpus_pipeline

    own = lambda name: " ".join(f"{name}{i}" for i in range(40))
    spark.createDataFrame([(0, own("leak"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, own("a")), (None, own("a")), (5, own("a")), (7, own("b")), (7, own("b")), (7, own("c")), (None, own("d")), (None, own("d")), (None, None), (None, "x " + own("leak")), (9, own("leak") + " y"), (9, own("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).repartition(3)
    got = corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path))
    key = lambda r: (r[0] or -1, r[1] or "")
    leaking = {"x " + own("leak"), own("leak") + " y"}
    wanted = [(5, own("a")), (7, own("b")), (7, own("c")), (None, own("d")), (None, None), (9, own("e"))]
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect() if r.text not in leaking), key=key) == sorted(wanted, key=key)
    assert got.filter(F.col("text").contains("leak")).count() == 1
    clean = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted((r for r in rows if r[1] not in leaking), key=key)


def test_warc_against_sql(spark):
    from twinledger.llm import queries

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    got = queries.op4_warc_writer(spark, data).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, con.execute(queries.oracle_sql()["op4_warc_writer"]).fetchall()))
