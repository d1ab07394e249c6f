"""Methods against plain versions of themselves, and paths that small tables don't reach by themselves."""

import hashlib
import itertools
import json
import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinledger.llm import bitmaps, components, decontamination, fingerprints, license_texts, licenses, neardup, packing, pii, pretokens, quality, storage, tokencounts, urlfilter, warc
from twinledger.llm.crf import Crf
from twinledger.llm.hashing import SPACED, WordHasher, shingle_sets

REPO = Path(__file__).parents[2]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def sketch_of(text):
    return fingerprints.sketches(WordHasher(), pa.array([text]), fingerprints.FRACTION, 5)[0]


# fingerprints


def test_sketches_keep_what_they_should():
    r = random.Random(1)
    bound = int(fingerprints.FRACTION * 2**64)
    for n in (0, 1, 4, 5, 20, 68, 69, 300, 4000):
        text = " ".join(f"w{r.randrange(900)}" for _ in range(n))
        sets = next(shingle_sets(next(WordHasher().blocks(pa.array([text])))))
        assert len(sets) == len(shingles(text))
        s = sketch_of(text)
        assert s.whole == (len(sets) <= fingerprints.WHOLE)
        assert s.hashes.tolist() == [h for h in sets.tolist() if s.whole or h < bound]
        again = fingerprints.from_text(fingerprints.text_form(s))
        assert again.whole == s.whole and again.hashes.tolist() == s.hashes.tolist()


def test_merged_sketches_are_those_of_the_union():
    r = random.Random(2)
    for n, m in ((10, 20), (40, 60), (10, 900), (800, 900)):
        a, b = (np.unique(np.array([r.randrange(2**64) for _ in range(k)], np.uint64)) for k in (n, m))
        got, wanted = fingerprints.merged(fingerprints.retained(a), fingerprints.retained(b)), fingerprints.retained(np.union1d(a, b))
        assert got.whole == wanted.whole and got.hashes.tolist() == wanted.hashes.tolist()


def test_likeness_exact_for_small_and_unbiased_for_unequal_texts():
    r = random.Random(3)
    text = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    for _ in range(100):
        a, b = text(r.randint(1, 60)), text(r.randint(1, 60))
        b[: len(b) // 2] = a[: len(b) // 2]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert fingerprints.likeness(sketch_of(" ".join(a)), sketch_of(" ".join(b))) == len(x & y) / min(len(x), len(y))
    # a part of a book, and a text half of which is: the estimate is right on average, or unknown, never a wrong zero
    for n, unknown in ((6, 0.77), (12, 0.34), (40, 0.01), (200, 0.0)):
        whole, half = [], []
        for _ in range(150):
            book = text(3000)
            part, mixed = book[100 : 100 + n], book[100 : 100 + n // 2] + text(n - n // 2)
            whole.append(fingerprints.likeness(sketch_of(" ".join(part)), sketch_of(" ".join(book))))
            half.append((fingerprints.likeness(sketch_of(" ".join(mixed)), sketch_of(" ".join(book))), len(shingles(" ".join(mixed)) & shingles(" ".join(book))) / len(shingles(" ".join(mixed)))))
        assert all(x == 1 for x in whole if x is not None) and abs(sum(x is None for x in whole) / 150 - unknown) < 0.12
        known = [(x, c) for x, c in half if x is not None]
        assert abs(np.mean([x - c for x, c in known])) < 0.12


def test_fingerprints_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(n)) for n in (0, 3, 9, 60, 61, 62, 90, 400)] + [None, "x", "x"]
    rows = list(enumerate(texts)) + [(None, texts[4]), (None, texts[3]), (7, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fingerprint": F.lit(1), "k": F.lit(2)}).repartition(5)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""), reverse=True)
    wanted = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        like = lambda x, y: fingerprints.likeness(sketch_of(x), sketch_of(y)) or 0.0
        wanted.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.text_form(sketch_of(t)), fingerprints.text_form(sketch_of(edited)), like(t, edited), like(t, after)))
    assert sorted(map(str, map(tuple, fingerprints.compare_with_next(docs).collect()))) == sorted(map(str, wanted))
    kept = fingerprints.fingerprints(docs)
    assert kept.columns == ["doc_id", "text", "k", "fingerprint"] and {r.fingerprint for r in kept.filter("doc_id = 0").collect()} == {"="}


# near-duplicates


def components_of(rows):
    sets = [shingles(t) for _, t in rows]
    group = {i: i for i, _ in rows if i is not None}
    links = [(rows[a][0], rows[b][0]) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            if a is not None and b is not None:
                group[a] = group[b] = min(group[a], group[b])
    return group


@pytest.mark.parametrize("block", [5, neardup.BLOCK])
def test_near_duplicates_that_no_leader_links(spark, monkeypatch, block):
    """Groups of edited copies in which many pairs share a bucket, but not all are linked with its smallest member."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    r, rows = random.Random(5), []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(22):
            copy = list(base)
            for at in r.sample(range(120), r.randint(1, 7)):
                copy[at] = f"x{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(3, rows[100][1]), (170, "one two"), (None, rows[5][1]), (400, "")]
    calls = []
    real = neardup.linked
    monkeypatch.setattr(neardup, "linked", lambda *a, **k: calls.append(1) or real(*a, **k))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(calls) == 2  # the pairs that cross components were reached
    wanted = components_of(rows)
    assert len(got) == len(rows) and {x.id: x.component_id for x in got if x.id is not None} == wanted
    assert sorted((x.id, x.n_shingles) for x in got if x.id is not None) == sorted((i, len(shingles(t))) for i, t in rows if i is not None)
    assert len(set(wanted.values())) < len(wanted) - 20


@pytest.mark.parametrize("local", [7, components.LOCAL])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL", local)
    r = random.Random(local)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    of = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in of:
        for a, b in edges:
            if a in of and b in of:
                of[a] = of[b] = min(of[a], of[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    assert len(got) == len(of) and {x.node: x.component for x in got} == of
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimates_correct_for_chance(spark):
    """Signatures of two bits a minimum estimate the similarity without bias."""
    r = random.Random(6)
    for share in (0.3, 0.75, 0.95):
        rows = []
        for i in range(60):
            own = [r.randrange(2**64) for _ in range(400)]
            both = int(400 * 2 * share / (1 + share))
            a, b = np.unique(np.array(own, np.uint64)), np.unique(np.array(own[:both] + [r.randrange(2**64) for _ in range(400 - both)], np.uint64))
            p, q = (neardup.pack(neardup.mix(neardup.minima([x], 128)))[0].view(np.int64).tolist() for x in (a, b))
            rows.append((i, p, q))
        got = spark.createDataFrame(rows, "i int, p array<long>, q array<long>").select(neardup.estimate("p", "q").alias("x")).collect()
        assert abs(np.mean([x.x for x in got]) - share) < 0.03


def test_bitmaps():
    r = np.random.default_rng(1)
    numbers = r.integers(-(2**63), 2**63, 5000)
    b = bitmaps.bits_for(5000)
    packed = np.zeros((1 << b) // 64, np.uint64)
    for part in np.array_split(numbers.view(np.uint64), 7):
        at, bits = bitmaps.words_of(part, b)
        packed[at] |= bits
    packed = packed.view(np.uint8)
    assert bitmaps.may_have(packed, numbers.view(np.uint64)).all()
    assert bitmaps.may_have(packed, r.integers(-(2**63), 2**63, 10**6).view(np.uint64)).mean() < 1e-4
    assert [bitmaps.bits_for(n) for n in (0, 10**6, 10**7, bitmaps.MOST)] == [22, 28, 28, 30]
    assert all(len(x) == 0 for x in bitmaps.words_of(np.zeros(0, np.uint64), b))


@pytest.mark.parametrize("most", [0, bitmaps.MOST])
def test_rows_among_ids(spark, most):
    rows = spark.createDataFrame([(i, "x") for i in [*range(50), None, 7]], "id long, text string")
    ids = spark.createDataFrame([(7,), (7,), (49,), (99,), (None,)], "id long")

    def kept(rows, ids):
        some, bits = bitmaps.among(rows, ids, most)
        return sorted(r.id for r in some.mapInArrow(lambda batches: (bitmaps.sifted(b, bits) for b in batches), rows.schema).collect())

    assert kept(rows, ids) == [7, 7, 49]
    assert kept(rows, ids.limit(0)) == kept(rows.limit(0), ids) == []


def test_passages_found_from_another_folder(tmp_path):
    """Workers need no copy of the package: only the driver knows its place."""
    code = f"""
import sys
import zlib
sys.path.append({str(REPO)!r})
from pyspark.sql import SparkSession
from twinledger.llm import decontamination, neardup, runs, sentencepieces, variants
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
text = "one two three four five six seven eight nine ten"
docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, "other words")], "doc_id long, text string")
print("LEAKS", sorted(r.doc_id for r in decontamination.leaks(docs, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()))
print("GROUPS", sorted((r.id, r.component_id) for r in neardup.near_duplicates(docs).collect()))
print("WORDS", sorted(r.n_tokens for r in sentencepieces.round_trip(docs).collect()), runs.digested(runs.without_runs(docs)).count(), variants.variants(variants.word_counts(docs, shortest=3, fewest=2)).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "WORDS [" in said.stdout and "LEAKS [1, 2]" in said.stdout and "GROUPS [(1, 1), (2, 1), (3, 3)]" in said.stdout, said.stderr[-3000:]


# token counts and vocabularies


def test_token_counts_in_many_buckets(spark, monkeypatch):
    r = random.Random(7)
    texts = [" ".join(r.choice(("héllo", "x" * 90, "don't", f"n{r.randrange(3000)}", "  ")) for _ in range(r.randrange(200))) for _ in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[3])], "doc_id long, text string").repartition(3)
    library = Tokenizer.from_file(tokencounts.VOCABULARY)
    wanted = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    monkeypatch.setattr(tokencounts, "PER_BUCKET", 7)
    monkeypatch.setattr(tokencounts, "BLOCK_BYTES", 2000)
    got = tokencounts.token_counts(docs).collect()
    assert {x.doc_id: x.n_tokens for x in got} == {**wanted, None: wanted[3]} and len(got) == len(texts) + 1


def test_distinct_pieces(spark):
    names = [f"p{i}" for i in range(20_000)]
    sketches = [(tokencounts._registers(tokencounts._hashes(names[i : i + 6000])).tobytes(),) for i in range(0, 20_000, 4000)]
    got = tokencounts.distinct_pieces(spark.createDataFrame([(bytearray(s[0]),) for s in sketches], "sketch binary"))
    assert abs(got / 20_000 - 1) < 0.12
    assert tokencounts.distinct_pieces(spark.createDataFrame([], "sketch binary")) == 0


def test_vocabularies_of_another_kind_are_refused(tmp_path):
    with open(tokencounts.VOCABULARY) as f:
        file = json.load(f)
    for change in (lambda d: d.update(normalizer={"type": "NFC"}), lambda d: d["model"]["merges"].reverse(), lambda d: d["pre_tokenizer"].update(add_prefix_space=True), lambda d: d["added_tokens"][0].update(lstrip=True)):
        d = json.loads(json.dumps(file))
        change(d)
        (tmp_path / "v.json").write_text(json.dumps(d))
        with pytest.raises(ValueError):
            pretokens.fitting(str(tmp_path / "v.json"))
    pretokens.fitting(tokencounts.VOCABULARY)


# archives


def test_warc_of_many_rows_is_the_same_however_partitioned(spark, tmp_path):
    pages = spark.range(120_000).selectExpr("if(id % 3 = 0, 5, id) page_id", "concat('http://x/', id) url", "repeat(sha2(cast(id as string), 512), 1 + id % 2) html", "id as shard", "1 as key2")
    found = []
    for n, p in enumerate((pages.repartition(3), pages.repartition(17, "url"))):
        rows = warc.write(p, f"file://{tmp_path}/{n}", file_bytes=300_000)
        found.append(sorted((r.name, r.sha256, r.n_records) for r in rows.collect()))
        if not n:
            back = warc.read(rows, f"file://{tmp_path}/{n}").groupBy().agg(F.count("*").alias("n"), F.count_distinct("payload_digest").alias("d"), F.count_if(F.col("page_id") == 5).alias("hot")).first()
            assert (back.n, back.d, back.hot) == (120_000, 120_000, 40_001)
            # rows of one id are shared by several shards
            assert rows.filter("first_id <= 5 and last_id >= 5").select("shard").distinct().count() > 3
    assert found[0] == found[1] and len({name.split("-")[0] for name, *_ in found[0]}) > 10


def test_warc_places():
    r = random.Random(8)
    for _ in range(200):
        cuts = sorted({(r.randrange(4), r.randrange(4)) for _ in range(r.randrange(6))})
        keys = [(r.randrange(5) - 1, r.randrange(5)) for _ in range(40)]
        made = tuple(np.array([c[i] for c in cuts], np.int64) for i in range(2))
        got = warc.places(made, np.array([k[0] for k in keys]), np.array([k[1] for k in keys]))
        assert got.tolist() == [sum(c <= k for c in cuts) for k in keys]


def test_unnamed_attempts_are_deleted(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x")], "page_id long, url string, html string")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "_000000-00000.dead.tmp").write_bytes(b"partial")
    warc.write(pages, f"file://{tmp_path}/w")
    assert not list((tmp_path / "w").glob("*.tmp")) and len(list((tmp_path / "w").glob("*.warc.gz"))) == 1


# URLs


def test_url_verdicts_by_brute_force(spark):
    r = random.Random(9)
    urls = [None, "", "nothing"] + [f"{r.choice(('http', 'https'))}://{r.choice('abc')}{r.randrange(9)}.example.{r.choice(('org', 'com', 'net'))}/{r.choice(('fr', 'de', 'es', 'en'))}/{r.randrange(30)}{r.choice(('', '?q=1', '#x'))}" for _ in range(150)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "row": F.lit(2), "gram": F.lit("x"), "score": F.lit(0)})
    got = {x.page_id: x for x in urlfilter.filtered(pages).collect()}
    said = {i: next((v.verdict for v in urlfilter.RULES if got[i].rule == v.host + v.path), None) for i in got}
    grams = {i: [("\x02" * 3 + (u or "") + "\x03")[j : j + 4] for j in range(len(u or "") + 1)] for i, u in enumerate(urls)}
    count = {v: {} for v in ("allow", "block")}
    for i, v in said.items():
        for g in grams[i] if v else ():
            for k in range(5):
                count[v]["t", g[4 - k :]] = count[v].get(("t", g[4 - k :]), 0) + 1
                if k < 4:
                    count[v]["b", g[3 - k : 3]] = count[v].get(("b", g[3 - k : 3]), 0) + 1

    def log_ratio(g):
        p = {}
        for v, c in count.items():
            p[v] = 1 / urlfilter.ALPHABET
            for k in range(1, 5):
                p[v] = (c.get(("t", g[4 - k :]), 0) + urlfilter.WEIGHT * p[v]) / (c.get(("b", g[4 - k : 3]), 0) + urlfilter.WEIGHT)
        return np.log(p["allow"]) - np.log(p["block"])

    score = {i: np.mean([log_ratio(g) for g in grams[i]]) for i in grams}
    at = lambda v, p: sorted(score[i] for i in said if said[i] == v)[max(0, int(np.ceil(p * sum(x == v for x in said.values()))) - 1)]
    threshold = (at("allow", 0.05) + at("block", 0.95)) / 2
    for i, x in got.items():
        assert abs(x.score - score[i]) < 1e-9
        assert x.verdict == (said[i] or ("allow" if score[i] >= threshold else "block"))
    assert {x.verdict for i, x in got.items() if not said[i]} == {"allow", "block"}
    assert urlfilter.filtered(pages.limit(0)).count() == 0


# packing


def test_packing_of_nulls_and_its_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (None, "a b"), (None, "a b"), (5, "")], "doc_id long, text string")
    rows = packing.pack(docs.unionAll(odd)).collect()
    assert sorted(r.doc_tokens for r in rows if r.doc_id is None) == [1, 3, 3]
    tokens, n = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert n * packing.WINDOW <= 1.03 * tokens + packing.WINDOW
    assert sorted((r.sequence_id, r.offset) for r in rows) == sorted({(r.sequence_id, r.offset) for r in rows})


def test_least_squares_against_a_plain_solver():
    r = np.random.default_rng(2)
    histogram = np.zeros(33, np.int64)
    histogram[1:] = r.integers(0, 40, 32)
    patterns = packing.combinations(histogram, 32)
    a = np.zeros((33, len(patterns)))
    for j, p in enumerate(patterns):
        np.add.at(a[:, j], list(p), 1)
    x = np.zeros(len(patterns))
    for _ in range(3000):  # coordinate by coordinate
        for j in range(len(x)):
            x[j] = max(0, x[j] + a[:, j] @ (histogram - a @ x) / (a[:, j] @ a[:, j]))
    loss = lambda y: float(((a @ y - histogram) ** 2).sum())
    assert loss(packing.least_squares(patterns, histogram, 4000)) <= loss(x) * 1.02 + 1


# decontamination


def plain_score(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_leaks_by_aligning_all_pairs(spark):
    """Items of several classes of length, edited copies in longer texts, and texts that share short runs only."""
    r = random.Random(10)
    word = lambda: f"w{r.randrange(300)}"
    items = [[word() for _ in range(n)] for n in (3, 5, 12, 30, 64, 65, 130, 260)] + [["same"] * 12]
    texts = []
    for i in range(60):
        text = [word() for _ in range(r.randrange(80))]
        if i % 3:
            copy = list(r.choice(items))
            for _ in range(r.randrange(1 + len(copy) // 5)):
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice(([], [word()], [copy[at], word()]))
            text[r.randrange(len(text) + 1) : 0] = copy[: r.randint(len(copy) // 2, len(copy))]
        texts.append(text)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").withColumns({"item_id": F.lit("y"), "seeds": F.lit(1), "kind": F.lit(2)}).repartition(4)
    got = {(x.doc_id, x.item_id): x.score for x in decontamination.leaks(docs, bench).collect()}
    wanted = {}
    for i, t in enumerate(texts):
        for j, x in enumerate(items):
            runs = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
            if (runs(t) & runs(x)) and (score := plain_score(x, t) / (2 * len(x))) >= decontamination.THRESHOLD:
                wanted[i, j] = score
    assert got == wanted and len({j for _, j in wanted}) > 5
    assert decontamination.decontaminated(docs, bench).columns == docs.columns


# personal data


def test_viterbi_finds_the_best_of_all():
    r = np.random.default_rng(3)
    for _ in range(40):
        k, t = 3, int(r.integers(1, 5))
        banned = np.zeros((k, k), bool)
        banned[0, 2] = True
        model = Crf(k, banned, np.array([False, False, True]))
        model.emit[:6] = r.normal(size=(6, k))
        model.move = np.where(banned, -1e4, r.normal(size=(k, k)))
        model.first = np.where([False, False, True], -1e4, r.normal(size=k))
        features = r.integers(-1, 6, (1, t, 2))
        emit = model.scores(features)[0]
        value = lambda y: model.first[y[0]] + sum(emit[i, y[i]] for i in range(t)) + sum(model.move[a, b] for a, b in itertools.pairwise(y))
        best = max(itertools.product(range(k), repeat=t), key=value)
        assert tuple(model.viterbi(features, np.array([t]))[0]) == best


def test_fitted_field_meets_its_own_expectations():
    """At the optimum, features occur with each label as often as the field expects, but for the pull to small weights."""
    r = np.random.default_rng(4)
    n, t, k = 12, 3, 2
    features, labels, lengths = r.integers(0, 5, (n, t, 2)), r.integers(0, k, (n, t)), r.integers(1, t + 1, n)
    model, decay = Crf(k, np.zeros((k, k), bool), np.zeros(k, bool)), 0.5
    model.fit(features, labels, lengths, rounds=4000, decay=decay)
    gap, moves = np.zeros((5, k)), np.zeros((k, k))
    for x, y, m in zip(features, labels, lengths, strict=True):
        emit = model.scores(x[None])[0]
        every = list(itertools.product(range(k), repeat=int(m)))
        value = np.array([model.first[s[0]] + sum(emit[i, s[i]] for i in range(m)) + sum(model.move[a, b] for a, b in itertools.pairwise(s)) for s in every])
        chance = np.exp(value - value.max()) / np.exp(value - value.max()).sum()
        for s, p in [(tuple(y[:m]), 1.0), *zip(every, -chance, strict=True)]:
            for i in range(m):
                np.add.at(gap[:, s[i]], x[i], p)
            for a, b in itertools.pairwise(s):
                moves[a, b] += p
    assert np.abs(gap - decay * model.emit[:5]).max() < 0.05 and np.abs(moves).max() < 0.05


def test_pii_digest_and_joined_spans(spark):
    texts = ["a@b.cc 10.0.0.1 +49 30 1234 5678 4111 1111 1111 1111", "é a@b.cc", "", None, "call 030-1234567", "x" * 100_000 + " a@b.cc"]
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, text):
        digits = re.sub("[^0-9]", "", text)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in text.split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]

    rows = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").withColumn("spans", F.lit(1))
    for r in pii.spans(rows).collect():
        text = texts[0 if r.doc_id is None else r.doc_id] or ""
        base = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, text) if good(k, m[0]))
        listed = [f"{k}:{a}:{b}" for a, _, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in base) for k in kinds]
        assert set(listed) <= set(r.spans.split(",")) and r.n_added == len([x for x in r.spans.split(",") if x]) - len(base)


# licenses


def test_whole_licenses_wrapped_and_edited(spark):
    wrap = lambda text, n, start: "\n".join(start + " ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    r = random.Random(11)
    texts = [wrap(t, n, "# ") for t, _ in license_texts.WHOLE for n in (4, 9)]
    texts += ["x " * 3000 + " ".join(w for w in t.split() if r.random() > 0.03) + " y" * 3000 for t, _ in license_texts.WHOLE]
    labels = [label for _, label in license_texts.WHOLE for _ in range(2)] + [label for _, label in license_texts.WHOLE]
    texts += ["Redistribution is discussed here without any of a license's other words", license_texts.MIT[: len(license_texts.MIT) // 3][60:]]
    got = [r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("s"))).orderBy("doc_id").collect()]
    assert all(label in x.split(",") for label, x in zip(labels, got, strict=False)) and got[len(labels)] == ""


def test_every_block_by_brute_force(spark):
    """Texts with line breaks and templates of 5 to 400 words: no block that meets a template is missed, none is made up."""
    r = random.Random(12)
    names = [f"t{i}" for i in range(500)]
    known = [(r.sample(names, n), f"k{n}") for n in (5, 20, 64, 65, 130, 400)]
    texts = []
    for i in range(50):
        text = [r.choice(names + ["x"] * 400) for _ in range(r.randrange(300))]
        words, _ = r.choice(known)
        text[r.randrange(len(text) + 1) : 0] = [w if r.random() > 0.25 * (i % 3) else "y" for w in words for w in ([w] if r.random() > 0.1 else ["z", w])]
        texts.append(text)
    rows = spark.createDataFrame([(i, "".join(w + r.choice((" ", " ", ",\n", "\r\n\t")) for w in t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: (set(x.labels.split(",")) - {""}, round(x.score, 9)) for x in licenses.scan(rows, known=tuple((" ".join(t), label) for t, label in known), threshold=0.7).collect()}
    for i, t in enumerate(texts):
        labels, score = set(), 0.0
        for words, label in known:
            wide, own = max(licenses.WIDE, 2 * len(words)), set(words)
            most = max((len(own & set(t[j : j + wide])) for j in range(len(t))), default=0)
            if most >= np.ceil(0.7 * len(own) - 1e-9):
                labels.add(label)
                score = max(score, most / len(own))
        assert got[i] == (labels, round(score, 9))
    assert sum(bool(x) for x, _ in got.values()) > 20


# quality


def test_dual_coordinate_descent_against_a_plain_solver():
    r = np.random.default_rng(5)
    n, m = 60, 12
    dense = r.normal(size=(n, m))
    y = np.where(dense[:, 0] + 0.5 * r.normal(size=n) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.7, 1.3)
    rows = [np.arange(m)] * n
    w, bias = quality.hinge(rows, list(dense), y, cost, m, passes=2000)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * (dense @ w + b))).sum()
    best, v, b = np.inf, np.zeros(m), 0.0
    for i in range(1, 60_000):  # subgradients of the primal
        short = y * (dense @ v + b) < 1
        v, b = v - (v - ((cost * y * short) @ dense)) / i / 2, b - (b - (cost * y * short).sum()) / i / 2
        best = min(best, loss(v, b))
    assert loss(w, bias) <= best * 1.005 and best <= loss(w, bias) * 1.02


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    r = random.Random(13)
    texts = [" ".join(r.choice(("Ab", "c1", "!x", "é", "long-word-of-letters", "dd")) for _ in range(n)) for n in (0, 1, 2, 30, 500)] + ["", " "]
    together = [x.tolist() for b in WordHasher(SPACED).blocks(pa.array(texts)) for x in quality.features(b)]
    alone = [next(quality.features(next(WordHasher(SPACED).blocks(pa.array([t]))))).tolist() for t in texts]
    assert together == alone and all(x == sorted(set(x)) for x in together)


def test_ratios_by_hand():
    rows = [np.array(x, np.int32) for x in ([1, 2], [1, 3], [4], [2, 4], [1], [4, 5])]
    labels = np.array([1, 1, 0, 0, 1, 0])
    model = quality.fitted(rows, labels, np.ones(6))
    own = [1, 2, 3, 4]  # the first and the sixth are kept apart
    p = np.bincount(np.concatenate([rows[i] for i in own if labels[i]]), minlength=1 << quality.BITS) + 1.0
    q = np.bincount(np.concatenate([rows[i] for i in own if not labels[i]]), minlength=1 << quality.BITS) + 1.0
    assert np.allclose(model.squares[:10], (np.log(p / p.sum()) - np.log(q / q.sum()))[:10] ** 2)
    assert model.scores([rows[0]])[0] > 0.5 > model.scores([rows[2]])[0]


def test_quality_keeps_clashing_columns_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "!!! ###", 9) for i in range(40)] + [(None, None, 9), (3, "", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.scored(docs, model, into=("own", "decided")).columns == ["doc_id", "text", "score", "own", "decided"]
    assert quality.classified(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]
    assert quality.classified(docs.limit(0), labels).count() == 0 and quality.classified(docs, labels).count() == 42


# stages


@pytest.fixture(scope="module")
def odd_docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    own = lambda name: " ".join(f"{name}{i}" for i in range(40))
    spark.createDataFrame([(0, own("leak")), (None, own("x")), (1, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    rows = [(i, own(f"good{i}") if i % 2 else "#!$ " * 30) for i in range(60)]
    rows += [(None, None), (61, None), (62, ""), (None, own("good1")), (1, own("good1")), (63, own("leak")), (64, "mail me at a.b@example.org " + own("p")), (65, "long " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    for c in ("score", "predicted", "component_id", "kept", "id", "words", "item_id", "start", "length", "n_shingles", "place", "label"):
        docs = docs.withColumn(c, F.lit("own"))
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    return spark.read.parquet(f"{at}/documents.parquet"), at


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, odd_docs, k):
    import corpus_pipeline

    docs, at = odd_docs
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, docs.limit(0), at).count() == 0
    got = stage(spark, docs, at)
    if k < 4:
        assert got.columns == docs.columns and {tuple(r) for r in got.select("score", "kept", "item_id", "length").distinct().collect()} == {("own",) * 4}
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got.collect()) if k < 4 else []
    every = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect())
    if k == 0:
        good = [x for x in every if 0 <= x[0] < 60 and x[0] % 2]
        assert [x for x in kept if x[0] % 2 and 0 <= x[0] < 60] == good and not any(t.startswith("#") for _, t in kept)
    elif k == 1:
        gone = [every.index((-1, " ".join(f"good1{i}" for i in range(40)))), every.index((1, " ".join(f"good1{i}" for i in range(40))))]
        bad = [x for x in every if x[1].startswith("#")]
        assert kept == sorted([x for i, x in enumerate(every) if i not in gone and x not in bad[1:]])
    elif k == 2:
        assert kept == [x for x in every if "leak" not in x[1]]
    elif k == 3:
        assert kept == [(i, t.replace("a.b@example.org", "<EMAIL>")) for i, t in every]
        assert got.filter("n_chars != length(text)").count() == 0
    else:
        library = Tokenizer.from_file(tokencounts.VOCABULARY)
        assert got.agg(F.sum("length")).first()[0] == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in every)


def test_stage_by_stage_equals_run(spark, odd_docs):
    import corpus_pipeline

    docs, at = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = storage.written(stage(spark, docs, at), "stage")
    whole = corpus_pipeline.run(spark, at)
    name = lambda df: sorted(map(str, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert name(whole) == name(docs) and whole.count() > 0


def test_only_tables_of_the_shared_folder_are_deleted(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    own = storage.written(spark.range(3).toDF("x"), "own")
    storage.forget(own)
    with pytest.raises(ValueError):
        storage.forget(spark.read.parquet(str(tmp_path / "t")))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_scores_end_to_end(spark):
    """Scores of documents against a plain training: counts in dictionaries, the same order of examples, and the logistic fit
    as the minimum that plain descent finds."""
    r = random.Random(12)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    docs = []
    for i in range(120):
        label = i % 2
        words = [r.choice(good if r.random() < (0.7 if label else 0.35) else bad) for _ in range(r.randrange(5, 40))]
        docs.append((i, " ".join(words), label))
    docs.append((500, None, None))
    table = spark.createDataFrame(docs, "doc_id long, text string, quality int").repartition(3)
    got = {x.doc_id: x.score for x in quality.classified(table.select("doc_id", "text"), table.filter("quality is not null").select("doc_id", "quality")).collect()}
    own = {i: next(quality.features(next(WordHasher(SPACED).blocks(pa.array([t or ""]))))).tolist() for i, t, _ in docs}
    crc = lambda i: zlib.crc32(str(i).encode())
    used = sorted((i for i, _, y in docs if y is not None and crc(i) % 4 != 2), key=lambda i: zlib.crc32(b"order%d" % i))
    y = {i: label for i, _, label in docs}
    fit, apart = [i for k, i in enumerate(used) if k % 5], [i for k, i in enumerate(used) if not k % 5]
    count = [{}, {}]
    for i in fit:
        for x in own[i]:
            count[y[i]][x] = count[y[i]].get(x, 0) + 1
    total = [sum(c.values()) + (1 << quality.BITS) for c in count]
    ratio = lambda x: np.log((count[1].get(x, 0) + 1) / total[1]) - np.log((count[0].get(x, 0) + 1) / total[0])
    values = {i: {x: ratio(x) for x in own[i]} for i in own}
    unit = {i: {x: v / np.sqrt(sum(u * u for u in values[i].values()) + 1e-9) for x, v in values[i].items()} for i in own}
    share = {c: len(fit) / (2 * sum(y[i] == c for i in fit)) for c in (0, 1)}
    w, bias, alpha, rng = {}, 0.0, dict.fromkeys(fit, 0.0), np.random.default_rng(3)
    for _ in range(12):
        moved = 0.0
        for k in rng.permutation(len(fit)):
            i = fit[k]
            sign = 1 if y[i] else -1
            slack = sign * (sum(w.get(x, 0) * v for x, v in unit[i].items()) + bias) - 1
            new = min(max(alpha[i] - slack / (sum(v * v for v in unit[i].values()) + 1), 0), share[y[i]])
            d = (new - alpha[i]) * sign
            for x, v in unit[i].items():
                w[x] = w.get(x, 0) + d * v
            bias, alpha[i], moved = bias + d, new, max(moved, abs(d))
        if moved < 1e-3:
            break
    margin = {i: sum(w.get(x, 0) * v for x, v in unit[i].items()) + bias for i in own}
    labelled = [i for i, _, label in docs if label is not None and crc(i) % 4 != 2]
    weight = {c: sum(y[i] == c for i in labelled) / sum(y[i] == c for i in used) for c in (0, 1)}
    n = [sum(y[i] == c for i in apart) for c in (0, 1)]
    aim = {1: 1 - 1 / (n[1] + 2), 0: 1 / (n[0] + 2)}
    a, b = 1.0, 0.0
    for _ in range(40_000):
        z = {i: 1 / (1 + np.exp(-(a * margin[i] + b))) for i in apart}
        da = sum(weight[y[i]] * (aim[y[i]] - z[i]) * margin[i] for i in apart) - 1e-3 * a
        db = sum(weight[y[i]] * (aim[y[i]] - z[i]) for i in apart) - 1e-3 * b
        a, b = a + 0.1 * da, b + 0.1 * db
        if abs(da) + abs(db) < 1e-7:
            break
    for i in own:
        assert abs(got[i] - 1 / (1 + np.exp(-(a * margin[i] + b)))) < 1e-3
    assert len({round(x, 3) for x in got.values()}) > 60
