"""The training-data operators against plain versions, and their edge cases."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from spindrel.llm import bpe, common, components, contamination, fmindex, line_dedup, lm, packing, pii, quality, sharding, simhash, substring, toxicity
from spindrel.llm.queries import oracle_sql, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "x" * 5000), (6, "a b " * 700), (7, "Tie tie TIE.\nTie tie TIE.\n\nlast"), (7, "Tie tie TIE.\nTie tie TIE.\n\nlast"), (None, "no id here"), (None, None), (8, "漢字 🙂 éà ß İ"), (9, "the quick brown fox jumps over the lazy dog " * 5)]
# Extra columns with names that the operators use themselves.
CLASH = "doc_id bigint, text string, fp string, n_words string, size string, component_id string, law string, q_votes string, k1 string, removed string, given string, kept string, label string, grp string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *["x"] * 12) for i, t in ODD], CLASH).repartition(3)


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def ids_of(spark, text):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(spark, docs, texts, odd, none):
    enc = ids_of(spark, "")
    for frame in (docs, odd):
        for r in bpe.encode(frame, PATH, PATTERN).join(frame.select("doc_id", "text"), "doc_id").collect():
            assert r.ids == enc.encode_ordinary(r.text or "")
    rng = random.Random(1)
    odd_texts = ["".join(rng.choice("aaabbeehht  \n1!é漢🙂'") for _ in range(rng.randint(0, 200))) for _ in range(400)] + ["a" * 9999, "ab" * 3000]
    codec = bpe.Codec(bpe.Vocabulary(bpe.read_ranks(PATH), PATTERN), 100)
    for text, ids in zip(odd_texts, codec.encode(odd_texts)):
        assert ids.tolist() == enc.encode_ordinary(text) and codec.decode(ids) == text.encode()
    assert bpe.digests(none, PATH, PATTERN).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()}
    assert back == texts


def test_bpe_query(spark, sf, texts):
    enc = ids_of(spark, "")
    found = queries()["op1_byte_bpe"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def plain_hits(text, items, window=13):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = fold(text), set(), set()
    for item, body in items:
        w = fold(body)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            part = w[j : j + window]
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_contamination(spark, odd, none, docs, sf):
    items = [(1, "Quick brown FOX"), (2, None), (3, "..."), (4, "the lazy dog the quick brown fox jumps over the lazy dog the quick brown"), (4, "one"), (5, "漢字"), (5, "fox, jumps")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(plain_hits(t, [x for x in items if x[1]]) for _, t in ODD)
    for bound in (1 << 20, 40):  # one automaton, and blocks
        got = contamination.scan(odd, bench, max_bytes=bound).collect()
        assert sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert contamination.scan(none, bench).count() == 0
    assert not contamination.scan(odd, bench.where("false")).where("contaminated").count()
    assert contamination.remove(odd, bench).columns == odd.columns
    r = contamination.scan(odd.where("doc_id = 9"), bench).first()
    raw = ODD[-1][1].encode()
    assert all(raw[s.first : s.last].split() for s in r.spans)


def plain_removed(documents, window=20):
    seen, out = set(), {}
    for i in sorted(documents):
        words = WORD.findall(documents[i])
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            if (key := tuple(words[j : j + window])) in seen:
                gone[j : j + window] = [True] * window
            seen.add(key)
        left = [w for w, g in zip(words, gone) if not g]
        out[i] = (len(words), len(words) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


def test_substring(spark, texts, docs, odd, none):
    rng = random.Random(2)
    made = {i: " ".join(rng.choice(["a", "b", "c"] if i % 3 else ["x", "y"]) for _ in range(rng.choice([5, 19, 20, 21, 60, 300]))) for i in range(50)} | {90: "q " * 22, 91: " ".join("mnop" * 8), 92: "a " * 500}
    frame = spark.createDataFrame(list(made.items()), "doc_id bigint, text string").repartition(4)
    for given, plain, size in ((frame, made, 2000), (docs, texts, 100_000)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(given, group_bytes=size).collect()}
        assert got == plain_removed(plain)
    assert substring.deduplicate(odd).count() == len(ODD) and substring.deduplicate(none).count() == 0


def test_substring_edge_cases(spark):
    rng = random.Random(12)
    long = [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(500)) for _ in range(20_000)]
    rows = [("z", " ".join(long)), ("y", " ".join(long[5000:9000])), (None, " ".join(long[100:130])), ("a", "x" * 3_000_000), ("b", "x" * 3_000_000)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id string, text string"), group_bytes=30_000).collect()}
    want = plain_removed({i or "~": t for i, t in rows})
    assert got == {i: want[i or "~"] for i, _ in rows}
    last = (1 << 63) - 1
    same = spark.createDataFrame([(None, " ".join(long[:40])), (last, " ".join(long[:40]))], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in substring.deduplicate(same).collect()} == {last: 0, None: 40}


def test_fmindex():
    """Intervals, groups, places and matching statistics, against the text that the index does not keep."""
    rng = np.random.default_rng(0)
    text, depth = rng.integers(1, 4, 400), 6
    index = fmindex.FMIndex(text, depth, np.arange(400) * 7 % 400, 32)
    assert not {"text", "suffixes"} & set(vars(index)) and len(index.places) < 20
    starts_of = lambda part: [i for i in range(len(text) - len(part) + 1) if (text[i : i + len(part)] == part).all()]
    for size in (1, 3, 6):
        for start in range(0, 390, 17):
            low, high = np.array([0]), np.array([index.size])
            for s in text[start : start + size][::-1]:
                low, high = index.extend(np.array([s]), low, high)
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == starts_of(text[start : start + size])
    # documents that the index does not hold, with words that it does not know
    words = np.concatenate([text[50:90], rng.integers(1, 6, 300), text[10:40], [99], text[200:230]])
    first, last = np.array([0, 150, 300]), np.array([150, 300, len(words)])
    got = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for _, at, low, high in index.matching(words, first, last) for p, a, b in zip(at, low, high)}
    want = {p: found for a, b in zip(first, last) for p in range(a, b - depth + 1) if (found := starts_of(words[p : p + depth]))}
    assert got == want and len(got) > 50
    least = {int(p): int(index.least[g]) for _, at, low, _ in index.matching(words, first, last) for p, g in zip(at, index.group_of(low))}
    assert least == {p: min(i * 7 % 400 for i in found) for p, found in want.items()}


def test_substring_by_the_index(monkeypatch):
    """What is removed follows from backward search: with an empty wavelet matrix nothing is found."""
    texts = [b" ".join(b"%d" % (x % 9) for x in range(60)), b" ".join(b"%d" % (x % 9) for x in range(3, 50)), b" ".join(b"%d" % x for x in range(30))]
    args = texts, np.array([0, 1, 2]), np.array([0, 0, 0]), 20
    segment, offset, windows = substring.repeated(*args)
    assert list(zip(segment.tolist(), offset.tolist(), windows.tolist())) == [(0, 9, 32), (1, 0, 28)]
    monkeypatch.setattr(fmindex.WaveletMatrix, "rank", lambda self, symbol, at: np.zeros(len(at), np.int64))
    assert not len(substring.repeated(*args)[0])


TOXIC_SAMPLE = ["you are an idiot and a worthless clown", "the garden is pleasant and the path is long", "stupid loser"] * 50


def test_toxicity_restores():
    model = toxicity.Model(toxicity.class_counts(TOXIC_SAMPLE))
    given = ("1d10t", "st.u.p.i.d", "cl0wn", "idiiiiot", "garden", "i d i o t", "y o u a r e a n i d i o t", "i.d.i.o.t.a.n.d.c.l.o.w.n", "a 1 d 1 o t")
    assert [toxicity.restore(w, model) for w in given] == ["idiot", "stupid", "clown", "idiot", "garden", "idiot", "you are an idiot", "idiot and clown", "a idiot"]
    # of any length, and in time that does not grow with its square
    assert toxicity.restore("-".join(["1d10t", "cl0wn"] * 20), model).replace(" ", "") == "idiotclown" * 20
    assert len(toxicity.restore(" ".join("s t u p i d" for _ in range(5_000)), model).split()) == 5_000
    assert toxicity.restore("1" + "d" * 500_000 + "10t", model)


def test_toxicity_decodes_like_all_readings():
    """Viterbi against every reading of small lattices."""
    model = toxicity.Model(toxicity.class_counts(TOXIC_SAMPLE))
    rng = random.Random(14)
    for _ in range(300):
        text = "".join(rng.choice("aidot1@!. -l") for _ in range(rng.randint(1, 6)))
        best = math.inf
        for reading in itertools.product(*(toxicity.options(c, len(list(run))) for c, run in itertools.groupby(text))):
            total, x, y = sum(price for _, price in reading), 0, 0
            for letter in "".join(w for w, _ in reading):
                if letter == " " and not y:
                    continue
                z = toxicity._CLASS.get(letter, 0)
                total, x, y = total + model.cost[x][y][z], y, z
            best = min(best, total + (model.cost[x][y][0] if y else 0.0))
        assert math.isclose(toxicity.decode(text, model)[0], best), text


def test_toxicity_fit_like_plain_descent():
    """The logistic model ends where its penalised likelihood has no slope."""
    rng = np.random.default_rng(15)
    rows = [sorted(rng.choice(12, rng.integers(0, 5), replace=False).tolist()) for _ in range(300)]
    labels = np.array([float((0 in r or 3 in r) != (rng.random() < 0.1)) for r in rows])
    w, b = toxicity.fit_logistic(rows, labels, 12, rounds=5000)
    x = np.zeros((300, 12))
    for i, r in enumerate(rows):
        x[i, r] = 1
    error = (1 / (1 + np.exp(-(x @ w + b))) - labels) * np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    assert np.abs(x.T @ error + w).max() < 1e-3 and abs(error.mean()) < 1e-4 and w[0] > 1 and w[3] > 1


def test_toxicity_learns(spark, odd, none):
    rng = random.Random(3)
    plain = "the garden path is long and pleasant with many trees beside a quiet river".split()
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [rng.choice(plain) for _ in range(30)]
        if bad:
            words[rng.randrange(30)] = rng.choice(["idiot", "1diot", "idi0t", "i d i o t", "idiiiot", "clown", "cl0wn"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.score(docs, marks).collect()
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.95
    # labels of held-out rows are of no account
    turned = marks.withColumn("toxic", F.when(common.crc_of_id() % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score(docs, turned).collect()} == {r.doc_id: r.score for r in got}
    assert toxicity.score(odd, marks).count() == len(ODD) and toxicity.score(none, marks).count() == 0
    assert {r.score for r in toxicity.score(odd, marks.where("false")).collect()} == {0.5}


def shingles_of(line, size=12):
    """The units of UTF-16 from every position, ``size`` at a time."""
    units = line.encode("utf-16-be")
    return {units[k : k + 2 * size] for k in range(0, max(1, len(units) - 2 * size + 2), 2)}


def plain_lines(documents, threshold=0.8):
    """The places that go, by comparing every pair of lines."""
    places = [(i, p, x.strip(" \t\n\r\x0b\x0c").lower()) for i in sorted(documents) for p, x in enumerate(documents[i].split("\n"))]
    places = [x for x in places if x[2]]
    names = list(dict.fromkeys(n for *_, n in places))
    sets = [shingles_of(n) for n in names]
    parent = list(range(len(names)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(names)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same >= threshold * (len(sets[i]) + len(sets[j]) - same):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    at, first, gone = {n: k for k, n in enumerate(names)}, {}, collections.defaultdict(list)
    for i, p, n in places:
        if first.setdefault(root(at[n]), (i, p)) != (i, p):
            gone[i].append(p)
    return gone


def removed_of(frame):
    return {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(frame).collect()}


def test_lines(spark, odd, none, docs):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    made = {}
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(base).split(" ")
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(rng.choice(["", " ", "  "]) + " ".join(line).capitalize())
        made[i] = "\n".join(lines + [""] * (i % 3))
    frame = spark.createDataFrame(list(made.items()), "doc_id bigint, text string").repartition(4)
    want = plain_lines(made)
    got = removed_of(frame)
    total = sum(map(len, want.values()))
    # banding is the one approximate step: hardly anything is missed, and what goes without need
    # went because the line it should have gone for was kept
    missed = sum(len(set(want[i]) - set(got[i])) for i in made)
    wrong = sum(len(set(got[i]) - set(want[i])) for i in made)
    assert len(got) == len(made) and missed <= 0.02 * total and wrong <= 0.01 * total and total > 50
    assert line_dedup.removed_lines(none).count() == 0


def test_lines_of_odd_documents(spark, odd):
    got = line_dedup.removed_lines(odd).collect()
    assert len(got) == len(ODD)
    # the empty-handed, the repeated document, and the line that another document holds first
    assert {(r.n_lines, r.n_removed) for r in got if r.doc_id in (1, 2, 3)} == {(0, 0)}
    assert [(r.n_lines, list(r.removed)) for r in got if r.doc_id == 7] == [(3, [1])] * 2
    clean = line_dedup.deduplicate(odd)
    assert clean.columns == odd.columns
    assert {r.text for r in clean.where("doc_id = 7").collect()} == {"Tie tie TIE.\n\nlast"}
    # ids may be text, and the greatest number is no null
    rows = [((1 << 63) - 1, "one line that stands twice"), (None, "one line that stands twice"), (3, "another line")]
    assert {r.doc_id: r.n_removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {(1 << 63) - 1: 0, None: 1, 3: 0}
    assert {r.doc_id: r.n_removed for r in line_dedup.removed_lines(spark.createDataFrame([("b", "same line"), ("a", "same line"), (None, "same line")], "doc_id string, text string")).collect()} == {"a": 0, "b": 1, None: 1}


def test_lines_very_long(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    huge = "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(1_000_000))
    rows = [(1, " ".join(words)), (2, " ".join([*words[:100], "new", *words[100:]])), (3, huge), (4, "x" + huge), (5, " ".join(reversed(words)))]
    assert {r.doc_id: r.n_removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_lines_of_a_large_band(spark, monkeypatch):
    """Pairs are found wherever they stand among lines on a common template."""
    monkeypatch.setattr(line_dedup, "BLOCK", 128)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    head, lines = [word() for _ in range(30)], []
    for _ in range(200):
        tail = [word() for _ in range(12)]
        lines += [" ".join(head + tail), " ".join(head + [*tail[:-1], word()])]
    rng.shuffle(lines)
    made = dict(enumerate(lines))
    want = plain_lines(made)
    frame = spark.createDataFrame(list(made.items()), "doc_id bigint, text string").repartition(4)
    distinct = line_dedup.distinct_lines(line_dedup.places(frame)).persist()
    assert distinct.select(F.explode("bands").alias("band")).groupBy("band").count().agg(F.max("count")).first()[0] > line_dedup.BLOCK
    got = removed_of(frame)
    assert {i for i in made if got[i]} == {i for i in made if want.get(i)} and sum(map(len, want.values())) == 200


def test_sketches_lose_no_link(spark):
    """200 hashes each, 180 in common, whose 64 least agree in 44: similar by 0.82."""
    rng = np.random.default_rng(11)
    pairs = [([*range(20), *range(100, 280)], [*range(50, 70), *range(100, 280)])]
    for _ in range(300):
        both = rng.choice(2000, int(rng.integers(20, 300)), replace=False).tolist()
        cut = lambda: both[int(rng.integers(0, len(both) // 4)) :]
        pairs.append((sorted(cut()), sorted({*cut(), *rng.integers(2000, 4000, int(rng.integers(0, 30))).tolist()})))
    rows = [(a[:64], b[:64], len(a), len(b), len({*a} & {*b}) / len({*a} | {*b}) >= 0.8) for a, b in pairs] + [([*range(64)], [*range(500, 564)], 200, 200, False)]
    df = spark.createDataFrame(rows, "sketch_a array<bigint>, sketch_b array<bigint>, n_a int, n_b int, similar boolean")
    found = df.withColumn("possible", line_dedup._possible(0.8)).collect()
    assert found[0].similar and all(r.possible for r in found if r.similar) and not found[-1].possible


def test_parities_lose_no_link(spark):
    """Similar lines stay open whatever their length; lines half alike do not."""
    rng = random.Random(13)
    rows = []
    for i in range(200):
        line = [rng.choice("abcdefghij klm") for _ in range(rng.choice((30, 200, 600, 3000)))]
        other = list(line)
        for _ in range(rng.randrange(1, 2 + len(line) // 60)):
            other[rng.randrange(len(other))] = "#"
        rows += [(2 * i, "".join(line)), (2 * i + 1, "".join(other))]
    half = "".join(rng.choice("abcdefghij") for _ in range(260))
    rows += [(400, half[:130] + "x" * 5 + half[130:200] * 2), (401, half[:130] + "y" * 5 + half[200:] * 2)]
    nodes = spark.createDataFrame(rows, "node bigint, text string").withColumn("units", F.encode("text", "UTF-16BE"))
    nodes = nodes.withColumn("n", F.size(F.array_distinct(line_dedup.shingles(F.col("units")))))
    made = nodes.join(line_dedup._parities(nodes), "node")
    side = lambda x: [F.floor(F.col("node") / 2).alias("pair"), *[F.col(c).alias(f"{c}_{x}") for c in made.columns]]
    both = made.where("node % 2 = 0").select(*side("a")).join(made.where("node % 2 = 1").select(*side("b")), "pair")
    got = {r.pair: r.near for r in both.select("pair", line_dedup._near(0.8).alias("near")).collect()}
    texts = dict(rows)
    sets = {i: (shingles_of(texts[2 * i]), shingles_of(texts[2 * i + 1])) for i in got}
    similar = {i for i, (x, y) in sets.items() if len(x & y) >= 0.8 * len(x | y)}
    assert len(got) == 201 and len(similar) > 50 and all(got[i] for i in similar) and not got[200]


def test_large_bands_without_shingle_sets(spark, monkeypatch):
    """What meets in a large band is lines, which are a fraction of their shingle sets."""
    names, plain = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: names.append((name, df.columns)) or plain(df, name))
    rng = random.Random(16)
    head = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    rows = [(i, head + " " + " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(8))) for i in range(80)]
    line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert "line-links" in [n for n, _ in names] and not any("ring" in columns for _, columns in names)


def test_lines_move_no_whole_text(spark, monkeypatch):
    """No shuffle takes the documents' texts along (of F1); what lines need of them is far less."""
    plans, plain = [], line_dedup.written
    explain = lambda df: spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    monkeypatch.setattr(line_dedup, "written", lambda df, name: plans.append(explain(df)) or plain(df, name))
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(5)) + "\nthe end of all documents") for i in range(40)]
    found = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    plans.append(explain(found))
    moved = [columns for plan in plans for columns in re.findall(r"\) Exchange\nInput[^:]*: \[(.*)\]", plan)]
    assert len(moved) > 8 and not [columns for columns in moved if "text#" in columns]
    assert {r.doc_id: r.n_removed for r in found.collect()} == {i: int(i > 0) for i in range(40)}


def test_marked_lines(spark, monkeypatch):
    """The bitmap lets all wanted lines pass and few others, and all of them at any size."""
    lines = spark.range(20_000).select("id", F.xxhash64("id").alias("h1"))
    wanted = lines.where("id % 200 = 7")
    got = {r.id for r in line_dedup._marked(lines, wanted, 100).collect()}
    assert {*range(7, 20_000, 200)} <= got and len(got) < 1000
    monkeypatch.setattr(line_dedup, "MOST", line_dedup.PAGE)
    assert line_dedup._marked(lines, lines, 20_000).count() == 20_000


def test_bins_lose_no_link(spark):
    """Similar lines stay open whatever they repeat; lines that share little do not."""
    rng = random.Random(17)
    rows = []
    for i in range(150):
        line = [rng.choice("abcdefghij klm") for _ in range(rng.choice((5, 30, 200, 600, 3000)))] * rng.choice((1, 1, 3))
        other = list(line)
        for _ in range(rng.randrange(2 + len(line) // 60)):
            other[rng.randrange(len(other))] = "#"
        rows += [(2 * i, "".join(line)), (2 * i + 1, "".join(other))]
    half = "".join(rng.choice("abcdefghij") for _ in range(2000))
    rows += [(300, half[:1400]), (301, half[600:])]
    bins = line_dedup._bins(spark.createDataFrame(rows, "node bigint, norm string"))
    side = lambda x: [F.floor(F.col("node") / 2).alias("pair"), *[F.col(c).alias(f"{c}_{x}") for c in bins.columns]]
    both = bins.where("node % 2 = 0").select(*side("a")).join(bins.where("node % 2 = 1").select(*side("b")), "pair")
    got = {r.pair: r.near for r in both.select("pair", line_dedup._near(0.8, line_dedup.BINS).alias("near")).collect()}
    texts = dict(rows)
    sets = {i: (shingles_of(texts[2 * i]), shingles_of(texts[2 * i + 1])) for i in got}
    similar = {i for i, (x, y) in sets.items() if len(x & y) >= 0.8 * len(x | y)}
    assert len(got) == 151 and len(similar) > 50 and all(got[i] for i in similar) and not got[150]


def test_alike_by_plain_sets(spark):
    """Inserts, repeats, lines that begin or end with another."""
    rng = random.Random(23)
    texts = []
    for i in range(300):
        line = "".join(rng.choice("abcdefgh klm") for _ in range(rng.choice((1, 11, 12, 13, 25, 60, 200, 700)))) * rng.choice((1, 1, 1, 2, 4))
        at = rng.randrange(len(line))
        other = rng.choice((line[:at] + "#" + line[at:], line[:at], line[at:] + "!", line + line[at:], line[:at] + "#~" + line[at + 9 :], line[: at // 2] + "#" + line[at // 2 : at] + "~" + line[at:]))
        texts.append((i, line, other))
    sets = [(shingles_of(x), shingles_of(y)) for _, x, y in texts]
    want = {i for i, (x, y) in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)}
    pairs = spark.createDataFrame([(i, i, max(len(x) - 11, 1), max(len(y) - 11, 1), x, y) for i, x, y in texts], "a int, b int, n_a int, n_b int, norm_a string, norm_b string")
    assert {r.a for r in line_dedup._alike(pairs, 0.8).collect()} == want
    assert 50 < len(want) < 250


def test_lines_by_fewer_rows(spark, monkeypatch):
    """bins make a row of a stretch and not of each position; the texts are read three times."""
    plans, plain = [], line_dedup.written
    explain = lambda df: spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    rows = [(0, "the same line of two documents\nand another one"), (1, "the same line of two documents\nand one more")]
    texts = spark.createDataFrame(rows, "node bigint, norm string")
    assert len(re.findall(r"\) Generate\n", explain(line_dedup._bins(texts)))) == 1
    monkeypatch.setattr(line_dedup, "written", lambda df, name: plans.append(explain(df)) or plain(df, name))
    found = line_dedup.removed_lines(texts.toDF("doc_id", "text"))
    plans.append(explain(found))
    assert sum(len(re.findall(r"\) Scan ExistingRDD\n", plan)) for plan in plans) == 3
    assert {r.doc_id: list(r.removed) for r in found.collect()} == {0: [], 1: [0]}


def test_lines_of_repeats(spark):
    """Sets count, not how often a shingle stands; blanks at the ends do not."""
    rows = [(1, "ab" * 200), (2, " \t" + "ab" * 150 + "\r"), (3, "ab" * 3), (4, "\x0b\x0c \r\n  "), (5, "AB" * 3 + "\x0c")]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 0), 4: (0, 0), 5: (1, 1)}


def test_lines_by_every_position(spark):
    """All positions count: unspaced lines with an early insertion, and spaced lines, by plain sets."""
    rng = random.Random(7)
    lines = []
    for n in (100, 300, 1000):
        for _ in range(20):
            x = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
            lines += [x, x[:2] + "\u9999" + x[2:], x[: n // 2] + x[: n // 2]]
    for _ in range(60):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(12, 40))]
        lines += [" ".join(words), " ".join(words[:-1]), " ".join([*words[:3], "zz", *words[3:]])]
    lines += ["short", "short", "tiny", "Short "]
    made = dict(enumerate(lines))
    want = {i for i, gone in plain_lines(made).items() if gone}
    got = {i for i, gone in removed_of(spark.createDataFrame(list(made.items()), "doc_id bigint, text string").repartition(4)).items() if gone}
    assert got <= want and len(want - got) <= 0.02 * len(want) and len(want) > 100
    assert set(range(1, 180, 3)) <= got


def test_line_bands_recall(spark):
    """Pairs at a similarity of 0.8 to 0.9 share a band."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    rows, pairs = [], 0
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(30)]
        other = list(words)
        other[rng.randrange(30)] = "changed"
        a, b = " ".join(words), " ".join(other)
        if len(shingles_of(a) & shingles_of(b)) >= 0.8 * len(shingles_of(a) | shingles_of(b)):
            rows += [(2 * i, a), (2 * i + 1, b)]
            pairs += 1
    found = line_dedup.places(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = found.select(F.floor(F.col("k1") / 2).alias("pair"), F.explode(F.array(*[f"b{b}" for b in range(line_dedup.BANDS)])).alias("band"))
    hit = found.groupBy("pair", "band").count().where("count > 1").select("pair").distinct().count()
    assert pairs > 100 and hit / pairs >= 0.98


def fold_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def plain_lm(rows):
    """(held out, tokens, known, base score, score) of each row, from counts in dictionaries."""
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    one, two, judges = collections.Counter(), collections.Counter(), []
    for i, t in rows:
        if crc(i) % 5 != 1:
            words = fold_words(t)
            one.update(words)
            two.update(zip(["\t", *words], words))
            if crc(i) // 5 % lm.HELD_OUT == 0:
                judges.append(words)
    n, v, starts = sum(one.values()), len(one), one["\n"]

    def estimates(before, word, less):
        context = max((starts if before == "\t" else one[before]) - less, 0)
        bucket = min(int(math.log2(context)) + 1, lm.BUCKETS - 1) if context else 0
        return bucket, max(two[before, word] - less, 0) / max(context, 1), max(one[word] - less, 0) / max(n - less, 1)

    cell = lambda p: min(round(-4 * math.log2(p)), 254) if p > 0 else 255
    cells = collections.Counter()
    for words in judges:
        for pair in zip(["\t", *words], words):
            bucket, p2, p1 = estimates(*pair, 1)
            cells[(bucket * 256 + cell(p2)) * 256 + cell(p1)] += 1
    weights = lm.learn(dict(cells), v)
    out = []
    for i, t in rows:
        words = fold_words(t)
        score = 0.0
        for pair in zip(["\t", *words], words):
            bucket, p2, p1 = estimates(*pair, 0)
            a, b, g = weights[bucket]
            score += math.log10(a * p2 + b * p1 + g / (v + 1))
        out.append((crc(i) % 5 == 1, len(words), sum(one[w] > 0 for w in words), round(sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 5), round(score, 5)))
    return n, out


def test_lm(spark, docs, texts, odd, none):
    for frame, rows in ((docs, list(texts.items())), (odd, ODD)):
        n, want = plain_lm(rows)
        got = lm.score(frame, group_bytes=50_000).collect()
        assert sorted((r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == sorted(x[:4] for x in want)
        assert np.allclose(sorted(r.score for r in got), sorted(x[4] for x in want), rtol=1e-6, atol=1e-3)
        assert {r.train_tokens for r in got} == {n}
    held = [r for r in lm.score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(none).count() == 0


def test_lm_learns_like_plain_em():
    """One bucket's weights against expectation-maximisation written out."""
    rng = random.Random(16)
    cells = {(5 * 256 + rng.randrange(40)) * 256 + rng.randrange(20, 90): rng.randint(1, 50) for _ in range(60)}
    w = [1 / 3] * 3
    for _ in range(100):
        total = [1.0] * 3
        for c, n in cells.items():
            p = [w[0] * 2 ** (-(c // 256 % 256) / 4), w[1] * 2 ** (-(c % 256) / 4), w[2] / 1001]
            total = [t + n * x / sum(p) for t, x in zip(total, p)]
        w = [t / sum(total) for t in total]
    assert np.allclose(lm.learn(cells, 1000)[5], w, atol=1e-9)


def test_lm_counts_of_eight_bytes():
    for x in ([], [0, 7, (1 << 32) - 1], [1, 1 << 32, 1 << 40]):
        assert lm._blob_numbers(lm._numbers_blob(np.array(x, np.int64))).tolist() == x


def test_lm_weights_sum_to_one():
    cells = {(3 * 256 + 8) * 256 + 40: 50, (3 * 256 + 255) * 256 + 60: 10, (0 * 256 + 255) * 256 + 30: 5}
    w = lm.learn(cells, 1000)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and w[3, 0] > w[3, 2]


def test_sorted_numbers():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (packing.decode_sorted(packing.encode_sorted(keys)) == keys).all()
    assert len(packing.decode_sorted(packing.encode_sorted(keys[:0]))) == 0


def luhn(n):
    d = [int(c) for c in n][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


KEY = "a key for tests"


def test_pii_keeps_columns(spark):
    rows = [("a", "2024-02-29", [1], 5)]
    got = pii.pseudonymise(spark.createDataFrame(rows, "p_found string, text string, p_kinds array<int>, p__new int"), key=KEY).first()
    assert (got.p_found, got.p_kinds, got.p__new, got.n_date) == ("a", [1], 5, 1) and got.text != "2024-02-29"
    with pytest.raises((TypeError, ValueError)):
        pii.pseudonymise(spark.createDataFrame(rows, "a string, text string, b array<int>, c int"), key="")


def plain_feistel(left, right, a, b, key, kind):
    def f(side, i, half, mod):
        given = f"{key}\x1f{kind}\x1f{side}{i}:{a}:{b}:{half}"
        return int(hashlib.sha256(given.encode()).hexdigest()[:14], 16) % mod

    for i in range(1, pii.ROUNDS + 1):
        left = (left + f("l", i, right, a)) % a
        right = (right + f("r", i, left, b)) % b
    return left, right


def test_pii_like_plain_networks(spark):
    """Numbers, addresses and dates against a network written out in Python."""
    import datetime

    rng = random.Random(13)
    rows, want = [], []
    for i in range(60):
        digits = "".join(rng.choice("123456789") for _ in range(rng.choice((12, 14, 15, 18))))
        half = len(digits) // 2
        check = next(c for c in "0123456789" if luhn(digits + c))
        l, r = plain_feistel(int(digits[:half]), int(digits[half:]), 10**half, 10 ** (len(digits) - half), KEY, "card")
        new = f"{l:0{half}d}{r:0{len(digits) - half}d}"
        rows.append(digits + check)
        want.append(new + next(c for c in "0123456789" if luhn(new + c)))
        octets = [rng.randrange(256) for _ in range(4)]
        l, r = plain_feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, KEY, "ip")
        rows.append(".".join(map(str, octets)))
        want.append(f"{l // 256}.{l % 256}.{r // 256}.{r % 256}")
        day = rng.randrange(pii.CYCLE)
        l, r = plain_feistel(day // pii.RIGHT_DAYS, day % pii.RIGHT_DAYS, pii.LEFT_DAYS, pii.RIGHT_DAYS, KEY, "date")
        start = datetime.date(1800, 1, 1)
        rows.append((start + datetime.timedelta(day)).strftime("%d/%m/%Y"))
        want.append((start + datetime.timedelta(l * pii.RIGHT_DAYS + r)).strftime("%d/%m/%Y"))
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), key=KEY).orderBy("doc_id").collect()
    assert [r.text for r in got] == want


def test_pii(spark, odd, none):
    base = ["4111111111111111", "5500005555555559", "378282246310005", "6011000990139424"]
    text = "pay 4111 1111 1111 1111 or 4111111111111111; on 2024-02-29, 29/02/2024 and 29.02.2024 from 10.0.0.255 call +1 (826) 555-7388 or 826-555-7388, ssn 123-45-6789; bob@example.com; not 4111111111111112 nor 2023-02-29 nor 1.2.3.4.5"
    rows = [(1, text), (2, "again 2024-02-29 4111111111111111 10.0.0.255")] + [(10 + i, n) for i, n in enumerate(base)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(d, key=KEY).collect()}
    one = got[1].text
    for clear in ("4111 1111", "4111111111111111", "2024-02-29", "29/02/2024", "29.02.2024", "10.0.0.255", "555-7388", "123-45-6789", "bob@"):
        assert clear not in one
    assert "4111111111111112" in one and "2023-02-29" in one and "1.2.3.4.5" in one
    assert (got[1].n_card, got[1].n_date, got[1].n_ip, got[1].n_phone, got[1].n_ssn, got[1].n_email) == (2, 3, 1, 2, 1, 1)
    card = re.search(r"or (\d{16});", one)[1]
    date = re.search(r"on (\d{4})-(\d\d)-(\d\d), (\d\d)/(\d\d)/(\d{4}) and (\d\d)\.(\d\d)\.(\d{4})", one)
    assert luhn(card) and re.search(r"pay (\d{4} \d{4} \d{4} \d{4})", one)[1].replace(" ", "") == card
    assert date.groups()[:3] == (date[6], date[5], date[4]) == (date[9], date[8], date[7])
    assert got[2].text.split()[1:] == ["-".join(date.groups()[:3]), card, re.search(r"from (\S+) call", one)[1]]
    assert all(luhn(got[10 + i].text) and len(got[10 + i].text) == len(n) and got[10 + i].text != n for i, n in enumerate(base))
    assert pii.pseudonymise(d, key="other").where("doc_id = 1").first().text != one
    assert pii.pseudonymise(odd, key=KEY).where("text is null").count() == 2 and pii.pseudonymise(none, key=KEY).count() == 0


def test_pii_permutes(spark):
    """No two dates, and no two numbers, share a pseudonym."""
    days = spark.range(0, 146097, 37).select(F.col("id").alias("doc_id"), F.date_format(F.expr("date_add(date'1800-01-01', cast(id as int))"), "yyyy-MM-dd").alias("text"))
    out = pii.pseudonymise(days, key=KEY)
    n = days.count()
    assert out.where("n_date = 1").select("text").distinct().count() == n
    assert out.where("to_date(text) between '1800-01-01' and '2199-12-31'").count() == n
    ssn = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws("-", F.lpad((F.col("id") % 665 + 1).cast("string"), 3, "0"), F.lpad((F.col("id") % 99 + 1).cast("string"), 2, "0"), F.lpad((F.col("id") + 1).cast("string"), 4, "0")).alias("text"))
    assert pii.pseudonymise(ssn, key=KEY).select("text").distinct().count() == 3000


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return {(i, f): least.get(root(f)) for i, f in rows}


def test_simhash(spark, docs, texts, odd, none):
    for frame, rows in ((docs, list(texts.items())), (odd, ODD)):
        prints = [(i, plain_fingerprint(t)) for i, t in rows]
        want = plain_components(prints)
        got = simhash.near_duplicates(frame).collect()
        assert len(got) == len(rows)
        assert all(want[r.doc_id, int(r.fingerprint, 16)] == r.component_id for r in got)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 7").count() == 1
    prints = [(i, plain_fingerprint(t)) for i, t in ODD]
    assert kept.count() == len({c for c in plain_components([(k, f) for k, (_, f) in enumerate(prints)]).values()})
    named = simhash.near_duplicates(spark.createDataFrame([("b", "some words of a text"), ("a", "some words of a text"), (None, "Some words of a text")], "doc_id string, text string")).collect()
    assert {r.component_id for r in named} == {"a"}


def test_simhash_covers():
    masks = simhash.masks()
    assert len(masks) == 31
    rng = random.Random(6)
    for _ in range(2000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not differ & m for m in masks)


@pytest.mark.parametrize("bound", [10, 100_000])
def test_simhash_links_of_clusters(spark, bound):
    """Large groups of near copies, split and unsplit, give the components of all pairs."""
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(150)}
    rows = list(enumerate(prints))
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in rows], "fp bigint, rep bigint")
    found = {r.node: r.component for r in components.components(simhash.links(frame, max_bucket=bound, max_rows=50)).collect()}
    want = plain_components(rows)
    assert all(found.get(i, i) == want[i, f] for i, f in rows)


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = list(range(2000))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


@pytest.mark.parametrize("step", [1, 997])
def test_components_in_few_tables(spark, monkeypatch, step):
    """A star ends after two rounds, a path, numbered in order or not, after few."""
    names, plain = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or plain(df, name))
    star = [(5000, i) for i in range(2000, 2200)]
    path = [(i * step % 1009, (i + 1) * step % 1009) for i in range(60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(star + path, "a bigint, b bigint")).collect()}
    assert got == {x: 2000 for p in star for x in p} | {x: 0 for p in path for x in p}
    assert len(names) <= 40
    names.clear()
    assert components.components(spark.createDataFrame(star, "a bigint, b bigint")).count() == 201 and names.count("moved") <= 2


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, texts, odd, none, sf):
    for frame, rows in ((docs, list(texts.items())), (odd, ODD)):
        got = quality.verdicts(frame).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), tuple(r[1:6]), r.base_failed) for r in got) == sorted(((i is None, i or 0), c, c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in rows for c in [plain_counts(t)])
    assert quality.verdicts(none).count() == 0
    assert quality.filter_documents(odd).columns == odd.columns


def plain_fit(rows, rounds=300, weight=20.0):
    """Expectation-maximisation row by row, and the posterior of a row's votes."""
    share, kinds = quality.SHARE, (-1, 0, 1)
    chances = [(quality.GOOD, quality.BAD)] * len(quality.RULES)

    def posterior(votes):
        good, bad = share, 1 - share
        for vote, (g, b) in zip(votes, chances):
            good, bad = good * g[vote + 1], bad * b[vote + 1]
        return good / (good + bad)

    for _ in range(rounds):
        of = [posterior(v) for v in rows]
        new = []
        for j in range(len(chances)):
            pair = []
            for part, start in ((of, quality.GOOD), ([1 - g for g in of], quality.BAD)):
                n = [weight * start[k + 1] + sum(p for p, v in zip(part, rows) if v[j] == k) for k in kinds]
                pair.append(tuple(x / sum(n) for x in n))
            new.append(tuple(pair))
        share, chances = (sum(of) + quality.SHARE * weight) / (len(rows) + weight), new
    return posterior


def test_quality_posterior_like_plain_em(spark, docs, sf):
    counted = quality.measured(docs.select("doc_id", "text")).persist()
    votes = {r.doc_id: tuple(r.v) for r in counted.select("doc_id", quality.votes().alias("v")).collect()}
    posterior = plain_fit(list(votes.values()))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = n = 0
    for r in quality.verdicts(docs).collect():
        assert abs(r.posterior - posterior(votes[r.doc_id])) < 1e-3
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
        if r.doc_id in labels and not r.base_failed:
            n, right = n + 1, right + (r.kept == (labels[r.doc_id] == 1))
    assert n > 20 and right >= 0.97 * n


def test_quality_weighs_votes():
    """A lone bad vote of a rule that is often alone keeps a text; two rules that agree reject it."""
    rng, size = random.Random(9), len(quality.RULES)
    counts = collections.Counter()
    for _ in range(3000):
        v = [1] * size
        if rng.random() < 0.15:
            v[rng.choice((0, 2))] = v[1] = -1
        elif rng.random() < 0.05:
            v[4] = -1
        counts[tuple(v)] += 1
    start, each = quality.weights(*quality.fit(list(counts.items())))
    odds = lambda *bad: start + sum(w[0 if j in bad else 2] for j, w in enumerate(each))
    assert odds() > 0 and odds(4) > 0 and odds(0, 1) < 0 and odds(1, 2) < 0


def test_quality_of_odd_texts(spark, odd):
    rows = [(1, "word " * 20_000), (2, "x" * 2_000_000), (3, " ".join(f"plain{i}" for i in range(20_000)))]
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].kept) == (20_000, 20_000, False)
    assert (got[2].n_words, got[2].word_chars, got[2].base_failed) == (1, 2_000_000, True)
    assert (got[3].n_words, got[3].n_repeat_words, got[3].base_failed) == (20_000, 0, False)
    empty = [r for r in quality.verdicts(odd).collect() if r.n_words == 0]
    assert len(empty) == 4 and all(r.base_failed and not r.kept for r in empty)


def test_quality_without_rows():
    share, chances = quality.fit([])
    assert 0 < share < 1 and len(chances) == len(quality.RULES)


def test_sharding(spark, docs, texts, odd, none):
    for frame, rows in ((docs, list(texts.items())), (odd, ODD)):
        got = sharding.assign(frame).collect()
        sizes = collections.Counter(r.shard for r in got)
        assert len(got) == len(rows) and max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
        assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
        assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sharding.assign(none).count() == 0


def test_sharding_moves_little(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    before, after = ({r.doc_id: r.shard for r in sharding.assign(docs, shards=n).collect()} for n in (8, 9))
    assert sum(before[i] != after[i] for i in before) < 0.2 * len(before)


def test_sharding_equal_rows(spark):
    same = spark.range(1000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("x").alias("text"))
    assert sorted(r["n"] for r in sharding.assign(same).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()) == [125] * 8


TABLES = "documents benchmark labels".split()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(got.columns)
    assert sorted(map(tuple, got[key].astype(str).values)) == sorted(map(tuple, want[key].astype(str).values))
