"""Ranked search, packing and resampling against brute force, exact round trips and edge tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfstream.llm import packing, ranked_search, resampling
from shelfstream.llm.queries import ORACLES, QUERIES

LONG = "word " * 40_000
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one"), (5, "one"), (None, "no id at all")]
CLASH = ("row", "part", "number", "n", "found", "rank", "score", "query", "features", "pieces", "ids", "some")


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit("x").alias(n) for n in CLASH]) if extra else df


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("rank", F.lit("x"))


# -- ranked search ------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_search(docs, items, k):
    bags = [(i, Counter(brute_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n // length
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m))
                for t in set(brute_terms(text)) if b[t]
            )
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def random_texts(rng, n, words=60, longest=40):
    vocabulary = [f"W{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [
        "".join(w + rng.choice([" ", ", ", "-", "É"]) for w in rng.choices(vocabulary, weights, k=rng.randint(0, longest)))
        for _ in range(n)
    ]


@pytest.mark.parametrize("k, size, first", [(5, 1 << 20, 1000), (50, 120, 2), (1, 1 << 20, 1)])
def test_search_equals_brute_force(spark, monkeypatch, k, size, first):
    monkeypatch.setattr(ranked_search, "FIRST_MERGE", first)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rng = random.Random(k)
    docs = [(i, t) for i, t in enumerate(random_texts(rng, 400))] + EDGE
    docs += [(1000 + i, "w0 w1 tie") for i in range(40)]  # ties beyond k
    items = [*enumerate(random_texts(rng, 12)), (90, None), (91, "..."), (92, "tie w0"), (None, "w3"), (93, "unseen")]
    try:
        got = ranked_search.search(docs_of(spark, docs).repartition(5), items_of(spark, items), k, size).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items, k)


def test_limit_on_accumulators_keeps_the_best():
    rng = np.random.default_rng(5)
    for trial in range(200):
        docs, k = 60, int(rng.integers(1, 8))
        lists = []
        for _ in range(rng.integers(0, 9)):
            where = np.flatnonzero(rng.random(docs) < rng.random())
            lists.append((where, rng.integers(0, 50, len(where))))
        whole = np.zeros(docs, np.int64)
        for where, parts in lists:
            whole[where] += parts
        best = sorted((-s, i) for i, s in enumerate(whole) if s > 0)[:k]
        least = -best[-1][0] if len(best) == k and trial % 2 else 0
        top = ranked_search.Best(k)
        found, scores = ranked_search.best_of(lists, docs, k, least)
        assert all(whole[i] == s for i, s in zip(found, scores, strict=True))
        top.add(found, scores)
        assert [(-s, i) for i, s in zip(top.ids, top.scores, strict=True)] == best


def test_rare_terms_alone_open_accumulators():
    rare = (np.arange(5), np.full(5, 1_000))
    common = (np.arange(1_000), np.full(1_000, 3))
    found, _ = ranked_search.best_of([rare, common], 1_000, 5, 0)
    assert found.tolist() == [0, 1, 2, 3, 4]


def test_search_of_empty_tables(spark):
    items = items_of(spark, [(1, "one")])
    assert ranked_search.search(docs_of(spark, []), items).count() == 0
    assert ranked_search.search(docs_of(spark, EDGE), items_of(spark, [])).count() == 0
    none = ranked_search.search(docs_of(spark, EDGE), items_of(spark, [(1, None)]))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


# -- packing ------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def awkward_texts(rng, n):
    bits = ["a", "it's", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "é", "日本", "123", "!?", "'ll", "<|endoftext|>",
            "word", "\x1c", "\x85", "​", "😀", "Ⅷ", "½", "_", "\x00"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(n)]


def test_ids_equal_the_library():
    encoder, whole = packing.Encoder(packing.tokenizer_path()), library()
    for text in [*awkward_texts(random.Random(3), 4_000), LONG, ""]:
        assert encoder.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_plain_texts_are_split_as_by_the_pattern():
    rng = random.Random(5)
    bits = [*"asrvetlmd", "re", "ll", "'", "'", " ", " ", "\n", "1", "!", '"', "é", "ж", "\u024f"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(20_000)] + ["", "'", "x'", "'r", "'re", " '"]
    assert all(packing.PLAIN.fullmatch(t) for t in texts)
    joined = "".join(t + "\0" for t in texts).encode()
    starts = packing.piece_starts(joined).tolist()
    found = [joined[a:b].decode() for a, b in itertools.pairwise([*starts, len(joined)])]
    assert found == [p for t in texts for p in [*packing.PIECE.findall(t), "\0"]]


def test_a_batch_looks_up_its_distinct_pieces_once():
    encoder, asked = packing.Encoder(packing.tokenizer_path()), []

    class Counted(type(encoder.known)):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    encoder.known.__class__ = Counted
    text = "the same words again, the same " * 500
    assert encoder.ids(text).tolist() == library().encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(packing.PIECE.findall(text)))
    texts = [text, "日本 the same", "", "a\tb", "the\0same", "again 'll"]
    assert [i.tolist() for i in encoder.all_ids(texts)] == [
        library().encode(t, add_special_tokens=False).ids for t in texts
    ]


def test_pieces_that_were_forgotten_are_encoded_anew():
    encoder, whole = packing.Encoder(packing.tokenizer_path()), library()
    encoder.known.limit = 3
    text = " ".join(random.Random(2).choices("abcdefghijkl", k=200))
    assert encoder.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) <= 3 and len(encoder.known.older) <= 3
    for n in range(200):  # other characters, in texts of two parts
        text = f"日{n} 本{n}"
        assert encoder.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 5 and len(encoder.known.older) <= 5


def check_packing(sequences, docs, capacity, end=packing.END):
    """Every id in exactly one piece, sequences gapless, pieces equal to the ids they name."""
    whole, rows = library(), sequences.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    pieces = defaultdict(list)
    for r in rows:
        ids, at = np.frombuffer(r.ids, "<u4"), 0
        assert 0 < len(ids) == r.n_tokens <= capacity
        assert r.padded == (len(ids) if len(ids) & (len(ids) - 1) == 0 else capacity)
        for p in r.pieces:
            assert p.offset == at and p.length > 0
            pieces[p.doc_id, p.doc_tokens].append((p.start, tuple(ids[at : at + p.length])))
            at += p.length
        assert at == len(ids)
    found = Counter()
    for (doc_id, total), own in pieces.items():
        # Rows that share an id have equal texts here, so their pieces cover each position equally often.
        covered = Counter(start + k for start, ids in own for k in range(len(ids)))
        assert set(covered) == set(range(total)) and len(set(covered.values())) == 1
        found[doc_id] += next(iter(covered.values()))
        want = {i: t for i, t in docs}[doc_id]
        want = [*whole.encode(want or "", add_special_tokens=False).ids, end]
        assert total == len(want)
        assert all(tuple(want[start : start + len(ids)]) == ids for start, ids in own)
    assert found == Counter(i for i, _ in docs)
    return sum(r.padded - r.n_tokens for r in rows)


@pytest.mark.parametrize("capacity, held, parts", [(2048, 4096, 3), (64, 16, 1), (100, 4096, 2), (7, 2, 2)])
def test_packing_is_whole_and_without_gaps(spark, capacity, held, parts):
    rng = random.Random(capacity)
    docs = [(10 + i, " ".join(rng.choices(["alpha", "beta", "x1", "ü"], k=rng.randint(0, 90)))) for i in range(120)]
    docs += [(1_000 + i, "the same text again") for i in range(300)] + EDGE
    packed = packing.pack(docs_of(spark, docs).repartition(parts), capacity=capacity, held=held)
    assert check_packing(packed, docs, capacity) == 0  # cuts leave no padding at all
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_pieces_carry_their_checksum(spark):
    docs = [(i, "some words " * (i * 40)) for i in range(30)]
    whole = library()
    for r in packing.list_pieces(packing.pack(docs_of(spark, docs))).collect():
        ids = [*whole.encode(docs[r.doc_id][1], add_special_tokens=False).ids, 1]
        own = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(own) and r.doc_tokens == len(ids)


def test_fullest_is_the_best_multiset():
    rng = random.Random(8)
    for _ in range(400):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 40)
        chosen = packing.fullest(counts, room)
        assert all(0 < n <= counts[length] for length, n in chosen)
        assert len({length for length, _ in chosen}) == len(chosen)
        ranges = [range(c + 1) for c in counts.values()]
        sums = (sum(n * length for n, length in zip(pick, counts, strict=True)) for pick in itertools.product(*ranges))
        assert sum(n * length for length, n in chosen) == max(s for s in sums if s <= room)


def test_documents_are_cut_only_where_lengths_ask_for_it():
    # 300 + 700 + 1048 fill a window; so does each other triple: nothing is cut.
    packer = packing.Packer(2048, 4096)
    out = []
    for i in range(90):
        out += packer.add(i, np.zeros((300, 700, 1048)[i % 3], np.uint32))
    out += packer.rest()
    assert len(out) == 30 and all(sum(len(p[2]) for p in w) == 2048 for w in out)
    assert all(len(p[2]) == p[3] for w in out for p in w)


# -- resampling ---------------------------------------------------------------

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, longest):
    found = ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(found[k : k + n]) for n in range(1, longest + 1) for k in range(len(found) - n + 1)]
    return len(found), runs


def brute_resampling(docs, target, percent, longest, buckets, least, seed):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s = Counter(bucket(f) for _, t in docs for f in brute_features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in brute_features(x, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        words, runs = brute_features(text, longest)
        gain = [
            math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
            for b in map(bucket, runs)
        ]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): n for n, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("longest, percent, buckets, least", [(1, 10, 10_000, 20), (3, 35, 97, 3), (2, 100, 70_000, 0), (1, 0, 16, 1)])
def test_resampling_equals_brute_force(spark, longest, percent, buckets, least):
    rng = random.Random(longest)
    docs = [*enumerate(random_texts(rng, 300), 100), *EDGE, *[(900 + i, "equal words in all of these") for i in range(30)]]
    target = [*random_texts(rng, 20, words=20), None, ""]
    aims = items_of(spark, list(enumerate(target)))
    frame = docs_of(spark, docs).repartition(4)
    got = resampling.score(frame, aims, percent, longest, buckets, least)
    want = brute_resampling(docs, target, percent, longest, buckets, least, resampling.SEED)
    assert sorted(map(tuple, got.collect()), key=str) == want
    drawn = resampling.draw(frame, aims, percent, longest, buckets, least)
    assert drawn.columns == frame.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(r[0] for r in want if r[4])


def test_windows_of_words_follow_offsets():
    feature = resampling.Featurizer(2, 1 << 16)
    for text in ("One two  Three,four", "Éa b\nc", "a b"):
        n, found = feature(text)
        words, runs = brute_features(text, 2)
        assert n == words and found.tolist() == [zlib.crc32(r.encode()) % (1 << 16) for r in runs]


def test_resampling_of_empty_tables(spark):
    assert resampling.score(docs_of(spark, []), items_of(spark, [(1, "one")])).count() == 0
    assert resampling.draw(docs_of(spark, []), items_of(spark, [(1, "one")])).count() == 0
    rows = resampling.score(docs_of(spark, EDGE), items_of(spark, []), least_words=0, percent=100).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(EDGE) + 1))


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_resampling"])
def test_search_queries_equal_their_sql(spark, folder, name):
    got = QUERIES[name](spark, folder)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want)
