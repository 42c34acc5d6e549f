"""Corpus operators that group, fit or filter: brute force and edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfstream.llm import decontaminate, exact_dedup, mixing, ngram_join, sharding, toxicity
from shelfstream.llm.common import components, crc_of_id
from shelfstream.llm.queries import ORACLES, QUERIES, jaccard_sql

LONG = "long text " * 20_000
EDGE = [(1, None), (2, ""), (3, " \n "), (4, LONG), (5, "one two"), (6, "One TWO"), (6, "One TWO"), (None, "one two")]


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "key", "digest", "node", "component", "n", "m", "a", "b"):
        df = df.withColumn(name, F.lit("x"))
    return df


# -- exact copies -------------------------------------------------------------


@pytest.mark.parametrize("counters", [1, 8, 4095])
def test_exact_copies(spark, counters):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"t{rng.randint(0, 60)}") for i in range(900)]
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "t1"), (None, "lonely")]
    got = exact_dedup.judge_copies(docs_of(spark, rows).repartition(5), counters).collect()
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    expected = Counter()
    for i, t in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        expected[(i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == expected
    assert exact_dedup.judge_copies(docs_of(spark, [])).count() == 0


def test_misra_gries_keeps_every_heavy_digest():
    rng = random.Random(6)
    stream = ["h1"] * 400 + ["h2"] * 300 + [f"x{i}" for i in range(800)]
    rng.shuffle(stream)
    summary = pd.Series(dtype="int64")
    for at in range(0, len(stream), 100):
        summary = exact_dedup.misra_gries(summary, pd.Series(Counter(stream[at : at + 100])), 9)
    assert len(summary) <= 9 and {"h1", "h2"} <= set(summary.index)
    assert 400 - len(stream) / 10 <= summary["h1"] <= 400


# -- near copies --------------------------------------------------------------


def brute_components(rows, percent=90, size=3):
    sets = {}
    for i, text in rows:
        if i is None:
            continue
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_rows(rng, n):
    pool = [f"w{k}" for k in range(400)]
    rows = []
    bases = [[rng.choice(pool) for _ in range(rng.choice([2, 3, 20, 45, 120]))] for _ in range(n // 6)]
    line = [rng.choice(pool) for _ in range(30)]
    for i in range(n):
        words = list(rng.choice(bases[: 3 if i % 3 == 0 else None]))
        if rng.random() < 0.2:
            words += line
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = rng.choice(pool)
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else "  ".join(words)))
    return rows


@pytest.mark.parametrize("block, short", [(1024, 32), (8, 2), (1024, 2)])
def test_components_equal_brute_force(spark, monkeypatch, block, short):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    rows = near_rows(random.Random(7), 420) + [(1001, None), (1002, " "), (1003, "w1"), (1004, "W1"), (None, "w1")]
    got = ngram_join.link_components(docs_of(spark, rows).repartition(4), block=block).collect()
    assert len(got) == len(rows)
    expected = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == expected
    assert len({c for _, c in expected.values()}) < len(expected) - 50
    assert next(r for r in got if r.doc_id is None).component_id is None


def test_one_of_each_component_stays(spark):
    rows = near_rows(random.Random(8), 200) + EDGE[:3] + [(900, "x y z q"), (900, "x y z q"), (None, "x y z q")]
    rows = [(None if i is None else i + 1000 * (k >= 200), t) for k, (i, t) in enumerate(rows)]
    df = docs_of(spark, rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    expected = sorted(i for i, (_, c) in brute_components(rows).items() if i == c)
    got = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in got if i is not None) == expected and got.count(None) == 1
    assert ngram_join.link_components(docs_of(spark, [])).count() == 0
    assert ngram_join.link_components(docs_of(spark, EDGE)).count() == len(EDGE)


def brute_links(texts, percent, size):
    """{id: ids it links with} of the given {id: text}, by comparing all pairs."""
    sets = {}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        k = min(size, len(w))
        sets[i] = frozenset(tuple(w[n : n + k]) for n in range(len(w) - k + 1)) if w else frozenset()
    out = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b]) if a < b else 0
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                out[a].add(b)
                out[b].add(a)
    return out


def heads_of(links):
    """The ids that are the least of their component."""
    left, out = set(links), []
    while left:
        group, new = set(), {min(left)}
        while new:
            group |= new
            new = set().union(*(links[i] for i in new)) - group
        out.append(min(group))
        left -= group
    return sorted(out)


@pytest.mark.parametrize("block, percent, size", [(1024, 90, 3), (8, 90, 3), (16, 80, 5)])
def test_no_link_is_lost(spark, monkeypatch, block, percent, size):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 4)
    rng = random.Random(13)
    # A group of near copies that all link, exact copies among them.
    base = [f"v{k}" for k in range(150)]
    group = []
    for i in range(60):
        text = list(base)
        if i % 4:
            text[rng.randrange(150)] = f"x{i % 17}"
        group.append((2_000 + i, " ".join(text)))
    rows = [*near_rows(rng, 240), *group, (900, None), (901, " "), (902, "w1 w2"), (903, "W1  w2")]
    rows = [*rows, rows[0]]
    df = docs_of(spark, [*rows, (None, "w1 w2")]).repartition(4)
    got = ngram_join.link_counts(df, percent, block, size).collect()
    assert len(got) == len(rows) + 1
    expected = brute_links(dict(rows), percent, size)
    assert {r.doc_id: r.n_links for r in got if r.doc_id is not None} == {i: len(x) for i, x in expected.items()}
    assert min(len(expected[2_000 + i]) for i in range(60)) >= 59
    assert sorted({r.doc_id for r in got if r.doc_id == r.component_id and r.doc_id is not None}) == heads_of(expected)
    alone = next(r for r in got if r.doc_id is None)
    assert (alone.component_id, alone.n_links) == (None, 0)
    assert ngram_join.link_counts(docs_of(spark, [])).count() == 0


def test_links_equal_their_sql(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = QUERIES["op1_ngram_links"](spark, folder)
    cursor = con.execute(ORACLES["op1_ngram_links"])
    assert df.columns == [d[0] for d in cursor.description]
    assert Counter(tuple(r) for r in df.collect()) == Counter(cursor.fetchall())


def test_one_stays_at_five_words(spark):
    base = [f"v{k}" for k in range(100)]
    near = [w if k not in (30, 70) else "other" + w for k, w in enumerate(base)]
    rows = [*near_rows(random.Random(12), 200), (500, " ".join(base)), (501, " ".join(near))]
    kept = ngram_join.keep_one(docs_of(spark, rows), percent=80, size=5)
    got = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert got == heads_of(brute_links(dict(rows), 80, 5))
    assert 500 in got and 501 not in got
    # Three words at 0.9 leave both.
    assert 501 in {r.doc_id for r in ngram_join.keep_one(docs_of(spark, rows)).select("doc_id").collect()}


def test_texts_that_share_an_id_are_judged_alone(spark):
    rows = [
        (1, "a b c d e f"), (2, "g h i j k l"), (2, "A B C d e f"), (2, "m n o p q r"), (2, "m n o p q r"),
        (3, None), (3, "s t u v w x"), (3, "g h i  j k l"), (4, " "), (4, ""), (4, ""), (None, "a b c d e f"),
    ]
    df = docs_of(spark, rows).repartition(3)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    # Text 2 of id 2 copies id 1, text 3 of id 3 copies id 2, equal rows count once.
    expected = [r for k, r in enumerate(rows) if k not in (2, 4, 7, 10)]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(expected)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(260, 259), (3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 141)) and all(got[k] == 7 for k in range(200, 261))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- toxicity -----------------------------------------------------------------


def toxic_rows(n=900, seed=9):
    rng = random.Random(seed)
    plain = ["table", "river", "not", "said", "stone", "you", "green", "walk", "paper", "cloud"] + [f"w{k}" for k in range(150)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["blarg", "snorkish", "vequ" + rng.choice("abcdefgh"), "vequ" + rng.choice("xyz")])
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_learns_words_and_stems(spark):
    rows, labels = toxic_rows()
    docs = docs_of(spark, [*rows, (9_000, None), (9_001, ""), (9_002, LONG), (None, "blarg blarg blarg")])
    grammar = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score_texts(docs, grammar).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (crc_of_id(r.doc_id) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(r.predicted == 0 for r in got if r.doc_id in (9_000, 9_001, 9_002))
    kept = toxicity.drop_toxic(docs, grammar)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score_texts(docs_of(spark, []), grammar).count() == 0


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, EDGE)
    assert {r.predicted for r in toxicity.score_texts(docs, toxicity.fit(docs, none)).collect()} == {0}


def test_grammar_labels_clauses():
    grammar = toxicity.Grammar({b"blarg ": 2.0}, toxicity.PRIOR)
    weight = grammar.weigher()
    label = lambda text: [k for k, _ in toxicity.read_clause(text.encode().split(), weight) if k in toxicity.LABELS]
    assert label("a blarg here") == ["insult"]
    assert label("you are a blarg") == ["targeted"]
    assert label("this is not blarg") == ["negated"]
    assert label("she said blarg then") == ["reported"]
    assert label("i will hurt you") == ["threat"]
    plain = grammar.score(b"you blarg", weight)[0]
    assert plain > grammar.score(b"she said you blarg", weight)[0] > grammar.score(b"stone", weight)[0]


# -- mixing -------------------------------------------------------------------


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(10)
    p = rng.dirichlet([1.0, 0.4, 0.3], 3_000)
    tokens = rng.integers(0, 400, 3_000)
    members = spark.createDataFrame(
        [(i, int(t), [float(v) for v in q]) for i, (t, q) in enumerate(zip(tokens, p, strict=True))],
        "row long, n_tokens long, p array<double>",
    )
    push, shares, wanted = mixing.fit_rates(members)
    rate = np.array([r.r for r in members.select("row", mixing.rate_column(push).alias("r")).orderBy("row").collect()])
    assert rate.min() >= 0 and rate.max() <= mixing.MOST
    met = (rate[:, None] * tokens[:, None] * p).sum(axis=0) / tokens.sum()
    assert np.abs(met - shares).max() < 1e-9 and np.abs(met - wanted).max() < 0.02
    # The optimum: no gradient is left, and rates follow from the push alone.
    assert np.abs(met - wanted - mixing.PULL * push).max() < 1e-4
    assert np.allclose(rate, np.clip(1 - p @ push, 0, mixing.MOST))
    assert not mixing.fit_rates(members.limit(0))[0].any()


@pytest.mark.parametrize("few", [9, 2])
def test_a_rare_domain_reaches_its_target(spark, few):
    # A share of 0.003 needs a rate of 16.7 for 0.05.
    members = spark.createDataFrame(
        [(i, 100, [0.0, 0.0, 1.0] if i < few else [0.0, 1.0, 0.0] if i < 300 else [1.0, 0.0, 0.0]) for i in range(3_000)],
        "row long, n_tokens long, p array<double>",
    )
    push, shares, wanted = mixing.fit_rates(members)
    assert np.abs(shares - wanted).max() <= mixing.MISS
    first = members.where("row = 0").select(mixing.rate_column(push).alias("r")).first().r
    assert abs(first - 0.05 * 3_000 / few) < 0.1 * 3_000 / few * 0.05


def test_targets_out_of_reach_are_reported(spark):
    # Posteriors alike everywhere: no rates change the proportions.
    docs = docs_of(spark, [(i, f"w{i} w{i + 1} w3") for i in range(50)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.miss > 0.5 for r in mixing.mix(docs, none).collect()} == {True}
    with pytest.warns(UserWarning, match="no rates meet"):
        mixing.apply_mix(docs, none)


def test_mix_meets_targets_of_the_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = mixing.mix(docs, labels).collect()
    assert {r.miss <= mixing.MISS for r in rows} == {True}
    total = sum(r.n_tokens for r in rows)
    for domain, share in mixing.TARGETS.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{domain}"] for r in rows) / total - share) < 2 * mixing.MISS
    rows = mixing.mix(docs, labels, mixing.FILTERED_TARGETS).collect()
    assert "p_toxic" not in rows[0] and {r.miss <= mixing.MISS for r in rows} == {True}


def test_mix_of_small_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    edge = docs.union(spark.createDataFrame([(9_999, None, None, None, None), (None, "a b", "en", None, 3)], docs.schema))
    rows = mixing.mix(edge, labels).collect()
    assert len(rows) == edge.count()
    assert all(abs(r.p_good + r.p_low + r.p_toxic - 1) < 1e-9 and abs(r.copies - r.rate) < 1 for r in rows)
    mixed = mixing.apply_mix(edge, labels)
    assert mixed.columns == docs.columns and mixed.count() > 0
    truth = {r.doc_id: r for r in labels.collect()}
    mean = lambda want: np.mean([r.rate for r in rows if r.doc_id in truth and want(truth[r.doc_id])])
    assert mean(lambda t: t.quality == 1 and t.toxic == 0) > mean(lambda t: t.toxic == 1)
    assert mixing.mix(docs.limit(0), labels).count() == 0
    assert mixing.mix(docs, labels.limit(0)).count() == docs.count()


# -- queries and pipeline -----------------------------------------------------


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op3_exact_dedup", "op5_decontamination", "op6_url_filter"])
def test_queries_equal_their_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    heads = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(heads)
    assert Counter(tuple(r) for r in df.select(heads).collect()) == Counter(cursor.fetchall())


def test_jaccard_sql_on_near_copies(spark):
    import duckdb

    rows = near_rows(random.Random(11), 150)
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    con.register("fixture", frame)
    got = {r[0]: r[1:] for r in con.execute(jaccard_sql("fixture")).fetchall()}
    assert got == brute_components(rows)


def test_pipeline_equals_its_parts(spark, folder):
    final = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert final.columns == [*docs.columns, "slot", "shard"]
    # The same by other means: verdict tables and brute force instead of the filters.
    judged = toxicity.score_texts(docs, toxicity.fit(docs, labels))
    left = {r.doc_id for r in judged.collect() if r.predicted == 0}
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = {i for i, (_, c) in brute_components([(i, texts[i]) for i in left], 80, 5).items() if i == c}
    rest = docs.where(F.col("doc_id").isin(*left))
    overlap = decontaminate.digest(decontaminate.find_overlap(rest, bench)).collect()
    left = {r.doc_id for r in overlap if not r.contaminated}
    rest = docs.where(F.col("doc_id").isin(*left))
    counts = Counter(r.doc_id for r in mixing.apply_mix(rest, labels).select("doc_id").collect())
    rows = final.collect()
    assert Counter(r.doc_id for r in rows) == counts
    owner = sharding.fill()
    assert all(r.shard == owner[r.slot] and r.text == texts[r.doc_id] for r in rows)


def test_pipeline_stages_hold_few_texts_at_a_time(spark, folder):
    # They held batches of 10,000 whole texts, with their words and features, and workers kept that memory.
    import pyarrow as pa

    from shelfstream.llm import common

    texts = ["x" * 400_000, None, "", "y" * 900_000, "é" * 2_000_000, *["z" * 1_000] * 3_000]
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": texts})
    parts = list(common.slices(batch, "text"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or sum(map(len, common.raw_texts(p.column("text")))) < 2 * common.SLICE_BYTES + 4_000_000 for p in parts)
    assert max(p.num_rows for p in parts[3:]) <= common.SLICE_BYTES // 1_000 + 1
    assert not list(common.slices(batch.slice(0, 0), "text"))

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.format_string("text %s", "id").alias("text"))
        docs = docs.coalesce(1)
        mixed = corpus_pipeline.mix_domains(spark, docs, folder)

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

        found = [r.n for r in mixed.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 1_000 and max(found) <= common.BATCH_ROWS
    finally:
        spark.conf.set(key, before)
