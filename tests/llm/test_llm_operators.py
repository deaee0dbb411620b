"""Each operator against brute force on a small table, and on odd and empty ones."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dealspan.llm import annforest, common, decontam, hmm, langid, linededup, packing, phrases, simhash, toxicity, urlfilter
from dealspan.llm.common import Scratch
from dealspan.llm.tokens import TokenCoder
from dealspan.llm.workload import TOKENIZER

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_token_coder_equals_the_tokenizer(odd_documents):
    whole, own = Tokenizer.from_file(PATH), TokenCoder(PATH, most=50)
    texts = [r.text or "" for r in odd_documents.collect()]
    texts += ["It's we'll 12½ ŉ Ǆ e\u0301 a\u0085b x\x0by <|startoftext|>", "ﬁ ΣΑΣ ÀÉß ſ", "a--b...c 'tis"]
    for text in texts:
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own(text), "<u4").tolist() == want


@pytest.mark.parametrize("range_rows, tail", [(100_000, 0), (20, 50), (100_000, 100_000)])
def test_packing_is_whole_and_tight(spark, docs, odd_documents, range_rows, tail):
    columns = ["doc_id", "text"]
    both = docs.select(columns).union(odd_documents.select(columns))
    with Scratch(spark) as scratch:
        pieces = packing.token_pieces(both, PATH).withColumn("unit_id", F.monotonically_increasing_id())
        pieces = scratch.keep(pieces)
        units = pieces.filter("length < 2048").select("unit_id", "length")
        placed = packing.best_fit(units, 2048, scratch, range_rows, tail).join(units, "unit_id").toPandas()
        assert len(placed) == units.count()
        total = int(pieces.agg(F.sum("length")).first()[0])
        full = pieces.filter("length = 2048").count()
    placed = placed.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 2048
    assert placed.sequence_id.nunique() + full <= 1.02 * math.ceil(total / 2048) + 1


@pytest.mark.parametrize("length, rows, least, tail", [(40, 12_000, 236, 2000), (58, 12_000, 343, 2000), (58, 1_200, 35, 0), (1, 2_048, 1, 2000), (63, 33, 2, 0)])
def test_short_units_fill_all_gaps(spark, length, rows, least, tail):
    units = spark.range(rows).select(F.col("id").alias("unit_id"), F.lit(length).cast("long").alias("length"))
    with Scratch(spark) as scratch:
        placed = packing.best_fit(units, 2048, scratch, tail=tail).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(placed.unit_id) == list(range(rows))
    assert (placed.offset == placed.groupby("sequence_id").cumcount() * length).all() and placed.offset.max() + length <= 2048
    assert placed.sequence_id.nunique() <= least + 1


def test_short_units_go_into_gaps_below_their_group(spark):
    """Gaps of 60 take units of 10, although their groups have 70."""
    units = [(i, 1988) for i in range(20)] + [(100 + i, 10) for i in range(120)]
    with Scratch(spark) as scratch:
        placed = packing.best_fit(spark.createDataFrame(units, "unit_id long, length long"), 2048, scratch).toPandas()
    assert len(placed) == 140 and placed.sequence_id.nunique() <= 21


def test_packed_ids_are_the_texts(odd_documents):
    rows = packing.pack_documents(odd_documents, PATH).toPandas()
    whole = Tokenizer.from_file(PATH)
    want = sorted(str(whole.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in odd_documents.collect())
    firsts = rows[rows.piece == 0]
    assert len(firsts) == len(want)
    by_start = rows[rows.doc_id.isin([5])].sort_values("start")
    ids = np.frombuffer(b"".join(by_start.ids), "<u4").tolist()
    assert str(ids) in want
    short = [str(np.frombuffer(x, "<u4").tolist()) for x in firsts[firsts.length < 2048].ids]
    assert set(short) <= set(want)


def test_near_duplicates_against_all_pairs(spark, docs, odd_documents):
    both = docs.select("doc_id", "text").union(odd_documents.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    rows = simhash.near_duplicates(both).toPandas()
    fps = {int(x) & (2**64 - 1) for x in rows.fp}
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    rows["root"] = [root(int(x) & (2**64 - 1)) for x in rows.fp]
    want = rows.groupby("root").doc_id.transform("min")
    assert len(rows) == both.count()
    assert ((rows.component_id == want) | (rows.component_id.isna() & want.isna())).all()


def test_fingerprint_of_short_texts():
    assert simhash.fingerprint(None, 4) == simhash.fingerprint(" \n", 4) == 0
    assert simhash.fingerprint("A b", 4) == xxhash.xxh64_intdigest(b"a b", 42)


def test_ball_plan_reaches_all_distances():
    rng = np.random.default_rng(0)
    for segments in (2, 3, 4):
        plan = simhash.ball_plan(4, segments)
        for _ in range(200):
            change = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
            assert any(change & mask in changes for _, mask, changes in plan)


def test_segments_follow_from_the_number_of_texts(spark):
    chosen = [simhash.cheapest_segments(10**n, 4) for n in range(11)]
    assert chosen == sorted(chosen, reverse=True) and len(set(chosen)) > 2 and chosen[-1] == 2
    assert simhash.cheapest_segments(1000, 0) == 1
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(63, k, replace=False)) for b in base for k in (0, 1, 3, 4, 5)]
    fps = spark.createDataFrame([(x,) for x in set(near)], "fp long")
    want = {(a, b) for a in near for b in near if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    for segments in (2, 3, 4, 5):
        assert {tuple(r) for r in simhash.near_links(fps, 4, segments).collect()} == want


def test_languages_of_held_out_texts(docs, odd_documents):
    held = "pmod(crc32(coalesce(cast(doc_id as string), '')), 4) = 2"
    rows = langid.predict_languages(docs, held).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.9
    odd = langid.predict_languages(odd_documents, held).toPandas()
    assert len(odd) == odd_documents.count() and odd.score.between(0, 1).all()
    assert set(odd[odd.doc_id.isin([2, 3, 4, 8])].lang_pred) == {"und"}


def _brute_score(p, symbols):
    a, total = p.start * p.emits[symbols[0]], 0.0
    for s in symbols[1:]:
        total += math.log10(a.sum())
        a = (a / a.sum()) @ p.moves * p.emits[s]
    return total + math.log10(a.sum())


def test_forward_and_expected_counts():
    rng = np.random.default_rng(3)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    p = hmm.Parameters(norm(rng.random(3)), norm(rng.random((3, 3))), np.ascontiguousarray(norm(rng.random((3, 5))).T))
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 2, 6, 4)]
    ragged = hmm.Ragged(sequences)
    assert np.allclose(ragged.forward(p), [_brute_score(p, s) for s in sequences])
    start, moves, counts = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for s in sequences:  # all paths
        paths = [()]
        for _ in s:
            paths = [(*x, k) for x in paths for k in range(3)]
        weights = [p.start[x[0]] * np.prod([p.emits[y, k] for y, k in zip(s, x)]) * np.prod([p.moves[i, j] for i, j in zip(x, x[1:])]) for x in paths]
        for x, w in zip(paths, np.array(weights) / sum(weights)):
            start[x[0]] += w
            for i, j in zip(x, x[1:]):
                moves[i, j] += w
            for y, k in zip(s, x):
                counts[k, y] += w
    for expected in (ragged.expected, ragged.expected_by_step):
        for have, want in zip(expected(p), (start, moves, counts)):
            assert np.allclose(have, want)
        assert math.isclose(ragged.whole, sum(_brute_score(p, s) for s in sequences))


def test_expected_counts_in_single_precision():
    rng = np.random.default_rng(5)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    emits = rng.random((8, 400)) ** 12 + 1e-9  # far from even
    moves = rng.random((8, 8)) ** 6 + 1e-6
    double = hmm.Parameters(norm(rng.random(8)), norm(moves), np.ascontiguousarray(norm(emits).T))
    single = hmm.Parameters(*(x.astype(np.float32) for x in (double.start, double.moves, double.emits)))
    ragged = hmm.Ragged([rng.integers(0, 400, n) for n in (1, 1, 700, 3, 50, 51, 200, 4, 5)])
    want, whole = ragged.expected_by_step(double), (ragged.whole,)
    for have, x in zip(ragged.expected(single), want):
        assert np.allclose(have, x, rtol=1e-3, atol=1e-4 * x.max())
    assert math.isclose(ragged.whole, whole[0], rel_tol=1e-6)
    # sums that leave single precision between two rescalings are done again in double precision
    far = np.full((4, 8), 1e-30)
    far[[0, 1, 2, 3], [0, 1, 2, 3]] = 1.0
    stuck = np.full((8, 8), 1e-30) + np.eye(8)
    cut = hmm.Parameters(np.eye(8)[0].astype(np.float32), stuck.astype(np.float32), far.astype(np.float32))
    lost = hmm.Ragged([np.array([0, 1, 2, 3, 0, 1, 2, 3])])
    with np.errstate(all="ignore"):
        start, _, counts = lost.expected(cut)
    assert np.isfinite(counts).all() and math.isclose(start.sum(), 1) and math.isclose(counts.sum(), 8)
    assert [x.tolist() for x in hmm.Ragged([]).expected(single)][0] == [0.0] * 8


def test_rounds_go_further_and_never_end_lower(spark):
    from pyspark.sql import types as T

    rng = np.random.default_rng(8)
    texts = [(np.r_[rng.choice(np.arange(1, 20) if i % 2 else np.arange(15, 40), 30), 0].astype(np.uint16).tobytes(),) for i in range(200)]
    train = spark.createDataFrame(texts, T.StructType([T.StructField("symbols", T.BinaryType())])).repartition(3)
    ragged = hmm.Ragged([np.frombuffer(x, np.uint16) for x, in texts])
    common = np.bincount(ragged.symbols, minlength=43) + 0.1
    common /= common.sum()
    first = plain = hmm.first_parameters([], 3, common, 0)
    for _ in range(12):
        plain = hmm.reestimate(*ragged.expected(plain), common)
    made = hmm._trained(train, first, 12, 12, 0.0, common, spark)
    assert ragged.forward(made).sum() >= ragged.forward(plain).sum() > ragged.forward(first).sum()


def test_groups_hold_every_sequence(monkeypatch):
    monkeypatch.setattr(hmm, "BATCH_TOKENS", 10)
    sequences = [np.zeros(n) for n in (3, 25, 1, 9, 9, 1, 4, 0)]
    groups = list(hmm._groups(sequences))
    assert sorted(i for places, _ in groups for i in places) == list(range(8))
    assert all(len(sequences[i]) == len(x) for places, part in groups for i, x in zip(places, part))
    assert list(hmm._groups([])) == []


def test_scores_of_texts(docs, odd_documents):
    both = docs.select("doc_id", "text").union(odd_documents.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    held = "pmod(crc32(coalesce(cast(doc_id as string), '')), 10) = 0"
    rows = hmm.score_texts(both, held, states=3, frequent=500, classes=50, sample_texts=50).toPandas()
    texts = both.withColumn("held", F.expr(held)).collect()
    counts = Counter(w for r in texts if not r.held for w in [*hmm.tokens(r.text), None])
    total, kinds = sum(counts.values()), len(counts)
    assert len(rows) == len(texts) and set(rows.train_tokens) == {total}
    base = lambda ws: sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
    key = lambda i, s: (i is None or i != i, -1 if i is None or i != i else int(i), round(s, 6))
    want = sorted((key(r.doc_id, base(ws)), len(ws), sum(w in counts for w in ws)) for r in texts for ws in [[*hmm.tokens(r.text), None]])
    have = sorted((key(r.doc_id, r.base_score), r.n_tokens, r.n_known) for r in rows.itertuples())
    assert have == want
    new = rows[rows.held_out]
    assert new.score.sum() > new.base_score.sum()


def test_recurring_passages_against_brute_force(docs, odd_documents):
    both = docs.select("doc_id", "text").union(odd_documents.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    rows = phrases.remove_recurring(both, shard_words=20_000).toPandas()
    texts = [(r.text or "").encode().split() for r in both.collect()]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    want = []
    for w in texts:
        keep = np.ones(len(w), bool)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = False
        want.append((len(w), len(w) - int(keep.sum()), b" ".join(x for x, k in zip(w, keep) if k).decode()))
    assert sorted(rows[["n_words", "n_removed", "text"]].itertuples(index=False, name=None)) == sorted(want)


def test_line_windows(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "q\nq\nq\nq\nq"), (4, "\n\n\n\n"), (5, None), (6, ""), (7, "a\nb"), (8, "a\nb\nc\nd"), (8, "a\nb\nc\nd")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_lines string")
    found = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(df).collect() if r.doc_id != 5)
    assert found == [
        (1, "a\nb\nc\nd", 4, 0), (2, "x\ny", 5, 3), (3, "q\nq\nq", 5, 2), (4, "\n\n\n\n", 5, 0), (6, "", 1, 0), (7, "a\nb", 2, 0),
        (8, "", 4, 4), (8, "", 4, 4),
    ]
    null = linededup.dedup_lines(df).filter("doc_id = 5").first()
    assert null.text is None and null.n_lines == 0


@pytest.mark.parametrize("sent_rows", [0, 1000])
def test_items_in_long_documents(spark, sent_rows):
    item = "one two three four five six seven eight nine ten"
    changed = item.replace("ten", "11")
    rows = [(1, "x " * 5000 + item.upper() + " y" * 5000), (2, changed + "!"), (3, item[:24]), (4, None), (5, ""), (None, item), (6, item), (6, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (7, item), (None, "a b c d e")], "item_id long, text string")
    found = decontam.contained_items(docs, items, sent_rows=sent_rows).collect()
    have = sorted((r.doc_id or 0, r.item_id, r.n_shared, r.n_item) for r in found)
    assert have == [(0, 7, 6, 6), (1, 7, 6, 6), (2, 7, 5, 6), (6, 7, 6, 6)]


def test_toxic_documents(spark, docs, odd_documents):
    rows = [(i, f"some quiet words number {i}" + (" vile" if i % 3 == 0 else ""), 0) for i in range(300)]
    own = spark.createDataFrame(rows, "doc_id long, text string, rejected int")
    labels = spark.createDataFrame([(i, int(i % 7 == 0), int(i % 3 == 0)) for i in range(150)], "doc_id long, low_quality int, toxic int")
    found = toxicity.toxic_documents(own, labels).toPandas()
    assert (found.rejected == (found.doc_id % 3 == 0)).all()
    odd = toxicity.toxic_documents(odd_documents, labels)
    assert odd.count() == odd_documents.count()
    assert odd.filter("doc_id in (2, 3, 4, 8) and rejected").count() == 0
    assert toxicity.toxic_documents(own, labels.limit(0)).filter("rejected").count() == 0


def test_urls(spark):
    urls = [None, "", "nothing", "http://A.com/x", "https://www.Example.com/en/1?q", "http://b.example.com/en/2", "ftp://c.net/es/3#f", "http://d.net/es", "http://com", "http://e.org/x://y.com/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    found = {r.page_id: r for r in urlfilter.judge_urls(pages).collect()}
    assert [found[i].host for i in range(10)] == ["", "", "", "a.com", "www.example.com", "b.example.com", "c.net", "d.net", "com", "e.org"]
    assert [found[i].path for i in (2, 3, 4, 6, 7, 9)] == ["", "/x", "/en/1", "/es/3", "/es", "/x://y.com/"]
    assert [found[i].rule for i in range(10)] == [None, None, None, "com/", "www.example.com/en/", "example.com/en/", "net/es/", None, None, None]
    assert found[4].verdict == "allow" and found[5].verdict == "block"
    assert all(r.verdict in ("allow", "block") for r in found.values())


def test_nearest_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.standard_normal(8).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[100][1]) for i in range(30)]
    odd = [(500, None), (600, []), (700, [0.0] * 8), (800, [float("nan")] * 8), (None, [1.0] * 8), (900, [1.0, None] * 4), (901, [1.0] * 3), (200, vectors[200][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    for least, recall in ((2000, 1.0), (40, 0.5)):
        found = annforest.nearest(df, "vec_id % 100 = 0", least=least).toPandas()
        sound = {i: np.array(v, np.float32).astype(float) for i, v in vectors}
        hits = 0
        assert sorted(set(found.query_id)) == [i for i in sorted(sound) if i % 100 == 0]
        for q, rows in found.groupby("query_id"):
            want = sorted((math.sqrt(((v - sound[q]) ** 2).sum()), i) for i, v in sound.items() if i != q)[:10]
            rows = rows.sort_values("rank")
            hits += len({i for _, i in want} & set(rows.vec_id))
            if recall == 1.0:
                assert rows.vec_id.tolist() == [i for _, i in want] and rows["rank"].tolist() == list(range(1, 11))
                assert np.allclose(rows.score, [s for s, _ in want])
        assert hits >= recall * len(found)


def test_empty_tables(spark, odd_documents):
    none = odd_documents.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, low_quality int, toxic int")
    results = [
        packing.pack_documents(none, PATH), simhash.near_duplicates(none), langid.predict_languages(none, "true"), urlfilter.judge_urls(pages),
        hmm.score_texts(none, "doc_id = 0"), phrases.remove_recurring(none), linededup.dedup_lines(none), decontam.contained_items(none, items),
        toxicity.toxic_documents(none, labels), annforest.nearest(vectors, "vec_id % 100 = 0"),
    ]
    assert [r.count() for r in results] == [0] * 10


def test_odd_rows_keep_every_row(odd_documents):
    n = odd_documents.count()
    assert simhash.near_duplicates(odd_documents).count() == n
    out = phrases.remove_recurring(odd_documents, carry={"h": F.sha2("text", 256)})
    assert out.count() == n and out.filter(F.col("h") == hashlib.sha256(b"").hexdigest()).count() >= 3
    assert linededup.without_repeated_lines(odd_documents).columns == odd_documents.columns


def test_nearest_in_a_cluster_of_jittered_copies(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    vectors = np.concatenate([rng.standard_normal((2000, 16)), centre + 1e-4 * rng.standard_normal((1000, 16))])[rng.permutation(3000)]
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
    found = annforest.nearest(df, "vec_id % 50 = 0", least=40, share=0.02).toPandas()
    in_cluster = [q for q in range(0, 3000, 50) if np.abs(vectors[q] - centre).max() < 0.01]
    hits = 0
    for q in in_cluster:
        gaps = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        gaps[q] = np.inf
        hits += len(set(np.argsort(gaps)[:10]) & set(found[found.query_id == q].vec_id))
    assert len(in_cluster) > 10 and hits >= 0.99 * 10 * len(in_cluster)


def test_words_of_a_run_of_texts():
    texts = [None, "", " \t ", "  Two words\n", "\u00c4 \u00e4\u00a0A\x1cb\u2003c\x0b\x0c\rD", "\x85x\x85 \x00 end", "a a A"]
    flat, lengths = hmm._flat(pa.array(["left out", *texts, "left out"])[1:-1])
    assert [w.encode() for w in flat.to_pylist()] == [w for t in texts for w in hmm.tokens(t)]
    assert lengths.tolist() == [len(hmm.tokens(t)) for t in texts]
    batches = [pa.RecordBatch.from_pydict({"own_text": pa.array(texts * n, pa.string())}) for n in (1, 2)]
    found = Counter()
    for batch in hmm._counted(iter(batches)):
        for row in batch.to_pylist():
            found[row["token"].encode()] += row["n"]
    assert found == Counter(w for t in texts * 3 for w in hmm.tokens(t))


def test_scores_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"{'ab'[i % 50 == 0]}{j}" for j in rng.integers(0, 30, 12)) for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = lambda n: hmm.score_texts(df.repartition(n, "doc_id"), "doc_id % 10 = 1", states=2, frequent=70, classes=5).toPandas().set_index("doc_id").score.sort_index()
    assert np.allclose(score(1), score(5), rtol=1e-4)


def test_toxicity_learns_from_one_row_of_an_id(spark, monkeypatch):
    rows = [(0, f"vile words repeated {i}") for i in range(500)] + [(i, "vile thing" if i % 2 else "quiet thing") for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 2 == 1)) for i in range(40)], "doc_id long, low_quality int, toxic int")
    fit, sizes = toxicity.Chain.fit, []
    monkeypatch.setattr(toxicity.Chain, "fit", lambda self, texts, *more: (sizes.append(len(texts)), fit(self, texts, *more))[1])
    assert toxicity.toxic_documents(docs, labels).count() == len(rows) and sizes == [40]


def test_only_a_run_is_read_as_texts(monkeypatch):
    batch, read, runs = pa.record_batch({"text": ["abc", None, "é" * 9, "", "x" * 30, "end"]}), [], common.runs

    class Seen:
        def __init__(self, part):
            self.part = part

        def column(self, name):
            read.append(self.part.num_rows)
            return self.part.column(name)

    monkeypatch.setattr(common, "runs", lambda *given: map(Seen, runs(*given)))
    assert [texts for _, texts in common.slices(batch, "text", 12)] == [["abc", None, "é" * 9, ""], ["x" * 30], ["end"]]
    assert read == [4, 1, 1]
    assert not list(common.slices(batch.slice(0, 0), "text"))


def test_rounds_read_groups_as_laid_out():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 50, n).astype("<u2") for n in (3, 1, 40, 7, 7, 90)]
    batch = pa.record_batch({"symbols": [x.tobytes() for x in sequences]})
    (row,) = [r for b in hmm._laid_out(iter([batch])) for r in b.to_pylist()]
    laid = hmm.Ragged.laid_out(np.frombuffer(row["symbols"], "<u2").astype(np.int64), np.frombuffer(row["lengths"], "<i8"))
    p = hmm.first_parameters(sequences, 4, np.full(50, 1 / 50), 2)
    for a, b in zip(laid.expected(p), hmm.Ragged(sequences).expected(p), strict=True):
        assert np.array_equal(a, b)


def test_words_are_looked_up_together(monkeypatch):
    commonest, asked, word_class = ["the", "of", "\u00e9"], [], hmm.word_class
    texts = ["of nation station a \u00e9 ab the na\u00efve\u20ac motion ab", None, "", "The of"]
    monkeypatch.setattr(hmm, "word_class", lambda w, *more: (asked.append(w), word_class(w, *more))[1])

    def symbols(words):
        class shared:
            value = [w.encode() for w in words], np.ones(len(words) + 1), np.ones(20)

        batch = pa.record_batch({"id": range(4), "held_out": [False] * 4, "text": pa.array(texts, pa.string())})
        (out,) = hmm._encoded(shared, len(words), 20, 9.0, "id", "text")(iter([batch]))
        return [np.frombuffer(x, "<u2").tolist() for x in out.column("symbols").to_pylist()]

    for words in (commonest, []):
        place = {w.encode(): i + 1 for i, w in enumerate(words)}
        assert symbols(words) == [[*(place.get(w) or word_class(w, len(words), 20) for w in hmm.tokens(t)), 0] for t in texts]
    asked.clear()
    symbols(commonest)
    assert len(asked) == len({w[-3:] for t in texts for w in hmm.tokens(t) if w.decode() not in commonest}) == 4  # not once for each word


def test_groups_share_their_tables(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(hmm, "ADDED_ROWS", 16)
    monkeypatch.setattr(hmm, "COUNTED_ROWS", 10)
    room = hmm.Room()
    for states, sizes in ((3, (3, 1, 40, 7, 7, 90)), (3, (2, 5)), (1, (4, 4, 9)), (8, (30, 0, 200))):
        ragged = hmm.Ragged([rng.integers(0, 50, n).astype("<u2") for n in sizes])
        p = hmm.first_parameters([], states, np.full(50, 1 / 50), 0)
        want, whole = ragged.expected_by_step(p), ragged.whole
        for x in room.tables(sum(sizes), states, p.emits.dtype):
            x[:] = np.nan  # what an earlier group left counts for nothing
        kept = room._kept[0]
        for have, x in zip(ragged.expected(p, room), want, strict=True):
            assert np.allclose(have, x)
        assert math.isclose(ragged.whole, whole) and room._kept[0] is kept


def test_pipeline_sends_a_text_to_the_classifier_once(spark, monkeypatch):
    docs = spark.createDataFrame([("x", 1, "one text", 3), ("y", 2, None, 4)], "`a.b` string, doc_id long, text string, rejected long")
    given = {}

    def judge(docs, labels, carry, carry_text):
        given.update(carry)
        own = docs.select("doc_id", *(c.alias(n) for n, c in carry.items()), F.col("text").alias(carry_text))
        return own.withColumn("rejected", F.lit(False))

    monkeypatch.setattr(toxicity, "toxic_documents", judge)
    left = corpus_pipeline.without_toxic(spark, docs, SF)
    assert left.columns == docs.columns and sorted(left.collect()) == sorted(docs.collect())
    assert "text" not in docs.select(given["document"].alias("d")).schema["d"].dataType.names
