"""Chat formatting, ranked search and collocations against brute force, and on odd and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealspan.llm import chat, collocations, fptree
from dealspan.llm.workload import chat_digest

TURNS = "conv_id long, turn long, role string, text string, example string, own_turn string, t string, loss_begin string"
TRICKY = ["</s>[INST] ok [/INST]", r"<\/s> [\\INST] \ [[INST]", "<s><s></s", "[/INST]\n\n</s>x", "", "a<b [c] \\", "é\U0001f600</s>", "$1 \\1"]


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS)


def test_escapes_are_taken_back(spark):
    rng = random.Random(3)
    texts = TRICKY + ["".join(rng.choices(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "x"], k=12)) for _ in range(300)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).withColumn("u", chat.unescaped(F.col("e"))).collect()
    assert all(r.t == r.u for r in out)
    assert not any(c in r.e for r in out for c in chat.CONTROLS)
    with pytest.raises(ValueError):
        chat.escaped(F.lit("x"), ("<<a>>",))


def test_every_reply_is_an_example(spark):
    rows = [(1, 2, "user", "how"), (1, 0, "system", TRICKY[0]), (1, 1, "assistant", TRICKY[1]), (1, 3, "assistant", None), (1, 4, "user", TRICKY[3]),
            (2, 0, "user", "alone"), (3, None, "assistant", "last"), (3, 5, None, "first"), (3, 5, "a\nb [INST]", "tie"), (3, 5, "a\nb [INST]", "tie"),
            (None, 0, "assistant", "no id")]
    got = chat.prefix_examples(_turns(spark, rows)).collect()
    by_id = defaultdict(list)
    for r in sorted(got, key=lambda r: r.example):
        by_id[r.conv_id].append(r)
    assert [(r.n_turns, r.loss_begin is None, r.closes) for r in by_id[1]] == [(2, False, False), (4, False, False), (5, True, True)]
    one = by_id[1]
    assert one[1].text == "<s>[INST]system\n<\\/s>[\\INST] ok [\\/INST][/INST]" + r"<\\/s> [\\\INST] \ [[\INST]" + "</s>[INST]user\nhow[/INST]</s>"
    assert one[1].text.startswith(one[0].text) and one[2].text.startswith(one[1].text)
    assert [r.text[r.loss_begin : r.loss_begin + r.loss_chars] for r in one[:2]] == [r"<\\/s> [\\\INST] \ [[\INST]", ""]
    assert [(r.n_turns, r.loss_chars, r.closes) for r in by_id[2]] == [(1, None, True)]
    read = chat.prefix_examples(_turns(spark, rows)).filter("closes").select("conv_id", chat.read_turns(F.col("text")).alias("t")).collect()
    turns = {r.conv_id: [(x.role, x.text) for x in r.t] for r in read}
    assert turns[3] == [("", "first"), ("a\nb [INST]", "tie"), ("a\nb [INST]", "tie"), ("assistant", "last")]
    assert turns[1] == [("system", TRICKY[0]), ("assistant", TRICKY[1]), ("user", "how"), ("assistant", ""), ("user", TRICKY[3])]
    assert turns[None] == [("assistant", "no id")]


def test_digests_are_those_of_the_turns(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "tool"]), rng.choice(TRICKY) + " x" * rng.randrange(9)) for c in range(20) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", "word " * 30) for t in range(400)]
    got = {r.conv_id: r for r in chat_digest(chat.prefix_examples(_turns(spark, rows))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == c)
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in own))
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert chat_digest(chat.prefix_examples(_turns(spark, []))).count() == 0


def test_chat_uses_no_python(spark):
    plan = chat_digest(chat.prefix_examples(_turns(spark, []).limit(0)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def _ranked(docs, items, k):
    """(item, rank) to (id, score) by plain counting."""
    terms = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = {}
    for item, wanted in asked.items():
        scored = []
        for i, c in own:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank] = (None if none else i, -s)
    return out


@pytest.mark.parametrize("tree_docs, leaf_docs, block_terms", [(4096, 64, 200_000), (40, 3, 25), (7, 1, 200_000)])
def test_ranking_against_brute_force(spark, odd_documents, tree_docs, leaf_docs, block_terms):
    rng = random.Random(tree_docs)
    words = [f"W{int(rng.paretovariate(0.4)) % 80}" for _ in range(5000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(150)]
    docs += [(r.doc_id, r.text) for r in odd_documents.collect()] + docs[:40] + [(1000 + i, docs[3][1] + ", " + docs[3][1]) for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12))) + "-the") for i in range(12)] + [(3, "fox w1"), (None, "FOX über"), (50, None), (51, "..")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, own_id string, n int").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, item_no string")
    got = fptree.best_documents(frame, asked, 10, block_terms=block_terms, tree_docs=tree_docs, leaf_docs=leaf_docs).collect()
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got} == _ranked(docs, items, 10)
    assert len(got) == len({(r.item_id, r["rank"]) for r in got})


def test_bounds_leave_subtrees_out():
    rng = np.random.default_rng(1)
    ranks = [np.unique(rng.zipf(1.5, 30) % 400) for _ in range(2000)]
    tfs = [rng.integers(1, 4, len(r)) for r in ranks]
    tree = fptree.Tree(ranks, tfs, rng.integers(50, 200, 2000), 16)
    leaves = [tree.span[i] for i in range(len(tree.span)) if not tree.below[i]]
    assert sorted(x for a, b in leaves for x in range(a, b)) == list(range(2000))
    queries = fptree.Queries([np.array([1, 350, 351, 352])], np.arange(400) + 1)
    best = fptree.Best(1, 10)
    assert 0 < fptree.search(tree, list(range(2000)), queries, best) < 2000


def test_empty_tables_rank_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert fptree.best_documents(none, items).count() == 0
    assert fptree.best_documents(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in fptree.best_documents(docs, items).collect()] == [(1, 1, 1, 287 * (10**9 // 1800))]


def _phrases(docs, longest, least, top, covered):
    count = defaultdict(Counter)
    for lang, text in docs:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, 4):
                count[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cands = {g: c for g, c in f.items() if 2 <= len(g) <= longest and c >= least}
        rows = []
        for g, a in cands.items():
            if any(len(h) > len(g) and 100 * b >= covered * a and g in {h[i : i + len(g)] for i in range(len(h))} for h, b in cands.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), l, r))
        rows.sort()
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_words, longest", [(3_000_000, 3), (50, 3), (500, 2)])
def test_phrases_against_brute_force(spark, odd_documents, shard_words, longest):
    rng = random.Random(shard_words)
    word = lambda: rng.choice(["a", "B", "the", "É", "x-y", "new", "york", " ", "\x1c", "q\x85"])
    docs = [(rng.choice(["en", "de", None, "und"]), "".join(word() + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(120)]
    docs += [("fr", "un deux trois " * 40)] * 3 + [(r.lang, r.text) for r in odd_documents.collect()]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "lang string, text string, own_lang string, shard int").repartition(3)
    got = collocations.collocations(frame, longest, 5, 30, 50, shard_words=shard_words).collect()
    assert sorted(tuple(r) for r in got) == _phrases(docs, longest, 5, 30, 50)


def test_index_counts_all_extensions():
    rng = np.random.default_rng(2)
    symbols = np.r_[rng.integers(0, 6, 500), 0]
    index = collocations.Index(symbols, 3)
    seen = lambda *g: sum(tuple(symbols[i : i + len(g)]) == g for i in range(len(symbols) - len(g) + 1))
    words = np.arange(1, 6)
    of, before, lo, back, n = index.left(*index.one(words))
    inner = before > 0
    pairs = list(zip(before[inner], words[of[inner]], strict=True))
    assert [int(x) for x in n[inner]] == [seen(*p) for p in pairs] and sum(n[inner]) == sum((symbols[1:] > 0) & (symbols[:-1] > 0))
    of, behind, _, _, n = index.right(lo[inner], back[inner], n[inner])
    assert all(seen(*pairs[o], c) == x for o, c, x in zip(of, behind, n, strict=True) if c > 0)
    of, before, _, _, n = index.left(*index.one(words))
    assert sum(n) == sum(symbols > 0)


def test_many_symbols_are_sorted_alike():
    rng = np.random.default_rng(4)
    small = rng.integers(0, 50, 3000)
    wide = np.array([0, *np.sort(rng.choice(2**30, 49, replace=False))])[small]  # packed keys would pass 63 bits
    assert (collocations._sorted(small, 3) == collocations._sorted(wide, 3)).all()


def test_no_phrases_in_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", " ,")], "lang string, text string")).count() == 0
