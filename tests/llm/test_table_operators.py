"""Mixing, sharding, chat formatting, the Jaccard join, top-k search and HTML extraction."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turfline.llm import chat_format, graph, html_extract, jaccard_join, mips, mixing, sharding
from turfline.llm.dom import parse
from turfline.llm.page_templates import labelled_page, loose_page

from .conftest import awkward_rows
from .pages_by_hand import PAGES


def brute_targets(sizes, weights, cap):
    """Iterated clamping: {source: target}; sources in order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        pool, mass = total - sum(fixed.values()), sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * pool > cap * sizes[s] * mass]
        if not over:
            return fixed | {s: w[s] * pool / mass for s in open_}
        fixed |= {s: float(cap * sizes[s]) for s in over}


def test_mixing_fills_targets(docs, no_docs):
    rows = mixing.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for _, text, _, source in awkward_rows():
        sizes[source] += len((text or "").replace("\x1c", "x").encode().split())
    want = brute_targets(sizes, mixing.WEIGHTS, 3)
    assert len(rows) == docs.count()
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    for s, t in want.items():
        assert t - 1 <= taken[s] <= t
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(no_docs).count() == 0


def test_water_filling_against_iteration(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 1000, 10**6]) for i in range(rng.randint(1, 9))}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.water_fill(table).collect()}
        want = brute_targets(sizes, mixing.WEIGHTS, 3)
        assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in sizes)


def test_the_mix_itself_takes_what_the_table_says(docs):
    mix = mixing.materialize_mix(docs)
    assert mix.columns == docs.columns
    n = lambda t: len((t or "").replace("\x1c", "x").encode().split())
    got, want = Counter(), Counter()
    for r in mix.collect():
        got[r.source] += n(r.text)
    for r in mixing.mix_sources(docs).collect():
        want[r.source] += r.taken
    assert got == +want


def test_repeated_rows_share_the_last_part(spark):
    rows = [(1, "a b c d e f g h", "x")] * 40 + [(k, "one two three four", "y") for k in range(100, 130)] + [(2, "w " * 500, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {s: t for (s, t) in {(r.source, r.target) for r in mixing.mix_sources(df).collect()}}
    got = Counter()
    for r in mixing.materialize_mix(df).collect():
        got[r.source] += len(r.text.split())
    assert all(want[s] - 1 <= got[s] <= want[s] for s in want)


def test_shards_are_even_and_hold_the_mixture(docs, no_docs):
    rows = sharding.interleave_shards(docs, shards=7).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 1 and set(by) == set(range(7))
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
    hot = [sum(r.source == "hot" for r in shard) for shard in by.values()]
    assert max(hot) - min(hot) <= 3
    assert {r.law for r in rows} == {"rows"} and all(r.grown_shard is None for r in rows)
    assert sum(r.size for r in rows) == sum(len((t or "").encode()) + 16 for _, t, _, _ in awkward_rows())
    assert sharding.interleave_shards(no_docs, shards=3).count() == 0


TURNS = [
    (1, 0, "user", "a<|im_end|>b"), (1, 1, "assistant", None), (1, 2, "assistant", "<\\|x <"), (1, 2, "assistant", "|y"),
    (2, 0, "a%\n0A<|", "\n"), (3, None, None, "z"), (4, 0, "assistant", "é😀<|im_sep|>"), (4, 0, "assistant", "é😀<|im_sep|>"), (None, 1, "user", ""),
]


def test_chats_read_back(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit("clash")).withColumn("formatted", F.lit(1))
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    want = defaultdict(list)
    for c, turn, role, text in sorted(TURNS, key=lambda t: (t[0] or 0, -1 if t[1] is None else t[1], t[2] or "", t[3] or "")):
        want[c].append((role or "", text or ""))
    for c, turns in want.items():
        assert [(t.role, t.text) for t in back[c].turns] == turns
        assert back[c].loss_text == "".join(x for role, x in turns if role == "assistant")
    digests = {r.conv_id: r for r in chat_format.chat_digests(df).collect()}
    for c, turns in want.items():
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat_format.chat_digests(df.limit(0)).count() == 0


def test_merged_turns_share_one_block(spark):
    df = spark.createDataFrame(TURNS[:4], "conv_id long, turn long, role string, text string")
    row = chat_format.format_chats(df).first()
    assert row.formatted.count("<|im_start|>") == 2 and row.formatted.count("<|im_sep|>") == 2


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def word_shingles(text):
    """Distinct 5-word tuples, by regex and without hashing."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, num=75):
    sets = [(i, word_shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    best = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        best[find(k)].append(i)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in best.items()}
    return Counter((i, len(s), low[find(k)]) for k, (i, s) in enumerate(sets))


def test_jaccard_join_finds_every_link(docs, no_docs):
    got = Counter(map(tuple, jaccard_join.near_duplicates(docs).collect()))
    assert got == brute_components([(i, t) for i, t, _, _ in awkward_rows()])
    assert jaccard_join.near_duplicates(no_docs).count() == 0
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: 1 for i, _, c in got if i == c})


def test_jaccard_join_on_drifting_copies(spark):
    rng = random.Random(9)
    rows, n = [], 0
    for family in range(6):
        text = [f"w{family}_{i}" for i in range(rng.randint(30, 90))]
        passage = [f"shared{i}" for i in range(20)]
        for _ in range(25):
            edited = list(text)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                text = edited  # chains of copies drift away from the first
            rows.append((n, " ".join(edited + (passage if rng.random() < 0.5 else []))))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, jaccard_join.near_duplicates(df).collect())) == brute_components(rows)


@pytest.mark.parametrize("num", [30, 40, 50, 90])
def test_jaccard_join_at_other_thresholds(spark, num):
    """Sizes, and so the widths of bitmaps, may differ by 1 / t."""
    rng = random.Random(num)
    rows = []
    for family in range(12):
        text = [f"w{family}_{i}" for i in range(rng.randint(40, 400))]
        for _ in range(8):
            cut = rng.randint(len(text) // 5, len(text))
            begin = rng.randint(0, len(text) - cut)
            rows.append((len(rows), " ".join(text[begin : begin + cut] + [f"e{len(rows)}_{i}" for i in range(rng.randint(0, 9))])))
    rows += [(len(rows), " ".join(f"z{i}" for i in range(154))), (len(rows) + 1, " ".join(f"z{i}" for i in range(68)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, jaccard_join.near_duplicates(df, num, 100).collect())) == brute_components(rows, num)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(50)} == {100} and got[300] == 200


def brute_top(vectors, k):
    fine = [(i, np.floor(1024 * np.array(v, float))) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in fine:
        if i % 100 == 0:
            scores = sorted((-int(sum(a * b for a, b in zip(q, c, strict=False))), j) for j, c in fine if j != i)[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)}
    return out


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2 + (i % 5), 12)]) for i in range(700)]
    vectors += [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (1100, [0.0] * 12), (1101, []), (1102, [1.0, 2.0]), (1104, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).repartition(3)
    got = {tuple(r) for r in mips.top_k(df, F.col("vec_id") % 100 == 0).collect()}
    assert got == brute_top(vectors, 10)
    few = df.where("vec_id < 5")
    assert {tuple(r) for r in mips.top_k(few, F.col("vec_id") % 100 == 0).collect()} == brute_top([v for v in vectors if v[0] < 5], 10)
    assert mips.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_many_query_blocks_and_stripes(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 24), ("VECTOR_BLOCK", 16), ("STRIPE", 2), ("GROUP", 2)):
        monkeypatch.setattr(mips, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8) * rng.choice([0.5, 1, 3])]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mips.top_k(df, F.col("vec_id") % 5 == 0, k=4).collect()}
    whole = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows}
    want = {}
    for q in range(0, 150, 5):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q)[:4]
        want |= {(q, place): (i, -s) for place, (s, i) in enumerate(best, 1)}
    assert got == want


def test_bounds_leave_few_pairs_to_score(spark):
    """On the test embeddings, if they are here; else on vectors of falling spectrum."""
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if os.path.exists(path):
        v = np.floor(1024 * np.array(pd.read_parquet(path)["embedding"].tolist(), float))
    else:
        v = np.floor(1024 * np.random.default_rng(6).normal(0, 1 / np.sqrt(1 + np.arange(64)), (5000, 64)))
    order = np.argsort(-np.linalg.norm(v, axis=1), kind="stable")
    basis = np.linalg.svd(v[:2048], full_matrices=True)[2].T
    block = lambda at: mips.Block(at, v[at].astype("<i4"), (v[at] @ basis).astype(np.float32))
    asked = np.arange(0, len(v), 100)
    first = mips._first_bounds(asked, v[asked], order[:1024], v[order[:1024]], 10)
    best, scored = mips.search(block(asked), first, (block(order[i : i + 512]) for i in range(0, len(v), 512)), 10)
    s = v[asked] @ v.T
    s[np.arange(len(asked)), asked] = -np.inf
    for i in range(len(asked)):
        assert best[best["at"] == i]["vec_id"].tolist() == np.lexsort((np.arange(len(v)), -s[i]))[:10].tolist()
    print("share scored in full", scored / s.size)
    assert scored < 0.3 * s.size


def test_top_k_of_huge_components_does_not_overflow(spark):
    vectors = [(0, [3e9, 1.0]), (1, [2e9, 5.0]), (2, [-3e9, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in mips.top_k(df, F.col("vec_id") == 0).collect()}
    assert got == {1: min(2**63 - 1, 6 * 10**18 * 2**20 + 5 * 2**20), 2: -(2**63)}


def test_extraction_on_unseen_templates():
    model = html_extract.fit_extractor()
    exact = 0
    for seed in range(200):
        html, kept = labelled_page(55_000_000 + seed)
        page = parse(html)
        exact += html_extract.extract_pages([page], model) == ["\n".join(t for n, t in page.runs if kept[n])]
    assert exact >= 186


def test_extraction_of_text_right_in_the_body():
    model = html_extract.fit_extractor()
    text = "An article written right into the body, as old pages do, with commas and full stops. It goes on for some sentences."
    lines = f"{text}<br><br>{text}<br>"
    both = f"{text} {text}"
    nav, ad, foot = "<nav><a href=/>Home</a> <a href=/b>News</a></nav>", "<div class=ad>Buy this now</div>", "<footer>&copy; us all</footer>"
    pages = {
        f"<html><body>{nav}{lines}</body></html>": both,
        f"<body>{lines}{ad}{lines}</body>": f"{both}\n{both}",
        f"<body><h1>A title of it</h1>{lines}<p>{text}</p>{lines}{foot}": f"A title of it\n{both}\n{text}\n{both}",
        f"<body>{nav}<article><h1>A title of it</h1><p>{text}</p></article><a href=/c>Contact</a> | <a href=/i>About us</a></body>": f"A title of it\n{text}",
        lines: both,
    }
    assert html_extract.extract_pages([parse(p) for p in pages], model) == list(pages.values())


def _overlap(make, base, meaningless):
    """(precision, recall) of words over 200 unseen pages."""
    model = html_extract.fit_extractor()
    hit = found = wanted = 0
    for seed in range(200):
        html, kept = make(base + seed, meaningless)
        page = parse(html)
        assert len(page.tags) == len(kept)
        got, want = Counter(html_extract.extract_pages([page], model)[0].split()), Counter(w for n, t in page.runs if kept[n] for w in t.split())
        hit, found, wanted = hit + (got & want).total(), found + got.total(), wanted + want.total()
    return hit / found, hit / wanted


@pytest.mark.parametrize("make, base, meaningless, least", [(labelled_page, 55_000_000, True, 0.97), (loose_page, 77_000_000, False, 0.98), (loose_page, 77_000_000, True, 0.97)])
def test_extraction_of_unseen_pages_by_words(make, base, meaningless, least):
    precision, recall = _overlap(make, base, meaningless)
    assert precision >= least and recall >= least


def test_extraction_of_pages_written_by_hand():
    model = html_extract.fit_extractor()
    got = [html_extract.extract_pages([parse(html)], model)[0].split("\n") for html, _ in PAGES]
    want = [text.split("\n") for _, text in PAGES]
    assert all(set(g) <= set(w) for g, w in zip(got, want, strict=True))  # nothing but main text
    assert all(len(w) - len(g) <= 1 for g, w in zip(got, want, strict=True))  # at most a heading is lost
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 18


@pytest.mark.parametrize("tag", ["script", "style", "noscript", "iframe", "textarea", "title"])
def test_elements_without_an_end_hold_the_rest_of_the_page(tag):
    page = parse(f"<article><p>Kept.</p><{tag} src=x>var leak = 1 <p>not text</p>")
    assert [t for _, t in page.runs] == ["Kept."]
    assert [t for _, t in parse(f"<p>A</p><{tag}>x</{tag}><p>B</p><svg><p>C</p>").runs] == ["A", "B", "C"]


def test_unknown_names_say_nothing_and_known_ones_do():
    odds = html_extract.fit_extractor().odds
    told = lambda name: odds[list(html_extract.token_buckets(name))]
    assert told("comments").min() < -1 and told("footer").min() < -1 and told("article-body").max() > 1
    assert np.abs([told(f"zq{i}x").min() for i in range(50)]).mean() < 0.5


def test_decoding_never_contradicts_itself():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 14)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        own = np.array([rng.random() < 0.4 or i not in parents for i in range(n)])
        keep = html_extract.decode(parents, own, np.array([rng.gauss(0, 2) for _ in range(n)]))
        for i in range(1, n):
            assert not keep[i] or keep[parents[i]]
            if keep[i] and not own[i]:
                assert any(keep[j] and parents[j] == i for j in range(n))


def test_decoding_is_the_best_of_all_consistent_labellings():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 9)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        own = np.array([rng.random() < 0.4 or i not in parents for i in range(n)])
        margin = np.array([rng.gauss(0, 2) for _ in range(n)])
        best = -np.inf
        for kept in itertools.product([False, True], repeat=n - 1):
            keep = [True, *kept]
            fine = all(keep[parents[i]] or not keep[i] for i in range(1, n))
            fine = fine and all(own[i] or not keep[i] or any(keep[j] and parents[j] == i for j in range(n)) for i in range(1, n))
            if fine:
                best = max(best, sum(margin[i] for i in range(1, n) if keep[i]))
        got = html_extract.decode(parents, own, margin)
        assert abs(sum(margin[1:][got[1:]]) - best) < 1e-9


def test_bitmaps_bound_the_difference_of_sets(spark):
    rng = np.random.default_rng(8)
    rows, true = [], []
    for k in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        cut = rng.random() * 0.4
        b = np.unique(np.concatenate([a[rng.random(len(a)) > cut], rng.integers(0, 2**63, int(len(a) * cut * rng.random()) + 1).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        rows.append((k, len(a), len(b), jaccard_join.bitmap(a).tolist(), jaccard_join.bitmap(b).tolist()))
        true.append(100 * both >= 75 * (len(a) + len(b) - both))
    df = spark.createDataFrame(rows, "k long, n long, m long, x array<long>, y array<long>").where("n * 100 >= m * 75 and m * 100 >= n * 75")
    got = {r.k for r in df.where(jaccard_join._may_overlap(75, 100)).collect()}
    assert {k for k, t in enumerate(true) if t} <= got and len(got) < 250


def test_extraction_of_awkward_pages(spark):
    body = "<p>First words of it, with &amp; and &eacute;.</p><p>Second   paragraph\nof the article, which goes on for some words more."
    rows = [
        (1, "u", None), (2, "u", ""), (3, None, "no markup at all"), (4, "u", "<<<>>> < a &lt;"),
        (5, "u", f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title here</h1>{body}</article><footer>&copy; us</footer>"),
        (6, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (5, "u", f"<article>{body * 400}</article>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract_main_text(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert {t for i, t, _ in got if i in (1, 2)} == {""}
    short = min((t for i, t, _ in got if i == 5), key=len)
    assert short == "Title here\nFirst words of it, with & and é.\nSecond paragraph of the article, which goes on for some words more."
    assert html_extract.extract_main_text(df.limit(0)).count() == 0
