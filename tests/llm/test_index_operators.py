"""Best-two-fit packing, vector codes and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from turfline.llm import ranked_search, two_fit, vector_codes

from .conftest import awkward_rows

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


# Best-two-fit packing


def test_the_pair_is_the_tightest():
    rng = random.Random(1)
    for _ in range(300):
        left = {rng.randint(1, 40): rng.randint(0, 2) for _ in range(rng.randint(1, 9))}
        above, most, least = rng.randint(0, 30), rng.randint(1, 60), rng.randint(1, 10)
        flat = sorted(k for k, n in left.items() for _ in range(n) if k >= least)
        pairs = [(a, b) for i, a in enumerate(flat) for b in flat[i + 1 :] if above < a + b <= most]
        want = min(pairs, key=lambda p: (-sum(p), p[0]), default=None)
        assert two_fit.tightest_pair(left, above, most, least) == want


def test_bins_repeated_by_count_are_those_found_one_at_a_time():
    for seed in range(40):
        rng = random.Random(seed)
        capacity = rng.choice([30, 100])
        lengths = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 150)))
        for least in (1, capacity // 6, capacity):
            got = Counter({tuple(sorted(used.items())): 0 for _, used in two_fit.plan_with(lengths, capacity, least)})
            for times, used in two_fit.plan_with(lengths, capacity, least):
                got[tuple(sorted(used.items()))] += times
            left, want = Counter(lengths), Counter()
            while +left:
                used = two_fit.fill_bin(dict(+left), capacity, least)
                want[tuple(sorted(used.items()))] += 1
                left -= Counter(used)
            assert got == want


def test_a_replaced_document_lessens_the_gap():
    # 60 and then 30 leave 10; 20 and 19 fit the gap of 40 better than 30.
    assert two_fit.greedy_fill({60: 1, 30: 1, 20: 1, 19: 1}, 100) == {60: 1, 30: 1}
    assert two_fit.fill_bin({60: 1, 30: 1, 20: 1, 19: 1}, 100) == {60: 1, 20: 1, 19: 1}
    plan = two_fit.plan_bins({60: 2, 30: 2, 20: 2, 19: 2}, 100)
    assert sum(times for times, _ in plan) == 3


def test_plans_are_never_longer_than_first_fit_decreasing():
    for seed in range(30):
        rng = random.Random(seed)
        lengths = Counter(min(1023, int(rng.lognormvariate(5, 1)) + 1) for _ in range(rng.randint(1, 800)))
        bins = []
        for k in sorted(lengths.elements(), reverse=True):
            at = next((i for i, x in enumerate(bins) if x + k <= 1024), None)
            if at is None:
                bins.append(k)
            else:
                bins[at] += k
        plan = two_fit.plan_bins(lengths)
        assert sum((Counter({k: n * times for k, n in used.items()}) for times, used in plan), Counter()) == lengths
        assert all(sum(k * n for k, n in used.items()) <= 1024 for _, used in plan)
        assert math.ceil(sum(lengths.elements()) / 1024) <= sum(times for times, _ in plan) <= len(bins)


def test_two_fit_pieces_hold_every_id_once(docs, no_docs):
    pieces = two_fit.pack_two_fit(docs, VOCABULARY).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, text, _, _ in awkward_rows():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, two_fit.CLOSING_ID]
        first = len(ids) % 1024
        cuts = [0, *range(first or 1024, len(ids), 1024), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    places = defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
    for place in places.values():
        end = 0
        for offset, length in sorted(place):
            assert offset == end
            end += length
        assert end <= 1024
    assert two_fit.pack_two_fit(no_docs, VOCABULARY).count() == 0


# Vector codes


def brute_codes(rows, entries=256, rounds=4):
    """{row number: (vec_id, code, error, label_error)} and the digest, with Python's integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    part = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // 4))
    kept = [(i, v + [0] * (4 * part - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * part : (p + 1) * part] for _, v, _ in first] for p in range(4)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((distance(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            groups = defaultdict(list)
            for _, v, _ in kept:
                x = v[p * part : (p + 1) * part]
                groups[nearest(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(books[p])]
    found = []
    for i, v, label in kept:
        got = [nearest(v[p * part : (p + 1) * part], books[p]) for p in range(4)]
        found.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label))
    sums = Counter()
    for _, _, error, label in found:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return Counter((i, code, min(error, 2**63 - 1), min(sums[label], 2**63 - 1), digest) for i, code, error, label in found)


VECTORS = "vec_id long, embedding array<double>, label int, pos string, weight string, _key string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "x", "x") for i, v, label in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e8])
def test_codes_are_those_of_plain_lloyd(spark, scale):
    rng = random.Random(int(scale))
    shared = [rng.gauss(0, scale) for _ in range(8)]
    rows = [(i, shared if i % 3 == 0 else [rng.gauss(0, scale) for _ in range(8)], rng.choice([1, 2, None])) for i in range(90)]
    rows += [(5, [scale / 2] * 8, 1), (5, [scale / 2] * 8, 1), (None, [0.25] * 8, None)]
    rows += [(200, None, 1), (201, [1.0, None] + [0.0] * 6, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] * 8, 2), (204, [1.0, -2.0, 3.0], 2), (205, [], 2)]
    for entries in (7, 256):
        got = vector_codes.compress_vectors(_vectors(spark, rows), entries=entries)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert Counter(map(tuple, got.collect())) == brute_codes(rows, entries)


def test_codes_of_few_or_no_vectors(spark):
    assert vector_codes.compress_vectors(_vectors(spark, [(1, None, 1)])).count() == 0
    one = [(1, [1.0, 2.0, 3.0, 4.0], None)]
    assert Counter(map(tuple, vector_codes.compress_vectors(_vectors(spark, one)).collect())) == brute_codes(one)
    hot = [(i, [0.5, -0.5, 0.25, 1.0], 3) for i in range(3000)] + [(9000 + i, [i / 50, 0.0, -i / 9, 1.0], i % 3) for i in range(40)]
    assert Counter(map(tuple, vector_codes.compress_vectors(_vectors(spark, hot)).collect())) == brute_codes(hot)


# Ranked search


def brute_search(docs, items, k):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    found = []
    for item, text in items:
        asked = Counter(TERM.findall(lower(text)))
        scores = []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        found += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return Counter(found)


def _tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", "x", 0) for i, t in docs], "doc_id long, text string, row string, n string, terms int").repartition(5)
    return d, spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id long, text string, term string, doc_id int")


def _corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Éa", "日本", "x1Y"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=rng.randint(1, 120)))) for i in range(n)]
    docs += [(1000 + i, docs[0][1]) for i in range(60)] + [(None, docs[1][1]), (3, docs[3][1]), (3, docs[3][1]), (2000, None), (2001, ""), (2002, " .,\x00- ")]
    docs += [(2003, "w1 " * 500_000 + "W5")]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 30)))) for i in range(20)]
    items += [(5, items[5][1]), (None, "w7 W7 w9"), (50, None), (51, "..."), (52, "unheard"), (53, "x1y éa 日本 Éa")]
    return docs, items


@pytest.mark.parametrize("tiers, candidates", [(((5, 0.0), (60, 0.0)), 2_000), (((40, 0.0), (400, 0.0)), 3), (ranked_search.TIERS, 2_000)])
def test_the_best_are_those_of_all_scores(spark, monkeypatch, tiers, candidates):
    monkeypatch.setattr(ranked_search, "TIERS", tiers)
    monkeypatch.setattr(ranked_search, "CANDIDATES", candidates)
    docs, items = _corpus(4, 400)
    report = []
    got = ranked_search.ranked_search(*_tables(spark, docs, items), k=10, report=report)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items, 10)
    if tiers[0][0] == 5:  # some items are proved above, some fall to the lowest tier
        assert sum(report[0][:2]) > 0 and report[0][2] > 0


def test_items_in_many_blocks_and_indexes(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "INDEX_TERMS", 100)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 4)
    docs, items = _corpus(8, 60)
    assert Counter(map(tuple, ranked_search.ranked_search(*_tables(spark, docs, items), k=3).collect())) == brute_search(docs, items, 3)


def test_bars_bound_what_a_tier_leaves_out(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "TIERS", ((5, 0.0), (60, 0.0)))
    docs, items = _corpus(5, 300)
    d, _ = _tables(spark, docs, items)
    numbers = {t: i for i, t in enumerate(sorted({t for _, text in items for t in ranked_search.term_counts(text)}))}
    index = ranked_search.build_index(d, numbers)
    rows = [r for r in index.rows.collect()]
    for i, size in enumerate((5, 60)):
        kept = {(r["row"], t): f for r in index.tiers[i].collect() for t, f in zip(r["terms"], r["fs"], strict=True)}
        held = Counter(t for _, t in kept)
        assert max(held.values()) <= size
        for r in rows:
            for t, tf in zip(r["terms"], r["tfs"], strict=True):
                f = int(ranked_search.impacts(np.array([tf]), np.array([r["n"]]), index.documents, index.terms)[0])
                assert kept.get((r["row"], t), f) == f and ((r["row"], t) in kept) == (f > index.bars[i][t])


def test_long_texts_are_counted_in_slices(monkeypatch):
    monkeypatch.setattr(ranked_search, "SLICE", 7)
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices("abAB \n.-é日0_`@[{\x00", k=rng.randint(0, 80)))
        want = Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
        assert {k.decode(): n for k, n in ranked_search.term_counts(text).items()} == want


def test_ranked_search_of_awkward_and_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "word1 word2"), (2, "one")], "item_id long, text string")
    got = ranked_search.ranked_search(docs, items)
    want = brute_search([(i, t) for i, t, _, _ in awkward_rows()], [(1, "word1 word2"), (2, "one")], 10)
    assert Counter(map(tuple, got.collect())) == want
    assert ranked_search.ranked_search(no_docs, items).count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0
