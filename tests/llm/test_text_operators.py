"""Token counts, packing, quality rules and toxicity against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from turfline.llm import packing, quality_rules, token_transducer, toxicity
from turfline.llm.text_stats import text_stats

from .conftest import awkward_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "the", "ing", " ", "  ", "\n", "\t", "▁", "é", "日", "😀", "12", "<s>", "<0x0A>", "<unk>", "aaaa", "x" * 20, "\x00", "'s", "don't", "<|endoftext|>", "\x1c"]


@pytest.fixture(scope="module")
def sentencepiece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def fuzz(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def test_transducer_counts_like_the_library(sentencepiece_model):
    machine = token_transducer.compile_model(MODEL)
    for text in fuzz(1500, 1):
        assert token_transducer.count_tokens(machine, text) == len(sentencepiece_model.encode(text)), repr(text)


def test_chunk_maps_compose_wherever_a_text_is_cut(sentencepiece_model):
    machine = token_transducer.compile_model(MODEL)
    for k, text in enumerate(fuzz(1000, 2)):
        assert token_transducer.count_tokens(machine, text, chunk=1 + k % 9) == len(sentencepiece_model.encode(text)), repr(text)


def test_composition_is_associative_and_scans_like_reading():
    machine = token_transducer.compile_model(MODEL)
    rng = np.random.default_rng(3)
    chars = np.array([ord(x) for x in "".join(rng.choice(["a", "in", "t", "the", "er"], 500))], np.int64)
    entries = machine.reachable(np.unique(chars[:1]))
    assert entries is not None and len(entries) > 2
    run = np.full(600, chars[0])
    begins = np.arange(0, 600, 50)
    exits, counts = machine.read(run, np.repeat(begins, len(entries)), np.repeat(begins + 50, len(entries)), np.tile(entries, len(begins)))
    maps = [(x[None], c[None]) for x, c in zip(np.searchsorted(entries, exits).reshape(-1, len(entries)), counts.reshape(-1, len(entries)), strict=True)]
    c = token_transducer.compose
    left, right = c(c(maps[0], maps[1]), maps[2]), c(maps[0], c(maps[1], maps[2]))
    assert (left[0] == right[0]).all() and (left[1] == right[1]).all()
    whole = token_transducer.prefix_scan(np.vstack([x for x, _ in maps]), np.vstack([n for _, n in maps]))
    exit_state, count = machine.read(run, np.array([0]), np.array([600]), np.array([0]))
    assert entries[whole[0][0]] == exit_state[0] and whole[1][0] == count[0]


@pytest.mark.parametrize("unit", ["x", "ab", "=", " ", "the", "é", "日", "qz", "aeiou", "a-"])
def test_long_stretches_count_like_the_library(unit, sentencepiece_model):
    machine = token_transducer.compile_model(MODEL)
    for text in (unit * 5000, "so " + unit * 999 + " it " + unit * 77):
        assert token_transducer.count_tokens(machine, text) == len(sentencepiece_model.encode(text))
    rng = random.Random(4)
    word = "".join(rng.choices("etaoinshrdlu", k=4000))  # more states than a map holds
    assert token_transducer.count_tokens(machine, word) == len(sentencepiece_model.encode(word))


def test_tables_that_start_anew_or_grow_never_change_a_count(sentencepiece_model, monkeypatch):
    monkeypatch.setattr(token_transducer, "SLOTS", 16)
    machine = token_transducer.Transducer(token_transducer.compile_model(MODEL).pieces)
    texts = fuzz(400, 4)
    for i in range(0, 400, 40):
        assert token_transducer.count_batch(machine, texts[i : i + 40]) == [len(sentencepiece_model.encode(x)) for x in texts[i : i + 40]]
    assert len(machine.keys) > 16


def test_token_counts_of_awkward_documents(docs, no_docs, sentencepiece_model):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_transducer.token_counts(docs, MODEL).collect())
    want = Counter()
    for i, text, _, _ in awkward_rows():
        n = len(sentencepiece_model.encode(text or ""))
        want[(i, len((text or "").encode()), n, n > 4096)] += 1
    assert got == want
    assert token_transducer.token_counts(no_docs, MODEL).count() == 0


def brute_fill(counts, capacity):
    reach = {0}
    for length, n in counts.items():
        reach = {s + length * k for s in reach for k in range(n + 1) if s + length * k <= capacity}
    return max(reach)


def test_best_fill_is_the_closest_sum():
    rng = random.Random(5)
    for _ in range(300):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        capacity = rng.randint(0, 90)
        used = packing.best_fill(counts, capacity)
        assert all(used[k] <= counts[k] for k in used)
        assert sum(k * n for k, n in used.items()) == brute_fill(counts, capacity)


def test_plan_uses_every_length_once():
    histogram = {3: 10, 2047: 4, 1: 2, 700: 9, 1024: 3}
    used = Counter()
    for times, fill in packing.plan_windows(histogram):
        assert sum(k * n for k, n in fill.items()) <= 2048
        for k, n in fill.items():
            used[k] += n * times
    assert used == Counter(histogram)


def test_word_tokenizer_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = packing.word_tokenizer(VOCABULARY).ids
    for text in fuzz(1500, 6) + [t or "" for _, t, _, _ in awkward_rows()]:
        assert ids_of(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text[:80])


@pytest.mark.parametrize("unit", [" ", "\n", "\t", " \n", "x", "-", "ab ", "é", "\u3000"])
def test_very_long_runs_have_the_ids_of_tokenizers(unit):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCABULARY)
    ids_of = packing.word_tokenizer(VOCABULARY).ids
    for text in (unit * (2_000_000 // len(unit)), "word" + unit * 30_000 + "word " + unit * 25_000):
        assert ids_of(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing_covers_every_id_once(docs, no_docs):
    pieces = packing.pack_documents(docs, VOCABULARY).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    want, ids_of = Counter(), packing.word_tokenizer(VOCABULARY).ids
    for i, text, _, _ in awkward_rows():
        ids = ids_of(text) + np.array([1], "<u4").tobytes()
        for s in range(0, len(ids), 8192):
            want[(i, s // 4, len(ids[s : s + 8192]) // 4, zlib.crc32(ids[s : s + 8192]), len(ids) // 4)] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    assert packing.pack_documents(no_docs, VOCABULARY).count() == 0


def brute_stats(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(hit)


def test_text_stats_against_brute_force():
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a ", "b ", "c", "\n", "# ", "\x1c", " ", " ", "\x85 ", "é "]) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for text in [None, "", "a b c a b c", *texts]:
        assert text_stats(text) == brute_stats(text), repr(text)


def test_quality_rules_keep_clean_and_drop_junk(docs, no_docs):
    rows = {r.doc_id: r for r in quality_rules.quality_verdicts(docs).collect()}
    assert quality_rules.quality_verdicts(docs).count() == docs.count()
    assert rows[200].kept and rows[1].kept and rows[None].kept
    assert not rows[12].kept and "symbol_share" in rows[12].failed_rules
    assert rows[4].base_failed and rows[5].base_failed and rows[7].base_failed
    kept = quality_rules.keep_clean(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in quality_rules.quality_verdicts(docs).where("kept").collect())
    assert quality_rules.quality_verdicts(no_docs).count() == 0


STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def test_sketch_quantiles_are_within_their_relative_error(spark):
    rng = np.random.default_rng(0)
    x = rng.lognormal(1.5, 0.5, 4000)
    stats = spark.createDataFrame([(i, "en", f"s{i % 3}", 1000, int(1000 * v), 0, 1, 0, 0, False) for i, v in enumerate(x)], STATS)
    got = quality_rules.quantiles(quality_rules.sketch(stats), ["lang"]).where("metric = 'word_length'").first()
    assert got.total == 4000
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q99", 0.99)):
        assert abs(got[name] / np.quantile(x, q) - 1) < 0.03


def brute_verdicts(rows, prior=100.0):
    """{doc_id: failed rules}, from weighted quantiles of exact bucket values; no DataFrames."""
    gamma = 1.02 / 0.98

    def cell(x):
        return 0.0 if x < 1e-4 else 2 * gamma ** np.ceil(np.log(x) / np.log(gamma)) / (gamma + 1)

    def far(x):
        return -np.log(1 - min(x, 1 - 1e-9))

    ratio = {"word_length": (4, 3), "symbol_share": (5, 3), "dup_line_share": (7, 6), "repeat_share": (8, 3), "length": (3, None)}
    fine = [r for r in rows if not r[9]]
    out = {r[0]: [] for r in fine}
    groups = {r[1:3] for r in fine}

    def points(m, group):
        """(running weight, value) of the group's smoothed sketch, and its weight."""
        top, bottom = ratio[m]

        def spread(some):
            weight, number = Counter(), 0
            for r in some:
                x = r[top] if bottom is None else r[top] / r[bottom] if r[bottom] else 0.0
                weight[cell(x)] += r[3] if m == "symbol_share" else 1.0
                number += 1
            return weight, number

        levels = [spread(fine), spread([r for r in fine if r[1] == group[0]]), spread([r for r in fine if r[1:3] == group])]
        weight, number = levels[0]
        for own, n in levels[1:]:
            weight, number = Counter({k: own[k] + prior * weight[k] / number for k in set(own) | set(weight)}), n + prior
        run, told = 0.0, []
        for k in sorted(weight):
            run += weight[k]
            told.append((run, k))
        return told, run

    for group in groups:
        quantile = {}
        for m in ratio:
            told, mass = points(m, group)
            quantile[m] = lambda x, told=told, mass=mass: next(k for at, k in told if at >= mass * (x - 1e-9))
        room = 1 / quantile["length"](0.5) ** 0.5
        for r in fine:
            if r[1:3] != group:
                continue
            for m, (top, bottom) in ratio.items():
                if m == "length":
                    continue
                q, x, n = quantile[m], r[top] / r[bottom] if r[bottom] else 0.0, r[bottom]
                if m == "word_length":
                    width, error = 3 * (q(0.75) - q(0.25)), 0.5 * q(0.5) / n**0.5
                    bad = x > q(0.75) + width + error or x < q(0.25) - width - error
                elif m == "symbol_share":
                    bad = x**0.5 > 8 * q(0.5) ** 0.5 - 7 * q(0.25) ** 0.5 + room + 2.5 / n**0.5
                else:
                    bad = far(x) > 4 * far(q(0.99)) - 3 * far(q(0.5))
                out[r[0]] += [m] * bool(bad)
    return out


def planted_groups():
    rng = random.Random(12)
    rows = []

    def add(source, words, chars, symbols, lines, dup, repeat, lang="en", base=False):
        rows.append((len(rows), lang, source, words, chars, symbols, lines, dup, repeat, base))

    for k in range(240):
        add("prose", 200, 1000 + rng.randint(-40, 40), rng.choice([0, 0, 0, 1]), 100, 0, k % 3)
        add("code", 200, 1300 + rng.randint(-60, 60), rng.randint(40, 90), 100, rng.randint(0, 6), k % 5)
        add("poems", 200, 850 + rng.randint(-40, 40), 0, 100, k % 20, 2 * (k % 20))
    add("prose", 200, 1000, 60, 100, 0, 0)  # as code has it, but not prose
    add("code", 200, 1300, 60, 100, 0, 0)
    add("prose", 200, 1300, 0, 100, 0, 0)  # words as long as in code
    add("prose", 200, 1000, 0, 100, 40, 0)  # lines repeat as in poems
    add("poems", 200, 850, 0, 100, 40, 0)
    add("prose", 200, 1000, 0, 100, 0, 80)
    add("poems", 200, 850, 0, 100, 0, 80)
    add(None, 60, 300, 0, 10, 0, 0, None)  # groups of one row follow their parents
    add("new", 60, 300, 55, 10, 0, 0, "fr")
    add("prose", 10, 50, 0, 1, 0, 0, "en", True)
    return rows


def test_fences_follow_their_groups_as_brute_force_has_it(spark):
    rows = planted_groups()
    stats = spark.createDataFrame(rows, STATS)
    got = {r.doc_id: r for r in quality_rules.verdict(stats, quality_rules.fences(quality_rules.sketch(stats), 5)).collect()}
    want = brute_verdicts(rows, 5)
    assert {i: r.failed_rules for i, r in got.items() if not r.base_failed} == want
    assert {i: r.kept for i, r in got.items()} == {r[0]: not r[9] and not want[r[0]] for r in rows}
    base = 720
    assert want[base] == ["symbol_share"] and want[base + 1] == [] and want[base + 2] == ["word_length"]
    assert want[base + 3] == ["dup_line_share"] and want[base + 4] == []
    assert want[base + 5] == ["repeat_share"] and want[base + 6] == []
    assert sum(map(bool, want.values())) <= 8  # ordinary rows of every group stay
    one_fence = {r[0]: f for r, f in zip(rows, brute_verdicts([(*r[:1], "x", "x", *r[3:]) for r in rows], 5).values(), strict=False)}
    # A fence for all would miss the long words, and drop the code for its symbols.
    assert one_fence[base + 2] == [] and sum(one_fence[r[0]] == ["symbol_share"] for r in rows if r[2] == "code") > 200


@pytest.mark.parametrize("share", [0.0, 0.0005, 0.002, 0.02])
def test_symbols_are_judged_alike_in_short_and_long_texts(spark, share):
    """Most texts are short and hold no symbol, so their quartiles are 0, whatever the share is."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(600):
        n = int(np.exp(rng.uniform(np.log(50), np.log(300)))) if k % 6 else int(np.exp(rng.uniform(np.log(300), np.log(20_000))))
        rows.append((k, "en", "web", n, int(5 * n + rng.normal(0, 0.1) * n + rng.normal(0, 2.5) * n**0.5), int(rng.poisson(share * n)), 10, 0, 0, False))
    junk = [(1000 + i, "en", "web", n, 5 * n, int(n * (5 * share + 0.3)), 10, 0, 0, False) for i, n in enumerate([50, 200, 1000, 5000, 20_000] * 8)]
    stats = spark.createDataFrame(rows + junk, STATS)
    got = {r.doc_id: r for r in quality_rules.verdict(stats, quality_rules.fences(quality_rules.sketch(stats), 100)).collect()}
    assert sum(not got[r[0]].kept for r in rows) <= 1
    assert all(got[r[0]].failed_rules == ["symbol_share"] for r in junk)
    few = [(2000 + i, "en", "web", n, 5 * n, 7, 10, 0, 0, False) for i, n in enumerate([60, 400, 3000, 20_000])]
    told = spark.createDataFrame(rows + junk + few, STATS)
    kept = {r.doc_id: r.kept for r in quality_rules.verdict(told, quality_rules.fences(quality_rules.sketch(told), 100)).collect()}
    assert kept[2001] and kept[2002] and kept[2003]  # seven symbols in a long text are nothing


def test_every_rule_can_fire(spark):
    rows = planted_groups()
    fired = {rule for rules in brute_verdicts(rows, 5).values() for rule in rules}
    assert fired == set(quality_rules.METRICS)
    # However many lines repeat in a group, a document of nothing else fails.
    rough = [(k, "en", "s", 200, 1000, 0, 100, (k % 10) * 4, 0, False) for k in range(200)] + [(999, "en", "s", 200, 1000, 0, 100, 99, 0, False)]
    stats = spark.createDataFrame(rough, STATS)
    assert [r.doc_id for r in quality_rules.verdict(stats, quality_rules.fences(quality_rules.sketch(stats), 5)).where("NOT kept").collect()] == [999]


def labelled(spark, n=400):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(30)]
        if rng.random() < 0.5:
            words[4] = "muslims" if toxic or rng.random() < 0.3 else "people"
        if toxic:
            words[rng.randrange(30)] = rng.choice(["vileword", "vilething", "gruntfool"])
        docs.append((i, " ".join(words) + ".", "en", "s"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_ignores_group_mentions(spark):
    docs, labels = labelled(spark)
    scored = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in scored) / len(scored) > 0.95
    model = toxicity.fit(docs, labels, F.lit(True), strength=50.0)
    loose = toxicity.fit(docs, labels, F.lit(True), strength=0.0)
    gap = lambda m: abs(m.scorer()("the muslims came by today") - m.scorer()("the jews came by today"))
    assert gap(model) < 0.02 and gap(model) <= gap(loose) + 1e-9
    assert model.scorer()("a vilething here") > 0.5


def test_the_penalty_acts_where_no_text_names_a_group(spark):
    """A toxic word shares its beginning with an identity term; no labelled text holds the term itself."""
    rng = random.Random(21)
    plain = ["".join(rng.choices("cdefgh", k=4)) for _ in range(40)]
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=25)
        if i % 4 == 0:
            words[rng.randrange(25)] = rng.choice(["blackrot", "jewiwart", "deafoid", "gruntfool"])
        docs.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted = {k: toxicity.fit(docs, labels, F.lit(True), strength=k) for k in (0.0, 1.0, 20.0)}
    assert all(m.pairs > 300 for m in fitted.values())
    neutral = [" ".join([*rng.choices(plain, k=20), term]) for term in ("black", "jewish", "deaf", "muslim", "women") for _ in range(10)]
    alarms = {k: sum(m.scorer()(x) for x in neutral) for k, m in fitted.items()}
    assert alarms[1.0] < 0.7 * alarms[0.0] and alarms[20.0] < alarms[1.0]
    caught = sum(fitted[1.0].scorer()(" ".join([*rng.choices(plain, k=20), w])) >= 0.5 for w in ("blackrot", "jewiwart", "deafoid", "gruntfool"))
    assert caught == 4


def test_the_fit_is_the_minimum_of_its_loss():
    """Against plain gradient descent on the same loss, written out."""
    rng = np.random.default_rng(3)
    one = lambda k: np.hstack([rng.integers(0, 2, (k, 4)), np.ones((k, 1))]).astype(np.float32)
    x, a, b = one(60), one(12), one(12)
    y, n, times = (x[:, 0] + rng.normal(0, 0.4, 60) > 0.5).astype(float), rng.integers(1, 4, 60).astype(float), rng.integers(1, 5, 12).astype(float)
    got = toxicity._descend(x, y, n, a, b, times, 0.5, 0.01)
    w, s = np.zeros(5), lambda z: 1 / (1 + np.exp(-z))
    w[-1] = np.log((y * n).sum() / n.sum() / (1 - (y * n).sum() / n.sum()))
    for _ in range(20000):
        p, q, r = s(x @ w), s(a @ w), s(b @ w)
        slope = x.T @ (n * (p - y)) / n.sum() + 0.01 * np.array([1, 1, 1, 1, 0]) * w
        slope += 2 * 0.5 / times.sum() * (a * (times * (q - r) * q * (1 - q))[:, None] - b * (times * (q - r) * r * (1 - r))[:, None]).sum(axis=0)
        w -= 0.5 * slope
    assert np.abs(got - w).max() < 1e-3


def test_scores_are_the_logistic_sum_of_the_features_present(spark, docs):
    model = toxicity.ToxicityModel(-1.5, {"tok5": 2.0, "word*": 0.5, "one": -1.0, "tail": 3.0})
    got = Counter((r.doc_id, round(r.score, 12)) for r in toxicity.score_texts(docs, model, ["doc_id"]).collect())
    want = Counter()
    for i, text, _, _ in awkward_rows():
        words = set(__import__("re").findall(r"[^\W\d_]+", (text or "").lower()))
        names = words | {w[:k] + "*" for w in words for k in (4, 5) if len(w) >= k}
        want[(i, round(float(1 / (1 + np.exp(1.5 - sum(v for f, v in model.weights.items() if f in names)))), 12))] += 1
    assert got == want


def test_toxicity_never_reads_held_out_labels(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.in_fold(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity_scores(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_of_awkward_documents(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (12, 1, 1), (None, 1, 1), (3, 1, None), (200, 0, 0), (200, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {toxicity.ToxicityModel(-700.0).scorer()("")}
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0
    assert toxicity.keep_civil(docs, labels).columns == docs.columns
