import math
import random
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import pytest

from evenkeel.functions import blocks
from evenkeel.operators.score import LEXICAL, score_lexical, with_performance


def f_measure(common, n_pred, n_gold):
    if common == 0:
        return 0.0
    p, r = common / n_pred, common / n_gold
    return 2 * p * r / (p + r)


def plain_token_f1(a, b):
    a, b = a.split(), b.split()
    if not a and not b:
        return 1.0
    return f_measure(sum((Counter(a) & Counter(b)).values()), len(a), len(b))


def plain_lcs(a, b):
    a, b = a.split(), b.split()
    row = [0] * (len(b) + 1)
    for x in a:
        previous = row[:]
        for j, y in enumerate(b):
            row[j + 1] = previous[j] + 1 if x == y else max(previous[j + 1], row[j])
    return f_measure(row[-1], len(a), len(b))


def plain_bleu(a, b):
    a, b = a.split(), b.split()
    if not a or not b or not set(a) & set(b):
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        grams = [Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b)]
        hits, total = sum((grams[0] & grams[1]).values()), max(1, len(a) - n + 1)
        logs += 0.25 * math.log((hits or 0.1) / total)
    return math.exp(logs) * (1.0 if len(a) > len(b) else math.exp(1 - len(b) / len(a)))


def scored(spark, pairs):
    rows = [(f"q{i}", a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "question_id string, response_text string, gold_answer string")
    return {r.question_id: r for r in score_lexical(df).collect()}


def test_random_pairs_against_plain_definitions(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]

    def sentence():
        return " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90)))

    pairs = [(sentence(), sentence()) for _ in range(300)]
    pairs += [(b, b) for _, b in pairs[:20]]
    got = scored(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        r = got[f"q{i}"]
        assert r.token_f1 == pytest.approx(plain_token_f1(a, b), abs=1e-12)
        assert r.rouge_l == pytest.approx(plain_lcs(a, b), abs=1e-12)
        assert r.bleu == pytest.approx(plain_bleu(a, b), abs=1e-12)
        assert r.string_similarity == pytest.approx(SequenceMatcher(None, a, b).ratio(), abs=1e-12)


def test_long_and_mixed_pairs_in_one_batch(spark):
    """Gold texts of one word of 64 bits up to more than the vectorised width, beside missing and empty ones."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    pairs = []
    for size in (0, 1, 63, 64, 65, 127, 128, 129, 300, 511, 513, 1023, 1024, 1025, 1400):
        gold = [rng.choice(words) for _ in range(size)]
        for _ in range(3):
            cut = [w for w in gold if rng.random() > 0.2]
            half = len(cut) // 2
            pairs += [(" ".join(cut), " ".join(gold)), (" ".join(cut[half:] + cut[:half] + ["other"]), " ".join(gold)), (" ".join(cut[:5]), " ".join(gold))]
    rng.shuffle(pairs)
    pairs += [(None, "a b"), ("a b", None), (None, None), ("", "")]
    got = scored(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        r = got[f"q{i}"]
        if a is None or b is None:
            assert (r.token_f1, r.rouge_l, r.bleu) == (None, None, None)
            continue
        assert r.token_f1 == pytest.approx(plain_token_f1(a, b), abs=1e-12)
        assert r.rouge_l == pytest.approx(plain_lcs(a, b), abs=1e-12)
        assert r.bleu == pytest.approx(plain_bleu(a, b), abs=1e-12)


def test_edges(spark):
    long_gold = "x" + "ab" * 99
    pairs = [
        ("", ""),
        ("", "a"),
        ("a", ""),
        ("tide", "diet"),
        ("diet", "tide"),
        ("Same answer.", "same  answer"),
        ("y" + "ab" * 99, long_gold),
        ("y" + "ab" * 99 + "a", long_gold + "a"),
        (None, "a"),
        (None, None),
    ]
    got = [scored(spark, pairs)[f"q{i}"] for i in range(len(pairs))]
    assert [r.token_f1 for r in got[:3]] == [1.0, 0.0, 0.0]
    assert [r.bleu for r in got[:3]] == [0.0, 0.0, 0.0]
    assert [r.rouge_l for r in got[:3]] == [0.0, 0.0, 0.0]
    assert (got[3].string_similarity, got[4].string_similarity) == (0.25, 0.5)
    assert (got[5].exact_match, got[5].normalized_exact_match, got[5].token_f1) == (0.0, 1.0, 1.0)
    # the junk heuristic switches on at 200 characters of gold
    assert len(long_gold) == 199 and got[6].string_similarity > 0.9 and got[7].string_similarity == 0.0
    assert all(got[8][m] is None for m in LEXICAL[2:]) and got[8].exact_match == 0.0
    assert got[9].exact_match == 1.0 and got[9].token_f1 is None


def test_missing_text_as_literal(spark):
    df = spark.createDataFrame([("q", None, "nan")], "question_id string, response_text string, gold_answer string")
    row = score_lexical(df, missing_text="nan").first()
    assert (row.exact_match, row.token_f1, row.rouge_l) == (1.0, 1.0, 1.0)


def test_hand_computed_bleu(spark):
    row = scored(spark, [("the cat sat", "the cat sat down")])["q0"]
    expected = math.exp(1 - 4 / 3) * (1.0 * 1.0 * 1.0 * 0.1) ** 0.25
    assert row.bleu == pytest.approx(expected, abs=1e-12)


def test_performance(spark):
    rows = [("10", "2000000000"), (None, "5"), ("4", "0"), ("x", "1000000"), ("4", None)]
    df = spark.createDataFrame(rows, "eval_count string, total_duration string")
    got = [tuple(r)[2:] for r in with_performance(df).collect()]
    assert got == [(10.0, 2000.0, 5.0), (None, 5e-6, None), (4.0, 0.0, None), (None, 1.0, None), (4.0, None, None)]


def plain_blocks(a, b):
    """Characters in matching blocks by trying every pair of places."""
    often = Counter(b)
    common = {c for c in often if len(b) >= 200 and often[c] > len(b) // 100 + 1}

    def box(a, b):
        best, at = 0, (0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and a[i + n] not in common:
                    n += 1
                if n > best:
                    best, at = n, (i, j)
        i, j = at
        while i and j and a[i - 1] == b[j - 1]:
            i, j, best = i - 1, j - 1, best + 1
        while i + best < len(a) and j + best < len(b) and a[i + best] == b[j + best]:
            best += 1
        return best + box(a[:i], b[:j]) + box(a[i + best :], b[j + best :]) if best else 0

    return box(a, b)


@pytest.mark.parametrize("cells, chars", [(1 << 20, 1 << 20), (40, 1 << 20), (5, 300)])
def test_matching_blocks_against_plain_search(monkeypatch, cells, chars):
    """Any list size: runs carried over between lists, pairs searched together or alone, golds shared."""
    monkeypatch.setattr(blocks, "CELLS", cells)
    monkeypatch.setattr(blocks, "CHARS", chars)
    rng = random.Random(cells)
    pairs = [(None, "a"), ("a", None), ("", ""), ("", "a"), ("a", ""), ("a" * 30, "a" * 40), ("ab" * 30, "ba" * 40)]
    for letters in ("ab", "abcdefgh ", "etaoin éß😀", "".join(map(chr, range(97, 400)))):
        for size in (1, 9, 60, 199, 200, 230):
            gold = "".join(rng.choice(letters) for _ in range(size))
            cut = rng.randrange(size)
            other = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
            pairs += [(gold[cut : cut + 60] + other + gold[: cut // 4], gold), (other, gold), (gold, gold)]
    got = blocks.matched_chars(pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()))
    want = [None if a is None or b is None else plain_blocks(a, b) for a, b in pairs]
    assert got.to_pylist() == want


def test_matching_blocks_of_an_empty_batch():
    assert blocks.matched_chars(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []
    assert blocks.matched_chars(pa.array([None], pa.string()), pa.array([None], pa.string())).to_pylist() == [None]


def test_a_pair_that_comes_again_is_searched_once(monkeypatch):
    texts = ["the quick fox", "a slow dog", None, "the quick fox", "the quick fox"]
    golds = ["quick the fox", "slow a dog", "x", "quick the fox", "fox the quick"]
    wanted = [blocks.matched_chars(pa.array([t], pa.string()), pa.array([g]))[0].as_py() for t, g in zip(texts, golds)]
    searched = []

    class Counted(blocks._Search):
        def __init__(self, pred, gold):
            searched.append(len(pred))
            super().__init__(pred, gold)

    monkeypatch.setattr(blocks, "_Search", Counted)
    assert blocks.matched_chars(pa.array(texts), pa.array(golds)).to_pylist() == wanted
    assert searched == [3]


def test_normal_forms_at_hand_are_taken(spark):
    rows = spark.sql("SELECT 'a b' AS response_text, 'A, b!' AS gold_answer, 'a b c' AS normalized_gold, 4 AS normalized_gold_tokens")
    assert score_lexical(rows, ("token_f1",)).first().token_f1 == pytest.approx(2 / 3)
