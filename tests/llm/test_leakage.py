from __future__ import annotations

import random

import numpy as np
import pytest

from lodestream.llm import leakage as lk


def search(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, similarity string")
    e = spark.createDataFrame([(i, "s", t) for i, t in items], "item_id long, suite string, text string")
    return {(r.item_id, r.doc_id): r for r in lk.leaks(d, e, **more).collect()}


WORDS = [f"word{i}" for i in range(500)]
PICK = random.Random(9)
ITEM = " ".join(PICK.choice(WORDS) for _ in range(60))


def piece(n, start=20):
    return ITEM.split()[start : start + n]


@pytest.mark.parametrize(
    "text, words",
    [
        ("before " + " ".join(piece(12)) + " after", 12),
        (" ".join(piece(11)), None),
        (", ".join(piece(12)).upper() + "!", 12),
        ("\n> ".join(piece(14)), 14),
        ("<p>" + "</b> <b>".join(piece(13)) + "</p>", 13),
        ("**" + "**  _".join(piece(15)) + "_", 15),
        ("x " * 50_000 + ITEM, 60),
        (" ".join(piece(8)) + " other " + " ".join(piece(9, 30)), None),
        ("", None),
        (None, None),
    ],
)
def test_passages_in_disguise(spark, text, words):
    got = search(spark, [(1, text)], [(7, ITEM), (8, "short item")])
    found = lk.full_matches  # the filter on the length of the common run
    assert found.__name__ == "full_matches"
    runs = {k: r.shared_words for k, r in got.items() if r.shared_words >= lk.WINDOW}
    assert runs == ({(7, 1): words} if words else {})


def test_random_corpus_against_brute_force(spark):
    pick = random.Random(2)
    items = [(i, " ".join(pick.choice(WORDS[:40]) for _ in range(30))) for i in range(12)]
    docs = []
    for i in range(120):
        text = [pick.choice(WORDS) for _ in range(40)]
        if pick.random() < 0.6:
            source, n = pick.choice(items)[1].split(), pick.randint(8, 16)
            at = pick.randint(0, 30 - n)
            text[10:10] = source[at : at + n]
        docs.append((i, " ".join(text)))
    windows = lambda t: {tuple(t.split()[k : k + 12]) for k in range(len(t.split()) - 11)}
    want = {(a, b) for a, x in items for b, y in docs if windows(x) & windows(y)}
    for more in ({}, {"item_bytes": 600}):
        assert {k for k, r in search(spark, docs, items, **more).items() if r.shared_words >= 12} == want


def test_repeated_rows_and_empty_tables(spark):
    assert len(search(spark, [(1, ITEM), (1, ITEM)], [(7, ITEM), (7, ITEM)])) == 1
    assert search(spark, [(1, ITEM)], []) == {} and search(spark, [], [(7, ITEM)]) == {}


@pytest.mark.parametrize("radius", [2, 7, 11])
def test_hamming_blocks_miss_nothing(radius):
    rng = np.random.default_rng(3)
    stored = rng.integers(0, 2**63, size=300).astype(np.uint64)
    base = rng.integers(0, 300, size=400)
    asked = stored[base].copy()
    for i in range(400):
        for b in rng.choice(64, size=rng.integers(0, 15), replace=False):
            asked[i] ^= np.uint64(1 << int(b))
    left, right = lk.Blocks(stored, radius).candidates(asked)
    near = np.argwhere(np.bitwise_count(asked[:, None] ^ stored[None, :]) <= radius)
    assert set(zip(left.tolist(), right.tolist())) == set(map(tuple, near.tolist())) and len(near) > 20


def test_edited_items_are_found(spark):
    """One word in ten replaced, dropped or doubled, so that few runs of 12 words stay: recall of 0.9 at least, nothing else found."""
    pick = random.Random(4)
    items = [(i, " ".join(pick.choice(WORDS) for _ in range(pick.randint(38, 96)))) for i in range(120)]
    docs, wanted = [], set()
    for i in range(360):
        text = [pick.choice(WORDS) for _ in range(60)]
        if i % 3 == 0:
            own = items[i // 3][1].split()
            for k in range(pick.randrange(5, 10), len(own), 10):
                own[k] = pick.choice([f"other{k}", "", f"{own[k]} {own[k]}"])
            text[30:30] = " ".join(own).split()
            wanted.add((i // 3, i))
        docs.append((i, " ".join(text)))
    got = search(spark, docs, items)
    assert set(got) <= wanted and len(got) >= 0.9 * len(wanted)
    assert all(r.similarity >= lk.LEAST_SIMILARITY for r in got.values()) and not any(r.shared_words for r in got.values())


def test_similarity_by_hand():
    a, b = np.array([1, 2, 3, 1, 2]), np.array([1, 2, 3, 0, 2])
    assert lk.weighted_similarity(a, b) == pytest.approx(2 / 6) and lk.weighted_similarity(a, a) == 1.0
    assert lk.lengths(17) == [] and lk.lengths(18) == [18] and max(lk.lengths(5000)) <= 5000


@pytest.mark.parametrize("tag", ['<a href="' + "x" * 500 + '">', "<span\n class='b'\n>", "<!-- a b c -->", "<p>"])
def test_markup_of_any_length_is_no_word(tag):
    assert lk.words(f"one {tag} two") == ["one", "two"]


def test_comparisons_are_no_markup():
    assert lk.words("for i<n; i++ then\n x>y") == ["for", "i", "n", "i", "then", "x", "y"]


def test_fingerprint_is_a_majority():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, size=30).astype(np.uint64)
    for at, value in enumerate(lk.fingerprints(h, 12)):
        plain = sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in h[at : at + 12]) > 6)
        assert int(value) == plain
