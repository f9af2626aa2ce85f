import random

import pytest

from quoteloom.llm import leakage as k

WORDS = "amber bishop candle dolphin ember falcon garnet harbour island jasper kettle lantern magnet nectar orchid pepper quartz ribbon saffron timber umbrella velvet walnut yellow zephyr anchor barley copper dragon engine".split()


def item(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randint(100, 999)}" if j % 3 else rng.choice(WORDS) for j in range(n))


ITEMS = [(j, item(j)) for j in range(12)]
FILLER = " the handler noted loose tiles on the porch and the surveyor asked about the boiler after heavy rain " * 4


def found(text, share=0.4):
    return {i: s for i, s, _ in k.Items(ITEMS).scan(text, share)}


def part(i, a, b):
    return " ".join(ITEMS[i][1].split()[a:b])


def test_whole_part_and_none():
    assert found(FILLER + ITEMS[3][1] + FILLER) == {3: 1.0}
    assert found(FILLER + part(3, 10, 34)) == {3: 24 / 60}
    assert found(FILLER + part(3, 10, 33)) == {}
    assert found(FILLER) == {} and found("") == {} and found("a b") == {}


def test_two_stretches_in_order():
    text = part(5, 2, 16) + " " + FILLER + part(5, 30, 44)
    assert list(found(text)) == [5]
    assert found(part(5, 30, 44) + " " + FILLER + part(5, 2, 16)) == {}
    assert found(part(5, 0, 9) + FILLER + part(5, 20, 29) + FILLER + part(5, 40, 49)) == {}


def test_however_written():
    words = ITEMS[7][1].split()
    assert 7 in found(ITEMS[7][1].upper())
    assert 7 in found("\n".join(f"  {j} | {' '.join(words[j * 6 : j * 6 + 6])}" for j in range(10)))
    assert 7 in found(ITEMS[7][1].replace("a", "а").replace("e", "е"))  # look-alike letters
    assert 7 in found(ITEMS[7][1].replace("an", "a­n"))
    changed = ["perhaps" if j % 7 == 3 else w for j, w in enumerate(words)]
    assert 7 in found(" ".join(changed))


def test_shared_phrasing_is_no_leak():
    phrase = "putting things right means {} if the joinery does it or {} on the desk based view while nobody noticed that an uplift was overdue"
    items = [(j, phrase.format(1000 + j, 5000 + j)) for j in range(60)]
    assert k.Items(items).scan(FILLER + phrase.format(77, 88), 0.4) == []
    assert [i for i, _, _ in k.Items(items).scan(FILLER + items[4][1], 0.4)] == [4]


def test_tables_and_removal(spark):
    docs = [(1, FILLER + ITEMS[0][1], "x", 9), (2, None, "x", 9), (3, "", "x", 9), (4, ITEMS[1][1] + " " + ITEMS[2][1], "x", 9), (4, ITEMS[1][1] + " " + ITEMS[2][1], "x", 9), (5, FILLER * 200, None, 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, spans string, item_id int")
    i = spark.createDataFrame([*ITEMS, (99, None), (98, "")], "item_id long, item_text string")
    leaks = k.find_leaks(d, i)
    assert sorted((r.doc_id, r.item_id) for r in leaks.collect()) == [(1, 0), (4, 1), (4, 1), (4, 2), (4, 2)]
    clean = {r.doc_id: r for r in k.without_leaks(d, leaks).collect()}
    assert clean[1].text == FILLER and clean[4].text.strip() == "" and clean[2].text is None and clean[5].text == FILLER * 200 and clean[1].item_id == 9
    assert {r.doc_id for r in k.without_leaks(d, leaks, remove="documents").collect()} == {2, 3, 5}
    assert k.find_leaks(d.limit(0), i).count() == 0 and k.find_leaks(d, i.limit(0)).count() == 0


def test_pair_far_down_and_slight():
    """The second stretch counts, however many heavier ones there are and however short it is."""
    first, last = part(6, 0, 15), part(6, 48, 60)
    assert found(" ".join([(first + " " + FILLER) * 45, last])) == {6: 27 / 60}
    items = [(j, item(j, 100)) for j in range(6)]
    words = items[2][1].split()
    text = " ".join(words[:37]) + FILLER + " ".join(words[90:93])
    assert [(i, round(s, 2)) for i, s, _ in k.Items(items).scan(text, 0.4)] == [(2, 0.4)]


def test_best_two_is_that_of_all_pairs():
    rng = random.Random(5)
    for _ in range(300):
        made = []
        for _ in range(rng.randint(0, 30)):
            low, start, n = rng.randint(0, 50), rng.randint(0, 300), rng.randint(3, 20)
            made.append((n * rng.uniform(0.5, 1), low, min(low + n, 60), start, start + n))
        pairs = [x[0] + y[0] - max(0, x[2] - y[1]) for x in made for y in made if x is not y and x[2] - y[1] <= 3 and x[4] <= y[3] + 3]
        assert abs(k.best_two(made, 60) - max([0.0, *(s[0] for s in made), *pairs])) < 1e-9


def test_every_copy_is_removed(spark):
    copies = [FILLER, ITEMS[8][1], FILLER, ITEMS[8][1], FILLER, part(8, 20, 50), FILLER, ITEMS[8][1], FILLER]
    d = spark.createDataFrame([(1, " ".join(copies))], "doc_id long, text string")
    clean = k.without_leaks(d, k.find_leaks(d, spark.createDataFrame(ITEMS, "item_id long, item_text string"))).first().text
    assert not set(clean.split()) & set(ITEMS[8][1].split()) and clean.split() == (FILLER * 5).split()


def test_short_items_are_found_whole():
    known = k.Items([(1, "four five six"), (2, "Zephyr"), (3, "two words"), (4, "..."), *((10 + i, t) for i, t in ITEMS)])
    got = {i: spans for i, s, spans in known.scan("say Four, five SIX and zephyr; then two more words. four five six", 0.4)}
    assert set(got) == {1, 2} and got[1] == [(4, 18), (52, 65)]
    assert known.scan("six five four", 0.4) == [] and known.scan("six", 0.4) == [] and known.scan("", 0.4) == []


def test_too_many_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(k, "MAX_ITEM_TOKENS", 10)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        k.find_leaks(docs, spark.createDataFrame([(1, "w " * 11)], "item_id long, item_text string"))
