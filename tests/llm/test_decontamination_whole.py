"""Items rich in numbers or names, and copies with edited slots."""

import pytest

from driftwell.llm import decontamination

ITEMS = [
    "What is 48 / 6 + 3 * 7 - 15 + 22 * 4?",
    "Calculate 15 * 4 + 22 * 3 - 9 and 81 / 9 - 4.",
    "Der Bauer Hans kauft im Laden Brot und Milch für Anna und Peter.",
    "Which of these cities is the capital of France: Paris, Lyon, Nice, Lille?",
    "one two three four five",
]
#: Other numbers in the same places: numbers where literals are few.
OTHER = ["In 12 boxes of 40 lie 7 of 30 red and 9 of 51 blue balls", "In 15 boxes of 44 lie 8 of 31 red and 6 of 55 blue balls"]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_every_item_is_found_in_its_copy(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", broadcast)
    docs = [(i, f"so it goes. {t} and then more") for i, t in enumerate(ITEMS)] + [(50, OTHER[1]), (51, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"), (52, "What is 1 2 3 4 of it"), (53, "Der Hund Rex und Milch für Tom und Max")]
    items = [*enumerate(ITEMS), (50, OTHER[0]), (51, "9 8 7 6 5 4 3 2 1 2 3 4 5 6 7 8 9")]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.reparameterised) for r in got) == [*[(i, i, False) for i in range(len(ITEMS))], (50, 50, True)]
    assert all(r.share == 1.0 for r in got)

STORY = "the old miller said to Anna that the bridge near the quiet river would stay closed all winter and so Anna walked home through the dark forest"
BOXES = "a box holds 3 red balls and 5 blue balls in the far corner of the room"


def test_an_odd_slot_costs_its_own_windows_only(spark):
    docs = [(1, "Anna".join(STORY.split("Anna")[:2]) + "Berta" + STORY.split("Anna")[2]), (2, BOXES.replace("3", "4").replace("5", "4"))]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, STORY), (2, BOXES)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2)]
    by = {r.doc_id: r for r in got}
    assert by[2].share == 1.0 and by[1].n_windows - 5 == by[1].n_hit


COUNT = "A train covers 60 km in 2 hours while Anna counts 60 red cars near the old stone bridge by the river"


def test_numbers_and_names_are_whole(spark):
    """Signs, separators and decimals belong to a number; names may be quoted or of several words."""
    change = [COUNT.replace("60", "1,250"), COUNT.replace("Anna", '"Anna"'), COUNT.replace("Anna", "Mary Ann"), COUNT.replace("60", "75").replace("in 2 ", "in 3.5 "), COUNT.replace("60", "-7"), COUNT.replace("60 km", "7.5km").replace("60", "7.5").replace("Anna", "'Mary Ann Lee'")]
    odd = [COUNT.replace("covers 60", "covers 1.5").replace("counts 60", "counts 2.5").replace("in 2", "in 9")]
    docs = [(i, f"So it goes. {t}, they say.") for i, t in enumerate(change + odd)]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, COUNT)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.share > 0.99) == list(range(len(change))) and all(r.reparameterised == (r.doc_id != 1) for r in got if r.doc_id < len(change))
    assert all(r.doc_id < len(change) for r in got)


def test_names_cannot_hide_an_item(spark):
    items = ["Der Bauer Hans kauft Brot", "Mary Ann met Peter Pan Smith", "Who Was The First Man On The Moon", "New York and Los Angeles"]
    docs = [(i, f"say: {t} or not") for i, t in enumerate(items)] + [(9, "nothing of the kind is in here")]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(len(items))]


def test_a_document_of_one_item_over_and_over(spark):
    import time

    docs = spark.createDataFrame([(1, f"{COUNT}. " * 3200)], "doc_id long, text string")
    items = spark.createDataFrame([(1, COUNT)], "item_id long, text string")
    began = time.time()
    got = decontamination.leaks(docs, items).collect()
    assert [(r.doc_id, r.share) for r in got] == [(1, 1.0)] and time.time() - began < 60
