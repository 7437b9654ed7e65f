"""The exchanges of the packing look at every piece of a bin."""

import numpy as np

from quadfield.llm import packing


def test_partner_behind_many_pieces():
    bins = packing.Bins([30] * 29 + [100, 130], 1000)
    for item in range(30):
        bins.put(item, 0 if item else -1)
    bins.put(30, -1)
    bins.improve()
    assert bins.gap == [0, 900]


def test_two_partners_behind_many_pieces():
    bins = packing.Bins([30] * 26 + [90, 101, 220], 1000)
    for item in range(28):
        bins.put(item, 0 if item else -1)
    bins.put(28, -1)
    bins.improve()
    assert bins.gap == [0, 809] and sorted(bins.items[1]) == [26, 27]


def test_search_ends_without_a_step_left():
    sizes = np.random.default_rng(3).integers(1, 300, 3000)
    bins = packing.Bins(sizes.tolist(), 2048)
    for item in range(len(sizes)):  # any order: much to improve
        bins.put(item, bins.tightest(int(sizes[item])))
    bins.improve()
    before = [list(own) for own in bins.items]
    bins.improve()
    assert bins.items == before and sorted(i for own in before for i in own) == list(range(3000))
