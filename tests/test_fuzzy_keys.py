"""Names that lie near share a key, in every way of keying."""

import random

import numpy as np
import pytest

from kinweave.functions import names
from kinweave.operators import fuzzy


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _edited(rng: random.Random, a: str, most: int) -> str:
    for _ in range(rng.randint(0, most)):
        i = rng.randint(0, len(a))
        a = rng.choice((a[:i] + rng.choice("abcd") + a[i:], a[:i] + a[i + 1 :], a[:i] + rng.choice("abcd") + a[i + 1 :]))
    return a


def _keys(name: str, *how) -> set:
    codes = np.array([list(map(ord, name))], np.uint64).reshape(1, len(name))
    return set(fuzzy._keys(codes, *how)[0].tolist())


@pytest.mark.parametrize("most", range(5))
@pytest.mark.parametrize("fixed", (False, True))
@pytest.mark.parametrize("block", (False, True))
def test_near_names_share_a_key(most, fixed, block):
    rng = random.Random(most)
    for table, top in ((fuzzy.WHOLE, 26), (fuzzy.WHOLE_GROUPED, 14), ({most: 5}, 16)):
        tried = 0
        while tried < 150:
            a = "".join(rng.choices("abcd", k=rng.randint(1, top)))
            b = _edited(rng, a, most)
            if _edits(a, b) > names.allowed_edits(len(a), most, fixed) or (block and a[:1] != b[:1]):
                continue
            tried += 1
            assert _keys(a, True, most, fixed, min(table[most], 12), block) & _keys(b, False, most, fixed, min(table[most], 12), block), (a, b)


def test_long_names_have_few_keys():
    """Names of 33 characters had some 2,800 keys each."""
    long = np.ones((1, 33), np.uint64)
    assert fuzzy._keys(long, True, 4, False, fuzzy.WHOLE[4], True).shape[1] < 120
    assert fuzzy._keys(long, False, 4, False, fuzzy.WHOLE[4], True).shape[1] == 5
