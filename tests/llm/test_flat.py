import random

import numpy as np
import pyarrow as pa
from brute import EDGES, LOWER, NAME_WORD, SPACE_WORD, prose, shingles

from pkgrisk.llm.flat import ALNUM, NOT_SPACE, blocks, distinct


def texts():
    rng = random.Random(1)
    return EDGES + [" ".join(prose(rng, rng.randint(0, 60))) for _ in range(60)] + [" ".join(prose(rng, 3000))]


def test_words_are_those_of_the_regular_expressions():
    for size in (64, 5000, 1 << 20):
        for member, pattern in ((NOT_SPACE, SPACE_WORD), (ALNUM, NAME_WORD)):
            for low, high, block in blocks(pa.array(texts(), pa.string()), size):
                words = block.words(member)
                for k in range(high - low):
                    own = slice(words.first[k], words.first[k + 1])
                    found = [block.data[a:b].tobytes().decode() for a, b in zip(words.starts[own], words.ends[own])]
                    assert found == pattern.findall((texts()[low + k] or "").translate(LOWER))


def test_equal_words_and_shingles_have_equal_hashes_only():
    seen: dict = {}
    for width in (2, 5):
        for low, high, block in blocks(pa.array(texts(), pa.string()), 3000):
            values, each = distinct(*block.words().shingles(width))
            ends = np.cumsum(each)
            for k in range(high - low):
                expected = shingles(texts()[low + k], width)
                assert each[k] == len(expected)
                for s in expected:
                    assert seen.setdefault((width, s), None) in (None, seen[(width, s)])
                own = frozenset(values[ends[k] - each[k]:ends[k]].tolist())
                key = (width, frozenset(expected))
                assert seen.setdefault(key, own) in (None, own)
    by_value = [v for k, v in seen.items() if isinstance(v, frozenset) and v]
    assert len(set(by_value)) == len(by_value)


def test_sliced_and_large_arrays():
    column = pa.array(["skip", None, "Two Words", "x"], pa.large_string()).slice(1)
    found = [(low, high, block.words().counts.tolist()) for low, high, block in blocks(column)]
    assert found == [(0, 3, [0, 2, 1])]
    assert list(blocks(pa.array([], pa.string()))) == []
