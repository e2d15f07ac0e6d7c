"""The labelling of texts against the states that training sees."""

import numpy as np

from seqloom.llm import langid

RNG = np.random.default_rng(8)


def test_labels_are_those_of_the_training_states():
    net = langid.Network(3, hidden=5)
    x, mask = langid.padded([RNG.integers(0, 256, n).astype(np.uint8).tobytes() for n in (40, 40, 17, 1, 0)], 40)
    z = np.exp(net.states(x, mask) @ net.p["V"] + net.p["c"])
    expected = (z / z.sum(axis=2, keepdims=True)).transpose(0, 2, 1)
    got = net.probabilities(x, mask)
    assert got.shape == (40, 3, 5) and got.flags.c_contiguous
    assert np.abs((got - expected) * mask[:, None]).max() < 1e-6
