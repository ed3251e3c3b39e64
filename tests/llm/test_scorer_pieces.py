import tracemalloc

import numpy as np

from targetloom.llm import weak_labels


def _rows(n):
    rng = np.random.default_rng(3)
    for _ in range(n):
        yield rng.integers(0, 1 << weak_labels.SLOT_BITS, 800).astype("<i4"), rng.random(800).astype("<f4"), float(rng.random() > 0.2)


def test_training_holds_arrays_of_a_piece_not_of_the_sample():
    tracemalloc.start()
    weak_labels.train_scorer(_rows(1000), rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # the sample itself is 10 MB; a number of 8 bytes per value would add 6 MB each time


def test_pieces_change_no_weights(monkeypatch):
    pieces = weak_labels.train_scorer(_rows(200), rounds=20)
    monkeypatch.setattr(weak_labels, "PIECE_VALUES", 1 << 40)
    assert np.allclose(pieces, weak_labels.train_scorer(_rows(200), rounds=20), rtol=0, atol=1e-12)
    assert (weak_labels.train_scorer(iter([])) == 0).all()
