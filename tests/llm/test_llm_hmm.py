"""The language model on long sentences."""

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import hmm


def model(states=3, symbols=9):
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(np.zeros(0, np.uint64), norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


@pytest.mark.parametrize("most", [1, 2, 3, 7])
def test_pieces_are_their_sentence(most):
    """Whatever the length of the pieces, scales and expected counts are those of whole sentences."""
    rng, m = np.random.default_rng(2), model()
    sizes = [1, 2, 3, 4, 6, 7, 20, 21, 35, 1]
    symbol = rng.integers(0, 9, sum(sizes))
    fresh = np.zeros(len(symbol), bool)
    fresh[np.cumsum([0, *sizes[:-1]])] = True
    whole, cut = hmm.Lanes(symbol, fresh, 10**6), hmm.Lanes(symbol, fresh, most)
    assert np.allclose(whole.forward(m)[2][whole.where], cut.forward(m)[2][cut.where])
    for a, b in zip(whole.expected(m, 9), cut.expected(m, 9)):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-4)


def test_stored_blocks_are_read_one_by_one(spark, tmp_path):
    """A reader's memory is that of a row group, which grew with the split; now each block is one."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"some words of text {i}. More words.") for i in range(300)], "doc_id long, text string").repartition(2)
    words = hmm.kept_vocabulary(docs, f"file://{tmp_path}/lm")
    rows = hmm._stored(hmm.packed(docs, words, block=1000), f"file://{tmp_path}/lm/symbols")
    groups = [m.row_group(i).num_rows for p in (tmp_path / "lm/symbols").glob("*.parquet") for m in [pq.ParquetFile(p).metadata] for i in range(m.num_row_groups)]
    assert len(groups) == rows.count() > 6 and set(groups) == {1}


def test_a_long_sentence_is_one_sequence():
    text = pa.array(["word " * 300, "a b. c"])
    h, _, owner, fresh = hmm.tokens(text)
    assert np.flatnonzero(fresh).tolist() == [0, 300, 302] and len(h) == 303
    # the plain forward recursion, one word after another
    rng, m = np.random.default_rng(3), model()
    symbol = rng.integers(0, 9, 1000)
    alpha, log = m.start, 0.0
    for i, s in enumerate(symbol):
        alpha = (alpha @ m.move if i else alpha) * m.emit[s]
        log += np.log(alpha.sum())
        alpha = alpha / alpha.sum()
    lanes = hmm.Lanes(symbol, np.arange(1000) == 0)
    assert len(lanes.size) == 8 and np.isclose(np.log(lanes.forward(m)[2]).sum(), log, rtol=1e-12)
