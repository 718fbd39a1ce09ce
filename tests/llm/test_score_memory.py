"""Scoring holds few words at a time, whatever the batch."""

import tracemalloc

import numpy as np

from paysieve.llm import toxicity as X


def texts():
    r = np.random.default_rng(5)
    words = np.array([f"{chr(97 + i % 26)}word{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(5000)])
    return [" ".join(r.choice(words, 300)) for _ in range(1500)] + [None, "", "123"]


def test_peak_of_a_batch_and_scores_by_group():
    net = X.TextCnn()
    net.fitted = True
    rows = texts()
    scorer = X.Scorer(net)
    tracemalloc.start()
    got = scorer.scores(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    alone = [X.Scorer(net).scores([t])[0] for t in [*rows[:20], *rows[-3:]]]
    assert np.allclose([*got[:20], *got[-3:]], alone, atol=1e-6)


def test_rows_and_projections_are_held_once():
    words = [f"word{i}" for i in range(50_000)]
    tracemalloc.start()
    rows = X.rows_of(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * rows.nbytes and rows[7].tolist() == X.word_rows("word7") and X.rows_of([]).shape == (0, len(X.PREFIXES) + 1)
    scorer = X.Scorer(X.TextCnn())
    scorer._group([words[:10]])
    kept = scorer.shares
    scorer._group([words[5:30_000]])
    assert scorer.shares is kept and len(scorer.index) == 30_000
    assert np.allclose(kept[:10], scorer.net.project(X.rows_of(sorted(words[:10]))))
