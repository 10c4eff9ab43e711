import tracemalloc

import numpy as np

from boutlog.llm.packing import Encoder
from boutlog.llm.queries import tokenizer_path


def test_known_runs_take_little_memory():
    """Runs that a worker remembers are told apart by arrays, not by a dictionary of Python numbers (131 bytes a run before, 46 now)."""
    encoder, n = Encoder(tokenizer_path()), 150_000
    text = lambda i: " ".join(f"w{x}" for x in range(i, i + 1000)).encode()
    encoder.batch([text(n)])
    tracemalloc.start()
    for i in range(0, n, 10_000):
        encoder.batch([text(j) for j in range(i, i + 10_000, 1000)])
    held = tracemalloc.take_snapshot().filter_traces([tracemalloc.Filter(True, "*/llm/packing.py")])
    tracemalloc.stop()
    used = sum(x.size for x in held.statistics("filename"))
    assert used / n < 80
    # known runs of either kind, and new ones, have a plain encoding's ids
    for i in (0, 70_000, n - 1000, n + 5000):
        assert np.array_equal(encoder.batch([text(i)])[0], encoder.whole([text(i)])[0])
