"""What a worker of the pipeline holds."""

import tracemalloc

import pyarrow as pa

from tideline.llm import language
from tideline.llm.common import given_back, pieces


def test_grams_of_a_batch_take_little_memory_at_once():
    batch = pa.record_batch({"text": ["some words of a text " * 300] * 600})
    tracemalloc.start()
    for piece in pieces(batch, "text", language.PIECE):
        language.grams(piece.column("text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_a_task_that_gives_memory_back_loses_no_batch():
    assert list(given_back(lambda batches: (b + 1 for b in batches))([1, 2, 3])) == [2, 3, 4]
